"""Scalar column functions for model formulas and result metrics.

Every function returns a ``Column`` built from Spark built-ins, so Catalyst sees
through it and it stays inside whole-stage codegen. "No value" and "unbounded"
are carried as SQL NULL; NaN and infinities never leave these functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcweave.functions.util import as_col, finite_or_null

# Fixed values that must equal the reference's for the same results.
ICEBERG_SLOPE = 0.1158826      # iceberg friction per log-mile
MILE_KM = 1.609                # km per mile in the iceberg formula
EARTH_RADIUS_KM = 6371.0       # great-circle radius
GAP_TOLERANCE = 1e-12          # percent-upgraded: cap at or below the old level
INCREASE_TOLERANCE = 1e-9      # percent-upgraded: smallest counted increase
GAIN_TOLERANCE = 1e-12         # percent gain: smallest usable baseline magnitude
DEGENERATE_WIDTH = 1e-9        # scale domain widened by this when hi <= lo


def iceberg_cost(km, floor: float = 0.0) -> Column:
    """C4: ``max(0.1158826·ln(km/1.609), floor)``; km = 0 gives the floor, km < 0 gives null."""
    km = as_col(km)
    raw = F.lit(ICEBERG_SLOPE) * F.log(km / F.lit(MILE_KM))
    return (F.when(km > 0, F.greatest(raw, F.lit(float(floor))))
            .when(km == 0, F.lit(float(floor))))


def at_digits(x, digits: int, whole) -> Column:
    """``x`` rounded to ``digits`` significant digits by ``whole``, a rounding to whole doubles; not finite -> NaN.

    One of the two units is 1, so each step is exact where it was with a case for each sign. Without cases and
    decimals the generated method of a dozen columns stays below the 8,000 bytes beyond which the JVM runs it interpreted.
    """
    x = as_col(x)
    scale = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))  # null for 0, which ``greatest`` passes over
    up, down = (F.pow(F.lit(10.0), F.greatest(s, F.lit(0).cast("long"))) for s in (scale, -scale))
    return whole(x * up / down) / up * down + F.lit(0.0)  # no negative zero


def round_sig(x, digits: int = 7) -> Column:
    """Round to ``digits`` significant digits (half to even); NaN/inf/null -> null."""
    return F.nanvl(at_digits(x, digits, F.rint), F.lit(None).cast("double"))


def perc_upgraded(new, old, iu, cap) -> Column:
    """Share of the headroom ``cap − old`` that was built, clamped to 0..100.

    ``iu`` null or not finite means the edge is unbounded and the global ``cap`` is used instead.
    """
    new, old, iu, cap = as_col(new), as_col(old), as_col(iu), as_col(cap)
    limit = F.coalesce(finite_or_null(iu), cap)
    gap = limit - old
    share = (new - old) / gap * F.lit(100.0)
    return (F.when(gap <= GAP_TOLERANCE,
                   F.when(new - old > INCREASE_TOLERANCE, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))))


def pct_gain(new, old) -> Column:
    """C11: ``(new − old)/|old|·100``; null when ``|old|`` is at most 1e-12."""
    new, old = as_col(new), as_col(old)
    return F.when(F.abs(old) > GAIN_TOLERANCE, (new - old) / F.abs(old) * F.lit(100.0))


def increase(new, old) -> Column:
    """``max(new − old, 0)``."""
    return F.greatest(as_col(new) - as_col(old), F.lit(0.0))


TRANSFORMS = ("level", "log", "log10", "log1p", "sqrt", "cbrt")


def transform_value(x, name: str) -> Column:
    """C14: value transform with domain guards; out-of-domain values become null."""
    x = as_col(x)
    if name == "level":
        return x
    if name == "log":
        return F.when(x > 0, F.log(x))
    if name == "log10":
        return F.when(x > 0, F.log10(x))
    if name == "log1p":
        return F.when(x > -1, F.log1p(x))
    if name == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if name == "cbrt":
        return F.cbrt(x)
    raise ValueError(f"unknown transform {name!r}; expected one of {TRANSFORMS}")


def widen_domain(lo, hi) -> Column:
    """Upper end of a scale domain: ``hi`` unless ``hi <= lo``, then ``lo + 1e-9``."""
    lo, hi = as_col(lo), as_col(hi)
    return F.when(hi > lo, hi).otherwise(lo + F.lit(DEGENERATE_WIDTH))


def normalise(x, lo, hi) -> Column:
    """Min-max scale to [0, 1] with clamping; ``hi`` must already be widened.
    A missing (out-of-domain) value stays null."""
    x, lo, hi = as_col(x), as_col(lo), as_col(hi)
    t = (x - lo) / (hi - lo)
    return F.when(t.isNotNull(), F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def utility(c, h, alpha, rho) -> Column:
    """Per-capita utility ``((c^α·h^(1−α))^(1−ρ))/(1−ρ)``; ρ = 1 and non-finite results give null."""
    c, h, alpha, rho = as_col(c), as_col(h), as_col(alpha), as_col(rho)
    inner = F.pow(c, alpha) * F.pow(h, F.lit(1.0) - alpha)
    value = F.pow(inner, F.lit(1.0) - rho) / (F.lit(1.0) - rho)
    return finite_or_null(F.when(rho != 1, value))


def transport_cost(delta_tau, q, infra, beta, gamma) -> Column:
    """Per-unit transport cost ``δτ·Q^β / I^γ``; null where I is zero."""
    delta_tau, q, infra = as_col(delta_tau), as_col(q), as_col(infra)
    beta, gamma = as_col(beta), as_col(gamma)
    return finite_or_null(F.try_divide(delta_tau * F.pow(q, beta), F.pow(infra, gamma)))


def production(z, labour, a) -> Column:
    """``Z·L^a``."""
    return finite_or_null(as_col(z) * F.pow(as_col(labour), as_col(a)))


def ces_exponent(sigma) -> Column:
    """Inner exponent ``(σ−1)/σ`` of the CES aggregate."""
    sigma = as_col(sigma)
    return (sigma - F.lit(1.0)) / sigma
