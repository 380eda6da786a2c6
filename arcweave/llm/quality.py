"""Quality rules whose cutoffs come from labelled holdouts with exact binomial guarantees.

Base rules (fixed): a text with under 20 words, or with more than 30 % of its words in
eight-word windows that the text repeats, fails. Every other text gets five rates, and a rate
over its cutoff rejects it. Cutoffs are whole percents, chosen per stratum (language) and rate:

* Holdout: all labelled texts that pass the base rules; copies of one text in a stratum count
  once, since they are not independent draws. Nothing is fitted before, so none is set aside.
* For each cutoff, the number of good texts over it is binomial under its true false-rejection
  rate. The exact test of "that rate is above ``alpha / rates``" has the p-value
  ``P(Bin(n_good, alpha / rates) <= rejected)`` (the dual of the exact upper bound).
* Multiple testing: Bonferroni over strata and rates; inside one, fixed-sequence testing from
  the laxest cutoff down to the first that fails, which needs no further correction.
* So with confidence ``1 - delta``, all chosen cutoffs at once reject at most ``alpha`` of the
  good texts of every stratum.
* Of the certified cutoffs, the one with the largest gain counts (bad texts rejected minus
  ``GOOD_COST`` times good ones); of equal ones the middle. No gain: the rate rejects nothing.

All labelled rows take part, through one histogram per stratum and rate (102 bins); only that
small table meets in a task, one stratum at a time.

Defined results: a null text has no words and fails; a null stratum is a stratum; several
labels of one id count as good if one is; null labels do not count; a stratum with too few good
labels certifies nothing and only the base rules apply; an empty label table likewise; rows with
the same id are judged by their own texts; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import stored
from arcweave.llm.wordhash import chunks, mix, split_words, text_buffer

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
ALPHA = 0.05   # false rejections per stratum, over all rates
DELTA = 0.05   # chance that any of the bounds fails
GOOD_COST = 10
#: rate: (numerator, denominator)
RATES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "stutter": ("n_stutter", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_capitals", "n_stutter", "n_lines")
_STRUCT = "struct<" + ",".join(f"{f}:bigint" for f in FEATURES) + ">"


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pa.Array) -> pa.Array:
    """The counts of ``FEATURES`` for every text."""
    data, offsets = text_buffer(texts)
    symbol = np.zeros(256, dtype=bool)
    symbol[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = True
    out = {f: np.zeros(len(offsets) - 1, dtype=np.int64) for f in FEATURES}
    for i, j in chunks(offsets):
        off = offsets[i:j + 1]
        w = split_words(data, off)
        b, bounds = w.data, w.offsets
        solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
        out["n_words"][i:j] = np.diff(w.first)
        out["word_chars"][i:j] = _per_doc(solid & ((b & 0xC0) != 0x80), bounds)
        out["n_symbols"][i:j] = _per_doc(symbol[b], bounds)
        out["n_capitals"][i:j] = _per_doc((b >= 65) & (b <= 90), bounds)
        h, doc = w.hashes(), w.doc_of_word()
        if len(h):
            same = np.zeros(len(h), dtype=bool)
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            out["n_stutter"][i:j] = _per_doc(same, w.first)
        k = REPEAT_WINDOW
        if len(h) >= k:
            whole = doc[k - 1:] == doc[:len(h) - k + 1]
            win = w.windows(h, k) + mix(doc[:len(whole)].astype(np.uint64) + np.uint64(1))
            s = np.sort(win[whole])
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            if len(twice):
                at = np.flatnonzero(whole & np.isin(win, twice))
                step = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + k, -1)
                out["n_repeat_words"][i:j] = _per_doc(np.cumsum(step)[:-1] > 0, w.first)
        for d in range(j - i):
            out["n_lines"][i + d], out["n_dup_lines"][i + d] = _lines(b[bounds[d]:bounds[d + 1]].tobytes())
    return pa.StructArray.from_arrays([pa.array(out[f]) for f in FEATURES], list(FEATURES))


def features(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum, text hash ``h``, the counts and ``base_failed``; one row per input row."""
    udf = F.arrow_udf(measure, _STRUCT)
    f = F.col("f")
    out = df.select(F.col(key).alias("key"), F.col(stratum).cast("string").alias("stratum"),
                    F.xxhash64(F.col(text)).alias("h"), udf(F.col(text)).alias("f"))
    out = out.select("key", "stratum", "h", *[f[c].alias(c) for c in FEATURES])
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def _bin(rate: str) -> Column:
    """Percent of the rate, rounded up and at most 101: over cutoff c exactly if the bin is over c."""
    num, den = (F.col(c) for c in RATES[rate])
    return F.when(den > 0, F.least(F.ceil(num * 100.0 / den), F.lit(101))).otherwise(F.lit(0)).cast("int")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, m = 1e-300, 1.0, 0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d, c = 1.0 + coef * d, 1.0 + coef / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-14:
            return front * total


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact."""
    if k >= n:
        return 1.0
    return beta_inc(n - k, k + 1, 1.0 - p)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate with ``k`` of ``n`` seen, at confidence 1 - error."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > error else (lo, mid)
    return hi


def choose_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int | None:
    """Cutoff (percent) for one histogram of good and bad texts by bin; None if no certified one gains."""
    over_good = good.sum() - np.cumsum(good)
    over_bad = bad.sum() - np.cumsum(bad)
    best, gain = [], 0
    for c in range(100, -1, -1):
        if binomial_cdf(int(over_good[c]), int(good.sum()), alpha) > delta:
            break
        g = int(over_bad[c]) - GOOD_COST * int(over_good[c])
        if g > gain:
            best, gain = [c], g
        elif g == gain and best:
            best.append(c)
    return best[len(best) // 2] if best else None


def cutoffs(feat: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
            alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labelled texts: ``stratum`` and ``cut_<rate>`` (null: no cutoff)."""
    lab = (labels.filter(F.col(label).isNotNull())
           .groupBy(F.col(key).alias("lkey")).agg(F.max(label).alias("good")))
    marked = (feat.filter(~F.col("base_failed"))
              .join(lab, F.col("key") == F.col("lkey"))
              .groupBy("stratum", "h")
              .agg(F.max("good").alias("good"), *[F.min(_bin(r)).alias(r) for r in RATES]))
    hist = (marked.select("stratum", "good", F.explode(F.array(*[
                F.struct(F.lit(r).alias("rate"), F.col(r).alias("bin")) for r in RATES])).alias("x"))
            .groupBy("stratum", "x.rate", "x.bin", "good").agg(F.count(F.lit(1)).alias("n")))
    hist = stored(hist, "histogram")
    n_strata = hist.select(F.countDistinct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull()).alias("n_strata"))
    names = list(RATES)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": pdf["stratum"].iloc[0]}
        tests = int(pdf["n_strata"].iloc[0]) * len(names)
        for r in names:
            x = pdf[pdf["rate"] == r]
            side = [np.bincount(y["bin"], weights=y["n"], minlength=102).astype(np.int64)
                    for y in (x[x["good"] > 0], x[x["good"] <= 0])]
            row[f"cut_{r}"] = choose_cutoff(side[0], side[1], alpha / len(names), delta / tests)
        return pd.DataFrame([row]).astype({f"cut_{r}": "Int32" for r in names})

    schema = "stratum string," + ",".join(f"cut_{r} int" for r in names)
    return hist.crossJoin(F.broadcast(n_strata)).groupBy("stratum").applyInPandas(choose, schema)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          stratum: str = "lang", label: str = "quality") -> DataFrame:
    """key, stratum, h, all counts, base_failed, ``failed`` (names of the rates over their cutoff) and kept."""
    feat = stored(features(df, key, text, stratum), "features")
    cut = stored(cutoffs(feat, labels, key, label), "cutoffs").withColumnRenamed("stratum", "cstratum")
    failed = F.filter(F.array(*[F.when(_bin(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RATES]),
                      lambda x: x.isNotNull())
    out = (feat.join(cut, F.col("stratum").eqNullSafe(F.col("cstratum")), "left")
           .withColumn("failed", failed)
           .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
    return out.select(F.col("key").alias(key), "stratum", "h", *FEATURES, "base_failed", "failed", "kept")


def keep_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents that pass, with all their columns."""
    out = stored(judge(df, labels, key, text, **kw)
                 .filter(~F.col("kept")).select(F.col(key).alias("__key"), F.col("h").alias("__h")).distinct(),
                 "rejected")
    return df.join(out, df[key].eqNullSafe(out["__key"]) & (F.xxhash64(df[text]) == out["__h"]), "left_anti")
