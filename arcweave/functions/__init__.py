"""Column functions (section 2C): built-in expressions only."""

from arcweave.functions.geometry import (LINE_TYPE, curved_line, curved_midpoint, haversine_km,
                                         line_length_km, parse_linestring, plainly_line, point,
                                         straight_line, to_linestring)
from arcweave.functions.numeric import (at_digits, ces_exponent, iceberg_cost, increase, normalise,
                                        pct_gain, perc_upgraded, production, round_sig,
                                        transform_value, transport_cost, utility,
                                        widen_domain)
from arcweave.functions.text import parse_progress, progress_distance, progress_iteration
from arcweave.functions.util import as_col, finite_or_null, fixed_point_text, plain_number

__all__ = [
    "LINE_TYPE", "as_col", "at_digits", "ces_exponent", "curved_line", "curved_midpoint", "finite_or_null",
    "fixed_point_text", "haversine_km", "iceberg_cost", "increase", "line_length_km",
    "normalise", "parse_linestring", "parse_progress", "pct_gain", "perc_upgraded", "plainly_line", "point",
    "production", "progress_distance", "progress_iteration", "round_sig", "straight_line",
    "to_linestring", "transform_value", "transport_cost", "utility", "widen_domain",
]
