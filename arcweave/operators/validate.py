"""Typing and validation rules (section 2B).

Every rule returns rows of one findings table::

    severity string, rule string, entity string, key long, message string

Column-level rules (types, ranges, signs) are computed for all columns in one
aggregate pass and unpivoted; row-level rules (references, self-loops,
duplicates, bounds) emit one row per offending edge, keyed by ``edge_id``.
Nothing is collected; the findings stay a distributed table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions import finite_or_null, parse_linestring
from arcweave.functions.sums import exact_sums
from arcweave.operators.arcs import PAIR, with_pair
from arcweave.session import ensure_checkpoint_dir

FINDINGS_SCHEMA = "severity string, rule string, entity string, key long, message string"
FINDING_COLUMNS = [c.split()[0] for c in FINDINGS_SCHEMA.split(", ")]

# The required columns of each table.
NODE_REQUIRED = ["node", "lon", "lat", "population", "productivity"]
EDGE_REQUIRED = ["from", "to", "delta_i", "delta_tau", "Ijk"]
NODE_INT_COLS = ["node"]
NODE_FLOAT_COLS = ["lon", "lat", "population", "productivity"]
EDGE_INT_COLS = ["from", "to"]
EDGE_FLOAT_COLS = ["delta_i", "delta_tau", "Ijk"]
EDGE_OPTIONAL_FLOAT = ["Il", "Iu"]

HOUSING_ABSENT = "housing absent, derived from population"
HOUSING_GAPS = "housing incomplete, derived from population"
GEOMETRY_BAD = "geometry unreadable, drawn straight"
# A number: digits with an optional point and exponent, or a word for a non-finite value.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
WHOLE = r"^[+-]?\d+$"


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS_SCHEMA)


def _finding(severity: str, rule: str, entity: str, key: Column | None,
             message: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
            F.lit(entity).alias("entity"),
            (key.cast("long") if key is not None else F.lit(None).cast("long")).alias("key"),
            message.alias("message")]


def _txt(c: Column) -> Column:
    return c.cast("string")


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _column_findings(stats: DataFrame, specs: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Unpivot a one-row aggregate of counters into findings where the counter is > 0.

    ``specs``: (counter column, severity, rule, entity, message prefix).
    """
    rows = [F.struct(F.col(c).alias("n"), F.lit(sev).alias("severity"), F.lit(rule).alias("rule"),
                     F.lit(ent).alias("entity"), F.lit(msg).alias("msg"))
            for c, sev, rule, ent, msg in specs]
    return (stats.select(F.inline(F.array(*rows)))
            .filter(F.col("n") > 0)
            .select("severity", "rule", "entity", F.lit(None).cast("long").alias("key"),
                    F.concat(F.col("msg"), F.lit(" ("), _txt(F.col("n")),
                             F.lit(" rows)")).alias("message")))


# ------------------------------------------------------------------ B1


def require_columns(df: DataFrame, required: list[str], entity: str) -> DataFrame:
    """B1: one error listing the missing required columns (metadata only, no scan)."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    if not missing:
        return empty_findings(spark)
    msg = f"{entity}: absent {', '.join(missing)}; needed {', '.join(required)}"
    return spark.createDataFrame([("error", "B1", entity, None, msg)], FINDINGS_SCHEMA)


# ------------------------------------------------------------------ B2, B3


def _blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw.cast("string")) == "")


def coerced_double(raw: Column) -> Column:
    """B2 value: text -> double; blank or no number (also ``5d``, ``1.5f``) -> null."""
    text = F.trim(raw.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coerced_long(raw: Column) -> Column:
    """B3 value: text -> long. Plain digits are read exactly; ``3.0`` is accepted, ``3.7``,
    non-finite and too large values -> null."""
    text = F.trim(raw.cast("string"))
    d = coerced_double(raw)
    # NaN and the infinities are not below the bound
    ok = d.isNotNull() & (F.abs(d) < F.lit(2.0 ** 63)) & (F.floor(d) == d)
    return F.when(text.rlike(WHOLE), text.try_cast("long")).when(ok, F.floor(d).cast("long"))


def coerce_table(raw: DataFrame, entity: str, int_cols: list[str], float_cols: list[str],
                 optional_float: list[str] = (), optional_int: list[str] = ()
                 ) -> tuple[DataFrame, DataFrame]:
    """B2 + B3 for all listed columns at once.

    Returns (typed table, findings). Findings come from one aggregate with two
    counters per column: missing values and values that do not parse.
    """
    typed_cols, counters, specs = [], [], []
    present = set(raw.columns)
    for c in raw.columns:
        col = F.col(f"`{c}`")
        if c in int_cols or c in optional_int:
            typed_cols.append(coerced_long(col).alias(c))
            bad = ~_blank(col) & coerced_long(col).isNull()
            kind = "holds something else than whole numbers"
        elif c in float_cols or c in optional_float:
            typed_cols.append(coerced_double(col).alias(c))
            bad = ~_blank(col) & coerced_double(col).isNull()
            kind = "holds something else than numbers"
        else:
            typed_cols.append(col)
            continue
        rule = "B3" if (c in int_cols or c in optional_int) else "B2"
        counters.append(F.count_if(bad).alias(f"bad_{c}"))
        specs.append((f"bad_{c}", "error", rule, entity, f"{c} {kind}"))
        if c in int_cols or c in float_cols:
            counters.append(F.count_if(_blank(col)).alias(f"miss_{c}"))
            specs.append((f"miss_{c}", "error", rule, entity,
                          f"{c} has blanks"))
    typed = raw.select(*typed_cols)
    if not counters or not (present & set(int_cols + float_cols + list(optional_float)
                                          + list(optional_int))):
        return typed, empty_findings(raw.sparkSession)
    return typed, _column_findings(raw.agg(*counters), specs)


def typed_view(df: DataFrame, int_cols: list[str], float_cols: list[str]) -> DataFrame:
    """Cast already-typed inputs (e.g. Parquet) to the engine's types without findings."""
    cols = []
    for c in df.columns:
        if c in int_cols:
            cols.append(F.col(f"`{c}`").cast("long").alias(c))
        elif c in float_cols:
            cols.append(F.col(f"`{c}`").cast("double").alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


# ------------------------------------------------------------------ B4


def resolve_housing_policy(nodes: DataFrame) -> DataFrame:
    """A warning when ``housing`` is absent or has a missing value (then it is ignored)."""
    if "housing" not in nodes.columns:
        # one row for a table with any row
        any_row = nodes.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
        return any_row.select(*_finding("warning", "B4", "nodes", None, F.lit(HOUSING_ABSENT)))
    stats = nodes.agg(F.count_if(_blank(F.col("housing"))).alias("n_missing"))
    return _column_findings(stats, [("n_missing", "warning", "B4", "nodes", HOUSING_GAPS)])


def drop_incomplete_housing(nodes: DataFrame) -> DataFrame:
    """The node table without ``housing`` values if any of them is missing.

    The column stays (as nulls) so that the schema does not depend on the data; all users of
    housing treat a column with nulls as absent.
    """
    if "housing" not in nodes.columns:
        return nodes
    gaps = nodes.agg(F.count_if(_blank(F.col("housing"))).alias("_gaps"))  # one row
    return (nodes.crossJoin(F.broadcast(gaps))
            .withColumn("housing", F.when(F.col("_gaps") == 0, F.col("housing"))).drop("_gaps"))


# ------------------------------------------------------------------ B5 – B9, B16


def _nonfinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def _fails(c: Column, ok: Column) -> Column:
    """Null-safe failure test: NaN and infinities fail; nulls are B2's business."""
    return c.isNotNull() & (_nonfinite(c) | ~ok)


def check_consecutive_ids(nodes: DataFrame) -> DataFrame:
    """Node ids must be exactly 1..J (count, min, max, distinct — no sort)."""
    s = nodes.agg(F.count(F.lit(1)).alias("j"), F.min("node").alias("lo"),
                  F.max("node").alias("hi"), F.count_distinct("node").alias("nd"))
    bad = ~((F.col("lo") == 1) & (F.col("hi") == F.col("j")) & (F.col("nd") == F.col("j")))
    return s.filter(bad & (F.col("j") > 0)).select(*_finding(
        "error", "B5", "nodes", None,
        F.concat(F.lit("numbering has holes or repeats: rows "), _txt(F.col("j")),
                 F.lit(", lowest "), _txt(F.col("lo")), F.lit(", highest "), _txt(F.col("hi")))))


NODE_RULES = [
    # (counter, severity, rule, message) ; predicates built in check_node_values
    ("lon", "B6", "lon beyond 180 degrees"),
    ("lat", "B6", "lat beyond 90 degrees"),
    ("population", "B7", "population zero or less"),
    ("productivity", "B7", "productivity below zero"),
    ("product", "B8", "product below one"),
]


def check_node_values(nodes: DataFrame) -> DataFrame:
    """B6, B7, B8 in one aggregate pass over the node table."""
    c = F.col
    preds = {
        "lon": _fails(c("lon"), c("lon").between(-180, 180)),
        "lat": _fails(c("lat"), c("lat").between(-90, 90)),
        "population": _fails(c("population"), c("population") > 0),
        "productivity": _fails(c("productivity"), c("productivity") >= 0),
    }
    if "product" in nodes.columns:
        preds["product"] = c("product").isNotNull() & (c("product") < 1)
    stats = nodes.agg(*[F.count_if(p).alias(f"n_{k}") for k, p in preds.items()])
    specs = [(f"n_{k}", "error", rule, "nodes", msg) for k, rule, msg in NODE_RULES if k in preds]
    return _column_findings(stats, specs)


def _unreadable(geometry: Column) -> Column:
    """A text that is no line; the parse comes first, where its repeated parts are evaluated once."""
    return parse_linestring(geometry).isNull() & geometry.isNotNull()


def check_edge_values(edges: DataFrame) -> DataFrame:
    """B9 (and B16 when a ``geometry`` column exists) in one aggregate pass."""
    c = F.col
    aggs = [F.count_if(_fails(c(k), c(k) >= 0)).alias(f"n_{k}") for k in EDGE_FLOAT_COLS]
    specs = [(f"n_{k}", "error", "B9", "edges", f"{k} below zero")
             for k in EDGE_FLOAT_COLS]
    if "geometry" in edges.columns:
        g = c("geometry")
        aggs.append(F.count_if(_unreadable(g)).alias("n_geom"))
        specs.append(("n_geom", "warning", "B16", "edges",
                      GEOMETRY_BAD))
    return _column_findings(edges.agg(*aggs), specs)


def check_geometry(edges: DataFrame) -> DataFrame:
    """B16 alone: one warning with the count of non-null texts that do not parse."""
    g = F.col("geometry")
    stats = edges.agg(F.count_if(_unreadable(g)).alias("n_geom"))
    return _column_findings(stats, [("n_geom", "warning", "B16", "edges",
                                     GEOMETRY_BAD)])


# ------------------------------------------------------------------ B10 – B13


BROADCAST_IDS = 100_000  # unknown ids; more are joined without a hint


def unknown_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``end``: the distinct ids at the ends of edges that are no node; only ids are shuffled."""
    ends = edges.select(F.explode(F.array("from", "to")).alias("end")).filter(F.col("end").isNotNull()).distinct()
    return ends.join(nodes.select(F.col("node").alias("end")), "end", "left_anti")


def reference_flags(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``ref_ok``: both endpoints exist in ``nodes``.

    The unknown ids are found first and stored; the driver sees their number. Without any, which is the rule, edges
    are not joined at all; with few they are broadcast, and otherwise AQE's skew-join split handles a hub.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    unknown = unknown_ends(edges, nodes).checkpoint()
    n, ok = unknown.count(), F.col("from").isNotNull() & F.col("to").isNotNull()
    if n == 0:
        return edges.withColumn("ref_ok", ok)
    unknown = F.broadcast(unknown) if n <= BROADCAST_IDS else unknown
    f_bad = unknown.select(F.col("end").alias("from"), F.lit(True).alias("_f_bad"))
    t_bad = unknown.select(F.col("end").alias("to"), F.lit(True).alias("_t_bad"))
    return (edges.join(f_bad, "from", "left").join(t_bad, "to", "left")
            .withColumn("ref_ok", ok & F.col("_f_bad").isNull() & F.col("_t_bad").isNull())
            .drop("_f_bad", "_t_bad"))


def _row_finding(when: Column, severity: str, rule: str, message: Column) -> Column:
    """One finding about an edge row, or null."""
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                 F.lit("edges").alias("entity"),
                                 F.col("edge_id").cast("long").alias("key"),
                                 message.alias("message")))


def _edge(*rest) -> Column:
    return F.concat(F.lit("edge "), _txt(F.col("edge_id")), *[
        F.lit(x) if isinstance(x, str) else _txt(x) for x in rest])


def _reference_rule(bad: Column) -> Column:
    return _row_finding(bad, "error", "B10", _edge(": unknown endpoint, ", F.col("from"), " > ", F.col("to")))


def _loop_rule(good: Column) -> Column:
    return _row_finding(good & (F.col("from") == F.col("to")), "error", "B11",
                        _edge(": both ends at ", F.col("from")))


def _duplicate_rule(good: Column) -> Column:
    return _row_finding(good & (F.col("edge_id") != F.col("first_id")), "error", "B12",
                        _edge(" repeats edge ", F.col("first_id"), " between ", F.col("from"),
                              " and ", F.col("to")))


def _bound_rules(good: Column, columns: list[str]) -> list[Column]:
    """Non-finite bounds mean "unbounded" and are no finding."""
    ijk, out = F.col("Ijk"), []
    if "Il" in columns:
        out.append(_row_finding(good & (finite_or_null(F.col("Il")) > ijk), "warning", "B13",
                                _edge(": Il above Ijk, cut to Ijk")))
    if "Iu" in columns:
        out.append(_row_finding(good & (finite_or_null(F.col("Iu")) < ijk), "warning", "B13",
                                _edge(": Iu below Ijk, lifted to Ijk")))
    return out


def _emit(edges: DataFrame, rules: list[Column]) -> DataFrame:
    """All row rules of the edges in one pass."""
    if not rules:
        return empty_findings(edges.sparkSession)
    return edges.select(F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))


def check_references(flagged: DataFrame) -> DataFrame:
    """One error per edge whose endpoint is not a node (input from ``reference_flags``)."""
    return _emit(flagged, [_reference_rule(~F.col("ref_ok"))])


def check_self_loops(edges: DataFrame) -> DataFrame:
    """One error per self-loop ``from = to``."""
    return _emit(edges, [_loop_rule(F.lit(True))])


def with_first_of_pair(edges: DataFrame) -> DataFrame:
    """Edges with ``first_id``: the smallest ``edge_id`` of their undirected pair, null if it is the only one.

    ``min(edge_id)`` per pair is a partial aggregate (a pair holding a third of
    all rows is combined map-side); only pairs seen more than once join back. Edges stored by pair are not shuffled.
    """
    keyed = with_pair(edges)
    firsts = (keyed.groupBy(*PAIR)
              .agg(F.min("edge_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") > 1).drop("_n"))
    return keyed.join(firsts, list(PAIR), "left").select(*[F.col(f"`{c}`") for c in edges.columns], "first_id")


def check_duplicates(edges: DataFrame) -> DataFrame:
    """Second and later occurrences of an undirected pair (by ``edge_id`` order)."""
    return _emit(with_first_of_pair(edges.select("edge_id", "from", "to")), [_duplicate_rule(F.lit(True))])


def check_bounds(edges: DataFrame) -> DataFrame:
    """``Il > Ijk`` and ``Iu < Ijk`` are warnings (values are clamped later)."""
    return _emit(edges, _bound_rules(F.lit(True), edges.columns))


def check_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """B10–B13 in one pass; an edge with an unknown endpoint gets no other finding.

    All edges of a pair have the same endpoints, so the first of a pair can be
    found before the endpoints are known to be good.
    """
    cols = ["edge_id", "from", "to", "Ijk", *[c for c in (*EDGE_OPTIONAL_FLOAT, *PAIR) if c in edges.columns]]
    flagged = reference_flags(with_first_of_pair(edges.select(*cols)), nodes)
    good = F.col("ref_ok")
    return _emit(flagged, [_reference_rule(~good), _loop_rule(good), _duplicate_rule(good),
                           *_bound_rules(good, cols)])


# ------------------------------------------------------------------ B14 (needs B15)


def unreachable_finding(components: DataFrame, root: int = 1) -> DataFrame:
    """One warning with the number of nodes not in the root's component."""
    root_c = components.filter(F.col("node") == root).select(F.col("component").alias("rc"))
    n = (components.crossJoin(F.broadcast(root_c))  # at most one row
         .agg(F.count_if(F.col("component") != F.col("rc")).alias("n_unreachable")))
    return n.filter(F.col("n_unreachable") > 0).select(*_finding(
        "warning", "B14", "nodes", None,
        F.concat(F.lit(f"nodes without a path to {root}: "), _txt(F.col("n_unreachable")))))


# ------------------------------------------------------------------ B17, B18


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row ``n_errors, n_warnings, valid``. A network that lacks a table (the finding with
    severity ``info``) is not valid."""
    return findings.agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_if(F.col("severity") == "info").alias("_half")).withColumn(
        "valid", (F.col("n_errors") == 0) & (F.col("_half") == 0)).drop("_half")


def network_summary(nodes: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """One row ``n_nodes, n_edges, n_goods`` (goods = max(product) or 1)."""
    spark = (nodes if nodes is not None else edges).sparkSession
    if nodes is not None:
        g = F.max("product") if "product" in nodes.columns else F.lit(1)
        ns = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), g.cast("int").alias("n_goods"))
    else:
        ns = spark.range(1).select(F.lit(0).cast("long").alias("n_nodes"),
                                   F.lit(1).alias("n_goods"))
    es = (edges.agg(F.count(F.lit(1)).alias("n_edges")) if edges is not None
          else spark.range(1).select(F.lit(0).cast("long").alias("n_edges")))
    return ns.crossJoin(es).select("n_nodes", "n_edges",
                                   F.coalesce(F.col("n_goods"), F.lit(1)).alias("n_goods"))


# ------------------------------------------------------------------ B19, B20


def check_solution(arcs: DataFrame, K, rtol: float = 1e-3, atol: float = 1e-6,
                   infra_col: str = "ijk") -> DataFrame:
    """Budget exhausted (``Σ δi·I ≈ 2K``) and bounds respected, on an arc table.

    ``arcs`` carries ``delta_i, Il, Iu`` (effective bounds, null = unbounded) and
    the solved infrastructure; ``K`` is a number or a one-row frame with ``K``.
    Returns one row: spent, budget, budget_ok, n_below, n_above, and n_percent (rows whose
    ``perc_upgraded``, if there is such a column, is outside 0..100).
    """
    i = F.col(infra_col)
    percent = F.col("perc_upgraded") if "perc_upgraded" in arcs.columns else F.lit(None).cast("double")
    counts = arcs.agg(
        F.count_if(i < F.col("Il") - atol).alias("n_below"),
        F.count_if(F.col("Iu").isNotNull() & (i > F.col("Iu") + atol)).alias("n_above"),
        F.count_if(~percent.between(-atol, 100 + atol)).alias("n_percent"))
    stats = counts.crossJoin(exact_sums(arcs, {"spent": F.col("delta_i") * i}))  # one row each
    if isinstance(K, DataFrame):
        stats = stats.crossJoin(F.broadcast(K.agg(F.max("K").alias("K"))))  # one row
    else:
        stats = stats.withColumn("K", F.lit(float(K)))
    budget = F.col("K") * 2
    return stats.select("spent", budget.alias("budget"),
                        (F.abs(F.col("spent") - budget) <= F.lit(rtol) * budget).alias("budget_ok"),
                        "n_below", "n_above", "n_percent")


def check_params(scenarios: DataFrame) -> DataFrame:
    """Parameter rules on a scenario table, one finding per violated rule and scenario."""
    c = F.col
    rules = [
        ("warning", (c("gamma") > c("beta")) & ~c("annealing"),
         "gamma above beta without annealing"),
        ("error", c("duality") & (c("labor_mobility") | (c("beta") > 1)),
         "duality with mobile labour or beta above 1"),
        ("error", c("a") > 1, "a above 1"),
        ("error", c("nu") < 1, "nu below 1"),
        ("error", (c("alpha") <= 0) | (c("alpha") >= 1), "alpha not between 0 and 1"),
    ]
    parts = [scenarios.filter(pred).select(*_finding(
        sev, "B20", "scenarios", c("scenario_id"),
        F.concat(F.lit("scenario "), _txt(c("scenario_id")), F.lit(": " + msg))))
        for sev, pred, msg in rules]
    return union_findings(parts)
