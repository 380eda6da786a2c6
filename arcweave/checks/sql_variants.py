"""SQL CTEs for the network variants, NET-N, NET-D and the run log (DuckDB oracle)."""

from __future__ import annotations

from arcweave.checks.sqlparts import NET_T, fp, hav, iceberg, lat, lon

S = '("from" + "to")'


NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
WHOLE = r"^[+-]?\d+$"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def dbl(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def lng(x: str) -> str:
    d = dbl(x)
    return (f"(CASE WHEN regexp_matches(trim({x}), '{WHOLE}') THEN TRY_CAST(trim({x}) AS BIGINT) "
            f"WHEN {d} IS NOT NULL AND abs({d}) < 9223372036854775808 AND floor({d}) = {d} "
            f"THEN CAST(floor({d}) AS BIGINT) END)")


def fails(c: str, ok: str) -> str:
    return f"({c} IS NOT NULL AND (isnan({c}) OR isinf({c}) OR NOT ({ok})))"


def col_findings(source: str, specs: list[tuple[str, str, str, str, str]]) -> str:
    """UNION ALL of one finding per spec whose counter is positive.

    ``specs``: (predicate, severity, rule, entity, message prefix).
    """
    counters = ", ".join(f"count_if({p}) AS n{i}" for i, (p, *_) in enumerate(specs))
    parts = []
    for i, (_p, sev, rule, ent, msg) in enumerate(specs):
        m = msg.replace("'", "''")
        parts.append(f"SELECT '{sev}' AS severity, '{rule}' AS rule, '{ent}' AS entity, "
                     f"CAST(NULL AS BIGINT) AS key, '{m} (' || CAST(n{i} AS VARCHAR) || ' rows)' "
                     f"AS message FROM stats WHERE n{i} > 0")
    return f"(WITH stats AS (SELECT {counters} FROM {source}) {' UNION ALL '.join(parts)})"


def coerce_specs(cols: list[tuple[str, str, bool]], entity: str) -> list:
    """(column, 'int'|'float', required) -> B2/B3 specs over a raw text table."""
    specs = []
    for c, kind, req in cols:
        q = f'"{c}"'
        val = lng(q) if kind == "int" else dbl(q)
        rule = "B3" if kind == "int" else "B2"
        word = f"holds something else than {'whole ' if kind == 'int' else ''}numbers"
        specs.append((f"NOT {blank(q)} AND {val} IS NULL", "error", rule, entity,
                      f"{c} {word}"))
        if req:
            specs.append((blank(q), "error", rule, entity, f"{c} has blanks"))
    return specs


NODE_COERCE = [("node", "int", True), ("lon", "float", True), ("lat", "float", True),
               ("population", "float", True), ("productivity", "float", True),
               ("product", "int", False)]
EDGE_COERCE = [("from", "int", True), ("to", "int", True), ("delta_i", "float", True),
               ("delta_tau", "float", True), ("Ijk", "float", True), ("Il", "float", False),
               ("Iu", "float", False)]


def node_value_specs(product: bool = True) -> list:
    specs = [
        (fails("lon", "lon BETWEEN -180 AND 180"), "error", "B6", "nodes",
         "lon beyond 180 degrees"),
        (fails("lat", "lat BETWEEN -90 AND 90"), "error", "B6", "nodes",
         "lat beyond 90 degrees"),
        (fails("population", "population > 0"), "error", "B7", "nodes",
         "population zero or less"),
        (fails("productivity", "productivity >= 0"), "error", "B7", "nodes",
         "productivity below zero"),
    ]
    if product:
        specs.append(("product IS NOT NULL AND product < 1", "error", "B8", "nodes",
                      "product below one"))
    return specs


def edge_value_specs() -> list:
    return [(fails(c, f"{c} >= 0"), "error", "B9", "edges", f"{c} below zero")
            for c in ("delta_i", "delta_tau", "Ijk")]


def typed_nodes(src: str) -> str:
    return (f"SELECT {lng('node')} AS node, {dbl('lon')} AS lon, {dbl('lat')} AS lat, "
            f"{dbl('population')} AS population, {dbl('productivity')} AS productivity, "
            f"{lng('product')} AS product FROM {src}")


def typed_edges(src: str) -> str:
    return (f'SELECT edge_id, {lng(chr(34) + "from" + chr(34))} AS "from", '
            f'{lng(chr(34) + "to" + chr(34))} AS "to", {dbl("delta_i")} AS delta_i, '
            f'{dbl("delta_tau")} AS delta_tau, {dbl("Ijk")} AS Ijk, {dbl("Il")} AS Il, '
            f'{dbl("Iu")} AS Iu FROM {src}')


TXT = "CAST({} AS VARCHAR)"


def t(x: str) -> str:
    return TXT.format(x)


VARIANTS = [
    ("vrange_nodes", f"""SELECT node, CASE WHEN node % 17 = 0 THEN lon + 200 ELSE lon END AS lon,
        lat, CASE WHEN node % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE population END AS population,
        CASE WHEN node % 19 = 0 THEN -productivity ELSE productivity END AS productivity,
        product, name FROM tnodes"""),
    ("vrange_edges", f"""SELECT * REPLACE (CASE WHEN {S} % 29 = 0 THEN -delta_i ELSE delta_i END
        AS delta_i) FROM tedges"""),
    ("vbounds_edges", f"""SELECT * REPLACE (CASE WHEN {S} % 3 = 0 THEN Ijk + 1 ELSE Il END AS Il,
        CASE WHEN {S} % 4 = 0 THEN Ijk - 1 ELSE Iu END AS Iu) FROM tedges"""),
    ("vorphan_nodes", "SELECT * FROM tnodes WHERE node % 97 <> 0"),
    ("vtypes_nodes", f"""SELECT
        CASE WHEN node % 7 = 0 THEN {t('node')} || '.0' ELSE {t('node')} END AS node,
        CASE WHEN node % 31 = 0 THEN '' ELSE {t('lon')} END AS lon, {t('lat')} AS lat,
        {t('population')} AS population,
        CASE node % 13 WHEN 0 THEN 'x' WHEN 1 THEN '5d' WHEN 2 THEN '1.5f' ELSE {t('productivity')} END AS productivity,
        CASE node % 11 WHEN 0 THEN '3.7' WHEN 1 THEN '9007199254740993' WHEN 2 THEN '3.0' ELSE {t('product')} END AS product, name
        FROM tnodes"""),
    ("vtypes_edges", f"""SELECT edge_id,
        CASE WHEN {S} % 3 = 0 THEN {t('"from"')} || '.0' ELSE {t('"from"')} END AS "from",
        CASE WHEN {S} % 43 = 0 THEN {t('"to"')} || '.5' ELSE {t('"to"')} END AS "to",
        {t('delta_i')} AS delta_i,
        CASE WHEN {S} % 37 = 0 THEN 'x' ELSE {t('delta_tau')} END AS delta_tau,
        CASE WHEN {S} % 41 = 0 THEN '' ELSE {t('Ijk')} END AS Ijk, {t('Il')} AS Il,
        CASE WHEN {S} % 47 = 0 THEN 'x' ELSE {t('Iu')} END AS Iu, geometry FROM tedges"""),
    ("vnan_nodes", f"""SELECT {t('node')} AS node,
        CASE WHEN node % 29 = 0 THEN 'NaN' ELSE {t('lon')} END AS lon, {t('lat')} AS lat,
        {t('population')} AS population,
        CASE WHEN node % 37 = 0 THEN 'Inf' ELSE {t('productivity')} END AS productivity,
        {t('product')} AS product FROM tnodes"""),
    ("vnan_edges", f"""SELECT edge_id, {t('"from"')} AS "from", {t('"to"')} AS "to",
        CASE WHEN {S} % 43 = 0 THEN 'NaN' ELSE {t('delta_i')} END AS delta_i,
        {t('delta_tau')} AS delta_tau, {t('Ijk')} AS Ijk, {t('Il')} AS Il,
        CASE WHEN {S} % 19 = 0 THEN 'Inf' ELSE {t('Iu')} END AS Iu FROM tedges"""),
]

_km = hav(lon('"from"'), lat('"from"'), lon('"to"'), lat('"to"'))

DUP = [
    ("vdup_lines", """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
             CASE WHEN l_returnflag = 'R' THEN CAST(nsup.n_sup + o_custkey + 1 AS BIGINT)
                  ELSE CAST(l_suppkey + 1 AS BIGINT) END AS "from",
             CASE WHEN l_returnflag = 'R' THEN CAST(l_suppkey + 1 AS BIGINT)
                  ELSE CAST(nsup.n_sup + o_custkey + 1 AS BIGINT) END AS "to"
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN nsup"""),
    ("vdup_edges", f"""
      SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                l_shipdate) AS edge_id, "from", "to",
             1 + (("from" * 31 + "to") % 97) / 10 AS delta_i,
             {iceberg(_km, 0.005)} AS delta_tau,
             CAST(20 + CAST(floor(l_quantity) AS BIGINT) % 61 AS DOUBLE) AS Ijk
      FROM vdup_lines"""),
]

NATION = [
    ("nlines", """
      SELECT CAST(a.nationkey + 1 AS BIGINT) AS src, CAST(b.nationkey + 1 AS BIGINT) AS dst,
             CAST(l.l_partkey % 5 + 1 AS INTEGER) AS good, l.l_quantity
      FROM tlines l JOIN tnodes a ON a.node = l.supp_node JOIN tnodes b ON b.node = l.cust_node"""),
    ("nnodes", f"""SELECT CAST(n_nationkey + 1 AS BIGINT) AS node, {lon('n_nationkey + 1')} AS lon,
        {lat('n_nationkey + 1')} AS lat, CAST(1 AS DOUBLE) AS population,
        CAST(1 AS DOUBLE) AS productivity, CAST(n_regionkey + 1 AS INTEGER) AS product,
        n_name AS name FROM nation"""),
    ("nedges", """SELECT lo * 4294967296 + hi AS edge_id, lo AS "from", hi AS "to",
        CAST(1 AS DOUBLE) AS delta_i, CAST(0.1 AS DOUBLE) AS delta_tau,
        CAST(20 + CAST(floor(qty) AS BIGINT) % 61 AS DOUBLE) AS Ijk
        FROM (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, sum(l_quantity) AS qty
              FROM nlines GROUP BY least(src, dst), greatest(src, dst)) p"""),
    ("nflow", "SELECT src, dst, good, sum(l_quantity) AS q FROM nlines GROUP BY src, dst, good"),
]

DOMESTIC = [
    ("dedges", """SELECT e.* FROM tedges e JOIN tnodes a ON a.node = e."from"
        JOIN tnodes b ON b.node = e."to" WHERE a.nationkey = b.nationkey"""),
    ("darcs", 'SELECT "from" AS src, "to" AS dst FROM dedges WHERE "from" <> "to" '
              'UNION ALL SELECT "to", "from" FROM dedges WHERE "from" <> "to"'),
    ("dreach(node, lbl)", """SELECT node, node FROM tnodes
        UNION SELECT a.dst, r.lbl FROM dreach r JOIN darcs a ON a.src = r.node"""),
    ("dcomp", "SELECT node, min(lbl) AS component FROM dreach GROUP BY node"),
]


def _num(x: str, scale: int) -> str:
    return fp(x, scale)


RUNLOG = [
    ("ev", "SELECT CAST(user_id AS BIGINT) AS run_id, event_id, event_type, value, "
           "CAST(round(value * 100) AS BIGINT) AS h, CAST(round(value * 10) AS BIGINT) AS d "
           "FROM events"),
    ("runlog", f"""
      SELECT run_id, event_id, 'Iteration No. ' || CAST(row_number() OVER (PARTITION BY run_id
             ORDER BY event_id) AS VARCHAR) || ' distance=' || {_num('h', 2)} || ' duration=' ||
             {_num('d', 1)} || ' secs. Welfare=' || {_num('-h', 2)} AS line
      FROM ev WHERE event_type = 'error'
      UNION ALL
      SELECT run_id, event_id, CASE
        WHEN event_type = 'purchase' THEN '[app] Solve finished in ' || {_num('d', 1)} || ' s.'
        WHEN event_type = 'click' AND value > 300
          THEN '[app] Abort requested (event)'
        WHEN event_type = 'view' AND value > 300
          THEN '[app] Solve FAILED after ' || {_num('d', 1)} || ' s.'
        WHEN event_type = 'signup' THEN '[app] Building model: ' || CAST(run_id AS VARCHAR)
        ELSE 'free text' END
      FROM ev WHERE event_type <> 'error'"""),
    ("runlog_n", "SELECT run_id, event_id, line, row_number() OVER (PARTITION BY run_id "
                 "ORDER BY event_id) AS line_no FROM runlog"),
]

BASE = NET_T


RAW = [
    ("raw_nodes", """SELECT node AS row_order, lon, lat,
        CASE WHEN node % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE population * 1000 END AS population,
        productivity * 1e9 AS gdp,
        CASE WHEN node % 7 = 0 THEN CAST(node * 10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
          AS outflows, product, name AS city_country FROM tnodes"""),
    ("raw_edges", f"""SELECT edge_id, "from", "to", {_km} * 1000 AS distance,
        CASE WHEN {S} % 53 = 0 THEN CAST(0 AS DOUBLE) ELSE {_km} * 1000 / 1000 / Ijk * 60 END
          AS duration, delta_i * 1e5 AS ug_cost_km FROM tedges"""),
    ("raw_geometry", f'SELECT "from", "to", geometry FROM tedges WHERE {S} % 17 <> 0'),
]

SCENARIOS = [
    ("scen", """SELECT CAST(r_regionkey AS BIGINT) + 1 AS scenario_id,
        (r_regionkey + 3) / 10 AS alpha, CAST(1 AS DOUBLE) AS beta, (r_regionkey + 8) / 10 AS gamma,
        CAST(r_regionkey % 3 AS DOUBLE) AS rho, CAST((r_regionkey + 1) * 1000 AS DOUBLE) AS K,
        CAST(r_regionkey + 3 AS DOUBLE) AS tol, CAST(r_regionkey + 2 AS DOUBLE) AS min_iter,
        (r_regionkey * 10 + 105) / 10 AS max_iter, CAST(r_regionkey + 3 AS DOUBLE) AS sigma,
        (r_regionkey + 7) / 10 AS a, (r_regionkey + 1) / 2 AS nu,
        r_regionkey = 3 AS labor_mobility, r_regionkey % 2 = 0 AS annealing, true AS duality,
        r_regionkey % 2 = 1 AS allow_downgrade, r_regionkey < 2 AS productivity_floor,
        CASE WHEN r_regionkey = 4 THEN 'road' END AS preset FROM region"""),
]
