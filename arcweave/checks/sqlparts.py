"""SQL text pieces for the DuckDB oracle.

The oracle rebuilds the fixture networks (FIXTURES.md section 3) from the same
tables with plain SQL, independently of the Spark code, so a query and its
oracle only share the written definition, not an implementation.
"""

from __future__ import annotations


def lon(x: str) -> str:
    return f"((({x}) * 7919) % 36000 - 18000) / 100"


def lat(x: str) -> str:
    return f"((({x}) * 104729) % 18000 - 9000) / 100"


def lon_h(x: str) -> str:
    return f"((({x}) * 7919) % 36000 - 18000)"


def lat_h(x: str) -> str:
    return f"((({x}) * 104729) % 18000 - 9000)"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = (f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))")
    return f"(12742.0 * asin(sqrt(least({h}, 1.0))))"


def iceberg(km: str, floor: float) -> str:
    return (f"(CASE WHEN ({km}) > 0 THEN greatest(0.1158826 * ln(({km}) / 1.609), "
            f"CAST({floor} AS DOUBLE)) WHEN ({km}) = 0 THEN CAST({floor} AS DOUBLE) END)")


def fp(x: str, scale: int) -> str:
    unit = 10 ** scale
    return (f"((CASE WHEN ({x}) < 0 THEN '-' ELSE '' END) || CAST(abs({x}) // {unit} AS VARCHAR)"
            f" || '.' || lpad(CAST(abs({x}) % {unit} AS VARCHAR), {scale}, '0'))")


def finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def utility(c: str, h: str, alpha: str, rho: str) -> str:
    v = f"(pow(pow({c}, {alpha}) * pow({h}, 1 - {alpha}), 1 - {rho}) / (1 - {rho}))"
    return finite(f"(CASE WHEN {rho} <> 1 THEN {v} END)")


def round_sig(x: str, k: int) -> str:
    """Half-to-even significant-digit rounding as the engine's C9."""
    e = f"floor(log10(abs({x})))"
    s = f"({k - 1} - {e})"
    up = f"(round_even(({x}) * pow(10.0, {s}), 0) / pow(10.0, {s}))"
    down = f"(round_even(({x}) / pow(10.0, -{s}), 0) * pow(10.0, -{s}))"
    return (f"(CASE WHEN NOT isfinite({x}) THEN NULL WHEN ({x}) = 0 THEN 0.0 "
            f"WHEN {s} >= 0 THEN {up} ELSE {down} END)")


def stable(x: str, k: int = 9) -> str:
    """Comparison rounding (half away from zero, k significant digits)."""
    e = f"floor(log10(abs({x})))"
    s = f"({k - 1} - {e})"
    up = f"(round(({x}) * pow(10.0, {s})) / pow(10.0, {s}))"
    down = f"(round(({x}) / pow(10.0, -{s})) * pow(10.0, -{s}))"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN NULL WHEN ({x}) = 0 THEN 0.0 "
            f"WHEN {s} >= 0 THEN {up} ELSE {down} END)")


def geometry_text(f: str, t: str) -> str:
    lf, af = f"({lon_h(f)} * 10)", f"({lat_h(f)} * 10)"
    lt, at = f"({lon_h(t)} * 10)", f"({lat_h(t)} * 10)"
    ml, ma = f"(({lf} + {lt}) // 2)", f"(({af} + {at}) // 2)"

    def pair(x, y):
        return f"({fp(x, 3)} || ' ' || {fp(y, 3)})"
    line = (f"('LINESTRING (' || {pair(lf, af)} || ', ' || {pair(ml, ma)} || ', ' || "
            f"{pair(lt, at)} || ')')")
    point = f"('POINT (' || {pair(lf, af)} || ')')"
    return (f"(CASE WHEN (({f}) + ({t})) % 13 = 0 THEN NULL "
            f"WHEN (({f}) + ({t})) % 11 = 0 THEN {point} ELSE {line} END)")


def _edges_select(src: str) -> str:
    f, t = "f", "t"
    km = hav(lon(f), lat(f), lon(t), lat(t))
    ijk = "CAST(20 + CAST(floor(qty) AS BIGINT) % 61 AS DOUBLE)"
    return f"""SELECT row_number() OVER (ORDER BY f, t) AS edge_id, f AS "from", t AS "to",
      1 + ((f * 31 + t) % 97) / 10 AS delta_i,
      {iceberg(km, 0.005)} AS delta_tau,
      {ijk} AS Ijk,
      CASE WHEN (f + t) % 5 <> 0 THEN {ijk} END AS Il,
      CASE WHEN (f + t) % 7 <> 0 THEN CAST(100 AS DOUBLE) END AS Iu,
      {geometry_text(f, t)} AS geometry
    FROM {src}"""


# NET-T and its allocations, as CTE bodies (name, body) in dependency order.
NET_T = [
    ("nsup", "SELECT count(*) AS n_sup FROM supplier"),
    ("shipped", "SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY l_suppkey"),
    ("placed", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey"),
    ("tnodes_raw", """
      SELECT s_suppkey + 1 AS node, coalesce(sh.n, 0) AS n, s_acctbal AS acctbal,
             s_nationkey AS nationkey, s_name AS name
      FROM supplier LEFT JOIN shipped sh ON s_suppkey = sh.key
      UNION ALL
      SELECT nsup.n_sup + c_custkey + 1, coalesce(pl.n, 0), c_acctbal, c_nationkey, c_name
      FROM customer CROSS JOIN nsup LEFT JOIN placed pl ON c_custkey = pl.key"""),
    ("tnodes", f"""
      SELECT CAST(r.node AS BIGINT) AS node, {lon('r.node')} AS lon, {lat('r.node')} AS lat,
             CAST(greatest(1, r.n) AS DOUBLE) AS population,
             abs(r.acctbal) / 1000 AS productivity,
             CAST(n_regionkey + 1 AS INTEGER) AS product, r.name AS name,
             CAST(r.nationkey AS INTEGER) AS nationkey
      FROM tnodes_raw r LEFT JOIN nation ON r.nationkey = n_nationkey"""),
    ("tlines", """
      SELECT CAST(l_suppkey + 1 AS BIGINT) AS supp_node,
             CAST(nsup.n_sup + o_custkey + 1 AS BIGINT) AS cust_node,
             l_partkey, l_quantity, l_returnflag, l_shipdate
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN nsup"""),
    ("tpairs", "SELECT supp_node AS f, cust_node AS t, sum(l_quantity) AS qty "
               "FROM tlines GROUP BY supp_node, cust_node"),
    ("tedges", _edges_select("tpairs")),
    ("tflow", """
      SELECT run_id, src, dst, good, sum(l_quantity) AS q FROM (
        SELECT 'result' AS run_id,
               CASE WHEN l_returnflag = 'R' THEN cust_node ELSE supp_node END AS src,
               CASE WHEN l_returnflag = 'R' THEN supp_node ELSE cust_node END AS dst,
               CAST(l_partkey % 5 + 1 AS INTEGER) AS good, l_quantity FROM tlines
        UNION ALL
        SELECT 'baseline',
               CASE WHEN l_returnflag = 'R' THEN cust_node ELSE supp_node END,
               CASE WHEN l_returnflag = 'R' THEN supp_node ELSE cust_node END,
               CAST(l_partkey % 5 + 1 AS INTEGER), l_quantity FROM tlines
        WHERE l_shipdate < TIMESTAMP '1999-01-01') x
      GROUP BY run_id, src, dst, good"""),
    ("tinfra", """
      SELECT 'baseline' AS run_id, "from" AS src, "to" AS dst, Ijk AS ijk FROM tedges
      UNION ALL SELECT 'baseline', "to", "from", Ijk FROM tedges
      UNION ALL SELECT 'result', "from", "to", Ijk * (1 + ("from" % 4) / 10) FROM tedges
      UNION ALL SELECT 'result', "to", "from", Ijk * (1 + ("to" % 4) / 10) FROM tedges"""),
    ("toutput", "SELECT run_id, src AS node, good, sum(q) AS y FROM tflow GROUP BY run_id, src, good"),
    ("tpergood", "SELECT run_id, dst AS node, good, sum(q) AS c FROM tflow GROUP BY run_id, dst, good"),
    ("tces", "SELECT run_id, node, pow(sum(pow(c, 0.8)), 1.25) AS c_agg FROM tpergood "
             "GROUP BY run_id, node"),
    ("truns", "SELECT 'baseline' AS run_id UNION ALL SELECT 'result'"),
    ("talloc", f"""
      SELECT r.run_id, n.node,
             {utility('(c.c_agg / n.population)', '0.5', '0.5', '2.0')} AS uj,
             c.c_agg / n.population AS c_pc, c.c_agg AS c_agg,
             1 + (n.node % 50) / 100 AS PCj, n.population AS Lj
      FROM tnodes n CROSS JOIN truns r
      LEFT JOIN tces c ON c.run_id = r.run_id AND c.node = n.node"""),
]


def with_ctes(parts: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in parts)
    kw = "WITH RECURSIVE" if any("(" in name for name, _ in parts) else "WITH"
    return f"{kw} {body}\n{final}"


def perc_upgraded(new: str, old: str, iu: str, cap: str) -> str:
    gap = f"(coalesce({iu}, {cap}) - ({old}))"
    return (f"(CASE WHEN {gap} <= 1e-12 THEN (CASE WHEN ({new}) - ({old}) > 1e-9 "
            f"THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) "
            f"ELSE least(greatest((({new}) - ({old})) / {gap} * 100, CAST(0 AS DOUBLE)), "
            f"CAST(100 AS DOUBLE)) END)")


def pct_gain(new: str, old: str) -> str:
    return f"(CASE WHEN abs({old}) > 1e-12 THEN (({new}) - ({old})) / abs({old}) * 100 END)"


W = "(CASE WHEN src = dst THEN 1.0 ELSE 0.5 END)"


def sym_infra(run: str) -> str:
    return (f"SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, sum(ijk * {W}) AS ijk "
            f"FROM tinfra WHERE run_id = '{run}' GROUP BY least(src, dst), greatest(src, dst)")


def sym_flows(run: str, n_goods: int = 5, src: str = "tflow") -> str:
    goods = ", ".join(f"sum(CASE WHEN good = {g} THEN q * {W} ELSE 0 END) AS Qjk_{g}"
                      for g in range(1, n_goods + 1))
    return (f"SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, {goods}, "
            f"sum(q * {W}) AS Qjk_total FROM {src} WHERE run_id = '{run}' "
            f"GROUP BY least(src, dst), greatest(src, dst)")


def edge_table(run: str = "result", edges: str = "tedges", n_goods: int = 5,
               flows: str = "tflow", keep: str = "", prefix: str = "f1") -> tuple[list, str]:
    """F1 as SQL: extra CTEs and the final SELECT over an edge CTE and the allocations."""
    qs = ", ".join(f"coalesce(f.Qjk_{g}, 0.0) AS Qjk_{g}" for g in range(1, n_goods + 1))
    j = f"{prefix}_j"
    ctes = [(j, f"""
      SELECT e.*, e.Ijk AS Ijk_orig, coalesce(i.ijk, 0.0) AS Ijk_new,
             greatest(coalesce(i.ijk, 0.0) - e.Ijk, 0.0) AS increase,
             least(e."from", e."to") AS lo, greatest(e."from", e."to") AS hi
      FROM {edges} e LEFT JOIN ({sym_infra(run)}) i
        ON i.lo = least(e."from", e."to") AND i.hi = greatest(e."from", e."to")"""),
            (f"{prefix}_cap", cap_of(j, new="Ijk_new")),
            (f"{prefix}_flows", sym_flows(run, n_goods, flows))]
    final = f"""
    SELECT {keep} j."from", j."to", j.delta_i, j.delta_tau, j.Ijk_orig, j.Ijk_new AS Ijk,
           j.increase, {perc_upgraded('j.Ijk_new', 'j.Ijk_orig', 'j.Iu', 'c.cap')} AS perc_upgraded,
           {qs}, coalesce(f.Qjk_total, 0.0) AS Qjk_total
    FROM {j} j CROSS JOIN {prefix}_cap c
    LEFT JOIN {prefix}_flows f ON f.lo = j.lo AND f.hi = j.hi"""
    return ctes, final


def cap_of(table: str, iu: str = "Iu", new: str = "Ijk", old: str = "Ijk_orig") -> str:
    return (f"SELECT coalesce(max(CASE WHEN isfinite({iu}) THEN {iu} END), "
            f"greatest(max({new}), max({old}))) AS cap FROM {table}")


LINE_PAT = r"^\s*LINESTRING\s*\(([^)]*)\)\s*$"


def parse_line(g: str) -> str:
    """C1 in DuckDB: list of {lon, lat} structs, or NULL."""
    toks = (f"list_transform(string_split(regexp_extract({g}, '{LINE_PAT}', 1, 'i'), ','), "
            f"lambda p: regexp_split_to_array(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '\\s+'))")
    pts = (f"list_transform({toks}, lambda tk: CASE WHEN TRY_CAST(tk[1] AS DOUBLE) IS NOT NULL "
           f"AND TRY_CAST(tk[2] AS DOUBLE) IS NOT NULL THEN {{'lon': TRY_CAST(tk[1] AS DOUBLE), "
           f"'lat': TRY_CAST(tk[2] AS DOUBLE)}} END)")
    return (f"(CASE WHEN regexp_matches({g}, '{LINE_PAT}', 'i') AND len({pts}) >= 2 "
            f"AND list_count({pts}) = len({pts}) THEN {pts} END)")


def plain(x: str) -> str:
    return (f"regexp_replace(regexp_replace(CAST(CAST(CAST({x} AS DOUBLE) AS DECIMAL(24,10)) "
            f"AS VARCHAR), '0+$', ''), '\\.$', '.0')")
