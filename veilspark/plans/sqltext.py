"""SQL fragments for the checks: fixture tables and brute-force taxonomy tables."""

from __future__ import annotations

from veilspark.plans.fixtures import PRIORITY_LINES, SEGMENT_LINES, STATUS_LINES


def _values(lines: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(lines)) + ") v(line, ord)"


NATION = """SELECT n_name || ';' || r_name || ';*' AS line, n_nationkey::BIGINT AS ord
 FROM nation JOIN region ON n_regionkey = r_regionkey"""
SUPPLIER = """SELECT s_name || ';' || n_name || ';' || r_name || ';*' AS line, s_suppkey AS ord
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
RAGGED = """SELECT CASE WHEN n_nationkey % 5 = 4 THEN n_name || ';*' ELSE n_name || ';' || r_name || ';*' END AS line,
 n_nationkey::BIGINT AS ord FROM nation JOIN region ON n_regionkey = r_regionkey"""
SHARED = NATION + """ UNION ALL SELECT n_name || ';' || r_name || ';*', n_nationkey + 100
 FROM nation JOIN region ON (n_regionkey + 1) % 5 = r_regionkey WHERE n_nationkey % 3 = 0"""
MONTH = """SELECT strftime(d, '%Y-%m') || ';' || strftime(d, '%Y') || ';*' AS line,
 row_number() OVER (ORDER BY d) - 1 AS ord
 FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d)"""
SEGMENT, PRIORITY, STATUS = _values(SEGMENT_LINES), _values(PRIORITY_LINES), _values(STATUS_LINES)

CUSTOMER_QI = """c AS (SELECT c_custkey AS rid, c_mktsegment AS segment, n_name AS nation, c_acctbal AS acctbal
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
BLANK_QI = """c AS (SELECT c_custkey AS rid, c_mktsegment AS segment, CASE c_custkey % 4 WHEN 0 THEN NULL
 WHEN 1 THEN 'NOWHERE' ELSE n_name END AS nation, c_acctbal AS acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ORDERS_QI = """o AS (SELECT o_orderkey AS rid, o_orderstatus AS status, o_orderpriority AS priority,
 strftime(o_orderdate, '%Y-%m') AS order_month, o_totalprice AS totalprice FROM orders)"""
PART_QI = "p AS (SELECT p_partkey AS rid, p_size AS size, p_retailprice AS retailprice FROM part)"
MIXED_QI = """m AS (SELECT c_custkey AS rid, c_nationkey::BIGINT AS cluster_id,
 CASE WHEN c_custkey % 5 < CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE 1 END THEN '35.0_42.0'
 ELSE CAST(35 + (c_custkey * 37 % 71) / 10e0 AS DECIMAL(18,1))::VARCHAR END AS temperature FROM customer)"""


def tax(n: str, lines: str) -> str:
    """CTEs of one taxonomy: closure ``n_c``, nodes with ancestor lists ``n_n``, distances of all
    node pairs ``n_d``, domain ``n_dom``, domain marginality ``n_m`` and boundary ``n_b``."""
    return f"""
 {n}_l AS (SELECT string_split(line, ';') AS nodes, min(ord) AS ord FROM ({lines}) GROUP BY line),
 {n}_p AS (SELECT nodes, nodes[1] AS leaf, min(ord) OVER (PARTITION BY nodes[1]) AS leaf_ord,
   row_number() OVER (PARTITION BY nodes[1] ORDER BY ord) - 1 AS path_id, len(nodes) AS n FROM {n}_l),
 {n}_h AS (SELECT max(n) - 1 AS h FROM {n}_p),
 {n}_x AS (SELECT *, unnest(range(1, n + 1)) AS i FROM {n}_p),
 {n}_c AS (SELECT leaf, leaf_ord, path_id, nodes[i] AS node, n - i AS height, h - (n - i) AS level
   FROM {n}_x, {n}_h),
 {n}_w AS (SELECT node, count(DISTINCT leaf) AS n_leaves FROM {n}_c GROUP BY node),
 {n}_n AS (SELECT nodes[i] AS node, list_distinct(flatten(list(nodes[i:n]))) AS anc,
   arg_min(n - i + 1, leaf_ord * 100 + path_id) AS depth, min(leaf_ord) AS leaf_ord,
   arg_min(h - (n - i), leaf_ord * 100 + path_id) AS level, max((i = 1)::INT) AS is_leaf
   FROM {n}_x, {n}_h GROUP BY nodes[i]),
 {n}_d AS (SELECT a.node AS a, b.node AS b, log2(1 + (len(list_distinct(a.anc || b.anc))
   - len(list_intersect(a.anc, b.anc))) * 1e0 / len(list_distinct(a.anc || b.anc))) AS d
   FROM {n}_n a, {n}_n b),
 {n}_s AS (SELECT a.node AS a, b.node AS b, 1 - 2e0 * max(x.depth) / (a.depth + b.depth) AS d
   FROM {n}_n a, {n}_n b, {n}_n x WHERE list_contains(a.anc, x.node) AND list_contains(b.anc, x.node)
   GROUP BY a.node, b.node, a.depth, b.depth),
 {n}_dom AS (SELECT DISTINCT leaf, leaf_ord FROM {n}_c WHERE level = 0),
 {n}_m AS (SELECT x.leaf AS value, x.leaf_ord, sum(d) AS m FROM {n}_dom x, {n}_dom y, {n}_d
   WHERE a = x.leaf AND b = y.leaf GROUP BY x.leaf, x.leaf_ord),
 {n}_t AS (SELECT value AS top FROM {n}_m ORDER BY round(m, 9) DESC, leaf_ord LIMIT 1),
 {n}_b AS (SELECT leaf AS bottom, top, d AS distance FROM {n}_dom, {n}_t, {n}_d
   WHERE a = leaf AND b = top ORDER BY round(d, 9) DESC, leaf_ord LIMIT 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


NATION_T = tax("nt", NATION)
SEGMENT_T = tax("st", SEGMENT)
SHARED_T = tax("sh", SHARED)
RAGGED_T = tax("rg", RAGGED)
SUPPLIER_T = tax("su", SUPPLIER)
PRIORITY_T = tax("pr", PRIORITY)
STATUS_T = tax("ot", STATUS)
MONTH_T = tax("mo", MONTH)


def band_sql(v: str, lo: int, units: int, width: int, decimals: int) -> str:
    """Text of the band holding ``v``; ``lo``, ``units`` and ``width`` in grid steps."""
    scale = 10**decimals
    last = max(1, round(units / width)) - 1
    i = f"least(greatest(floor((round(({v}) * {scale}) - ({lo})) / {width}), 0), {last})::BIGINT"
    kind = "BIGINT" if decimals == 0 else f"DECIMAL(18,{decimals})"
    end = f"CASE WHEN {i} = {last} THEN {lo} + {units} ELSE {lo} + {i} * {width} + {width} - 1 END"
    return (f"CAST(({lo} + {i} * {width}) / {scale}e0 AS {kind})::VARCHAR || '_' || "
            f"CAST(({end}) / {scale}e0 AS {kind})::VARCHAR")


ACCTBAL_BAND = band_sql("acctbal", -100000, 1100000, 100000, 2)
PRICE_BAND1 = band_sql("totalprice", 0, 50000000, 5000000, 2)
PRICE_BAND2 = band_sql("totalprice", 0, 50000000, 25000000, 2)
SIZE_BAND = band_sql("size", 1, 49, 10, 0)
ACCTBAL_TEXT = "CAST(acctbal AS DECIMAL(18,2))::VARCHAR"


def u(seed: str, purpose: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}|{purpose}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


def laplace(uni: str, scale: str) -> str:
    return f"(-sign({uni} - 0.5e0) * ln(1 - 2 * abs({uni} - 0.5e0)) * ({scale}))"
