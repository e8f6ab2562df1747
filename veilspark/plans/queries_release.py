"""Queries over classes, microaggregation, noise and lattice search."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import classes, lattice, microaggregation as ma, release, semantic_noise as sn
from veilspark.operators.marginality import marginality_sample
from veilspark.operators.safepub import Release, safepub
from veilspark.plans import fixtures as fx
from veilspark.plans import sqltext as q
from veilspark.plans.catalog import query
from veilspark.plans.queries_tables import SAMPLE_MARG, SIM_MEAN, r6
from veilspark.sources import tables

SEED = "fixed-for-tests"


# ---- microaggregation

POINT_SQL = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + """SELECT rid, round(dist, 6) AS distance FROM (
 SELECT rid, round(sqrt(power(nt_d.d / nt_b.distance, 2) + power(st_d.d / st_b.distance, 2) + power((acctbal - 500) / 11000, 2)), 12) AS dist
 FROM c JOIN nt_d ON nt_d.a = nation AND nt_d.b = 'NATION_7' JOIN st_d ON st_d.a = segment AND st_d.b = 'MACHINERY', nt_b, st_b)
 ORDER BY dist, rid LIMIT 50"""


@query("e2_nearest_k", POINT_SQL)
def e2(spark, sf):
    point = {"segment": "MACHINERY", "nation": "NATION_7", "acctbal": 500.0}
    return r6(ma.nearest_k(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), point, 50), "distance")


def _ordered_ctes(k: int) -> str:
    """Clusters of the one-sort strategy around the first corner (the bottom of every attribute)."""
    return f"""ord AS (SELECT c.*, row_number() OVER (ORDER BY round(sqrt(power(st_d.d / st_b.distance, 2)
   + power(nt_d.d / nt_b.distance, 2) + power((acctbal + 1000) / 11000, 2)), 12), rid) - 1 AS pos, count(*) OVER () AS total
   FROM c, nt_b, st_b, nt_d, st_d WHERE nt_d.a = nation AND nt_d.b = nt_b.bottom AND st_d.a = segment AND st_d.b = st_b.bottom),
 cl AS (SELECT *, least(pos // {k}, total // {k} - 1)::BIGINT AS cluster_id FROM ord)"""


CLUSTERS = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, _ordered_ctes(25))
K = 25


def _clusters(spark, sf):
    return ma.microaggregate(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), K, "ordered")


@query("e3_microaggregate_ordered", CLUSTERS + "SELECT rid, cluster_id FROM cl")
def e3_ordered(spark, sf):
    return _clusters(spark, sf)


@query("e3_microaggregate_batched", f"""SELECT least(r // {K}, n // {K} - 1) AS cluster_id, count(*) AS size FROM
 (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) GROUP BY 1""")
def e3_batched(spark, sf):
    # which rows share a cluster is not expressible in SQL; sizes are, and tests compare with a sequential scan
    return ma.microaggregate(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), K, "batched").groupBy(
        "cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query("a6_cluster_store", CLUSTERS + "SELECT rid, cluster_id FROM cl")
def a6(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    ma.cached_clusters(df, qis, K, "ordered")
    return tables.load_clusters(spark, f"{tables.fingerprint(df, qis, K)}-ordered")


def _members(spark, sf):
    return fx.customer_qi(spark, sf).join(_clusters(spark, sf), "rid")


@query("e4_numeric_centroid", CLUSTERS + "SELECT cluster_id, round(avg(acctbal), 6) AS centroid FROM cl GROUP BY 1")
def e4(spark, sf):
    return r6(release.numeric_centroid(_members(spark, sf), "acctbal"), "centroid")


@query("e5_mixed_centroid", q.with_(q.MIXED_QI) + """SELECT cluster_id, CASE WHEN count(*) FILTER (temperature LIKE '%\\_%' ESCAPE '\\') > count(*) / 2e0
 THEN '35.0_42.0' ELSE CAST(round_even(avg(TRY_CAST(temperature AS DOUBLE)) FILTER (temperature NOT LIKE '%\\_%' ESCAPE '\\'), 1) AS DECIMAL(18,1))::VARCHAR END AS centroid
 FROM m GROUP BY cluster_id""")
def e5(spark, sf):
    return release.mixed_centroid(fx.mixed_qi(spark, sf), "temperature")


NATION_MARG = """, k AS (SELECT cluster_id, nation, count(*) AS n FROM cl GROUP BY ALL),
 mg AS (SELECT cluster_id, leaf AS value, leaf_ord, sum(n * d) AS m FROM nt_dom JOIN nt_d ON a = leaf JOIN k ON b = nation GROUP BY ALL)"""


@query("e6_categorical_centroid", CLUSTERS + NATION_MARG + """
 SELECT cluster_id, arg_min(value, round(m, 9) * 1000 + leaf_ord / 1000e0) AS centroid FROM mg
 WHERE (cluster_id, value) IN (SELECT cluster_id, nation FROM k) GROUP BY 1""")
def e6(spark, sf):
    return release.categorical_centroid(_members(spark, sf), fx.customer_qis(spark, sf)[1])


def _gumbel(eps, it, attr, cluster, value):
    return f"(-ln(-ln({q.u(SEED, 'centroid', repr(attr), repr(str(eps)), repr(str(it)), cluster, value)})))"


def _dp_centroid(n: str, attr: str, eps: float, it: int = 1, name: str | None = None, k: int = K) -> str:
    """CTEs of the exponential-mechanism centroid of one attribute per cluster."""
    name = name or f"dp_{attr}"
    return f"""{name} AS (SELECT cluster_id, arg_max(value, -{eps}e0 * m / (2 * (total / {k}e0) * distance)
   + {_gumbel(eps, it, attr, 'cluster_id', 'value')}) AS {attr}
 FROM (SELECT cluster_id, leaf AS value, sum(n * d) AS m FROM {n}_dom JOIN {n}_d ON a = leaf
   JOIN (SELECT cluster_id, {attr}, count(*) AS n FROM cl GROUP BY ALL) ON b = {attr} GROUP BY ALL),
   {n}_b, (SELECT count(*) AS total FROM c) GROUP BY cluster_id)"""


@query("e7_dp_categorical_centroid", CLUSTERS + ", " + _dp_centroid("nt", "nation", 1.0)
       + " SELECT cluster_id, nation AS centroid FROM dp_nation")
def e7(spark, sf):
    n = fx.customer_qi(spark, sf).count()
    return release.dp_categorical_centroid(_members(spark, sf), fx.customer_qis(spark, sf)[1], 1.0, n, K, SEED)


@query("e8_apply_centroids", CLUSTERS + NATION_MARG + """,
 cen AS (SELECT cluster_id, arg_min(value, round(m, 9) * 1000 + leaf_ord / 1000e0) AS nation FROM mg
  WHERE (cluster_id, value) IN (SELECT cluster_id, nation FROM k) GROUP BY 1),
 cs AS (SELECT x.cluster_id, x.segment, any_value(leaf_ord) AS leaf_ord, sum(y.n * d) AS m FROM
  (SELECT cluster_id, segment, count(*) n FROM cl GROUP BY ALL) x JOIN (SELECT cluster_id, segment, count(*) n FROM cl GROUP BY ALL) y USING (cluster_id)
  JOIN st_d ON a = x.segment AND b = y.segment JOIN st_n ON node = x.segment GROUP BY ALL),
 sen AS (SELECT cluster_id, arg_min(segment, round(m, 9) * 1000 + leaf_ord / 1000e0) AS segment FROM cs GROUP BY 1),
 num AS (SELECT cluster_id, avg(acctbal) AS acctbal FROM cl GROUP BY 1)
 SELECT rid, sen.segment, cen.nation, round(num.acctbal, 6) AS acctbal FROM cl JOIN cen USING (cluster_id)
 JOIN sen USING (cluster_id) JOIN num USING (cluster_id)""")
def e8(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    clusters = _clusters(spark, sf)
    return r6(release.apply_centroids(clusters, release.centroid_table(df, clusters, qis)), "acctbal")


def _noisy(value, attr, eps, it, lo, hi, decimals, integer=False, parts=True, k=K):
    span = hi - lo
    extra = [repr(str(eps)), repr(str(it))] if parts else []
    noise = q.laplace(q.u(SEED, "laplace", repr(attr), *extra, "rid"), f"{span}e0 / {eps}e0 / {k}e0")
    total = f"round_even({noise}, 0) + round_even({value}, 0)" if integer else f"round_even({value} + {noise}, {decimals})"
    kind = "BIGINT" if decimals == 0 else f"DECIMAL(18,{decimals})"
    return f"CAST(least(greatest({total}, {lo}), {hi}) AS {kind})::VARCHAR"


@query("e9_sanitise", q.with_(q.PART_QI) + f"""SELECT rid, {_noisy('size', 'size', 0.5, 0, 1, 50, 0, True, False)} AS size,
 {_noisy('retailprice', 'retailprice', 0.5, 0, 900, 1000, 1, False, False)} AS retailprice FROM p""")
def e9(spark, sf):
    return release.sanitise(fx.part_qi(spark, sf), fx.part_qis(spark, sf), 0.5, K, SEED)


@query("e9_sanitise_mixed", q.with_(q.MIXED_QI) + f"""SELECT rid, CASE WHEN temperature = '35.0_42.0' THEN temperature
 ELSE {_noisy('TRY_CAST(temperature AS DOUBLE)', 'temperature', 0.5, 0, 35, 42, 1, False, False)} END AS temperature FROM m""")
def e9_mixed(spark, sf):
    return release.sanitise(fx.mixed_qi(spark, sf), [fx.TEMPERATURE], 0.5, K, SEED).drop("cluster_id")


def _microdp_sql(grid):
    ctes, parts = [], []
    for e, i in grid:
        tag = f"{str(e).replace('.', '_')}_{i}"
        ctes += [_dp_centroid("nt", "nation", e, i, f"n{tag}"), _dp_centroid("st", "segment", e, i, f"s{tag}")]
        parts.append(f"""SELECT {e}e0 AS eps, {i} AS iteration, 3 * {e}e0 AS total_eps, rid, s{tag}.segment, n{tag}.nation,
 {_noisy('num.acctbal', 'acctbal', e, i, -1000, 10000, 2)} AS acctbal
 FROM cl JOIN n{tag} USING (cluster_id) JOIN s{tag} USING (cluster_id) JOIN num USING (cluster_id)""")
    head = CLUSTERS + ", " + ",\n".join(ctes) + ", num AS (SELECT cluster_id, avg(acctbal) AS acctbal FROM cl GROUP BY 1)\n"
    return head + "\nUNION ALL\n".join(parts)


@query("e10_microdp", _microdp_sql([(1.0, 1)]).replace("1.0e0 AS eps, 1 AS iteration, 3 * 1.0e0 AS total_eps, ", ""))
def e10(spark, sf):
    return release.microdp(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), 1.0, K, SEED, "ordered")


@query("e10_microdp_sweep", _microdp_sql([(0.5, 1), (0.5, 2), (2.0, 1), (2.0, 2)]))
def e10_sweep(spark, sf):
    return release.microdp_sweep(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), [0.5, 2.0], K, SEED, 2, "ordered")


# ---- semantic noise


F1_SQL = SAMPLE_MARG + f""",
 gap AS (SELECT abs(x.m - y.m) AS gap FROM b1, b2, lm x, lm y WHERE x.value = bound1 AND y.value = bound2),
 t AS (SELECT rid, nation, m + {q.laplace(q.u(SEED, 'marginality', "'nation'", 'rid'), 'gap * 0.5e0')} AS target
  FROM c JOIN lm ON value = nation, gap),
 f AS (SELECT rid, arg_min(value, round(abs(round(m, 9) - target), 9) * 1e6 + leaf_ord / 1000e0) AS noisy FROM t, lm GROUP BY rid)
 SELECT c.rid, c.nation, coalesce(noisy, '*') AS noisy FROM c LEFT JOIN f USING (rid)"""


@query("f1_marginality_noise", q.with_(q.NATION_T, q.CUSTOMER_QI) + F1_SQL)
def f1(spark, sf):
    return sn.marginality_noise(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), 0.5, SEED).select(
        "rid", "nation", "noisy")


@query("f1_marginality_noise_blanks", q.with_(q.NATION_T, q.BLANK_QI) + F1_SQL)
def f1_blanks(spark, sf):
    return sn.marginality_noise(fx.blank_customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), 0.5, SEED).select(
        "rid", "nation", "noisy")


@query("f2_nearest_by_marginality", q.with_(q.NATION_T, q.CUSTOMER_QI) + SAMPLE_MARG + """
 SELECT rid, arg_min(value, round(abs(round(m, 9) - (800 + acctbal / 100)), 9) * 1e6 + leaf_ord / 1000e0) AS nearest
 FROM c, lm GROUP BY rid""")
def f2(spark, sf):
    df, tax = fx.customer_qi(spark, sf), fx.taxonomy(spark, sf, "nation")
    margins = marginality_sample(df, "nation", tax, targets="leaves")
    targets = df.select("rid", (800 + F.col("acctbal") / 100).alias("target"))
    return sn.nearest_by_marginality(targets, "target", margins, rows=tax.facts["rows"]).select("rid", "nearest")


F3_SQL = q.with_(q.NATION_T, q.CUSTOMER_QI) + SIM_MEAN.replace("{where}", "true") + f""",
 e AS (SELECT rid, nation, {q.laplace(q.u(SEED, 'semantic', "'nation'", 'rid'), 'variance * 1e0')} AS e,
  {q.u(SEED, 'semantic tie', "'nation'", 'rid')} AS tie FROM c, var),
 lv AS (SELECT n.node AS leaf, n.leaf_ord, round(s.d, 12) AS dm FROM nt_n n, mean, nt_s s WHERE is_leaf = 1 AND s.a = n.node AND s.b = mean),
 x AS (SELECT e.rid, e.nation, e.e, e.tie, leaf, dm, leaf_ord, round(s.d, 12) AS d, round(o.d, 12) AS mean_d, mean
  FROM e, mean JOIN nt_s o ON o.b = mean JOIN lv ON true JOIN nt_s s ON s.b = leaf WHERE o.a = nation AND s.a = nation),
 g AS (SELECT *, d >= abs(e) AS near, d >= abs(e) AND dm > mean_d AS far_side, d >= abs(e) AND dm < mean_d AS near_side FROM x),
 a AS (SELECT rid, nation, e, tie, any_value(mean) AS mean, count(*) FILTER (near) AS n_near,
  count(*) FILTER (far_side) AS n_far, count(*) FILTER (near_side) AS n_close, max(d) AS max_all,
  min(d) FILTER (near) AS min_near, max(d) FILTER (near) AS max_near, min(d) FILTER (far_side) AS min_far,
  min(d) FILTER (near_side) AS min_close FROM g GROUP BY ALL),
 pick AS (SELECT g.rid, g.nation, a.tie, leaf, dm, leaf_ord, d FROM g JOIN a USING (rid) WHERE CASE
  WHEN n_near = 0 THEN d = max_all
  WHEN {{small}} < 0.01 THEN false
  WHEN g.nation = a.mean THEN near AND d = min_near
  WHEN g.e > 0 AND n_far > 0 THEN far_side AND d = min_far
  WHEN g.e > 0 THEN near AND d = max_near
  WHEN n_close > 0 THEN near_side AND d = min_close
  ELSE near AND d = min_near END),
 p AS (SELECT rid, list(leaf ORDER BY d, dm, leaf_ord) AS l, any_value(tie) AS tie FROM pick GROUP BY rid)
 SELECT c.rid, c.nation, coalesce(l[(floor(tie * len(l)) + 1)::INT], c.nation) AS noisy FROM c LEFT JOIN p USING (rid)"""


@query("f3_semantic_noise", F3_SQL.replace("{small}", "abs(g.e)"))
def f3(spark, sf):
    return sn.semantic_noise(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), 1.0, SEED).select(
        "rid", "nation", "noisy")


@query("f3_semantic_noise_signed", F3_SQL.replace("{small}", "g.e"))
def f3_signed(spark, sf):
    return sn.semantic_noise(
        fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), 1.0, SEED, "signed").select("rid", "nation", "noisy")


# ---- k-anonymity and lattice


@query("g1_dp_sample", q.with_(q.CUSTOMER_QI) + f"""SELECT rid, CASE WHEN keep THEN segment ELSE '*' END AS segment,
 CASE WHEN keep THEN nation ELSE '*' END AS nation, CASE WHEN keep THEN {q.ACCTBAL_TEXT} ELSE '*' END AS acctbal
 FROM (SELECT *, {q.u(SEED, 'sample', 'rid')} < 0.6 AS keep FROM c)""")
def g1(spark, sf):
    qis = fx.customer_qis(spark, sf)
    return classes.dp_sample(classes.release_cells(fx.customer_qi(spark, sf), qis, ["rid"]), qis, 0.6, SEED)


G2 = f""", g AS (SELECT rid, s.node AS segment, n.node AS nation, {q.ACCTBAL_BAND} AS acctbal FROM c
 JOIN st_c s ON s.leaf = segment AND s.level = 1 JOIN nt_c n ON n.leaf = nation AND n.level = 1)"""
G_CTES = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + G2


def _generalised(spark, sf):
    return classes.generalise_all(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), [1, 1, 1])


@query("g2_generalise_all", G_CTES + " SELECT * FROM g")
def g2(spark, sf):
    return _generalised(spark, sf)


@query("g2_generalise_orders", q.with_(q.STATUS_T, q.PRIORITY_T, q.MONTH_T, q.ORDERS_QI) + f"""SELECT rid, s.node AS status, p.node AS priority,
 m.node AS order_month, {q.PRICE_BAND2} AS totalprice FROM o JOIN ot_c s ON s.leaf = status AND s.level = 1
 JOIN pr_c p ON p.leaf = priority AND p.level = 1 JOIN mo_c m ON m.leaf = order_month AND m.level = 1""")
def g2_orders(spark, sf):
    return classes.generalise_all(fx.orders_qi(spark, sf), fx.orders_qis(spark, sf), [1, 1, 1, 2])


@query("g3_equivalence_classes", G_CTES + " SELECT segment, nation, acctbal, count(*) AS class_size FROM g GROUP BY ALL")
def g3(spark, sf):
    return classes.equivalence_classes(_generalised(spark, sf), fx.customer_qis(spark, sf))


def _anonymous(k):
    return G_CTES + f""", a AS (SELECT rid, CASE WHEN n < {k} THEN '*' ELSE segment END AS segment,
 CASE WHEN n < {k} THEN '*' ELSE nation END AS nation, CASE WHEN n < {k} THEN '*' ELSE acctbal END AS acctbal
 FROM (SELECT *, count(*) OVER (PARTITION BY segment, nation, acctbal) AS n FROM g))"""


KANON = 12  # keeps some classes and suppresses others on the sample tables


@query("g4_k_anonymise", _anonymous(KANON) + " SELECT * FROM a")
def g4(spark, sf):
    return classes.k_anonymise(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), [1, 1, 1], KANON)


def _lattice_ctes() -> str:
    """Every node of the customer lattice, by brute force over rows."""
    return q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + f""",
 lr AS (SELECT c.rid, ls, ln, la, (ls * 3 + ln) * 3 + la AS node, s.node AS segment, n.node AS nation,
   CASE la WHEN 0 THEN {q.ACCTBAL_TEXT} WHEN 1 THEN {q.ACCTBAL_BAND} ELSE '*' END AS acctbal,
   sw.n_leaves / 5e0 + nw.n_leaves / 25e0 + CASE la WHEN 0 THEN 1 / 1100001e0
     WHEN 1 THEN CASE WHEN acctbal >= 9000 THEN 100001 ELSE 100000 END / 1100001e0 ELSE 1 END AS share
   FROM c, range(0, 3) a(ls), range(0, 3) b(ln), range(0, 3) d(la), st_c s, nt_c n, st_w sw, nt_w nw
   WHERE s.leaf = segment AND s.level = ls AND n.leaf = nation AND n.level = ln AND sw.node = s.node AND nw.node = n.node),
 lk AS (SELECT *, count(*) OVER (PARTITION BY node, segment, nation, acctbal) AS cnt FROM lr),
 lv AS (SELECT node, v, count(*) AS n FROM (SELECT node, unnest(['s' || segment, 'n' || nation, 'a' || acctbal]) AS v FROM lk WHERE cnt >= 5)
   GROUP BY ALL),
 le AS (SELECT node, sum(CASE WHEN v[2:] = '*' THEN n * (SELECT count(*) FROM c) ELSE n * n END)::DOUBLE AS e FROM lv GROUP BY node),
 sc AS (SELECT node, ls, ln, la, count(*) AS rows, count(*) FILTER (cnt < 5) AS gone, coalesce(sum(share) FILTER (cnt >= 5), 0) AS loss,
   coalesce(sum(cnt) FILTER (cnt >= 5), 0)::DOUBLE AS squares,
   count(DISTINCT segment || '|' || nation || '|' || acctbal) FILTER (cnt >= 5) AS kept FROM lk GROUP BY ALL),
 sl AS (SELECT node, (loss + gone * 3) / (3 * 4) AS granularity,
   ((ls + ln + la) / 2e0 * (rows - gone) + gone * 3) / (3 * 4) AS intensity,
   (squares + gone * rows) / (7.25e0 * rows) AS discernibility,
   (coalesce(e, 0) + gone * rows * 3e0) / (7.25e0 * 3 * rows) AS entropy,
   rows / (kept + (gone > 0)::INT)::DOUBLE AS groupsize, gone / rows::DOUBLE AS suppressed_share
   FROM sc LEFT JOIN le USING (node))"""


SCORE_COLS = ["granularity", "intensity", "discernibility", "entropy", "groupsize", "suppressed_share"]
LATTICE = _lattice_ctes()


@query("g5_suppression_limit", LATTICE + " SELECT node, round(suppressed_share, 6) AS suppressed_share FROM sl WHERE suppressed_share <= 0")
def g5(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    scores = lattice.score_lattice(lattice.frequency_set(df, qis), qis, 5, ["granularity"])
    return r6(lattice.within_limit(scores, 0.0).select("node", "suppressed_share"), "suppressed_share")


@query("g6_score_lattice", LATTICE + " SELECT node, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM sl")
def g6(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    return r6(lattice.score_lattice(lattice.frequency_set(df, qis), qis, 5).drop("levels"), *SCORE_COLS)


@query("g6_score_lattice_rolled", LATTICE + " SELECT node, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM sl")
def g6_rolled(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    return r6(lattice.score_lattice(lattice.frequency_set(df, qis), qis, 5, rollup_rows=0).drop("levels"), *SCORE_COLS)


def _best_release(limit):
    return LATTICE + f""", best AS (SELECT node AS best FROM sl WHERE suppressed_share <= {limit} ORDER BY round(granularity, 9), node LIMIT 1)
 SELECT rid, CASE WHEN cnt < 5 THEN '*' ELSE segment END AS segment, CASE WHEN cnt < 5 THEN '*' ELSE nation END AS nation,
 CASE WHEN cnt < 5 THEN '*' ELSE acctbal END AS acctbal FROM lk, best WHERE node = best"""


@query("g7_optimal_k_anonymity", _best_release(1.0))
def g7(spark, sf):
    return lattice.optimal_k_anonymity(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), 5)[1]


@query("g7_optimal_k_anonymity_no_suppression", _best_release(0.0))
def g7_none(spark, sf):
    return lattice.optimal_k_anonymity(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), 5, 0.0)[1]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def private_ctes(searches: list[tuple], n: str = "") -> str:
    """Private searches over the customer lattice, replayed node by node. A search is (name, param,
    iteration, optimised metric, k, share sampled, eps of the search, steps, seed); CTEs ``fin{n}`` with
    the node drawn by each, and ``out{n}`` with the released rows."""
    rows = ", ".join(
        f"('{name}', {float(param)!r}::DOUBLE, {i}, '{metric}', {k}, {beta!r}::DOUBLE, {eps!r}::DOUBLE / {min(steps, 26) + 1} / 2, {min(steps, 26)}, '{seed}')"
        for name, param, i, metric, k, beta, eps, steps, seed in searches)
    noise = lambda step: f"ln(-ln((('0x' || substr(md5(seed || '|search|' || {step} || '|' || x), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0))"
    pick = lambda nodes, step: (f"-(list_max(list_transform({nodes}, lambda x: "
                                f"{{'w': -mp[x] * unit - {noise(step)}, 'n': -x}}))).n")
    finer = "list_filter([CASE WHEN {v} // 9 > 0 THEN {v} - 9 END, CASE WHEN {v} // 3 % 3 > 0 THEN {v} - 3 END, CASE WHEN {v} % 3 > 0 THEN {v} - 1 END], lambda x: x IS NOT NULL AND NOT list_contains({seen}, x))"
    fresh = finer.format(v="here", seen="seen")
    sens = "(k * k / (k - 1e0) + 1)"
    return f"""
 rel{n} AS (SELECT * FROM (VALUES {rows}) v(rel, param, iteration, metric, k, beta, unit, steps, seed)),
 cs{n} AS (SELECT rel{n}.*, c.*, {q.u("", "sample", "rid").replace("'|sample'", "seed || '|sample'")} < beta AS keep FROM c, rel{n}),
 ls{n} AS (SELECT rel, k, metric, rid, ls, ln, la, ((ls * 3 + ln) * 3 + la)::BIGINT AS node, s.node AS segment, n.node AS nation,
   CASE la WHEN 0 THEN {q.ACCTBAL_TEXT} WHEN 1 THEN {q.ACCTBAL_BAND} ELSE '*' END AS acctbal,
   sw.n_leaves / 5e0 + nw.n_leaves / 25e0 + CASE la WHEN 0 THEN 1 / 1100001e0
     WHEN 1 THEN CASE WHEN acctbal >= 9000 THEN 100001 ELSE 100000 END / 1100001e0 ELSE 1 END AS share
   FROM cs{n} c, range(0, 3) a(ls), range(0, 3) b(ln), range(0, 3) d(la), st_c s, nt_c n, st_w sw, nt_w nw
   WHERE keep AND s.leaf = segment AND s.level = ls AND n.leaf = nation AND n.level = ln AND sw.node = s.node AND nw.node = n.node),
 lt{n} AS (SELECT *, count(*) OVER (PARTITION BY rel, node, segment, nation, acctbal) AS cnt, count(*) OVER (PARTITION BY rel, node) AS total FROM ls{n}),
 sn{n} AS (SELECT rel, node, CASE any_value(metric)
   WHEN 'granularity' THEN sum(CASE WHEN cnt < k THEN 3 ELSE share END) / (3 * (any_value(k) - 1))
   WHEN 'intensity' THEN sum(CASE WHEN cnt < k THEN 3 ELSE (ls + ln + la) / 2e0 END) / (3 * (any_value(k) - 1))
   ELSE sum(CASE WHEN cnt < k THEN total ELSE cnt END) / ({sens.replace("k", "any_value(k)")} * any_value(total)) END AS loss
   FROM lt{n} GROUP BY rel, node),
 mp{n} AS (SELECT rel, any_value(unit) AS unit, any_value(seed) AS seed, any_value(steps) AS steps, map(list(node), list(loss)) AS mp
   FROM sn{n} JOIN rel{n} USING (rel) GROUP BY rel),
 se{n} AS (SELECT rel, 0 AS step, 26::BIGINT AS here, []::BIGINT[] AS todo, [26]::BIGINT[] AS seen, [26]::BIGINT[] AS visited FROM rel{n}
  UNION ALL SELECT rel, step + 1, nxt, list_filter(todo, lambda x: x <> nxt), seen, list_append(visited, nxt) FROM (
   SELECT *, {pick("todo", "step")} AS nxt FROM (
    SELECT rel, step, todo || {fresh} AS todo, seen || {fresh} AS seen, visited, mp, unit, seed FROM se{n} JOIN mp{n} USING (rel) WHERE step < steps))),
 fin{n} AS (SELECT rel, {pick("visited", "steps")} AS best FROM se{n} JOIN mp{n} USING (rel) WHERE step = steps),
 out{n} AS (SELECT cs{n}.rel, param, cs{n}.iteration, cs{n}.metric AS optimised, cs{n}.rid, CASE WHEN lt.cnt >= cs{n}.k THEN lt.segment ELSE '*' END AS segment,
   CASE WHEN lt.cnt >= cs{n}.k THEN lt.nation ELSE '*' END AS nation, CASE WHEN lt.cnt >= cs{n}.k THEN lt.acctbal ELSE '*' END AS acctbal
   FROM cs{n} LEFT JOIN (SELECT lt{n}.* FROM lt{n} JOIN fin{n} ON fin{n}.rel = lt{n}.rel AND best = node) lt
   ON lt.rel = cs{n}.rel AND lt.rid = cs{n}.rid AND cs{n}.keep)"""


def release_search(r: Release, param: float, iteration: int, steps: int) -> tuple:
    """A release of the library as a search of ``private_ctes``."""
    return r.name, param, iteration, r.model, r.k, r.beta, r.search, steps, r.seed


G8_K, G8_STEPS = 20, 30
G8_SQL = recursive(q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, private_ctes(
    [("", 0, 1, "granularity", G8_K, 1.0, 0.1, G8_STEPS, SEED)])))
G9_SQL = recursive(q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, private_ctes(
    [release_search(Release("", 1.0, 1e-5, SEED), 0, 1, 300)])))


@query("g8_dp_search", G8_SQL + " SELECT segment, nation, acctbal, count(*) AS class_size FROM lt JOIN fin ON best = node GROUP BY ALL")
def g8(spark, sf):
    """Classes of the node drawn by the private search, 30 expansions."""
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    levels = lattice.dp_search(lattice.frequency_set(df, qis), qis, G8_K, 0.1, G8_STEPS, SEED)
    return classes.equivalence_classes(classes.generalise_all(df, qis, levels), qis)


@query("g9_safepub", G9_SQL + " SELECT rid, segment, nation, acctbal FROM out")
def g9(spark, sf):
    return safepub(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), 1.0, 1e-5, seed=SEED, steps=300)


# ---- the larger tables

QUANTITY_BAND = q.band_sql("l_quantity", 1, 49, 10, 0)
LINE_K = 180  # splits the classes of the sample tables


@query("g4_k_anonymise_lineitem", f"""WITH g AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, {QUANTITY_BAND} AS quantity,
 CAST(l_discount AS DECIMAL(18,2))::VARCHAR AS discount FROM lineitem),
 k AS (SELECT *, count(*) OVER (PARTITION BY returnflag, linestatus, quantity, discount) < {LINE_K} AS small FROM g)
 SELECT CASE WHEN small THEN '*' ELSE returnflag END AS returnflag, CASE WHEN small THEN '*' ELSE linestatus END AS linestatus,
 CASE WHEN small THEN '*' ELSE quantity END AS quantity, CASE WHEN small THEN '*' ELSE discount END AS discount, count(*) AS class_size
 FROM k GROUP BY ALL""")
def g4_lineitem(spark, sf):
    qis = fx.lineitem_qis(spark, sf)
    return classes.equivalence_classes(
        classes.k_anonymise(fx.lineitem_qi(spark, sf), qis, [0, 0, 1, 0], LINE_K), qis)


ORDER_NODES = f"""lr AS (SELECT ((ls * 3 + lp) * 3 + lm) * 4 + lt AS node, s.node AS status, p.node AS priority, m.node AS order_month,
   CASE lt WHEN 0 THEN CAST(totalprice AS DECIMAL(18,2))::VARCHAR WHEN 1 THEN {q.PRICE_BAND1} WHEN 2 THEN {q.PRICE_BAND2} ELSE '*' END AS totalprice,
   sw.n_leaves / 3e0 + pw.n_leaves / 5e0 + mw.n_leaves / 84e0 AS share
   FROM o, range(0, 3) a(ls), range(0, 3) b(lp), range(0, 3) d(lm), range(0, 4) e(lt), ot_c s, pr_c p, mo_c m, ot_w sw, pr_w pw, mo_w mw
   WHERE s.leaf = status AND s.level = ls AND p.leaf = priority AND p.level = lp AND m.leaf = order_month AND m.level = lm
   AND sw.node = s.node AND pw.node = p.node AND mw.node = m.node),
 c0 AS (SELECT node, status, priority, order_month, totalprice, count(*) AS cnt, any_value(share) AS part FROM lr GROUP BY ALL),
 cl AS (SELECT *, part + CASE WHEN totalprice = '*' THEN 1e0 WHEN contains(totalprice, '_') THEN
   (round((TRY_CAST(string_split(totalprice, '_')[2] AS DOUBLE) - TRY_CAST(string_split(totalprice, '_')[1] AS DOUBLE)) * 100) + 1) / 50000001e0
   ELSE 1 / 50000001e0 END AS share FROM c0),
 best AS (SELECT node AS best FROM (SELECT node, sum(CASE WHEN cnt < 5 THEN cnt * 4 ELSE cnt * share END) / 16 AS loss FROM cl GROUP BY node)
   ORDER BY round(loss, 9), node LIMIT 1)"""


@query("g7_optimal_k_anonymity_orders", q.with_(q.STATUS_T, q.PRIORITY_T, q.MONTH_T, q.ORDERS_QI, ORDER_NODES) + """SELECT CASE WHEN cnt < 5 THEN '*' ELSE status END AS status, CASE WHEN cnt < 5 THEN '*' ELSE priority END AS priority,
 CASE WHEN cnt < 5 THEN '*' ELSE order_month END AS order_month, CASE WHEN cnt < 5 THEN '*' ELSE totalprice END AS totalprice,
 sum(cnt)::BIGINT AS class_size FROM cl, best WHERE node = best GROUP BY 1, 2, 3, 4""")
def g7_orders(spark, sf):
    qis = fx.orders_qis(spark, sf)
    return classes.equivalence_classes(lattice.optimal_k_anonymity(fx.orders_qi(spark, sf), qis, 5)[1], qis)


def _wide_levels(n: str, qi, value: str) -> str:
    """CTE ``n``: cell number and covered share of a numeric attribute at every level, brute force."""
    units, scale = qi.grid_units, 10**qi.decimals
    at = f"(round(({value} - {qi.lo}) * {scale}))::BIGINT"
    parts = [f"SELECT p_partkey AS rid, 0 AS level, {at} AS cell, 1e0 / {qi.domain_size} AS share FROM part"]
    for level, w in enumerate(qi.widths, 1):
        w = round(w * scale)
        last = max(1, round(units / w)) - 1
        cell = f"least(greatest({at} // {w}, 0), {last})"
        parts.append(f"""SELECT p_partkey, {level}, {cell}, CASE WHEN {cell} = {last} THEN {units - last * w + 1} ELSE {w} END / {qi.domain_size}e0 FROM part""")
    parts.append(f"SELECT p_partkey, {qi.top_level}, 0, 1e0 FROM part")
    return f"{n} AS (" + " UNION ALL ".join(parts) + ")"


WIDE_K = 5
WIDE_SQL = q.with_(
    _wide_levels("a0", fx.WIDE_NUMBER, "p_partkey"), _wide_levels("a1", fx.WIDE_SIZE, "p_size"),
    _wide_levels("a2", fx.WIDE_PRICE, "p_retailprice"),
    """ty AS (SELECT *, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 1 ELSE 2 END AS up, dense_rank() OVER (ORDER BY p_type) AS own FROM part),
 a3 AS (SELECT p_partkey AS rid, l AS level, CASE l WHEN 0 THEN own WHEN 1 THEN up ELSE 0 END AS cell,
   CASE l WHEN 0 THEN 1 / 6e0 WHEN 1 THEN 0.5e0 ELSE 1 END AS share FROM ty, range(3) r(l))""",
    """br AS (SELECT *, p_brand[7:]::INT AS own FROM part),
 a4 AS (SELECT p_partkey AS rid, l AS level, CASE l WHEN 0 THEN own WHEN 1 THEN own // 10 ELSE 0 END AS cell,
   CASE l WHEN 0 THEN 1 / 25e0 WHEN 1 THEN CASE own // 10 WHEN 0 THEN 9 WHEN 1 THEN 10 ELSE 6 END / 25e0 ELSE 1 END AS share FROM br, range(3) r(l))""",
    f"""cl AS (SELECT a0.level AS l0, a1.level AS l1, a2.level AS l2, a3.level AS l3, a4.level AS l4, count(*) AS cnt,
   any_value(a0.share + a1.share + a2.share + a3.share + a4.share) AS share
   FROM a0 JOIN a1 USING (rid) JOIN a2 USING (rid) JOIN a3 USING (rid) JOIN a4 USING (rid)
   GROUP BY l0, l1, l2, l3, l4, a0.cell, a1.cell, a2.cell, a3.cell, a4.cell),
 sc AS (SELECT l0, l1, l2, l3, l4, (((l0 * 7 + l1) * 10 + l2) * 3 + l3) * 3 + l4 AS node,
   sum(CASE WHEN cnt < {WIDE_K} THEN cnt * 5 ELSE cnt * share END) / (5 * {WIDE_K - 1}) AS loss,
   coalesce(sum(cnt) FILTER (cnt < {WIDE_K}), 0) / sum(cnt)::DOUBLE AS gone FROM cl GROUP BY ALL)""") + """
 SELECT node::BIGINT AS node, concat_ws(',', l0, l1, l2, l3, l4) AS levels, round(loss, 6) AS granularity,
 round(gone, 6) AS suppressed_share FROM sc WHERE gone <= {limit} ORDER BY round(loss, 9), node LIMIT 1"""


def _wide(spark, sf, limit):
    qis = fx.wide_part_qis(spark, sf)
    scorer = lattice.Scorer(lattice.frequency_set(fx.wide_part_qi(spark, sf), qis), qis, WIDE_K)
    node = lattice.exact_node(scorer, limit)
    scores = scorer.scores(["granularity"], [node]).select(
        "node", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"), "granularity", "suppressed_share")
    return r6(scores, "granularity", "suppressed_share")


@query("g7_optimal_node_wide", WIDE_SQL.replace("{limit}", "1"))
def g7_wide(spark, sf):
    """Best of 5,670 nodes over five attributes of the parts."""
    return _wide(spark, sf, 1.0)


@query("g7_optimal_node_wide_suppression", WIDE_SQL.replace("{limit}", "0.01"))
def g7_wide_limit(spark, sf):
    """The same with at most a hundredth of the rows suppressed."""
    return _wide(spark, sf, 0.01)


@query("e9_sanitise_events", f"""SELECT event_id AS rid, event_type,
 {_noisy('value', 'value', 0.5, 0, 0, 500, 2, False, False).replace("'value') || '|' || (rid)", "'value') || '|' || (event_id)")} AS value FROM events""")
def e9_events(spark, sf):
    return release.sanitise(fx.events_qi(spark, sf), fx.events_qis(spark, sf), 0.5, K, SEED)


ORDER_ATTRS = {"status": "ot", "priority": "pr", "order_month": "mo"}
ORDER_FAR = " + ".join(f"power({t}_d.d / {t}_b.distance, 2)" for t in ORDER_ATTRS.values())
ORDER_AT = " AND ".join(f"{t}_d.a = {a} AND {t}_d.b = {t}_b.bottom" for a, t in ORDER_ATTRS.items())
ORDER_CLUSTERS = f"""c AS (SELECT * FROM o),
 ord AS (SELECT c.*, row_number() OVER (ORDER BY round(sqrt({ORDER_FAR} + power(totalprice / 500000, 2)), 12), rid) - 1 AS pos,
   count(*) OVER () AS total FROM c, ot_b, pr_b, mo_b, ot_d, pr_d, mo_d WHERE {ORDER_AT}),
 cl AS (SELECT *, least(pos // 100, total // 100 - 1)::BIGINT AS cluster_id FROM ord)"""
ORDER_CENTROIDS = [_dp_centroid(t, a, 1.0, k=100) for a, t in ORDER_ATTRS.items()]


@query("e10_microdp_orders", q.with_(
    q.STATUS_T, q.PRIORITY_T, q.MONTH_T, q.ORDERS_QI, ORDER_CLUSTERS, *ORDER_CENTROIDS,
    "num AS (SELECT cluster_id, avg(totalprice) AS totalprice FROM cl GROUP BY 1)") + f"""
 SELECT rid, dp_status.status, dp_priority.priority, dp_order_month.order_month,
 {_noisy('num.totalprice', 'totalprice', 1.0, 1, 0, 500000, 2, k=100)} AS totalprice
 FROM cl JOIN dp_status USING (cluster_id) JOIN dp_priority USING (cluster_id) JOIN dp_order_month USING (cluster_id)
 JOIN num USING (cluster_id)""")
def e10_orders(spark, sf):
    """One release of the orders; its clusters come from one sort of the whole table."""
    return release.microdp(fx.orders_qi(spark, sf), fx.orders_qis(spark, sf), 1.0, 100, SEED, "ordered")
