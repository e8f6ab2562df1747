"""Queries over utility metrics, disclosure risk and sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators import classes, linkage, metrics, ranks
from veilspark.operators.safepub import class_size_for
from veilspark.plans import evaluation as ev, fixtures as fx, sweeps
from veilspark.plans import sqltext as q
from veilspark.plans.catalog import query
from veilspark.plans.queries_release import (
    KANON, LATTICE, SEED, _anonymous, _dp_centroid, _noisy, _ordered_ctes, g4, private_ctes, recursive, release_search)
from veilspark.plans.queries_tables import r6
from veilspark.sources.tables import attach_grid

PENALTIES = ["granularity", "intensity", "discernibility", "entropy", "groupsize", "sse"]
BAND_SHARE = "CASE WHEN acctbal = '9000.00_10000.00' THEN 100001 ELSE 100000 END / 1100001e0"


# ---- utility metrics of one release

def _metric_ctes(source: str, by: str = "") -> str:
    """Plain sums of every metric over ``source``, brute force over rows; ``by`` ends with a comma."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    using = f"USING ({by.rstrip(', ')})" if by else "ON true"
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""
 mr AS (SELECT r.*, count(*) OVER ({part}) AS total, segment = '*' AND nation = '*' AND acctbal = '*' AS gone,
   sw.n_leaves / 5e0 + nw.n_leaves / 25e0 + CASE WHEN acctbal = '*' THEN 1e0 WHEN contains(acctbal, '_') THEN {BAND_SHARE} ELSE 1 / 1100001e0 END AS share,
   sn.level / 2e0 + nn.level / 2e0 + CASE WHEN acctbal = '*' THEN 1e0 WHEN contains(acctbal, '_') THEN 0.5e0 ELSE 0 END AS lvl
   FROM {source} r JOIN st_w sw ON sw.node = segment JOIN nt_w nw ON nw.node = nation
   JOIN st_n sn ON sn.node = segment JOIN nt_n nn ON nn.node = nation),
 mc AS (SELECT {by} gone, count(*)::DOUBLE AS size, any_value(total) AS total FROM mr GROUP BY {by} gone, segment, nation, acctbal),
 m1 AS (SELECT {by} sum(share) AS granularity, sum(lvl) AS intensity, count(*) AS n FROM mr {group}),
 m2 AS (SELECT {by} sum(CASE WHEN gone THEN size * total ELSE size * size END) AS discernibility, count(*)::DOUBLE AS groupsize
   FROM mc {group}),
 m3 AS (SELECT {by} sum(CASE WHEN v[2:] = '*' THEN cnt * total ELSE cnt * cnt END)::DOUBLE AS entropy FROM
   (SELECT {by} v, count(*) AS cnt, any_value(total) AS total FROM
     (SELECT {by} total, unnest(['s' || segment, 'n' || nation, 'a' || acctbal]) AS v FROM mr) GROUP BY {by} v) {group}),
 ms AS (SELECT {by} m1.* EXCLUDE ({(by.rstrip(', ') + ', n') if by else 'n'}), n, discernibility, groupsize, entropy
   FROM m1 JOIN m2 {using} JOIN m3 {using})"""


H_CTES = _anonymous(KANON) + "," + _metric_ctes("a")
SENS = f"({KANON * KANON} / {KANON - 1}e0 + 1)"
H_SQL = {
    "granularity": f"granularity / (3 * {KANON - 1})",
    "intensity": f"intensity / (3 * {KANON - 1})",
    "discernibility": f"discernibility / ({SENS} * n)",
    "entropy": f"entropy / ({SENS} * 3 * n)",
    "groupsize": "groupsize",
}


@query("h1_granularity", H_CTES + f" SELECT round({H_SQL['granularity']}, 6) AS granularity FROM ms")
def h1(spark, sf):
    return r6(metrics.granularity(g4(spark, sf), fx.customer_qis(spark, sf), KANON), "granularity")


@query("h2_intensity", H_CTES + f" SELECT round({H_SQL['intensity']}, 6) AS intensity FROM ms")
def h2(spark, sf):
    return r6(metrics.intensity(g4(spark, sf), fx.customer_qis(spark, sf), KANON), "intensity")


@query("h3_discernibility", H_CTES + f" SELECT round({H_SQL['discernibility']}, 6) AS discernibility FROM ms")
def h3(spark, sf):
    return r6(metrics.discernibility(g4(spark, sf), fx.customer_qis(spark, sf), KANON), "discernibility")


@query("h4_non_uniform_entropy", H_CTES + f" SELECT round({H_SQL['entropy']}, 6) AS entropy FROM ms")
def h4(spark, sf):
    return r6(metrics.non_uniform_entropy(g4(spark, sf), fx.customer_qis(spark, sf), KANON), "entropy")


@query("h5_group_count", H_CTES + " SELECT groupsize FROM ms")
def h5(spark, sf):
    return metrics.group_count(g4(spark, sf), fx.customer_qis(spark, sf))


@query("h5_avg_group_size", H_CTES + " SELECT round(n / groupsize, 6) AS avg_group_size FROM ms")
def h5_avg(spark, sf):
    return r6(metrics.avg_group_size(g4(spark, sf), fx.customer_qis(spark, sf)), "avg_group_size")


def _sse(source: str, by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    end = lambda at: f"TRY_CAST(string_split(r.acctbal, '_')[{at}] AS DOUBLE)"
    width = f"({end(-1)} - {end(1)})"
    return f"""SELECT {by} sum((CASE WHEN r.segment = '*' THEN 1 ELSE power(st_d.d / st_b.distance, 2) END)
 + (CASE WHEN r.nation = '*' THEN 1 ELSE power(nt_d.d / nt_b.distance, 2) END)
 + (CASE WHEN r.acctbal = '*' THEN 1 WHEN contains(r.acctbal, '_') THEN power({width} / 11000, 2)
    ELSE power((c.acctbal - TRY_CAST(r.acctbal AS DOUBLE)) / 11000, 2) END)) AS sse
 FROM {source} r JOIN c USING (rid) JOIN st_d ON st_d.a = c.segment AND st_d.b = r.segment
 JOIN nt_d ON nt_d.a = c.nation AND nt_d.b = r.nation, st_b, nt_b {group}"""


@query("h6_sse", _anonymous(KANON) + f" SELECT round(sse, 6) AS sse FROM ({_sse('a')})")
def h6(spark, sf):
    return r6(metrics.sse(fx.customer_qi(spark, sf), g4(spark, sf), fx.customer_qis(spark, sf)), "sse")


@query("h7_scores", H_CTES + " SELECT " + ", ".join(
    f"round(-{H_SQL[m]}, 6) AS {m}_score" for m in list(H_SQL)[:4]) + " FROM ms")
def h7(spark, sf):
    release, qis = g4(spark, sf), fx.customer_qis(spark, sf)
    sums = metrics.plain_sums(release, qis, list(metrics.PENALISED))
    for m in metrics.PENALISED:
        sums = metrics.score(sums.withColumn(
            m, F.col(m) / metrics.scale_of(m, F.lit(KANON), F.col("n_rows"), len(qis))), m)
    return r6(sums.drop("n_rows"), *[f"{m}_score" for m in metrics.PENALISED])


@query("h8_compute_metric", H_CTES + f" SELECT round({H_SQL['discernibility']}, 6) AS discernibility FROM ms")
def h8(spark, sf):
    return r6(metrics.compute_metric("discernibility", g4(spark, sf), fx.customer_qis(spark, sf), KANON), "discernibility")


@query("h9_compute_metrics", H_CTES + ", se AS (" + _sse("a") + ") " + " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, round({e}, 6) AS score FROM ms" for m, e in H_SQL.items()]
    + ["SELECT 'sse', round(sse, 6) FROM se"]))
def h9(spark, sf):
    return r6(metrics.compute_metrics(PENALTIES, g4(spark, sf), fx.customer_qis(spark, sf), KANON,
                                      fx.customer_qi(spark, sf)), "score")


# ---- disclosure risk

def _ranked(n: str, source: str, attr: str, kind: str) -> str:
    """CTE ``n``: rid, value, pos (ties by rid), rank (largest of the value) of one column."""
    if kind == "number":
        key = "0 AS tier, acctbal::DOUBLE AS key, " + q.ACCTBAL_TEXT + " AS value"
        return f"""{n} AS (SELECT rid, value, row_number() OVER (ORDER BY tier, key, value, rid) AS pos,
 count(*) OVER (ORDER BY tier, key, value RANGE UNBOUNDED PRECEDING) AS rank FROM (SELECT rid, {key} FROM {source}))"""
    return f"""{n}_k AS (SELECT {attr} AS v, count(*) AS n FROM {source} GROUP BY 1),
 {n}_g AS (SELECT x.v, round(sum(y.n * d), 9) AS key FROM {n}_k x, {n}_k y, {kind}_d WHERE a = x.v AND b = y.v GROUP BY x.v),
 {n} AS (SELECT rid, v AS value, row_number() OVER (ORDER BY key, v, rid) AS pos,
 count(*) OVER (ORDER BY key, v RANGE UNBOUNDED PRECEDING) AS rank FROM {source} JOIN {n}_g ON v = {attr})"""


MASKED = """z AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 4 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS segment,
 n_name AS nation, least(greatest(round(c_acctbal + (c_custkey * 7919 % 2001) - 1000, 2), -1000), 10000) AS acctbal
 FROM customer JOIN nation ON (c_nationkey + c_custkey % 3) % 25 = n_nationkey)"""
ATTRS = [("segment", "st"), ("nation", "nt"), ("acctbal", "number")]
ORIG_RANKS = ",\n".join(_ranked(f"o_{a}", "c", a, k) for a, k in ATTRS)
MASK_RANKS = ",\n".join(_ranked(f"m_{a}", "z", a, k) for a, k in ATTRS)
RISK = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, MASKED, ORIG_RANKS, MASK_RANKS) + ""
MAPPED = RISK + """, zz AS (SELECT s.rid, s2.value AS segment, n2.value AS nation, a2.value AS acctbal,
  s2.rank AS z0, n2.rank AS z1, a2.rank AS z2
  FROM m_segment s JOIN m_nation n USING (rid) JOIN m_acctbal a USING (rid)
  JOIN o_segment s2 ON s2.pos = s.pos JOIN o_nation n2 ON n2.pos = n.pos JOIN o_acctbal a2 ON a2.pos = a.pos),
 xx AS (SELECT rid, s.rank AS x0, n.rank AS x1, a.rank AS x2 FROM o_segment s JOIN o_nation n USING (rid) JOIN o_acctbal a USING (rid)),
 pr AS (SELECT xx.rid, zz.rid AS zid, greatest(abs(x0 - z0), abs(x1 - z1), abs(x2 - z2)) AS d FROM xx, zz),
 mn AS (SELECT rid, min(d) AS distance FROM pr GROUP BY rid)
 """


@query("i1_numeric_ranks", q.with_(q.CUSTOMER_QI, _ranked("r", "c", "acctbal", "number"))
       + "SELECT value, min(pos) AS first_rank, max(rank) AS last_rank FROM r GROUP BY value")
def i1(spark, sf):
    return ranks.numeric_ranks(fx.customer_qi(spark, sf), fx.ACCTBAL)


@query("i1_numeric_ranks_mixed", q.with_(q.MIXED_QI) + """SELECT temperature AS value, min(pos) AS first_rank, max(pos) AS last_rank FROM
 (SELECT temperature, row_number() OVER (ORDER BY contains(temperature, '_'), TRY_CAST(temperature AS DOUBLE), rid) AS pos FROM m) GROUP BY 1""")
def i1_mixed(spark, sf):
    return ranks.numeric_ranks(fx.mixed_qi(spark, sf), fx.TEMPERATURE)


@query("i2_categorical_ranks", q.with_(q.NATION_T, q.CUSTOMER_QI, _ranked("r", "c", "nation", "nt"))
       + "SELECT value, min(pos) AS first_rank, max(rank) AS last_rank FROM r GROUP BY value")
def i2(spark, sf):
    return ranks.categorical_ranks(fx.customer_qi(spark, sf), fx.category(spark, sf, "nation"))


@query("i3_reverse_map", MAPPED + "SELECT rid, segment, nation, acctbal FROM zz")
def i3(spark, sf):
    return ranks.reverse_map(fx.customer_qi(spark, sf), fx.masked_qi(spark, sf), fx.customer_qis(spark, sf))


@query("i4_nearest_numeric", q.with_(q.CUSTOMER_QI, MASKED) + """SELECT x, arg_min(y, (round(abs(x - y), 6)) * 1e7 + r) AS nearest FROM
 (SELECT DISTINCT acctbal AS x FROM c), (SELECT acctbal AS y, min(rid) AS r FROM z GROUP BY 1) GROUP BY x""")
def i4(spark, sf):
    points = fx.customer_qi(spark, sf).select(F.col("acctbal").alias("x"))
    column = fx.masked_qi(spark, sf).select(F.col("acctbal").alias("y"), F.col("rid").alias("first_rid"))
    return ranks.nearest_numeric(points, column)


@query("i5_nearest_category", q.with_(q.NATION_T, q.CUSTOMER_QI) + """SELECT x, arg_min(y, round(d, 9) * 1e9 + r) AS nearest FROM
 (SELECT DISTINCT nation AS x FROM c), (SELECT n_name AS y, min(c_custkey) AS r FROM customer JOIN nation ON c_nationkey - c_nationkey % 2 = n_nationkey GROUP BY 1), nt_d
 WHERE a = x AND b = y GROUP BY x""")
def i5(spark, sf):
    points = fx.customer_qi(spark, sf).select(F.col("nation").alias("x"))
    # released nations: every second one is merged into the one before it
    nation = F.broadcast(fx.table(spark, sf, "nation").select("n_nationkey", "n_name"))
    column = fx.table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") - F.col("c_nationkey") % 2 == F.col("n_nationkey")).select(
        F.col("n_name").alias("y"), F.col("c_custkey").alias("first_rid"))
    return ranks.nearest_category(points, column, fx.category(spark, sf, "nation"))


@query("i5_nearest_supplier", q.with_(q.SUPPLIER_T) + """SELECT x, arg_min(y, round(d, 9) * 1e9 + r) AS nearest FROM
 (SELECT s_name AS x FROM supplier UNION SELECT n_name FROM nation),
 (SELECT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN n_name ELSE r_name END AS y, min(s_suppkey) AS r
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 5 > 0 GROUP BY 1), su_d
 WHERE a = x AND b = y GROUP BY x""")
def i5_supplier(spark, sf):
    supplier = fx.table(spark, sf, "supplier")
    nation, region = (F.broadcast(fx.table(spark, sf, t)) for t in ("nation", "region"))
    points = supplier.select(F.col("s_name").alias("x")).unionByName(nation.select(F.col("n_name").alias("x")))
    # a third of the released suppliers is generalised to nations, a third to regions
    place, key = F.col("s_suppkey") % 3, F.col("s_suppkey")
    column = supplier.filter(key % 5 > 0).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(place == 0, F.col("s_name")).when(place == 1, F.col("n_name")).otherwise(F.col("r_name")).alias("y"),
        key.alias("first_rid"))
    return ranks.nearest_category(points, column, fx.category(spark, sf, "supplier"))


NEAR = lambda a, t: f"""y_{a} AS (SELECT x AS v, arg_min(y, round(d, 9) * 1e9 + r) AS y FROM (SELECT DISTINCT {a} AS x FROM c),
 (SELECT {a} AS y, min(rid) AS r FROM z GROUP BY 1), {t}_d WHERE a = x AND b = y GROUP BY x)"""


@query("i6_permutation_distance", RISK + ", " + NEAR("segment", "st") + ", " + NEAR("nation", "nt") + """,
 y_acctbal AS (SELECT x AS v, arg_min(y, round(abs(x - y), 6) * 1e7 + r) AS y FROM (SELECT DISTINCT acctbal AS x FROM c),
  (SELECT acctbal AS y, min(rid) AS r FROM z GROUP BY 1) GROUP BY x),
 rk_segment AS (SELECT DISTINCT value, rank FROM m_segment), rk_nation AS (SELECT DISTINCT value, rank FROM m_nation),
 rk_acctbal AS (SELECT DISTINCT value::DOUBLE AS value, rank FROM m_acctbal)
 SELECT c.rid, abs(s2.rank - s.rank) AS d_segment, abs(n2.rank - n.rank) AS d_nation, abs(a2.rank - a.rank) AS d_acctbal,
 greatest(abs(s2.rank - s.rank), abs(n2.rank - n.rank), abs(a2.rank - a.rank)) AS max_distance
 FROM c JOIN m_segment s USING (rid) JOIN m_nation n USING (rid) JOIN m_acctbal a USING (rid)
 JOIN y_segment ys ON ys.v = c.segment JOIN y_nation yn ON yn.v = c.nation JOIN y_acctbal ya ON ya.v = c.acctbal
 JOIN rk_segment s2 ON s2.value = ys.y JOIN rk_nation n2 ON n2.value = yn.y JOIN rk_acctbal a2 ON a2.value = ya.y""")
def i6(spark, sf):
    qis = fx.customer_qis(spark, sf)
    out = linkage.permutation_distance(fx.customer_qi(spark, sf), fx.masked_qi(spark, sf), qis)
    return out.select("rid", *[F.col("distances")[j].alias(f"d_{qi.name}") for j, qi in enumerate(qis)], "max_distance")


@query("i7_closest_records", MAPPED + """SELECT rid, any_value(distance) AS distance, count(*) AS n_closest
 FROM pr JOIN mn USING (rid) WHERE d = distance GROUP BY rid""")
def i7(spark, sf):
    return linkage.closest_released(fx.customer_qi(spark, sf), fx.masked_qi(spark, sf), fx.customer_qis(spark, sf))


@query("i7_closest_records_expanded", MAPPED + """SELECT rid, distance, zid AS match_rid FROM pr JOIN mn USING (rid) WHERE d = distance""")
def i7_expanded(spark, sf):
    return linkage.closest_released(fx.customer_qi(spark, sf), fx.masked_qi(spark, sf), fx.customer_qis(spark, sf), expand=True)


LINKAGE = MAPPED + """, one AS (SELECT rid, any_value(zid) AS zid FROM pr JOIN mn USING (rid) WHERE d = distance GROUP BY rid HAVING count(*) = 1)
 SELECT round(count(*) FILTER (one.zid = xx.rid) / count(*)::DOUBLE, 6) AS record_linkage FROM xx LEFT JOIN one ON one.rid = xx.rid"""


@query("i8_record_linkage", LINKAGE)
def i8(spark, sf):
    return r6(linkage.record_linkage(fx.customer_qi(spark, sf), fx.masked_qi(spark, sf), fx.customer_qis(spark, sf)), "record_linkage")


@query("i8_record_linkage_self", LINKAGE.replace(MASKED, "z AS (SELECT * FROM c)"))
def i8_self(spark, sf):
    df = fx.customer_qi(spark, sf)
    return r6(linkage.record_linkage(df, df, fx.customer_qis(spark, sf)), "record_linkage")


# ---- sweeps

SAMPLE = f"""ra AS (SELECT 'flat' AS model, p AS param, i AS iteration, rid, CASE WHEN p = 2 THEN s.node ELSE segment END AS segment,
 CASE WHEN p = 2 THEN n.node ELSE nation END AS nation, {q.ACCTBAL_BAND} AS acctbal, (rid + i) % 10 < p AS gone
 FROM c JOIN st_c s ON s.leaf = segment AND s.level = 1 JOIN nt_c n ON n.leaf = nation AND n.level = 1,
 (VALUES (1.0e0), (2.0e0)) v(p), (VALUES (1), (2)) w(i)),
 r AS (SELECT model, param, iteration, rid, CASE WHEN gone THEN '*' ELSE segment END AS segment,
 CASE WHEN gone THEN '*' ELSE nation END AS nation, CASE WHEN gone THEN '*' ELSE acctbal END AS acctbal FROM ra)"""
BY = "model, param, iteration, "
KSQL = "CASE param WHEN 1 THEN 5 ELSE 10 END"
K_OF = {1.0: 5, 2.0: 10}


def _sens(k):
    return f"(CASE WHEN {k} = 1 THEN 5 ELSE {k} * {k} / nullif({k} - 1e0, 0) + 1 END)"


def _scaled(k):
    return {
        "granularity": f"granularity / (CASE WHEN {k} > 1 THEN 3 * ({k} - 1) ELSE 1 END)",
        "intensity": f"intensity / (CASE WHEN {k} > 1 THEN 3 * ({k} - 1) ELSE 1 END)",
        "discernibility": f"discernibility / ({_sens(k)} * n)",
        "entropy": f"entropy / ((CASE WHEN {k} = 1 THEN 1 ELSE {_sens(k)} END) * 3 * n)",
        "groupsize": "groupsize",
    }


S_CTES = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, SAMPLE, _metric_ctes("r", BY)) + ", sse AS (" + _sse(
    "r", BY) + f"), sc AS (SELECT {BY} metric, score, {KSQL} AS k FROM (" + " UNION ALL ".join(
    [f"SELECT {BY} '{m}' AS metric, {e} AS score FROM (SELECT *, {KSQL} AS kk FROM ms)" for m, e in _scaled("kk").items()]
    + [f"SELECT {BY} 'sse', sse FROM sse"]) + "))\n"


def _scores(spark, sf):
    return ev.score_releases(fx.sample_releases(spark, sf), fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), PENALTIES, K_OF)


@query("j1_score_releases", S_CTES + f"SELECT {BY} metric, k, round(score, 6) AS score FROM sc")
def j1(spark, sf):
    return r6(_scores(spark, sf), "score")


@query("j2_mean_metrics", S_CTES + "SELECT param, " + ", ".join(
    f"round(avg(score) FILTER (metric = '{m}'), 6) AS {m}" for m in metrics.METRICS) + " FROM sc GROUP BY param")
def j2(spark, sf):
    return r6(ev.mean_metrics(_scores(spark, sf), "param"), *metrics.METRICS)


@query("j3_mean_by_iterations", S_CTES + """SELECT model, param, metric, c AS iterations, round(avg(score), 6) AS mean_score
 FROM sc, (VALUES (1), (2)) v(c) WHERE iteration <= c GROUP BY ALL""")
def j3(spark, sf):
    return r6(ev.mean_by_iterations(_scores(spark, sf), [1, 2]), "mean_score")


KS = [1, 5, 10]
RAW_TEXT = f"raw AS (SELECT rid, segment, nation, {q.ACCTBAL_TEXT} AS acctbal FROM c)"


def _reference(ks, subset=("segment", "nation", "acctbal"), n="ref"):
    """Reference scores of a subset of the customer attributes, brute force."""
    m = len(subset)
    cells = "[" + ", ".join(f"'{a}' || {a}" for a in subset) + "]"
    leaf = {"segment": "1 / 5e0", "nation": "1 / 25e0", "acctbal": "1 / 1100001e0"}
    share = " + ".join(leaf[a] for a in subset)
    out = f"""{n}_s AS (SELECT 'original' AS reference, count(*) AS n, count(*) * ({share}) AS granularity, 0e0 AS intensity,
  (SELECT sum(x * x)::DOUBLE FROM (SELECT count(*) AS x FROM raw GROUP BY {', '.join(subset)})) AS discernibility,
  (SELECT sum(x * x)::DOUBLE FROM (SELECT count(*) AS x FROM (SELECT unnest({cells}) AS v FROM raw) GROUP BY v)) AS entropy,
  (SELECT count(*)::DOUBLE FROM (SELECT DISTINCT {', '.join(subset)} FROM raw)) AS groupsize, 0e0 AS sse FROM raw
  UNION ALL SELECT 'suppressed', count(*), count(*) * {m}, count(*) * {m}, count(*)::DOUBLE * count(*), count(*)::DOUBLE * count(*) * {m}, 1, count(*) * {m} FROM raw),
 {n} AS ("""
    parts = []
    for k in ks:
        for metric, e in {**_scaled(k), "sse": "sse"}.items():
            e = e.replace("3 *", f"{m} *").replace("* 3 * n", f"* {m} * n")
            parts.append(f"SELECT reference, {k} AS k, '{metric}' AS metric, {e} AS score FROM {n}_s")
    return out + " UNION ALL ".join(parts) + ")"


REF_HEAD = q.with_(q.CUSTOMER_QI, RAW_TEXT)


@query("j4_reference_scores", REF_HEAD + ", " + _reference(KS) + " SELECT reference, k, metric, round(score, 6) AS score FROM ref")
def j4(spark, sf):
    return r6(ev.reference_scores(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), PENALTIES, KS), "score")


@query("j5_append_reference", REF_HEAD + ", " + _reference(KS) + " SELECT reference, k, metric, round(score, 6) AS score FROM ref")
def j5(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    first = ev.reference_scores(df, qis, PENALTIES, [1, 5])
    return r6(ev.append_reference(first, ev.reference_scores(df, qis, PENALTIES, [5, 10])), "score")


@query("j6_reference_scores_by_subset", REF_HEAD + ", " + _reference([1, 5], ("segment", "nation"), "r1") + ", "
       + _reference([1, 5], ("nation", "acctbal"), "r2") + """ SELECT 'segment-nation' AS subset, reference, k, metric, round(score, 6) AS score FROM r1
 UNION ALL SELECT 'nation-acctbal', reference, k, metric, round(score, 6) FROM r2""")
def j6(spark, sf):
    return r6(ev.reference_scores_by_subset(
        fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), PENALTIES, [1, 5],
        [["segment", "nation"], ["nation", "acctbal"]]), "score")


N_CTES = S_CTES + ", " + RAW_TEXT + ", " + _reference(KS) + f""", nm AS (SELECT {BY} sc.metric, sc.k,
 (sc.score - o.score) / nullif(s.score - o.score, 0) AS score FROM sc JOIN ref o ON o.metric = sc.metric AND o.k = sc.k AND o.reference = 'original'
 JOIN ref s ON s.metric = sc.metric AND s.k = sc.k AND s.reference = 'suppressed')"""


def _normalised(spark, sf):
    reference = ev.reference_scores(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), PENALTIES, KS)
    return ev.normalise_scores(_scores(spark, sf), reference)


@query("j7_normalise_scores", N_CTES + f" SELECT {BY} metric, k, round(score, 6) AS score FROM nm")
def j7(spark, sf):
    return r6(_normalised(spark, sf), "score")


@query("j8_mean_std", S_CTES + """SELECT model, param, metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std
 FROM sc GROUP BY ALL""")
def j8(spark, sf):
    return r6(ev.mean_std(_scores(spark, sf)), "mean", "std")


@query("j9_mean_histogram", q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, SAMPLE) + """SELECT model, param, attr, value, count(*) / 2e0 AS mean_count FROM
 (SELECT model, param, 'segment' AS attr, segment AS value FROM r UNION ALL SELECT model, param, 'nation', nation FROM r
  UNION ALL SELECT model, param, 'acctbal', acctbal FROM r) GROUP BY ALL""")
def j9(spark, sf):
    return ev.mean_histogram(fx.sample_releases(spark, sf), fx.customer_qis(spark, sf), 2)


@query("j10_suppressed_records", q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, SAMPLE) + f"""SELECT {BY} count(*) FILTER (segment = '*' AND nation = '*' AND acctbal = '*') AS n_suppressed,
 round(count(*) FILTER (segment = '*' AND nation = '*' AND acctbal = '*') / count(*)::DOUBLE, 6) AS share_suppressed FROM r GROUP BY ALL""")
def j10(spark, sf):
    return r6(ev.suppressed_records(fx.sample_releases(spark, sf), fx.customer_qis(spark, sf)), "share_suppressed")


J11_LEVELS = {1.0: [0, 2, 1], 2.0: [2, 2, 1], 3.0: [1, 1, 1], 4.0: [0, 0, 0]}
J11_VALUES = ", ".join(f"({p}e0, {s}, {n}, {a})" for p, (s, n, a) in J11_LEVELS.items())


@query("j11_suppressed_attributes", q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + f"""
, r AS (SELECT p AS param, s.node AS segment, n.node AS nation,
  CASE la WHEN 0 THEN {q.ACCTBAL_TEXT} ELSE {q.ACCTBAL_BAND} END AS acctbal FROM c, (VALUES {J11_VALUES}) v(p, ls, ln, la), st_c s, nt_c n
  WHERE s.leaf = c.segment AND s.level = ls AND n.leaf = c.nation AND n.level = ln),
 k AS (SELECT *, count(*) OVER (PARTITION BY param, segment, nation, acctbal) < {KANON} AS small FROM r)
 SELECT 'flat' AS model, param, 1 AS iteration, coalesce(max((segment = '*')::INT + (nation = '*')::INT) FILTER (NOT small), 3) AS n_suppressed_attrs
 FROM k GROUP BY param""")
def j11(spark, sf):
    """k-anonymous releases at four nodes; the last, without generalisation, leaves no class."""
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    parts = [attach_grid(classes.k_anonymise(df, qis, levels, KANON), model=["flat"], param=[p], iteration=[1])
             for p, levels in J11_LEVELS.items()]
    return ev.suppressed_attributes(reduce(DataFrame.unionByName, parts), qis)


@query("j12_compare", N_CTES + """, x AS (SELECT 'swept' AS model, param, score FROM nm WHERE metric = 'sse'
 UNION ALL SELECT 'baseline', p, score FROM nm, (VALUES (1.0e0), (2.0e0)) v(p) WHERE metric = 'sse' AND param = 1)
 SELECT model, param, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM x GROUP BY ALL""")
def j12(spark, sf):
    scores = _normalised(spark, sf)
    baseline = ev.over_values(scores.filter("param = 1"), "param", [1.0, 2.0])
    return r6(ev.compare({"swept": scores, "baseline": baseline}, "sse"), "mean", "std")


@query("j12_compare_k_delta", N_CTES + """ SELECT 'aligned' AS model, CASE param WHEN 1 THEN 200e0 ELSE 500e0 END AS param,
 round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM nm WHERE metric = 'sse' GROUP BY param""")
def j12_aligned(spark, sf):
    moved = ev.align_by_position(_normalised(spark, sf), "param", [1.0, 2.0], [200.0, 500.0])
    return r6(ev.compare({"aligned": moved}, "sse"), "mean", "std")


# runs of a model: the same lattice node released for two class sizes
RUNS = [5, 10]


def _runs(df: DataFrame, qis: list, levels: list[int], model: str, **labels) -> DataFrame:
    """Discernibility of one lattice node's releases for all class sizes, labelled."""
    cells = attach_grid(classes.generalise_all(df, qis, levels), param=[float(k) for k in RUNS]).withColumn("iteration", F.lit(1))
    releases = classes.suppress_small(cells, qis, F.col("param"), ["param"]).withColumn("model", F.lit(model))
    scores = ev.score_releases(releases, df, qis, ["discernibility"], F.col("param").cast("int"))
    return scores.select("*", *[F.lit(v).alias(c) for c, v in labels.items()])


def _runs_sql(x: str, cells: list[tuple]) -> str:
    """The same from rows: ``cells`` lists model, label, source and the text of a row's class."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, {label} AS x, {key} AS cls FROM {source}" for m, label, source, key in cells)
    return f""",
 rc AS ({rows}), rk AS (SELECT model, x, k, count(*) OVER (PARTITION BY model, x, k, cls) AS cnt, count(*) OVER (PARTITION BY model, x, k) AS total
  FROM rc, (VALUES {", ".join(f"({k})" for k in RUNS)}) v(k)),
 rs AS (SELECT model, x, k, sum(CASE WHEN cnt < k THEN total ELSE cnt END)::DOUBLE / ((k * k / (k - 1e0) + 1) * count(*)) AS score FROM rk GROUP BY model, x, k)
 SELECT model, x AS {x}, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM rs GROUP BY ALL"""


CUSTOMER_CELLS = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI, q.PART_QI) + f""",
 cc AS (SELECT segment, nation, {q.ACCTBAL_TEXT} AS acctbal, s.node AS segment1, n.node AS nation1, {q.ACCTBAL_BAND} AS acctbal1
  FROM c, st_c s, nt_c n WHERE s.leaf = segment AND s.level = 1 AND n.leaf = nation AND n.level = 1)""".lstrip("\n")
MODELS = {"fine": [0, 0, 1], "coarse": [1, 1, 1]}


def _class_text(levels: list[int]) -> str:
    return " || '|' || ".join(a + ("1" if level else "") for a, level in zip(["segment", "nation", "acctbal"], levels))


@query("j12_compare_attributes", CUSTOMER_CELLS + _runs_sql("n_attrs", [
    (m, n, "cc", _class_text(levels[:n])) for m, levels in MODELS.items() for n in (1, 2, 3)]))
def j12_attributes(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    models = {m: reduce(DataFrame.unionByName, [
        _runs(df, qis[:n], levels[:n], m, n_attrs=n) for n in (1, 2, 3)]) for m, levels in MODELS.items()}
    return r6(ev.compare(models, "discernibility", ["n_attrs"]), "mean", "std")


PART_BANDS = f"{q.SIZE_BAND} || '|' || {q.band_sql('retailprice', 9000, 1000, 200, 1)}"


@query("j12_compare_datasets", CUSTOMER_CELLS + _runs_sql("dataset", [
    ("raw", "'customer'", "cc", _class_text([0, 0, 0])), ("banded", "'customer'", "cc", _class_text([1, 1, 1])),
    ("raw", "'part'", "p", "size::VARCHAR || '|' || retailprice::VARCHAR"), ("banded", "'part'", "p", PART_BANDS)]))
def j12_datasets(spark, sf):
    sets = {"customer": (fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)), "part": (fx.part_qi(spark, sf), fx.part_qis(spark, sf))}
    models = {m: reduce(DataFrame.unionByName, [
        _runs(df, qis, [level] * len(qis), m, dataset=name) for name, (df, qis) in sets.items()])
        for m, level in (("raw", 0), ("banded", 1))}
    return r6(ev.compare(models, "discernibility", ["dataset"]), "mean", "std")


@query("j14_value_frequency", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def j14(spark, sf):
    return ev.value_frequency(fx.orders_qi(spark, sf), "priority")


RL_SQL = LINKAGE.replace("SELECT round(count(*)", "SELECT 'flat' AS model, 1.0e0 AS param, 1 AS iteration, round(count(*)").replace(
    "FROM xx LEFT JOIN", ", (SELECT round(sum(power(nt_d.d / nt_b.distance, 2) + power(st_d.d / st_b.distance, 2) + power((c.acctbal - z.acctbal) / 11000, 2)) / (3 * count(*)), 6)"
    " FROM c JOIN z USING (rid) JOIN nt_d ON nt_d.a = c.nation AND nt_d.b = z.nation JOIN st_d ON st_d.a = c.segment AND st_d.b = z.segment, nt_b, st_b) AS information_loss"
    " FROM xx LEFT JOIN")


@query("j13_risk_utility", RL_SQL)
def j13(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    rel = classes.release_cells(fx.masked_qi(spark, sf), qis, ["rid"]).select(
        F.lit("flat").alias("model"), F.lit(1.0).alias("param"), F.lit(1).alias("iteration"), "*")
    scores = ev.score_releases(rel, df, qis, ["sse", "record_linkage"], 5)
    norm = ev.normalise_scores(scores, ev.reference_scores(df, qis, ["sse"], [5]))
    return r6(ev.risk_utility(scores, norm), "record_linkage", "information_loss")


# ---- whole sweeps: every release replayed in SQL, then scored

BASE = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI)
KA_CTES = LATTICE[len(BASE):].lstrip(", \n") + """, bs AS (SELECT node AS best FROM sl ORDER BY round(granularity, 9), node LIMIT 1),
 ka AS (SELECT rid, CASE WHEN cnt < 5 THEN '*' ELSE segment END AS segment, CASE WHEN cnt < 5 THEN '*' ELSE nation END AS nation,
 CASE WHEN cnt < 5 THEN '*' ELSE acctbal END AS acctbal FROM lk, bs WHERE node = best)"""


def _microdp_ctes(n: str, k: int, grid: list[tuple[float, int]], with_k: bool) -> str:
    """CTE ``n`` (eps, iteration, rid and cells): releases of the one-sort clusters of size k. ``with_k``:
    k is part of every draw, as in a sweep over k."""
    ctes = [_ordered_ctes(k).replace("ord AS", f"{n}_o AS").replace("cl AS", f"{n}_c AS").replace("FROM ord)", f"FROM {n}_o)"),
            f"{n}_m AS (SELECT cluster_id, avg(acctbal) AS acctbal FROM {n}_c GROUP BY 1)"]
    parts = []
    for e, i in grid:
        tag = f"{n}_{str(e).replace('.', '_')}_{i}"
        for t, attr in (("st", "segment"), ("nt", "nation")):
            one = _dp_centroid(t, attr, e, i, f"{tag}_{t}", k).replace("FROM cl GROUP", f"FROM {n}_c GROUP")
            ctes.append(one.replace(" (cluster_id)::VARCHAR", f" '{k}|' || (cluster_id)::VARCHAR") if with_k else one)
        cell = _noisy("m.acctbal", "acctbal", e, i, -1000, 10000, 2, k=k)
        if with_k:
            cell = cell.replace("(rid)::VARCHAR", f"'{k}|' || (rid)::VARCHAR")
        parts.append(f"""SELECT {e}e0 AS eps, {i} AS iteration, rid, a.segment, b.nation, {cell} AS acctbal
 FROM {n}_c JOIN {tag}_st a USING (cluster_id) JOIN {tag}_nt b USING (cluster_id) JOIN {n}_m m USING (cluster_id)""")
    return ",\n".join(ctes) + f",\n {n} AS (" + " UNION ALL ".join(parts) + ")"


def _searches(settings, iterations, models=("granularity",), steps=300):
    out = []
    for r in sweeps.safepub_settings(settings, SEED, iterations, list(models)):
        param, i, _ = r.name.split("|")
        out.append(release_search(r, float(param), int(i), steps))
    return out


def _sweep_sql(ctes: list[str], releases: str, k_sql: str, ks: list[int]) -> str:
    """Mean and deviation of the normalised metrics of ``releases`` (a union over the CTEs)."""
    score = " UNION ALL ".join(
        [f"SELECT {BY} '{m}' AS metric, {e} AS score FROM (SELECT *, {k_sql} AS kk FROM ms)" for m, e in _scaled("kk").items()]
        + [f"SELECT {BY} 'sse', sse FROM sse"])
    return recursive(BASE) + ", " + ",\n".join([
        *ctes, f"r AS ({releases})", _metric_ctes("r", BY), "sse AS (" + _sse("r", BY) + ")",
        f"sw AS (SELECT {BY} metric, score, {k_sql} AS k FROM ({score}))", RAW_TEXT, _reference(ks),
        f"""nm AS (SELECT {BY} sw.metric, (sw.score - o.score) / nullif(s.score - o.score, 0) AS score
 FROM sw JOIN ref o ON o.metric = sw.metric AND o.k = sw.k AND o.reference = 'original'
 JOIN ref s ON s.metric = sw.metric AND s.k = sw.k AND s.reference = 'suppressed')"""]) + """
 SELECT model, param, metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM nm GROUP BY ALL"""


def _case(values: dict[float, int]) -> str:
    return "CASE param " + " ".join(f"WHEN {p!r}::DOUBLE THEN {k}" for p, k in values.items()) + " END"


MD = "SELECT 'MicroDP' AS model, {param} AS param, iteration, rid, segment, nation, acctbal FROM {n}"
SP = " UNION ALL SELECT 'SafePub', param::DOUBLE, iteration, rid, segment, nation, acctbal FROM out"
J15_EPS, J15_DELTA = [0.5, 2.0], 1e-5
J15_K = {e: class_size_for(e, J15_DELTA) for e in J15_EPS}


@query("j15_sweep_epsilon", _sweep_sql(
    [private_ctes(_searches([(e, e, J15_DELTA) for e in J15_EPS], 2)), KA_CTES,
     _microdp_ctes("md", 25, [(e, i) for e in J15_EPS for i in (1, 2)], False)],
    MD.format(param="eps", n="md") + SP + " UNION ALL SELECT 'k-anonymisation', 5e0, 1, rid, segment, nation, acctbal FROM ka",
    f"CASE model WHEN 'MicroDP' THEN 25 WHEN 'k-anonymisation' THEN 5 ELSE {_case(J15_K)} END", sorted({25, 5, *J15_K.values()})))
def j15(spark, sf):
    return r6(sweeps.sweep_epsilon(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), J15_EPS, 25, J15_DELTA, iterations=2,
                                   seed=SEED, steps=300, strategy="ordered"), "mean", "std")


J15_MODELS = ["granularity", "intensity", "discernibility"]


@query("j15_sweep_optimised", _sweep_sql(
    [private_ctes(_searches([(e, e, J15_DELTA) for e in J15_EPS], 2, J15_MODELS))],
    "SELECT optimised AS model, param::DOUBLE AS param, iteration, rid, segment, nation, acctbal FROM out",
    _case(J15_K), sorted(set(J15_K.values()))))
def j15_optimised(spark, sf):
    """SafePub for three optimised metrics."""
    return r6(sweeps.sweep_optimised(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), J15_EPS, J15_MODELS, J15_DELTA,
                                     iterations=2, seed=SEED, steps=300), "mean", "std")


J16_KS, J16_K = [20, 50], {d: class_size_for(1.0, d) for d in (1e-4, 1e-6)}


@query("j16_sweep_k_delta", _sweep_sql(
    [private_ctes(_searches([(d, 1.0, d) for d in J16_K], 1)), *[_microdp_ctes(f"md{k}", k, [(1.0, 1)], True) for k in J16_KS]],
    " UNION ALL ".join(MD.format(param=f"{k}e0", n=f"md{k}") for k in J16_KS) + SP,
    f"CASE model WHEN 'MicroDP' THEN param::INT ELSE {_case(J16_K)} END", sorted({*J16_KS, *J16_K.values()})))
def j16(spark, sf):
    return r6(sweeps.sweep_k_delta(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), J16_KS, list(J16_K),
                                   seed=SEED, steps=300, strategy="ordered"), "mean", "std")


@query("j17_sweep_attributes")
def j17(spark, sf):
    return sweeps.sweep_attributes(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf),
                                   [["segment", "nation"], ["nation", "acctbal"]], 25, seed=SEED, steps=300, strategy="ordered")


@query("j18_sweep_disclosure")
def j18(spark, sf):
    return sweeps.sweep_disclosure(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), [1.0, 2.0], 25,
                                   seed=SEED, steps=300, strategy="ordered")
