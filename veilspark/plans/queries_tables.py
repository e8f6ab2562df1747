"""Queries over sources, taxonomies, distances and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import cells, distance
from veilspark.operators import classes, marginality as mg, taxonomy as tx
from veilspark.plans import fixtures as fx
from veilspark.plans import sqltext as q
from veilspark.plans.catalog import query
from veilspark.runtime import shared_dir
from veilspark.sources import tables
from veilspark.sources.hierarchy import closure_from_lines
from veilspark.spec import STAR

LINEITEM_COLS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
                 "l_tax l_returnflag l_linestatus l_shipdate").split()


def r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a1_read_table", f"""SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM_COLS)}) AS rid,
 l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def a1(spark, sf):
    return tables.read_table(spark, f"{sf}/lineitem.parquet").select("rid", "l_orderkey", "l_linenumber", "l_quantity")


def _closure(spark, sf, attr):
    return closure_from_lines(fx.LINES[attr](spark, sf), attr).select(
        "leaf", "leaf_ord", "path_id", "level", "node", "height", "n_leaves", "is_numeric")


def _closure_sql(n, ctes):
    return q.with_(ctes) + f"""SELECT leaf, leaf_ord, path_id, level, node, height, n_leaves, false AS is_numeric
 FROM {n}_c JOIN {n}_w USING (node)"""


@query("a2_read_hierarchy", _closure_sql("su", q.SUPPLIER_T))
def a2(spark, sf):
    return _closure(spark, sf, "supplier")


@query("a2_read_hierarchy_two_parents", _closure_sql("sh", q.SHARED_T))
def a2_shared(spark, sf):
    return _closure(spark, sf, "shared")


@query("a2_read_hierarchy_ragged", _closure_sql("rg", q.RAGGED_T))
def a2_ragged(spark, sf):
    return _closure(spark, sf, "ragged")


@query("a3_drop_attrs", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a3(spark, sf):
    return tables.drop_attrs(fx.table(spark, sf, "customer"), ["c_name"])


@query("a4_attribute_subset", q.with_(q.CUSTOMER_QI) + """SELECT 'segment-nation' AS subset, segment || '/' || nation AS cells,
 count(*) AS n FROM c GROUP BY 2 UNION ALL
 SELECT 'segment-acctbal', segment || '/' || CAST(acctbal AS DECIMAL(18,2))::VARCHAR, count(*) FROM c GROUP BY 2 UNION ALL
 SELECT 'nation-acctbal', nation || '/' || CAST(acctbal AS DECIMAL(18,2))::VARCHAR, count(*) FROM c GROUP BY 2""")
def a4(spark, sf):
    df, qis = fx.customer_qi(spark, sf), fx.customer_qis(spark, sf)
    out = None
    for attrs in tables.attribute_subsets(qis, 2):
        sub, chosen = tables.attribute_subset(df, qis, attrs)
        text = classes.release_cells(sub, chosen, [])
        part = text.groupBy(F.concat_ws("/", *attrs).alias("cells")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(tables.subset_name(attrs)).alias("subset"), "cells", "n")
        out = part if out is None else out.unionByName(part)
    return out


RELEASES_SQL = q.with_(q.CUSTOMER_QI) + f"""SELECT 'flat' AS model, p AS param, i AS iteration, rid, segment, nation,
 CASE WHEN p = 1 THEN {q.ACCTBAL_TEXT} ELSE {q.ACCTBAL_BAND} END AS acctbal
 FROM c, (VALUES (1.0e0), (2.0e0)) v(p), (VALUES (1), (2)) w(i)"""


def grid_releases(spark, sf):
    """Raw and banded releases of the customers, each twice."""
    df = fx.customer_qi(spark, sf)
    grid = tables.attach_grid(df, param=[1.0, 2.0], iteration=[1, 2])
    acct = F.when(F.col("param") == 1.0, cells.cell_text(F.col("acctbal"), fx.ACCTBAL)).otherwise(
        cells.band(F.col("acctbal"), fx.ACCTBAL, 1))
    return grid.select(F.lit("flat").alias("model"), "param", "iteration", "rid", "segment", "nation", acct.alias("acctbal"))


@query("a5_write_release", RELEASES_SQL)
def a5(spark, sf):
    root = f"{shared_dir(spark)}/releases-a5-{sf.rstrip('/').rsplit('/', 1)[-1]}"
    tables.write_release(grid_releases(spark, sf), root)
    return tables.read_releases(spark, root)


@query("a7_read_releases", f"""SELECT model, param, iteration, nation, acctbal, count(*) AS n FROM ({RELEASES_SQL}) GROUP BY ALL""")
def a7(spark, sf):
    root = f"{shared_dir(spark)}/releases-a7-{sf.rstrip('/').rsplit('/', 1)[-1]}"
    tables.write_release(grid_releases(spark, sf), root)
    return tables.read_releases(spark, root).groupBy("model", "param", "iteration", "nation", "acctbal").agg(
        F.count(F.lit(1)).alias("n"))


@query("a8_param_grid", """SELECT event_type, eps, k, iteration, count(*) AS n, max(value) AS top FROM events,
 (VALUES (0.5e0), (1.0e0), (2.0e0)) e(eps), (VALUES (5), (50)) k(k), range(1, 4) i(iteration) GROUP BY ALL""")
def a8(spark, sf):
    counts = fx.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return tables.attach_grid(counts, eps=[0.5, 1.0, 2.0], k=[5, 50], iteration=[1, 2, 3])


@query("a9_suppress_all", "SELECT c_custkey AS rid, '*' AS segment, '*' AS nation, '*' AS acctbal FROM customer")
def a9(spark, sf):
    return classes.suppress_all(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf))


# ---- taxonomies


@query("b1_ancestors", q.with_(q.SHARED_T) + """SELECT leaf, array_to_string(list_sort(list(DISTINCT node)), ',') AS ancestors
 FROM sh_c GROUP BY leaf""")
def b1(spark, sf):
    return tx.ancestors(fx.taxonomy(spark, sf, "shared")).select("leaf", F.array_join("ancestors", ",").alias("ancestors"))


@query("b2_leaf_domain", q.with_(q.RAGGED_T) + "SELECT leaf, leaf_ord FROM rg_dom")
def b2(spark, sf):
    return tx.leaf_domain(fx.taxonomy(spark, sf, "ragged"))


@query("b3_node_width", q.with_(q.SUPPLIER_T) + "SELECT node, n_leaves FROM su_w")
def b3(spark, sf):
    return tx.node_width(fx.taxonomy(spark, sf, "supplier"))


@query("b4_node_level", q.with_(q.RAGGED_T) + "SELECT node, level FROM rg_n")
def b4(spark, sf):
    return tx.node_level(fx.taxonomy(spark, sf, "ragged"))


@query("b5_generalise", q.with_(q.NATION_T, q.CUSTOMER_QI) + f"""SELECT rid, segment, node AS nation, {q.ACCTBAL_BAND} AS acctbal
 FROM c JOIN nt_c ON leaf = nation AND level = 1""")
def b5(spark, sf):
    return classes.generalise_all(fx.customer_qi(spark, sf), fx.customer_qis(spark, sf), [0, 1, 1])


@query("b5_generalise_integer", q.with_(q.PART_QI) + f"SELECT rid, {q.SIZE_BAND} AS size FROM p")
def b5_int(spark, sf):
    return classes.generalise(fx.part_qi(spark, sf), fx.SIZE, 1).select("rid", "size")


@query("b6_covers", q.with_(q.SHARED_T) + """, x AS (SELECT n_name, b.r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 JOIN region b ON c_custkey % 5 = b.r_regionkey)
 SELECT n_name AS value, r_name AS node, list_contains(anc, r_name) AS covered, count(*) AS n
 FROM x JOIN sh_n ON node = n_name GROUP BY ALL""")
def b6(spark, sf):
    c = fx.table(spark, sf, "customer").join(
        F.broadcast(fx.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.broadcast(fx.table(spark, sf, "region"))
    pairs = c.join(r, F.col("c_custkey") % 5 == F.col("r_regionkey")).groupBy(
        F.col("n_name").alias("value"), F.col("r_name").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return tx.covers(pairs, "value", "node", fx.taxonomy(spark, sf, "shared"))


@query("b6_in_range", q.with_(q.PART_QI) + f"""SELECT rid, size BETWEEN 11 AND 30 AS inside,
 {q.SIZE_BAND} IN ('11_20', '21_30') AS band_inside, true AS all_inside FROM p""")
def b6_range(spark, sf):
    size = F.col("size").cast("double")
    own = cells.band(size, fx.SIZE, 1)
    price = F.col("retailprice")
    return fx.part_qi(spark, sf).select(
        "rid", cells.contains_number(size, F.lit("11_30")).alias("inside"),
        cells.contains_range(own, F.lit("11_30")).alias("band_inside"),
        (cells.contains_number(size, own) & cells.contains_number(price, cells.band(price, fx.PRICE, 1))).alias("all_inside"))


@query("b7_lcs", q.with_(q.SHARED_T) + """SELECT a.node AS node_a, b.node AS node_b, max(x.depth) - 1 AS lcs_height
 FROM sh_n a, sh_n b, sh_n x WHERE a.is_leaf = 1 AND b.is_leaf = 1 AND list_contains(a.anc, x.node)
 AND list_contains(b.anc, x.node) GROUP BY a.node, b.node""")
def b7(spark, sf):
    return tx.lcs(fx.taxonomy(spark, sf, "shared")).select("node_a", "node_b", "lcs_height")


PAIRS = """, x AS (SELECT a.n_name AS a, b.n_name AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON o_orderkey % 25 = b.n_nationkey GROUP BY ALL)"""


def _nation_pairs(spark, sf):
    nation = fx.table(spark, sf, "nation")
    side = lambda c: F.broadcast(nation.select(F.col("n_nationkey").alias(f"k_{c}"), F.col("n_name").alias(c)))
    o = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        o.join(side("a"), F.col("c_nationkey") == F.col("k_a"))
        .join(side("b"), F.col("o_orderkey") % 25 == F.col("k_b"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))


@query("b8_semantic_distance", q.with_(q.SHARED_T) + PAIRS + """
 SELECT x.a, x.b, n, round(d, 6) AS distance FROM x JOIN sh_d USING (a, b)""")
def b8(spark, sf):
    return r6(tx.semantic_distance(_nation_pairs(spark, sf), "a", "b", fx.taxonomy(spark, sf, "shared")), "distance")


@query("b9_similarity_distance", q.with_(q.SHARED_T) + PAIRS + """
 SELECT x.a, x.b, n, round(d, 6) AS distance FROM x JOIN sh_s USING (a, b)""")
def b9(spark, sf):
    return r6(tx.similarity_distance(_nation_pairs(spark, sf), "a", "b", fx.taxonomy(spark, sf, "shared")), "distance")


@query("b10_distance_matrix", q.with_(q.NATION_T) + """SELECT a AS node_a, b AS node_b, round(d, 6) AS distance
 FROM nt_d JOIN nt_dom x ON a = x.leaf JOIN nt_dom y ON b = y.leaf""")
def b10(spark, sf):
    return r6(tx.distance_matrix(fx.taxonomy(spark, sf, "nation")), "distance")


@query("b10_distance_matrix_all", q.with_(q.SHARED_T) + "SELECT a AS node_a, b AS node_b, round(d, 6) AS distance FROM sh_d")
def b10_all(spark, sf):
    return r6(tx.distance_matrix(fx.taxonomy(spark, sf, "shared"), "all"), "distance")


# ---- distances, scaling, rounding


@query("c1_numeric_distance", f"""SELECT p_partkey AS rid, round(CASE p_partkey % 4
 WHEN 0 THEN p_size - 25 WHEN 1 THEN 9 WHEN 2 THEN 9 ELSE
 greatest(least(floor((p_size - 1) / 10), 4) * 10 + 10, 30) - least(least(floor((p_size - 1) / 10), 4) * 10 + 1, 21) END, 6) AS distance
 FROM part""")
def c1(spark, sf):
    size, kind = F.col("size").cast("double"), F.col("rid") % 4
    text, own = cells.number_text(size, 0), cells.band(size, fx.SIZE, 1)
    a = F.when(kind < 2, text).otherwise(own)
    b = F.when(kind % 2 == 0, F.lit("25")).otherwise(F.lit("21_30"))
    return fx.part_qi(spark, sf).select("rid", F.round(distance.numeric_distance(a, b), 6).alias("distance"))


@query("c2_cell_distance", q.with_(q.NATION_T, q.CUSTOMER_QI) + """SELECT rid,
 CASE WHEN rid % 7 = 0 THEN 1 ELSE round(d, 6) END AS nation_distance,
 CASE WHEN rid % 11 = 0 THEN 1 ELSE round(acctbal - 500, 6) END AS acctbal_distance
 FROM c JOIN nt_d ON a = nation AND b = 'NATION_7'""")
def c2(spark, sf):
    df = fx.customer_qi(spark, sf).withColumn("other", F.lit("NATION_7"))
    df = tx.semantic_distance(df, "nation", "other", fx.taxonomy(spark, sf, "nation"))
    released = F.when(F.col("rid") % 7 == 0, STAR).otherwise(F.col("other"))
    number = F.when(F.col("rid") % 11 == 0, STAR).otherwise("500.00")
    raw = cells.cell_text(F.col("acctbal"), fx.ACCTBAL)
    return df.select(
        "rid", F.round(distance.cell_distance(F.col("nation"), released, F.col("distance")), 6).alias("nation_distance"),
        F.round(distance.cell_distance(raw, number, distance.numeric_distance(raw, number)), 6).alias("acctbal_distance"))


RECORD_SQL = q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + """SELECT rid, round(sqrt(
 (CASE WHEN rid % 7 = 0 THEN 1 ELSE power(nt_d.d / nt_b.distance, 2) END)
 + power(st_d.d / st_b.distance, 2) + power((acctbal - 500) / 11000, 2)), 6) AS distance
 FROM c JOIN nt_d ON nt_d.a = nation AND nt_d.b = 'NATION_7' JOIN st_d ON st_d.a = segment AND st_d.b = 'MACHINERY', nt_b, st_b"""


@query("c3_record_distance", RECORD_SQL)
def c3(spark, sf):
    seg, nat, acct = fx.customer_qis(spark, sf)
    df = fx.customer_qi(spark, sf).withColumn("n2", F.lit("NATION_7")).withColumn("s2", F.lit("MACHINERY"))
    df = tx.semantic_distance(df, "nation", "n2", nat.tax, "nd")
    df = tx.semantic_distance(df, "segment", "s2", seg.tax, "sd")
    released = F.when(F.col("rid") % 7 == 0, STAR).otherwise(F.col("n2"))
    raw = cells.cell_text(F.col("acctbal"), acct)
    number = F.lit("500.00")
    d = distance.record_distance([
        (F.col("nation"), released, F.col("nd"), nat.span),
        (F.col("segment"), F.col("s2"), F.col("sd"), seg.span),
        (raw, number, distance.numeric_distance(raw, number), acct.span)])
    return df.select("rid", F.round(d, 6).alias("distance"))


@query("c4_normalise", """SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS scaled FROM events
 JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)""")
def c4(spark, sf):
    ev = fx.table(spark, sf, "events")
    ends = ev.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ev.join(ends, "event_type").select(
        "event_id", F.round(cells.normalise(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


@query("c5_round_clamp", """SELECT p_partkey AS rid,
 least(greatest(round_even(p_size / 2e0, 0) + round_even((p_partkey % 9 - 4) / 2e0, 0), 1), 50) AS size,
 least(greatest(round_even(p_retailprice + (p_partkey % 9 - 4) / 4e0, 1), 900), 1000) AS price FROM part""")
def c5(spark, sf):
    shift = F.col("rid") % 9 - 4
    return fx.part_qi(spark, sf).select(
        "rid", cells.round_clamp(F.col("size") / 2, shift / 2, fx.SIZE).alias("size"),
        cells.round_clamp(F.col("retailprice"), shift / 4, fx.PRICE).alias("price"))


# ---- statistics on categories


@query("d1_marginality_domain", q.with_(q.NATION_T) + "SELECT value, leaf_ord, round(m, 6) AS marginality FROM nt_m")
def d1(spark, sf):
    return r6(mg.marginality_domain(fx.taxonomy(spark, sf, "nation")), "marginality")


@query("d1_marginality_domain_supplier", q.with_(q.SUPPLIER_T) + "SELECT value, leaf_ord, round(m, 6) AS marginality FROM su_m")
def d1_supplier(spark, sf):
    return r6(mg.marginality_domain(fx.taxonomy(spark, sf, "supplier")), "marginality")


@query("d2_marginality_sample", q.with_(q.SHARED_T, q.CUSTOMER_QI) + """, k AS (SELECT segment, nation, count(*) AS n FROM c GROUP BY ALL)
 SELECT x.segment, x.nation AS value, leaf_ord, round(sum(y.n * d), 6) AS marginality
 FROM k x JOIN k y USING (segment) JOIN sh_d ON a = x.nation AND b = y.nation JOIN sh_n ON node = x.nation GROUP BY ALL""")
def d2(spark, sf):
    return r6(mg.marginality_sample(
        fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "shared"), ["segment"]), "marginality")


def _sim_sql(target):
    return q.with_(q.SHARED_T, q.CUSTOMER_QI) + f"""SELECT node AS value, leaf_ord, round(sum(n * d), 6) AS marginality
 FROM sh_n JOIN sh_s ON a = node JOIN (SELECT nation, count(*) AS n FROM c GROUP BY 1) k ON b = nation
 WHERE {target} GROUP BY ALL"""


@query("d3_marginality_similarity", _sim_sql("is_leaf = 1"))
def d3(spark, sf):
    return r6(mg.marginality_sample(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "shared"),
                                    dist="similarity", targets="leaves"), "marginality")


@query("d3_marginality_similarity_all", _sim_sql("true"))
def d3_all(spark, sf):
    return r6(mg.marginality_sample(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "shared"),
                                    dist="similarity", targets="nodes"), "marginality")


@query("d4_boundary", q.with_(q.NATION_T) + "SELECT bottom, top, round(distance, 6) AS distance FROM nt_b")
def d4(spark, sf):
    return r6(mg.boundary(fx.taxonomy(spark, sf, "nation")), "distance")


@query("d4_boundary_supplier", q.with_(q.SUPPLIER_T) + "SELECT bottom, top, round(distance, 6) AS distance FROM su_b")
def d4_supplier(spark, sf):
    return r6(mg.boundary(fx.taxonomy(spark, sf, "supplier")), "distance")


SAMPLE_MARG = """, k AS (SELECT nation, count(*) AS n FROM c GROUP BY 1),
 lm AS (SELECT node AS value, leaf_ord, sum(n * d) AS m FROM nt_n JOIN nt_d ON a = node JOIN k ON b = nation
  WHERE is_leaf = 1 GROUP BY ALL),
 mean AS (SELECT value AS mean FROM lm ORDER BY round(m, 9), leaf_ord LIMIT 1),
 b1 AS (SELECT value AS bound1 FROM lm, mean, nt_d WHERE a = value AND b = mean ORDER BY round(d, 9) DESC, leaf_ord LIMIT 1),
 b2 AS (SELECT value AS bound2 FROM lm, b1, nt_d WHERE a = value AND b = bound1 ORDER BY round(d, 9) DESC, leaf_ord LIMIT 1)"""


@query("d5_boundary_from_mean", q.with_(q.NATION_T, q.CUSTOMER_QI) + SAMPLE_MARG + " SELECT mean, bound1, bound2 FROM mean, b1, b2")
def d5(spark, sf):
    return mg.boundary_from_mean(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"))


MEAN_SQL = q.with_(q.NATION_T, q.CUSTOMER_QI) + """, k AS (SELECT segment, nation, count(*) AS n FROM c GROUP BY ALL),
 m AS (SELECT x.segment, x.nation, leaf_ord, sum(y.n * d) AS m FROM k x JOIN k y USING (segment)
  JOIN {d} ON a = x.nation AND b = y.nation JOIN nt_n ON node = x.nation GROUP BY ALL)
 SELECT segment, arg_min(nation, round(m, 9) * 1000 + leaf_ord / 1000e0) AS mean FROM m GROUP BY segment"""


@query("d6_categorical_mean", MEAN_SQL.replace("{d}", "nt_d"))
def d6(spark, sf):
    return mg.categorical_mean(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), ["segment"])


@query("d6_categorical_mean_similarity", MEAN_SQL.replace("{d}", "nt_s"))
def d6_sim(spark, sf):
    return mg.categorical_mean(
        fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation"), ["segment"], dist="similarity")


@query("d7_marginality_variance", q.with_(q.NATION_T, q.CUSTOMER_QI) + SAMPLE_MARG + """
 SELECT round(sum(n * m) / sum(n), 6) AS variance FROM lm JOIN k ON nation = value""")
def d7(spark, sf):
    return r6(mg.marginality_variance(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation")), "variance")


SIM_MEAN = """, k AS (SELECT nation, count(*) AS n FROM c GROUP BY 1),
 lm AS (SELECT node AS value, leaf_ord, is_leaf, depth, sum(n * d) AS m FROM nt_n JOIN nt_s ON a = node JOIN k ON b = nation GROUP BY ALL),
 mean AS (SELECT value AS mean FROM lm WHERE {where} ORDER BY round(m, 9), leaf_ord LIMIT 1),
 var AS (SELECT sum(n * d * d) / sum(n) AS variance FROM k, mean, nt_s WHERE a = nation AND b = mean)"""


@query("d8_distance_variance", q.with_(q.NATION_T, q.CUSTOMER_QI) + SIM_MEAN.replace("{where}", "is_leaf = 1")
       + " SELECT round(variance, 6) AS variance FROM var")
def d8(spark, sf):
    return r6(mg.distance_variance(fx.customer_qi(spark, sf), "nation", fx.taxonomy(spark, sf, "nation")), "variance")


@query("d9_variance_distance", q.with_(q.NATION_T, q.SEGMENT_T, q.CUSTOMER_QI) + """,
 kn AS (SELECT nation v, count(*) n FROM c GROUP BY 1), ks AS (SELECT segment v, count(*) n FROM c GROUP BY 1),
 mn AS (SELECT x.v, any_value(x.n) n, sum(y.n * d) m FROM kn x, kn y, nt_d WHERE a = x.v AND b = y.v GROUP BY x.v),
 ms AS (SELECT x.v, any_value(x.n) n, sum(y.n * d) m FROM ks x, ks y, st_d WHERE a = x.v AND b = y.v GROUP BY x.v),
 tn AS (SELECT sum(n * m) / sum(n) t FROM mn), ts AS (SELECT sum(n * m) / sum(n) t FROM ms)
 SELECT c.rid, round(((n1.m + n2.m) / 2 / tn.t + (s1.m + s2.m) / 2 / ts.t) / 2, 6) AS distance
 FROM c JOIN c c2 ON c2.rid = c.rid // 2 JOIN mn n1 ON n1.v = c.nation JOIN mn n2 ON n2.v = c2.nation
 JOIN ms s1 ON s1.v = c.segment JOIN ms s2 ON s2.v = c2.segment, tn, ts""")
def d9(spark, sf):
    df = fx.customer_qi(spark, sf)
    other = df.select(F.col("rid").alias("half"), F.col("nation").alias("nation_b"), F.col("segment").alias("segment_b"))
    pairs = df.select("rid", F.floor(F.col("rid") / 2).alias("half"), F.col("nation").alias("nation_a"),
                      F.col("segment").alias("segment_a")).join(other, "half")
    taxes = {a: fx.taxonomy(spark, sf, a) for a in ("nation", "segment")}
    return r6(mg.variance_distance(pairs, df, taxes, "rid"), "distance")
