import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.functions.cells import round_clamp
from veilspark.functions.noise import gumbel, laplace, uniform
from veilspark.operators import classes, lattice, metrics, microaggregation, release, semantic_noise as sn
from veilspark.operators.safepub import class_size_for, safepub
from veilspark.operators.taxonomy import Taxonomy
from veilspark.runtime import materialise
from veilspark.sources.hierarchy import lines_from_list
from veilspark.sources.tables import fingerprint
from veilspark.spec import QI

# Class size required for (eps, delta)
GOLDEN = [
    (2.0, 1e-5, 103), (1.5, 1e-5, 72), (1.25, 1e-5, 67), (math.log(3), 1e-5, 61), (1.0, 1e-5, 59),
    (0.75, 1e-5, 54), (math.log(2), 1e-5, 53), (0.5, 1e-5, 50), (0.1, 1e-5, 50), (0.01, 1e-5, 50),
    (1.0, 1e-4, 45), (2.0, 1e-4, 74), (1.0, 1e-6, 74), (1.0, 1e-7, 88), (1.0, 1e-8, 100), (1.0, 1e-9, 114),
    (1.0, 1e-10, 129), (1.0, 1e-11, 141), (1.0, 1e-12, 155), (1.0, 1e-13, 170), (1.0, 1e-14, 184),
    (1.0, 1e-15, 199), (1.0, 1e-16, 211), (1.0, 1e-17, 225), (1.0, 1e-18, 240), (1.0, 1e-19, 252), (1.0, 1e-20, 266),
]
AGE = QI("age", "number", 1.0, 40.0, 0, integer=True, widths=(10.0, 20.0))


@pytest.fixture(scope="module")
def city(spark):
    lines = [f"c{i};g{i % 3};*" for i in range(9)]
    return QI("city", "category", tax=Taxonomy.from_lines(lines_from_list(spark, lines), "city"))


@pytest.fixture(scope="module")
def people(spark):
    # a third of all rows is the same person
    return spark.range(600).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit("c0")).otherwise(F.concat(F.lit("c"), (F.col("id") * 7 % 9).cast("string"))).alias("city"),
        F.when(F.col("id") % 3 == 0, F.lit(20)).otherwise(F.col("id") * 13 % 40 + 1).alias("age"))


@pytest.mark.parametrize("eps,delta,k", GOLDEN)
def test_class_size(eps, delta, k):
    assert class_size_for(eps, delta) == k


def test_noise_does_not_depend_on_partitioning(spark):
    draw = lambda df: sorted(map(tuple, df.select("id", uniform("s", "p", "a", F.col("id")).alias("u")).collect()))
    assert draw(spark.range(500).repartition(1)) == draw(spark.range(500).repartition(13))


def test_noise_distributions(spark):
    u = uniform("s", "p", F.col("id"))
    row = spark.range(40_000).select(laplace(u, F.lit(3.0)).alias("l"), gumbel(u).alias("g")).agg(
        F.avg("l").alias("ml"), F.avg(F.abs("l")).alias("al"), F.avg("g").alias("mg")).first()
    assert row["ml"] == pytest.approx(0, abs=0.08)
    assert row["al"] == pytest.approx(3, rel=0.03)
    assert row["mg"] == pytest.approx(0.5772, abs=0.03)


def test_exponential_mechanism_frequencies(spark, city):
    """Over many clusters of equal content the draws follow the exponential weights."""
    df = spark.range(4000).select(F.col("id").alias("cluster_id"), F.lit("c0").alias("city"))
    got = Counter(r["centroid"] for r in release.dp_categorical_centroid(df, city, 2.0, 4, 4, "s").collect())
    from veilspark.operators.taxonomy import distance_matrix
    d = {r["node_b"]: r["distance"] for r in distance_matrix(city.tax).filter("node_a = 'c0'").collect()}
    weight = {v: math.exp(-2.0 * x / (2 * city.span)) for v, x in d.items()}
    for v, w in weight.items():
        assert got[v] / 4000 == pytest.approx(w / sum(weight.values()), abs=0.03)


def check_anonymous(df, qis, k):
    bad = classes.equivalence_classes(df, qis).filter((F.col("class_size") < k) & ~classes.all_suppressed(qis))
    assert bad.count() == 0


def test_k_anonymity_and_hot_classes(spark, people, city, monkeypatch):
    qis = [city, AGE]
    plain = classes.k_anonymise(people, qis, [1, 1], 8)
    check_anonymous(plain, qis, 8)
    assert plain.count() == 600
    want = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(classes, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, classes.k_anonymise(people, qis, [1, 1], 8).collect())) == want


def test_null_is_a_class(spark, city):
    df = spark.createDataFrame([(i, None if i < 5 else "c1") for i in range(9)], "rid long, city string")
    out = classes.suppress_small(df, [city], 5)
    assert Counter(r["city"] for r in out.collect()) == {None: 5, "*": 4}


def test_best_node_is_best(spark, people, city):
    qis = [city, AGE]
    levels, out = lattice.optimal_k_anonymity(people, qis, 5)
    check_anonymous(out, qis, 5)
    scores = lattice.score_lattice(lattice.frequency_set(people, qis), qis, 5, ["granularity"])
    assert scores.count() == 12
    assert lattice.Lattice(qis).node(levels) == lattice.best_node(scores).first()["node"]


def test_best_first_search_finds_a_release(spark, people, city):
    levels, out = lattice.optimal_k_anonymity(people, [city, AGE], 5, steps=12, search="best_first")
    check_anonymous(out, [city, AGE], 5)
    assert len(levels) == 2


def test_rolled_scores_are_the_direct_ones(spark, people, city):
    uneven = QI("age", "number", 1.0, 40.0, 0, integer=True, widths=(10.0, 25.0))
    freq = lattice.frequency_set(people, [city, uneven])
    one, other = (lattice.score_lattice(freq, [city, uneven], 5, rollup_rows=r).drop("levels").orderBy("node").collect()
                  for r in (10**9, 0))
    assert len(one) == len(other)
    assert all(abs(x[c] - y[c]) < 1e-9 for x, y in zip(one, other) for c in x.asDict())


def test_private_search_refuses_an_unbounded_score(spark, people, city):
    with pytest.raises(ValueError):
        lattice.dp_search(lattice.frequency_set(people, [city, AGE]), [city, AGE], 5, 0.1, 8, "a", model="groupsize")


def test_null_number_stays_null(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "v double")
    assert [r[0] for r in df.select(round_clamp(df["v"], F.lit(0.0), AGE)).collect()] == [None, 5.0]


def test_cluster_key_covers_the_hierarchy(spark, people, city):
    lines = [f"c{i};g{i % 2};*" for i in range(9)]
    other = QI("city", "category", tax=Taxonomy.from_lines(lines_from_list(spark, lines), "city"))
    assert fingerprint(people, [city], 5) != fingerprint(people, [other], 5)


def test_private_search_is_seeded(spark, people, city):
    freq = lattice.frequency_set(people, [city, AGE])
    draw = lambda seed: lattice.dp_search(freq, [city, AGE], 5, 0.1, 8, seed)
    assert draw("a") == draw("a")
    assert all(0 <= level <= q.top_level for level, q in zip(draw("b"), [city, AGE]))


def test_safepub(spark, people, city):
    out = safepub(people, [city, AGE], 1.0, 1e-4, seed="s", steps=5)
    assert out.count() == 600 and out.select("rid").distinct().count() == 600
    check_anonymous(out, [city, AGE], class_size_for(1.0, 1e-4))


def test_microdp(spark, people, city):
    qis = [city, AGE]
    out = release.microdp(people, qis, 1.0, 20, "s", "batched")
    assert out.count() == 600
    ages = [int(r["age"]) for r in out.collect()]
    assert min(ages) >= 1 and max(ages) <= 40
    again = release.microdp(people.repartition(5), qis, 1.0, 20, "s", "batched")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_budget(city):
    assert release.total_budget([city, AGE], 1.0) == (1.0, 2.0)
    assert release.total_budget([city, AGE], 1.0, "split") == (0.5, 1.0)
    with pytest.raises(ValueError):
        release.total_budget([city], 1.0, "other")


def test_sweep_draws_differ(spark, people, city):
    out = release.microdp_sweep(people, [city, AGE], [0.5, 1.0], 20, "s", 2, "ordered")
    assert out.count() == 4 * 600
    per = {}
    for r in out.collect():
        per.setdefault((r["eps"], r["iteration"]), []).append((r["rid"], r["city"], r["age"]))
    assert len({tuple(sorted(v)) for v in per.values()}) == 4
    assert {r["total_eps"] for r in out.select("total_eps").distinct().collect()} == {1.0, 2.0}


def test_semantic_noise_is_drawn_in_many_tasks(spark, people, city):
    """A compact table comes in one split; its rows are dealt out before the work on them."""
    out = sn.semantic_noise(people.coalesce(1), "city", city.tax, 1.0, "s")
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_semantic_noise(spark, people, city):
    out = sn.semantic_noise(people, "city", city.tax, 1.0, "s").select("rid", "city", "noisy")
    rows = out.collect()
    assert len(rows) == 600 and all(r["noisy"].startswith("c") for r in rows)
    still = sn.semantic_noise(people, "city", city.tax, 0.0, "s").filter("city <> noisy").count()
    assert still == 0
    with pytest.raises(ValueError):
        sn.semantic_noise(people, "city", city.tax, 1.0, "s", "other")


def test_nearest_by_marginality_both_ways(spark, people, city):
    from veilspark.operators.marginality import marginality_sample
    margins = marginality_sample(people, "city", city.tax, targets="leaves")
    targets = people.select("rid", (F.col("rid") * 1.5).alias("t"))
    a = sn.nearest_by_marginality(targets, "t", margins).select("rid", "nearest")
    b = sn.nearest_by_marginality(targets, "t", margins, rows=10**9).select("rid", "nearest")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_value_moved_to_a_null_neighbour_changes_the_key(spark):
    qis = [QI("x", "number", 0, 9), QI("y", "number", 0, 9)]
    rows = lambda *r: spark.createDataFrame([(1, *r)], "rid long, x double, y double")
    keys = {fingerprint(rows(*r), qis, 5) for r in ((4.0, None), (None, 4.0), (None, None), (4.0, 4.0))}
    assert len(keys) == 4 and fingerprint(rows(4.0, None), qis, 5) in keys


def test_private_centroids_are_drawn_in_many_tasks(spark, people, city):
    """Counts are few bytes, which the domain multiplies; they are dealt out by cluster first."""
    counted = people.withColumn("cluster_id", F.col("rid") % 40)
    out = release.dp_categorical_centroid(counted, city, 1.0, 600, 15, "s")
    assert out.count() == 40 and out.select(F.spark_partition_id()).distinct().count() > 1


def test_squared_terms_of_known_and_unknown_cells(spark, city):
    cells = ["c0", "c5", "c8", "g1", "*", "nowhere", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "rid long, city string")
    got = {r["city"]: r["terms"][0] for r in microaggregation.with_squared_terms(df, [city], {"city": ["c0", "c4"]}).collect()}
    up = {**{f"c{i}": {f"c{i}", f"g{i % 3}", "*"} for i in range(9)}, "g1": {"g1", "*"}}
    for cell, corners in got.items():
        for corner, term in zip(["c0", "c4"], corners):
            if cell in up:
                all_, both = len(up[cell] | up[corner]), len(up[cell] & up[corner])
                assert term == pytest.approx((math.log2(1 + (all_ - both) / all_) / city.span) ** 2)
            else:
                assert term == (1.0 if cell == "*" else None)


def test_tables_of_records_are_not_broadcast(spark, people, city, monkeypatch):
    """Their written files are far below the broadcast threshold, however many rows those hold."""
    qis = [city, AGE]
    joins = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    rows, clusters = materialise(people), materialise(microaggregation.microaggregate(people, qis, 20, "ordered"))
    centroids = materialise(release.centroid_table(people, clusters, qis))
    assert any("SortMergeJoin [rid" in x for x in joins(release.centroid_table(rows, clusters, [AGE])))
    applied = release.apply_centroids(clusters, centroids)
    assert any("SortMergeJoin [cluster_id" in x for x in joins(applied)) and applied.count() == 600
    anon = materialise(classes.release_cells(people, qis, ["rid"]))
    assert any("SortMergeJoin [rid" in x for x in joins(metrics.sse(rows, anon, qis)))
    # classes below k that were counted as too many to broadcast
    monkeypatch.setattr(classes, "BROADCAST_ROWS", 0)
    out = classes.suppress_small(anon.drop("rid"), qis, 30)
    assert any("SortMergeJoin" in x and "LeftOuter" in x for x in joins(out)) and out.count() == 600
