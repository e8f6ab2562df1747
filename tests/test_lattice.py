"""The exact search against scoring every node, and families of private releases against single ones."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import lattice
from veilspark.operators.lattice import SET, Lattice, Scorer
from veilspark.operators.microaggregation import microaggregate, microaggregate_each
from veilspark.operators.release import microdp, microdp_sweep
from veilspark.operators.safepub import Release, safepub, safepub_family
from veilspark.operators.taxonomy import Taxonomy
from veilspark.plans import sweeps
from veilspark.sources.hierarchy import lines_from_list
from veilspark.spec import QI, names


@pytest.fixture(scope="module")
def city(spark):
    lines = [f"c{i};g{i % 3};*" for i in range(9)]
    return QI("city", "category", tax=Taxonomy.from_lines(lines_from_list(spark, lines), "city"))


@pytest.fixture(scope="module")
def wide(spark, city):
    """Eight attributes, 6,561 nodes; bands of ``b`` and ``d`` do not nest."""
    rng = random.Random(3)
    qis = [city] + [QI(c, "number", 0.0, 40.0, 0, integer=True, widths=w) for c, w in zip(
        "abdefgh", [(10.0,), (15.0,), (7.0,), (20.0,), (5.0,), (8.0,), (4.0,)])]
    qis[2] = QI("b", "number", 0.0, 40.0, 0, integer=True, widths=(10.0, 15.0))
    qis[7] = QI("h", "number", 0.0, 40.0, 0, integer=True, widths=())
    rows = [(f"c{rng.randrange(9)}", *[None if rng.random() < 0.02 else float(int(rng.triangular(0, 40, 9))) for _ in range(7)])
            for _ in range(120)]
    rows += [("c0", *[5.0] * 7)] * 60
    return spark.createDataFrame(rows, "city string, " + ", ".join(f"{c} double" for c in "abdefgh")), qis


def best(rows, model, limit):
    return min((round(r[model], 9), r["node"]) for r in rows if r["suppressed_share"] <= limit)[1]


def test_exact_search_on_a_large_lattice(wide):
    df, qis = wide
    freq = lattice.frequency_set(df, qis)
    rows = lattice.score_lattice(freq, qis, 5, ["granularity"]).select("node", "granularity", "suppressed_share").collect()
    assert len(rows) == Lattice(qis).size > 5_000
    for limit in (1.0, 0.0):
        scorer = Scorer(freq, qis, 5)
        assert lattice.exact_node(scorer, limit) == best(rows, "granularity", limit)
        assert len(scorer.known) < 0.25 * len(rows)


@pytest.mark.parametrize("rollup", [10**9, 0])
def test_exact_search_for_every_model(wide, rollup):
    df, qis = wide
    some = [qis[0], qis[2], qis[3]]  # hierarchy, bands that do not nest, bands
    freq = lattice.frequency_set(df, some)
    rows = lattice.score_lattice(freq, some, 7, rollup_rows=rollup).collect()
    for model in lattice.MODELS:
        scorer = Scorer(freq, some, 7, model, rollup)
        for limit in (1.0, 0.1):
            assert lattice.exact_node(scorer, limit) == best(rows, model, limit)


def test_bands_that_nest():
    q = QI("x", "number", 0.0, 40.0, 0, widths=(5.0, 10.0, 15.0, 20.0))
    nests = Lattice([q]).nests
    assert nests(0, 0, 3) and nests(0, 1, 2) and nests(0, 2, 4) and nests(0, 3, 5) and nests(0, 2, 2)
    assert not nests(0, 2, 3) and not nests(0, 3, 4) and not nests(0, 3, 2)
    # 14 bands of 3 cover 0 to 40, and 7 bands of 6, the last of which takes four more
    uneven = QI("x", "number", 0.0, 40.0, 0, widths=(3.0, 6.0))
    assert Lattice([uneven]).nests(0, 1, 2)


def test_a_bound_is_below_its_box(wide):
    df, qis = wide
    some = [qis[0], qis[2], qis[4]]
    for model in lattice.MODELS:
        scorer = Scorer(lattice.frequency_set(df, some), some, 7, model)
        scorer.fetch(None)
        lat, rng = scorer.lattice, random.Random(1)
        for _ in range(200):
            ends = [sorted(rng.choices(range(r), k=2)) for r in lat.radix]
            low, high = [a for a, _ in ends], [b for _, b in ends]
            score, share = scorer.bound(low, high)
            node = lat.node([rng.randint(a, b) for a, b in ends])
            assert score <= -scorer.value(node) + 1e-9 and share <= scorer.suppressed(node)


def test_null_cells_count_as_lost_in_search_and_metrics(wide):
    from veilspark.operators.classes import k_anonymise
    from veilspark.operators.metrics import granularity

    df, qis = wide
    some = [qis[0], qis[2]]
    scores = lattice.score_lattice(lattice.frequency_set(df, some), some, 3, ["granularity"]).collect()
    for r in scores:
        if r["node"] % 3 == 1:
            mine = granularity(k_anonymise(df.select(*names(some)), some, r["levels"], 3), some, 3).first()["granularity"]
            assert abs(mine - r["granularity"]) < 1e-9


def test_empty_and_small_tables(spark, city):
    df = spark.createDataFrame([(1, "c1")], "rid long, city string")
    levels, out = lattice.optimal_k_anonymity(df, [city], 5)
    assert [r["city"] for r in out.collect()] == ["*"]
    levels, out = lattice.optimal_k_anonymity(df.limit(0), [city], 5)
    assert levels == [2] and out.collect() == []


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(900).select(
        F.col("id").alias("rid"), F.when(F.col("id") == 7, None).when(F.col("id") == 8, "nowhere").otherwise(
            F.concat(F.lit("c"), (F.col("id") * 7 % 9).cast("string"))).alias("city"),
        F.when(F.col("id") == 9, None).otherwise(F.col("id") * 13 % 40 + 1).alias("age"))


AGE = QI("age", "number", 1.0, 40.0, 0, integer=True, widths=(10.0, 20.0))


def test_a_family_holds_the_single_releases(people, city):
    qis = [city, AGE]
    family = [Release(f"r{i}", eps, 1e-4, f"s{i}", model) for i, (eps, model) in enumerate(
        [(1.0, "granularity"), (2.0, "discernibility"), (0.01, "intensity")])]
    out = safepub_family(people, qis, family, 12)
    for r in family:
        mine = out.filter(F.col(SET) == r.name).drop(SET)
        one = safepub(people, qis, r.eps, r.delta, r.model, 12, r.seed)
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
        assert mine.count() == 900
    with pytest.raises(ValueError):
        safepub(people, qis, 1.0, 1e-4, "groupsize", 12, "s")


def test_cells_at_levels_are_generalised_ones(people, city):
    from veilspark.operators.classes import generalise_all

    qis = [city, AGE]
    for levels in ([0, 0], [1, 1], [0, 2], [2, 3]):
        rows = lattice.with_paths(people, qis).withColumn("_levels", F.array(*[F.lit(x) for x in levels]))
        got = rows.select("rid", *lattice.cells_at(qis, "_levels")).collect()
        want = generalise_all(people, qis, levels).select("rid", *names(qis)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("strategy", ["ordered", "batched"])
def test_clusters_of_every_k(people, city, strategy):
    qis = [city, AGE]
    many = microaggregate_each(people, qis, [20, 45], strategy).collect()
    for k in (20, 45):
        one = microaggregate(people, qis, k, strategy).collect()
        assert sorted((r["rid"], r["cluster_id"]) for r in many if r["k"] == k) == sorted(map(tuple, one))


def test_releases_over_k_differ_in_clusters_and_draws(people, city):
    qis = [city, AGE]
    out = microdp_sweep(people, qis, [1.0], [20, 45], "s", 1, "ordered")
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {20: 900, 45: 900}
    assert out.columns == ["k", "eps", "iteration", "total_eps", "rid", "city", "age"]
    assert microdp(people, qis, 1.0, 20, "s", "ordered").columns == ["rid", "city", "age"]


def count_jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    run().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_of_a_family_do_not_grow_with_releases(spark, people, city):
    qis = [city, AGE]
    family = lambda n: [Release(f"r{i}", 1.0 + i / 10, 1e-4, f"s{i}") for i in range(n)]
    few, many = (count_jobs(spark, lambda: safepub_family(people, qis, family(n), 12)) for n in (2, 9))
    assert many <= few + 2


def test_sweeps_over_attributes_and_disclosure(people, city):
    qis = [city, AGE]
    out = sweeps.sweep_attributes(people, qis, [["city"], ["city", "age"]], 20, seed="s", steps=12, strategy="ordered").collect()
    assert {(r["model"], r["subset"], r["param"]) for r in out} == {
        (m, s, p) for m in ("MicroDP", "SafePub") for s, p in (("city", 1.0), ("city-age", 2.0))}
    assert all(r["mean"] is not None and r["std"] == 0 for r in out if r["metric"] != "groupsize")
    risk = sweeps.sweep_disclosure(people.filter("age is not null and city like 'c%'"), qis, [1.0, 2.0], 20, seed="s", steps=12, strategy="ordered").collect()
    linked = {(r["model"], r["param"]): r["score"] for r in risk if r["metric"] == "record_linkage"}
    assert set(linked) == {("MicroDP", 1.0), ("MicroDP", 2.0), ("SafePub", 1.0), ("SafePub", 2.0), ("k-anonymisation", 5.0)}
    assert all(0 <= x <= 1 for x in linked.values())
    assert all(r["score"] >= 0 for r in risk)


def test_last_plan_of_an_attribute_sweep_holds_scores_only(people, city):
    out = sweeps.sweep_attributes(people, [city, AGE], [["city"], ["age"]], 20, seed="s", metrics=["sse"], steps=12, strategy="ordered")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted((r["subset"], r["model"], r["metric"]) for r in out.collect()) == [
        (s, m, "sse") for s in ("age", "city") for m in ("MicroDP", "SafePub")]


def test_codes_and_shares_of_numbers_are_those_of_their_text(spark):
    qis = [QI("a", "number", -10.0, 30.0, 2, widths=(0.5, 7.0, 15.0)), QI("b", "number", 1.0, 50.0, 0, integer=True, widths=(10.0,))]
    rows = [(None, None), *[(x, y) for x in (-10.0, -9.51, -0.01, 0.0, 4.996, 29.99, 30.0, 44.0) for y in (1.0, 2.5, 50.0, 70.0)]]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("n", F.lit(1))
    scorer = Scorer(df, qis, 2)
    text = lattice.with_paths(df, qis)
    for j, q in enumerate(qis):
        for level in range(q.top_level + 1):
            want = text.groupBy(F.col(f"p{j}")[level]["node"]).agg(F.sum("n"), F.first(F.col(f"p{j}")[level]["share"])).collect()
            cell, share = scorer._cell(j, F.lit(level))
            mine = scorer.tables[0, 0][0].groupBy(cell).agg(F.sum("n"), F.first(share)).collect()
            assert sorted((r[1], r[2]) for r in mine) == sorted((r[1], r[2]) for r in want)


def test_coarse_nodes_are_scored_from_tables_rolled_up_along_several_attributes(spark):
    qis = [QI(c, "number", 0.0, 999.0, 0, integer=True, widths=(250.0,)) for c in "abc"]
    df = spark.range(3000).select(
        *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).cast("double").alias(c) for c in "abc"], F.lit(1).alias("n"))
    rolled, direct = Scorer(df, qis, 5, rollup_rows=100), Scorer(df, qis, 5)
    nodes = [rolled.lattice.node(x) for x in ([1, 1, 1], [2, 1, 1], [2, 2, 1], [0, 1, 1])]
    rolled.fetch({"": set(nodes)})
    direct.fetch({"": set(nodes)})
    for i in nodes:
        assert abs(rolled.value(i) - direct.value(i)) < 1e-9 and rolled.suppressed(i) == direct.suppressed(i)
    small = rolled.tables[rolled._holding((1, 1, 1))][1]
    assert small * 8 <= 3000


def test_an_aggregate_takes_few_nodes_of_a_large_set(spark, monkeypatch):
    qis = [QI(c, "number", 0.0, 999.0, 0, integer=True, widths=(250.0,)) for c in "ab"]
    df = spark.range(900).select(
        *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).cast("double").alias(c) for c in "ab"], F.lit(1).alias("n"))
    scorer, nodes = Scorer(df, qis, 5), [0, 1, 3, 4, 8]
    direct = scorer.scores(["granularity"], nodes).drop("levels").orderBy("node").collect()
    monkeypatch.setattr(lattice, "NODE_ROWS", 2000)
    plan = scorer.classes(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3
    assert scorer.scores(["granularity"], nodes).drop("levels").orderBy("node").collect() == direct
