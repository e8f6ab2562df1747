import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import classes, linkage, metrics, ranks
from veilspark.operators.taxonomy import Taxonomy
from veilspark.plans import evaluation as ev, sweeps
from veilspark.sources import tables
from veilspark.sources.hierarchy import lines_from_list
from veilspark.spec import QI

X = QI("x", "number", 0.0, 1000.0, 0, widths=(100.0,))
Y = QI("y", "number", 0.0, 1000.0, 0, widths=(100.0,))
ALL = ["granularity", "intensity", "discernibility", "entropy", "groupsize", "sse"]


@pytest.fixture(scope="module")
def color(spark):
    lines = [f"c{i};g{i % 2};*" for i in range(6)]
    return QI("color", "category", tax=Taxonomy.from_lines(lines_from_list(spark, lines), "color"))


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(5)
    rows = [(i, 500, 500, "c1") if i % 3 == 0 else (i, rng.randint(0, 1000), rng.randint(0, 1000), f"c{rng.randint(0, 5)}")
            for i in range(150)]
    return spark.createDataFrame(rows, "rid long, x long, y long, color string")


def test_sse_ends(raw, color):
    qis = [X, Y, color]
    same = metrics.sse(raw, classes.release_cells(raw, qis, ["rid"]), qis).first()["sse"]
    gone = metrics.sse(raw, classes.suppress_all(raw, qis), qis).first()["sse"]
    assert same == 0 and gone == 150 * 3


def test_normalised_ends(spark, raw, color):
    qis = [X, Y, color]
    cells = classes.release_cells(raw, qis, ["rid"])
    tag = lambda df, m: df.select(F.lit(m).alias("model"), F.lit(1.0).alias("param"), F.lit(1).alias("iteration"), "*")
    both = tag(cells, "raw").unionByName(tag(classes.suppress_all(cells, qis), "gone"))
    scores = ev.score_releases(both, raw, qis, ALL, 5)
    norm = ev.normalise_scores(scores, ev.reference_scores(raw, qis, ALL, [5]))
    got = {(r["model"], r["metric"]): r["score"] for r in norm.collect()}
    assert len(got) == 12
    for (model, _), score in got.items():
        assert score == pytest.approx(0 if model == "raw" else 1, abs=1e-9)


def test_unknown_metric(raw, color):
    with pytest.raises(ValueError):
        metrics.compute_metric("other", raw, [X])
    with pytest.raises(ValueError):
        metrics.compute_metrics(["sse", "other"], raw, [X])


def vectors(rows):
    """Largest rank of each value per column."""
    cols = list(zip(*rows))
    return [tuple(sum(w <= v for w in cols[j]) for j, v in enumerate(r)) for r in rows]


@pytest.mark.parametrize("cell_rows", [4096, 4])
def test_closest_records_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(linkage, "CELL_ROWS", cell_rows)
    rng = random.Random(9)
    orig = [(5, 5) if i % 3 == 0 else (rng.randint(0, 60), rng.randint(0, 60)) for i in range(90)]
    mapped = orig[:]
    rng.shuffle(mapped)
    mapped = [(a[0], b[1]) for a, b in zip(mapped, orig)]
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, x long, y long")
    rank = {}
    for j in range(2):
        col = [r[j] for r in orig]
        for v in col:
            rank[j, v] = sum(w <= v for w in col)
    vec = lambda r: tuple(rank[j, v] for j, v in enumerate(r))
    want = {}
    for i, r in enumerate(orig):
        ds = [max(abs(a - b) for a, b in zip(vec(r), vec(z))) for z in mapped]
        want[i] = (min(ds), ds.count(min(ds)))
    got = {r["rid"]: (r["distance"], r["n_closest"]) for r in
           linkage.closest_records(frame(orig), frame(mapped), [X, Y]).collect()}
    assert got == want


@pytest.mark.parametrize("pairs, stretch", [(linkage.LINE_PAIRS, linkage.STRETCH), (linkage.LINE_PAIRS, 7), (-1, 7)])
def test_closest_records_build_no_pairs(spark, monkeypatch, pairs, stretch):
    """Closest records are found along lines, on the own one and on others; the grid finds the same."""
    monkeypatch.setattr(linkage, "LINE_PAIRS", pairs)
    monkeypatch.setattr(linkage, "STRETCH", stretch)
    monkeypatch.setattr(linkage, "FIRST_LINES", 1)
    if pairs > 0:
        monkeypatch.setattr(linkage, "_neighbours", lambda *a: pytest.fail("pairs of records"))
    rng = random.Random(11)
    orig = [(rng.randint(0, 90), rng.choice([1, 2, 3, 5, 7]), rng.choice([1, 4])) for _ in range(70)] + [(40, 2, 4)] * 12
    orig += [(None, 1, 1)]
    column = lambda j: [r[j] for r in orig if r[j] is not None]
    pick = lambda *ks: tuple(rng.choice(column(j)) if k is None else k for j, k in enumerate(ks))
    releases = {
        "mixed": [pick(None, None, None) for _ in orig],
        "few": [pick(None, 7, None) if i % 9 else (None, 3, 1) for i in range(len(orig))],  # own lines are empty
        "heap": [(orig[0][0], 1, 1)] * 30 + [pick(None, 3, 4)] * 5,
    }
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(orig)], "rid long, x long, y long, v long")
    mapped = spark.createDataFrame([(name, i, *r) for name, rs in releases.items() for i, r in enumerate(rs)],
                                   "model string, rid long, x long, y long, v long")
    last = [{v: sum(w <= v for w in column(j)) for v in column(j)} for j in range(3)]
    # an unknown number comes before all known ones
    last[0] = {v: n + 1 for v, n in last[0].items()}
    vec = lambda r: None if None in r else [last[j][v] for j, v in enumerate(r)]
    want, pairs_ = {}, set()
    for name, rs in releases.items():
        for i, r in enumerate(orig):
            ds = {k: max(abs(a - b) for a, b in zip(vec(r), vec(z))) for k, z in enumerate(rs) if vec(r) and vec(z)}
            if ds:
                near = min(ds.values())
                want[name, i] = (near, list(ds.values()).count(near))
                pairs_ |= {(name, i, near, k) for k, d in ds.items() if d == near}
    qis = [X, Y, QI("v", "number", 0.0, 10.0, 0, widths=(5.0,))]
    got = linkage.closest_records(raw, mapped, qis, ["model"]).collect()
    assert {(r["model"], r["rid"]): (r["distance"], r["n_closest"]) for r in got} == want and len(got) == len(want)
    got = linkage.closest_records(raw, mapped, qis, ["model"], expand=True).collect()
    assert {(r["model"], r["rid"], r["distance"], r["match_rid"]) for r in got} == pairs_ and len(got) == len(pairs_)


@pytest.mark.parametrize("expand", [False, True])
def test_closest_records_of_a_release_rank_the_originals_once(spark, raw, color, monkeypatch, expand):
    for qis in ([X, color], [X]):
        anon = classes.release_cells(raw, qis, ["rid"]).withColumn("x", ((F.col("x").cast("int") * 7 + 13) % 1000).cast("string"))
        want = linkage.closest_records(raw, ranks.reverse_map(raw, anon, qis), qis, expand=expand)
        asked, value_ranks = [], ranks.value_ranks
        with monkeypatch.context() as patch:
            for module in (linkage, ranks):
                patch.setattr(module, "value_ranks", lambda df, *a, **k: asked.append(df) or value_ranks(df, *a, **k))
            got = linkage.closest_released(raw, anon, qis, expand=expand)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
        assert sum(df is raw for df in asked) == 1


def test_linkage_of_raw_is_share_of_unique_vectors(spark, raw, color):
    qis = [X, Y, color]
    rows = [tuple(r)[1:] for r in raw.collect()]
    unique = sum(rows.count(r) == 1 for r in rows)
    got = linkage.record_linkage(raw, raw, qis).first()["record_linkage"]
    # equal ranks, not equal values, decide; colours of equal marginality differ in rank
    assert got == pytest.approx(unique / len(rows))


@pytest.mark.parametrize("lines", [linkage.LINES, 0])
def test_far_searches_build_no_pairs(spark, monkeypatch, lines):
    """Released records far from the originals are counted along lines; the grid finds the same."""
    monkeypatch.setattr(linkage, "LINES", lines)
    if lines:
        monkeypatch.setattr(linkage, "_neighbours", lambda *a: pytest.fail("pairs of records"))
    rng = random.Random(4)
    orig = [(rng.randint(0, 400), 10 * (i % 4)) for i in range(120)]
    released = {"same": orig, "far": [(a, 30 - b) for a, b in orig], "flat": [(a, 10) for a, _ in orig],
                "turned": [(400 - a, b) for a, b in orig]}
    rows = [(name, i, *map(str, r)) for name, rs in released.items() for i, r in enumerate(rs)]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(orig)], "rid long, x long, y long")
    anon = spark.createDataFrame(rows, "model string, rid long, x string, y string")
    got = {r["model"]: r["linked"] for r in linkage.linked_records(raw, anon, [X, Y], ["model"]).collect()}

    def places(rs, j):  # position in the column, ties by record
        order = sorted(range(len(rs)), key=lambda i: (rs[i][j], i))
        return {i: p for p, i in enumerate(order)}

    last = [{v: sum(r[j] <= v for r in orig) for v in {r[j] for r in orig}} for j in range(2)]
    want = {}
    for name, rs in released.items():
        z = [[last[j][sorted(r[j] for r in orig)[places(rs, j)[i]]] for j in range(2)] for i in range(len(rs))]
        d = lambda i, k: max(abs(last[j][orig[i][j]] - z[k][j]) for j in range(2))
        want[name] = sum(sum(d(i, k) <= d(i, i) for k in range(len(rs))) == 1 for i in range(len(rs)))
    assert got == want and want["same"] > 0


def test_linkage_of_several_releases_at_once(spark, raw, color):
    qis = [X, Y, color]
    cells = classes.release_cells(raw, qis, ["rid"])
    shifted = cells.withColumn("x", ((F.col("x").cast("int") * 7 + 13) % 1000).cast("string"))
    gone = classes.suppress_all(cells, qis)
    each = {"a": cells, "b": shifted, "c": gone}
    both = None
    for name, df in each.items():
        part = df.withColumn("model", F.lit(name))
        both = part if both is None else both.unionByName(part)
    got = {r["model"]: r["record_linkage"] for r in linkage.record_linkage(raw, both, qis, ["model"]).collect()}
    for name, df in each.items():
        assert got[name] == pytest.approx(linkage.record_linkage(raw, df, qis).first()["record_linkage"])


def test_a_sweep_reads_its_table_in_many_splits(spark, raw, color):
    table = sweeps._read_often(raw.coalesce(1), [X, Y, color])
    assert len(table.inputFiles()) > 1
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, raw.select("rid", "x", "y", "color").collect()))


def test_hot_values_are_joined_apart(spark, raw, color, monkeypatch):
    want = sorted(map(tuple, ranks.row_ranks(raw, [X, color]).collect()))
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, ranks.row_ranks(raw, [X, color]).collect())) == want


def test_values_are_looked_up_by_attribute(spark, raw, color, monkeypatch):
    """Hot, cold, unknown and missing values get the same ranks by broadcast and by shuffle; cells are never laid out."""
    odd = raw.withColumn("x", F.when(F.col("rid") % 7 != 0, F.col("x") + F.col("rid") % 2 * 2_000))
    qis, values = [X, color], ranks.materialise(ranks.value_ranks(raw, [X, color]))
    ask = lambda: [sorted(map(str, df.collect())) for df in (
        ranks.value_cells(raw, qis, values, [], ["p", "q"]), ranks.value_cells(odd, qis, values, [], ["p", "q"]),
        ranks.reverse_map(raw, odd, qis))]
    want = ask()
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(ranks, "HOT_SHARE", 10)
    monkeypatch.setattr(ranks, "_join_values", lambda *a: pytest.fail("cells laid out before the lookup"))
    assert ask() == want


def test_bumped_ranks(spark, color):
    """Equal counts tie all marginalities of a branch; later values move up by whole ones."""
    from veilspark.operators.taxonomy import distance_matrix

    values = [f"c{i}" for i in range(6) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(values)), "rid long, color string")
    d = {(r["node_a"], r["node_b"]): r["distance"] for r in distance_matrix(color.tax).collect()}
    taken, keys = set(), {}
    for v in sorted(set(values)):
        m = round(sum(d[v, w] for w in values), 9)
        while round(m, 9) in taken:
            m += 1
        taken.add(round(m, 9))
        keys[v] = m
    order = sorted(keys, key=keys.get)
    got = {r["value"]: r["first_rank"] for r in ranks.categorical_ranks(df, color, ties="bump").collect()}
    assert got == {v: 4 * i + 1 for i, v in enumerate(order)}


def test_read_table_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n2,x\n1,y\n1,x\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b string")
    assert sorted(map(tuple, df.collect())) == [(1, 1, "x"), (2, 1, "y"), (3, 2, "x")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.csv"))


def test_release_is_replaced_not_duplicated(spark, tmp_path):
    root = str(tmp_path / "rel")
    make = lambda p, v: spark.createDataFrame([("m", p, 1, v)], "model string, param double, iteration int, x string")
    tables.write_release(make(1.0, "a"), root)
    tables.write_release(make(2.0, "b"), root)
    tables.write_release(make(1.0, "c"), root)
    got = sorted((r["param"], r["x"]) for r in tables.read_releases(spark, root).collect())
    assert got == [(1.0, "c"), (2.0, "b")]


def test_named_releases(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"granularity_eps-0.5_{i}.csv").write_text(f"x,y\n{i},*\n")
    got = sorted(map(tuple, tables.read_named_releases(spark, str(tmp_path), "x string, y string").collect()))
    assert got == [("granularity", 0.5, 1, "1", "*"), ("granularity", 0.5, 2, "2", "*")]


def test_bad_declarations(color):
    with pytest.raises(ValueError):
        QI("a", "number")
    with pytest.raises(ValueError):
        QI("a", "category")
    with pytest.raises(ValueError):
        QI("a", "date")
