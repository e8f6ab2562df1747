import math

import pytest
from pyspark.sql import functions as F

from veilspark.operators import marginality as mg, taxonomy as tx
from veilspark.sources.hierarchy import lines_from_list, read_hierarchy

LINES = ["a1;a;*", "a2;a;*", "b1;b;*", "b2;b;*"]


@pytest.fixture(scope="module")
def tax(spark):
    return tx.Taxonomy.from_lines(lines_from_list(spark, LINES), "t")


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r["distance"] for r in df.collect()}


def test_hand_values(tax):
    d = as_map(tx.distance_matrix(tax), "node_a", "node_b")
    assert d["a1", "a1"] == 0
    assert d["a1", "a2"] == pytest.approx(math.log2(1.5))
    assert d["a1", "b1"] == pytest.approx(math.log2(1.8))
    s = as_map(tx.distance_matrix(tax, dist="similarity"), "node_a", "node_b")
    assert s["a1", "a2"] == pytest.approx(1 / 3)
    assert s["a1", "b1"] == pytest.approx(2 / 3)


def test_file_order_and_repeats(spark, tmp_path):
    path = tmp_path / "hierarchy_x.csv"
    path.write_text("z;g;*\ny;g;*\nz;g;*\nx;h;*\n")
    rows = read_hierarchy(spark, str(path), "x").select("leaf", "leaf_ord").distinct().orderBy("leaf_ord").collect()
    assert [r["leaf"] for r in rows] == ["z", "y", "x"]
    widths = {r["node"]: r["n_leaves"] for r in tx.node_width(
        tx.Taxonomy(read_hierarchy(spark, str(path), "x"), "x")).collect()}
    assert widths == {"z": 1, "y": 1, "x": 1, "g": 2, "h": 1, "*": 3}


def test_numeric_hierarchy(spark):
    tax = tx.Taxonomy.from_lines(lines_from_list(spark, ["10;5_10;*", "5;5_10;*", "11;11_20;*"]), "n")
    assert tax.is_numeric
    assert (tax.boundary.bottom, tax.boundary.top, tax.boundary.distance) == ("5", "11", 6.0)


def test_matrix_is_refused_when_too_large(tax, monkeypatch):
    monkeypatch.setattr(tx, "MATRIX_NODES", 3)
    with pytest.raises(ValueError):
        tx.distance_matrix(tax)


@pytest.mark.parametrize("dist", ["semantic", "similarity"])
@pytest.mark.parametrize("lines", [
    LINES,
    [*LINES, "a1;b;*", "a2;b;*", "c;*"],
    ["a1;p;a;*", "a1;q;b;*", "a2;p;a;*", "b1;q;b;*", "b1;p;a;*", "z;*"],
])
def test_marginality_equals_pair_sums(spark, lines, dist):
    """The linear form agrees with summing the matrix, shared and short branches included."""
    tax = tx.Taxonomy.from_lines(lines_from_list(spark, lines), "t")
    leaves = sorted({line.split(";")[0] for line in lines})
    counts = {v: 3 * i + 1 for i, v in enumerate(leaves)}
    frame = spark.createDataFrame(list(counts.items()), "value string, n long")
    d = as_map(tx.distance_matrix(tax, "all", dist), "node_a", "node_b")
    got = {r["value"]: r["marginality"] for r in mg.marginality(frame, tax, dist=dist, targets="nodes").collect()}
    nodes = {a for a, _ in d}
    assert set(got) == nodes
    for v in nodes:
        assert got[v] == pytest.approx(sum(n * d[v, w] for w, n in counts.items()))


def test_large_taxonomies_are_not_broadcast(spark, tax, monkeypatch):
    """Without broadcasts the results stay the same."""
    import veilspark.runtime as rt

    want = sorted(map(tuple, mg.marginality_domain(tax).collect()))
    monkeypatch.setattr(rt, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mg.marginality_domain(tax).collect())) == want


def test_covers(spark, tax):
    df = spark.createDataFrame([("a1", "a"), ("a1", "b"), ("a1", "*"), ("zz", "a")], "v string, n string")
    got = {(r["v"], r["n"]): r["covered"] for r in tx.covers(df, "v", "n", tax).collect()}
    assert got == {("a1", "a"): True, ("a1", "b"): False, ("a1", "*"): True, ("zz", "a"): False}
