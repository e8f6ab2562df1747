"""The nearest released category against all pairs."""

import random

import pytest

from veilspark.operators import ranks
from veilspark.operators import taxonomy as tx
from veilspark.sources.hierarchy import lines_from_list
from veilspark.spec import QI

TREE = [f"l{i};m{i % 5};t{i % 5 % 2};*" for i in range(18)] + ["s1;t0;*", "s2;*"]
#: leaves with two paths, an inner node with two paths, and leaves below it that have one line each
SHARED = [*TREE, "l0;m3;t1;*", "l4;m1;t1;*", "u0;w;t0;*", "u1;w;t1;*", "u2;w;t1;*", "u3;w;t0;*", "u3;m2;t0;*"]


def brute(tax, points, column):
    d = {(r["node_a"], r["node_b"]): r["distance"] for r in tx.distance_matrix(tax, "all").collect()}
    nodes = {a for a, _ in d}
    out = {}
    for x in {p for p in points if p in nodes}:
        best = [(1.0 if "*" in (x, y) else round(d[x, y], 9), r, y) for y, r in column if y in nodes]
        if best:
            out[x] = min(best)[2]
    return out


@pytest.mark.parametrize("lines", [TREE, SHARED])
@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_equals_all_pairs(spark, lines, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr("veilspark.runtime.BROADCAST_ROWS", 0)
    tax = tx.Taxonomy.from_lines(lines_from_list(spark, lines), "t")
    nodes = sorted({n for line in lines for n in line.split(";")})
    points = [*nodes, "nowhere", None]
    draw = random.Random(7)
    for share in (0.1, 0.4, 0.9) if broadcast else (0.4,):
        column = [(n, draw.randrange(1000) * 100 + i) for i, n in enumerate(nodes) if draw.random() < share]
        column += [("elsewhere", -1)]
        got = ranks.nearest_category(
            spark.createDataFrame([(p,) for p in points], "x string"),
            spark.createDataFrame(column, "y string, first_rid long"), QI("t", "category", tax=tax))
        assert {r["x"]: r["nearest"] for r in got.collect()} == brute(tax, points, column)


def test_nothing_released(spark):
    tax = tx.Taxonomy.from_lines(lines_from_list(spark, TREE), "t")
    got = ranks.nearest_category(spark.createDataFrame([("l1",)], "x string"),
                                 spark.createDataFrame([], "y string, first_rid long"), QI("t", "category", tax=tax))
    assert got.count() == 0


def test_more_nodes_than_a_matrix_allows(spark):
    """25,000 leaves: each finds itself or the first one of its group."""
    lines = spark.range(25_000).selectExpr("concat('v', id, ';g', id % 500, ';*') AS line", "id AS ord")
    tax = tx.Taxonomy.from_lines(lines, "t")
    points = spark.range(25_000).selectExpr("concat('v', id) AS x")
    column = spark.range(25_000).filter("id % 3 = 0").selectExpr("concat('v', id) AS y", "id AS first_rid")
    got = {r["x"]: r["nearest"] for r in ranks.nearest_category(points, column, QI("t", "category", tax=tax)).collect()}
    first = {}
    for i in range(0, 25_000, 3):
        first.setdefault(i % 500, i)
    assert got == {f"v{i}": f"v{i}" if i % 3 == 0 else f"v{first[i % 500]}" for i in range(25_000)}
