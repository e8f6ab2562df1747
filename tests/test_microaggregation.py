import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.operators import microaggregation as ma
from veilspark.spec import QI

X = QI("x", "number", 0.0, 100.0, 0)
Y = QI("y", "number", 0.0, 10.0, 0)


def table(spark, n, seed, hot=0.0):
    rng = random.Random(seed)
    rows = [(i, 7.0, 3.0) if rng.random() < hot else (i, float(rng.randint(0, 100)), float(rng.randint(0, 10)))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "rid long, x double, y double")


def shapes_of_a_scan(rows, k):
    """Multiset of attribute vectors in each cluster of the sequential greedy; rows of one vector
    are interchangeable. Vectors at equal distance are ordered as the operator orders them."""
    import hashlib
    import json

    steps = len(rows) // k - 1
    left = Counter((x, y) for _, x, y in rows)
    key = {v: hashlib.md5(json.dumps({"x": v[0], "y": v[1]}, separators=(",", ":")).encode()).hexdigest() for v in left}
    out = []
    for corner in ma.corner_order(2, steps):
        cx, cy = 100.0 * corner[0], 10.0 * corner[1]
        dist = lambda v: round((((v[0] - cx) / 100) ** 2 + ((v[1] - cy) / 10) ** 2) ** 0.5, 12)
        need, got = k, Counter()
        for v in sorted(left, key=lambda v: (dist(v), key[v])):
            take = min(need, left[v])
            if take:
                got[v] += take
                left[v] -= take
                need -= take
        out.append(got)
    out.append(+left)
    return out


@pytest.mark.parametrize("n,k,hot,batch", [(60, 5, 0.0, None), (120, 7, 0.0, 60), (150, 6, 0.4, 40), (11, 6, 0.0, None)])
def test_batched_is_the_sequential_scan(spark, monkeypatch, n, k, hot, batch):
    if batch:
        monkeypatch.setattr(ma, "BATCH_ROWS", batch)  # many batches, and distance cuts
    rows, df = table(spark, n, n, hot)
    got = {r["rid"]: r["cluster_id"] for r in ma.microaggregate(df, [X, Y], k, "batched").collect()}
    assert len(got) == n
    shapes = {}
    for rid, x, y in rows:
        shapes.setdefault(got[rid], Counter())[x, y] += 1
    want = shapes_of_a_scan(rows, k) if n >= 2 * k else [Counter((x, y) for _, x, y in rows)]
    assert [shapes[i] for i in range(len(want))] == want


def test_few_vectors_are_one_batch_however_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ma, "BATCH_ROWS", 100)
    batches, run = [], ma._batch_runs
    monkeypatch.setattr(ma, "_batch_runs", lambda *a: batches.append(1) or run(*a))
    rows = [(i, 10 * (i % 5), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, x long, y long")
    got = {r["rid"]: r["cluster_id"] for r in ma.microaggregate(df, [X, Y], 3, "batched").collect()}
    shapes = {}
    for rid, x, y in rows:
        shapes.setdefault(got[rid], Counter())[x, y] += 1
    assert [shapes[i] for i in range(len(shapes))] == shapes_of_a_scan(rows, 3)
    assert len(batches) == 1


@pytest.mark.parametrize("strategy", ["batched", "ordered"])
def test_sizes(spark, strategy):
    _, df = table(spark, 103, 1, 0.3)
    sizes = Counter(r["cluster_id"] for r in ma.microaggregate(df, [X, Y], 10, strategy).collect())
    assert sum(sizes.values()) == 103 and len(sizes) == 10
    assert all(10 <= s < 20 for s in sizes.values())


def test_corner_order():
    assert ma.corner_order(1, 3) == [(0,), (1,), (0,)]
    assert ma.corner_order(2, 5)[:4] == [(0, 0), (1, 1), (0, 1), (1, 0)]
    for m in (3, 4, 6):
        cycle = ma.corner_order(m, 2**m)
        assert len(set(cycle)) == 2**m
    assert len(set(ma.corner_order(30, 100))) == 100


def test_store_follows_the_data(spark, tmp_path):
    _, df = table(spark, 40, 3)
    root = str(tmp_path)
    first = ma.cached_clusters(df, [X, Y], 5, "ordered", root)
    again = ma.cached_clusters(df, [X, Y], 5, "ordered", root)
    assert sorted(first.collect()) == sorted(again.collect())
    changed = df.withColumn("x", F.when(F.col("rid") == 0, 99.0).otherwise(F.col("x")))
    ma.cached_clusters(changed, [X, Y], 5, "ordered", root)
    assert len(list((tmp_path / "clusters").iterdir())) == 2


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        ma.microaggregate(table(spark, 10, 1)[1], [X, Y], 3, "other")
