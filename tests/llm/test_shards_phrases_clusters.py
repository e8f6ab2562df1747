"""Uniform shards, collocations and pivot clustering against brute force and odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

import harness  # noqa: E402
from veilspark.llm import collocations, pivot_clustering, uniform_shards  # noqa: E402
from veilspark.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, at string, place string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, "clash", "clash", "clash", "clash", "clash") for r in rows], DOC)


@pytest.mark.parametrize("name", ["op12_collocations", "op13_pivot_clustering"])
def test_query_is_sql(spark, name):
    assert harness.compare(QUERIES[name](spark, SF), harness.duck(SF), SQL[name]) is None


# --- shards

def test_shards_hold_every_document_once(spark):
    rows = QUERIES["op11_uniform_shards"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[j]) for j in range(40)]
    assert set(by) <= set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("limit", [10 ** 9, 1])
def test_hypergeometric_counts(limit):
    """Both samplers draw with the exact probabilities."""
    rng, good, bad, sample, n = np.random.default_rng(5), 9, 14, 8, 20_000
    drawn = collections.Counter(uniform_shards.hypergeometric(rng, good, bad, sample, limit) for _ in range(n))
    chi = 0.0
    for k in range(sample + 1):
        want = n * math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
        chi += (drawn[k] - want) ** 2 / want
    assert chi < 27.9  # 0.9995 quantile at 8 degrees of freedom: 27.87
    assert uniform_shards.hypergeometric(rng, 3 * 10 ** 10, 10 ** 11, 0) == 0
    assert uniform_shards.hypergeometric(rng, 3 * 10 ** 10, 10 ** 11, 13 * 10 ** 10) == 3 * 10 ** 10
    wide = [uniform_shards.hypergeometric(rng, 3 * 10 ** 10, 10 ** 11, 10 ** 6) for _ in range(300)]
    assert abs(np.mean(wide) - 10 ** 6 * 3 / 13) < 5 * 421 / math.sqrt(300) and 350 < np.std(wide) < 500


def test_matrix_has_the_margins():
    rows, columns = np.array([5, 0, 7, 1, 12]), np.array([9, 8, 8])
    m = uniform_shards.deal(np.random.default_rng(1), columns, rows)
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == columns).all() and (m >= 0).all()


def test_shuffle_is_uniform_and_repeats(spark):
    """Small pieces and many groups: rows of a piece meet every shard and slot about equally often."""
    df = spark.range(0, 6_000, 1, 3).withColumnRenamed("id", "doc_id")
    run = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in uniform_shards.shuffle_into_shards(
        df, 6, seed, piece_rows=128).collect()}
    got = run("a")
    assert got == run("a") and got != run("b")
    assert sorted(got.values()) == [(s, i) for s in range(6) for i in range(1_000)]
    for lo in range(0, 6_000, 1_000):
        part = [got[i] for i in range(lo, lo + 1_000)]
        shard = np.bincount([s for s, _ in part], minlength=6)
        half = sum(i < 500 for _, i in part)
        assert ((shard - 1_000 / 6) ** 2 / (1_000 / 6)).sum() < 22.1 and abs(half - 500) < 80


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, None), (None, None, None), (3, "", "en"), (3, "", "en"), (4, "x" * 300_000, "en"), (5, "é漢", "en")] * 2
    df = docs(spark, rows)
    out = uniform_shards.shuffle_into_shards(df, 5).collect()
    assert len(out) == 12 and collections.Counter(r["shard"] for r in out) == {0: 3, 1: 3, 2: 2, 3: 2, 4: 2}
    assert set(out[0].asDict()) == set(df.columns) and {r["at"] for r in out} == {"clash"}
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert uniform_shards.shuffle_into_shards(df.limit(0)).collect() == []
    few = uniform_shards.shuffle_into_shards(df.limit(2)).collect()
    assert sorted(r["shard"] for r in few) == [0, 1]
    uniform_shards.write_shards(df, str(tmp_path / "out"), shards=3, piece_rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12 and back.filter("shard = 1").count() == 4
    one = uniform_shards.shuffle_into_shards(spark.range(3).select("id", "id").toDF("a`b", "c d"), 2).collect()
    assert sorted(r["c d"] for r in one) == [0, 1, 2]


# --- phrases

def phrases(rows, least=10, top=2_000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in many.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        best = []
        for p, a in many.items():
            if p not in gone:
                s, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


def odd_texts():
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "É", "é", "漢", "A", "x\x01", "\x00", "-", "zz", "b\xa0c"]
    text = lambda k: "".join(rng.choice(names) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(k))
    rows = [(i, text(int(rng.integers(0, 400))), [None, "und", "en", "de"][i % 4]) for i in range(60)]
    return rows + [(None, None, "en"), (7, "", "en"), (7, " \t ", "fr"), (8, "a b c " * 20_000, "en"), (8, "...,,,", None)]


@pytest.mark.parametrize("words", [1_000_000, 500])
def test_collocations_are_brute_force(spark, words):
    """One shard or many: the same phrases."""
    rows = odd_texts()
    got = collocations.collocations(docs(spark, rows).repartition(3), words=words).collect()
    assert sorted(map(tuple, got)) == phrases(rows)
    small = collocations.collocations(docs(spark, rows), min_count=3, top=7, words=words).collect()
    assert sorted(map(tuple, small)) == phrases(rows, 3, 7)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, odd_texts()).limit(0)).collect() == []
    assert collocations.collocations(docs(spark, [(1, "a b", "en"), (2, None, None)])).collect() == []


def test_exact_score_beyond_64_bits(spark):
    a, left, right = 3 * 10 ** 14 + 7, 9 * 10 ** 14 + 1, 4 * 10 ** 14 + 3
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    col = collocations.score(*[df[c] for c in "alr"])
    assert df.select(col.alias("s")).first()["s"] == 10 ** 6 * a * a // (left * right)


def test_word_index_counts_and_extends():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 6, 4_000).astype(np.int32) * 7
    grams = collections.Counter(tuple(ids[i:i + k].tolist()) for k in (1, 2, 3) for i in range(len(ids) - k + 1))
    index = collocations.WordIndex(ids, 3)
    for k in (1, 2, 3):
        for p in np.ndindex(*(5,) * k):
            p = tuple(7 * (x + 1) for x in p)
            assert index.count(list(p)) == grams[p]
    assert index.count([7, 99]) == 0
    one = index.words()
    two, _, size, right, left = index.extend(one)
    pair = {(int(index.values[a]), int(index.values[b + 1])): int(n) for a, b, n in zip(left, right, size)}
    assert pair == {p: n for p, n in grams.items() if len(p) == 2 and 0 not in p}
    _, row, size, _, left = index.extend(two)
    assert sum(size) == sum(n for p, n in grams.items() if len(p) == 3 and 0 not in p)


def test_long_texts_are_cut_between_words():
    text = "word, another\tone  and. more " * 500
    assert "".join(collocations.slices(text, 37)) == text
    assert all(len(s) < 60 and (s[-1] in " \t.,") for s in list(collocations.slices(text, 37))[:-1])
    assert list(collocations.slices("x" * 100, 10)) == ["x" * 100, ""]


# --- clusters

def clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(float(x) * 1024) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    place = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        at = [j for _, j in place()]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            centres[j] = [sum(x) // len(own) for x in zip(*own)]
    last = place()
    inertia = collections.Counter()
    for d, j in last:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, last)), key=str)


VEC = "vec_id long, embedding array<double>, cluster string, v string, p string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], VEC)


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(100 + i, (rng.normal(size=64) * 0.01 + i % 3).tolist()) for i in range(40)]
    rows += [(5, rows[5][1]), (5, rows[7][1]), (None, rows[9][1]), (None, [0.0] * 64), (200, [0.0] * 64), (201, [60_000.0] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63),
             (305, [float("nan")] + [1.0] * 63), (306, [float("-inf")] + [1.0] * 63)]
    got = pivot_clustering.report(*pivot_clustering.cluster(vectors(spark, rows).repartition(4))).collect()
    assert sorted(map(tuple, got), key=str) == clusters(rows)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(12)]
    for rows in (same, same[:3], []):
        got = pivot_clustering.report(*pivot_clustering.cluster(vectors(spark, rows))).collect()
        assert sorted(map(tuple, got), key=str) == clusters(rows)
    with pytest.raises(Exception, match="no exact distance"):
        pivot_clustering.cluster(vectors(spark, [(1, [1e30] * 64)]))


def test_bounds_never_pass_the_distance_and_save_work():
    rng = np.random.default_rng(7)
    middles = rng.integers(-4_000, 4_000, size=(8, 64))
    v = (middles[rng.integers(0, 8, 4_000)] + rng.integers(-40, 40, size=(4_000, 64))).astype(np.int64)
    centres, pivots = v[:8].copy(), v[8:16]
    sq = lambda a, b: ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    to = np.sqrt(sq(v, pivots).astype(float))
    low = pivot_clustering.lower_bounds(to, np.sqrt(sq(centres, pivots).astype(float)), np.sqrt(sq(pivots, pivots).astype(float)))
    far = sq(v, centres)
    assert (low * low <= far).all()
    looked = []
    number, dist = pivot_clustering.nearest(v, to, centres, pivots, looked)
    assert (number == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()
    assert sum(looked) < 0.5 * 7 * len(v)
