"""Operators of the llm subpackage against SQL, brute force and odd inputs."""

import collections
import hashlib

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from veilspark.llm import hashing_search, jaccard_join, language_crf, mixing, nbest, phrase_dedup  # noqa: E402
from veilspark.llm import quality, secrets, suffix_dedup, warc  # noqa: E402
from veilspark.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox number {} jumps over lazy dogs near river bank while {} people watch from far away. "


def odd_rows():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words, 120))
    near = base.replace(base.split()[60], "changed", 1)
    passage = " ".join(rng.choice(words, 45))
    return [
        (1, None, "en", None), (2, "", "en", "a"), (3, "one two", "de", "a"), (4, "ONE TWO", None, "b"),
        (5, base, "en", "a"), (6, base, "en", "a"), (7, near, "en", "b"), (7, near, "en", "b"),
        (8, " ".join(rng.choice(words, 80)) + " " + passage, "de", "b"), (9, passage + " é漢 ▁ " + " ".join(rng.choice(words, 90)), "de", "a"),
        (10, " \n\t ", "en", "a"), (11, "x" * 5000, "fr", "a"), (12, " ".join(rng.choice(words, 30_000)), "en", "a"),
        (13, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + " ".join(rng.choice(words, 60)), "en", "test"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(*r, None, "clash") for r in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long, _key string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def union_sets(ids, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(low).encode().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(a & b)
                if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                    low_id = min(group[ids[i]], group[ids[j]])
                    changed |= group[ids[i]] != low_id or group[ids[j]] != low_id
                    group[ids[i]] = group[ids[j]] = low_id
    return {i: (len(s), group[i]) for i, s in zip(ids, sets)}


def removed(seqs, length):
    count = collections.Counter(tuple(s[i:i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append(gone)
    return out


def test_jaccard_join_is_brute_force(odd):
    rows = odd_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()}
    assert got == union_sets([r[0] for r in rows], [r[1] for r in rows])


def test_large_family_in_units(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "UNIT", 7)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(3):
        base = list(rng.choice(words, 60))
        for i in range(25):
            text = list(base)
            text[int(rng.integers(60))] = f"v{g}_{i}"
            rows.append((g * 100 + i, " ".join(text[: 60 - i % 3])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == union_sets(*map(list, zip(*rows)))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(80):
        t = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 50)))
        t = np.append(np.tile(t, 3) if trial % 3 == 0 else t, 0)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == order
        lcp, phi = suffix_dedup.permuted_lcp(t, sa)
        for i, j in zip(order[1:], order):
            n = 0
            while max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert (lcp[i], phi[i]) == (n, j)


def test_span_removals_are_brute_force(odd):
    rows = odd_rows()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_recurring_bytes(odd).collect())
    raws = [(r[1] or "").encode() for r in rows]
    want = [(r[0], len(b), sum(g), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest())
            for r, b, g in zip(rows, raws, removed(raws, 200))]
    assert got == sorted(want)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.remove_repeated_phrases(odd).collect())
    seqs = [(r[1] or "").encode().split() for r in rows]
    want = [(r[0], len(s), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(s, g) if not y)).hexdigest())
            for r, s, g in zip(rows, seqs, removed(seqs, 35))]
    assert got == sorted(want)


def test_statistics_are_brute_force():
    text = "a b c a b c d ##\n\na b c a b c d ##\n x|y \n x|y \nx"
    words = text.split()
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    assert quality.text_statistics(text) == (len(words), len("".join(words)), 6, 2, len(covered))
    assert quality.text_statistics(None) == (0,) * 5


def test_quality_rejects_symbols_and_keeps_clean(spark):
    rng = np.random.default_rng(4)
    words = [f"{'abcdefgh'[i % 8]}{'lmnop'[i % 5]}word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80 + i % 40)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in rng.choice(words, 80)), "en", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, ["doc_id"]).collect()}
    assert not any(kept[1000 + i] for i in range(10)) and sum(kept[i] for i in range(300)) == 300


def test_quality_judges_small_languages_and_groups(spark):
    """Sixty documents of a language are judged alone in the table, beside a large language, and cut into
    sources of ten."""
    rng = np.random.default_rng(5)
    words = [f"{'abcdefgh'[i % 8]}{'lmnop'[i % 5]}word{i}" for i in range(300)]
    clean = lambda: " ".join(rng.choice(words, 90))
    small = [(i, clean() if i < 50 else " ".join(w + "#$%&*" for w in rng.choice(words, 90)), None, f"s{i % 6}") for i in range(60)]
    large = [(1000 + i, clean(), "en", f"s{i % 2}") for i in range(300)]
    split = [(2000 + i, clean() if i % 10 else clean().replace(" ", "||| "), "de", f"t{i % 15}") for i in range(150)]
    for rows in (small, small + large, small + large + split):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        got = {r["doc_id"]: (r["kept"], r["d2"]) for r in quality.judge(df, ["doc_id"]).collect()}
        assert len(got) == len(rows) and all(d is not None for _, d in got.values())
        bad = {i for i, text, *_ in rows if "#" in text or "|||" in text}
        assert {i for i, (kept, _) in got.items() if not kept} == bad
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(empty, ["doc_id"]).count() == 0


def test_mcd_distances_equal_a_plain_estimate(spark):
    """Concentration steps in numpy over one group, from the same start and floors."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * [0.1, 0.3, 0.2, 0.4] + [1, 0.5, 0, 2]
    x[:40] += 3
    rows = [("g", i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i long, x0 double, x1 double, x2 double, x3 double")
    got = {r["i"]: r["d2"] for r in quality.robust_distances(df, "k").collect()}
    floor = np.diag(np.square(quality.FLOOR))
    centre, inverse = np.sort(x, axis=0)[199], np.linalg.inv(floor)
    for step in range(quality.STEPS + 1):
        d2 = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        bins = np.floor(np.log2(np.maximum(d2, 1e-9)) * quality.BINS).astype(int)
        half = np.sort(bins)[199]
        if step < quality.STEPS:
            core = x[bins <= half]
            centre = core.mean(axis=0)
            inverse = np.linalg.inv(np.cov(core.T, bias=True) + floor)
    want = d2 / max(2 ** ((half + 0.5) / quality.BINS) / quality.CHI2_MEDIAN, 1)
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    assert want[:40].min() > quality.LEVEL_BOUND


def test_mix_is_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(SQL["op5_mix_sources"]).fetchall()
    got = [tuple(r) for r in QUERIES["op5_mix_sources"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for _, size, source_size, target, taken, _ in got:
        assert taken <= 3 * size
        by[source_size, target][0] += taken
        by[source_size, target][2] = max(by[source_size, target][2], size)
    assert all(abs(taken - target) <= most for (_, target), (taken, _, most) in by.items())


def test_mix_draws_each_copy_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.plan_mix(docs)
    rows = mixing.draws(plan).select("doc_id", "copy", "shard").collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert all(0 <= r["shard"] < mixing.SHARDS for r in rows)
    assert mixing.mix_stage(spark, docs, SF).count() == len(rows)


def test_mix_stage_shuffles_texts_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = mixing.draws(mixing.plan_mix(docs)).count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = mixing.mix_stage(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2  # the texts and the runs
        assert out.count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_warc_round_trip(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, QUERIES["op6_warc"](spark, SF).collect()), key=str) == sorted(
        con.execute(SQL["op6_warc"]).fetchall(), key=str)
    html = "WARC/1.1\r\n\r\n" + "é漢x" * 5000
    rows = [(1, "u", html), (2, "u", html), (3, None, None), (4, "u", ""), (5, "v", "a"), (5, "v", "a"), (None, "w", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=4096)
    back = warc.read_records(spark, str(tmp_path / "w")).withColumn("page_id", warc.page_of("record_id")).collect()
    assert len(back) == len(rows)
    for r in back:
        want = next((h or "") for p, _, h in rows if p == r["page_id"]).encode()
        assert r["payload_bytes"] == len(want) and r["payload_digest"] == warc.digest(want)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"] or b"") == want


def test_warc_keeps_rows_that_share_a_page_id(spark, tmp_path):
    long = "long é" * 3000
    rows = [(None, "u", "a"), (None, "u", "b"), (None, "v", long), (None, "v", "a"), (5, "u", "c"), (5, "u", "d"),
            (5, "w", long), (5, "w", "c"), (6, "u", "d"), (7, None, None), (7, None, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=4096)
    back = warc.read_records(spark, str(tmp_path / "w"))
    back = back.withColumn("page_id", warc.page_of("record_id")).collect()
    want = [(p, warc.digest((h or "").encode())) for p, _, h in rows]
    assert sorted(((r["page_id"], r["payload_digest"]) for r in back), key=str) == sorted(want, key=str)
    assert len({r["record_id"] for r in back}) == len(rows)
    held = {r["record_id"]: r["payload_digest"] for r in back if r["record_type"] == "response"}
    assert all(held[r["refers_to_id"]] == r["payload_digest"] for r in back if r["record_type"] == "revisit")
    for r in back:
        assert r["record_type"] == "revisit" or warc.digest(bytes(r["payload"] or b"")) == r["payload_digest"]


def test_vector_search_recall(spark):
    got = QUERIES["op8_nearest_vectors"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], dtype=float)
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
        pair = v[ids == r["query_id"]][0] @ v[ids == r["vec_id"]][0]
        assert abs(pair - r["score"]) < 1e-9
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -9
        hits += len(found[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [1.0]), (20, [0.2, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hashing_search.search(df, df.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, 1), (0, 20), (20, 0), (20, 1)]
    assert hashing_search.search(df.limit(0), df.limit(0), 20).count() == 0


def test_nbest_is_brute_force_and_decodes():
    v = nbest.Pieces(nbest.MODEL)

    def every(text):
        t = nbest.MARK + text.replace(nbest.MARK, "\udc81").replace(" ", nbest.MARK)
        out = []

        def go(i, s):
            if i == len(t):
                out.append(s)
                return
            for j in range(i + 1, len(t) + 1):
                if t[i:j] in v.score:
                    go(j, s + v.score[t[i:j]][1])
            if t[i] not in v.score:
                go(i + 1, s + v.fallback)

        go(0, 0.0)
        return sorted(out, reverse=True)

    rng = np.random.default_rng(3)
    for _ in range(60):
        text = "".join(rng.choice(list("aet hin▁é\n漢s "), int(rng.integers(1, 10))))
        got = v.encode(text, 4)
        assert [s for s, _ in got] == every(text)[:4]
        assert all(v.decode(ids) == text for _, ids in got)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)


def test_crf_labels_switched_text_and_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_crf.learn(docs)
    got = language_crf.identify(docs, model).join(docs.select("doc_id", "lang", language_crf.held_out("doc_id").alias("h")), "doc_id")
    rows = got.filter("h").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    text = {lang: docs.filter((docs["lang"] == lang) & (docs["n_chars"] > 400)).first()["text"].split()[:30] for lang in ("en", "de")}
    tagger = language_crf.Labeller(model)
    prob = tagger.word_probabilities([text["en"] + text["de"]])[0]
    names = [tagger.names[i] for i in prob.argmax(axis=1)]
    assert names[:30].count("en") >= 26 and names[30:].count("de") >= 26
    assert np.allclose(prob.sum(axis=1), 1)


def test_crf_reads_text_without_blanks_to_its_end(spark):
    rng = np.random.default_rng(6)
    letters = {"aa": list("上下左右大小東西"), "bb": list("あいうえおかきく")}
    draw = lambda lang, n: "".join(rng.choice(letters[lang], n))
    texts = [(lang, draw(lang, 300)) for lang in ("aa", "bb") for _ in range(30)]
    model = language_crf.train([t for _, t in texts], [lang for lang, _ in texts])
    rows = [(1, draw("bb", 64) + draw("aa", 600)), (2, draw("aa", 64) + draw("bb", 600)), (3, "7" * 64 + draw("bb", 80)),
            (4, "7" * 64 + draw("aa", 80)), (5, "7" * 200), (6, "-" * 100)]
    got = language_crf.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "aa", 2: "bb", 3: "bb", 4: "aa", 5: "und", 6: "und"}
    for n in (1, 63, 64, 65, 66, 126, 127, 128, 500):
        word = draw("aa", n)
        pieces = language_crf.positions(word)
        grams = {word[i:i + 3] for i in range(max(1, n - 2))}
        assert max(map(len, pieces)) <= language_crf.RUN and grams == {p[i:i + 3] for p in pieces for i in range(max(1, len(p) - 2))}


def test_secrets_found_and_redacted(odd):
    found = secrets.scan(odd).filter("secret").collect()
    assert [r["doc_id"] for r in found] == [13]
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(odd, secrets.scan(odd)).collect()}
    assert secrets.REDACTED in texts[13] and "04dbebab" not in texts[13] and texts[1] is None


def test_secrets_of_every_form(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: "a7" + "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n - 2))
    forms = ["API_KEY={}", "export AWS_SECRET_ACCESS_KEY={}", '{{"api_key": "{}"}}', '{{\\"api_key\\": \\"{}\\"}}', 'x-api-key: "{}"',
             "Authorization: Bearer {}", "-H 'authorization: token {}'", "curl bearer {} x", "token = '{}'", 'secret2 := "{}"']
    keys = [(i, f, draw(40)) for i, f in enumerate(forms * 3)]
    keys += [(100, "key {} here", "AKIA" + "Q7RT" * 4), (101, "see {}", "ghp_" + draw(36)), (102, "x {}", "glpat-" + draw(20))]
    rows = [(i, f"some words {f.format(k)} and more", "s") for i, f, k in keys]
    rows += [(1000 + i, f"call {int(rng.integers(10 ** 15, 10 ** 16))} in this_long_name_of_words_{i} today", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for some in (df, df.filter("doc_id < 1000"), df.filter("doc_id = 3")):
        found = secrets.scan(some).filter("secret").collect()
        ids = {r["doc_id"] for r in some.select("doc_id").collect()}
        assert {(r["doc_id"], r["candidate"]) for r in found} == {(i, k) for i, _, k in keys if i in ids}


def test_odd_and_empty_inputs(odd, none):
    n = len(odd_rows())
    assert quality.judge(odd, ["doc_id"]).count() == n and quality.judge(none, ["doc_id"]).count() == 0
    assert mixing.plan_mix(odd).count() == n and mixing.plan_mix(none).count() == 0
    model = language_crf.learn(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.identify(odd, model).collect()}
    assert got[1] == got[2] == got[10] == "und" and got[12] in ("de", "en", "fr")
    assert language_crf.identify(none, language_crf.learn(none)).count() == 0
    coded = {r["doc_id"]: r for r in nbest.encode_documents(odd, ["doc_id"]).collect()}
    assert coded[1]["n_pieces"] is None and coded[2]["n_pieces"] == 0 and all(r["round_trip"] for r in coded.values())
    assert jaccard_join.near_duplicates(none).count() == 0 and secrets.scan(none).count() == 0
    assert suffix_dedup.remove_recurring_bytes(none).count() == 0 and phrase_dedup.remove_repeated_phrases(none).count() == 0


def test_units_learned_together_and_forgotten(monkeypatch):
    rng = np.random.default_rng(11)
    letters = list("aeinorst") + ["é", "漢", "\ue000", "\n", "▁", "\U0001f600"]
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 40)))) for _ in range(60)) for _ in range(30)] + ["", " "]
    vocab = nbest.Pieces(nbest.MODEL)
    want = [[(s, x.tolist()) for s, x in f] for f in vocab.encode_all(texts, 3)]
    for length in {len(u) for u in vocab.units}:
        same = [u for u in vocab.units if len(u) == length]
        assert vocab.two_best_of(same) == [vocab.two_best(u) for u in same]
    monkeypatch.setattr(nbest, "CACHE_UNITS", 50)
    monkeypatch.setattr(nbest, "CHUNK_CHARS", 500)
    again = nbest.Pieces(nbest.MODEL)
    assert [[(s, x.tolist()) for s, x in f] for f in again.encode_all(texts, 3)] == want


def test_a_worker_keeps_few_units(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join("".join(rng.choice(list("aeinorst"), int(rng.integers(4, 12)))) for _ in range(60)) for _ in range(60)]
    want = [[(s, x.tolist()) for s, x in f] for f in nbest.Pieces(nbest.MODEL).encode_all(texts, 4)]
    for name, value in (("CACHE_UNITS", 300), ("CACHE_CHOICES", 20), ("CHUNK_CHARS", 1_500)):
        monkeypatch.setattr(nbest, name, value)
    vocab, got, kept, choices = nbest.Pieces(nbest.MODEL), [], [], []
    for found in vocab.encode_all(texts, 4):
        got.append([(s, x.tolist()) for s, x in found])
        kept.append(len(vocab.units))
        choices.append(len(vocab.second))
    assert got == want and max(kept) <= 300 and max(choices) <= 20
