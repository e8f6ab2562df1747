"""The pipeline's stages, each judged on its own input."""

import numpy as np

import corpus_pipeline
from veilspark.llm import jaccard_join, quality, secrets
from veilspark.runtime import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialise(stage(spark, docs, SF))
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").collect()) for x in [*inputs, docs]]
    assert all(x.columns == columns for x in inputs)
    assert ids[1] == sorted(r["doc_id"] for r in quality.judge(inputs[0], ["doc_id"]).filter("kept").collect())
    assert ids[2] == sorted({r["component_id"] for r in jaccard_join.near_duplicates(inputs[1]).collect()})  # ids are unique here
    assert ids[3] == ids[2]
    bad = [r["candidate"] for r in secrets.scan(inputs[2]).filter("secret").collect()]
    assert not any(b in r["text"] for r in inputs[3].collect() for b in bad)
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    assert docs.filter("not round_trip").count() == 0


def test_stages_decide_by_row(spark):
    rng = np.random.default_rng(8)
    words = [f"{'abcdefgh'[i % 8]}{'lmnop'[i % 5]}word{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words, 90))
    key = '"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(i, text(), "en", "s") for i in range(150)]
    rows += [(None, text(), "en", "s"), (None, "too short", "en", "s"), (None, None, "en", "s")]
    rows += [(7, text(), "en", "s"), (7, "short as well", "en", "s"), (8, "no words", None, "s")]
    rows += [(None, f"{text()} token = {key}", "en", "s"), (9, f"{text()} token = {key}", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = quality.quality_stage(spark, docs, SF)
    want = [r for r in rows if r[1] is not None and len(r[1].split()) >= quality.MIN_WORDS]
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    redacted = [(r[0], r[1] and r[1].replace(key, f'"{secrets.REDACTED}"'), *r[2:]) for r in rows]
    assert sorted(map(tuple, secrets.secret_stage(spark, docs, SF).collect()), key=str) == sorted(redacted, key=str)


def test_one_of_each_group_stays_and_no_unique_text_goes(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(500)]
    text = lambda n=80: " ".join(rng.choice(words, n))
    a, b, c, d = text(), text(), text(), text()
    near = c.split()
    near[40] = "changed"
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (9, " ".join(near)), (None, d), (None, text()), (5, d), (5, d),
            (11, None), (11, None), (None, ""), (12, " "), (12, text())]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", "x", "y", "z") for i, t in rows],
        "doc_id long, text string, lang string, source string, nr string, row string, `group` string")
    kept = jaccard_join.one_per_group(spark, docs, SF)
    assert kept.columns == docs.columns and {tuple(r)[4:] for r in kept.collect()} == {("x", "y", "z")}
    want = [(3, a), (7, b), (9, " ".join(near)), (5, d), rows[7], *rows[10:]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccard_join.one_per_group(spark, docs.limit(0), SF).collect() == []


def test_quality_stage_leaves_names_alone(spark):
    clash = "_row n_words word_chars _lang _group x0 d2 kept base_failed members _members bin half _thin".split()
    docs = spark.createDataFrame(
        [(i, " ".join(f"word{i}a{j}" for j in range(60)), None, "s", *clash) for i in range(5)] + [(9, "short", "en", None, *clash)],
        "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
    kept = quality.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[4:] for r in kept.collect()) == [tuple(clash)] * 5
