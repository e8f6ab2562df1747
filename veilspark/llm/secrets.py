"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``MIN_LENGTH`` key characters with a digit or a mixture of cases in it,
taken with what stands just before and after. The forest sees its length, the changes between classes
of characters, its distinct characters, how much of it dictionary words cover, whether the neighbouring
words name a credential or assign to it, and whether the document's path (its source) names a test or an
example. The dictionary is counted over all documents: their ``DICTIONARY`` most frequent words.

Labelled findings may be given as a table (doc_id, candidate, label); the forest then sees all features.
The tables here hold none, so the query labels by evidence that the forest does not see: a known key format
(``KNOWN``), or a credential's name that assigns to the candidate (quoted or not, JSON, hyphenated), or a
bearer scheme before it. The forest learns from shape, dictionary and path (``SHAPE``) what such candidates
look like. A known format is a secret; a named candidate is one unless its shape is clearly that of the
others (``NAMED_LEAST``); any other candidate is one if its shape is clearly a secret's (``BARE_LEAST``).
The sample is bounded per label (``SAMPLE`` candidates with the smallest hash in all, half for each label).

Only DataFrame functions and Spark's own forest are used; training sees the bounded sample, scoring every
candidate. Words are counted with map-side aggregation, and only candidates are shuffled.

Defined results: NULL and empty texts have no candidates. Repeated rows give repeated findings. If there
is one label only, nothing can be learned, and each candidate's own evidence decides. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import md5_of, query, row_key, table
from veilspark.runtime import materialise

MIN_LENGTH = 16
SAMPLE = 20_000
DICTIONARY = 5_000
TREES, DEPTH = 20, 6
REDACTED = "[secret]"

_RUN = r"[A-Za-z0-9+/_=-]"
_QUOTE = r"\\?[\"']"
#: Name, closing quote of a JSON name, assignment; opening quote; scheme of a header.
_LEAD = (rf"(?:([A-Za-z_][A-Za-z0-9_-]{{1,59}})(?:{_QUOTE})?[\x20\t]{{0,3}}(:=|=>|[=:])[\x20\t]{{0,3}})?"
         rf"({_QUOTE})?(?:((?i:bearer|basic|token))[\x20\t]{{1,3}})?")
#: Name and assignment before a run, if any, the run, and a closing quote.
FOUND = rf"(?<![A-Za-z0-9+/_=-]){_LEAD}{_RUN}{{{MIN_LENGTH},}}(?:{_QUOTE})?"
PARTS = rf"^{_LEAD}({_RUN}{{{MIN_LENGTH},}})({_QUOTE})?$"
CHANGES = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[^A-Za-z0-9])(?=[A-Za-z])"
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api[_-]?key|auth(?!or(s|ed|ing)?$)|credential|bearer|(access|private)[_-]?key)"
#: Formats that providers give their keys.
KNOWN = (r"(?:^|[^A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}"
         r"|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"
         r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}|eyJ[A-Za-z0-9_-]{13,})(?:$|[^A-Za-z0-9])")
FEATURES = ["length", "changes", "distinct", "digits", "upper", "covered", "named", "assigned", "quoted", "test_path"]
#: What the forest sees where labels come from name and format.
SHAPE = [x for x in FEATURES if x not in ("named", "assigned", "quoted")]
NAMED_LEAST, BARE_LEAST = 0.2, 0.95


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: its row's key and doc_id, its number in the text, the candidate, and what surrounds it."""
    key = row_key("doc_id", "text").alias("row_key")
    hits = docs.select(key, "doc_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))).alias("nr", "hit"))
    part = lambda i: F.regexp_extract("hit", PARTS, i)
    rows = hits.select("row_key", "doc_id", "source", "nr", part(1).alias("name"), part(2).alias("sign"), part(3).alias("quote"),
                       part(4).alias("scheme"), part(5).alias("candidate"), part(6).alias("close"))
    mixed = F.col("candidate").rlike("[0-9]") | (F.col("candidate").rlike("[a-z][A-Z]") & F.col("candidate").rlike("[A-Z]{2}"))
    return rows.filter(mixed)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The most frequent lower-case words of all documents, three letters or more."""
    words = F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}]+"))
    counts = docs.select(words.alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(size).select("word")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns ``FEATURES``. ``words`` is small by construction and broadcast."""
    c = F.col("candidate")
    runs = found.select("candidate").distinct().select(
        "candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word"))
    cover = runs.join(F.broadcast(words), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("_cover"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    n = F.length("candidate").cast("double")
    assigned = F.col("name").rlike(CREDENTIAL) & (F.col("sign") != "")
    return found.join(cover, "candidate", "left").select(
        "row_key", "doc_id", "nr", "candidate", n.alias("length"),
        (F.regexp_count(c, F.lit(CHANGES)) / n).alias("changes"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).cast("double").alias("distinct"),
        (F.regexp_count(c, F.lit("[0-9]")) / n).alias("digits"),
        (F.regexp_count(c, F.lit("[A-Z]")) / n).alias("upper"),
        (F.coalesce(F.col("_cover"), F.lit(0)) / n).alias("covered"),
        flag(F.col("name").rlike(CREDENTIAL)).alias("named"), flag(F.col("sign") != "").alias("assigned"),
        flag((F.col("quote") != "") & (F.col("close") == F.col("quote"))).alias("quoted"),
        flag(F.col("source").rlike("(?i)test|example|sample|fixture|docs?/")).alias("test_path"),
        flag(c.rlike(KNOWN)).cast("boolean").alias("_known"),
        flag(assigned | (F.lower("scheme") == "bearer")).cast("boolean").alias("_context"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, trees: int = TREES,
         depth: int = DEPTH) -> DataFrame:
    """Every candidate with its features, the forest's ``probability`` and the verdict ``secret``."""
    docs = docs.select("doc_id", "source", "text")
    found = materialise(candidates(docs))
    rows = materialise(features(found, materialise(dictionary(docs))))
    evidence = F.col("_known") | F.col("_context")
    seen = SHAPE if labelled is None else FEATURES
    if labelled is None:
        train = rows.withColumn("label", evidence.cast("double"))
    else:
        train = rows.join(labelled.select("doc_id", "candidate", F.col("label").cast("double").alias("label")), ["doc_id", "candidate"])
    counts = {r["label"]: r["n"] for r in train.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = ["row_key", "doc_id", "nr", "candidate", *FEATURES, "probability", "secret"]
    if len(counts) < 2:
        return rows.withColumn("probability", evidence.cast("double")).withColumn("secret", evidence).select(*shown)
    half = sample // 2
    # the smallest hashes of each label; sorted in one partition, so that the forest is the same in every run
    order = [md5_of("forest", F.col("candidate"), F.col("doc_id")), F.col("nr")]
    parts = [train.filter(F.col("label") == k).orderBy(*order).limit(half).withColumn(
        "_weight", F.lit((half if labelled is None else n) / min(n, half))) for k, n in sorted(counts.items())]
    train = parts[0]
    for x in parts[1:]:
        train = train.unionByName(x)
    train = materialise(train.select("label", "_weight", *seen).repartition(1).sortWithinPartitions("label", *seen))
    pack = VectorAssembler(inputCols=seen, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", numTrees=trees,
                                    maxDepth=depth, seed=3)
    model = forest.fit(pack.transform(train))
    scored = model.transform(pack.transform(rows)).withColumn("probability", vector_to_array("probability")[1])
    least = F.when(F.col("_context"), NAMED_LEAST).otherwise(BARE_LEAST) if labelled is None else F.lit(0.5)
    return scored.withColumn("secret", F.col("_known") | (F.col("probability") >= least)).select(*shown)


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with every confirmed secret of a row replaced in its whole text, longest first. Findings meet
    their row by its key, so rows without an id are redacted too."""
    per = findings.filter("secret").groupBy("row_key").agg(F.collect_set("candidate").alias("_s"))
    per = materialise(per.select("row_key", F.reverse(F.sort_array(F.transform(
        "_s", lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))).alias("_secrets")))
    text = F.aggregate("_secrets", F.col("text"), lambda t, s: F.replace(t, s["s"], F.lit(REDACTED)))
    changed = docs.withColumn("row_key", row_key("doc_id", "text")).join(per, "row_key", "left").withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast("long")))
    return changed.select(*docs.columns)


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are redacted, documents stay."""
    return redact(docs, scan(docs))


@query("op3_secret_scan")
def op3(spark, sf_dir):
    """Every candidate of all documents with the forest's verdict; the candidate itself as a digest."""
    return scan(table(spark, sf_dir, "documents")).drop("row_key").withColumn("candidate", F.sha2("candidate", 256))
