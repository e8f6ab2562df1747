"""Collocations by an FM-index over word ids per shard, counts summed across shards.

A shard is about ``WORDS`` words of one language, cut from one task's texts at piece ends. Its index is
the Burrows-Wheeler transform of its word ids, suffixes sorted to the depth asked. A phrase is an
interval of suffixes; ``WordIndex.extend`` extends all intervals by one word to the left at once: the
last-to-first mapping sends each suffix to the one that starts a word earlier, and the suffixes that
share that word and came from the same interval are the longer phrase's interval. The intervals nest by
prefix, so the same positions also give the phrase without its last word: right extension. Depth-limited
enumeration yields every phrase of a shard with its count and both ways it extends a shorter one.

Counts are summed across shards level by level, because a phrase is no more frequent than its parts:
words first (frequent ones get ids, in order of language and word; the others end up as separators), then
pairs, then only the triples whose two pairs are frequent everywhere. What is learned of a level goes
back to the shards by an exchange keyed by shard. Nothing is dropped but what cannot reach ``min_count``.

Defined results: NULL and empty texts have no words; NULL language is ``und``, together with a language
of that name. Repeated rows and ids count each time. Ties of score and count go to the smaller phrase in
byte order. An empty table gives no rows. A piece of more than ``WORDS`` words makes a larger shard.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import query, table
from veilspark.runtime import materialise, ordered_positions

MIN_COUNT = 10
TOP = 2_000
#: A candidate goes when a longer one has at least this percentage of its count.
COVER = 50
#: Words of a shard.
WORDS = 400_000
#: Slices of a language whose best phrases are found side by side.
SLICES = 64
#: Characters tokenised at a time.
SLICE = 1 << 20
#: Ids are below 2^31, so a pair of words is one 64-bit number.
ID_BITS = 31

#: Lower case, one mark for every end of a piece, and blanks; all are single bytes in UTF-8.
END = 10
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + bytes([END]) * 9 + b" ")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut behind a blank or the end of a piece."""
    at = 0
    while len(text) - at > size:
        cuts = [i for i in (text.find(c, at + size) for c in " \t\n.,;:!?") if i >= 0]
        end = min(cuts, default=len(text) - 1) + 1
        yield text[at:end]
        at = end
    yield text[at:]


class Shard:
    """Word ids of one language's texts in the order of their first use from 1; 0 ends a piece."""

    def __init__(self):
        self.vocab: dict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[bytes([END])], self.vocab[b""] = 0, 1
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: str) -> None:
        for part in slices(text):
            tokens = part.encode().translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.vocab.__getitem__, tokens), np.int32, len(tokens))
            ids = ids[ids != 1]
            self.words += int(np.count_nonzero(ids))
            self.parts.append(ids)
        self.parts.append(np.zeros(1, np.int32))

    def row(self) -> tuple[bytes, list[bytes], np.ndarray, int]:
        """(ids, words, their counts, all words); word number i has id i + 2."""
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.vocab))[2:]
        return ids.tobytes(), list(self.vocab)[2:], counts, self.words


class WordIndex:
    """FM-index of a sequence of numbers from 0, where 0 separates; suffixes sorted to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        # the sequence is a ring of separated pieces: a suffix ends at its separator
        values, x = np.unique(np.concatenate([np.zeros(1, ids.dtype), ids]), return_inverse=True)
        x, width, ended = x.astype(np.int32), len(values), x == 0
        rank = x.astype(np.int64)
        for d in range(1, depth):
            follow = np.roll(x, -d)
            follow[ended] = 0
            ended |= follow == 0
            rank *= width
            rank += follow
            if d + 1 < depth:
                rank = np.unique(rank, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable").astype(np.int32)
        del rank, ended
        self.values, self.sa, self.depth = values, order, depth
        self.bwt = x[order - 1]
        #: rows of the transform in the order of their suffixes extended to the left
        self.last_to_first = np.argsort(self.bwt, kind="stable").astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=width))])

    def occ(self, word: int, row: int) -> int:
        """How often ``word`` stands before the suffixes of the first ``row`` rows."""
        rows = self.last_to_first[self.first[word]:self.first[word + 1]]
        return int(np.searchsorted(rows, row))

    def count(self, phrase: list[int]) -> int:
        """Occurrences of a phrase of at most ``depth`` words, by backward search."""
        low, high = 0, len(self.sa)
        for value in reversed(phrase):
            word = int(np.searchsorted(self.values, value))
            if word == len(self.values) or self.values[word] != value or value == 0:
                return 0
            low, high = (int(self.first[word]) + self.occ(word, r) for r in (low, high))
        return high - low

    def words(self) -> np.ndarray:
        """Interval number of every row at depth 1; -1 for separators."""
        return np.repeat(np.arange(-1, len(self.values) - 1, dtype=np.int32), np.diff(self.first))

    def extend(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All phrases one word longer, from the interval numbers of the rows at a depth.

        Returns the rows' new interval numbers (-1 in none) and per new interval its first row, its
        size, the interval it extends to the left, and the word put before.
        """
        rows = self.last_to_first
        word, old = self.bwt[rows], number[rows]
        inside = (word > 0) & (old >= 0)
        start = inside & np.concatenate([[True], (np.diff(word) != 0) | (np.diff(old) != 0)])
        new = np.where(inside, np.cumsum(start, dtype=np.int32) - 1, np.int32(-1))
        at = np.flatnonzero(start)
        size = np.bincount(new[inside], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        return new, at, size, old[at], word[at]


def cut_shards(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(shard, lang, ids, vocab, counts, n): the shards of all texts, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}

        def out(lang: str) -> pa.RecordBatch:
            ids, vocab, counts, n = open_.pop(lang).row()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([ids], pa.binary()), pa.array([[w.decode() for w in vocab]], pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([n], pa.int64())], ["lang", "ids", "vocab", "counts", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                lang = lang.as_py()
                shard = open_.setdefault(lang, Shard())
                shard.add(text.as_py())
                if shard.words >= words:
                    yield out(lang)
        for lang in list(open_):
            yield out(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).filter(F.length("text") > 0)
    shards = texts.mapInArrow(cut, "lang string, ids binary, vocab array<string>, counts array<int>, n long")
    return materialise(shards.withColumn("shard", F.monotonically_increasing_id()))


def recode(shards: DataFrame, words: DataFrame) -> DataFrame:
    """(shard, ids): shards over the ids of frequent words, 0 for separators and for other words."""
    local = shards.select("shard", "lang", F.posexplode("vocab").alias("i", "word"))
    known = local.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(
        F.collect_list("i").alias("at"), F.collect_list("id").alias("id"))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_py(), np.int32)
                new = np.zeros(b.column("size")[i].as_py() + 2, np.int32)
                at, to = (b.column(c)[i].values.to_numpy() for c in ("at", "id"))
                new[at + 2] = to
                ids = new[ids]
                # one separator says as much as many
                ids = ids[(ids > 0) | np.concatenate([[False], ids[:-1] > 0])]
                yield pa.RecordBatch.from_arrays([b.column("shard")[i:i + 1], pa.array([ids.tobytes()], pa.binary())], ["shard", "ids"])

    # a shard's two rows meet once; each is bounded by the shard's words
    both = shards.select("shard", "ids", F.size("vocab").alias("size")).join(known, "shard")
    return materialise(both.mapInArrow(change, "shard long, ids binary"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            index = WordIndex(np.frombuffer(b.column("ids")[i].as_py(), np.int32), 2)
            _, _, size, right, left = index.extend(index.words())
            key = (index.values[left].astype(np.int64) << ID_BITS) | index.values[right + 1]
            shard = pa.array(np.full(len(key), b.column("shard")[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([shard, pa.array(key), pa.array(size.astype(np.int32))], ["shard", "key", "n"])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            index = WordIndex(np.frombuffer(b.column("ids")[i].as_py(), np.int32), 3)
            frequent = np.sort(b.column("pairs")[i].values.to_numpy())
            number, _, _, right, left = index.extend(index.words())
            pair = (index.values[left].astype(np.int64) << ID_BITS) | index.values[right + 1]
            at = np.searchsorted(frequent, pair)
            known = frequent[np.minimum(at, len(frequent) - 1)] == pair
            # only intervals of frequent pairs are extended
            number = np.where((number >= 0) & known[number], number, -1)
            _, row, size, suffix, _ = index.extend(number)
            prefix = number[row]  # the interval without the last word holds the same rows
            row = prefix >= 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[prefix[row]]), pa.array(pair[suffix[row]]), pa.array(size[row].astype(np.int64))],
                ["xy", "yz", "n"])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, words: int = WORDS) -> dict[str, DataFrame]:
    """Frequent words (id, lang, word, f), pairs (key, f), triples (xy, yz, f), and words per language."""
    shards = cut_shards(docs, words)
    total = materialise(shards.groupBy("lang").agg(F.sum("n").cast("long").alias("n")))
    counted = shards.select("lang", F.explode(F.arrays_zip("vocab", "counts")).alias("w")).groupBy(
        "lang", F.col("w.vocab").alias("word")).agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= min_count)
    known = ordered_positions(counted, ["lang", "word"], "id").withColumn("id", F.col("id").cast("int"))
    known = materialise(known)
    coded = recode(shards, known)
    found = coded.mapInArrow(_pairs, "shard long, key long, n int").withColumn(
        "f", F.sum("n").over(W.partitionBy("key"))).filter(F.col("f") >= min_count)
    pairs_in = materialise(found.select("shard", "key", "f"))
    pairs = materialise(pairs_in.groupBy("key").agg(F.max("f").alias("f")))
    asked = coded.join(pairs_in.groupBy("shard").agg(F.collect_list("key").alias("pairs")), "shard")
    triples = materialise(asked.mapInArrow(_triples, "xy long, yz long, n long").groupBy("xy", "yz").agg(
        F.sum("n").alias("f")).filter(F.col("f") >= min_count))
    return {"total": total, "words": known, "pairs": pairs, "triples": triples}


def score(a, left, right):
    """floor(10^6 a a / (l r)), exact in 38 decimal digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER,
                 words: int = WORDS) -> DataFrame:
    """Each language's ``top`` phrases of two and three words."""
    found = phrase_counts(docs, min_count, words)
    known, pairs = found["words"], found["pairs"]
    high = lambda c: F.shiftright(c, ID_BITS).cast("int")
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")

    # one row per key on the right; a word that many phrases share is a skewed key, which Spark splits
    def of(df, key, name, *more):
        return df.join(known.select(F.col("id").alias(key), F.col("f").alias(name), *more), key)

    def pair(df, key, name):
        return df.join(pairs.select(F.col("key").alias(key), F.col("f").alias(name)), key)

    two = pairs.select("key", F.col("f").alias("a"), high("key").alias("x"), low("key").alias("y"))
    two = of(of(two, "x", "l", "lang"), "y", "r").select("lang", "x", "y", F.lit(0).alias("z"), "a", "l", "r", "key")
    three = found["triples"].select("xy", "yz", F.col("f").alias("a"), high("xy").alias("x"), low("xy").alias("y"), low("yz").alias("z"))
    three = pair(pair(of(of(three, "x", "fx", "lang"), "z", "fz"), "xy", "fxy"), "yz", "fyz")
    three = materialise(three)
    inside = three.select(F.explode(F.array(
        F.struct(F.col("xy").alias("key"), F.col("fxy").alias("f"), "a"),
        F.struct(F.col("yz").alias("key"), F.col("fyz").alias("f"), "a"))).alias("p")).select("p.*")
    covered = inside.filter(F.col("a") * 100 >= F.col("f") * cover).select("key").distinct()
    two = two.join(covered, "key", "left_anti").drop("key").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    one, other = score(F.col("a"), F.col("fx"), F.col("fyz")), score(F.col("a"), F.col("fxy"), F.col("fz"))
    three = three.withColumn("s1", one).withColumn("s2", other)
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", "x", "y", "z", "a", F.when(first, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
        F.when(first, F.col("fyz")).otherwise(F.col("fz")).alias("r"), F.least("s1", "s2").alias("score"))
    # ties of the last place stay until their words are known; a large language is cut down in slices first
    order = [F.desc("score"), F.desc("a")]
    best = two.unionByName(three).withColumn("_s", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SLICES)))
    for by in (("lang", "_s"), ("lang",)):
        best = best.withColumn("_r", F.rank().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= top)
    best = materialise(best.drop("_r", "_s"))
    word = known.select("id", "word")
    for c in "xyz":
        best = best.join(word.select(F.col("id").alias(c), F.col("word").alias(f"w{c}")), c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "wx", "wy", "wz"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).join(F.broadcast(found["total"]), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase",
        *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


OP12_SQL = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
w AS (
  SELECT piece, lang, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM (
    SELECT piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces)),
t AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, x, count(*)::HUGEINT AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*)::HUGEINT AS f FROM t WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}),
c3 AS (
  SELECT f3.lang, f3.x, f3.y, f3.z, f3.f AS a, u.f AS fx, v.f AS fz, p.f AS fxy, q.f AS fyz,
    (1000000 * a * a) // (fx * fyz) AS s1, (1000000 * a * a) // (fxy * fz) AS s2
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z
  JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z),
covered AS (
  SELECT lang, x, y FROM c3 WHERE 100 * a >= {COVER} * fxy UNION SELECT lang, y, z FROM c3 WHERE 100 * a >= {COVER} * fyz),
c2 AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, u.f AS l, v.f AS r, (1000000 * a * a) // (l * r) AS score
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
  WHERE f2.f >= {MIN_COUNT} AND (f2.lang, f2.x, f2.y) NOT IN (SELECT (lang, x, y) FROM covered)),
every_one AS (
  SELECT * FROM c2 UNION ALL
  SELECT lang, x || ' ' || y || ' ' || z, a, CASE WHEN s1 <= s2 THEN fx ELSE fxy END,
    CASE WHEN s1 <= s2 THEN fyz ELSE fz END, least(s1, s2) FROM c3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM every_one JOIN n USING (lang) QUALIFY rank <= {TOP}"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    """All documents: each language's first 2,000 phrases."""
    return collocations(table(spark, sf_dir, "documents"))
