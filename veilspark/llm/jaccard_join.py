"""N-gram Jaccard join: count-vector R-trees over families of candidates.

A document's set is its distinct 5-word shingles, as 48-bit hashes. Two sets link at Jaccard similarity
0.75 or more. A tree over all documents would prune nothing (chance differences of the counts are as
large as those the bound allows, and boxes in many dimensions overlap), so the tree works where it can:

1. Census: tasks send their shingle hashes sorted, delta-coded and dealt by range; owners count in how
   many sets each occurs and answer only for those in two or more.
2. Prefix rule: in the order of that count, linked sets share one of their first n - ceil(0.75 n) + 1
   shingles. Most documents end here, since that many of their shingles occur nowhere else.
3. Equal sets collapse to one. Sets that share a prefix shingle are chained; the connected families of
   these chains hold every link.
4. In a family, shingles are hashed into groups and the group counts are the points of an R-tree. The
   overlap of two boxes or points is at most the sum of the smaller coordinates; what survives is
   verified by intersecting the sets. Pairs known to be connected are skipped, so a family of near
   copies costs about one check per member.
5. Families above ``UNIT`` members are dealt by size class and hash into units, and unit against unit is
   a task; only size classes that can link meet.

48-bit hashes: a pair of sets of n shingles agrees wrongly on one with chance n * n / 2**48.

Defined results: NULL and blank texts have no shingles and link with nothing. A text of fewer than five
words is one shingle. A row without doc_id takes no part and has a NULL component. Rows that repeat an
id are one document. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import query, quoted, table
from veilspark.llm.components import Forest, components
from veilspark.llm.repeats import mix
from veilspark.runtime import materialise

WORDS = 5
#: Shingles a task gathers before it sends, and an owner is given on average.
CHUNK = 1 << 20
#: Groups the shingles are hashed into: the dimensions of the tree.
GROUPS = 32
FANOUT = 16
#: Members of a family, or of one of its size classes, that one task side holds.
UNIT = 2_000
#: Bytes of their sets, likewise.
UNIT_BYTES = 32 << 20
TASK_BYTES = 2 << 20

_ORD = np.uint64(0xFFFF)
_MANY = 0xFFFF
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingles of a whole text as sorted 64-bit hashes whose low 16 bits are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    n = len(raw)
    ids = np.fromiter(map(_words.__getitem__, raw), np.uint64, n)
    if n >= WORDS:
        sums = ids[:n - WORDS + 1] * _FACTORS[0]
        for i in range(1, WORDS):
            sums = sums + ids[i:n - WORDS + 1 + i] * _FACTORS[i]
    elif n:
        sums = (ids * np.array(_FACTORS[:n])).sum(keepdims=True) + np.uint64(n)
    else:
        return ids
    value = np.sort(mix(sums) & ~_ORD)
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = value[1:] != value[:-1]
    return value[keep]


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of ``x``, one plane after the other: small values compress to nothing."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _pack(tokens: np.ndarray, ords: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted tokens with their document ordinals and counts."""
    top = tokens >> np.uint64(16)
    delta = np.diff(top, prepend=np.uint64(0))
    return _planes(delta, 6) + _planes(ords, 2) + _planes(counts, 4)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 12
    tokens = np.cumsum(_unplanes(data[:6 * n], 6, n)) << np.uint64(16)
    return tokens, _unplanes(data[6 * n:8 * n], 2, n).astype(np.uint16), _unplanes(data[8 * n:], 4, n).astype(np.uint32)


_SENT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()),
                   ("facts", pa.binary())])
SENT = "part long, chunk long, data binary, ids binary, facts binary"


def _chunk_rows(ids: list[int], sets: list[np.ndarray], parts: int) -> list[tuple]:
    """What a task sends for a chunk: a blob per owner, and a row about the documents themselves."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    # two independent sums identify a set
    sums = [np.concatenate([[0], np.cumsum(mix(flat ^ np.uint64(k)))]).astype(np.uint64) for k in (1, 2)]
    marks = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
    both = np.sort(flat | np.repeat(np.arange(len(sets), dtype=np.uint64), sizes))
    token = both & ~_ORD
    head = np.ones(len(token), dtype=bool)
    head[1:] = token[1:] != token[:-1]
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(token)))
    lone = both[first] & _ORD
    lone[count > 1] = _MANY
    several = both[np.repeat(count > 1, count)]
    key = np.array(ids, dtype=np.int64)
    chunk = xxhash.xxh64_intdigest(key.tobytes() + sizes.tobytes()) >> 1
    owner = (token[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cut = np.searchsorted(owner, np.arange(parts + 1))
    rows = [(p, chunk, _pack(token[first][a:b], lone[a:b], count[a:b]), None, None)
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    # this row skips the census: shingles of several documents here, and what is known of each document
    rows.append((-1 - chunk % max(parts, 1), chunk, several.tobytes(), key.tobytes(),
                 np.stack([sizes, *marks]).tobytes()))
    return rows


def _send(parts: int):
    def run(batches):
        ids, sets, size = [], [], 0

        def flush():
            cols = zip(*_chunk_rows(ids, sets, parts))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT)], schema=_SENT)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py())
                ids.append(i)
                sets.append(found)
                size += len(found)
                if size >= CHUNK or len(ids) >= _MANY:
                    yield flush()
                    ids, sets, size = [], [], 0
        if ids:
            yield flush()

    return run


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """Census of one range: per chunk the shingles that occur in several sets, with their counts."""
    if pdf["part"].iloc[0] < 0:
        return pdf[["chunk", "data", "ids", "facts"]]
    blobs = [_unpack(x) for x in pdf["data"]]
    n_blobs = len(blobs)
    place = np.repeat(np.arange(n_blobs, dtype=np.int32), [len(b[0]) for b in blobs])
    token, lone, count = (np.concatenate(x) for x in zip(*blobs))
    # the largest arrays of the operator: each goes as soon as it has been used
    del blobs
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    total = np.add.reduceat(count[order].astype(np.int64), first)
    del count
    times = np.diff(np.append(first, len(token)))
    keep = np.repeat(total > 1, times)
    order, token = order[keep], token[keep]
    total = np.repeat(np.minimum(total, 2**32 - 1).astype(np.uint64)[total > 1], times[total > 1])
    place, lone = place[order], lone[order]
    by = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[by], np.arange(n_blobs + 1))
    data = [_pack(token[by[a:b]], lone[by[a:b]], total[by[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "data": data, "ids": None, "facts": None})


MEMBER = ("doc_id long, n long, mark1 long, mark2 long, common binary, prefix array<long>")


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per document of a chunk: size and identity of its set, and, if its prefix holds a shingle of
    several sets, those shingles and that prefix."""
    own = pdf["ids"].notna().to_numpy()
    about = pdf[own].iloc[0]
    ids = np.frombuffer(about["ids"], np.int64)
    sizes, mark1, mark2 = np.frombuffer(about["facts"], np.int64).reshape(3, -1)
    several = np.frombuffer(about["data"], np.uint64)
    blobs = [_unpack(x) for x in pdf["data"][~own]] or [(np.zeros(0, np.uint64),) * 3]
    token, lone, count = (np.concatenate(x) for x in zip(*blobs))
    order = np.argsort(token)
    token, lone, count = token[order], lone[order], count[order]
    where = np.searchsorted(token, several & ~_ORD) if len(several) else np.zeros(0, np.int64)
    single = lone != _MANY
    token2 = np.concatenate([token[single], several & ~_ORD])
    doc = np.concatenate([lone[single], several & _ORD]).astype(np.int64)
    count2 = np.concatenate([count[single], count[where]])
    shared = np.bincount(doc, minlength=len(ids))
    # shingles found nowhere else come first in the order and fill this much of the prefix
    room = sizes - (3 * sizes + 3) // 4 + 1 - (sizes - shared)
    live = (room > 0) & (sizes > 0)
    use = live[doc]
    token2, doc, count2 = token2[use], doc[use], count2[use]
    by = np.lexsort((token2, count2, doc))
    token2, doc = token2[by], doc[by]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    common, prefix = [None] * len(ids), [None] * len(ids)
    for d in np.flatnonzero(live):
        mine = token2[cut[d]:cut[d + 1]]
        prefix[d] = mine[:room[d]].view(np.int64)
        common[d] = np.sort(mine).tobytes()
    return pd.DataFrame({"doc_id": ids, "n": sizes, "mark1": mark1, "mark2": mark2, "common": common, "prefix": prefix})


class RTree:
    """Sort-tile-recursive tree over count vectors; each level holds boxes of ``FANOUT`` children."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        slab = max(1, int(np.ceil(np.sqrt(len(sizes) / FANOUT)))) * FANOUT
        by = np.argsort(sizes, kind="stable")
        tiles = [t[np.argsort(counts[t, 0], kind="stable")] for t in np.split(by, range(slab, len(by), slab))]
        self.order = np.concatenate(tiles)
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Which pairs of boxes (or points) i of ``a`` and j of ``b`` may hold a link: an overlap of at least
    3/7 of both sizes, and sizes within 3/4 of each other."""
    most = np.minimum(a[0][i][:, None, :], b[0][j][None, :, :]).sum(axis=2)
    low_a, low_b = a[1][i][:, None], b[1][j][None, :]
    fits = (4 * a[2][i][:, None] >= 3 * low_b) & (4 * b[2][j][None, :] >= 3 * low_a)
    return fits & (7 * most >= 3 * (low_a + low_b))


def join_trees(a: RTree, b: RTree, link, roots_a, roots_b) -> None:
    """Call ``link(x, y)`` for every pair of members that the bound lets through and that is not yet
    connected. ``roots_*`` give the current component of members by position in the tree."""
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            if not same or i < j:
                link(a.order[i], b.order[j])
            continue
        left = a.children(la, i) if la and la >= lb else np.array([i])
        right = b.children(lb, j) if lb and lb >= la else np.array([j])
        na, nb = (la - 1 if la and la >= lb else la), (lb - 1 if lb and lb >= la else lb)
        ok = possible(a.levels[na], left, b.levels[nb], right)
        if same and na == nb:
            ok &= left[:, None] <= right[None, :]
        if na == 0 and nb == 0:
            ok &= roots_a(left)[:, None] != roots_b(right)[None, :]
        stack += [(na, int(left[x]), nb, int(right[y])) for x, y in zip(*np.nonzero(ok))]


def link_family(ids: np.ndarray, sizes: np.ndarray, common: list[bytes], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among the members (across the sides, if there are two)."""
    sets = [np.frombuffer(c, np.uint64) for c in common]
    counts = np.stack([np.bincount((s >> np.uint64(17)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets])
    # shingles outside ``common`` occur in one set only: they count in the size, never in an overlap
    forest, out = Forest(), []

    def link(x, y):
        if forest.find(int(x)) == forest.find(int(y)):
            return
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= 75 * (sizes[x] + sizes[y] - both):
            forest.union(int(x), int(y))
            out.append((int(ids[x]), int(ids[y])))

    groups = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = []
    for g in groups:
        tree = RTree(counts[g], sizes[g])
        tree.order = g[tree.order]
        trees.append(tree)
    root = lambda t: lambda at: np.array([forest.find(int(m)) for m in t.order[at]])
    join_trees(trees[0], trees[-1], link, root(trees[0]), root(trees[-1]))
    return out


def _link_tasks(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, rows in pdf.groupby("task", sort=False):
        out += link_family(rows["doc_id"].to_numpy(), rows["n"].to_numpy(), rows["common"].tolist(), rows["side"].to_numpy())
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _tasks(members: DataFrame) -> DataFrame:
    """Members (doc_id, n, common, family) dealt to tasks. A family of at most ``UNIT`` members and
    ``UNIT_BYTES`` is one task. A larger one is cut into units by size class and hash, and units that may
    link are paired."""
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    members = members.withColumn("cls", cls)
    sizes = members.groupBy("family", "cls").agg(
        F.greatest(F.count(F.lit(1)) / UNIT, F.sum(F.length("common")) / UNIT_BYTES).alias("u"))
    sizes = sizes.withColumn("_all", F.sum("u").over(W.partitionBy("family")))
    large = materialise(sizes.filter(F.col("_all") > 1).select("family", "cls", F.ceil("u").cast("int").alias("units")))
    small = members.join(large.select("family").distinct(), "family", "left_anti").select(
        F.xxhash64("family").alias("task"), F.lit(0).alias("side"), "doc_id", "n", "common")
    near = large.select("family", (F.col("cls") - 1).alias("cls"), F.col("units").alias("units_up"))
    near = near.join(large.select("family", "cls"), ["family", "cls"])
    below = large.select("family", (F.col("cls") + 1).alias("cls"), F.col("units").alias("units_down"))
    placed = (
        members.join(large, ["family", "cls"]).join(near, ["family", "cls"], "left").join(below, ["family", "cls"], "left")
        .withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.col("units")).cast("int"))
    )
    unit = F.col("unit")
    to = lambda c1, u1, c2, u2, side: F.struct(
        F.xxhash64("family", c1, u1, c2, u2).alias("task"), F.lit(side).alias("side"))
    one = F.col("cls")
    pairs = F.concat(
        F.transform(F.sequence(unit, F.col("units") - 1), lambda u: to(one, unit, one, u, 0)),
        F.filter(F.transform(F.sequence(F.lit(0), unit), lambda u: F.when(u < unit, to(one, u, one, unit, 1))),
                 lambda s: s.isNotNull()),
        F.coalesce(F.transform(F.sequence(F.lit(0), F.col("units_up") - 1), lambda u: to(one, unit, one + 1, u, 0)), F.array()),
        F.coalesce(F.transform(F.sequence(F.lit(0), F.col("units_down") - 1), lambda u: to(one - 1, u, one, unit, 1)), F.array()))
    spread = placed.select(F.explode(pairs).alias("_t"), "doc_id", "n", "common").select(
        "_t.task", "_t.side", "doc_id", "n", "common")
    return small.unionByName(spread)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the component is the smallest doc_id that
    links reach."""
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // (6 * CHUNK)))
    census = rows.mapInArrow(_send(parts), SENT).groupBy("part").applyInPandas(
        _own, "chunk long, data binary, ids binary, facts binary")
    members = materialise(census.groupBy("chunk").applyInPandas(_candidates, MEMBER))
    marks = ["n", "mark1", "mark2"]
    sets = members.filter(F.col("n") > 0).groupBy(*marks).agg(F.min("doc_id").alias("set_id"))
    sets = materialise(members.join(sets, marks, "left").select("doc_id", *marks, "set_id"))
    chosen = members.filter(F.col("prefix").isNotNull()).join(
        sets.filter(F.col("doc_id") == F.col("set_id")).select("doc_id", *marks).distinct(), ["doc_id", *marks]
    ).dropDuplicates(["doc_id", *marks])
    chosen = materialise(chosen)
    entry = chosen.select("doc_id", F.explode("prefix").alias("token"))
    chain = F.lag("doc_id").over(W.partitionBy("token").orderBy("doc_id"))
    edges = entry.select(F.col("doc_id").alias("a"), chain.alias("b")).filter("b is not null").distinct()
    family = components(edges)
    members_of = chosen.join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    members_of = materialise(members_of.select("doc_id", "n", "common", "family"))
    size = members_of.agg(F.coalesce(F.sum(F.length("common")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // TASK_BYTES))
    links = materialise(
        _tasks(members_of).withColumn("_bucket", F.pmod("task", F.lit(buckets))).groupBy("_bucket")
        .applyInPandas(_link_tasks, "a long, b long"))
    linked = components(links).select(F.col("node").alias("set_id"), "component")
    known = sets.join(linked, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", "set_id", "doc_id").alias("component_id"))
    lost = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text")
    return known.unionByName(_without_id(lost))


def _without_id(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = pa.array([len(shingles(t)) for t in batch.column(1).to_pylist()], pa.int64())
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, n, none], ["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def one_per_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near duplicates one row stays, that with the smallest id (a NULL
    id is last), and of equal ids the first in the table. Rows are judged by themselves, so different texts
    that share an id stay and copies go, with a repeated id or none. They travel as one column, so no name
    of theirs can clash."""
    # written, so that a row keeps its number
    rows = materialise(docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"),
                                   F.monotonically_increasing_id().alias("nr")))
    found = near_duplicates(rows.select(F.col("nr").alias("doc_id"), F.col("row.text").alias("text")))
    found = materialise(found.select(F.col("doc_id").alias("nr"), F.col("component_id").alias("group")))
    several = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    order = F.struct(F.col("id").isNull(), "id", "nr")
    members = found.join(several, "group").join(rows.select("nr", F.col("row.doc_id").alias("id")), "nr")
    members = materialise(members.select("group", order.alias("place")))
    first = members.groupBy("group").agg(F.min("place").alias("first"))
    gone = members.join(first, "group").filter(F.col("place") != F.col("first")).select("place.nr")
    kept = rows.join(materialise(gone), "nr", "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    """All documents with the size of their set and their group."""
    return near_duplicates(table(spark, sf_dir, "documents"))
