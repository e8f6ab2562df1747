"""Where windows of a fixed length recur anywhere in a corpus: what the two span removals share.

A window is ``length`` consecutive symbols (bytes, words) of one document. Its anchor is its gram of
``gram`` symbols with the smallest hash, so equal windows have equal anchors at equal offsets. Anchors
are about two per window length, so they are cheap to count:

1. Every document sends the hashes of its anchors; those that occur once in the corpus are dropped.
2. Documents that hold recurring anchors send, per such anchor, the snippet that all windows with this
   anchor make up. Equal windows meet, since snippets are dealt by anchor.
3. An exact matcher (the operator's own) finds the recurring windows among a shard's snippets.
4. The covered stretches go back to their documents.

Pre-aggregation: what a task sees twice itself is recurring already. It votes once for all its
occurrences, and sends one snippet for all equal ones, so a passage that a third of all documents share
costs each shard one row per task batch. Hashes only select; every removal rests on an exact match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.runtime import materialise

#: Symbols handled at once; positions in a batch fit in 21 bits.
BATCH = 1 << 20
_POS = np.uint64((1 << 21) - 1)
#: Bytes of snippets a shard should hold.
SHARD_BYTES = 3 << 20

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: list[np.ndarray] = []


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` symbols (uint64), by prefix sums modulo 2**64."""
    if not _powers:
        size = 2 * BATCH + 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    n = len(symbols)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * _powers[0][:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _powers[1][:n - gram + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


@dataclass
class Anchors:
    """Anchors of a batch of pieces: piece index, hash, and the first and last window start (in the
    piece) that have this anchor."""

    piece: np.ndarray
    value: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors_of(pieces: list[np.ndarray], length: int, gram: int) -> Anchors:
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none.astype(np.uint64), none, none)
    hashes = gram_hashes(np.concatenate(pieces), gram)
    ranked = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
    best = sliding_min(ranked, length - gram + 1)
    piece = np.repeat(np.arange(len(pieces)), windows)
    start = runs_of(windows)
    at = (best[offsets[piece] + start] & _POS).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return Anchors(piece[head], hashes[at[head]], start[head], start[tail])


def batches_of(docs: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """Lists of (key, shift, symbols, raw) of at most about ``BATCH`` symbols. A longer document comes
    in pieces that overlap by ``length - 1`` symbols, so each of its windows is in exactly one."""
    out, size = [], 0
    for key, symbols, raw in docs:
        if len(symbols) < length:
            continue
        for shift in range(0, len(symbols) - length + 1, BATCH - length):
            end = min(shift + BATCH - 1, len(symbols))
            if size + end - shift > BATCH and out:
                yield out
                out, size = [], 0
            out.append((key, shift, symbols[shift:end], raw))
            size += end - shift
    if out:
        yield out


def _rows(batches, symbols_of):
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for i, text in enumerate(batch.column(1)):
            yield (int(keys[i]), *symbols_of(text.as_py() or ""))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key that stands for a row: rows equal in id and text share it."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def recurring_anchors(docs: DataFrame, symbols_of: Callable, length: int, gram: int) -> DataFrame:
    """(_key, hashes): the anchors of each document that recur in the corpus."""

    def send(batches):
        for pieces in batches_of(_rows(batches, symbols_of), length):
            found = anchors_of([p[2] for p in pieces], length, gram)
            keys = np.array([p[0] for p in pieces], dtype=np.int64)[found.piece]
            value = found.value.view(np.int64)
            kinds, where, times = np.unique(value, return_inverse=True, return_counts=True)
            known = times[where] > 1
            pairs = np.unique(np.stack([keys[known], value[known]]), axis=1) if known.any() else np.zeros((2, 0), np.int64)
            votes = kinds[times > 1]
            own = mix(pairs[0].view(np.uint64)).view(np.int64)
            group = np.concatenate([value[~known], own, votes])
            out_value = np.concatenate([value[~known], pairs[1], votes])
            out_key = np.concatenate([keys[~known], pairs[0], np.zeros(len(votes), np.int64)])
            absent = np.zeros(len(group), dtype=bool)
            absent[len(group) - len(votes):] = True
            count = np.full(len(group), 2, dtype=np.int8)
            count[:int((~known).sum())] = 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(out_value), pa.array(out_key, mask=absent), pa.array(count)],
                ["grp", "value", "_key", "n"])

    sent = docs.select("_key", "text").mapInArrow(send, "grp long, value long, _key long, n byte")
    total = F.sum("n").over(W.partitionBy("grp"))
    hits = sent.withColumn("total", total).filter((F.col("total") > 1) & F.col("_key").isNotNull())
    return hits.groupBy("_key").agg(F.collect_set("value").alias("hashes"))


def covered(docs: DataFrame, symbols_of: Callable, snippet_of: Callable, match: Callable, length: int,
            gram: int) -> DataFrame:
    """(_key, spans): per document the stretches [lo, hi) of symbols that recurring windows cover.

    ``symbols_of(text)`` gives (uint64 symbols, raw); ``snippet_of(raw, lo, hi)`` the bytes of a stretch;
    ``match(snippets, several)`` for a shard's distinct snippets, and whether each occurs more than once,
    a list of stretches per snippet.
    """
    hits = materialise(recurring_anchors(docs, symbols_of, length, gram))
    n = hits.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    symbol_bytes = 1 if length > 100 else 6
    shards = max(1, -(-n * int(1.4 * length) * symbol_bytes // SHARD_BYTES))

    def send(batches):
        for batch in batches:
            wanted = {}
            for k, h in zip(batch.column(0).to_pylist(), batch.column(2)):
                wanted[k] = h.values.to_numpy(zero_copy_only=False)
            for pieces in batches_of(_rows([batch], symbols_of), length):
                found = anchors_of([p[2] for p in pieces], length, gram)
                ask = np.unique(np.concatenate([wanted[p[0]] for p in pieces]))
                take = np.flatnonzero(np.isin(found.value.view(np.int64), ask))
                snippets: dict[bytes, list] = {}
                for i in take:
                    key, shift, _, raw = pieces[found.piece[i]]
                    lo, hi = shift + int(found.first[i]), shift + int(found.last[i]) + length
                    snippets.setdefault(snippet_of(raw, lo, hi), []).append((key, lo, hi, int(found.value[i])))
                rows = []
                for snippet, places in snippets.items():
                    several = len(places) > 1
                    key, lo, hi, value = places[0]
                    rows.append((value % shards, snippet, None if several else key, lo, hi))
                    if several:
                        rows += [(shards + (k & 0x7FFFFFFF) % shards, None, k, x, y) for k, x, y, _ in places]
                cols = list(zip(*rows)) if rows else [()] * 5
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["shard", "snippet", "_key", "lo", "hi"])

    def in_shard(pdf):
        import pandas as pd

        direct = pdf[pdf["snippet"].isna()]
        out = [direct[["_key", "lo", "hi"]].astype("int64")]
        rows = pdf[pdf["snippet"].notna()]
        if len(rows):
            code, kinds = pd.factorize(rows["snippet"])
            asked = rows["_key"].notna().to_numpy()
            several = np.bincount(code) > 1
            several[code[~asked]] = True
            spans = match(list(kinds), several)
            back = [(int(k), int(lo) + x, int(lo) + y)
                    for k, lo, c in zip(rows["_key"][asked], rows["lo"][asked], code[asked]) for x, y in spans[c]]
            out.append(pd.DataFrame(back, columns=["_key", "lo", "hi"], dtype="int64"))
        return pd.concat(out)

    asked = docs.join(hits, "_key").select("_key", "text", "hashes")
    snippets = asked.mapInArrow(send, "shard long, snippet binary, _key long, lo long, hi long")
    # the key travels as text through pandas, which would round a nullable integer
    snippets = snippets.withColumn("_key", F.col("_key").cast("string"))
    spans = snippets.groupBy("shard").applyInPandas(in_shard, "_key long, lo long, hi long")
    return spans.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def covered_mask(n: int, spans: list) -> np.ndarray:
    """Which of ``n`` symbols the stretches cover."""
    edge = np.zeros(n + 1, dtype=np.int32)
    if spans:
        ends = np.array([(s["lo"], s["hi"]) for s in spans], dtype=np.int64)
        np.add.at(edge, ends[:, 0], 1)
        np.add.at(edge, ends[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0
