"""Removal of byte strings that recur: suffix arrays by induced sorting, with permuted common prefixes.

Candidate stretches (see ``repeats``) are dealt to shards by the anchor their windows share. A shard's
distinct snippets are joined by separators and suffix-sorted: suffixes are classified, the leftmost
smaller ones' substrings are sorted by induction and named, the string of names is sorted, and the
whole array is induced from it in linear time. Induction is done bucket by bucket in numpy. The string
of names is sorted by doubling its ranks, since its alphabet is too large for buckets. Common prefixes
are computed in text order: only irreducible ones are compared, the others follow by subtraction.

Memory: a shard is about ``repeats.SHARD_BYTES`` of snippets, whatever the size of the corpus.

Defined results: NULL text is empty. Texts shorter than ``length`` bytes lose nothing. Rows that repeat
a text of at least ``length`` bytes lose all of it, as does any pair of copies. Overlapping windows of one
document count. What is left may end inside a UTF-8 character; it is treated as bytes. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import query, table
from veilspark.llm.repeats import covered, covered_mask, keyed
from veilspark.runtime import materialise

LENGTH = 200
GRAM = 48
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_SYMBOLS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. The last symbol is the unique smallest."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ahead = change[np.searchsorted(change, np.arange(n - 1))]
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = t[ahead] < t[ahead + 1]
    return smaller


def _deal(sa, items, chars, at, step):
    """Append ``items`` to the buckets of ``chars`` in order; ``at`` moves by ``step`` per item."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    count = np.bincount(chars, minlength=len(at))
    rank = np.arange(len(chars)) - (np.cumsum(count) - count)[chars]
    sa[at[chars] + step * rank] = items[order]
    at += step * count


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array induced from sorted leftmost-smaller suffixes (or their substrings)."""
    sa = np.full(len(t), -1, dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    per = np.bincount(t[lms], minlength=len(sizes))
    order = np.argsort(t[lms], kind="stable")
    sorted_lms = lms[order]
    upto = np.cumsum(per)
    at = starts.copy()
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < at[c]:
            seg, done = sa[done:at[c]], at[c]
            prev = seg[seg > 0] - 1
            prev = prev[~smaller[prev]]
            _deal(sa, prev, t[prev], at, 1)
        seg = sorted_lms[upto[c] - per[c]:upto[c]]
        prev = seg[seg > 0] - 1
        prev = prev[~smaller[prev]]
        _deal(sa, prev, t[prev], at, 1)
    larger_end = at
    at = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c] - 1
        while done > at[c]:
            seg, done = sa[at[c] + 1:done + 1][::-1], at[c]
            prev = seg[seg > 0] - 1
            prev = prev[smaller[prev]]
            _deal(sa, prev, t[prev], at, -1)
        seg = sa[starts[c]:larger_end[c]][::-1]
        prev = seg[seg > 0] - 1
        prev = prev[smaller[prev]]
        _deal(sa, prev, t[prev], at, -1)
    return sa


def _first_difference(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    step = 0
    pad = np.concatenate([t, np.arange(-1, -2, -1)])
    n = len(t)
    while len(live):
        x, y = a[live] + step, b[live] + step
        same = (np.maximum(x, y) < n) & (pad[np.minimum(x, n)] == pad[np.minimum(y, n)])
        out[live[~same]] = step
        live = live[same]
        step += 1
    return out


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling."""
    n, rank, width = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (rank.max() + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank.max() == n - 1 or width >= n:
            return order
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers ``t`` whose last element is the unique smallest."""
    if len(t) < 2:
        return np.arange(len(t))
    smaller = classify(t)
    sizes = np.bincount(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # a sentinel-only start: the last position is always leftmost smaller, unless nothing precedes it
    rough = induce(t, smaller, lms[np.argsort(t[lms], kind="stable")], sizes)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    # the sentinel suffix is first and induces others but is not itself induced
    rough = np.where(rough < 0, len(t) - 1, rough)
    in_order = rough[is_lms[rough]]
    in_order = in_order[np.sort(np.unique(in_order, return_index=True)[1])]
    last = len(t) - 1
    in_order = np.concatenate([[last], in_order[in_order != last]])
    nxt = np.full(len(t), last, dtype=np.int64)
    nxt[lms[:-1]] = lms[1:]
    span = nxt - np.arange(len(t)) + 1
    a, b = in_order[:-1], in_order[1:]
    same_len = span[a] == span[b]
    equal = np.zeros(len(a), dtype=bool)
    live = np.flatnonzero(same_len & (a != last) & (b != last))
    step = 0
    while len(live):
        ok = t[a[live] + step] == t[b[live] + step]
        live = live[ok]
        step += 1
        done = span[a[live]] == step
        equal[live[done]] = True
        live = live[~done]
    name = np.zeros(len(t), dtype=np.int64)
    name[in_order] = np.concatenate([[0], np.cumsum(~equal)])
    names = name[lms]
    order = np.argsort(names) if names.max() == len(names) - 1 else _sort_names(names)
    sa = induce(t, smaller, lms[order], sizes)
    sa[0] = last
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, phi) in text order: the common prefix of each suffix with its predecessor ``phi`` in the
    array. A value is one less than its left neighbour's unless the symbols before differ."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = np.where((at > 0) & (phi > 0), t[at - 1] == t[np.maximum(phi, 1) - 1], False) & (phi >= 0)
    head = np.flatnonzero(~before)
    has = phi[head] >= 0
    lcp = np.zeros(len(head), dtype=np.int64)
    lcp[has] = _first_difference(t, head[has], phi[head[has]])
    owner = np.searchsorted(head, at, side="right") - 1
    return np.maximum(lcp[owner] - (at - head[owner]), 0), phi


def recurring_starts(snippets: list[bytes], several: np.ndarray, length: int) -> list[np.ndarray]:
    """Per snippet the starts of its ``length``-byte strings that occur more than once in the shard."""
    raw = np.frombuffer(b"\0".join(snippets) + b"\0\0", dtype=np.uint8).astype(np.int64) + 2
    sizes = np.array([len(s) for s in snippets], dtype=np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    raw[(offsets + sizes)] = 1
    raw[-1] = 0
    sa = suffix_array(raw)
    lcp, phi = permuted_lcp(raw, sa)
    again = lcp >= length
    again[phi[again]] = True
    out = []
    for off, size, many in zip(offsets, sizes, several):
        n = size - length + 1
        out.append(np.arange(n) if many else np.flatnonzero(again[off:off + n]))
    return out


def match_bytes(snippets: list[bytes], several: np.ndarray) -> list[list[tuple[int, int]]]:
    spans = []
    for starts in recurring_starts(snippets, several, LENGTH):
        if not len(starts):
            spans.append([])
            continue
        cut = np.flatnonzero(np.diff(starts) > 1)
        first, last = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
        spans.append([(int(a), int(b) + LENGTH) for a, b in zip(first, last)])
    return spans


def _bytes(text: str) -> tuple[np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return _SYMBOLS[np.frombuffer(raw, dtype=np.uint8)], raw


def remove_recurring_bytes(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, digest of the rest and ``kept`` itself."""
    rows = keyed(docs.select("doc_id", "text"))
    spans = materialise(covered(rows, _bytes, lambda raw, lo, hi: raw[lo:hi], match_bytes, LENGTH, GRAM))

    def cut(batches):
        for batch in batches:
            out = []
            for text, stretches in zip(batch.column(1), batch.column(2)):
                raw, found = (text.as_py() or "").encode("utf-8", "surrogatepass"), stretches.as_py()
                if not found:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                gone = covered_mask(len(raw), found)
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(spans, "_key", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, SCHEMA + ", kept binary")


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    """All documents: what the removal of recurring 200-byte strings leaves."""
    return remove_recurring_bytes(table(spark, sf_dir, "documents")).drop("kept")
