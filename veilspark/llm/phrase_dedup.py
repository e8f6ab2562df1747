"""Removal of repeated passages: Aho-Corasick automata over confirmed phrases.

Recurring passages are confirmed by counting: candidate stretches (see ``repeats``) meet in shards by
the anchor phrase their windows share, windows that occur more than once there are counted, and
consecutive ones are joined to passages. Each shard compiles its passages into one automaton over word
numbers, and streams every stretch of every document that holds one of its anchors through it; what the
automaton finds is removed. Together the shards see every candidate word of every document, and an
automaton's size depends on the shard alone.

Defined results: NULL text has no words. Documents with fewer than ``length`` words lose nothing. Rows
that repeat a text of at least ``length`` words lose all of it, as does any pair of copies. Words are
compared as they are. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from veilspark.llm.common import query, table
from veilspark.llm.repeats import covered, covered_mask, gram_hashes, keyed, mix
from veilspark.runtime import materialise

LENGTH = 35
GRAM = 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Words(dict):
    """Hash of each word, kept for the words a task meets again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _symbols(text: str) -> tuple[np.ndarray, list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_words.__getitem__, raw), np.uint64, len(raw)), raw


def confirmed_passages(seqs: list[np.ndarray], several: np.ndarray, length: int) -> set[tuple[int, ...]]:
    """Maximal runs of windows that occur more than once among the shard's stretches."""
    sizes = np.array([len(s) for s in seqs], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    flat = np.concatenate(seqs)
    windows = np.maximum(sizes - length + 1, 0)
    # in parts, so that the prefix sums of the hashes stay in their range
    hashes = np.zeros(len(flat), dtype=np.uint64)
    step = 1 << 20
    for at in range(0, len(flat), step):
        part = mix(flat[at:at + step + length - 1].astype(np.uint64) + np.uint64(1))
        if len(part) >= length:
            value = gram_hashes(part, length)
            hashes[at:at + len(value)] = value
    owner = np.repeat(np.arange(len(seqs)), windows)
    start = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    _, where, times = np.unique(hashes[offsets[owner] + start], return_inverse=True, return_counts=True)
    good = (times[where] > 1) | several[owner]
    if not good.any():
        return set()
    owner, start = owner[good], start[good]
    head = np.ones(len(owner), dtype=bool)
    head[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(owner)) - 1
    return {tuple(seqs[owner[a]][start[a]:start[b] + length].tolist()) for a, b in zip(first, last)}


def match_phrases(snippets: list[bytes], several: np.ndarray) -> list[list[tuple[int, int]]]:
    number: dict[bytes, int] = {}
    seqs = []
    for s in snippets:
        raw = s.split(b" ")
        seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in raw), np.int64, len(raw)))
    passages = confirmed_passages(seqs, several, LENGTH)
    if not passages:
        return [[] for _ in snippets]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return [[(end - size + 1, end + 1) for end, size in automaton.iter(tuple(seq.tolist()))] for seq in seqs]


def remove_repeated_phrases(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, digest of the rest and ``kept`` itself."""
    rows = keyed(docs.select("doc_id", "text"))
    spans = materialise(covered(
        rows, _symbols, lambda raw, lo, hi: b" ".join(raw[lo:hi]), match_phrases, LENGTH, GRAM))

    def cut(batches):
        for batch in batches:
            out = []
            for text, stretches in zip(batch.column(1), batch.column(2)):
                raw, found = (text.as_py() or "").encode("utf-8", "surrogatepass").split(), stretches.as_py()
                gone, n = 0, len(raw)
                if found:
                    mask = covered_mask(n, found)
                    gone = int(mask.sum())
                    raw = [w for w, m in zip(raw, mask.tolist()) if not m]
                kept = b" ".join(raw)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(spans, "_key", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, SCHEMA + ", kept binary")


@query("op7_phrase_dedup")
def op7(spark, sf_dir):
    """All documents: what the removal of repeated 35-word passages leaves."""
    return remove_repeated_phrases(table(spark, sf_dir, "documents")).drop("kept")
