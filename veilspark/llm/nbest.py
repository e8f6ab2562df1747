"""N-best segmentation over a SentencePiece vocabulary, and decoding.

The lattice holds every vocabulary piece at every place; a character no piece covers falls back to its
bytes. A segmentation's score is the sum of its pieces' scores in the vocabulary file. Forward Viterbi
gives the best score of every prefix; a backward A* search uses these as exact estimates of what is
left, so it takes complete segmentations from the agenda in order of score.

No piece crosses from a character to a following word mark, so a lattice falls into units (a word with
the marks before it) that are searched once and kept. A document's n best are composed from its units'
n best: only the n - 1 units that lose least by their second choice can differ from the best.

Decoding joins pieces and bytes and turns marks into blanks. A literal mark character in a text is
encoded as bytes, so decoding gives back every text exactly.

Defined results: NULL text gives NULL pieces, the empty text none; both with score 0. Ties in score are
broken by the agenda's order, which depends on the text alone. Repeated rows get equal answers. An empty
table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import query, table
from veilspark.llm.repeats import runs_of

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
N_BEST = 4
#: Units a worker keeps; before more, it forgets those that few documents hold. Workers outlive their tasks, so
#: what they keep adds to the memory of every later stage of a job.
CACHE_UNITS = 200_000
#: Units whose further segmentations a worker keeps.
CACHE_CHOICES = 8_000
#: Characters of text whose new units are learned together.
CHUNK_CHARS = 1_000_000
#: Units up to this length are learned together, one length at a time.
SHORT_UNIT = 32
#: Units of a length learned at once: their arrays stay in the processor's cache.
GROUP_UNITS = 1024
MARK = "▁"
#: Stands for a literal mark in a text; no piece holds it.
_LITERAL = ""
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """Vocabulary of a SentencePiece file, and the units segmented so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {}
        self.score: dict[str, tuple[int, float]] = {}
        self.text: list[str | None] = [None] * n
        self.byte_of: dict[int, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value], self.byte_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.score[piece] = (i, sp.get_score(i))
                self.text[i] = piece.replace(MARK, " ")
        for i, value in self.byte_of.items():
            if value < 0x80:  # a whole character by itself
                self.text[i] = chr(value)
        self.longest = max(map(len, self.score))
        # pieces outside the ranking carry one very low score; bytes cost a little more than the rarest ranked piece
        self.fallback = min(s for _, s in self.score.values() if s > -1e8) - 10.0
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece crosses into the next word")
        self._reset()
        self.second: dict[tuple[str, int], list] = {}
        self._build_trie()

    def _build_trie(self):
        """The pieces as a trie in arrays: sorted keys (node, character class) and the nodes they lead to."""
        alphabet = sorted({c for p in self.score for c in p})
        self.classes = np.full(0x110000, -1, np.int32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        of = {c: i for i, c in enumerate(alphabet)}
        steps: dict[int, int] = {}
        ends = {}
        for piece, (i, score) in self.score.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node * len(alphabet) + of[c], len(steps) + 1)
            ends[node] = i, score
        self.fan = len(alphabet)
        keys, into = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.into = keys[order], into[order]
        self.node_id, self.node_score = np.zeros(len(steps) + 1, np.int64), np.full(len(steps) + 1, -np.inf)
        for node, (i, score) in ends.items():
            self.node_id[node], self.node_score[node] = i, score

    def _reset(self):
        """Units met so far: number, best score, loss of the second choice, ids of the best."""
        self.units: dict[str, int] = {}
        self.best, self.loss = np.zeros(1 << 16), np.zeros(1 << 16)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.seen = np.zeros(1 << 16, np.uint8)  # documents that held it, up to 255
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def lattice(self, unit: str) -> tuple[list[float], list[list]]:
        """Forward Viterbi: the best score of every prefix, and the pieces (start, ids, score) that end
        at every place."""
        get, longest = self.score.get, self.longest
        best, into = [0.0], [[]]
        for end in range(1, len(unit) + 1):
            here, top, hit = [], float("-inf"), None
            for start in range(max(0, end - longest), end):
                hit = get(unit[start:end])
                if hit is not None:
                    here.append((start, hit[0], hit[1]))
                    if best[start] + hit[1] > top:
                        top = best[start] + hit[1]
            if hit is None:  # no piece for the last character itself
                raw = unit[end - 1].replace(_LITERAL, MARK).encode("utf-8", "surrogatepass")
                here.append((end - 1, tuple(self.byte[b] for b in raw), self.fallback))
                top = max(top, best[end - 1] + self.fallback)
            best.append(top)
            into.append(here)
        return best, into

    def two_best(self, unit: str) -> tuple[float, float, list[int]]:
        """Forward Viterbi that also carries the second score: enough to know how much a unit loses by
        its second choice, so that only a document's few closest units need the search."""
        get, longest = self.score.get, self.longest
        one, two, back = [0.0], [float("-inf")], [None]
        for end in range(1, len(unit) + 1):
            a = b = float("-inf")
            came = hit = None
            for start in range(end - longest if end > longest else 0, end):
                hit = get(unit[start:end])
                if hit is not None:
                    v = one[start] + hit[1]
                    if v > a:
                        w = two[start] + hit[1]
                        b = a if a > w else w
                        a, came = v, (start, hit[0])
                    elif v > b:
                        b = v
            if hit is None:
                raw = unit[end - 1].replace(_LITERAL, MARK).encode("utf-8", "surrogatepass")
                v, w = one[end - 1] + self.fallback, two[end - 1] + self.fallback
                if v > a:
                    a, b, came = v, max(a, w), (end - 1, tuple(self.byte[x] for x in raw))
                else:
                    b = max(b, v)
            one.append(a)
            two.append(b)
            back.append(came)
        ids, at = [], len(unit)
        while at:
            at, piece = back[at]
            ids.append(piece)
        return one[-1], two[-1], [i for p in reversed(ids) for i in (p if isinstance(p, tuple) else (p,))]

    def two_best_of(self, units: list[str]) -> list[tuple[float, float, list[int]]]:
        """``two_best`` of units of one length, all at once: places are rows, units are columns."""
        length, many = len(units[0]), len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, length)
        kinds = self.classes[chars].T.astype(np.int64)
        ids, weights = [], []  # by piece length: number and score of the piece that starts at each place
        nodes = np.zeros((length, many), np.int64)
        for n in range(min(length, self.longest)):
            nodes, kind = nodes[:length - n], kinds[n:]
            live = np.flatnonzero((nodes.ravel() >= 0) & (kind.ravel() >= 0))
            if not len(live):
                break
            key = nodes.ravel()[live] * self.fan + kind.ravel()[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            after = np.full(nodes.size, -1, np.int64)
            after[live] = np.where(self.keys[at] == key, self.into[at], -1)
            nodes = after.reshape(nodes.shape)
            weights.append(np.where(nodes >= 0, self.node_score[nodes], -np.inf))
            ids.append(self.node_id[nodes])
        one, two = np.full((length + 1, many), -np.inf), np.full((length + 1, many), -np.inf)
        one[0] = 0.0
        back, came = np.zeros((length + 1, many), np.int64), np.zeros((length + 1, many), np.int64)
        for end in range(1, length + 1):
            a, b = one[end], two[end]
            for start in range(max(0, end - len(weights)), end):
                w = weights[end - start - 1][start]
                v = one[start] + w
                up = v > a
                b[:] = np.where(up, np.maximum(a, two[start] + w), np.maximum(b, v))
                a[up], back[end][up], came[end][up] = v[up], start, ids[end - start - 1][start][up]
            bare = np.ones(many, bool) if not weights else weights[0][end - 1] == -np.inf
            if bare.any():
                v = np.where(bare, one[end - 1] + self.fallback, -np.inf)
                up = v > a
                b[:] = np.where(up, np.maximum(a, np.where(bare, two[end - 1] + self.fallback, -np.inf)), np.maximum(b, v))
                a[up], back[end][up], came[end][up] = v[up], end - 1, -1
        out = []
        for unit, first, other, froms, pieces_ in zip(units, one[-1].tolist(), two[-1].tolist(), back.T.tolist(), came.T.tolist()):
            found, at = [], length
            while at:
                if pieces_[at] < 0:
                    raw = unit[at - 1].replace(_LITERAL, MARK).encode("utf-8", "surrogatepass")
                    found += [self.byte[x] for x in reversed(raw)]
                else:
                    found.append(pieces_[at])
                at = froms[at]
            out.append((first, other, found[::-1]))
        return out

    def segment(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a unit: backward A* guided by the forward scores."""
        best, into = self.lattice(unit)
        agenda, out, made = [(-best[-1], 0, len(unit), 0.0, None)], [], 0
        pop, push = heapq.heappop, heapq.heappush
        while agenda and len(out) < n:
            _, _, at, behind, tail = pop(agenda)
            if at == 0:
                ids = []
                while tail:
                    ids += tail[0] if isinstance(tail[0], tuple) else (tail[0],)
                    tail = tail[1]
                out.append((behind, ids))
                continue
            for start, piece, w in into[at]:
                made += 1
                push(agenda, (-(best[start] + behind + w), made, start, behind + w, (piece, tail)))
        return out

    def learn(self, units: set[str]):
        """Add the units not met so far."""
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > CACHE_UNITS:
            self._forget()
            new = [u for u in units if u not in self.units]
        by_length: dict[int, list[str]] = {}
        for u in new:
            by_length.setdefault(len(u), []).append(u)
        for length, some in by_length.items():
            for i in range(0, len(some), GROUP_UNITS):
                part = some[i:i + GROUP_UNITS]
                self._add(part, self.two_best_of(part) if length <= SHORT_UNIT else list(map(self.two_best, part)))

    def _add(self, units: list[str], found: list[tuple[float, float, list[int]]]):
        known = len(self.units)
        self.units.update(zip(units, range(known, known + len(units))))
        first, other, ids = zip(*found)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        best, used = np.array(first), self.used + int(size.sum())
        self._write("best", known, best)
        self._write("loss", known, best - np.array(other))
        self._write("size", known, size)
        self._write("start", known, self.used + np.cumsum(size) - size)
        self._write("seen", known, np.zeros(len(units), np.uint8))
        self._write("ids", self.used, np.fromiter(chain.from_iterable(ids), np.int32, used - self.used))
        self.used = used

    def _forget(self):
        """Keep at most half of what may be kept: the units that most documents held lately."""
        seen = self.seen[:len(self.units)]
        fewest = 2
        while (seen >= fewest).sum() > CACHE_UNITS // 2 and fewest < 255:
            fewest += 1
        keep = np.flatnonzero(seen >= fewest)[:CACHE_UNITS // 2]
        names = list(self.units)
        units = [names[i] for i in keep.tolist()]
        best, loss, size = self.best[keep], self.loss[keep], self.size[keep]
        ids = self.ids[np.repeat(self.start[keep], size) + runs_of(size)]
        self._reset()
        self.units.update(zip(units, range(len(units))))
        for name, values in (("best", best), ("loss", loss), ("size", size), ("start", np.cumsum(size) - size)):
            self._write(name, 0, values)
        self._write("ids", 0, ids)
        self._write("seen", 0, np.zeros(len(units), np.uint8))
        self.used = len(ids)

    def _write(self, name: str, at: int, values: np.ndarray):
        """Put values into an array that grows by doubling."""
        old = getattr(self, name)
        while at + len(values) > len(old):
            old = np.concatenate([old, np.zeros_like(old)])
        old[at:at + len(values)] = values
        setattr(self, name, old)

    def choices(self, unit: str, n: int) -> list:
        found = self.second.get((unit, n))
        if found is None:
            if len(self.second) >= CACHE_CHOICES:
                self.second.clear()
            found = self.second[unit, n] = self.segment(unit, n)
        return found

    def encode(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best segmentations of a whole text, best first."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """``encode`` of each text in turn; units that are new in some of them are learned together."""
        for some in _chunks(texts, CHUNK_CHARS):
            parts = [_UNITS.findall(MARK + t.replace(MARK, _LITERAL).replace(" ", MARK)) if t else [] for t in some]
            self.learn(set().union(*parts))
            for units in parts:
                yield self._compose(units, n)

    def _compose(self, units: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        if not units:
            return [(0.0, np.zeros(0, np.int32))]
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        self.seen[at] = np.minimum(self.seen[at], 254) + 1
        base, size = float(self.best[at].sum()), self.size[at]
        ids = self.ids[np.repeat(self.start[at], size) + runs_of(size)]
        loss = self.loss[at]
        few = np.arange(len(at))
        if len(at) > n - 1:
            few = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1]) if n > 1 else few[:0]
        few = few[np.isfinite(loss[few])]
        few = few[np.lexsort((few, loss[few]))][:n - 1]
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for i in few.tolist():
            options = self.choices(units[i], n)
            steps = [(options[0][0] - score, j) for j, (score, _) in enumerate(options)]
            sums = sorted((a + d, (*c, (i, j)) if j else c) for a, c in sums for d, j in steps)[:n]
        out, ends = [], np.cumsum(size)
        for lost, choice in sums:
            parts, done = [], 0
            pick = dict.fromkeys(few.tolist(), 0) | dict(choice)
            for i, j in sorted(pick.items()):
                parts += [ids[done:ends[i] - size[i]], np.array(self.choices(units[i], n)[j][1], np.int32)]
                done = ends[i]
            out.append((base - lost, np.concatenate([*parts, ids[done:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation."""
        found = list(map(self.text.__getitem__, ids.tolist()))
        if None not in found:
            return "".join(found)[1:]
        out, raw = [], bytearray()
        for i, piece in zip(ids.tolist(), found):
            if piece is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(piece)
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


def _chunks(texts: list[str], size: int) -> Iterator[list[str]]:
    """Runs of texts that hold about ``size`` characters together; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


ENCODED = ("n_pieces long, score double, scores array<double>, ids_sha256 string, round_trip boolean")


def encode_documents(docs: DataFrame, keep: list[str], n: int = N_BEST, model: str = MODEL, ids: bool = False) -> DataFrame:
    """Columns ``keep`` and, per document, the best segmentation's length, score and digest of its ids
    (little-endian 32 bits), the scores of the n best, and whether the best decodes to the text; with ``ids=True`` also the n best themselves as ``nbest``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", " + ENCODED
    schema += ", nbest array<array<int>>" if ids else ""
    names = [x.split()[0] for x in (ENCODED + (", nbest x" if ids else "")).split(", ")]
    types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.bool_()]
    types += [pa.list_(pa.list_(pa.int32()))] if ids else []

    def run(batches):
        vocab = pieces(model)
        for batch in batches:
            rows = []
            texts = batch.column(len(keep)).to_pylist()
            answers = vocab.encode_all([t for t in texts if t is not None], n)
            for text in texts:
                if text is None:
                    rows.append((None, 0.0, [], None, True, None))
                    continue
                found = next(answers)
                best = found[0][1].astype("<i4")
                exact = vocab.decode(best) == text
                rows.append((len(best), found[0][0], [s for s, _ in found], hashlib.sha256(best.tobytes()).hexdigest(),
                             exact, [x for _, x in found] if ids else None))
            cols = list(zip(*rows)) if rows else [()] * 6
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what stayed, encoded."""
    return encode_documents(docs, ["doc_id", "source"])


@query("op9_piece_nbest")
def op9(spark, sf_dir):
    """All documents encoded and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])
