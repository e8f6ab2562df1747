"""Language identification of words by a linear-chain conditional random field.

Every word gets affix, character n-gram and lexicon (whole-word) features, hashed into a table of
weights; learned transitions tie neighbours together. Forward-backward gives each word's language
probabilities, so code-switched text is labelled word by word. A document's language is the one with
the largest mean probability over its words that hold a letter, and that mean is the score. A word of more
than ``RUN`` characters, as in text without blanks, is several positions of at most ``RUN`` characters, each
of which counts as a word; they overlap by two, so that no n-gram is lost.

Training: a bounded sample, at most ``SAMPLE_DOCS`` documents a language and of at most
``SAMPLE_CHARS`` characters each, chosen by hash from the documents with a crc32 of
the id that modulo 5 is not 0. Training sequences join stretches of different documents, which is what
transitions are learned from. The likelihood is maximised on the driver, whose work does not depend on
the size of the corpus. Prediction reads whole texts only, never language, source or id.

Defined results: NULL text, or text without a letter, is ``und`` with score 0; so is every text if no
labelled document can be learned from. A NULL id counts as not held out and is not learned from. Repeated
rows get equal answers. Ties go to the language first in order. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspark.llm.common import BLANKS, md5_of, query, table
from veilspark.llm.repeats import runs_of

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
TABLE = 1 << 16
STEPS = 25
#: Training sequences and their length in words.
SEQUENCES, SEQ_WORDS = 1_500, 60
#: Words of a forward-backward batch.
BATCH_WORDS = 400_000
#: Characters of a word that are one position.
RUN = 64
#: New words whose features are held at once.
NEW_WORDS = 1 << 14

_STRIP = BLANKS + ".,;:!?\"'()[]{}|*#$%&<>-"


def positions(text: str) -> list[str]:
    """Words of a whole text, those longer than ``RUN`` in overlapping pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= RUN:
        return words
    out = []
    for word in words:
        if len(word) > RUN:
            word = word.strip(_STRIP)
        out += [word[i:i + RUN] for i in range(0, max(1, len(word) - 2), RUN - 2)]
    return out


def features(word: str) -> list[int]:
    """Hashed features of a word: affixes, inner n-grams, and the word itself as lexicon entry."""
    w = word.strip(_STRIP).lower()
    if not any(map(str.isalpha, w)):
        return []
    names = ["=" + w]
    names += ["<" + w[:i] for i in (1, 2, 3) if len(w) >= i] + [">" + w[-i:] for i in (1, 2, 3) if len(w) >= i]
    names += ["*" + w[i:i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % TABLE for x in names]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, sizes = array("q"), np.zeros(len(words), dtype=np.int64)
    for n, word in enumerate(words):
        found = features(word)
        index.extend(found)
        sizes[n] = len(found)
    return np.array(index, dtype=np.int64), np.repeat(np.arange(len(words)), sizes), np.maximum(sizes, 1)


def _emissions(flat, weights: np.ndarray) -> np.ndarray:
    index, owner, sizes = flat
    # one language at a time: the features of all languages at once would not fit for text without blanks
    out = np.stack([np.bincount(owner, w[index], minlength=len(sizes)) for w in np.ascontiguousarray(weights.T)], axis=1)
    return out / np.sqrt(sizes)[:, None]


def train(texts: list[str], labels: list[str], seed: int = 5) -> dict:
    """Weights and transitions learned from whole labelled texts."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    pools = [[] for _ in names]
    for text, lab in sorted(zip(texts, labels)):
        pools[names.index(lab)] += [number.setdefault(w, len(number)) for w in positions(text)]
    pools = [np.array(p, dtype=np.int64) for p in pools]
    k = len(names)
    ids = np.zeros((SEQUENCES, SEQ_WORDS), dtype=np.int64)
    gold = np.zeros((SEQUENCES, SEQ_WORDS), dtype=np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQ_WORDS:
            lab = int(rng.integers(k))
            size = int(min(rng.geometric(1 / 25), SEQ_WORDS - at))
            start = int(rng.integers(max(1, len(pools[lab]) - size)))
            piece = pools[lab][start:start + size]
            size = max(1, len(piece))
            ids[s, at:at + size] = piece if len(piece) else 0
            gold[s, at:at + size] = lab
            at += size
    flat = _flat(list(number))
    weights, trans = np.zeros((TABLE, k)), np.zeros((k, k))
    sq_w, sq_t = np.full((TABLE, k), 1e-8), np.full((k, k), 1e-8)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    truth = np.zeros((len(number), k))
    np.add.at(truth, (ids.ravel(), gold.ravel()), 1)
    for _ in range(STEPS):
        psi = np.exp(np.clip(_emissions(flat, weights), -30, 30))[ids.T]
        a = np.exp(trans)
        alpha, beta = np.zeros_like(psi), np.ones_like(psi)
        alpha[0] = psi[0] / psi[0].sum(axis=1, keepdims=True)
        for t in range(1, SEQ_WORDS):
            x = (alpha[t - 1] @ a) * psi[t]
            alpha[t] = x / x.sum(axis=1, keepdims=True)
        expected = np.zeros((k, k))
        for t in range(SEQ_WORDS - 2, -1, -1):
            x = (psi[t + 1] * beta[t + 1])
            y = x @ a.T
            joint = alpha[t][:, :, None] * a[None] * x[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[t] = y / y.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        model = np.zeros_like(truth)
        np.add.at(model, ids.T.ravel(), post.reshape(-1, k))
        d_words = (truth - model) / np.sqrt(flat[2])[:, None]
        d_w = np.stack([np.bincount(flat[0], d_words[flat[1], j], minlength=TABLE) for j in range(k)], axis=1)
        d_w -= 0.5 * weights
        d_t = pairs - expected - 0.5 * trans
        sq_w += d_w ** 2
        sq_t += d_t ** 2
        weights += 0.5 * d_w / np.sqrt(sq_w)
        trans += 0.5 * d_t / np.sqrt(sq_t)
    return {"names": names, "weights": weights.astype(np.float32), "trans": trans}


class Labeller:
    """Forward-backward over many documents at once, with the word scores met so far."""

    def __init__(self, model: dict):
        self.names, self.weights = model["names"], model["weights"].astype(np.float64)
        self.a = np.exp(model["trans"])
        self.number: dict[str, int] = {}
        self.psi = np.zeros((0, len(self.names)))
        self.letters = np.zeros(0, dtype=bool)

    def _numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > 400_000:
            self.number.clear()
            self.psi, self.letters = self.psi[:0], self.letters[:0]
        known, number = len(self.number), self.number
        out = [np.fromiter((number.setdefault(w, len(number)) for w in d), np.int64, len(d)) for d in docs]
        if len(number) > known:
            new = list(number)[known:]
            score = np.concatenate([_emissions(_flat(new[i:i + NEW_WORDS]), self.weights) for i in range(0, len(new), NEW_WORDS)])
            self.psi = np.concatenate([self.psi, np.exp(np.clip(score, -30, 30))])
            self.letters = np.concatenate([self.letters, [any(map(str.isalpha, w)) for w in new]]).astype(bool)
        return out

    def word_probabilities(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Per document an array (words, languages)."""
        tm, doc, t, order, _ = self._run(docs)
        out: list = [None] * len(docs)
        for rank, d in enumerate(order):
            mine = doc == rank
            out[d] = tm[mine][np.argsort(t[mine], kind="stable")]
        return out

    def _run(self, docs):
        ids = self._numbers(docs)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents longer than t
        start = np.cumsum(active) - active
        doc = np.repeat(np.arange(len(docs)), sizes)
        t = runs_of(sizes)
        where = start[t] + doc
        flat = np.zeros(len(where), dtype=np.int64)
        flat[where] = np.concatenate([ids[d] for d in order]) if len(where) else 0
        psi = self.psi[flat]
        alpha = np.empty_like(psi)
        last = None
        for s, n in zip(start.tolist(), active.tolist()):
            x = psi[s:s + n] if last is None else (last[:n] @ self.a) * psi[s:s + n]
            last = x / x.sum(axis=1, keepdims=True)
            alpha[s:s + n] = last
        back = self.a.T
        nxt = np.ones((0, len(self.names)))
        for s, n in zip(start[::-1].tolist(), active[::-1].tolist()):
            beta = np.ones((n, len(self.names)))
            if len(nxt):
                x = nxt @ back
                beta[:len(nxt)] = x / x.sum(axis=1, keepdims=True)
            alpha[s:s + n] *= beta
            nxt = psi[s:s + n] * beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        tm_doc, tm_t = np.empty_like(doc), np.empty_like(t)
        tm_doc[where], tm_t[where] = doc, t
        return alpha, tm_doc, tm_t, order, self.letters[flat]

    def documents(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        alpha, doc, _, order, letters = self._run(docs)
        count = np.bincount(doc[letters], minlength=len(docs))
        mean = np.stack([np.bincount(doc[letters], alpha[letters, k], minlength=len(docs))
                         for k in range(len(self.names))], axis=1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        out: list = [None] * len(docs)
        for rank, d in enumerate(order):
            out[d] = (self.names[best[rank]], float(min(1.0, mean[rank, best[rank]]))) if count[rank] else ("und", 0.0)
        return out


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict | None:
    """Train on the bounded sample; None if there is nothing to learn from."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # about three times the sample by hash, so that the ranking below sees a bounded number of rows
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3.0 * sample_docs / n))])[F.col("lang")]
    some = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    some = some.filter((F.length("text") <= sample_chars) & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(md5_of("lang", F.col("doc_id")), "text"))
    rows = some.withColumn("_r", rank).filter(F.col("_r") <= sample_docs).select("text", "lang").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


_labellers: dict[int, Labeller] = {}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    schema = "doc_id long, lang_pred string, score double"
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    mark = zlib.crc32(model["weights"].tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE x languages numbers

    def run(batches):
        tagger = _labellers.get(mark)
        if tagger is None:
            _labellers.clear()
            tagger = _labellers[mark] = Labeller(shared.value)
        for batch in batches:
            sizes = np.array([len(x.as_py() or "") for x in batch.column(1)])
            order = np.argsort(-sizes, kind="stable")  # long ones together: few steps for the rest
            answers: list = [("und", 0.0)] * len(order)
            group, words, size = [], [], 0
            for n, i in enumerate(order.tolist()):
                mine = positions(batch.column(1)[i].as_py() or "")
                group.append(i)
                words.append(mine)
                size += len(mine)
                if size >= BATCH_WORDS or n == len(order) - 1:
                    if size:
                        for j, a in zip(group, tagger.documents(words)):
                            answers[j] = a
                    group, words, size = [], [], 0
            names, scores = zip(*answers) if answers else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@query("op10_language_crf")
def op10(spark, sf_dir):
    """All documents: held out or not, and the predicted language."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
