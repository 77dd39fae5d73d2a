"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both sides.

1. Corpus counts of every distinct word, aggregated over all documents. The ``VOCABULARY`` most frequent words get an
   input number each, the others one per ending; output classes are the ``TOP`` words and the endings. Within a class a
   word's probability is its share of the class's count; rare words share theirs evenly among the class's distinct
   rare words, so the probabilities of all words of the corpus sum to one in every context.
2. The network (embeddings of ``SIDE`` words on each side, one hidden layer, softmax over classes; the word itself is
   never an input) is trained in numpy on every document: the rounds split the documents among them by a hash of the
   text; in each round every partition takes steps on its documents of that round, and the parameters are averaged by an
   aggregation, weighted by words seen.
3. Documents are scored with the sum of log p(class | both sides) + log p(word | class).

Tables of the model have a fixed size and are broadcast. Sums of parameters may differ in the last digits between runs.

Defined cases: a null or wordless text has 0 tokens, score 0 and a null mean; on an empty table nothing is trained and
no rows come out; repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import SPACES, Words, lower_ascii, mix, separator_table, text_blocks
from tidemark.session import cut_lineage

VOCABULARY = 4096
TOP = 32
ENDINGS = 64
SIDE = 2
EMBEDDING = 12
HIDDEN = 32
ROUNDS = 2
BATCH = 2048
STEP = 0.05
_SEPARATORS = separator_table(SPACES)
CLASSES = TOP + ENDINGS
INPUTS = VOCABULARY + ENDINGS + 1  # the last is the edge of a document
_SHAPES = {"embed": (INPUTS, EMBEDDING), "w1": (2 * SIDE * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,)}


@dataclass
class Vocabulary:
    """Frequent words' hashes in order, their class and log share of it; per class the log share of one rare word."""

    hashes: np.ndarray
    number: np.ndarray
    log_share: np.ndarray
    of_class: np.ndarray
    rare_log_share: np.ndarray


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a block, their hashes, their endings."""
    w = Words(lower_ascii(data), offsets, _SEPARATORS)
    last = w.data[w.ends - 1].astype(np.uint64)
    before = np.where(w.ends - w.starts > 1, w.data[w.ends - 2], 0).astype(np.uint64)
    return w, w.hashes(), (mix(last * np.uint64(256) + before) % np.uint64(ENDINGS)).astype(np.int64)


def word_counts(documents: DataFrame) -> DataFrame:
    """h (hash of a word), ending, n: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch, "text"):
                _, h, ending = _tokens(data, offsets)
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ending[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "ending", "n"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, ending int, n long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _reach(histogram: DataFrame, room: int) -> tuple[int, int]:
    """First key, in ascending order, at which the running sum of ``n`` reaches ``room``; the sum before it."""
    total = 0
    for r in sorted(histogram.collect()):  # a bounded number of keys
        if total + r["n"] >= room:
            return r["key"], total
        total += r["n"]
    return 1 << 62, total


def frequent(counts: DataFrame, size: int = VOCABULARY) -> list:
    """The ``size`` most frequent words; among words that are within 1/64 of a doubling at the edge, by hash.

    Two histograms of a fixed number of cells find the edge, so no more than about ``size`` rows come to the driver,
    however many tasks hold the counts.
    """
    cells = counts.withColumn("key", -F.floor(F.log2("n") * 64)).withColumn("sub", F.shiftrightunsigned("h", 52))
    edge, above = _reach(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")), size)
    within = cells.where(F.col("key") == edge).groupBy(F.col("sub").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    last, _ = _reach(within, size - above)
    rows = cells.where((F.col("key") < edge) | ((F.col("key") == edge) & (F.col("sub") <= last))).collect()
    by_edge = sorted(rows, key=lambda r: (r["key"], r["sub"], r["h"]))[:size]
    return sorted(by_edge, key=lambda r: (-r["n"], r["h"]))


def vocabulary(counts: DataFrame) -> Vocabulary | None:
    """The frequent words and, per ending, what is left of the corpus."""
    top = frequent(counts)
    if not top:
        return None
    totals = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    mass, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in totals:
        mass[r["ending"]], words[r["ending"]] = r["n"], r["words"]
    for r in top[:TOP]:
        mass[r["ending"]] -= r["n"]
        words[r["ending"]] -= 1
    rest, distinct = mass.copy(), words.copy()
    for r in top[TOP:]:
        rest[r["ending"]] -= r["n"]
        distinct[r["ending"]] -= 1
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    of_class = np.array([i if i < TOP else TOP + r["ending"] for i, r in enumerate(top)])
    share = np.array([0.0 if i < TOP else np.log(r["n"] / mass[r["ending"]]) for i, r in enumerate(top)])
    rare = np.log(np.maximum(rest, 0.5) / np.maximum(mass, 1.0)) - np.log(np.maximum(distinct, 1.0))
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, share[order], of_class[order], np.concatenate((np.zeros(TOP), rare)))


def encode(v: Vocabulary, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input number, output class and log share within the class, of every word."""
    at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
    known = v.hashes[at] == h
    of_class = np.where(known, v.of_class[at], TOP + ending)
    return np.where(known, v.number[at], VOCABULARY + ending), of_class, np.where(known, v.log_share[at], v.rare_log_share[of_class])


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Input numbers of the ``SIDE`` words before and after every word; the edge's number outside the document."""
    n, begin, end = np.diff(first), np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    place = np.arange(int(n.sum()))
    out = np.full((len(ids), 2 * SIDE), INPUTS - 1)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = place + shift
        ok = (at >= begin) & (at < end)
        out[ok, k] = ids[at[ok]]
    return out


def new_parameters(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}


def forward(p: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer and log probabilities of the classes."""
    x = p["embed"][context].reshape(len(context), -1)
    hidden = np.tanh(x @ p["w1"] + p["b1"])
    z = hidden @ p["w2"] + p["b2"]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return x, hidden, z


class Trainer:
    """Gradient steps with a rate per parameter, on batches of words."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.seen, self.words = {k: v.copy() for k, v in p.items()}, {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}, 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        x, hidden, z = forward(p, context)
        d = np.exp(z)
        d[np.arange(n), target] -= 1
        d /= n
        back = (d @ p["w2"].T) * (1 - hidden * hidden)
        grad = {"w2": hidden.T @ d, "b2": d.sum(axis=0), "w1": x.T @ back, "b1": back.sum(axis=0)}
        for k, g in grad.items():
            self.seen[k] += g * g
            p[k] -= STEP * g / np.sqrt(self.seen[k])
        dx = (back @ p["w1"].T).reshape(-1, EMBEDDING)
        rows, of = np.unique(context.ravel(), return_inverse=True)
        g = np.stack([np.bincount(of, dx[:, k], len(rows)) for k in range(EMBEDDING)], axis=1).astype(np.float32)
        self.seen["embed"][rows] += g * g
        p["embed"][rows] -= STEP * g / np.sqrt(self.seen["embed"][rows])
        self.words += n


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def train(documents: DataFrame, v: Vocabulary, rounds: int = ROUNDS, rate: int | None = None) -> dict[str, np.ndarray]:
    """Rounds of steps in every partition and an average over partitions.

    Round r takes the documents whose text hashes to r modulo ``rate`` (the number of rounds, if it is not given), so
    the rounds together take each document once; with ``rate`` 1 every round takes all. The text, unlike the doc_id,
    is at hand in every row and falls to the same round however the rows are dealt.
    """
    spark, p, rate = documents.sparkSession, new_parameters(), rate or rounds
    if rate > rounds:
        raise ValueError("with fewer rounds than shares some documents are never trained on")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((v, p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, start = shared.value  # noqa: B023
            t = Trainer(start)
            for batch in batches:
                for _, data, offsets in text_blocks(batch, "text"):
                    w, h, ending = _tokens(data, offsets)
                    ids, target, _ = encode(vocab, h, ending)
                    context = contexts(ids, w.first)
                    order = np.random.default_rng(len(h)).permutation(len(h))
                    for at in range(0, len(order), BATCH):
                        t.step(context[order[at : at + BATCH]], target[order[at : at + BATCH]])
            if t.words:
                flat = _flat(t.p).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * t.words), pa.array(np.full(len(flat), t.words, np.int64))], ["i", "x", "n"])

        text = F.col("text").cast("string")
        chosen = documents.where(F.pmod(F.xxhash64(text), F.lit(rate)) == r % rate).select(text.alias("text"))
        mean = chosen.mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
        rows = mean.toArrow()  # one row per parameter
        if not rows.num_rows:
            continue
        flat = np.zeros(rows.num_rows)
        flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
        p = _shaped(flat)
    return p


def block_scores(v: Vocabulary, p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed conditional log probability of every document of a block."""
    w, h, ending = _tokens(data, offsets)
    ids, target, share = encode(v, h, ending)
    context, logs = contexts(ids, w.first), share.astype(np.float64)
    for at in range(0, len(ids), 1 << 14):
        part = slice(at, at + (1 << 14))
        z = forward(p, context[part])[2]
        logs[part] += z[np.arange(len(z)), target[part]]
    sums = np.concatenate(([0.0], np.cumsum(logs)))[w.first]
    return w.counts(), np.diff(sums)


def score(documents: DataFrame, v: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """Per document: doc_id, n_tokens, log_likelihood (summed), mean_log_likelihood."""
    shared = documents.sparkSession.sparkContext.broadcast((v, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, params = shared.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text", 1 << 20):
                n, sums = block_scores(vocab, params, data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(sums)], ["doc_id", "n_tokens", "log_likelihood"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return rows.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def score_documents(documents: DataFrame) -> DataFrame:
    """Counts the corpus, trains on it and scores every document."""
    v = vocabulary(cut_lineage(word_counts(documents)))
    if v is None:
        v = Vocabulary(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(CLASSES))
        return score(documents, v, new_parameters())
    return score(documents, v, train(documents, v))
