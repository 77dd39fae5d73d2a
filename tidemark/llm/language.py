"""Language identification with a linear-chain conditional random field over words.

Every word gets features of its characters: prefixes and suffixes (affixes), n-grams, and the whole word (lexicon),
hashed into one weight table. Learned transitions couple neighbouring words, so in code-switched text each word is
labelled in its context. Forward-backward gives each word's label probabilities; a document's language is the label
with the largest mean over its words that have letters, and that mean is the score.

Training reads text and lang of documents outside the held-out fold: about ``PER_LANGUAGE`` documents of each language
(chosen by a hash of doc_id, whole texts), a bounded sample that is collected and fitted on the driver.

Defined cases: a null text or one without letters is ``und`` with score 0; a table without labelled rows gives ``und``
everywhere; a null doc_id counts as held out; repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import chains
from tidemark.llm.bpe import _spread as spread
from tidemark.llm.words import SPACES, Words, lower_ascii, mix, separator_table, text_blocks

PER_LANGUAGE = 120
BUCKETS = 1 << 15
PASSES = 4
BATCH_WORDS = 8_000
RATE = 0.15
FOLDS = 5
GRAMS = (2, 3, 4)
AFFIXES = (2, 3)
_SEPARATORS = separator_table(SPACES)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id's text is divisible by ``FOLDS``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    transitions: np.ndarray
    start: np.ndarray


class Features:
    """Hashed features of the distinct words of a block: ``bucket`` in rows, word j has ``at[j]:at[j + 1]``."""

    def __init__(self, w: Words) -> None:
        hashes = w.hashes()
        keys, index, self.of_word = np.unique(hashes, return_index=True, return_inverse=True)
        start, n = w.starts[index], (w.ends - w.starts)[index]
        room = n + 2  # with a mark before and after
        at = np.concatenate(([0], np.cumsum(room)))
        text = np.full(int(at[-1]), 1, np.uint64)
        text[spread(at[:-1] + 1, n)] = w.data[spread(start, n)]
        word = np.repeat(np.arange(len(n)), room)
        rows, buckets = [np.arange(len(n))], [_bucket(keys, 1)]
        for size in GRAMS:
            if len(text) >= size:
                code = np.zeros(len(text) - size + 1, np.uint64)
                for k in range(size):
                    code = code * np.uint64(257) + text[k : len(text) - size + 1 + k]
                inside = word[: len(code)] == word[size - 1 :]
                rows.append(word[: len(code)][inside])
                buckets.append(_bucket(code[inside], 10 + size))
        for size in AFFIXES:
            long = np.flatnonzero(n >= size)
            for tag, begin in ((20, at[:-1][long] + 1), (30, at[1:][long] - 1 - size)):
                code = np.zeros(len(long), np.uint64)
                for k in range(size):
                    code = code * np.uint64(257) + text[begin + k]
                rows.append(long)
                buckets.append(_bucket(code, tag + size))
        row, bucket = np.concatenate(rows), np.concatenate(buckets)
        order = np.argsort(row, kind="stable")
        self.bucket = bucket[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n)))))
        self.scale = 1 / np.sqrt(np.maximum(1, np.diff(self.at)))
        letters = ((w.data >= 65) & (w.data <= 90)) | ((w.data >= 97) & (w.data <= 122)) | (w.data >= 128)
        sums = np.concatenate(([0], np.cumsum(letters)))
        self.lettered = sums[w.ends] > sums[w.starts]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """One row per word of the block."""
        if not len(self.of_word):
            return np.zeros((0, weights.shape[1]))
        return (np.add.reduceat(weights[self.bucket], self.at[:-1], axis=0) * self.scale[:, None])[self.of_word]

    def scatter(self, by_word: np.ndarray) -> np.ndarray:
        """Gradient of the weights from the gradient of the emissions."""
        per = np.stack([np.bincount(self.of_word, by_word[:, k], len(self.scale)) for k in range(by_word.shape[1])], axis=1) * self.scale[:, None]
        spread_out = np.repeat(per, np.diff(self.at), axis=0)
        return np.stack([np.bincount(self.bucket, spread_out[:, k], BUCKETS) for k in range(by_word.shape[1])], axis=1)


def _bucket(code: np.ndarray, tag: int) -> np.ndarray:
    return (mix(code + np.uint64((tag * 0x9E3779B97F4A7C15) & (2**64 - 1))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _block(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(lower_ascii(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), _SEPARATORS)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, passes: int = PASSES, seed: int = 5) -> Model | None:
    """Fits the field on about ``per_language`` documents of each language; doc_id only picks the sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chance < share[F.col("lang")]).limit(2 * per_language * len(counts)).select("text", "lang").collect()
    sample.sort()  # the same order however the rows arrive
    labels = sorted(counts)
    model = Model(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))), np.zeros(len(labels)))
    rng, steps = np.random.default_rng(seed), chains.Adagrad(RATE)
    batches, now, size = [], [], 0
    for i in rng.permutation(len(sample)):
        now.append(sample[i])
        size += sample[i]["text"].count(" ") + 1
        if size >= BATCH_WORDS:
            batches.append(now)
            now, size = [], 0
    for _ in range(passes):
        for batch in [*batches, now]:
            w = _block([r["text"] for r in batch])
            if not len(w.starts):
                continue
            x = Features(w)
            y = np.repeat([labels.index(r["lang"]) for r in batch], w.counts())
            by_word, pairs, start = chains.gradient(x.emissions(model.weights), w.first, model.transitions, model.start, y)
            n = len(by_word)
            steps.step("w", model.weights, x.scatter(by_word) / n)
            steps.step("t", model.transitions, pairs / n + 1e-4 * model.transitions)
            steps.step("s", model.start, start / n + 1e-4 * model.start)
    model.weights = model.weights.astype(np.float32)
    return model


def word_probabilities(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of a block, and whether the word has letters."""
    x = Features(w)
    return chains.marginals(x.emissions(model.weights), w.first, model.transitions, model.start), x.lettered


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, and ``shares``, the mean probability of every label."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text", 1 << 20):
                n = rows.num_rows
                mean = np.zeros((n, len(m.labels) if m else 1))
                if m:
                    w = Words(lower_ascii(data), offsets, _SEPARATORS)
                    p, lettered = word_probabilities(w, m)
                    sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p * lettered[:, None], axis=0)))
                    heard = np.concatenate(([0], np.cumsum(lettered)))[w.first]
                    mean = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(1, np.diff(heard))[:, None]
                best = mean.argmax(axis=1)
                ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                has = np.concatenate(([0], np.cumsum(ascii_letter)))[offsets]
                known = np.diff(has) > 0
                for j in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                    known[j] = any(c.isalpha() for c in data[offsets[j] : offsets[j + 1]].tobytes().decode())
                known &= bool(m)
                langs = [m.labels[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(mean[np.arange(n), best], 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(list(mean), pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "shares"]
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, shares array<double>")


def identify(documents: DataFrame) -> DataFrame:
    """Trains outside the held-out fold and predicts every document."""
    return predict(documents, train(documents.where(~held_out(F.col("doc_id")))))
