"""Target-distribution importance resampling: documents drawn by how much their n-grams look like the target's.

Scanning. Texts are lower-cased (A-Z) and every run of separators becomes one space, so an n-gram is a span of the text
itself. One regular expression per n, searched with overlaps and held to word borders by lookarounds, emits the spans;
each feature's CRC-32 names its bucket. A document is scanned once: its buckets and counts are kept, packed, in a
written table, from which both the corpus totals and the weights are taken.

Weights. A bucket's gain is the log ratio of its share in the target and in the corpus, smoothed by one per bucket; a
document's weight is the sum over its features. Noise from a hash of seed and doc_id turns the highest scores into a
draw without replacement. The ranks come from ranges of the scores, so no task sorts all of them.

Defined cases: a null or empty text has no words, weight 0 and no rank; a null doc_id is an empty one in the noise and
comes last in a tie; rows that repeat a doc_id are judged and ranked each; extra columns are ignored; an empty target
gives gains from the corpus alone; empty documents give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import ranks
from tidemark.session import cut_lineage

WORDS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def patterns(words: int) -> list[regex.Pattern]:
    """One pattern per n-gram size: n words between spaces or the text's ends."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, words + 1)]


def features(text: bytes, sizes: list[regex.Pattern]) -> tuple[int, Counter]:
    """Number of words, and the n-grams with their counts."""
    flat = _SEPARATORS.sub(b" ", text.lower()).strip()  # bytes.lower changes A-Z only
    found: Counter = Counter()
    words = 0
    for k, pattern in enumerate(sizes):
        found.update(flat[m.start() : m.end()] for m in pattern.finditer(flat, overlapped=True))
        if not k:
            words = found.total()
    return words, found


def _scan(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    zip_, sizes = zstandard.ZstdCompressor(), patterns(words)
    for batch in batches:
        n_words, n_features, used = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            n, found = features(text.as_py() or b"", sizes)
            ids = np.fromiter((crc32(f) % buckets for f in found), np.int64, len(found))
            at, place = np.unique(ids, return_inverse=True)
            count = np.bincount(place, np.fromiter(found.values(), np.float64, len(found)), len(at)).astype(np.int64)
            n_words.append(n)
            n_features.append(int(count.sum()))
            used.append(zip_.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + count.astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(used, pa.binary())], ["id", "n_words", "n_features", "used"])


def _unpacked(used: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    unzip = zstandard.ZstdDecompressor()
    for x in used:
        both = np.frombuffer(unzip.decompress(x.as_py()), np.int32)
        yield np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :].astype(np.int64)


def scanned(texts: DataFrame, key: str, words: int, buckets: int) -> DataFrame:
    """id, n_words, n_features, used (buckets and counts, packed) of every text; written."""
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(lambda it: _scan(it, words, buckets), "id long, n_words long, n_features long, used binary"))


def bucket_totals(scan: DataFrame, buckets: int) -> np.ndarray:
    """Number of features per bucket: added up in each task, then over the tasks; ``buckets`` numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, count in _unpacked(batch.column(0)):
                total[at] += count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in scan.select("used").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)))) for s, t in zip(corpus, target)], np.int64)


def resample(
    documents: DataFrame, target: DataFrame, target_key: str, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every document."""
    scan = scanned(documents, "doc_id", words, buckets)
    gain = gains(bucket_totals(scan, buckets), bucket_totals(scanned(target, target_key, words, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int((gain[at] * count).sum()) for at, count in _unpacked(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    rows = scan.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    eligible = F.col("n_words") >= min_words
    drawn = scan.where(eligible).count() * percent // 100
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("_order", F.when(eligible, -F.col("score")))
    rows = rows.withColumn("_tie", F.struct(F.col("doc_id").isNull(), "doc_id", F.monotonically_increasing_id()))
    rows = ranks.running_before(rows, [], "_order", "_tie", out="_before").drop("_order", "_tie")
    return rows.withColumn("rank", F.when(F.col("_before") < drawn, F.col("_before").cast("long") + 1)).drop("_before")
