"""Vector code compression: product codes whose codebooks come from exact k-means steps, bounded by balls.

The vectors, as whole numbers, lie in blocks of some thousand rows, dealt once by block number and written; every round
only moves the codes of the round before (a byte per part). In a round a task takes a block's parts with their last
entry and lets the entries' balls say what must be looked at:

* An entry's ball has the radius of its farthest part. Entries that lie farther than twice the radius from it cannot
  hold any of its parts; the others are its neighbours.
* A part closer to its entry than half the way to the nearest neighbour lies in the stable core and stays.
* The rest of the ball is cut into rings by the neighbours' half distances: a part in ring m is compared with the m
  nearest neighbours only, by exact squared distances.

All of it is done in whole numbers, so the result is that of comparing everything with everything, ties included. Sums
and counts per entry are added up in each task before they are shuffled; a codebook (parts x entries numbers) is the
only thing that comes to the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of
another length than the kept row of the smallest vec_id has; components beyond +-32768 count as +-32768; the length
must be a multiple of ``parts`` (else ValueError); rows with a null vec_id get a code but start no entry; rows that
repeat a vec_id are coded each and start an entry each, in the order of their components; fewer rows than entries give
fewer entries; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.lookup import attach
from tidemark.session import cut_dealt, cut_lineage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_VALUES = 1 << 18
_MOST = 32768


def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the kept rows' components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    near = F.transform(x, lambda c: F.floor(F.greatest(F.least(c, F.lit(float(_MOST))), F.lit(float(-_MOST))) * scale).cast("int"))
    return embeddings.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", near.alias("v"))


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (smallest index on ties) and squared distance of every row, by comparing all."""
    best = ((x - book[0]) ** 2).sum(1)
    entry = np.zeros(len(x), np.uint8)
    for e in range(1, len(book)):
        d = ((x - book[e]) ** 2).sum(1)
        less = d < best
        best[less], entry[less] = d[less], e
    return entry, best


def ball_step(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As :func:`_nearest`, from each row's last entry; also the number of distances taken."""
    own = ((x - book[entry]) ** 2).sum(1)
    out, best, taken = entry.copy(), own.copy(), len(x)
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    for e in np.unique(entry):
        inside = np.flatnonzero(entry == e)
        others = np.argsort(apart[e], kind="stable")
        others = others[others != e]
        reach = 4 * own[inside]
        others = others[apart[e][others] <= reach.max()]  # neighbours of the ball
        rings = np.searchsorted(apart[e][others], reach, side="right")  # 0: stable core
        for m, j in enumerate(others):
            ring = inside[rings > m]
            d = ((x[ring] - book[j]) ** 2).sum(1)
            taken += len(ring)
            better = (d < best[ring]) | ((d == best[ring]) & (j < out[ring]))
            out[ring[better]], best[ring[better]] = j, d[better]
    return out, best, taken


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, vec_id, label, v) to one row per block, its numbers packed."""
    rows = max(1, BLOCK_VALUES // max(width, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            v = part.column(3)
            packed = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
            whole = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *whole, pa.array([packed], pa.binary())], ["block", "ids", "labels", "v"])


class _Assigned:
    """Codes and distances of a block's parts under the codebooks."""

    def __init__(self, v: bytes, books: np.ndarray, last: bytes | None) -> None:
        parts, _, width = books.shape
        self.x = np.frombuffer(v, np.int32).reshape(-1, parts, width).astype(np.int64)
        before = np.frombuffer(last, np.uint8).reshape(-1, parts) if last is not None else None
        self.codes = np.empty(self.x.shape[:2], np.uint8)
        self.error = np.zeros(len(self.x), np.int64)
        for p in range(parts):
            x = np.ascontiguousarray(self.x[:, p])
            entry, d = _nearest(x, books[p]) if before is None else ball_step(x, books[p], before[:, p])[:2]
            self.codes[:, p], self.error = entry, self.error + d

    def sums(self, entries: int) -> np.ndarray:
        """(parts, entries, width + 1): sums of the parts of every entry, and their number."""
        out = np.zeros((self.x.shape[1], entries, self.x.shape[2] + 1), np.int64)
        for p in range(self.x.shape[1]):
            for e in range(entries):
                mine = self.codes[:, p] == e
                out[p, e, :-1], out[p, e, -1] = self.x[mine, p].sum(0), mine.sum()
        return out


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (block, codes) per block, and at a task's end one with the sums of all its blocks."""
    total, names = np.zeros(0, np.int64), ["block", "codes", "sums"]
    for batch in batches:
        for i in range(batch.num_rows):
            got = _Assigned(batch.column(1)[i].as_py(), books, batch.column(2)[i].as_py())
            sums = got.sums(books.shape[1]).ravel()
            total = sums if not len(total) else total + sums
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([got.codes.tobytes()], pa.binary()), pa.nulls(1, pa.list_(pa.int64()))], names)
    if len(total):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tolist()], pa.list_(pa.int64()))], names)


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = _Assigned(batch.column(3)[i].as_py(), books, batch.column(4)[i].as_py())
            text = got.codes.tobytes().hex()
            size = 2 * got.codes.shape[1]
            codes = pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, batch.column(2)[i].values, codes, pa.array(got.error)], ["vec_id", "label", "code", "error"])


def _next_books(done: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry becomes the floor of its parts' mean; unused entries stay."""
    rows = done.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(books.shape[:2] + (books.shape[2] + 1,), np.int64)
    for r in rows.collect():  # parts x entries x (width + 1) numbers
        total.flat[r["at"]] = r["x"]
    count = total[..., -1:]
    return np.where(count > 0, total[..., :-1] // np.maximum(count, 1), books)


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of all kept vectors, and the codebooks (parts, entries, width of a part)."""
    if entries > 256:
        raise ValueError("an entry's number must fit into a byte")
    spark = embeddings.sparkSession
    kept = whole_numbers(embeddings, scale)
    label = kept.schema["label"].dataType.simpleString()
    first = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == width)
    seeds = [r["v"] for r in kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).collect()]
    if not width:
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    rows = kept.select(F.monotonically_increasing_id().alias("block"), "vec_id", "label", "v")
    packed = rows.mapInArrow(lambda it: _blocks(it, width), f"block long, ids array<bigint>, labels array<{label}>, v binary")
    blocks = cut_dealt(packed, int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    codes = None
    for _ in range(rounds):
        now = books
        joined = blocks.select("block", "v", F.lit(None).cast("binary").alias("codes")) if codes is None else blocks.select("block", "v").join(codes.hint("shuffle_hash"), "block")
        done = cut_lineage(joined.mapInArrow(lambda it, now=now: _round(it, now), "block long, codes binary, sums array<bigint>"))
        books = _next_books(done, books)
        codes = done.where("sums IS NULL").select("block", "codes")
    joined = blocks.withColumn("codes", F.lit(None).cast("binary")) if codes is None else blocks.join(codes.hint("shuffle_hash"), "block")
    return joined.mapInArrow(lambda it: _coded(it, books), f"vec_id long, label {label}, code string, error long"), books


def summary(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256."""
    coded = cut_lineage(coded)
    totals = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    text = ",".join(map(str, books.ravel().tolist()))
    rows = attach(coded, totals, "label", "n")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
