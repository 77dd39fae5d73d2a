"""Benchmark decontamination by winnowing.

Every run of ``WINDOW`` words keeps the smallest hash among its ``GRAM``-word grams. A shared span of ``WINDOW`` words
or more has the same grams on both sides, so it keeps the same fingerprint on both sides: no long shared span is
missed. Training and benchmark fingerprints are joined; each hit is extended to the whole windows around it, which are
compared by a hash of all their words. Items shorter than a window are one window of their own length and have one
gram, as long as the item.

The benchmark side of the join is broadcast only while it has at most ``max_broadcast`` windows; beyond that both
sides are shuffled by fingerprint, then by window, and hits go back to their row by a generated number: the documents
are written once with it to the shared folder, so that every read sees the same numbers. Both ways return the same rows.

Defined cases: null text has no words and is not contaminated; an item without words has no windows; every row
is judged by its own text, also where a ``doc_id`` is null or repeated; a null ``item_id`` is ignored; columns other than
those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import Grams, Words, covered, fits, lower_ascii, owner, separator_table, sliding_min, text_blocks
from tidemark.session import cut_lineage

WINDOW = 10
GRAM = 5
MAX_BROADCAST = 2_000_000
# The bytes that separate words, after A-Z became a-z.
SEPARATORS = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_WINDOWS = "row long, size int, pos int, mark long, window long"


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(lower_ascii(data), offsets, SEPARATORS)


def _fingerprints(hashes: np.ndarray, grams: Grams, size: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprint and window hash of the window of ``size`` words at every position."""
    short = size < window
    marks = sliding_min(grams.of(size if short else gram), 1 if short else window - gram + 1)
    return marks, grams.of(size)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per item and distinct window: item_id, size, mark (fingerprint), win (hash of all words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                w = _words(data, offsets)
                grams, n = Grams(w.hashes()), w.counts()
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                own = owner(w.first)
                for size in sorted({int(min(x, window)) for x in n if x}):
                    marks, wins = _fingerprints(w.hashes(), grams, size, window, gram)
                    at = np.flatnonzero(fits(w.first, size))
                    at = at[n[own[at]] >= window] if size == window else at[n[own[at]] == size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own[at]], pa.int64()), pa.array(np.full(len(at), size, np.int32)), pa.array(marks[at].view(np.int64)), pa.array(wins[at].view(np.int64))],
                        ["item_id", "size", "mark", "win"],
                    )

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id long, size int, mark long, win long").distinct()


class _Index:
    """Benchmark windows of one size: sorted fingerprints, sorted window hashes, and the items of each window."""

    def __init__(self, marks: np.ndarray, wins: np.ndarray, items: np.ndarray) -> None:
        self.marks = np.unique(marks)
        order = np.argsort(wins, kind="stable")
        self.wins, at = np.unique(wins[order], return_index=True)
        self.items, self.at = items[order], np.append(at, len(items))

    def find(self, marks: np.ndarray, wins: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose fingerprint and then whole window occur in the benchmark; the window's number."""
        change = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.zeros(0, np.int64)
        kept = _member(self.marks, marks[change])
        pos = np.flatnonzero(np.repeat(kept, np.diff(np.append(change, len(marks)))) & ok)
        pos = pos[_member(self.wins, wins[pos])]
        return pos, np.searchsorted(self.wins, wins[pos])


def _member(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x if len(ordered) else np.zeros(len(x), bool)


def _indexes(windows: DataFrame) -> dict[int, _Index]:
    """All benchmark windows, by size; callers have checked their number."""
    t = windows.toArrow()
    size = t["size"].to_numpy()
    mark, win, item = (t[c].to_numpy() for c in ("mark", "win", "item_id"))
    return {int(s): _Index(mark[size == s].view(np.uint64), win[size == s].view(np.uint64), item[size == s]) for s in np.unique(size)}


def _broadcast_join(docs: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_indexes(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                w = _words(data, offsets)
                h, own = w.hashes(), owner(w.first)
                grams = Grams(h)
                hit = np.zeros(len(h), bool)
                pairs = [np.zeros((0, 2), np.int64)]
                for s, index in shared.value.items():
                    marks, wins = _fingerprints(h, grams, s, window, gram)
                    pos, number = index.find(marks, wins, fits(w.first, s))
                    hit |= covered(pos, s, len(h))
                    n = index.at[number + 1] - index.at[number]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.stack([np.repeat(own[pos], n), index.items[np.repeat(index.at[number], n) + step]], 1))
                found = np.unique(np.concatenate(pairs), axis=0)
                at = np.searchsorted(found[:, 0], np.arange(rows.num_rows + 1))
                sums = np.concatenate(([0], np.cumsum(hit)))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(w.counts().astype(np.int64)),
                        pa.array((sums[w.first[1:]] - sums[w.first[:-1]]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found[:, 1])),
                    ],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<long>")


def _numbered(documents: DataFrame) -> DataFrame:
    """The rows with a number of their own, written once; their columns go into a struct, where no name can clash with it."""
    return cut_lineage(documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")))


def _row_hits(docs: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """row, pos, size, item_id of every benchmark window in ``docs`` (row, text)."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``window`` rows

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                w = _words(data, offsets)
                h, own = w.hashes(), owner(w.first)
                grams, ids = Grams(h), rows.column(0)
                for s in sizes:
                    m, wins = _fingerprints(h, grams, s, window, gram)
                    at = np.flatnonzero(fits(w.first, s))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own[at])), pa.array(np.full(len(at), s, np.int32)), pa.array((at - w.first[own[at]]).astype(np.int32)), pa.array(m[at].view(np.int64)), pa.array(wins[at].view(np.int64))],
                        ["row", "size", "pos", "mark", "window"],
                    )

    kept = windows.select("size", "mark").distinct()
    near = docs.mapInArrow(marks, _WINDOWS).join(kept, ["size", "mark"])
    return near.join(windows.select("size", F.col("win").alias("window"), "item_id"), ["size", "window"]).select("row", "pos", "size", "item_id")


def _shuffle_join(docs: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_words(data, offsets).counts().astype(np.int64))], ["row", "n_words"])

    rows = _numbered(docs)
    text = rows.select("row", F.col("doc.text").alias("text"))
    hits = _row_hits(text, windows, window, gram)
    items = hits.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # Words covered: each start adds the words up to the next start's reach; a document's starts are bounded by its words.
    spans = hits.select("row", "pos", (F.col("pos") + F.col("size")).alias("end")).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("pos", "end"))).alias("s"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["pos"]))).cast("long").alias("n"), F.greatest(a["to"], x["end"]).cast("int").alias("to")
    )
    n_hit = spans.select("row", F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step)["n"].alias("n_hit"))
    return (
        rows.select("row", F.col("doc.doc_id").alias("doc_id"))
        .join(text.mapInArrow(counts, "row long, n_words long"), "row")
        .join(n_hit, "row", "left")
        .join(items, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside benchmark windows), items (ids of items with such windows)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = benchmark_windows(benchmark, window, gram)
    small = windows.limit(max_broadcast + 1).count() <= max_broadcast
    return (_broadcast_join if small else _shuffle_join)(docs, windows, window, gram)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents without a word inside a benchmark window, with all their columns.

    With a broadcast benchmark the rows are filtered in place, without a shuffle.
    """
    windows = benchmark_windows(benchmark, window, gram)
    if windows.limit(max_broadcast + 1).count() > max_broadcast:
        rows = _numbered(documents)
        text = rows.select("row", F.col("doc.text").cast("string").alias("text"))
        return rows.join(_row_hits(text, windows, window, gram).select("row"), "row", "left_anti").select("doc.*")
    shared = documents.sparkSession.sparkContext.broadcast(_indexes(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                w = _words(data, offsets)
                h = w.hashes()
                grams, hit = Grams(h), np.zeros(len(h), bool)
                for s, index in shared.value.items():
                    marks, wins = _fingerprints(h, grams, s, window, gram)
                    hit |= covered(index.find(marks, wins, fits(w.first, s))[0], s, len(h))
                sums = np.concatenate(([0], np.cumsum(hit)))[w.first]
                yield rows.filter(pa.array(np.diff(sums) == 0))

    return documents.mapInArrow(run, documents.schema)
