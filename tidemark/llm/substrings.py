"""Substring dedup: runs of ``window`` words that an earlier document also has, found with repeated-phrase automata.

1. Candidates. A document's windows are grouped by winnowing: each window belongs to the smallest of its
   ``gram``-word hashes, its anchor, and the consecutive windows of one anchor occurrence form a context. The same
   window has the same anchor everywhere, so only contexts whose anchor several documents have can matter. Anchors are
   counted first (map-side combine); the second reading writes the contexts of repeated anchors only. A sketch of fixed
   size keeps most others out; what it lets through in error does no harm.
2. Confirmation. A context seen in two documents recurs with all its windows; where an anchor has several contexts, the
   windows of each context's first document are counted one by one. The recurring windows of a document that is the
   first to have them, merged, are its passages, cut into pieces of ``piece`` words that overlap by a window less one.
   Every recurring hash (of a context or a window) names the pieces that it lies in.
3. Automata. Each document gets the pieces named by hashes that it holds itself. Each block of documents cuts its pieces
   into tiles of ``tile`` words so that every window of a piece holds a whole tile, and compiles them into one
   Aho-Corasick automaton over word numbers. All documents of the block are streamed through it; at every tile found,
   document and piece are compared word by word, and equal runs of ``window`` words or more are removed if the piece
   comes from a smaller doc_id.

So the automata are sharded with the documents, and a document holds a window of every piece that it is sent: what one
task collects for it is bounded by its own length. The text is shuffled once (compressed) and kept as a checkpoint
partitioned by doc_id, which the later joins reuse; pieces travel compressed.

Defined cases: a null text has no words, its kept text is empty; rows that repeat a doc_id, with equal or
different texts, are judged against smaller ids only and keep a row each; rows with a null doc_id are returned whole and are nobody's source; extra columns are
ignored. Kept text is the kept words joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import BLOCK_BYTES, SPACES, Grams, Words, fits, owner, separator_table, sliding_min
from tidemark.session import cut_dealt, cut_lineage

WINDOW = 50
GRAM = 20
TILE = 20
PIECE = 256
SKETCH_BITS = 1 << 25
_FLUSH = 1 << 20
_SEPARATORS = separator_table(SPACES)
_PLACE = np.uint64((1 << 28) - 1)


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        words = [b" ".join((t.as_py() or b"").split()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress(w) for w in words], pa.binary())], ["doc_id", "z"])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """Rows ``a:b`` of a batch with a packed column ``z``, unpacked, in blocks of bounded size."""
    unzip = zstandard.ZstdDecompressor()
    parts, at, size = [], 0, 0
    col = batch.column(batch.schema.get_field_index("z"))
    for i in range(batch.num_rows):
        parts.append(unzip.decompress(col[i].as_py()))
        size += len(parts[-1])
        if size >= BLOCK_BYTES or i == batch.num_rows - 1:
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield at, i + 1, Words(np.frombuffer(b"".join(parts), np.uint8), offsets, _SEPARATORS)
            parts, at, size = [], i + 1, 0


def _contexts(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Grams]:
    """First and last window of every context, its anchor's hash, the hash of its words."""
    grams = Grams(w.hashes())
    small = grams.of(gram)
    key = (small & ~_PLACE) | np.arange(len(small), dtype=np.uint64)
    chosen = (sliding_min(key, window - gram + 1) & _PLACE).astype(np.int64)
    at = np.flatnonzero(fits(w.first, window))
    chosen = chosen[at]
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(at) else at
    low, high = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    return low, high, small[chosen[new]], grams.spans(low, high + window), grams


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _windows_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low + 1
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _wanted(batch: pa.RecordBatch, name: str, a: int, b: int) -> list[np.ndarray]:
    """A list column's values per row, as unsigned hashes."""
    col = batch.column(batch.schema.get_field_index(name))
    return [np.array(col[i].as_py() or [], np.int64).view(np.uint64) for i in range(a, b)]


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(SKETCH_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _sketch(rows: DataFrame, column: str) -> np.ndarray:
    """A bit per hash of the column, ``SKETCH_BITS`` in all whatever the number of rows; bits are joined in the shuffle."""
    at = F.col(column).bitwiseAND(SKETCH_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    got = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SKETCH_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _span(hashes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Distinct hashes with the smallest and largest id."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    last = np.append(first[1:], len(hashes)) - 1
    return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(ids[first]), pa.array(ids[last])], ["h", "low", "high"])


def _combined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Joins a task's (hashes, ids) in buffers of bounded size before they are shuffled."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in found:
        parts.append(pair)
        size += len(pair[0])
        if size >= _FLUSH:
            yield _span(*map(np.concatenate, zip(*parts)))
            parts, size = [], 0
    if size:
        yield _span(*map(np.concatenate, zip(*parts)))


class _Passages:
    """The pieces sent to a block's documents, as (source, text), and their automaton."""

    def __init__(self, pieces: list[tuple[int, bytes]], window: int, tile: int) -> None:
        self.sources = [s for s, _ in pieces]
        parts = [t for _, t in pieces]
        w = Words(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))), _SEPARATORS)
        self.first, self.words, self.window, self.tile = w.first.tolist(), w.hashes(), window, tile
        symbols = _symbols(self.words)
        self.places: list[list[tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        known: dict[tuple[int, ...], int] = {}
        for p in range(len(parts)):
            for at in range(self.first[p], self.first[p + 1] - tile + 1, window - tile + 1):
                key = tuple(symbols[at : at + tile])
                number = known.setdefault(key, len(known))
                if number == len(self.places):
                    self.places.append([])
                    self.automaton.add_word(key, number)
                self.places[number].append((p, at))
        if self.places:
            self.automaton.make_automaton()

    def cover(self, doc_id: int, words: np.ndarray, symbols: list[int]) -> np.ndarray:
        """True at every word inside a window of a passage from a smaller doc_id."""
        hit = np.zeros(len(words), bool)
        if not self.places or len(words) < self.window:
            return hit
        seen = set()
        for end, number in self.automaton.iter(tuple(symbols)):
            for p, at in self.places[number]:
                shift = end - self.tile + 1 - at  # document position minus passage position
                if (p, shift) in seen or self.sources[p] >= doc_id:
                    continue
                seen.add((p, shift))
                low, high = max(0, self.first[p] + shift), min(len(words), self.first[p + 1] + shift)
                starts, ends = _runs(words[low:high] == self.words[low - shift : high - shift])
                for s, e in zip(starts, ends):
                    if e - s >= self.window:
                        hit[low + s : low + e] = True
        return hit


def _symbols(words: np.ndarray) -> list[int]:
    return (words & np.uint64(0x3FFFFFFF)).tolist()


def remove_repeated(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (text without the windows that a smaller doc_id has)."""
    if not 0 < gram <= window or not 0 < tile <= window or piece < window:
        raise ValueError("gram and tile must fit into a window, a window into a piece")
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = cut_dealt(docs.mapInArrow(_packed_words, "doc_id long, z binary"), parts, "doc_id")
    named = text.where("doc_id IS NOT NULL")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, b, w in _blocks(batch):
                    low, _, anchor, _, _ = _contexts(w, window, gram)
                    yield anchor, ids[a:b][owner(w.first)[low]]

        return _combined(found())

    repeated = named.mapInArrow(anchors, "h long, low long, high long").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    anchor_bits = _sketch(repeated.where("low < high"), "h")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, w in _blocks(batch):
                low, _, anchor, words, _ = _contexts(w, window, gram)
                take = np.flatnonzero(_held(anchor_bits, anchor))
                own = ids[a:b][owner(w.first)[low[take]]]
                yield pa.RecordBatch.from_arrays([pa.array(words[take].view(np.int64)), pa.array(anchor[take].view(np.int64)), pa.array(own)], ["h", "a", "doc_id"])

    seen = cut_lineage(named.mapInArrow(contexts, "h long, a long, doc_id long"))
    distinct = seen.groupBy("h").agg(F.min("doc_id").alias("s"), F.max("doc_id").alias("last"), F.first("a").alias("a"))
    shared = distinct.groupBy("a").agg(F.count(F.lit(1)).alias("variants"), F.min("s").alias("from"), F.max("last").alias("to")).where("from < to")
    known = cut_lineage(distinct.join(shared, "a").where("s < last OR variants > 1").select("h", "s", "last", "variants"))
    recurring = known.where("s < last").select("h", "s")

    # Windows one by one where an anchor has several contexts: those of each context's first document.
    mixed = cut_lineage(known.where("variants > 1").groupBy(F.col("s").alias("doc_id")).agg(F.collect_list("h").alias("hs")))
    first_of_mixed = named.join(mixed, "doc_id")

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, w in _blocks(batch):
                low, high, _, words, grams = _contexts(w, window, gram)
                at = np.flatnonzero(np.isin(words, np.concatenate(_wanted(batch, "hs", a, b))))
                at = _windows_of(low[at], high[at])
                yield grams.of(window)[at], ids[a:b][owner(w.first)[at]]

    singles = first_of_mixed.mapInArrow(lambda it: _combined(windows_of(it)), "h long, low long, high long")
    again = cut_lineage(singles.groupBy("h").agg(F.min("low").alias("s"), F.max("high").alias("last")).where("s < last").select("h", "s"))

    # Passages of the first documents, in pieces, and the pieces that each recurring hash lies in.
    wanted = recurring.unionByName(again).groupBy(F.col("s").alias("doc_id")).agg(F.collect_list("h").alias("hs"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, names = zstandard.ZstdCompressor(), ["h", "s", "piece", "z"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, w in _blocks(batch):
                low, high, _, words, grams = _contexts(w, window, gram)
                own, wins, hs = owner(w.first)[low], grams.of(window), _wanted(batch, "hs", a, b)
                for j in range(b - a):
                    begin, end = int(w.first[j]), int(w.first[j + 1])
                    mine = slice(*np.searchsorted(own, [j, j + 1]))
                    take = np.isin(words[mine], hs[j])
                    lows, highs = low[mine][take] - begin, high[mine][take] - begin
                    single = np.flatnonzero(np.isin(wins[begin : max(begin, end - window + 1)], hs[j]))
                    delta = np.zeros(end - begin + 1, np.int64)
                    np.add.at(delta, np.concatenate((lows, single)), 1)
                    np.add.at(delta, np.concatenate((highs, single)) + window, -1)
                    starts, ends = _runs(np.cumsum(delta[:-1]) > 0)
                    step = piece - window + 1
                    count = np.maximum(-(-(ends - starts - window + 1) // step), 1)
                    number = np.cumsum(count) - count  # of each run's first piece

                    def pieces(at: np.ndarray) -> np.ndarray:
                        run = np.searchsorted(starts, at, side="right") - 1
                        return number[run] + (at - starts[run]) // step

                    keys = np.concatenate((words[mine][take], wins[begin + single]))
                    lo, hi = pieces(np.concatenate((lows, single))), pieces(np.concatenate((highs, single)))
                    spread = hi - lo + 1
                    of = _windows_of(lo, hi)
                    keys = np.repeat(keys, spread)
                    texts = []
                    for s, e, n in zip(starts, ends, count):
                        for k in range(n):
                            u, v = begin + s + k * step, begin + min(e, s + k * step + piece)
                            texts.append(zip_.compress(w.data[w.starts[u] : w.ends[v - 1]].tobytes()))
                    m, n = len(keys), len(texts)
                    if n:
                        columns = [pa.array(keys.view(np.int64)), pa.array(np.full(m, ids[a + j])), pa.array(of.astype(np.int64)), pa.nulls(m, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, ids[a + j])), pa.array(np.arange(n)), pa.array(texts, pa.binary())], names)

    placed = cut_lineage(named.join(wanted, "doc_id").mapInArrow(passages, "h long, s long, piece long, z binary"))
    places = placed.where("z IS NULL").select("h", "s", "piece").distinct()
    window_bits = _sketch(again, "h")

    def held_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, ids in windows_of(batches):
            take = _held(window_bits, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[take].view(np.int64)), pa.array(ids[take])], ["h", "doc_id"])

    holders = seen.select("h", "doc_id").unionByName(first_of_mixed.mapInArrow(held_windows, "h long, doc_id long"))
    pairs = holders.join(places, "h").where("s < doc_id").select("doc_id", "s", "piece").distinct()
    sent = pairs.join(placed.where("z IS NOT NULL").select("s", "piece", "z"), ["s", "piece"])
    routed = sent.groupBy("doc_id").agg(F.collect_list(F.struct("s", "z")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2)
            for a, b, w in _blocks(batch):
                pieces = {(x["s"], x["z"]) for i in range(a, b) for x in found[i].as_py() or []}
                library, words = _Passages([(s, unzip.decompress(z)) for s, z in sorted(pieces)], window, tile), w.hashes()
                gone, kept = [], []
                for j in range(b - a):
                    begin, end = int(w.first[j]), int(w.first[j + 1])
                    body = w.data[w.offsets[j] : w.offsets[j + 1]].tobytes()
                    hit = np.zeros(0, bool)
                    if library.places and ids[a + j] is not None:
                        hit = library.cover(ids[a + j], words[begin:end], _symbols(words[begin:end]))
                    gone.append(int(hit.sum()))
                    kept.append(b" ".join(compress(body.split(), (~hit).tolist())) if gone[-1] else body)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(w.first).astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return text.join(routed, "doc_id", "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
