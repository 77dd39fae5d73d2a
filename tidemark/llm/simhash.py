"""SimHash near-duplicates with covering locality-sensitive hashing.

Every bit position gets a random non-zero vector of ``radius + 1`` bits. For each non-zero vector v there is one table;
its mask keeps the positions whose vector has an odd product with v. Two fingerprints that differ in at most
``radius`` positions leave some v orthogonal to all differing positions, so that table's mask hides every difference
and the two collide there: no linked pair is missed, with 2^(radius+1) - 1 tables.

Equal fingerprints are merged before any table is built, and buckets with one member are dropped. A bucket of many
members is cut into chunks, and each pair of chunks is compared as a tile of XORs; of a tile only links that join
parts not yet joined inside it are passed on (at most one per member), which keeps every component whole. Components
come from rounds of large-star and small-star steps over the links, cut by reliable checkpoints.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows that repeat a doc_id keep a
row each, with the fingerprint of their own text; the component is that of the doc_id's fingerprint; a null doc_id is
never a component's smallest id unless all are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import SPACES, Words, lower_ascii, separator_table, text_blocks
from tidemark.session import cut_lineage

SHINGLE = 4
RADIUS = 4
SEED = 42
CHUNK = 512
_SEPARATORS = separator_table(SPACES)


def _fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Majority of the bits of the shingles' XXH64; no words give zero."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: len(words) - shingle]))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _printed(rows: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns of longs before ``text``, the last one, and fp in its place."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                low, at = lower_ascii(data).tobytes(), offsets.tolist()
                fp = [_fingerprint(low[a:b].split(), shingle, seed) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(np.array(fp, np.uint64).view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _printed(docs, shingle, seed)


def masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """The covering masks; every vector occurs about equally often among the bit positions."""
    full = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    vectors = rng.permutation(np.resize(np.arange(1, full), bits))
    odd = lambda a, b: bin(a & b).count("1") & 1
    return [sum(1 << i for i in range(bits) if odd(int(vectors[i]), v)) for v in range(1, full)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, split: int, radius: int) -> tuple[list[int], list[int]]:
    """Links that join the members of a tile; with ``split`` only pairs across it are compared."""
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for i in range(split or len(x)):
        rest = max(split, i + 1)
        for j in (np.flatnonzero(np.bitwise_count(x[rest:] ^ x[i]) <= radius) + rest).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                left.append(i)
                right.append(j)
    return left, right


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits, enough to join them all."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    members = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    crowded = members.join(sizes, ["t", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int"))
    # A member of part p meets the other parts q in the tiles (p, q) and (q, p), p < q, and its own part in (p, p).
    tiles = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "t", "key", "fp", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("second")
    )
    grouped = tiles.groupBy("t", "key", "lo", "hi").agg(F.collect_list(F.struct("second", "fp")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            col, across = batch.column(0), (pd.Series(batch.column(1)) != pd.Series(batch.column(2))).to_numpy()
            offs = col.offsets.to_numpy()
            fps, second = col.values.field("fp").to_numpy().view(np.uint64), col.values.field("second").to_numpy(zero_copy_only=False)
            for k, (s, e) in enumerate(zip(offs[:-1], offs[1:])):
                order = np.argsort(second[s:e], kind="stable")
                x = fps[s:e][order]
                split = int((~second[s:e]).sum()) if across[k] else 0
                if across[k] and split in (0, len(x)):
                    continue
                i, j = _forest(x, split, radius)
                a.append(x[i])
                b.append(x[j])
            both = [np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in both], ["a", "b"])

    return grouped.select("m", "lo", "hi").mapInArrow(compare, "a long, b long").distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: neighbours move to the smallest neighbour of their centre."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b); nodes without an edge are left out."""
    now = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        now = cut_lineage(_stars(_stars(now, True), False))
    raise RuntimeError("components did not settle")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked to it, through others too)."""
    prints = cut_lineage(fingerprints(documents, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), radius, chunk))
    by_root = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written once, so that the join below stands on two plain exchanges and a large component's part can be split.
    least = cut_lineage(by_root.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_fp = by_root.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id, then the smallest text hash.

    Rows are told apart by doc_id and text, so texts that share a doc_id stand for themselves; of rows that repeat both
    one stays. Rows with a null doc_id cannot be told apart by it; they are kept and are nobody's duplicate.
    """
    named, unnamed = documents.where(F.col("doc_id").isNotNull()), documents.where(F.col("doc_id").isNull())
    number, mark = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    prints = _printed(named.select(number.alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text")), shingle)
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("first")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    first = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.doc_id").alias("_kept"), F.col("first.mark").alias("_mark"))
    return named.join(kept, (number == F.col("_kept")) & (mark == F.col("_mark")), "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(unnamed)
