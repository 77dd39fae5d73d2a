"""Leads and lags: one vector per series, every series against every target of a list, rank correlations in arrays.

A series' quarters are bounded by the calendar, so each is one row with an array. Sources and targets are packed, some to a
row; a row of both is a tile of pairs, whose correlations at all lags are taken together. A pair is one row from there on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.session import dealt

C = F.col
SOURCES, TARGETS = 64, 32  # vectors in a packed row
BLOCKS = 4  # tasks that pack the target list
CELLS = 1 << 21  # numbers in one array of a tile
_LAGS = "array<struct<lag:int,n:bigint,rho:double>>"


def _packed(d: DataFrame, name: str, size: int) -> DataFrame:
    """Up to ``size`` rows of a partition as one row with an array of structs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=[name])

    return d.mapInArrow(pack, f"{name} array<{d.schema.simpleString()}>")


def _grid(at: pa.Array, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions at which any vector has a value; per vector and position the value's place in order, and 1 where it has one."""
    size = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.repeat(at.to_numpy(zero_copy_only=False) - (np.cumsum(size) - size), size) + np.arange(len(row))
    flat = values.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    _, order = np.unique(flat.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)
    places, col = np.unique(pos[known], return_inverse=True)
    codes, has = np.zeros((len(size), len(places))), np.zeros((len(size), len(places)))
    codes[row[known], col], has[row[known], col] = order, 1
    return places, codes, has


def _ranks(codes: np.ndarray, has: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Average rank of each value among those of its vector that the other side's vector has too: (vector, position, other).

    It counts the smaller values and half the equal ones, itself included. Ranks where the other has no value mean nothing.
    """
    n = codes.shape[1]
    out = np.empty((*codes.shape, len(other)))
    step = max(1, CELLS // max(codes.size, 1))
    for lo in range(0, n, step):
        mine, all_ = codes[:, lo : lo + step, None], codes[:, None, :]
        above = ((mine > all_) + 0.5 * (mine == all_)) * has[:, None, :]
        out[:, lo : lo + step] = (above.reshape(-1, n) @ other.T).reshape(len(codes), -1, len(other))
    return out + 0.5


def _spearman(x: np.ndarray, x_has: np.ndarray, y: np.ndarray, y_has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common positions and rank correlation of every row of x with every row of y; no number where either does not vary."""
    both = x_has[:, :, None] * y_has.T[None]
    a = _ranks(x, x_has, y_has) * both
    b = _ranks(y, y_has, x_has).transpose(2, 1, 0) * both
    n = x_has @ y_has.T
    total = n * (n + 1) / 2  # ranks with ties averaged always add up to this
    dot = lambda p, q: n * np.einsum("sit,sit->st", p, q) - total * total
    root = np.sqrt(dot(a, a) * dot(b, b))
    return n, np.divide(dot(a, b), root, out=np.full(n.shape, np.nan), where=root != 0)


def _tile(sources: pa.StructArray, targets: pa.StructArray, lags: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and correlations of all pairs of a tile: (source, target, lag)."""
    x_at, x, x_has = _grid(sources.field("x_at"), sources.field("x"))
    y_at, y, y_has = _grid(targets.field("y_at"), targets.field("y"))
    n, rho = np.zeros((len(x), len(y), len(lags))), np.full((len(x), len(y), len(lags)), np.nan)
    for k, lag in enumerate(lags):
        _, i, j = np.intersect1d(x_at + lag, y_at, assume_unique=True, return_indices=True)
        across = min(len(y), max(1, CELLS // max(len(i), 1)))
        down = max(1, CELLS // max(len(i) * across, 1))
        for t in range(0, len(y), across):
            yt, yt_has = y[t : t + across, j], y_has[t : t + across, j]
            for s in range(0, len(x), down):
                at = (slice(s, s + down), slice(t, t + across), k)
                n[at], rho[at] = _spearman(x[s : s + down, i], x_has[s : s + down, i], yt, yt_has)
    return n.astype(np.int64), np.where(n >= least, rho, np.nan)


def vectors(d: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """One row per key: ``<out>_at`` its first position, ``<out>`` its values from there on, null in gaps."""
    m = F.map_from_entries(F.collect_list(F.struct(pos, value)))
    g = d.where(C(value).isNotNull()).groupBy(key).agg(F.min(pos).alias(f"{out}_at"), F.max(pos).alias("_to"), m.alias("_m"))
    return g.select(key, f"{out}_at", F.transform(F.sequence(f"{out}_at", "_to"), lambda q: F.element_at("_m", q)).alias(out))


def lagged_pairs(source: DataFrame, targets: DataFrame, lags: Sequence[int], least: int, keep: Column) -> DataFrame:
    """Pairs of source and target vectors that pass ``keep``, with ``lags``: an array of (lag, n, rho) in the order given,
    rho null below ``least`` common quarters. ``source`` holds x_at, x and ``targets`` y_at, y besides their keys.

    Every source meets the whole target list. The sources go out once; the list, packed, is broadcast only if it passes
    Spark's size check, else packed rows of both sides meet in a Cartesian product, which has tasks for each pair of partitions.
    """
    mine = [c for c in source.columns if c not in ("x_at", "x")]
    names = [c for c in targets.columns if c not in ("y_at", "y")]
    # A row of a few hundred bytes stands for a block of correlations: deal rows by number, not by their bytes.
    s = _packed(dealt(source, *source.columns), "sources", SOURCES)
    p = s.crossJoin(_packed(targets.repartition(BLOCKS), "targets", TARGETS))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for xs, ys in zip(b.column("sources"), b.column("targets"), strict=True):
                n, rho = (v.ravel() for v in _tile(xs.values, ys.values, lags, least))
                i, j = (pa.array(v.ravel()) for v in np.indices((len(xs), len(ys))))
                lag = pa.array(np.tile(np.array(lags, np.int32), len(i)))
                at = pa.StructArray.from_arrays([lag, pa.array(n), pa.array(rho, mask=np.isnan(rho))], names=["lag", "n", "rho"])
                ends = pa.array(np.arange(len(i) + 1, dtype=np.int32) * len(lags))
                out = [xs.values.field(c).take(i) for c in mine] + [ys.values.field(c).take(j) for c in names]
                yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(ends, at)], names=[*mine, *names, "lags"])

    fields = [source.schema[c] for c in mine] + [targets.schema[c] for c in names]
    all_lags = StructField("lags", StructType.fromDDL(f"lags {_LAGS}")["lags"].dataType)
    return p.mapInArrow(cross, StructType([*fields, all_lags])).where(keep)


def lead_gain(pairs: DataFrame) -> DataFrame:
    """Adds rho_lag0 to rho_lag2 and by how much the better lead beats lag 0; pairs without all three are left out."""
    rho = [F.get("lags", F.lit(i))["rho"].alias(f"rho_lag{i}") for i in range(3)]
    p = pairs.select("*", *rho).drop("lags").where("rho_lag0 IS NOT NULL AND rho_lag1 IS NOT NULL AND rho_lag2 IS NOT NULL")
    return p.withColumn("lead_gain", F.greatest("rho_lag1", "rho_lag2") - C("rho_lag0"))


def shifted(targets: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """Each target's values moved ``shift`` places around its own dates (a target's history is one small group)."""
    w = Window.partitionBy("target").orderBy("qn")
    t = targets.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target")))
    to = t.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    to = to.select("target", "shift", C("t_yoy"), F.pmod(C("i") + C("shift"), C("n")).alias("i"))
    return t.select("target", "qn", "i").join(to, ["target", "i"]).drop("i")
