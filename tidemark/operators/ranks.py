"""Ranks, positions, running sums and exact percentiles of groups of any size.

A plain window sorts a whole group in one task, and the built-in exact ``percentile`` holds all of a group's values
in one buffer. Here the rows are dealt by ranges of (keys, value, tie) that Spark takes from the data, so values that
lie close together spread like any others. The dealt rows are written to the shared folder before anything is read
off them: the range a row lies in is then fixed, and a lost executor reads the same rows again. Inside a range a window
runs over (keys, range), at most one range's rows; between ranges only their totals are summed, one row per group and
range. Equal values are collapsed by a map-side aggregation first where their order does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows written in ranges of (keys, order); ``_range`` numbers the ranges in that order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *keys, *order)).withColumn("_range", F.spark_partition_id())


def _prefix(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, out: str) -> DataFrame:
    """Adds to dealt rows the weight of all earlier rows of their group, and the group's weight ``n``."""
    keys = list(keys)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = (
        dealt.groupBy(*keys, "_range")
        .agg(F.sum(weight).alias("_rw"))
        .withColumn("_base", F.coalesce(F.sum("_rw").over(_before(part.orderBy("_range"))), F.lit(0.0)))
        .withColumn("n", F.sum("_rw").over(part))
        .drop("_rw")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    local = dealt.withColumn("_in", F.coalesce(F.sum(weight).over(_before(inside)), F.lit(0.0)))
    return local.join(totals, [*keys, "_range"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in")


def distinct_prefix(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, value): its weight ``w`` and ``before``, the weight of all smaller values of the group.

    Without ``weight`` every row counts 1, so ``before + 1`` is the first rank of the value. Rows without a value or
    with a null key are left out.
    """
    keys = list(keys)
    w = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.alias("w"))
    return _prefix(_dealt(vals, keys, [value]), keys, [value], "w", "before")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, size: str | None = None) -> DataFrame:
    """Adds the rank of ``value`` in its group with ties averaged (null for a null value); ``size`` adds the group count."""
    keys = list(keys)
    cols = [(F.col("before") + (F.col("w") + 1) / 2).alias(out)]
    if size:
        cols.append(F.col("n").cast("long").alias(size))
    return df.join(distinct_prefix(df, keys, value).select(*keys, value, *cols), [*keys, value], "left")


def running_before(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, weight: Column | None = None, out: str = "before"
) -> DataFrame:
    """Adds the weight of all rows of the group that come earlier by (value, tie); ``tie`` must be unique in a value.

    The ranges are of value and tie, so a third of all rows may share one value. Rows with a null value or a null key
    get none.
    """
    keys = list(keys)
    rows = df.withColumn("_w", F.lit(1.0) if weight is None else weight)
    known = F.col(value).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    dealt = _dealt(rows, keys, [value, tie])
    got = _prefix(dealt.where(known), keys, [value, tie], "_w", out).drop("n", "_w")
    rest = dealt.where(~known).drop("_range", "_w").withColumn(out, F.lit(None).cast("double"))
    return got.unionByName(rest)


def position(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """1-based position by (value, tie) in the group; null values get none."""
    return running_before(df, keys, value, tie, out="_pos").withColumn(out, (F.col("_pos") + 1).cast("int")).drop("_pos")


def percentiles(
    df: DataFrame, keys: Sequence[str], values: str | Sequence[str], probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group, all value columns in one pass.

    ``weight`` names a column that says how many times a row counts, for values collapsed before. Columns are ``<prob name>`` for one value column and ``<value>_<prob name>`` for several, beside ``n`` (per value
    column ``<value>_n``).
    """
    keys = list(keys)
    many = not isinstance(values, str)
    names = list(values) if many else [values]
    stacked = F.inline(F.array(*[F.struct(F.lit(v).alias("_m"), F.col(v).cast("double").alias("_x")) for v in names]))
    times = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ranked = distinct_prefix(df.select(*keys, times.alias("_t"), stacked), [*keys, "_m"], "_x", F.col("_t"))
    aggs = []
    for v in names:
        mine = F.col("_m") == v
        aggs.append(F.max(F.when(mine, F.col("n"))).alias(f"_n_{v}"))
        for name, p in probs.items():
            at = (F.col("n") - 1) * p
            for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                holds = mine & (F.col("before") <= pos) & (pos < F.col("before") + F.col("w"))
                aggs.append(F.max(F.when(holds, F.col("_x"))).alias(f"_{tag}_{v}_{name}"))
    got = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for v in names:
        n = F.col(f"_n_{v}")
        cols.append(n.cast("long").alias(f"{v}_n" if many else "n"))
        for name, p in probs.items():
            at = (n - 1) * p
            lo, hi = F.col(f"_lo_{v}_{name}"), F.col(f"_hi_{v}_{name}")
            cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{v}_{name}" if many else name))
    return got.select(*keys, *cols)


def quantile_bucket(pos: Column, n: Column, buckets: int = 5) -> Column:
    """0-based equal-count bucket of a 1-based position, right-closed edges interpolated as in an exact quantile cut."""
    return F.greatest(F.ceil((pos - 1) * buckets / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0)).cast("int")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per group. The rank filter is pushed below the shuffle, so each task forwards at most ``n``
    rows per group and a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    got = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return got.withColumnRenamed("_rn", out) if out else got.drop("_rn")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``: a map-side combined ``max_by``, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
