"""As-of, nearest and tolerance joins.

Both sides are first reduced to one row per (key, date), so a key's window is never longer than its calendar however
many rows the key has; the matches then go back to the left rows by an equi-join. Nearest and tolerance joins meet
in date buckets, so a row only ever sees rows a few days away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _one_per_date(df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """The greatest value row per key and date."""
    return df.groupBy(*keys, F.col(t).alias("_t")).agg(F.max(F.struct(F.col(t).alias(f"_{t}"), *values)).alias("_v"))


def _directed(left, right, keys, lt, rt, values, inclusive, ahead):
    keys = list(keys)
    r = _one_per_date(right, keys, rt, values).withColumn("_side", F.lit(0 if inclusive else 2))
    points = left.select(*keys, F.col(lt).alias("_t")).distinct()
    points = points.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_side", F.lit(1))
    u = r.select(*keys, "_t", "_v", "_side").unionByName(points)
    order = [F.desc("_t") if ahead else F.asc("_t"), "_side"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = u.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*keys, "_t", "_m")
    got = left.withColumn("_t", F.col(lt)).join(hit, [*keys, "_t"], "left")
    cols = [F.col(f"_m._{rt}").alias(f"matched_{rt}")] + [F.col(f"_m.{v}").alias(v) for v in values]
    return got.select(*left.columns, *cols)


def backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    inclusive: bool = True,
) -> DataFrame:
    """Latest right row at or before each left row's date; adds ``matched_<right_time>`` and the values."""
    return _directed(left, right, keys, left_time, right_time, values, inclusive, ahead=False)


def forward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    inclusive: bool = False,
) -> DataFrame:
    """First right row after (or at, when inclusive) each left row's date."""
    return _directed(left, right, keys, left_time, right_time, values, inclusive, ahead=True)


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)


def within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, low: int, high: int
) -> DataFrame:
    """All pairs of one key with ``low <= right - left <= high`` days, through date buckets as wide as the band.

    Column names other than the keys must differ between the two sides.
    """
    width = max(high - low + 1, 1)
    lo = _bucket(F.date_add(F.col(left_time), low), width)
    hi = _bucket(F.date_add(F.col(left_time), high), width)
    lb = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    rb = right.withColumn("_b", _bucket(F.col(right_time), width))
    gap = F.datediff(F.col(right_time), F.col(left_time))
    return lb.join(rb, [*keys, "_b"]).where(gap.between(low, high)).drop("_b")


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tolerance: int,
) -> DataFrame:
    """Closest right row within ``tolerance`` days per left row (a tie goes to the earlier date), else nulls."""
    keys = list(keys)
    r = _one_per_date(right, keys, right_time, values)
    points = left.select(*keys, F.col(left_time).alias("_lt")).distinct()
    pairs = within(points, r, keys, "_lt", "_t", -tolerance, tolerance)
    best = pairs.groupBy(*keys, "_lt").agg(
        F.min_by("_v", F.struct(F.abs(F.datediff("_t", "_lt")), F.col("_t"))).alias("_m")
    )
    got = left.withColumn("_lt", F.col(left_time)).join(best, [*keys, "_lt"], "left")
    cols = [F.col(f"_m._{right_time}").alias(f"matched_{right_time}")]
    return got.select(*left.columns, *cols, *[F.col(f"_m.{v}").alias(v) for v in values])
