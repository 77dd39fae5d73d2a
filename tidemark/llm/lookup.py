"""Adding a per-key value to rows whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 1_000_000
HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``table`` (one small row per key, already written; ``count`` is the rows of ``rows`` that it fits).

    Null keys meet. Up to ``most`` keys the table is broadcast. Beyond that only keys that hold at least one in
    ``HOT_SHARE`` of all counted rows are, so at most ``HOT_SHARE`` of them, and the others, none of them hot, meet in
    a shuffle.
    """
    on = f"_{key}"
    table = table.withColumnRenamed(key, on)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left[key].eqNullSafe(right[on]), how).drop(on)

    size = table.agg(F.count(F.lit(1)).alias("keys"), F.sum(count).alias("rows")).first()
    if size["keys"] <= most:
        return joined(rows, F.broadcast(table.drop(count)), "left")
    hot: Column = F.col(count) * HOT_SHARE >= size["rows"]
    few = table.where(hot).drop(count)
    fields = [c for c in few.columns if c != on]
    first = joined(rows, F.broadcast(few.withColumn("_hot", F.lit(True))), "left")
    cold = joined(first.where("_hot IS NULL").drop("_hot", *fields), table.where(~hot).drop(count), "left")
    return first.where("_hot").drop("_hot").unionByName(cold)
