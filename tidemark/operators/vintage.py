"""Point-in-time printings: first and latest value per key, derived fourth quarters, concept choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import QUARTER_DAYS

VINTAGE = ("first", "first_filed", "first_accn", "latest", "latest_filed", "latest_accn", "printings")


def vintage_agg(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and latest printing per key and the number of distinct values printed.

    Input columns value, filed, accn. Printings are collapsed per distinct value before the final aggregation, so a
    key with very many printings is combined map-side.
    """
    row = F.struct("filed", "accn", "value")
    per_value = df.groupBy(*keys, F.round("value", 3).alias("_v")).agg(F.min(row).alias("_a"), F.max(row).alias("_b"))
    g = per_value.groupBy(*keys).agg(
        F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.count("_v").alias("printings")
    )
    return g.select(
        *keys,
        F.col("_a.value").alias("first"),
        F.col("_a.filed").alias("first_filed"),
        F.col("_a.accn").alias("first_accn"),
        F.col("_b.value").alias("latest"),
        F.col("_b.filed").alias("latest_filed"),
        F.col("_b.accn").alias("latest_accn"),
        "printings",
    )


def basis_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rows per key, the first-reported and the latest-filed printing, told apart by ``basis``."""
    v = vintage_agg(df, keys)
    both = F.array(
        F.struct(
            F.lit("as_first_reported").alias("basis"),
            F.col("first").alias("value"),
            F.col("first_filed").alias("filed"),
            F.col("first_accn").alias("accn"),
        ),
        F.struct(
            F.lit("latest_filed").alias("basis"),
            F.col("latest").alias("value"),
            F.col("latest_filed").alias("filed"),
            F.col("latest_accn").alias("accn"),
        ),
    )
    return v.select(*keys, F.inline(both))


def derive_last_quarter(
    vint: DataFrame, keys: Sequence[str], end: str = "period_end", duration: str = "duration_months"
) -> DataFrame:
    """Quarterly vintages: reported quarters plus FY less 9M where no quarter is reported for the same key and end.

    ``vint`` holds one row per (keys, end, duration); year and nine-month rows meet when their ends lie one quarter
    apart. The nearest nine-month row wins, then the earlier end.
    """
    keys = list(keys)
    q = vint.where(F.col(duration) == 3).select(*keys, end, *VINTAGE, F.lit("reported 3M").alias("source"))
    fy = vint.where(F.col(duration) == 12)
    nine = vint.where(F.col(duration) == 9).select(
        *keys,
        F.col(end).alias("_end9"),
        F.col("first").alias("_f9"),
        F.col("latest").alias("_l9"),
        F.col("printings").alias("_p9"),
    )
    gap = F.datediff(F.col(end), F.col("_end9"))
    pairs = fy.join(nine, keys).where(gap.between(*QUARTER_DAYS))
    rest = [F.col(c) for c in VINTAGE] + [F.col("_f9"), F.col("_l9"), F.col("_p9")]
    one = pairs.groupBy(*keys, end).agg(F.min_by(F.struct(*rest), F.col("_end9")).alias("_r"))
    derived = one.select(
        *keys,
        end,
        (F.col("_r.first") - F.col("_r._f9")).alias("first"),
        F.col("_r.first_filed").alias("first_filed"),
        F.col("_r.first_accn").alias("first_accn"),
        (F.col("_r.latest") - F.col("_r._l9")).alias("latest"),
        F.col("_r.latest_filed").alias("latest_filed"),
        F.col("_r.latest_accn").alias("latest_accn"),
        F.greatest("_r.printings", "_r._p9").alias("printings"),
        F.lit("derived Q4 = FY - 9M").alias("source"),
    )
    return q.unionByName(derived.join(q.select(*keys, end), [*keys, end], "left_anti"))


def pin_concept(df: DataFrame, entity: Sequence[str], concept: str, value: str) -> DataFrame:
    """Per entity the concept with the most periods; equals go to the larger median, then to the smaller name.

    One (entity, concept) history is a few hundred periods, so the built-in median sees small groups only.
    """
    stats = df.groupBy(*entity, concept).agg(F.count(value).alias("_n"), F.median(value).alias("_med"))
    best = F.min_by(concept, F.struct(-F.col("_n"), -F.col("_med"), F.col(concept))).alias(concept)
    return stats.groupBy(*entity).agg(best)


def lowest_priority(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Rows of each key that carry the key's best (lowest) priority."""
    best = df.groupBy(*keys).agg(F.min(priority).alias(priority))
    return df.join(best, [*keys, priority], "left_semi")


def collapse_members(df: DataFrame, keys: Sequence[str], value: str, rest: Sequence[str], by: str) -> DataFrame:
    """One row per key: values summed, the other columns from the row with the smallest ``by``."""
    firsts = [F.min_by(c, by).alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.sum(value).alias(value), *firsts)


def modal(df: DataFrame, keys: Sequence[str], label: str, latest: str) -> DataFrame:
    """Most frequent label per key; ties go to the label seen last, then to the smaller text."""
    n = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_n"), F.max(latest).alias("_last")
    )
    top = n.groupBy(*keys).agg(F.max(F.struct("_n", "_last")).alias("_t"))
    hit = n.join(top, list(keys)).where((F.col("_n") == F.col("_t._n")) & (F.col("_last") == F.col("_t._last")))
    return hit.groupBy(*keys).agg(F.min(label).alias(label))


def repair_units(df: DataFrame, keys: Sequence[str], value: str, is_share: Column, medians: DataFrame) -> DataFrame:
    """Share values a hundred times under their metric's median are taken as thousands: scaled and flagged."""
    d = df.join(medians, list(keys), "left")
    fix = F.coalesce(is_share & (F.col(value) < F.col("med") / 100), F.lit(False))
    d = d.withColumn("unit_fix", fix)
    return d.withColumn(value, F.when(F.col("unit_fix"), F.col(value) * 1000).otherwise(F.col(value)))


def keep_dominant(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Rows in each entity's most frequent unit; ties go to the smaller name."""
    n = df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("_n"))
    top = n.groupBy(*keys).agg(F.min_by(unit, F.struct(-F.col("_n"), F.col(unit))).alias(unit))
    return df.join(top, [*keys, unit], "left_semi")


def first_filed(df: DataFrame, keys: Sequence[str], filed: str = "filed", accn: str = "accn") -> DataFrame:
    """The first filing's row per key."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(filed, accn)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
