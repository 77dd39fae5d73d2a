"""Statement grids: every item of a filer by year and quarter, on both bases, with margins and growth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import windows as W

C = F.col
BASES = ("as_first_reported", "latest_filed")


def both_bases(filings: DataFrame, keys: Sequence[str], items: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key and basis: each item as the first filing printed it and as the last one did.

    A filing that leaves an item out (null) says nothing about it.
    """
    when = lambda c: F.when(C(c).isNotNull(), F.struct(*order))
    g = filings.groupBy(*keys).agg(
        F.struct(F.lit(BASES[0]).alias("basis"), *[F.min_by(c, when(c)).alias(c) for c in items]).alias("_first"),
        F.struct(F.lit(BASES[1]).alias("basis"), *[F.max_by(c, when(c)).alias(c) for c in items]).alias("_last"),
    )
    return g.select(*keys, F.inline(F.array("_first", "_last")))


def statement_grid(
    filings: DataFrame, keys: Sequence[str], flows: Sequence[str], stocks: Sequence[str], ratios: Mapping[str, tuple[str, str]],
    growth: Mapping[str, tuple[str, int]], order: Sequence[str],
) -> DataFrame:
    """Rows (keys, basis, item, fy, q1..q4, year) from filings (keys, qn, items, order).

    ``year`` is the sum of four known quarters for a flow, the fourth quarter for a stock, and for a ratio the ratio of the
    years. Growth is against the quarter that many places before, for the year against the year before. Balance items are
    given as first reported only. An item without any value in a year has no row. One row per series and quarter enters the
    windows; the year's grouping stays on their partitioning.
    """
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0.0)), 6)
    d = both_bases(filings, [*keys, "qn"], [*flows, *stocks], order)
    series = [*keys, "basis"]
    d = d.select(*series, "qn", *flows, *[F.when(C("basis") == BASES[0], C(s)).alias(s) for s in stocks])
    d = d.select("*", *[ratio(C(a), C(b)).alias(k) for k, (a, b) in ratios.items()])
    d = d.select("*", *[F.round(ratio(C(c), W.period_offset(C(c), series, "qn", n)) - 1, 6).alias(k) for k, (c, n) in growth.items()])
    at = lambda c, i: F.max(F.when(C("qn") % 4 == i, C(c)))

    def row(c: str) -> Column:
        qs = [at(c, i) for i in range(4)]
        year = F.round(qs[0] + qs[1] + qs[2] + qs[3], 4) if c in flows else qs[3] if c in stocks else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("item"), *[q.alias(f"q{i + 1}") for i, q in enumerate(qs)], year.alias("year")).alias(c)

    items = [*flows, *stocks, *ratios, *growth]
    y = d.groupBy(*series, F.floor(C("qn") / 4).cast("int").alias("fy")).agg(*[row(c) for c in items])
    years = {k: ratio(C(f"{a}.year"), C(f"{b}.year")) for k, (a, b) in ratios.items()}
    years |= {k: F.round(ratio(C(f"{c}.year"), W.period_offset(C(f"{c}.year"), series, "fy", 1)) - 1, 6) for k, (c, n) in growth.items() if n == 4}
    y = y.select(*series, "fy", *[C(c).withField("year", years[c]).alias(c) if c in years else C(c) for c in items])
    y = y.select(*series, "fy", F.inline(F.array(*items)))
    return y.where(F.coalesce("q1", "q2", "q3", "q4").isNotNull())
