"""Calendar and fiscal-period expressions. A quarter is the integer ordinal ``year * 4 + quarter - 1``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Reporting durations that are kept, and the day bands of a quarter and a year.
DURATIONS = (0, 3, 6, 9, 12)
QUARTER_DAYS = (80, 100)
YEAR_DAYS = (350, 380)
DAYS_PER_MONTH = 30.44


def quarter_ordinal(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


def quarter_end(qn: Column) -> Column:
    return F.last_day(F.make_date(F.floor(qn / 4).cast("int"), (F.pmod(qn, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def duration_months(start: Column, end: Column) -> Column:
    """Months spanned, rounded half-even; an instant (no start) is 0; spans that are no reporting duration are null."""
    months = F.when(start.isNull(), F.lit(0)).otherwise(F.bround(F.datediff(end, start) / DAYS_PER_MONTH).cast("int"))
    return F.when(months.isin(*DURATIONS), months)


def span_kind(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(days.between(*QUARTER_DAYS), "quarter").when(days.between(*YEAR_DAYS), "year")


def nearest_month_end(d: Column) -> Column:
    """The closer of this month's end and the previous month's end; a tie goes forward."""
    ahead = F.last_day(d)
    behind = F.last_day(F.add_months(d, -1))
    return F.when(F.datediff(ahead, d) <= F.datediff(d, behind), ahead).otherwise(behind)


def snapped_quarter(d: Column) -> Column:
    return quarter_ordinal(nearest_month_end(d))


def fiscal_year(d: Column, year_end_month: Column | int = 12) -> Column:
    fye = F.lit(year_end_month) if isinstance(year_end_month, int) else year_end_month
    me = nearest_month_end(d)
    return F.when(F.month(me) <= fye, F.year(me)).otherwise(F.year(me) + 1)


def fiscal_quarter(d: Column, year_end_month: Column | int = 12) -> Column:
    fye = F.lit(year_end_month) if isinstance(year_end_month, int) else year_end_month
    return F.floor(F.pmod(F.month(nearest_month_end(d)) - fye - 1, F.lit(12)) / 3).cast("int") + 1


def nearest_quarter_end(d: Column) -> Column:
    """Closest calendar quarter end on either side; a tie goes to the earlier one."""
    ahead = quarter_end(quarter_ordinal(d))
    behind = quarter_end(quarter_ordinal(d) - 1)
    return F.when(F.datediff(d, behind) <= F.datediff(ahead, d), behind).otherwise(ahead)


def reported_quarter_end(filed: Column, grace_days: int = 5) -> Column:
    """Latest calendar quarter end strictly before ``filed`` less the grace days."""
    limit = F.date_sub(filed, grace_days)
    return quarter_end(quarter_ordinal(limit) - 1)


def fiscal_label(d: Column, year_end_month: Column | int = 12) -> Column:
    return F.format_string("Q%d FY%d", fiscal_quarter(d, year_end_month), fiscal_year(d, year_end_month))


def consecutive_quarter_days(prev: Column, cur: Column, low: int = 75, high: int = 105) -> Column:
    return F.datediff(cur, prev).between(low, high)
