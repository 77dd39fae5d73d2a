"""Figures read from release text: printed-number checks, shares, concentrations, results tables, outlook sections.

Number scans and checks are array expressions on the text column, without a shuffle. Guides are in ``plans.guides``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import money, number_words, numbers
from tidemark.plans.guides import let

C = F.col

# Labels of the revenue row of a results table.
REVENUE_LABELS = ("revenue", "revenues", "net revenue", "net revenues", "total revenue", "total revenues", "net sales", "total net sales")

def printed_share(text_numbers: Column, values: Column, tol: float = 0.005) -> Column:
    """Share of the values that the text prints, as they are or scaled by a thousand either way."""
    def printed(v: Column) -> Column:
        def near(x: Column) -> Column:
            hit = F.lit(False)
            for s in (1.0, 1e-3, 1e3):
                hit = hit | (F.abs(x - v * s) <= F.abs(v * s) * tol)
            return hit

        return F.exists(text_numbers, near)

    return F.size(F.filter(values, printed)) / F.nullif(F.size(values), F.lit(0))


# Words of customer concentration, sentences that speak of places or receivables instead, floors.
CUSTOMER = r"(?:customers?|distributors?)\b"
REVENUE_NAME = r"(?:total |net |consolidated )?(?:net )?(?:revenues?|sales)\b"
NO_CUSTOMER = r"no (?:single |one |direct )?(?:end )?customers? (?:represented|accounted for|exceeded) (?:10\s?%|ten percent)"
ELSEWHERE = (
    r"outside (?:of )?the United States|headquarter|billing location|shipments to|shipped to|[A-Z][a-z]+-based customers|revenue was direct|"
    r"through distributors|loss of a significant customer"
)
PLACES = r"outside (?:of )?the United States|geographic|headquarter|located in|billing location"
FLOOR = r"(?:more than|at least|over)\s+(?:10\s?%|ten percent)|(?:10\s?%|ten percent) or (?:more|greater)"
SHARE = r"\b\d{1,2}(?:\.\d+)?\s?(?:%|percent)"
SHARE_BAND = (10.0, 60.0)


def concentration_paragraphs(lines: Column, following: int = 7) -> Column:
    """Lines on customer concentration, once each: a percentage near a customer and a revenue word, or a statement that
    no customer reached ten percent; a heading takes the line after it, a line that introduces a table the table rows
    among the ``following`` lines."""
    near = rf"(?i){CUSTOMER}.{{0,250}}?{SHARE}.{{0,160}}?\b{REVENUE_NAME}|{SHARE} of (?:our )?{REVENUE_NAME}.{{0,120}}?{CUSTOMER}|{NO_CUSTOMER}"

    def block(s: Column, i: Column) -> Column:
        heads = s.rlike(r"(?i)^\s*(?:major|significant) customers?\s*$")
        tells = s.rlike(near) & ~s.rlike(f"(?i){ELSEWHERE}")
        opens = F.rtrim(s).endswith(":") | s.rlike(r"(?i)^(?:direct |indirect )?customers?\b")
        table = F.filter(F.slice(lines, i + 2, following), lambda x: x.contains("|"))
        return F.when(heads, F.slice(lines, i + 1, 2)).when(tells & opens, F.concat(F.array(s), table)).when(tells, F.array(s)).otherwise(F.array().cast("array<string>"))

    return F.array_join(F.array_distinct(F.flatten(F.transform(lines, block))), "\n")


def _shares(text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}(?:\.\d+)?)\s?(?:%|percent)"), F.lit(1))
    return F.filter(F.transform(hits, lambda s: s.cast("double")), lambda v: v.between(*SHARE_BAND))


def concentration_percents(text: Column) -> Column:
    """Percentages of 10 to 60 that a text gives, floors included."""
    return _shares(text)


def concentration_shares(text: Column) -> Column:
    """Measured shares of single customers and the none-flag: shares (sorted, distinct), none.

    A share counts in a sentence with a customer and a revenue word that is not about receivables or places, and in
    table rows that begin with a customer; floors such as 'more than 10%' are taken out first.
    """
    flat = F.regexp_replace(text, r"\s+", " ")
    told = F.filter(F.split(flat, r"(?<=[.!?])\s+(?=\S)"), lambda s: s.rlike(rf"(?i)\b{CUSTOMER}") & s.rlike(rf"(?i)\b{REVENUE_NAME}") & s.rlike(r"\d\s?(?:%|percent)"))
    told = F.filter(told, lambda s: ~s.rlike(f"(?i){PLACES}") & (~s.rlike(r"(?i)accounts receivable") | s.rlike(r"(?i)revenue from")))
    stated = F.flatten(F.transform(told, lambda s: _shares(F.regexp_replace(s, f"(?i){FLOOR}", " "))))
    rows = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"(?i)^\s*(?:direct |indirect )?customer \w+\s*\|"))
    listed = F.flatten(F.transform(rows, lambda s: _shares(F.regexp_replace(s, r"^[^|]*\|", ""))))
    return F.struct(F.array_sort(F.array_distinct(F.concat(stated, listed))).alias("shares"), flat.rlike(f"(?i){NO_CUSTOMER}").alias("none"))


def is_floor(text: Column, pct: Column) -> Column:
    """'More than 10%' is a floor, not a measured share."""
    return (pct == 10) & text.rlike(f"(?i){FLOOR}")


def clause_share(text: Column, place: str) -> Column:
    """Percentages of revenue stated in the clauses that name a place."""
    clauses = F.split(text, r"[.;]\s|, and ")
    mine = F.filter(clauses, lambda s: s.rlike(rf"(?i)\b{place}\b") & s.rlike(r"(?i)revenue|sales"))
    pct = F.transform(mine, lambda s: F.nullif(F.regexp_extract(s, r"(\d+(?:\.\d+)?)\s?(?:%|percent)", 1), F.lit("")).cast("double"))
    return F.filter(pct, lambda v: v.isNotNull())


def period_of_text(text: Column, duration: Column | None = None) -> Column:
    """'first quarter of fiscal 2027', 'nine months of fiscal 2026', 'fiscal year 2026', '2012' as (year, quarter, months).

    Null where the text has no year, or a year without a period word (a duration of twelve months counts as one).
    """
    t, duration = F.lower(text), F.lit(None).cast("int") if duration is None else duration
    year = F.coalesce(F.nullif(F.regexp_extract(t, r"(?:fiscal(?: year)?|fy)\s*'?(\d{4}|\d{2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\b(20\d\d)\b", 1), F.lit(""))).cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    ordinal = F.array_position(F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth")]), F.regexp_extract(t, r"(first|second|third|fourth) quarter", 1)).cast("int")
    twelve = t.rlike(r"fiscal (?:year )?\d|year") | (F.coalesce(duration, F.lit(0)) == 12)
    parts = [
        (t.rlike(r"^\s*(?:year )?(?:ended )?20\d\d\s*$"), F.lit(4), 12), (ordinal > 0, ordinal, 3), (t.rlike("first half|six months"), F.lit(2), 6),
        (t.rlike("nine months|first three quarters"), F.lit(3), 9), (twelve, F.lit(4), 12),
    ]
    out = None
    for holds, quarter, months in parts:
        value = F.struct(year.alias("year"), quarter.cast("int").alias("quarter"), F.lit(months).alias("months"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return F.when(year.isNotNull(), out)


def dated_period(text: Column, duration: Column | None = None) -> Column:
    """'three months ended July 26, 2015' as (end, months); three months where the text has no span and none is given."""
    t, duration = F.lower(text), F.lit(None).cast("int") if duration is None else duration
    part = lambda i: F.regexp_extract(t, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2}),? (\d{4})", i)
    end = F.try_to_date(F.concat_ws(" ", F.initcap(part(1)), part(2), part(3)), "MMM d yyyy")
    spans = F.create_map(*[F.lit(x) for kv in (("three", 3), ("six", 6), ("nine", 9), ("twelve", 12)) for x in kv])
    months = F.coalesce(spans[F.nullif(F.regexp_extract(t, r"(three|six|nine|twelve) months", 1), F.lit(""))], duration, F.lit(3))
    return F.when(end.isNotNull(), F.struct(end.alias("end"), months.cast("int").alias("months")))


def fiscal_period(text: Column, calendar: Column, year_end_month: Column, duration: Column | None = None, within: int = 45) -> Column:
    """The period of a text as (period_end, months): the date of ``calendar``, a filer's period ends, that is nearest to
    the stated end; null if none is within ``within`` days."""

    def snapped(read: Column) -> Column:
        key, dated = read["key"], read["dated"]
        near = F.coalesce(F.add_months(F.make_date(key["year"], year_end_month, F.lit(28)), -3 * (4 - key["quarter"])), F.when(key.isNull(), dated["end"]))
        ranked = let(near, lambda n: F.transform(calendar, lambda d: F.struct(F.abs(F.datediff(d, n)).alias("off"), d.alias("d"))))
        best = F.array_min(F.filter(ranked, lambda x: x["off"] <= within))["d"]
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(b.alias("period_end"), F.coalesce(key["months"], dated["months"]).alias("months"))))

    return let(F.struct(period_of_text(text, duration).alias("key"), dated_period(text, duration).alias("dated")), snapped)


def first_reported(rows: DataFrame, keys: list[str], filed: str) -> DataFrame:
    """All rows of the filing that reported a period first."""
    first = rows.groupBy(*keys).agg(F.min(filed).alias("_first"))
    return rows.join(first, keys).where(C(filed) == C("_first")).drop("_first")


def label_quarter_end(label: Column) -> Column:
    """'4Q18Amount' to the quarter's last day."""
    q = F.regexp_extract(label, r"^([1-4])Q(\d\d)", 1)
    y = F.regexp_extract(label, r"^([1-4])Q(\d\d)", 2)
    ok = F.when(q != "", F.make_date(y.try_cast("int") + 2000, q.try_cast("int") * 3, F.lit(1)))
    return F.last_day(ok)


def checked_results(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Results rows 'label | now | year ago | y/y % | prior | q/q %' kept only where the printed changes reproduce."""
    cells = F.split(C(line), r"\s*\|\s*")
    v = F.transform(F.slice(cells, 2, 5), lambda s: F.regexp_replace(s, "[,%$]", "").try_cast("double"))
    d = lines.where(F.size(cells) == 6).select(key, cells[0].alias("label"), v.alias("v"))
    now, ago, yoy, prior, qoq = (F.get("v", F.lit(i)) for i in range(5))
    ok = (F.abs((now / F.nullif(ago, F.lit(0.0)) - 1) * 100 - yoy) <= 0.1) & (F.abs((now / F.nullif(prior, F.lit(0.0)) - 1) * 100 - qoq) <= 0.1)
    return d.where(ok).select(key, "label", now.alias("value"), ago.alias("year_ago"), prior.alias("prior"))


def table_values(lines: DataFrame, key: str, line: str, n: int) -> DataFrame:
    """Table rows with exactly ``n`` numbers: label and values."""
    v = numbers(F.regexp_replace(C(line), r"^[^|]*", ""))
    d = lines.where(C(line).contains("|")).select(key, F.trim(F.split(C(line), r"\|")[0]).alias("label"), v.alias("values"))
    return d.where(F.size("values") == n)


def monthly_revenue(text: Column) -> Column:
    """Amount of 'net revenue for May 2024 was approximately NT$229.62 billion', in millions."""
    p = r"(?i)revenues? for \w+ \d{4} (?:was|were) (?:approximately )?(?:NT|US)?\$\s?([\d,]+(?:\.\d+)?) (billion|million)"
    return money(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.regexp_extract(text, p, 2))


def range_guide(text: Column, what: str, percent: bool = False) -> tuple[Column, Column]:
    """Low and high of '<what> ... between A and B' as money or percent."""
    if percent:
        p = rf"(?i){what}[^.]{{0,60}}?between (\d+(?:\.\d+)?)% and (\d+(?:\.\d+)?)%"
        return tuple(F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("double") for i in (1, 2))
    p = rf"(?i){what}[^.]{{0,60}}?between (?:US|NT)?\$\s?([\d,]+(?:\.\d+)?) (billion|million) and (?:US|NT)?\$\s?([\d,]+(?:\.\d+)?) (billion|million)"
    return tuple(money(F.nullif(F.regexp_extract(text, p, i), F.lit("")), F.regexp_extract(text, p, i + 1)) for i in (1, 3))


def headline_figures(lines: Column) -> dict[str, Column]:
    """Revenue (in millions) and the first two gross margins of a results table.

    A table line is a label and cells; rows are picked by the words of the label, a scale in its brackets counts.
    """
    rows = F.transform(F.filter(lines, lambda s: s.contains("|")), lambda s: F.struct(F.trim(F.substring_index(s, "|", 1)).alias("label"), numbers(F.regexp_replace(s, r"^[^|]*\|", "")).alias("v")))
    bare = lambda r: F.lower(F.trim(F.regexp_replace(r["label"], r"\(.*$", "")))
    revenue = F.get(F.filter(rows, lambda r: bare(r).isin(*REVENUE_LABELS)), F.lit(0))
    margins = F.filter(rows, lambda r: r["label"] == "Gross margin")
    value = lambda r: F.get(r["v"], F.lit(0))
    return {
        "revenue": value(revenue) * F.when(revenue["label"].rlike(r"(?i)\(.*(\$b\b|billions)"), 1000.0).otherwise(1.0),
        "gross_margin_gaap": value(F.get(margins, F.lit(0))),
        "gross_margin_nongaap": value(F.get(margins, F.lit(1))),
    }


def platform_table(docs: DataFrame, key: str, lines: str, header: str) -> DataFrame:
    """Rows of a platform table up to its total: label, value and the period its column is headed by.

    The table starts below the line that matches ``header``; without a total it ends where its rows do.
    """
    at = F.array_position(F.transform(C(lines), lambda s: s.rlike(header)), F.lit(True)).cast("int")
    d = docs.select(key, C(lines).alias("_l"), at.alias("_at")).where("_at > 0")
    d = d.select(key, F.slice("_l", C("_at") + 1, F.size("_l")).alias("_b"))
    total = F.array_position(F.transform("_b", lambda s: s.rlike("(?i)^total")), F.lit(True)).cast("int")
    kinds = F.transform("_b", lambda s: s.contains("|"))
    after = F.array_position(F.transform("_b", lambda s, i: ~s.contains("|") & (i >= F.array_position(kinds, F.lit(True))) & F.array_contains(kinds, True)), F.lit(True)).cast("int")
    end = F.when(total > 0, total).otherwise(after)
    d = d.withColumn("_e", end)
    rows = F.when(C("_e") > 0, F.slice("_b", F.lit(1), C("_e") - 1)).otherwise(C("_b"))
    heads = F.get(F.filter(F.slice("_b", 1, 3), lambda s: s.rlike(r"Q[1-4] FY\d\d")), F.lit(0))
    d = d.select(key, F.regexp_extract_all(heads, F.lit(r"Q[1-4] FY\d\d"), F.lit(0)).alias("_p"), F.explode(rows).alias("_r"))
    d = d.where(C("_r").contains("|") & ~C("_r").rlike(r"Q[1-4] FY\d\d"))
    label = F.trim(F.regexp_replace(F.get(F.split("_r", r"\|"), F.lit(0)), r"\s*\(\d\)\s*$", ""))
    vals = numbers(F.regexp_replace("_r", r"^[^|]*\|", ""))
    d = d.select(key, "_p", label.alias("label"), F.posexplode(vals).alias("column", "value"))
    return d.select(key, "label", "column", "value", F.get("_p", C("column")).alias("period"))


def _block(lines: Column, starts: Callable[[Column], Column], size: int) -> Column:
    """The lines from the first that ``starts``, ``size`` at most; null without one."""
    at = F.array_position(F.transform(lines, starts), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(lines, F.greatest(at, F.lit(1)), size))


def outlook_section(lines: Column, size: int = 12) -> Column:
    """The outlook section as one text: ``size`` lines from the sentence that opens it, else from its heading."""
    opened = _block(lines, lambda s: s.rlike(r"(?i)\boutlook for the\b.{0,60}\bas follows"), size)
    words = lambda s: F.split(F.trim(s), r"\s+")
    titled = _block(lines, lambda s: (F.element_at(words(s), -1) == "Outlook") & (F.size(words(s)) <= 8) & s.rlike(r"^\s*[A-Z][\w ]*$") & ~s.rlike(r"^\s*(?:Q\d|FY)"), size)
    return number_words(F.array_join(F.coalesce(opened, titled), " "))


def outlook_fields(sec: Column, lines: Column | None = None, table_lines: int = 30) -> dict[str, Column]:
    """Guides of an outlook section: revenue, margins with tolerance, expenses.

    A pair is stated as 'GAAP and non-GAAP X are expected to be A and B', as one figure for both, or one after the
    other. Expenses printed in the reconciliation table of the outlook, in ``lines``, overrule the rounded sentence.
    """
    expect, about = r"(?:is|are) expected to be", r"(?:approximately )?"
    amount, rate = r"\$([\d.,]+)\s*(billion|million)", r"([\d.]+)\s*(?:%|percent)"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(sec, f"(?i){pattern}", group), F.lit(""))

    def pair(what: str, shape: str, apart: int) -> tuple[str, str, str]:
        both = rf"GAAP and non-GAAP {what} {expect} {about}{shape}"
        return rf"{both} and {shape}", rf"(?<!non-)GAAP {what} {expect} {about}{shape}.{{0,{apart}}}?non-GAAP {what} {expect} {about}{shape}", both

    m1, m2, m3 = pair("gross margins?", rate, 80)
    e1, e2, _ = pair("operating expenses", amount, 120)
    bps = r"(?:,? respectively)?,? plus or minus (\d+) basis points"
    revenue = rf"revenue {expect} {about}{amount}"
    opex = [F.coalesce(money(part(e1, i), part(e1, i + 1)), money(part(e2, i), part(e2, i + 1))) for i in (1, 3)]
    if lines is not None:
        block = _block(lines, lambda s: s.rlike(r"(?i)reconciliation of gaap to non-gaap outlook"), table_lines)
        scale = F.when(F.exists(block, lambda s: s.rlike(r"(?i)in billions")), 1000.0).otherwise(1.0)
        exact = lambda label: F.get(F.transform(F.filter(block, lambda s: F.lower(s).startswith(label) & s.contains("|")), lambda s: F.get(numbers(F.split(s, r"\|")[1]), F.lit(0))), F.lit(0)) * scale
        opex = [F.coalesce(exact(label), v) for label, v in zip(("gaap operating expenses", "non-gaap operating expenses"), opex)]
    return {
        "revenue_mid": money(part(revenue, 1), part(revenue, 2)),
        "revenue_pm_pct": part(rf"{revenue},? plus or minus {rate}", 3).try_cast("double"),
        "gm_gaap": F.coalesce(part(m1, 1), part(m2, 1), part(m3, 1)).try_cast("double"),
        "gm_nongaap": F.coalesce(part(m1, 2), part(m2, 2), part(m3, 1)).try_cast("double"),
        "gm_pm_bps": F.coalesce(part(m1 + bps, 3), part(m3 + bps, 2)).try_cast("double"),
        "opex_gaap": opex[0],
        "opex_nongaap": opex[1],
    }
