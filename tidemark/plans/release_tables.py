"""Tables of results releases whose columns are dated: KPI tables, quarter tables, self-checked monthly rows.

A release is a row per exhibit: ``accn``, ``filed``, ``exhibit`` and ``lines``, the text's lines with the cells of a
table row kept as ``a | b``. A reader finds the table's head, turns it into a list of periods, reads the lines after
it and keeps only rows that hold exactly one figure per period, so that a column can never shift. Readers are column
expressions over an exhibit's own lines, and all readers of a query see an exhibit at once, so that a text is neither
written nor read again. What they found is compared between exhibits and releases by windows that share one order; rows
dealt by company or by release before they are read need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import dates as D
from tidemark.functions.text import money, numbers
from tidemark.plans.guides import let

C = F.col

# Labels of operating figures as printed (lower case, without footnote marks), and how longer labels begin.
KPI_LABELS = {
    "net bookings excluding euv (units)": "bookings_units_ex_euv",
    "net bookings excluding euv (in units)": "bookings_units_ex_euv",
    "net bookings excluding euv": "bookings_value_ex_euv",
    "systems backlog excluding euv (units)": "backlog_units_ex_euv",
    "systems backlog excluding euv (in units)": "backlog_units_ex_euv",
    "number of payroll employees in ftes": "employees_payroll_fte",
    "number of payroll employees (in ftes)": "employees_payroll_fte",
    "number of payroll employees(in ftes)": "employees_payroll_fte",
    "net bookings (units)": "bookings_units",
    "net bookings (in units)": "bookings_units",
    "net bookings lithography systems (units)": "bookings_units",
    "net bookings lithography systems (in units)": "bookings_units",
    "net bookings": "bookings_value",
    "net bookings (eur million)": "bookings_value",
    "net bookings (eur millions)": "bookings_value",
    "systems backlog": "backlog_value",
    "backlog": "backlog_value",
    "systems backlog (eur million)": "backlog_value",
    "systems backlog (eur millions)": "backlog_value",
    "systems backlog (units)": "backlog_units",
    "systems backlog (in units)": "backlog_units",
    "sales of systems (in units)": "systems_sold_units",
    "sales of lithography systems (in units)": "systems_sold_units",
    "total sales of lithography systems (in units)": "systems_sold_units",
    "new systems sold (units)": "new_systems_sold_units",
    "new lithography systems sold (units)": "new_systems_sold_units",
    "used systems sold (units)": "used_systems_sold_units",
    "used lithography systems sold (units)": "used_systems_sold_units",
    "installed base management sales": "installed_base_mgmt_sales",
    "...of which installed base management sales": "installed_base_mgmt_sales",
}
KPI_BEGINNINGS = {
    "value of net bookings excluding euv": "bookings_value_ex_euv",
    "value of systems backlog excluding euv": "backlog_value_ex_euv",
    "systems backlog excluding euv": "backlog_value_ex_euv",
    "value of net bookings": "bookings_value",
    "net bookings (in value)": "bookings_value",
    "value of systems backlog": "backlog_value",
    "asp of systems backlog": "backlog_asp",
    "average selling price of systems backlog": "backlog_asp",
    "asp of system sales": "asp_system_sales",
    "asp of lithography system sales": "asp_system_sales",
    "average selling price of system sales": "asp_system_sales",
    "average selling price of lithography system sales": "asp_system_sales",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Heads of the dated tables, wording that marks a second set of accounts, lines looked at.
RATIOS_HEAD = r"(?i)Quarterly Summary.{0,30}Ratios"
RESULTS_HEAD = r"(?i)Quarterly Summary.{0,40}(Statements? of Operations|Income Statement)"
OTHER_ACCOUNTS = r"(?i)under IFRS|IFRS-EU|IFRS Consolidated|in accordance with IFRS"
HEAD_LINES, TABLE_LINES = 6, 44
_DAY = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? ?(\d{1,2})(?!\d)"
_YEAR = r"(20\d\d)(?!\d)"
_FIGURE = r"\(?-?[\d,]*\d(?:\.\d+)?\)?\s?%?"


def plain_label(label: Column) -> Column:
    """A row label in lower case without footnote marks: '(3)', '*', and bare digits behind a blank, letter or bracket."""
    x = F.regexp_replace(F.trim(label), r"\s*(?:\*|\(\d\))\s*$", "")
    x = F.regexp_replace(x, r"(?:\s+\d(?:\s*,\s*\d)*|(?<=[a-z)])\d(?:,\d)*)$", "")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def kpi_metric(label: Column) -> Column:
    """Canonical name of an operating figure; null for any other label."""
    x = F.replace(plain_label(label), F.lit(", excluding euv"), F.lit(" excluding euv"))
    exact = F.create_map(*[F.lit(v) for pair in KPI_LABELS.items() for v in pair])
    return let(x, lambda y: F.coalesce(exact[y], *[F.when(y.startswith(k), v) for k, v in KPI_BEGINNINGS.items()]))


def lookup(labels: dict[str, str]) -> Callable[[Column], Column]:
    """Canonical name of a label (footnote digits at its end aside) in a table of labels."""
    names = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return lambda label: names[F.trim(F.regexp_replace(label, r"\s*[\d,]+$", ""))]


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows for a join that grow with the releases: never gathered at the driver, whatever size a plan expects."""
    return rows.hint("merge")


def _all(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def _paired_dates(days: Column, years: Callable[[Column], Column]) -> Column:
    """Dates of 'Mar 27, Dec 31' and the last as many of ``years`` (of the number of days); null unless all of two or more
    are real dates."""

    def built(x: Column, y: Column) -> Column:
        n = F.size(x["m"])
        last = F.slice(y, F.greatest(F.size(y) - n + 1, F.lit(1)), n)
        out = F.zip_with(F.zip_with(x["m"], x["d"], lambda a, b: F.concat_ws(" ", F.initcap(a), b)), last, lambda a, b: F.try_to_date(F.concat_ws(" ", a, b), "MMM d yyyy"))
        return F.when(F.size(y) >= n, let(out, lambda o: F.when(F.forall(o, lambda d: d.isNotNull()), o)))

    some = lambda x: F.when(F.size(x["m"]) >= 2, let(years(F.size(x["m"])), lambda y: built(x, y)))
    return let(F.struct(_all(days, _DAY, 1).alias("m"), _all(days, _DAY, 2).alias("d")), some)


def header_dates(lines: Column) -> Column:
    """Column dates of a table head, on one line or with the years on the line below; footnote digits may stick to a year."""

    def at(line: Column, i: Column) -> Column:
        below = _all(F.coalesce(F.get(lines, i + 1), F.lit("")), _YEAR, 1)
        return _paired_dates(line, lambda n: let(_all(line, _YEAR, 1), lambda own: F.when(F.size(own) >= n, own).otherwise(below)))

    return F.get(F.filter(F.transform(lines, at), lambda d: d.isNotNull()), F.lit(0))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))


def _figures(cells: Column) -> Column:
    """The first number of every cell that has one."""
    return F.array_compact(F.transform(cells, lambda c: F.get(numbers(c), F.lit(0))))


def own_accounts(lines: Column) -> Column:
    """False for an exhibit that says in its first 4,000 characters that it follows the other set of accounts."""
    return ~F.substring(F.array_join(lines, "\n"), 1, 4000).rlike(OTHER_ACCOUNTS)


def _figure(metric: Column, period_end: Column, place: Column, col: Column, value: Column) -> Column:
    """What a reader returns an array of: ``place`` is the row in its table, ``col`` the column."""
    return F.struct(metric.alias("metric"), period_end.alias("period_end"), place.cast("int").alias("place"), col.cast("int").alias("col"), value.alias("value"))


def _every(found: list[tuple[Column, dict[str, Column]]]) -> Column:
    """All figures of several readers in one array, with fields of their own in front; a reader may have found null."""

    def tagged(rows: Column, fields: dict[str, Column]) -> Column:
        return F.transform(rows, lambda x: F.struct(*[v.alias(k) for k, v in fields.items()], *[x[c].alias(c) for c in ("metric", "period_end", "place", "col", "value")]))

    return F.flatten(F.array_compact(F.array(*[tagged(*f) for f in found])))


def _label_rows(lines: Column, metric: Callable[[Column], Column]) -> Column:
    """(metric, cells, place) of the lines whose label ``metric`` knows."""
    rows = F.transform(lines, lambda s, i: let(_cells(s), lambda c: F.struct(metric(c[0]).alias("metric"), c.alias("cells"), i.alias("place"))))
    return F.filter(rows, lambda r: r["metric"].isNotNull())


def _rest(cells: Column) -> Column:
    return F.slice(cells, F.lit(2), F.size(cells))


def _by_date(rows: Column, dates: Column) -> Column:
    """A figure per date of each row's values ``v``, for the quarter end next to the date."""
    ends = F.transform(dates, D.nearest_quarter_end)
    return let(ends, lambda e: F.flatten(F.transform(rows, lambda r: F.transform(e, lambda d, k: _figure(r["metric"], d, r["place"], k, F.get(r["v"], k))))))


def dated_figures(lines: Column, heading: str, metric: Callable[[Column], Column], figures: Callable[[Column, Column], Column]) -> Column:
    """Figures of the table below the first heading with a dated head; ``figures`` of (cells, dates): a value per date, or null."""
    heads = F.transform(lines, lambda s, i: F.when(s.rlike(heading) & ~s.contains("IFRS"), F.struct(i.alias("i"), header_dates(F.slice(lines, i + 2, HEAD_LINES)).alias("dates"))))
    head = F.get(F.filter(heads, lambda h: h["dates"].isNotNull()), F.lit(0))

    def read(h: Column) -> Column:
        rows = F.transform(_label_rows(F.slice(lines, h["i"] + 2, TABLE_LINES), metric), lambda r: F.struct(r["metric"].alias("metric"), r["place"].alias("place"), figures(r["cells"], h["dates"]).alias("v")))
        return _by_date(F.filter(rows, lambda r: r["v"].isNotNull()), h["dates"])

    return F.when(own_accounts(lines), let(head, read))


def ratio_figures(lines: Column) -> Column:
    """Operating figures of the dated ratios table; a lone footnote digit is no figure."""
    whole = lambda v, dates: F.when(F.size(v) == F.size(dates), v)
    return dated_figures(lines, RATIOS_HEAD, kpi_metric, lambda cells, dates: let(_figures(F.filter(_rest(cells), lambda c: ~c.rlike(r"^\d$"))), lambda v: whole(v, dates)))


def ratio_printings(releases: DataFrame, keep: list[str]) -> DataFrame:
    """Operating figures of the dated ratios tables: keep, metric, period_end, value."""
    return releases.select(*keep, F.inline(ratio_figures(C("lines")))).select(*keep, "metric", "period_end", "value")


def flat_figures(lines: Column, metric: Callable[[Column], Column]) -> Column:
    """Tables that a conversion left on one line, 'Three months ended Jun 29, Sep 28, ... 2025 2025 ... label 1 2 ...'.

    The body is a run of words and a run of figures by turns; a run counts if it has a figure per date (a footnote digit
    in front aside), under the longest ending of its words that ``metric`` knows.
    """
    head = r"^\s*Three months ended\s+((?:[A-Z][a-z]{2,4}\.? \d{1,2},\s*){3,})(?:\([^)]*\))?\s*((?:20\d\d\s+){3,})(.*)"
    token = rf"(?:{_FIGURE})(?=\s|$)"
    runs = rf"((?:(?!{token})\S+\s+)+)((?:{token}\s*)+)"

    def known(words: Column) -> Column:
        ends = let(F.split(F.trim(words), r"\s+"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, k, F.size(w)), " ")))
        return F.get(F.filter(F.transform(ends, metric), lambda m: m.isNotNull()), F.lit(0))

    def run(r: Column, place: Column, n: Column) -> Column:
        own = let(_all(r["run"], _FIGURE, 0), lambda v: F.when((F.size(v) == n + 1) & F.get(v, F.lit(0)).rlike(r"^\d\s*$"), F.slice(v, F.lit(2), n)).otherwise(v))
        return let(own, lambda v: F.when(F.size(v) == n, F.struct(known(r["words"]).alias("metric"), place.alias("place"), F.transform(v, lambda s: F.get(numbers(s), F.lit(0))).alias("v"))))

    def body(x: Column) -> Column:
        both = F.arrays_zip(_all(x["body"], runs, 1).alias("words"), _all(x["body"], runs, 2).alias("run"))
        rows = F.filter(F.transform(both, lambda r, place: run(r, place, F.size(x["dates"]))), lambda r: r["metric"].isNotNull())
        return _by_date(rows, x["dates"])

    def table(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, head, i)
        parts = F.struct(part(1).alias("days"), _all(part(2), r"20\d\d", 0).alias("years"), part(3).alias("body"))
        dated = let(parts, lambda p: F.struct(_paired_dates(p["days"], lambda n: p["years"]).alias("dates"), F.size(p["years"]).alias("n"), p["body"].alias("body")))
        return let(dated, lambda x: F.when(F.size(x["dates"]) == x["n"], body(x)))

    tables = F.transform(F.filter(F.array_distinct(lines), lambda s: s.rlike(head)), table)
    return F.flatten(F.array_compact(tables))


def headline_figures(lines: Column, reported: Column) -> Column:
    """Operating figures of the headline table: the first whose head has the reported quarter's label, quarter columns only."""
    quarter = r"^Q([1-4]) ?(\d{4})$"
    periods = lambda s: F.filter(_cells(s), lambda c: c.rlike(rf"{quarter}|^(?:FY ?|Full[- ]year )?\d{{4}}$"))
    spelled = lambda c: F.regexp_replace(c, quarter, "Q$1 $2")
    heads = F.transform(lines, lambda s, i: F.struct(i.alias("i"), F.transform(periods(s), spelled).alias("p")))
    head = let(F.format_string("Q%d %d", F.quarter(reported), F.year(reported)), lambda label: F.get(F.filter(heads, lambda h: F.array_contains(h["p"], label)), F.lit(0)))
    end = lambda p: F.last_day(F.make_date(F.regexp_extract(p, quarter, 2).cast("int"), F.regexp_extract(p, quarter, 1).cast("int") * 3, F.lit(1)))

    def figures(cells: Column, p: Column) -> Column:
        some = F.filter(F.transform(_rest(cells), lambda c: F.struct(c.alias("c"), F.get(numbers(c), F.lit(0)).alias("v"))), lambda x: x["v"].isNotNull())
        some = let(some, lambda v: F.when(F.size(v) > F.size(p), F.filter(v, lambda x: ~x["c"].rlike(r"^\d$"))).otherwise(v))
        return let(some, lambda v: F.when(F.size(v) == F.size(p), v["v"]))

    def read(h: Column) -> Column:
        rows = F.transform(_label_rows(F.slice(lines, h["i"] + 2, 29), kpi_metric), lambda r: F.struct(r["metric"].alias("metric"), r["place"].alias("place"), figures(r["cells"], h["p"]).alias("v")))
        rows = F.filter(rows, lambda r: r["v"].isNotNull())
        return F.flatten(F.transform(rows, lambda r: F.array_compact(F.transform(h["p"], lambda p, k: F.when(p.rlike(quarter), _figure(r["metric"], end(p), r["place"], k, F.get(r["v"], k)))))))

    return let(head, read)


def text_figures(lines: Column, reported: Column) -> Column:
    """Bookings and backlog of the first sentence about the reported quarter that states any."""
    euro = r"(?:EUR|€) ?([\d,.]+) ?(million|billion)"
    value, backlog = rf"(?i)net bookings (?:valued at|totaled \d+ systems valued at|of) {euro}", rf"(?i)backlog valued at {euro}"
    units = r"(?i)net bookings[^.]{0,40}?(?:with|totaled|of) (\d+) (?:lithography )?systems"
    part = lambda s, p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    flat = F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")
    named = F.format_string(r"Q%d %d", F.quarter(reported), F.year(reported))
    mine = lambda s, n: s.contains(n) | s.contains(F.replace(n, F.lit(" "), F.lit(""))) | s.rlike("this quarter|in the quarter")
    at = lambda metric, v: _figure(F.lit(metric), reported, F.lit(0), F.lit(0), v)
    read = lambda s: F.array(
        at("bookings_value", money(part(s, value, 1), part(s, value, 2))),
        at("bookings_units", part(s, units, 1).cast("double")),
        at("backlog_value", money(part(s, backlog, 1), part(s, backlog, 2))),
    )
    own = let(named, lambda n: F.filter(F.split(flat, r"(?<=[.•])\s"), lambda s: mine(s, n)))
    told = F.transform(own, lambda s: F.filter(read(s), lambda x: x["value"].isNotNull()))
    return F.get(F.filter(told, lambda x: F.size(x) > 0), F.lit(0))


# Where an operating figure was printed.
RATIOS, FLAT, HEADLINE, TEXT = "EX-99.3 ratios table", "EX-99.3 ratios (flattened)", "EX-99.1 headline table", "EX-99.1 text"


def _known(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [C(c).isNotNull() for c in columns])


def kpi_printings(releases: DataFrame) -> DataFrame:
    """Every printing of an operating figure: cik, accn, filed, period_end, metric, value, source.

    The ratios tables (dated or flattened), the headline table, and the text for what no table of the release gives.
    """
    docs, lines, main = releases.withColumn("reported", D.reported_quarter_end(C("filed"))), C("lines"), C("exhibit") == "EX-99.1"
    flat_labels = lambda x: F.when(F.lower(x).isin("sales of lithography systems (in units)", "net bookings", "number of payroll employees (in ftes)"), kpi_metric(x))
    found = [
        (ratio_figures(lines), RATIOS), (flat_figures(lines, flat_labels), FLAT),
        (F.when(main, headline_figures(lines, C("reported"))), HEADLINE), (F.when(main, text_figures(lines, C("reported"))), TEXT),
    ]
    rows = docs.select("cik", "accn", "filed", F.inline(_every([(x, {"source": F.lit(s)}) for x, s in found])))
    key, text = ["cik", "period_end", "metric", "accn"], C("source") == TEXT
    place = ["place", C("col").desc(), "value"]
    # one order serves both windows and the groups of first_and_latest
    whole = Window.partitionBy(*key).orderBy("filed", "source", *place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_t", F.max(~text).over(whole)).where(~text | ~C("_t") | ~_known(*key))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "filed", "source").orderBy(*place)))
    return rows.where((C("source") != FLAT) | (C("_n") == 1)).select("cik", "accn", "filed", "period_end", "metric", "value", "source")


def first_and_latest(printings: DataFrame) -> DataFrame:
    """Per (cik, period_end, metric): the first printing and the latest, by filing day and source; sources that disagree
    inside the first release count as a conflict."""
    key, at, v = ["cik", "period_end", "metric"], F.struct("filed", "source", "accn", "value"), F.round("value", 1)
    d = printings.where(_known(*key)).groupBy(*key, "accn").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.coalesce(F.min(v) < F.max(v), F.lit(False)).cast("int").alias("x"))
    d = d.groupBy(*key).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("x").alias("conflicts"))
    return d.select(*key, C("a.value").alias("first"), C("a.source").alias("first_source"), C("b.value").alias("latest"), C("b.filed").alias("latest_filed"), "conflicts")


# Forms of a quarter's results, the one to prefer first.
FLATTENED, DATED, LABELLED = 0, 1, 2
FORMS = ("flattened", "dated columns", "quarter labels")


def _form(form: int, i: Column | None = None) -> dict[str, Column]:
    return {"form": F.lit(form), "i": F.lit(0) if i is None else i}


def summary_figures(lines: Column, metric: Callable[[Column], Column]) -> Column:
    """Every dated column of the results summary, with ``form`` and ``i``.

    A row may hold more figures than dates (a note in front), so columns count from the right.
    """
    right = lambda v, n: F.when(F.size(v) >= n, F.slice(v, F.size(v) - n + 1, n))
    dated = dated_figures(lines, RESULTS_HEAD, metric, lambda cells, dates: let(_figures(_rest(cells)), lambda v: right(v, F.size(dates))))
    return _every([(dated, _form(DATED)), (flat_figures(lines, metric), _form(FLATTENED))])


def labelled_figures(lines: Column, metric: Callable[[Column], Column], reported: Column) -> Column:
    """The reported quarter's column of every table whose head names periods ('Q1 2026 | Q2 2026'), with ``form`` and the
    head's line ``i``; only rows with exactly one figure per period column."""
    period = r"(?i)\bQ[1-4]\b|\b20\d\d\b|FY|Full year"
    q, y = F.quarter(reported), F.year(reported)
    labels = [F.format_string("Q%d %d", q, y), F.format_string("Q%d '%d", q, y), F.format_string("Q%d%d", q, y), F.format_string("Q%d %d", q, y % 100), F.format_string("Q%d '%d", q, y % 100), F.format_string("Q%d'%d", q, y % 100)]
    names = lambda c, own: F.exists(own, lambda x: F.concat(F.lit(" "), c, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" "))))

    def head(s: Column, i: Column, own: Column) -> Column:
        cols = F.filter(_cells(s), lambda c: c.rlike(period))
        return let(cols, lambda x: F.struct(i.alias("i"), F.size(x).alias("n"), F.array_max(F.transform(x, lambda c, k: F.when(names(c, own), k))).alias("k")))

    def table(h: Column) -> Column:
        rows = F.transform(_label_rows(F.slice(lines, h["i"] + 2, 39), metric), lambda r: F.struct(r["metric"].alias("metric"), r["place"].alias("place"), _figures(_rest(r["cells"])).alias("v")))
        rows = F.transform(F.filter(rows, lambda r: F.size(r["v"]) == h["n"]), lambda r: _figure(r["metric"], reported, r["place"], F.lit(0), F.get(r["v"], h["k"])))
        return _every([(rows, _form(LABELLED, h["i"]))])

    heads = let(F.array(*labels), lambda own: F.filter(F.transform(lines, lambda s, i: F.when(s.contains("|"), head(s, i, own))), lambda h: h["k"].isNotNull() & (h["n"] >= 2)))
    return F.when(own_accounts(lines), F.flatten(F.transform(heads, table)))


def _settled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Of the rows of a release: one exhibit with a summary, the first in name order, flattened ones before dated ones;
    the first row of a label in a table; no column without revenue."""
    table, place = ["form", "exhibit", "i"], ["place", C("col").desc(), "value"]
    # one order serves all windows
    release = Window.partitionBy(*keep).orderBy(*table, "period_end", "metric", *place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.where(_known(*keep)).withColumn("_o", F.min(F.when(C("form") != LABELLED, F.struct("form", "exhibit"))).over(release))
    rows = rows.where((C("form") == LABELLED) | (C("form") == C("_o.form")) & (C("exhibit") == C("_o.exhibit")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keep, *table, "period_end", "metric").orderBy(*place))).where("_n = 1")
    return rows.withColumn("_r", F.max(C("metric") == "revenue").over(Window.partitionBy(*keep, *table, "period_end"))).where("_r")


def _source() -> Column:
    return F.get(F.array(*[F.lit(s) for s in FORMS]), C("form")).alias("source")


def quarter_printings(releases: DataFrame, keep: list[str], metric: Callable[[Column], Column]) -> DataFrame:
    """Every dated column of the results summary: keep, period_end, metric, value, source."""
    rows = releases.select(*keep, "exhibit", F.inline(summary_figures(C("lines"), metric)))
    return _settled(rows, keep).select(*keep, "period_end", "metric", "value", _source())


def reported_quarters(releases: DataFrame, labels: dict[str, str], within: int = 10) -> DataFrame:
    """Figures of each release's reported quarter: cik, accn, filed, period_end, metric, value, source.

    Taken from the dated or flattened summary if it has the quarter, else from the first table with quarter labels and
    revenue.
    """
    keep, metric = ["cik", "accn", "filed", "reported"], lookup(labels)
    docs = releases.withColumn("reported", D.reported_quarter_end(C("filed")))
    found = [summary_figures(C("lines"), metric), labelled_figures(C("lines"), metric, C("reported"))]
    rows = docs.select(*keep, "exhibit", F.inline(F.flatten(F.array_compact(F.array(*found)))))
    rows = _settled(rows, keep).where(F.abs(F.datediff("period_end", "reported")) <= within)
    table = F.struct("form", "exhibit", "i")
    rows = rows.withColumn("_b", F.min(table).over(Window.partitionBy(*keep))).where(table.eqNullSafe(C("_b")))
    return rows.select("cik", "accn", "filed", C("reported").alias("period_end"), "metric", "value", _source())


def monthly_rows(releases: DataFrame, keep: list[str], slack: float = 0.35, share: float = 0.02) -> DataFrame:
    """Month revenue of a monthly report: keep, month_end, revenue (millions), to_date (millions or null), source.

    The month comes from the report's title. A row of net revenue prints the month, the year before, the change, the
    month before, the change, and figures to date: it counts only if its own changes reproduce, within ``slack`` points
    or ``share`` of the change. A report without such a row may state the month in a sentence, rounded.
    """
    months = "|".join(MONTHS)
    title = rf"(?i)\b({months}) (\d{{4}}) revenue report"
    flat = F.regexp_replace(F.array_join("lines", " "), r"\s+", " ")
    top = F.regexp_replace(F.array_join(F.slice("lines", 1, 60), " "), r"\s+", " ")
    number = lambda name: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")
    d = releases.withColumn("_m", number(F.regexp_extract(top, title, 1))).withColumn("_y", F.regexp_extract(top, title, 2).try_cast("int")).where("_m > 0 AND _y IS NOT NULL")

    def change(v: Column, base: int, said: int) -> Column:
        made, p = F.abs(v[0] / F.nullif(v[base], F.lit(0.0)) - 1) * 100, F.abs(v[said])
        return F.coalesce(F.abs(made - p) <= F.greatest(F.lit(slack), p * share), F.lit(False))

    rows = F.filter(C("lines"), lambda s: F.trim(F.split(s, r"\|")[0]).rlike(r"(?i)^net revenues?$"))
    rows = F.transform(rows, lambda s: let(_cells(s), lambda c: _figures(F.slice(c, F.lit(2), F.size(c)))))
    good = F.get(F.filter(rows, lambda v: F.when(F.size(v) >= 5, change(v, 1, 2) & change(v, 3, 4)).otherwise(F.lit(False))), F.lit(0))
    stated = rf"(?i)revenues? for ({months}) (\d{{4}}) (?:was|were) approximately NT\$\s?([\d,.]*\d) billion"
    same = (number(F.regexp_extract(flat, stated, 1)) == C("_m")) & (F.regexp_extract(flat, stated, 2).try_cast("int") == C("_y"))
    said = F.when(same, money(F.regexp_extract(flat, stated, 3), F.lit("billion")))
    d = d.withColumn("_v", good).withColumn("_s", said).where("_v IS NOT NULL OR _s IS NOT NULL")
    return d.select(
        *keep, F.last_day(F.make_date("_y", "_m", F.lit(1))).alias("month_end"), F.coalesce(F.get("_v", F.lit(0)), C("_s")).alias("revenue"),
        F.get("_v", F.lit(5)).alias("to_date"), F.when(C("_v").isNotNull(), "row").otherwise("sentence").alias("source"),
    )


def monthly_sentences(releases: DataFrame, keep: list[str]) -> DataFrame:
    """Consolidated month revenue of a sentence: keep, month_end, revenue (millions); never the unconsolidated figure."""
    months = "|".join(MONTHS)
    p = rf"(?i)(?<!un)consolidated basis,? net (?:sales|revenues?) for ({months}) (\d{{4}}) (?:was|were) approximately NT\$\s?([\d,.]*\d) billion"
    flat = F.regexp_replace(F.array_join("lines", " "), r"\s+", " ")
    name = lambda i: F.regexp_extract(flat, p, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name(1))).cast("int")
    d = releases.select(*keep, F.when(month > 0, F.last_day(F.make_date(name(2).try_cast("int"), month, F.lit(1)))).alias("month_end"), money(name(3), F.lit("billion")).alias("revenue"))
    return d.where("month_end IS NOT NULL")


def backfilled_months(rows: DataFrame, sentences: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The months of ``rows``, and from ``sentences`` those that are missing; the earliest by ``order`` per key."""
    known = rows.select(*key).distinct()
    added = sentences.join(_shuffled(known), key, "left_anti").withColumn("source", F.lit("backfill"))
    both = rows.select(*key, *order, "revenue", "source").unionByName(added.select(*key, *order, "revenue", "source"))
    first = F.min_by(F.struct("revenue", "source"), F.struct(*order, "revenue"))
    return both.groupBy(*key).agg(first.alias("_f")).select(*key, "_f.revenue", "_f.source")


# Words of a share that covers all finer sizes, and the platforms of the revenue slide.
CUMULATIVE = r"(?i)advanced technolog|defined as|and more advanced|and below"
PLATFORMS = ("Smartphone", "HPC", "IoT", "Automotive", "DCE", "Others")
PLATFORM_SUM = (97.0, 103.0)


def node_shares(text: Column) -> Column:
    """(node, basis, pct) of the first sentence that gives shares of total wafer revenue.

    Its clauses are cut at semicolons, at 'and' behind 'revenue' and at 'while'; each gives one node and one share. A share
    of advanced technologies or of a size 'and below' is cumulative and named so, and never adds up with the others.
    """
    node, pct = r"(?i)(\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?)[\s-]?(nanometer|nm|micron|micrometer)\b", r"(?i)(\d+(?:\.\d+)?)\s?(?:percent|%)"
    flat = F.regexp_replace(text, r"\s+", " ")
    sentence = F.get(F.filter(F.split(flat, r"(?<=[.])\s"), lambda s: s.rlike("(?i)of total wafer revenue")), F.lit(0))
    clauses = F.coalesce(F.split(sentence, r";|(?<=revenue),?\s+and\s+|,?\s+while\s+"), F.array().cast("array<string>"))

    def read(c: Column) -> Column:
        size, unit, share = F.regexp_extract(c, node, 1), F.lower(F.regexp_extract(c, node, 2)), F.nullif(F.regexp_extract(c, pct, 1), F.lit("")).cast("double")
        wide = c.rlike(CUMULATIVE)
        name = F.concat(size, F.when(unit.startswith("n"), "nm").otherwise("um"), F.when(wide, " and below").otherwise(""))
        return F.when((size != "") & (share > 0) & (share <= 100), F.struct(name.alias("node"), F.when(wide, "cumulative").otherwise("node").alias("basis"), share.alias("pct")))

    firsts = lambda got: F.filter(got, lambda x: F.get(F.filter(got, lambda y: y["node"] == x["node"]), F.lit(0))["pct"] == x["pct"])
    return F.array_distinct(let(F.filter(F.transform(clauses, read), lambda x: x.isNotNull()), firsts))


def platform_shares(text: Column, period_end: Column, reach: int = 400) -> Column:
    """(platform, pct) of the quarter's slide: at least four platforms that sum to 97 to 103, behind its title or before it.

    The text is cut at the slide titles; the piece behind the quarter's own title is read first, then the one before.
    """
    title = r"(?:[1-4]Q\d\d|\b20\d\d\b) Revenue by Platform"
    mine = F.concat(F.quarter(period_end).cast("string"), F.lit("Q"), F.date_format(period_end, "yy"), F.lit(" Revenue by Platform"))

    def read(piece: Column) -> Column:
        share = lambda p: F.nullif(F.regexp_extract(piece, rf"{p}\s*(\d+(?:\.\d+)?)\s?%", 1), F.lit("")).cast("double")
        return F.filter(F.array(*[F.struct(F.lit(p).alias("platform"), share(p).alias("pct")) for p in PLATFORMS]), lambda x: x["pct"].isNotNull())

    def whole(found: Column) -> Column:
        return (F.size(found) >= 4) & F.aggregate(found, F.lit(0.0), lambda a, x: a + x["pct"]).between(*PLATFORM_SUM)

    def around(x: Column) -> Column:
        at = F.array_position(x["titles"], mine).cast("int")
        behind, before = F.get(x["pieces"], at), F.get(x["pieces"], at - 1)
        behind = F.when(at == F.size(x["titles"]), F.substring(behind, 1, reach)).otherwise(behind)
        before = F.when(at == 1, F.right(before, F.lit(reach))).otherwise(before)
        return F.when(at > 0, F.array(behind, before))

    flat = F.regexp_replace(text, r"\s+", " ")
    sides = let(flat, lambda t: let(F.struct(F.split(t, title).alias("pieces"), _all(t, title, 0).alias("titles")), around))
    return F.get(F.filter(F.transform(sides, read), whole), F.lit(0))
