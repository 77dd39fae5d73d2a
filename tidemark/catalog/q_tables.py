"""Queries on dated tables: releases are composed from the orders table, so the SQL knows what must be read back."""

from pyspark.sql import functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions import dates as D
from tidemark.plans import release_tables as R
from tidemark.session import cut_lineage, dealt

C = F.col

_DAY = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR AS DATE)"  # the readers take years from 2000 on
_O = f"""o AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_custkey AS INT) AS cik, {_DAY} AS filed, CAST(floor(o_totalprice / 100) AS INT) + 100 AS v,
  CAST(o_orderkey % {{k}} AS INT) AS k, date_trunc('quarter', {_DAY} - 5) AS q0 FROM orders)"""
_ENDS = "SELECT o.*, j, CAST(CAST(q0 - to_months(CAST(3 * j AS INT)) AS DATE) - 1 AS DATE) AS pe FROM o, (SELECT unnest(range(5)) AS j)"


def order_rows(spark, sf, k, key="accn"):
    """Order rows with the last five quarter ends before the day it is filed, newest first, dealt by ``key``."""
    o = V.table(spark, sf, "orders").select(
        C("o_orderkey").cast("int").alias("accn"), C("o_custkey").cast("int").alias("cik"), F.add_months(C("o_orderdate").cast("date"), 300).alias("filed"),
        (F.floor(C("o_totalprice") / 100) + 100).cast("int").alias("v"), (C("o_orderkey") % k).cast("int").alias("k"),
    )
    last = D.reported_quarter_end(C("filed"))
    # composing and reading a text costs far more than its row
    return dealt(o, key).withColumn("ends", F.array(*[F.last_day(F.add_months(last, -3 * j)) for j in range(5)]))


def orders(spark, sf, k):
    """As :func:`order_rows`, written once for all readers."""
    return cut_lineage(order_rows(spark, sf, k))


def cells(values):
    return F.array_join(values, " | ")


def oldest_first(fn):
    """One text per quarter end, oldest first: ``fn`` of the end and its number of quarters back."""
    return F.reverse(F.transform("ends", fn))


def printed(label, fn):
    return F.concat(F.lit(f"{label} | "), cells(oldest_first(lambda d, j: F.format_string("%,d", fn(j)))))


def quarter(i):
    return F.format_string("Q%d %d", F.quarter(C("ends")[i]), F.year(C("ends")[i]))


def flattened(*labels):
    """'Three months ended ...' and every (label, fn) on one line."""
    days = F.array_join(oldest_first(lambda d, j: F.concat(F.date_format(F.date_sub(d, 2), "MMM d"), F.lit(","))), " ")
    years = F.array_join(oldest_first(lambda d, j: F.year(d).cast("string")), " ")
    rows = [F.replace(printed(label, fn), F.lit(" | "), F.lit(" ")) for label, fn in labels]
    return F.concat_ws(" ", F.lit("Three months ended"), days, F.lit("(Unaudited, in millions)"), years, *rows)


def dated_head(title):
    """The head of a dated table over two lines; every other release prints days two before the quarter's end."""
    days = cells(oldest_first(lambda d, j: F.concat(F.date_format(F.date_sub(d, (C("accn") % 2 * 2).cast("int")), "MMM d"), F.lit(","))))
    return [F.lit(title), F.lit("Three months ended"), F.concat(F.lit(" | "), days), F.concat(F.lit("(in millions) | "), cells(oldest_first(lambda d, j: F.year(d).cast("string"))))]


def composed(o, *parts):
    """Rows (cik, accn, filed, exhibit, lines) from (k, exhibit, lines) triples."""
    rows = F.array(*[F.when(C("k") == k, F.struct(F.lit(name).alias("exhibit"), F.array(*lines).alias("lines"))) for k, name, lines in parts])
    return o.select("cik", "accn", "filed", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def exhibits(o, *parts):
    """As :func:`composed`, written once for all readers."""
    return cut_lineage(composed(o, *parts))


LABELS = {"Net sales": "revenue", "Total net sales": "revenue", "Gross profit": "gross_profit", "Income from operations": "operating_income"}


def quarter_tables(spark, sf):
    """Three forms of a results summary: dated columns, one flattened line, columns with quarter labels."""
    v = C("v")
    sales, profit = (lambda j: v + j), (lambda j: F.floor((v + j) / 2).cast("int"))
    dated = [*dated_head("Quarterly Summary Consolidated Statements of Operations"), printed("Total net sales 1", sales), printed("Gross profit", profit), F.lit("Income from operations | 1 | 2 | 3 | 4"), printed("Net sales", lambda j: v + 1000 + j)]
    flat = flattened(("Summary US GAAP Net sales", sales), ("Cost of sales 2", lambda j: v + 7), ("Gross profit", profit), ("Gross margin as", lambda j: v + j))
    label = [
        F.lit("Other table | Q1 1999 | Q2 1999"), F.concat_ws(" | ", F.lit("(in millions)"), quarter(1), quarter(0), F.concat(F.lit("FY "), F.year(C("ends")[0]).cast("string"))),
        F.format_string("Net sales | %,d | %,d | %,d", v + 1, v, v * 4), F.format_string("Gross profit | %,d | %,d", v + 2, v), F.format_string("Income from operations | (%d) | (%d) | %d", v + 1, v, v),
    ]
    other = [F.lit("Results in accordance with IFRS-EU"), *dated_head("Quarterly Summary Consolidated Statements of Operations"), printed("Net sales", lambda j: v * 9 + j)]
    return composed(order_rows(spark, sf, 3), (0, "EX-99.0", other), (0, "EX-99.2", dated), (1, "EX-99.3", [F.lit("Summary"), flat]), (2, "EX-99.1", label))


@query(
    "i16_fpi_quarter_tables",
    f"""WITH {_O.format(k=3)}, e AS ({_ENDS})
SELECT cik, accn, CAST(pe AS VARCHAR) AS pe, metric, CAST(CASE metric WHEN 'revenue' THEN v WHEN 'gross_profit' THEN v // 2 ELSE -v END AS DOUBLE) AS value,
  CASE k WHEN 0 THEN 'dated columns' WHEN 1 THEN 'flattened' ELSE 'quarter labels' END AS source
FROM e, (SELECT unnest(['revenue', 'gross_profit', 'operating_income']) AS metric) WHERE j = 0 AND (metric = 'revenue' OR metric = 'gross_profit' AND k < 2 OR metric = 'operating_income' AND k = 2)""",
)
def i16(spark, sf):
    d = R.reported_quarters(quarter_tables(spark, sf), LABELS)
    return d.select("cik", "accn", C("period_end").cast("string").alias("pe"), "metric", "value", "source")


@query(
    "i16_quarter_printings",
    f"""WITH {_O.format(k=3)}, e AS ({_ENDS})
SELECT accn, CAST(pe AS VARCHAR) AS pe, metric, CAST(CASE metric WHEN 'revenue' THEN v + j ELSE (v + j) // 2 END AS DOUBLE) AS value
FROM e, (SELECT unnest(['revenue', 'gross_profit']) AS metric) WHERE k < 2""",
)
def i16_printings(spark, sf):
    d = R.quarter_printings(quarter_tables(spark, sf), ["cik", "accn", "filed"], R.lookup(LABELS))
    return d.select("accn", C("period_end").cast("string").alias("pe"), "metric", "value")


def kpi_releases(spark, sf):
    """Four forms of operating figures: dated ratios beside a rounded text, headline table, text, flattened ratios."""
    v = C("v")
    u = (v % 90 + 10).cast("int")
    ratios = [
        *dated_head("Quarterly Summary Ratios and other data"), printed("Net bookings (in units) 1, 2", lambda j: u + j), printed("Value of net bookings (EUR millions)3", lambda j: v + j),
        printed("Value of systems backlog, excluding EUV (2)", lambda j: v * 2 + j), F.lit("Systems backlog (units) | 5 | 6 | 7"), printed("Return on equity", lambda j: v),
    ]
    rounded = F.concat(quarter(0), F.format_string(" net bookings of EUR %d billion, systems backlog valued at EUR %,d million.", v, v * 3))
    head = [
        F.lit("Highlights | Q1 1999"), F.concat_ws(" | ", F.lit("(Figures in millions)"), quarter(1), quarter(0), F.concat(F.lit("FY "), F.year(C("ends")[0]).cast("string"))),
        F.format_string("Net bookings * | %,d | %,d | %,d", v + 1, v, v * 4), F.format_string("Systems backlog (units) | 2 | %d | %d | %d", u + 1, u, u * 9), F.lit("Systems backlog | 1 | 2"),
    ]
    text = F.concat(F.lit("The year was good. Our "), quarter(0), F.format_string(" net bookings totaled %d systems valued at EUR %,d million, with a backlog valued at EUR %d.5 billion. In the quarter net bookings of EUR 1 million came late.", u, v, v))
    flat = flattened(("Ratios Number of payroll employees (in FTEs)", lambda j: v + j), ("Net bookings 3", lambda j: v + 20 + j), ("Systems backlog", lambda j: v))
    return composed(
        order_rows(spark, sf, 4, "cik"), (0, "EX-99.3", ratios), (0, "EX-99.1", [rounded]), (1, "EX-99.1", head), (2, "EX-99.1", [text]), (3, "EX-99.3", [flat])
    )


_KPI = f"""{_O.format(k=4)}, e AS ({_ENDS}), p AS (
SELECT cik, accn, filed, pe, m.metric, CAST(CASE m.metric WHEN 'bookings_units' THEN v % 90 + 10 + j WHEN 'bookings_value' THEN v + j ELSE v * 2 + j END AS DOUBLE) AS value, 'EX-99.3 ratios table' AS source
  FROM e, (SELECT unnest(['bookings_units', 'bookings_value', 'backlog_value_ex_euv']) AS metric) m WHERE k = 0
UNION ALL SELECT cik, accn, filed, pe, 'backlog_value', CAST(v * 3 AS DOUBLE), 'EX-99.1 text' FROM e WHERE k = 0 AND j = 0
UNION ALL SELECT cik, accn, filed, pe, 'bookings_value', CAST(v + j AS DOUBLE), 'EX-99.1 headline table' FROM e WHERE k = 1 AND j < 2
UNION ALL SELECT cik, accn, filed, pe, 'backlog_units', CAST(v % 90 + 10 + j AS DOUBLE), 'EX-99.1 headline table' FROM e WHERE k = 1 AND j < 2
UNION ALL SELECT cik, accn, filed, pe, m.metric, CAST(CASE m.metric WHEN 'bookings_units' THEN v % 90 + 10 WHEN 'bookings_value' THEN v ELSE v * 1000 + 500 END AS DOUBLE), 'EX-99.1 text'
  FROM e, (SELECT unnest(['bookings_units', 'bookings_value', 'backlog_value']) AS metric) m WHERE k = 2 AND j = 0
UNION ALL SELECT cik, accn, filed, pe, 'employees_payroll_fte', CAST(v + j AS DOUBLE), 'EX-99.3 ratios (flattened)' FROM e WHERE k = 3
UNION ALL SELECT cik, accn, filed, pe, 'bookings_value', CAST(v + 20 + j AS DOUBLE), 'EX-99.3 ratios (flattened)' FROM e WHERE k = 3)"""


@query(
    "i17_kpi_tables",
    f"""WITH {_KPI}, c AS (SELECT cik, pe, metric, sum(x) AS conflicts FROM (SELECT cik, pe, metric, accn, CAST(count(DISTINCT value) > 1 AS BIGINT) AS x FROM p GROUP BY ALL) GROUP BY ALL)
SELECT cik, CAST(pe AS VARCHAR) AS pe, metric, arg_min(value, (filed, source, accn, value)) AS first, arg_min(source, (filed, source, accn, value)) AS first_source,
  arg_max(value, (filed, source, accn, value)) AS latest, CAST(max(filed) AS VARCHAR) AS latest_filed, CAST(any_value(conflicts) AS BIGINT) AS conflicts FROM p JOIN c USING (cik, pe, metric) GROUP BY cik, pe, metric""",
)
def i17(spark, sf):
    d = R.first_and_latest(R.kpi_printings(kpi_releases(spark, sf)))
    return d.withColumn("pe", C("period_end").cast("string")).withColumn("latest_filed", C("latest_filed").cast("string")).drop("period_end")


_MARKS = ["", " *", " (3)", "2", " 1, 2", " (2) "]


@query(
    "h13_kpi_canonical_label",
    "SELECT CAST(p_partkey AS INT) AS part, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'bookings_units_ex_euv' WHEN 1 THEN 'bookings_value' WHEN 2 THEN 'backlog_value_ex_euv' WHEN 3 THEN 'employees_payroll_fte'"
    " WHEN 4 THEN 'asp_system_sales' WHEN 5 THEN 'installed_base_mgmt_sales' WHEN 6 THEN 'backlog_units' END AS metric FROM part",
)
def h13(spark, sf):
    """Labels in every case and with every footnote mark by part; the eighth form is no operating figure."""
    forms = ["Net bookings, excluding EUV (in units)", "Value of net  bookings (EUR millions)", "Systems backlog, excluding EUV in millions", "Number of payroll employees (in FTEs)",
             "Average selling price of lithography system sales (EUR millions)", "...of which Installed Base Management sales", "SYSTEMS BACKLOG (units)", "Systems backlogged (units)"]
    p = V.table(spark, sf, "part").select(C("p_partkey").cast("int").alias("part"))
    form = F.array(*[F.lit(x) for x in forms])[C("part") % len(forms)]
    mark = F.array(*[F.lit(x) for x in _MARKS])[(C("part") / len(forms)).cast("int") % len(_MARKS)]
    return p.select("part", R.kpi_metric(F.concat(F.lit(" "), form, mark)).alias("metric"))



def monthly_reports(spark, sf):
    """Monthly reports: a sound row, a row with one wrong change beside a rounded sentence, a wrong row alone, no title."""
    o = orders(spark, sf, 4)
    v, ago, before = C("v").cast("double"), (C("v") + C("v") % 50 + 30).cast("double"), (C("v") - C("v") % 40 - 5).cast("double")
    name = F.date_format("filed", "MMMM yyyy")
    yoy, mom = (v / ago - 1) * 100, (v / before - 1) * 100
    row = lambda off: F.format_string("Net Revenues | %,.0f | %,.0f | (%.1f)%% | %,.0f | %.1f%% | %,.0f | %,.0f | 3.0%%", v, ago, -yoy, before, mom + off, v * 3, v * 2)
    sentence = F.concat(F.lit("On a consolidated basis, revenues for "), name, F.format_string(" were approximately NT$%,d.25 billion, up on the year.", C("v")))
    title = F.concat(F.lit("Acme "), name, F.lit(" Revenue Report"))
    head = F.lit("(in NT$ million) | Month | Year ago | Change | Prior | Change | To date | Year ago | Change")
    return exhibits(o, (0, "EX-99.1", [title, head, row(0.0)]), (1, "EX-99.1", [title, head, row(9.0), sentence]), (2, "EX-99.1", [title, head, row(9.0)]), (3, "EX-99.1", [head, row(0.0)]))


@query(
    "i18_monthly_rows",
    f"""SELECT CAST(o_orderkey AS INT) AS accn, CAST(last_day({_DAY}) AS VARCHAR) AS month_end, CASE WHEN o_orderkey % 4 = 0 THEN v ELSE v * 1000 + 250 END AS revenue,
  CASE WHEN o_orderkey % 4 = 0 THEN v * 3 END AS to_date, CASE WHEN o_orderkey % 4 = 0 THEN 'row' ELSE 'sentence' END AS source
FROM (SELECT *, CAST(floor(o_totalprice / 100) + 100 AS DOUBLE) AS v FROM orders) WHERE o_orderkey % 4 < 2""",
)
def i18_months(spark, sf):
    d = R.monthly_rows(monthly_reports(spark, sf), ["accn"])
    return d.select("accn", C("month_end").cast("string").alias("month_end"), "revenue", "to_date", "source")


@query(
    "i20_monthly_sentence",
    f"""WITH r AS (SELECT CAST(o_custkey AS INT) AS cik, {_DAY} AS filed, CAST(o_orderkey AS INT) AS accn, last_day({_DAY}) AS m, CAST(o_orderkey % 4 AS INT) AS k, CAST(floor(o_totalprice / 100) + 100 AS DOUBLE) AS v FROM orders),
p AS (SELECT cik, m, filed, accn, v AS revenue, 'row' AS source FROM r WHERE k = 0 UNION ALL SELECT cik, m, filed, accn, v * 1000 + 250, 'sentence' FROM r WHERE k = 1),
a AS (SELECT cik, m, filed, accn, revenue, source FROM p UNION ALL SELECT cik, m, filed, accn, v * 1000 + 750, 'backfill' FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cik = r.cik AND p.m = r.m))
SELECT cik, CAST(m AS VARCHAR) AS month_end, arg_min(revenue, (filed, accn)) AS revenue, arg_min(source, (filed, accn)) AS source FROM a GROUP BY cik, m""",
)
def i20(spark, sf):
    """Months of the reports, and for companies without one that month the older wording of every order."""
    o = orders(spark, sf, 1)
    name = F.date_format("filed", "MMMM yyyy")
    old = F.concat(F.lit("On an unconsolidated basis, net sales for "), name, F.lit(" were approximately NT$ 1.00 billion. On a consolidated basis, net sales for "), name, F.format_string(" were approximately NT$ %d.75 billion.", C("v")))
    keep = ["cik", "filed", "accn"]
    d = R.backfilled_months(R.monthly_rows(monthly_reports(spark, sf), keep), R.monthly_sentences(exhibits(o, (0, "EX-99.1", [old])), keep), ["cik", "month_end"], ["filed", "accn"])
    return d.withColumn("month_end", C("month_end").cast("string"))


@query(
    "i19_mix_sentences",
    """WITH o AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_orderkey % 30 + 1 AS DOUBLE) AS p FROM orders)
SELECT accn, '5nm' AS node, 'node' AS basis, p AS pct FROM o UNION ALL SELECT accn, '7nm', 'node', p + 20.5 FROM o UNION ALL SELECT accn, '0.11/0.13um', 'node', p + 1 FROM o
UNION ALL SELECT accn, '7nm and below', 'cumulative', 2 * p + 20.5 FROM o""",
)
def i19(spark, sf):
    """Node shares of a sentence with single nodes, a decimal share, microns and a cumulative bucket, text unedited."""
    o = orders(spark, sf, 1)
    p = (C("accn") % 30 + 1).cast("int")
    text = F.format_string(
        "Net income rose 12%%. In the quarter, 5-nanometer accounted for %d%% of total wafer revenue, while 7-nanometer process technology accounted for %d.5 percent; the 0.11/0.13 micron node contributed %d%% of total wafer revenue, and advanced technologies, defined as 7-nanometer and more advanced technologies, accounted for %d.5%%. The 28nm share was 9%% of total wafer revenue.",
        p, p + 20, p + 1, p * 2 + 20,
    )
    return o.select("accn", F.inline(R.node_shares(text)))


@query(
    "i19_platform_mix",
    """WITH o AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_orderkey % 20 + 1 AS DOUBLE) AS p, CAST(o_orderkey % 3 AS INT) AS k FROM orders)
SELECT accn, m.platform, CASE m.i WHEN 0 THEN p WHEN 1 THEN 40 - p WHEN 2 THEN 20.5 WHEN 3 THEN 30 ELSE 9 END AS pct
FROM o, (SELECT unnest(['Smartphone', 'HPC', 'IoT', 'Automotive', 'Others']) AS platform, unnest(range(5)) AS i) m WHERE k < 2""",
)
def i19_platforms(spark, sf):
    """Slides: labels behind the title, labels before it, and shares that do not sum to a hundred."""
    o = orders(spark, sf, 3)
    p = (C("accn") % 20 + 1).cast("int")
    shares = F.format_string("Smartphone %d%% HPC %d%% IoT 20.5%% Automotive 30%% Others %d%%", p, F.lit(40) - p, F.when(C("k") == 2, 29).otherwise(9))
    title = F.concat(F.quarter(C("ends")[0]).cast("string"), F.lit("Q"), F.date_format(C("ends")[0], "yy"), F.lit(" Revenue by Platform"))
    older = F.concat(F.quarter(C("ends")[1]).cast("string"), F.lit("Q"), F.date_format(C("ends")[1], "yy"), F.lit(" Revenue by Platform HPC 50% Smartphone 50%"))
    text = F.when(C("k") == 1, F.concat_ws(" ", shares, title, F.lit("Growth"), older)).otherwise(F.concat_ws(" ", older, title, shares, F.lit("Growth")))
    return o.select("accn", F.inline(R.platform_shares(text, C("ends")[0])))
