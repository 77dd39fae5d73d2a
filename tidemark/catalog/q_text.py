"""Text queries: release texts are composed from the orders table, so the SQL knows what must be read back."""

from pyspark.sql import functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions import dates as D, text as X
from tidemark.plans import guides as G, release_text as T
from tidemark.session import dealt
from tidemark.sources import html as H

C = F.col

_TX = """t AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(floor(o_totalprice / 1000) AS INT) + 1 AS v, CAST(o_orderkey % 10 AS INT) AS k FROM orders),
e AS (SELECT accn, k, v, v + v // 10 + 1 AS hi, v % 20 + 1 AS g FROM t)"""


def releases(spark, sf):
    """One release text per order, ten phrasings: ranges, a tolerance, growth, headline, figures without a sign, and traps
    (a result, other money, a cue before the guide's own cue, no guide)."""
    o = V.table(spark, sf, "orders").select(
        C("o_orderkey").cast("int").alias("accn"), (F.floor(C("o_totalprice") / 1000) + 1).cast("int").alias("v"), (C("o_orderkey") % 10).cast("int").alias("k")
    )
    o = dealt(o, "accn")  # reading a text costs far more than its row
    v, hi, g = C("v"), (C("v") + F.floor(C("v") / 10) + 1).cast("int"), C("v") % 20 + 1
    text = (
        F.when(C("k") == 0, F.format_string("Outlook. For the second quarter, we expect revenue in the range of $%d million to $%d million. Gross margin is expected between %d%% and %d%%.", v, hi, g, g + 2))
        .when(C("k") == 1, F.format_string("Revenue for the third quarter is expected to be $%d million, plus or minus two percent.", v))
        .when(C("k") == 2, F.format_string("For the full year 2027, the company expects total revenue between $%d million and $%d million.", v, hi))
        .when(C("k") == 3, F.format_string("For the full year, we expect revenue growth of %d%% to %d%%.", g, g + 4))
        .when(C("k") == 4, F.format_string("Revenue was $%d million, compared with the prior year. The company expects cost savings of $%d million and lower sales costs.", v, v))
        .when(C("k") == 5, F.format_string("The company will host a call at %d pm.", v % 12))
        .when(C("k") == 6, F.format_string("The company expects revenue of %d to %d million for the first quarter.", v, hi))
        .when(C("k") == 7, F.format_string("Acme announces full-year guidance of $%d-%d million in revenue.", v, hi))
        .when(C("k") == 8, F.format_string("Outlook. Demand is expected to stay firm. We expect capital spending to be lower; for the full year, net sales are forecast to grow by %d%%.", g))
        .otherwise(F.format_string("Sales guidance, which excludes the divested unit, is now $%d million for the next quarter.", v))
    )
    return o.select("accn", "k", "v", text.alias("text"))


@query(
    "i05_market_guide_dollar",
    f"""WITH {_TX} SELECT accn, CASE WHEN k IN (0, 2, 6, 7) THEN CAST(v AS DOUBLE) END AS low, CASE WHEN k IN (0, 2, 6, 7) THEN CAST(v + hi AS DOUBLE) / 2 WHEN k IN (1, 9) THEN CAST(v AS DOUBLE) END AS mid, CASE WHEN k IN (0, 2, 6, 7) THEN CAST(hi AS DOUBLE) END AS high FROM e""",
)
def i05(spark, sf):
    g = releases(spark, sf).withColumn("g", G.guide(C("text")))
    return g.select("accn", C("g.revenue_low").alias("low"), C("g.revenue_mid").alias("mid"), C("g.revenue_high").alias("high"))


@query(
    "i06_market_guide_pct",
    f"WITH {_TX} SELECT accn, CASE WHEN k = 3 THEN CAST(g AS DOUBLE) END AS low, CASE WHEN k = 3 THEN CAST(g + 2 AS DOUBLE) WHEN k = 8 THEN CAST(g AS DOUBLE) END AS mid, CASE WHEN k = 3 THEN CAST(g + 4 AS DOUBLE) END AS high FROM e",
)
def i06(spark, sf):
    g = releases(spark, sf).withColumn("g", G.guide(C("text")))
    return g.select("accn", C("g.growth_low_pct").alias("low"), C("g.growth_mid_pct").alias("mid"), C("g.growth_high_pct").alias("high"))


@query(
    "i07_guide_period",
    f"WITH {_TX} SELECT accn, CASE WHEN k IN (0, 1, 6, 9) THEN 'quarter' WHEN k IN (2, 3, 7, 8) THEN 'full_year' END AS period FROM e",
)
def i07(spark, sf):
    return releases(spark, sf).select("accn", G.guide(C("text")).alias("g")).select("accn", C("g.period").alias("period"))


@query(
    "i01_guidance_windows",
    f"WITH {_TX} SELECT accn, CAST(CASE WHEN k IN (0, 8) THEN 2 WHEN k = 5 THEN 0 ELSE 1 END AS INT) AS windows FROM e",
)
def i01(spark, sf):
    return G.with_windows(releases(spark, sf), "text").select("accn", F.size("windows").alias("windows"))


@query(
    "i02_guidance_patterns",
    f"""WITH {_TX} SELECT accn, CASE WHEN k IN (0, 2, 6) THEN CAST(v AS DOUBLE) END AS revenue_low, CASE WHEN k IN (0, 2, 6) THEN CAST(v + hi AS DOUBLE) / 2 WHEN k IN (1, 9) THEN CAST(v AS DOUBLE) END AS revenue_mid,
  CASE WHEN k IN (0, 1, 2, 9) THEN '$' END AS revenue_currency, CASE WHEN k = 2 THEN 'fy_' WHEN k IN (0, 1, 6, 9) THEN '' END AS revenue_period,
  CASE WHEN k = 1 THEN CAST(2 AS DOUBLE) END AS revenue_pm_pct, CASE WHEN k = 0 THEN CAST(g AS DOUBLE) END AS gm_low, CASE WHEN k = 0 THEN CAST(g + 2 AS DOUBLE) END AS gm_high FROM e""",
)
def i02(spark, sf):
    d = G.with_windows(releases(spark, sf), "text").withColumn("f", G.best_detail(C("windows")))
    return d.select("accn", *[C(f"f.{c}") for c in ("revenue_low", "revenue_mid", "revenue_currency", "revenue_period", "revenue_pm_pct", "gm_low", "gm_high")])


_FAMILIES = (
    "The company expects third quarter total net sales to be between EUR {v} million and EUR {hi} million.",
    "The company expects net sales for the fourth quarter to be around EUR {v} million.",
    "For the next quarter, we expect revenue to increase {g}% to {h}% sequentially.",
    "For the next quarter, we expect revenue to decrease approximately {g}-{h}% sequentially.",
    "For the next quarter, we expect revenue to grow {g}%, plus or minus 2%, sequentially.",
    "For the next quarter, we expect revenue to decline by {g}% sequentially, plus or minus 2%.",
    "For quarter 2, we expect revenue to be flat to slightly down sequentially.",
    "Revenue for the first quarter is expected to be ${v} million. GAAP and non-GAAP gross margins are expected to be {g}.5% and {h}%, respectively.",
    "Outlook for the first quarter: revenue is expected to be ${v} million. Gross margin | {g}% | {h}%.",
    "Revenue for the first quarter is expected to be ${v} million. GAAP and non-GAAP gross margins are expected to be {g}%.",
)


@query(
    "i02_guidance_families",
    f"""WITH {_TX} SELECT accn, CASE WHEN k = 0 THEN CAST(v AS DOUBLE) END AS revenue_low, CASE WHEN k = 0 THEN CAST(v + hi AS DOUBLE) / 2 WHEN k IN (1, 7, 8, 9) THEN CAST(v AS DOUBLE) END AS revenue_mid, CASE WHEN k = 0 THEN CAST(hi AS DOUBLE) END AS revenue_high,
  CASE WHEN k IN (0, 1) THEN 'EUR' WHEN k >= 7 THEN '$' END AS revenue_currency, CASE WHEN k = 2 THEN CAST(g AS DOUBLE) WHEN k = 3 THEN CAST(-g AS DOUBLE) END AS revenue_qoq_low_pct, CASE WHEN k = 2 THEN CAST(g + 2 AS DOUBLE) WHEN k = 3 THEN CAST(-g - 2 AS DOUBLE) END AS revenue_qoq_high_pct,
  CASE WHEN k = 2 THEN CAST(g + 1 AS DOUBLE) WHEN k = 3 THEN CAST(-g - 1 AS DOUBLE) WHEN k = 4 THEN CAST(g AS DOUBLE) WHEN k = 5 THEN CAST(-g AS DOUBLE) END AS revenue_qoq_pct, CASE WHEN k IN (4, 5) THEN CAST(2 AS DOUBLE) END AS revenue_qoq_pm_pct, CASE WHEN k = 6 THEN 'flat to slightly down' END AS revenue_direction,
  CASE k WHEN 7 THEN g + CAST(0.5 AS DOUBLE) WHEN 8 THEN CAST(g AS DOUBLE) WHEN 9 THEN CAST(g AS DOUBLE) END AS gm_gaap, CASE k WHEN 7 THEN CAST(g + 2 AS DOUBLE) WHEN 8 THEN CAST(g + 2 AS DOUBLE) WHEN 9 THEN CAST(g AS DOUBLE) END AS gm_nongaap FROM e""",
)
def i02_families(spark, sf):
    """Currency words, changes on the quarter as ranges or with tolerance, directions in words, margins on both bases."""
    d = releases(spark, sf).select("accn", "k", "v", (C("v") + F.floor(C("v") / 10) + 1).alias("hi"), (C("v") % 20 + 1).alias("g"))
    text = F.get(F.array(*[F.lit(t) for t in _FAMILIES]), C("k"))
    for name, value in (("v", C("v")), ("hi", C("hi")), ("g", C("g")), ("h", C("g") + 2)):
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    d = G.with_windows(d.select("accn", text.alias("text")), "text").withColumn("f", G.best_detail(C("windows")))
    names = "revenue_low revenue_mid revenue_high revenue_currency revenue_qoq_low_pct revenue_qoq_high_pct revenue_qoq_pct revenue_qoq_pm_pct revenue_direction gm_gaap gm_nongaap".split()
    return d.select("accn", *[C(f"f.{c}") for c in names])


@query(
    "i04_guide_presence",
    f"WITH {_TX} SELECT accn, CAST(k IN (0, 1, 2, 4, 7, 9) AS INT) AS present, CAST(k NOT IN (4, 5, 6) AS INT) AS strict FROM e",
)
def i04(spark, sf):
    return releases(spark, sf).select("accn", G.guide_present(C("text")).cast("int").alias("present"), G.guide_present_strict(C("text")).cast("int").alias("strict"))


@query(
    "i08_guide_tiering",
    f"WITH {_TX} SELECT CASE WHEN k IN (0, 1, 2, 6, 9) THEN 'tier1' WHEN k IN (3, 7, 8) THEN 'tier2' WHEN k = 4 THEN 'unread' ELSE 'none' END AS status, count(*) AS n FROM e GROUP BY 1",
)
def i08(spark, sf):
    return G.tiered(releases(spark, sf), "text").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tables(spark, sf):
    """Plain-text tables of an order: a guide table, a checked results row and a mixed row."""
    o = V.table(spark, sf, "orders").select(C("o_orderkey").cast("int").alias("accn"), (F.floor(C("o_totalprice") / 100) + 100).cast("int").alias("v"))
    v = C("v")
    text = F.concat_ws(
        "\n",
        F.lit("Business outlook"),
        F.lit("Item | Next quarter"),
        F.format_string("Revenue | $%d million | +/- | $%d million", v, F.floor(v / 20)),
        F.format_string("Net sales | %d | %d | %.1f%% | %d | %.1f%%", v * 2, v, F.lit(100.0), v * 4, F.when(C("accn") % 2 == 0, -50.0).otherwise(-40.0)),
        F.format_string("Units (sold) | (%d) | %d", v, v + 1),
        F.lit("No numbers here"),
    )
    return o.select("accn", "v", text.alias("text"))


@query(
    "i03_guidance_table",
    """SELECT CAST(o_orderkey AS INT) AS accn, CAST(v AS DOUBLE) AS revenue_mid, CAST(v // 20 AS DOUBLE) AS revenue_pm_abs, 'Revenue | $' || v || ' million | +/- | $' || v // 20 || ' million' AS row
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS INT) + 100 AS v FROM orders)""",
)
def i03(spark, sf):
    d = tables(spark, sf).withColumn("lines", G.text_lines(C("text")))
    return d.select("accn", G.table_guide(C("lines")).alias("t")).select("accn", "t.revenue_mid", "t.revenue_pm_abs", "t.row")


def table_lines(spark, sf):
    return tables(spark, sf).select("accn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    "i18_self_checked_table",
    "SELECT CAST(o_orderkey AS INT) AS accn, 'Net sales' AS label, CAST((CAST(floor(o_totalprice / 100) AS INT) + 100) * 2 AS DOUBLE) AS value FROM orders WHERE o_orderkey % 2 = 0",
)
def i18(spark, sf):
    return T.checked_results(table_lines(spark, sf), "accn", "line").select("accn", "label", "value")


@query(
    "i16_table_values",
    "SELECT CAST(o_orderkey AS INT) AS accn, 'Units (sold)' AS label, -CAST(CAST(floor(o_totalprice / 100) AS INT) + 100 AS DOUBLE) AS a, CAST(CAST(floor(o_totalprice / 100) AS INT) + 101 AS DOUBLE) AS b FROM orders",
)
def i16(spark, sf):
    d = T.table_values(table_lines(spark, sf), "accn", "line", 2).where(C("label").startswith("Units"))
    return d.select("accn", "label", C("values")[0].alias("a"), C("values")[1].alias("b"))


@query(
    "h09_number_scan",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '\(?-?\$?\s?[\d,]+(?:\.\d+)?\)?')) AS s FROM documents),
n AS (SELECT doc_id, TRY_CAST(regexp_replace(s, '[^\d.\-]', '', 'g') AS DOUBLE) AS v, starts_with(s, '(') AND ends_with(s, ')') AS neg FROM x)
SELECT doc_id, count(*) AS n FROM n WHERE v IS NOT NULL GROUP BY 1""",
)
def h09(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.size(X.numbers(C("text"))).cast("long").alias("n"))
    return d.where(C("n") > 0)


@query(
    "h10_money_scale",
    "SELECT CAST(o_orderkey AS INT) AS accn, CAST(floor(o_totalprice) AS DOUBLE) * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS millions FROM orders",
)
def h10(spark, sf):
    o = V.table(spark, sf, "orders")
    unit = F.when(C("o_orderkey") % 2 == 0, "Billion").otherwise("mm")
    text = F.format_number(F.floor("o_totalprice"), 0)
    return o.select(C("o_orderkey").cast("int").alias("accn"), X.money(text, unit).alias("millions"))


@query("h11_number_words", "SELECT CAST(o_orderkey AS INT) AS accn, 'up plus or minus ' || CAST(o_orderkey % 10 + 1 AS VARCHAR) || '%' AS text FROM orders")
def h11(spark, sf):
    words = F.array(*[F.lit(w) for w in X.NUMBER_WORDS])
    o = V.table(spark, sf, "orders").select(C("o_orderkey").cast("int").alias("accn"), F.element_at(words, (C("o_orderkey") % 10 + 1).cast("int")).alias("w"))
    return o.select("accn", X.number_words(F.concat(F.lit("up +/- "), "w", F.lit(" percent"))).alias("text"))


@query("h08_member_label", "SELECT DISTINCT p_name AS label, p_name AS want FROM part")
def h08(spark, sf):
    tag = F.concat(F.lit("us:"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("Member"))
    p = V.table(spark, sf, "part").select("p_name").distinct()
    return p.select(F.lower(X.member_words(tag)).alias("label"), C("p_name").alias("want"))


@query(
    "h12_geo_label",
    "SELECT r_name AS name, CAST(upper(r_name) IN ('ASIA', 'EUROPE', 'AMERICA') AS INT) AS geo FROM region UNION ALL SELECT n_name, CAST(upper(n_name) IN ('UNITED STATES', 'CHINA', 'JAPAN', 'INDIA', 'GERMANY') AS INT) FROM nation",
)
def h12(spark, sf):
    r = V.table(spark, sf, "region").select(C("r_name").alias("name"))
    d = r.unionByName(V.table(spark, sf, "nation").select(C("n_name").alias("name")))
    return d.select("name", X.is_geography(C("name"), F.lit("x")).cast("int").alias("geo"))


@query(
    "i22_printed_number_check",
    f"""WITH {_TX}, n AS (SELECT accn, list_transform(regexp_extract_all(txt, '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS ns, [CAST(v AS DOUBLE), v * CAST(77777 AS DOUBLE)] AS vs
  FROM (SELECT accn, v, v || ' | ' || hi || ' | ' || g || ' | 2027' AS txt FROM e))
SELECT accn, len(list_filter(vs, lambda v: len(list_filter(ns, lambda x: abs(x - v) <= v * 0.005 OR abs(x - v / 1e3) <= v / 1e3 * 0.005 OR abs(x - v * 1e3) <= v * 1e3 * 0.005)) > 0)) / CAST(2 AS DOUBLE) AS printed FROM n""",
)
def i22(spark, sf):
    """Every number of a printed row (years and small percentages too) against a value it holds and one it may hold."""
    v, hi, g = C("v"), (C("v") + F.floor(C("v") / 10) + 1).cast("int"), C("v") % 20 + 1
    d = releases(spark, sf).select("accn", "v", F.format_string("%d | %d | %d | 2027", v, hi, g).alias("line"))
    vals = F.array(v.cast("double"), v * 77777.0)
    return d.withColumn("n", X.numbers(C("line"))).select("accn", T.printed_share(C("n"), vals).alias("printed"))


def customers_text(spark, sf):
    """Concentration texts: a floor with a table, a measured share with a receivable and a place sentence, a none statement."""
    o = V.table(spark, sf, "orders").select(C("o_orderkey").cast("int").alias("accn"), (C("o_orderkey") % 70).cast("int").alias("p"), C("o_custkey").cast("int").alias("c"))
    line = (
        F.when(C("accn") % 3 == 0, F.format_string("The following customers each represented more than 10%% of total revenue:\nCustomer %d | %d%%\nNote | none\nOther text", C("c"), C("p")))
        .when(C("accn") % 3 == 1, F.format_string("Sales to China were %d%% of revenue. Costs in Japan rose %d%%.\nCustomer A accounted for %d%% of total revenue. Customer B was 33%% of accounts receivable and sales. Customers headquartered abroad were 44%% of sales.", C("p"), C("p"), C("p")))
        .otherwise(F.format_string("For the first quarter of fiscal %d, no customers to report.\nNo single customer represented 10%% or more of total revenue.", 2010 + C("p") % 10))
    )
    return o.select("accn", "p", "c", line.alias("text"))


@query(
    "i12_concentration_text",
    """SELECT CAST(o_orderkey AS INT) AS accn, CASE o_orderkey % 3 WHEN 0 THEN 'The following customers each represented more than 10% of total revenue:' || chr(10) || 'Customer ' || o_custkey || ' | ' || o_orderkey % 70 || '%' || chr(10) || 'Note | none'
  ELSE 'No single customer represented 10% or more of total revenue.' END AS text FROM orders WHERE o_orderkey % 3 <> 1""",
)
def i12(spark, sf):
    d = customers_text(spark, sf).withColumn("lines", G.text_lines(C("text")))
    d = d.select("accn", T.concentration_paragraphs(C("lines")).alias("text"))
    return d.where(C("text") != "")


@query(
    "i13_concentration_pct",
    """SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_orderkey % 3 = 2 AS INT) AS none_over_ten, CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 70 BETWEEN 10 AND 60 THEN CAST(o_orderkey % 70 AS DOUBLE) END AS pct FROM orders""",
)
def i13(spark, sf):
    d = customers_text(spark, sf).select("accn", T.concentration_shares(C("text")).alias("s"))
    return d.select("accn", C("s.none").cast("int").alias("none_over_ten"), F.explode_outer("s.shares").alias("pct"))


@query(
    "b27_floor_flag",
    "SELECT CAST(o_orderkey AS INT) AS accn, CAST(unnest(CASE WHEN o_orderkey % 70 BETWEEN 11 AND 60 THEN [1, 0] WHEN o_orderkey % 70 = 10 THEN [1, 1] ELSE [1] END) AS INT) AS is_floor FROM orders WHERE o_orderkey % 3 = 0",
)
def b27(spark, sf):
    d = customers_text(spark, sf).where(C("accn") % 3 == 0)
    d = d.withColumn("pct", F.explode(T.concentration_percents(C("text"))))
    return d.select("accn", T.is_floor(C("text"), C("pct")).cast("int").alias("is_floor"))


_PERIODS = """pt AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_custkey AS INT) AS c, CAST(o_custkey % 50 AS INT) AS cik, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey % 70 AS DOUBLE) AS pct, CAST(o_orderkey % 8 AS INT) AS k, 2010 + CAST(o_orderkey % 70 AS INT) % 10 AS y FROM orders),
pe AS (SELECT *, CASE k WHEN 0 THEN make_date(y, 3, 31) WHEN 1 THEN make_date(y, 6, 30) WHEN 2 THEN make_date(y, 9, 30) WHEN 3 THEN make_date(y, 12, 31) WHEN 4 THEN make_date(y, 6, 30) WHEN 5 THEN make_date(y, 12, 31) END AS period_end,
  CASE k WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 12 WHEN 4 THEN 3 WHEN 5 THEN 12 END AS months FROM pt)"""


def period_rows(spark, sf):
    """Rows of concentration tables with the period as text: quarters, spans, years, dates off the calendar, and no period."""
    y = (2010 + (C("o_orderkey") % 70) % 10).cast("int")
    texts = (
        "First quarter of fiscal %d", "Six months ended June 28, %d", "Nine months of fiscal %d", "Fiscal year %d", "Three months ended July 3, %d", "%d", "Customer list %d", "Call on August 15, %d"
    )
    text = F.element_at(F.array(*[F.format_string(t, y) for t in texts]), (C("o_orderkey") % 8 + 1).cast("int"))
    ends = [F.make_date(y + i, F.lit(m), F.lit(d)) for i in (-1, 0, 1) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    o = V.table(spark, sf, "orders").select(
        C("o_orderkey").cast("int").alias("accn"), C("o_custkey").cast("int").alias("c"), (C("o_custkey") % 50).cast("int").alias("cik"), C("o_orderdate").cast("date").alias("filed"),
        (C("o_orderkey") % 70).cast("double").alias("pct"), text.alias("text"), F.array(*ends).alias("calendar"),
    )
    return o.withColumn("p", T.fiscal_period(C("text"), C("calendar"), F.lit(12)))


@query(
    "i14_concentration_rows",
    f"""WITH {_PERIODS} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, months, accn, c, pct, CAST(pct = 10 AND accn % 2 = 0 AS INT) AS is_floor FROM pe WHERE period_end IS NOT NULL
  QUALIFY filed = min(filed) OVER (PARTITION BY cik, period_end, months)""",
)
def i14(spark, sf):
    said = F.when(C("accn") % 2 == 0, "represented more than 10% of sales").otherwise("represented about 10% of sales")
    d = period_rows(spark, sf).where(C("p").isNotNull()).select("cik", "p.period_end", "p.months", "accn", "c", "pct", "filed", T.is_floor(said, C("pct")).cast("int").alias("is_floor"))
    d = T.first_reported(d, ["cik", "period_end", "months"], "filed")
    return d.select("cik", C("period_end").cast("string").alias("period_end"), "months", "accn", "c", "pct", "is_floor")


@query(
    "i15_clause_share",
    "SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_orderkey % 70 AS DOUBLE) AS pct FROM orders WHERE o_orderkey % 3 = 1",
)
def i15(spark, sf):
    return customers_text(spark, sf).select("accn", F.explode(T.clause_share(C("text"), "China")).alias("pct"))


@query("h05_period_text", f"WITH {_PERIODS} SELECT accn, CAST(period_end AS VARCHAR) AS period_end, months FROM pe")
def h05(spark, sf):
    return period_rows(spark, sf).select("accn", C("p.period_end").cast("string").alias("period_end"), C("p.months").alias("months"))


def shares_text(spark, sf):
    o = V.table(spark, sf, "orders").select(C("o_orderkey").cast("int").alias("accn"), (C("o_orderkey") % 60 + 1).cast("int").alias("p"), (F.floor(C("o_totalprice") / 100) + 1).cast("int").alias("v"))
    text = F.format_string(
        "5-nanometer accounted for %d%% of revenue, while 7-nanometer and below accounted for %d%%. Net revenue for May 2024 was approximately NT$%d.25 billion. We expect revenue to be between US$%d million and US$%d million, and capital expenditure between US$%d million and US$%d million.",
        C("p"), C("p") + 20, C("v"), C("v"), C("v") + 5, C("v"), C("v") + 1,
    )
    return o.select("accn", "p", "v", text.alias("text"))


@query("i20_sentence_amount", "SELECT CAST(o_orderkey AS INT) AS accn, (CAST(floor(o_totalprice / 100) AS INT) + 1.25) * 1000.0 AS revenue FROM orders".replace("(CAST(floor(o_totalprice / 100) AS INT) + 1.25) * 1000.0", "CAST((CAST(floor(o_totalprice / 100) AS INT) + 1.25) * 1000 AS DOUBLE)"))
def i20(spark, sf):
    return shares_text(spark, sf).select("accn", T.monthly_revenue(C("text")).alias("revenue"))


@query(
    "i21_range_guidance",
    "SELECT CAST(o_orderkey AS INT) AS accn, CAST(floor(o_totalprice / 100) + 1 AS DOUBLE) AS low, CAST(floor(o_totalprice / 100) + 6 AS DOUBLE) AS high, CAST(floor(o_totalprice / 100) + 2 AS DOUBLE) AS capex_high FROM orders",
)
def i21(spark, sf):
    lo, hi = T.range_guide(C("text"), "expect revenue")
    _, cap = T.range_guide(C("text"), "capital expenditure")
    return shares_text(spark, sf).select("accn", lo.alias("low"), hi.alias("high"), cap.alias("capex_high"))


@query(
    "a12_html_to_lines",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(?i)</?(p|div|li|h[1-6]|title|br|article|section|table|ul|ol)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
SELECT page_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)""",
)
def a12(spark, sf):
    return H.to_lines(V.table(spark, sf, "pages"), "page_id", "html")


@query(
    "a08_row_label_scan",
    """SELECT CAST(o_orderkey AS INT) AS accn, 'c1' AS context, round(CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) / 1e3, 3) AS value, 'Net sales & other' AS label FROM orders
UNION ALL SELECT CAST(o_orderkey AS INT), 'c2', -round(CAST(o_orderkey % 100 + 1 AS DOUBLE), 3), 'Operating loss' FROM orders UNION ALL SELECT CAST(o_orderkey AS INT), 'c3', round(CAST(o_orderkey % 7 AS DOUBLE) / 1e6, 3), 'Operating loss' FROM orders""",
)
def a08(spark, sf):
    o = dealt(V.table(spark, sf, "orders"), "o_orderkey")
    body = F.format_string(
        "<html><table><tr><th>x</th></tr><tr class='a'><td>$</td><td><b>Net sales&nbsp;&amp; other</b></td><td>9.5</td><td>$<ix:nonFraction name=\"us-gaap:Revenues\" contextRef=\"c1\" scale=\"3\">%s</ix:nonFraction></td></tr>"
        "<tr><td> Operating\nloss </td><td>(<ix:nonFraction scale=\"6\" sign=\"-\" contextRef=\"c2\" name=\"x:OperatingIncomeLoss\">%d</ix:nonFraction>)</td>"
        "<td><ix:nonFraction contextRef=\"c3\" name=\"x:OperatingIncomeLoss\">%d</ix:nonFraction></td><td><ix:nonFraction contextRef=\"c4\" name=\"x:Assets\">1</ix:nonFraction></td></tr>"
        "<tr><td>12</td><td><ix:nonFraction contextRef=\"c5\" name=\"x:Revenues\">7</ix:nonFraction></td></tr></table></html>",
        F.format_number(F.floor("o_totalprice"), 0), C("o_orderkey") % 100 + 1, C("o_orderkey") % 7,
    )
    docs = o.select(C("o_orderkey").cast("int").alias("accn"), body.alias("html"))
    return H.fact_row_labels(docs, "accn", "html", ["Revenues", "OperatingIncomeLoss"]).select("accn", "context", "value", "label")


# ---------------------------------------------------------------- dates
_D = "(SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def days(spark, sf):
    return V.table(spark, sf, "lineitem").select(C("l_shipdate").cast("date").alias("d")).distinct()


_ME = "CASE WHEN last_day(d) - d <= d - last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) THEN last_day(d) ELSE last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) END"


@query(
    "h01_fiscal_quarter",
    f"WITH m AS (SELECT d, {_ME} AS me FROM {_D}) SELECT CAST(d AS VARCHAR) AS d, CAST(CASE WHEN month(me) <= 9 THEN year(me) ELSE year(me) + 1 END AS INT) AS fy, CAST((month(me) - 9 - 1 + 12) % 12 // 3 + 1 AS INT) AS fq FROM m",
)
def h01(spark, sf):
    return days(spark, sf).select(C("d").cast("string").alias("d"), D.fiscal_year(C("d"), 9).alias("fy"), D.fiscal_quarter(C("d"), 9).alias("fq"))


@query("h02_snap_calendar_quarter", f"WITH m AS (SELECT d, {_ME} AS me FROM {_D}) SELECT CAST(d AS VARCHAR) AS d, CAST(year(me) * 4 + quarter(me) - 1 AS INT) AS qn FROM m")
def h02(spark, sf):
    return days(spark, sf).select(C("d").cast("string").alias("d"), D.snapped_quarter(C("d")).alias("qn"))


@query(
    "h03_nearest_quarter_end",
    f"WITH q AS (SELECT d, CAST(date_trunc('quarter', d) AS DATE) - 1 AS b, last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS a FROM {_D}) SELECT CAST(d AS VARCHAR) AS d, CAST(CAST(CASE WHEN d - b <= CAST(a AS DATE) - d THEN b ELSE a END AS DATE) AS VARCHAR) AS qe FROM q",
)
def h03(spark, sf):
    return days(spark, sf).select(C("d").cast("string").alias("d"), D.nearest_quarter_end(C("d")).cast("string").alias("qe"))


@query(
    "h04_reported_quarter",
    f"SELECT CAST(d AS VARCHAR) AS d, CAST(CAST(date_trunc('quarter', d - 5) AS DATE) - 1 AS VARCHAR) AS qe FROM {_D}",
)
def h04(spark, sf):
    return days(spark, sf).select(C("d").cast("string").alias("d"), D.reported_quarter_end(C("d")).cast("string").alias("qe"))


@query(
    "h06_label_quarter",
    f"SELECT CAST(d AS VARCHAR) AS d, CASE WHEN year(d) >= 2000 THEN CAST(CAST(last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS VARCHAR) END AS qe FROM {_D}",
)
def h06(spark, sf):
    label = F.when(F.year("d") >= 2000, F.format_string("%dQ%02dAmounta", F.quarter("d"), F.year("d") % 100)).otherwise("n/a")
    return days(spark, sf).select(C("d").cast("string").alias("d"), T.label_quarter_end(label).cast("string").alias("qe"))


@query("h16_quarter_label", f"WITH m AS (SELECT d, {_ME} AS me FROM {_D}) SELECT CAST(d AS VARCHAR) AS d, 'Q' || CAST((month(me) - 1) // 3 + 1 AS VARCHAR) || ' FY' || CAST(year(me) AS VARCHAR) AS label FROM m")
def h16(spark, sf):
    return days(spark, sf).select(C("d").cast("string").alias("d"), D.fiscal_label(C("d")).alias("label"))


@query("h14_log_return_ratio_clip", "SELECT CAST(c_custkey AS INT) AS id, round(ln(greatest(c_acctbal, 1)), 6) AS l, round(least(greatest(c_acctbal, -2), 500), 2) AS c FROM customer")
def h14(spark, sf):
    b = C("c_acctbal")
    return V.table(spark, sf, "customer").select(
        C("c_custkey").cast("int").alias("id"), F.round(F.log(F.greatest(b, F.lit(1.0))), 6).alias("l"), F.round(F.least(F.greatest(b, F.lit(-2.0)), F.lit(500.0)), 2).alias("c")
    )


def results(spark, sf):
    """Results text of each order: headline rows, a platform table and an outlook section."""
    o = V.table(spark, sf, "orders").select(C("o_orderkey").cast("int").alias("accn"), (F.floor(C("o_totalprice") / 100) + 1000).cast("int").alias("v"))
    v = C("v")
    text = F.concat_ws(
        "\n",
        F.format_string("Total revenue ($ in millions) | %d | 17", v),
        F.format_string("Gross margin | %.1f%% | 50%%", F.lit(55.5)),
        F.format_string("Gross margin | %d%%", v % 50 + 10),
        F.lit("Revenue by platform"),
        F.lit("| Q2 FY27 | Q1 FY27"),
        F.format_string("Data Center (1) | %d | %d", v, v - 3),
        F.format_string("Gaming | %d | %d", v % 91 + 1, v % 17 + 1),
        F.lit("Total | 1 | 1"),
        F.lit("Outlook"),
        F.format_string("Revenue is expected to be $%d.5 million, plus or minus two percent.", v),
        F.format_string("GAAP and non-GAAP gross margins are expected to be 71.0%% and %d.5%%, respectively, plus or minus 50 basis points.", v % 20 + 60),
        F.format_string("GAAP and non-GAAP operating expenses are expected to be approximately $%d million and $%d million, respectively.", v * 2, v),
    )
    return o.select("accn", text.alias("text")).withColumn("lines", G.text_lines(C("text")))


_RV = "r AS (SELECT CAST(o_orderkey AS INT) AS accn, CAST(floor(o_totalprice / 100) AS INT) + 1000 AS v FROM orders)"


@query(
    "i09_headline_figures",
    f"WITH {_RV} SELECT accn, CAST(v AS DOUBLE) AS revenue, CAST(55.5 AS DOUBLE) AS gross_margin_gaap, CAST(v % 50 + 10 AS DOUBLE) AS gross_margin_nongaap FROM r",
)
def i09(spark, sf):
    f = T.headline_figures(C("lines"))
    return results(spark, sf).select("accn", *[f[c].alias(c) for c in f])


@query(
    "i10_platform_table",
    f"""WITH {_RV} SELECT accn, 'Data Center' AS label, 0 AS "column", CAST(v AS DOUBLE) AS value, 'Q2 FY27' AS period FROM r UNION ALL SELECT accn, 'Data Center', 1, CAST(v - 3 AS DOUBLE), 'Q1 FY27' FROM r
UNION ALL SELECT accn, 'Gaming', 0, CAST(v % 91 + 1 AS DOUBLE), 'Q2 FY27' FROM r UNION ALL SELECT accn, 'Gaming', 1, CAST(v % 17 + 1 AS DOUBLE), 'Q1 FY27' FROM r""",
)
def i10(spark, sf):
    return T.platform_table(results(spark, sf), "accn", "lines", "(?i)revenue by platform")


@query(
    "i11_outlook_sentences",
    f"WITH {_RV} SELECT accn, v + CAST(0.5 AS DOUBLE) AS revenue_mid, CAST(2 AS DOUBLE) AS revenue_pm_pct, CAST(71 AS DOUBLE) AS gm_gaap, v % 20 + CAST(60.5 AS DOUBLE) AS gm_nongaap, CAST(50 AS DOUBLE) AS gm_pm_bps, CAST(v * 2 AS DOUBLE) AS opex_gaap, CAST(v AS DOUBLE) AS opex_nongaap FROM r",
)
def i11(spark, sf):
    f = T.outlook_fields(C("section"), C("lines"))
    return results(spark, sf).withColumn("section", T.outlook_section(C("lines"))).select("accn", *[f[c].alias(c) for c in f])
