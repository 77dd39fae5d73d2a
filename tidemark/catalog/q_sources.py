"""Source queries: documents are composed from the tables in each landed format and read back by the sources."""

from pyspark.sql import Window, functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions.dates import quarter_end, quarter_ordinal
from tidemark.operators import vintage as N, windows as W
from tidemark.plans.statements import statement_grid
from tidemark.session import dealt
from tidemark.sources import facts as S

C = F.col
METRICS = {"A": ("rev", 1), "N": ("rev", 0), "R": ("rpo", 0)}


def day(c, name=None):
    return C(c).cast("string").alias(name or c)


def frame_docs(spark, sf):
    """Frame documents per tag and period, in parts of at most 16 filers."""
    s = V.fq_seg(spark, sf)
    obs = F.struct(
        "cik", F.concat(F.lit("F"), C("cik").cast("string")).alias("entityName"),
        F.date_add(quarter_end(C("qn") - 1), 1).alias("start"), quarter_end(C("qn")).alias("end"), C("rev").alias("val"), F.lit("x").alias("accn"),
    )
    ccp = F.format_string("CY%dQ%d", F.floor(C("qn") / 4), C("qn") % 4 + 1)
    g = s.groupBy(C("segment").alias("tag"), ccp.alias("ccp"), F.floor(C("cik") / 16).alias("part")).agg(F.collect_list(obs).alias("data"))
    return g.select(F.to_json(F.struct("tag", "ccp", "data")).alias("body"))


@query(
    "a01_frames_scan",
    "SELECT cik, CAST(qn // 4 AS INT) AS cy, CAST(qn % 4 + 1 AS INT) AS cq, segment AS tag, CASE WHEN segment = 'R' THEN 'rpo' ELSE 'rev' END AS metric, CAST(segment = 'A' AS INT) AS prio, rev AS val FROM fq_seg",
)
def a01(spark, sf):
    return S.frames_scan(frame_docs(spark, sf), "body", METRICS).select("cik", "cy", "cq", "tag", "metric", "prio", "val")


@query(
    "a02_frames_fetch_log",
    "SELECT CASE WHEN segment = 'R' THEN 'rpo' ELSE 'rev' END AS metric, 'ok' AS status, count(DISTINCT segment || qn || '-' || cik // 16) AS requests, count(*) AS rows FROM fq_seg GROUP BY 1",
)
def a02(spark, sf):
    return S.fetch_log(frame_docs(spark, sf), "body", METRICS)


def fact_docs(spark, sf):
    """One company-facts document per filer: revenue in two currencies, a balance, shares; odd filers use the other taxonomy."""
    d = V.fq_rev(spark, sf)
    end = quarter_end(C("qn"))

    def obs(start, val, form="10-Q", late=30):
        return F.struct(
            start.alias("start"), end.alias("end"), val.cast("double").alias("val"), F.concat(F.lit("a"), C("qn").cast("string")).alias("accn"),
            F.lit(form).alias("form"), F.date_add(end, late).alias("filed"),
        )

    q0 = F.date_add(quarter_end(C("qn") - 1), 1)
    none = F.lit(None).cast("date")
    g = d.groupBy("cik").agg(  # a filer's quarters
        F.collect_list(obs(q0, C("rev") * 1000)).alias("usd"),
        F.collect_list(obs(q0, C("rev") * 900, "8-K")).alias("other"),
        F.collect_list(obs(none, C("rev") * 2000)).alias("bal"),
        F.collect_list(obs(none, C("rev") * 2100, late=90)).alias("bal2"),
    )
    unit = lambda *kv: F.struct(F.create_map(*kv).alias("units"))
    concepts = F.create_map(
        F.lit("Revenues"), unit(F.lit("USD"), C("usd"), F.lit("EUR"), C("other")),
        F.lit("Backlog"), unit(F.lit("USD"), F.concat("bal", "bal2")),
    )
    tax = F.when(C("cik") % 2 == 0, "us-gaap").otherwise("ifrs-full")
    return g.select(F.to_json(F.struct("cik", F.concat(F.lit("F"), C("cik").cast("string")).alias("entityName"), F.create_map(tax, concepts).alias("facts"))).alias("body"))


@query(
    "a03_companyfacts_scan",
    "SELECT cik, qn, CASE WHEN cik % 2 = 0 THEN 0 ELSE 1 END AS priority, 3 AS duration_months, round(rev * 1000 / 1e6, 8) AS value FROM fq_rev",
)
def a03(spark, sf):
    c = spark.createDataFrame(
        [("us-gaap", "Revenues", "revenue", 0), ("ifrs-full", "Revenues", "revenue", 1)], "taxonomy string, concept string, canonical string, priority int"
    )
    v = S.fact_vintages(S.company_facts(fact_docs(spark, sf), "body"), c)
    qn = F.year("period_end") * 4 + F.quarter("period_end") - 1
    return v.select("cik", qn.alias("qn"), "priority", "duration_months", F.round("value", 8).alias("value"))


def balance_docs(spark, sf):
    """Backlog facts of each filer: instants in its main currency (filed twice), some in another, and a duration."""
    d = V.fq_rev(spark, sf)
    end = quarter_end(C("qn"))

    def obs(start, val, late=30):
        return F.struct(start.alias("start"), end.alias("end"), val.cast("double").alias("val"), F.lit("a").alias("accn"), F.lit("10-Q").alias("form"), F.date_add(end, late).alias("filed"))

    none, q0 = F.lit(None).cast("date"), F.date_add(quarter_end(C("qn") - 1), 1)
    g = d.groupBy("cik").agg(  # a filer's quarters
        F.collect_list(obs(none, C("rev") * 2000)).alias("main"),
        F.collect_list(obs(none, C("rev") * 2100, 90)).alias("again"),
        F.collect_list(F.when(C("qn") % 2 == 0, obs(none, C("rev") * 7, 5))).alias("minor"),
        F.collect_list(obs(q0, C("rev") * 3, 1)).alias("span"),
    )
    usd, eur, gbp = F.lit("USD"), F.lit("EUR/x"), F.lit("GBP")
    both = lambda main, minor: F.create_map(main, F.concat("main", "again", "span"), minor, C("minor"), gbp, F.concat("main", "main", "main"))
    units = F.when(C("cik") % 3 == 0, both(eur, usd)).otherwise(both(usd, eur))
    concepts = F.create_map(F.lit("Backlog"), F.struct(units.alias("units")))
    return g.select(F.to_json(F.struct("cik", F.lit("x").alias("entityName"), F.create_map(F.lit("us-gaap"), concepts).alias("facts"))).alias("body"))


@query(
    "a04_balance_facts_scan",
    "SELECT cik, qn, 'backlog' AS metric, CASE WHEN cik % 3 = 0 THEN 'EUR/x' ELSE 'USD' END AS unit, rev * 2000 AS value FROM fq_rev",
)
def a04(spark, sf):
    b = S.balance_facts(S.company_facts(balance_docs(spark, sf), "body"), {"Backlog": "backlog"})
    return b.select("cik", (F.year("period_end") * 4 + F.quarter("period_end") - 1).alias("qn"), "metric", "unit", "value")


def instance_docs(spark, sf):
    """One instance document per filer and quarter: segment facts (one with the operating qualifier), a two-axis fact, a
    customer fact, reconciling rows under any name, and facts that must not count: eliminations beside a segment,
    subtotals, an unlisted axis, an instant, the undivided total."""
    g = V.fq_seg(spark, sf).groupBy("cik", "qn").agg(F.collect_list(F.struct("segment", "rev")).alias("parts"))  # three segments
    s = dealt(g, "cik", "qn")  # before the bodies are written, which cost far more than their rows
    end = quarter_end(C("qn")).cast("string")
    start = F.date_add(quarter_end(C("qn") - 1), 1).cast("string")
    span = F.concat(F.lit("<xbrli:period><xbrli:startDate>"), start, F.lit("</xbrli:startDate><xbrli:endDate>"), end, F.lit("</xbrli:endDate></xbrli:period>"))
    instant = F.concat(F.lit("<xbrli:period><xbrli:instant>"), end, F.lit("</xbrli:instant></xbrli:period>"))

    def member(axis, name):
        return F.concat(F.lit(f'<xbrldi:explicitMember dimension="us-gaap:{axis}">co:'), name, F.lit("Member</xbrldi:explicitMember>"))

    def written(x):
        seg = member("StatementBusinessSegmentsAxis", F.concat(F.lit("DataCenter"), F.element_at(F.create_map(*[F.lit(x) for x in ("A", "East", "N", "North", "R", "West")]), x["segment"])))
        two = F.concat(seg, member("ProductOrServiceAxis", F.lit("Chips")))
        whole = lambda name: member("ConsolidationItemsAxis", F.lit(name))

        def part(tag, dims, factor, period=span):
            ctx = F.concat(F.lit("c"), F.lit(tag), x["segment"])
            return F.concat(
                F.lit('<xbrli:context id="'), ctx, F.lit('"><xbrli:entity><xbrli:segment>'), dims, F.lit("</xbrli:segment></xbrli:entity>"), period,
                F.lit('</xbrli:context><us-gaap:Revenues contextRef="'), ctx, F.lit('">'), F.format_string("%.4f", x["rev"] * factor), F.lit("</us-gaap:Revenues>"),
            )

        once = F.concat(
            part("r", whole("HeadOfficeThings"), 10), part("x", whole("ReportableSegmentsSubtotal"), 11), part("u", member("OddAxis", F.lit("Z")), 12), part("n", F.lit(""), 14),
        )
        return F.concat(
            part("s", F.concat(seg, whole("OperatingSegments")), 1000), part("d", seg, 1000), part("t", two, 500), part("e", F.concat(seg, whole("IntersegmentElimination")), 9),
            part("i", seg, 13, instant), part("k", member("MajorCustomersAxis", F.lit("BigBuyer")), 20), F.when(x["segment"] == "A", once).otherwise(""),
        )

    b = F.concat_ws("", F.transform("parts", written))
    return s.select(F.concat_ws("-", "cik", "qn").alias("doc"), F.concat(F.lit('<xbrl xmlns:xbrli="x" xmlns:xbrldi="d" xmlns:us-gaap="g">'), b, F.lit("</xbrl>")).alias("body"))


_SEG = "'Data Center ' || CASE segment WHEN 'A' THEN 'East' WHEN 'N' THEN 'North' ELSE 'West' END"
_INST = f"""SELECT cik || '-' || qn AS doc, 'segment' AS axis, {_SEG} AS members, 3 AS duration_months, round(rev * 1000 / 1e6, 10) AS value FROM fq_seg
UNION SELECT cik || '-' || qn, 'product_or_service+segment', 'Chips+' || {_SEG}, 3, round(rev * 500 / 1e6, 10) FROM fq_seg
UNION SELECT cik || '-' || qn, 'customer', 'Big Buyer', 3, round(rev * 20 / 1e6, 10) FROM fq_seg
UNION SELECT cik || '-' || qn, 'segment', 'All Other', 3, round(rev * 10 / 1e6, 10) FROM fq_seg WHERE segment = 'A'"""


def dims(spark, sf):
    return S.dimensional_facts(instance_docs(spark, sf), "doc", "body", {"Revenues": "revenue"})


@query("a06_dim_fact_scan", _INST)
def a06(spark, sf):
    return dims(spark, sf).select("doc", "axis", "members", "duration_months", F.round("value", 10).alias("value"))


@query("c29_context_join", f"SELECT axis, count(*) AS facts FROM ({_INST}) GROUP BY 1")
def c29(spark, sf):
    return dims(spark, sf).groupBy("axis").agg(F.count(F.lit(1)).alias("facts"))


@query(
    "a07_label_scan",
    """SELECT 'd' || p_partkey AS doc, 'M' || p_partkey AS member, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Total ' || p_name WHEN 2 THEN p_brand ELSE p_type END AS label FROM part""",
)
def a07(spark, sf):
    k, kind = C("p_partkey").cast("string"), C("p_partkey") % 4

    def label(role, text):
        return F.concat(F.lit(f'<label label="t" role="x/{role}">'), text, F.lit("</label>"))

    terse = F.when(kind == 0, label("terseLabel", F.concat(C("p_name"), F.lit(" [Member]")))).when(kind == 1, label("terseLabel", F.concat(F.lit("Total "), C("p_name"), F.lit(" [Domain]"))))
    terse = terse.otherwise(label("terseLabel", F.lit("Reportable Segments [Member]")))
    verbose = F.when(kind == 2, label("verboseLabel", C("p_brand"))).when(kind == 3, label("verboseLabel", F.lit("Total net sales"))).otherwise(label("documentation", F.lit("text")))
    body = F.concat(
        F.lit('<linkbase><loc label="l" href="f.xsd#M'), k, F.lit('"/><labelArc from="l" to="t"/>'), terse, label("label", F.concat(C("p_type"), F.lit(" [Member]"))), verbose, F.lit("</linkbase>"),
    )
    docs = dealt(V.table(spark, sf, "part"), "p_partkey").select(F.concat(F.lit("d"), k).alias("doc"), body.alias("body"))
    return S.member_labels(docs, "doc", "body")


@query(
    "a09_filing_index_scan",
    "SELECT cik, 'a' || accn AS accession, form, CAST(filed AS VARCHAR) AS filed FROM releases",
)
def a09(spark, sf):
    r = V.releases(spark, sf)
    part = F.floor(C("accn") / 1000)
    cols = {"accessionNumber": F.concat(F.lit("a"), C("accn").cast("string")), "filingDate": C("filed").cast("string"), "form": C("form"), "primaryDocument": F.lit("p.htm"), "items": F.lit("2.02")}
    rows = r.groupBy("cik", part.alias("part")).agg(F.collect_list(F.struct(*[v.alias(n) for n, v in cols.items()])).alias("z"))
    recent = F.struct(*[C(f"z.{n}").alias(n) for n in cols])
    docs = rows.select(F.to_json(F.struct("cik", recent.alias("recent"))).alias("body"))
    return S.filing_index(docs, "body").select("cik", C("accessionNumber").alias("accession"), "form", day("filingDate", "filed"))


@query(
    "a11_holdings_xml_scan",
    """SELECT 'n' || c_nationkey || '-' || c_custkey // 64 AS doc, '2024-06-30' AS report_date, 'Fund ' || c_nationkey AS series, 1000.5 + c_nationkey AS net_assets, c_name AS name, c_acctbal AS usd,
  'US' || c_custkey AS isin, CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey END AS ticker, 'NS' AS units, 'CORP' AS issuer, c_mktsegment AS country FROM customer""",
)
def a11(spark, sf):
    k = C("c_custkey").cast("string")
    ids = F.concat(F.lit('<identifiers><isin value="US'), k, F.lit('"/>'), F.when(C("c_custkey") % 2 == 0, F.concat(F.lit('<ticker value="T'), k, F.lit('"/>'))).otherwise(""), F.lit("</identifiers>"))
    row = F.concat(
        F.lit("<invstOrSec><name>"), "c_name", F.lit("</name><title>t</title><cusip>1</cusip>"), ids, F.lit("<balance>2.0</balance><units>NS</units><valUSD>"), C("c_acctbal").cast("string"),
        F.lit("</valUSD><pctVal>1.0</pctVal><assetCat>EC</assetCat><issuerCat>CORP</issuerCat><invCountry>"), "c_mktsegment", F.lit("</invCountry></invstOrSec>"),
    )
    c = V.table(spark, sf, "customer").select("c_nationkey", F.concat_ws("", F.lit("n"), "c_nationkey", F.lit("-"), F.floor(C("c_custkey") / 64)).alias("doc"), row.alias("row"))
    head = F.concat(
        F.lit("<edgar><genInfo><seriesName>Fund "), C("c_nationkey").cast("string"), F.lit("</seriesName><repPdDate>2024-06-30</repPdDate></genInfo><fundInfo><netAssets>"),
        (C("c_nationkey") + 1000.5).cast("string"), F.lit("</netAssets></fundInfo><invstOrSecs>"),
    )
    docs = c.groupBy("doc", "c_nationkey").agg(F.concat_ws("", F.collect_list("row")).alias("rows"))  # 64 positions at most
    h = S.fund_holdings(docs.select("doc", F.concat(head, "rows", F.lit("</invstOrSecs></edgar>")).alias("body")), "doc", "body")
    return h.select(
        "doc", day("report_date"), "series", "net_assets", "name", C("valUSD").alias("usd"), "isin", "ticker", "units", C("issuerCat").alias("issuer"), C("invCountry").alias("country")
    )


@query(
    "a13_checkpoint_scan",
    "SELECT CAST(event_id % 700 AS VARCHAR) AS accn, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value, arg_max(user_id, event_id) AS user_id, max(event_id) AS line FROM events WHERE event_id % 11 <> 0 GROUP BY 1",
)
def a13(spark, sf):
    e = V.table(spark, sf, "events")
    good = F.to_json(F.struct((C("event_id") % 700).cast("string").alias("accn"), C("event_type").alias("status"), "value", "user_id", C("event_id").alias("line")))
    lines = e.select("event_id", F.when(C("event_id") % 11 == 0, F.lit("{broken")).otherwise(good).alias("line"))
    return S.last_log_records(lines, "line", "event_id", "struct<accn:string,status:string,value:double,user_id:bigint,line:bigint>")


@query("a14_price_scan", "SELECT CAST(d AS VARCHAR) AS d, 'T' || ticker AS ticker, px FROM px WHERE d <= (SELECT min(m) FROM (SELECT max(d) AS m FROM px GROUP BY ticker))")
def a14(spark, sf):
    p = V.px(spark, sf)
    ends = p.groupBy("ticker").agg(F.max("d").alias("m")).agg(F.min("m"))
    wide = p.groupBy(C("d").alias("date")).pivot("ticker").agg(F.max("px"))
    wide = wide.toDF("date", *[f"T{c}" for c in wide.columns[1:]])
    return S.wide_prices(wide.withColumn("_end", ends.scalar()).where("date <= _end").drop("_end")).select(day("date", "d"), "ticker", "px")


@query(
    "a15_membership_scan",
    """WITH m AS (SELECT qn, list(DISTINCT 'T' || chr(CAST(65 + cik % 26 AS INT)) || chr(CAST(65 + cik // 26 % 26 AS INT))) AS l FROM fq_rev WHERE (qn % 3 <> 1 OR cik % 50 = 0) GROUP BY 1),
c AS (SELECT qn, last_value(CASE WHEN len(l) >= 90 THEN len(l) END IGNORE NULLS) OVER (ORDER BY qn) AS n FROM m) SELECT qn, CAST(n AS INT) AS members FROM c""",
)
def a15(spark, sf):
    sym = F.concat(F.lit("T"), F.char(65 + C("cik") % 26), F.char(65 + F.floor(C("cik") / 26) % 26))
    name = F.concat(F.lit("Name "), C("cik").cast("string"))
    row = F.when(C("cik") % 3 == 0, F.concat(F.lit("| "), name, F.lit(" || {{NASDAQ|"), sym, F.lit("}} || text")))
    row = row.when(C("cik") % 3 == 1, F.concat(F.lit("* [["), name, F.lit("]] (["), F.lit("["), sym, F.lit("]])"))).otherwise(F.concat(F.lit("| "), sym, F.lit(" || "), name))
    d = V.fq_rev(spark, sf).where((C("qn") % 3 != 1) | (C("cik") % 50 == 0))
    pages = d.select("qn", row.alias("row")).distinct().groupBy("qn").agg(F.concat_ws("\n", F.collect_list("row")).alias("rows"))  # one page per quarter
    pages = pages.select("qn", F.concat(F.lit("Intro {{NASDAQ|ZZZ}}\n* Old (ZZY)\n== Components ==\n{| class\n|-\n"), "rows", F.lit("\n|}\n== See also ==\n* Else (ZZX)\n| ZZW || x")).alias("text"))
    got = S.carried_members(pages.withColumn("index", F.lit("n100")), ["index"], "qn", "text", 90)
    return got.select("qn", F.when(C("members").isNotNull(), F.size("members")).alias("members"))


_KINDS = ("", " American Depositary Receipts", " 7% Debentures due 2031", " American Depositary Shares", " Warrant", " Units", " Subordinated", " Ordinary Shares", " Rights")


@query(
    "a16_listing_scan",
    f"""WITH l AS (SELECT p_partkey, p_size, p_name || (['{"', '".join(_KINDS)}'])[CAST(p_partkey % 9 + 1 AS INT)] AS name FROM part WHERE p_partkey % 13 <> 0)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'etf' WHEN regexp_matches(name, '(?i)warrant|unit|right|preferred|depositary shares|notes|debenture|subordinated') THEN 'other' ELSE 'common' END AS kind FROM l) GROUP BY 1""",
)
def a16(spark, sf):
    name = F.concat(C("p_name"), F.get(F.array(*[F.lit(x) for x in _KINDS]), (C("p_partkey") % 9).cast("int")))
    p = V.table(spark, sf, "part").select(
        C("p_partkey").alias("s"), name.alias("n"), F.when(C("p_size") % 4 == 0, "Y").otherwise("N").alias("e"), F.when(C("p_partkey") % 13 == 0, "Y").otherwise("N").alias("t")
    )
    return S.listing_kinds(p, "s", "n", "e", "t").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a17_share_count_scan",
    "SELECT CAST(l_suppkey AS INT) AS cik, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, l_quantity - 5 AS shares, CAST(l_linenumber AS INT) AS prio FROM lineitem WHERE l_quantity > 5 QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_linenumber, l_orderkey, l_quantity) = 1",
)
def a17(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        C("l_suppkey").cast("int").alias("cik"), C("l_shipdate").cast("date").alias("end"), (C("l_quantity") - 5).alias("val"),
        C("l_linenumber").cast("int").alias("prio"), F.struct("l_orderkey", "l_quantity").alias("accn"),
    )
    return S.share_counts(li).select("cik", day("end", "d"), "shares", "prio")


@query(
    "a18_dead_listing_profile",
    "WITH x AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1) SELECT count(*) AS listed, count(*) FILTER (WHERE b < DATE '2001-06-01') AS ended, count(*) FILTER (WHERE a < DATE '1995-06-01') AS started FROM x",
)
def a18(spark, sf):
    x = V.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    return S.listed_profile(x, "a", "b", "1995-06-01", "2001-06-01")


@query("a21_event_calendar_scan", "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def a21(spark, sf):
    e = V.table(spark, sf, "events").where(C("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return e.select("event_id", "event_type", "value")


@query("a26_gold_table_scan", "SELECT CAST(l_orderkey AS INT) AS accn, coalesce(nullif(l_tax, 0), l_discount) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def a26(spark, sf):
    li = V.table(spark, sf, "lineitem").where((C("l_returnflag") == "R") & (C("l_quantity") > 45))
    return li.select(C("l_orderkey").cast("int").alias("accn"), F.coalesce(F.nullif("l_tax", F.lit(0.0)), "l_discount").alias("value"))


@query(
    "a25_ticker_dimension",
    "SELECT r.cik, r.qn, s_name AS name, CAST(((r.qn % 4 + 1) * 3 - (3 * (1 + r.cik % 4)) - 1 + 12) % 12 // 3 + 1 AS INT) AS fq FROM fq_gap r JOIN supplier ON s_suppkey = r.cik",
)
def a25(spark, sf):
    from tidemark.functions.dates import fiscal_quarter

    dim = V.table(spark, sf, "supplier").select(C("s_suppkey").cast("int").alias("cik"), C("s_name").alias("name"), (3 * (1 + C("s_suppkey") % 4)).cast("int").alias("fye"))
    d = V.fq_gap(spark, sf).join(dim, "cik")
    return d.select("cik", "qn", "name", fiscal_quarter(quarter_end(C("qn")), C("fye")).alias("fq"))


# ---------------------------------------------------------------- share counts and caps
@query(
    "e35_daily_market_cap",
    """WITH sc AS (SELECT CAST(n_regionkey AS INT) AS ticker, last_day(make_date(CAST(qn // 4 AS INT), CAST(qn % 4 * 3 + 3 AS INT), 1)) + INTERVAL 60 DAY AS avail, sum(rev) AS shares FROM fq_gap JOIN supplier ON s_suppkey = cik JOIN nation ON s_nationkey = n_nationkey WHERE qn % 3 <> 0 GROUP BY 1, 2),
s2 AS (SELECT ticker, CAST(avail AS DATE) AS avail, round(shares, 4) AS shares FROM sc)
SELECT p.ticker, CAST(p.d AS VARCHAR) AS d, round(CASE WHEN p.d - s.avail <= 200 THEN px * shares / (1 + p.ticker) / 1e9 END, 6) AS cap FROM px p ASOF LEFT JOIN s2 s ON p.ticker = s.ticker AND p.d >= s.avail""",
)
def e35(spark, sf):
    r = V.fq_gap(spark, sf).where(C("qn") % 3 != 0)
    s, n = V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    sc = r.join(s, C("s_suppkey") == C("cik")).join(n, C("s_nationkey") == C("n_nationkey"))
    sc = sc.groupBy(C("n_regionkey").cast("int").alias("ticker"), "qn").agg(F.round(F.sum("rev"), 4).alias("shares"))
    sc = sc.withColumn("end", quarter_end(C("qn")))
    return daily_caps(V.px(spark, sf), sc, 60, 200, 1 + C("ticker")).select("ticker", day("d"), F.round("cap", 6).alias("cap"))


def daily_caps(px, shares, lag_days, max_age, ratio):
    """Price times the latest share count that was public, if not too old, over the receipt ratio, in billions."""
    from tidemark.operators import asof

    avail = shares.select("ticker", F.date_add("end", lag_days).alias("avail"), "shares")
    d = asof.backward(px, avail, ["ticker"], "d", "avail", ["shares"])
    fresh = F.datediff("d", "matched_avail") <= max_age
    return d.withColumn("cap", F.when(fresh, C("px") * C("shares") / ratio / 1e9))


@query(
    "e34_split_restatement_walk",
    """WITH b AS (SELECT cik, qn, row_number() OVER (PARTITION BY cik ORDER BY qn DESC) - 1 AS i, 1000 + cik * 10 + qn - 7980 AS truth FROM fq_rev),
s AS (SELECT cik, qn, truth, CASE WHEN qn < 7996 THEN CASE WHEN cik % 2 = 0 AND qn >= 7992 THEN truth ELSE truth / 2.0 END ELSE truth END AS shares FROM b) SELECT cik, qn, CAST(truth AS DOUBLE) AS adjusted FROM s""",
)
def e34(spark, sf):
    d = V.fq_rev(spark, sf).select("cik", "qn")
    truth = (1000 + C("cik") * 10 + C("qn") - 7980).cast("double")
    # a 2:1 split at quarter 7996: older counts are half, unless a later filing already restated them
    restated = (C("cik") % 2 == 0) & (C("qn") >= 7992)
    d = d.withColumn("shares", F.when((C("qn") < 7996) & ~restated, truth / 2).otherwise(truth))
    split = F.array(F.struct(F.lit(7996).alias("t"), F.lit(2.0).alias("ratio")))
    return adjusted_shares(d.withColumn("splits", split), ["cik"], "qn", 5).select("cik", "qn", "adjusted")


def adjusted_shares(df, keys, order, window):
    """Share counts in today's units, walking back from the newest: of the factors the later filings may already hold,
    the one that lands nearest the median of the last three.

    ``splits`` is an array of (t, ratio); ``window`` is how long after a count a split may already be in it.
    """
    def factor(e, upto):
        keep = F.filter(e["splits"], lambda s: (s["t"] > e["t"]) & upto(s))
        return F.aggregate(keep, F.lit(1.0), lambda a, s: a * s["ratio"])

    g = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(C(order).alias("t"), "shares", "splits")), asc=False).alias("_a")
    )

    def step(acc, e):
        last = F.array_sort(F.slice(acc, F.greatest(F.size(acc) - 2, F.lit(1)), 3))
        full = factor(e, lambda s: F.lit(True))
        ref = F.when(F.size(acc) == 0, e["shares"] * full).otherwise(
            F.get(last, F.floor((F.size(last) - 1) / 2).cast("int"))["v"] / 2 + F.get(last, F.floor(F.size(last) / 2).cast("int"))["v"] / 2
        )
        inside = F.filter(e["splits"], lambda s: (s["t"] > e["t"]) & (s["t"] <= e["t"] + window))
        n = F.sequence(F.lit(0), F.size(inside))
        cands = F.transform(n, lambda k: full / F.aggregate(F.slice(inside, F.lit(1), k), F.lit(1.0), lambda a, s: a * s["ratio"]))
        best = F.array_min(F.transform(cands, lambda c: F.struct(F.abs(F.log(e["shares"] * c / ref)).alias("d"), (e["shares"] * c).alias("v"))))
        return F.concat(acc, F.array(F.struct(best["v"].alias("v"), e["t"].alias("t"))))

    empty = F.array().cast("array<struct<v:double,t:int>>")
    return g.select(*keys, F.inline(F.aggregate("_a", empty, step))).select(*keys, C("t").alias(order), C("v").alias("adjusted"))


# ---------------------------------------------------------------- dimensions, statements
@query(
    "b20_sic_universe",
    "SELECT CAST(p_partkey AS INT) AS id FROM part WHERE (p_size IN (7, 11, 28) OR p_partkey IN (1, 2, 3)) AND (p_type <> 'SMALL' OR p_retailprice > 950)",
)
def b20(spark, sf):
    p = V.table(spark, sf, "part")
    keep = (C("p_size").isin(7, 11, 28) | C("p_partkey").isin(1, 2, 3)) & ((C("p_type") != "SMALL") | (C("p_retailprice") > 950))
    return p.where(keep).select(C("p_partkey").cast("int").alias("id"))


@query(
    "b21_breakdown_kind",
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_type = 'SMALL' THEN 'geography' WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 'end-use' WHEN contains(p_name, 'widget') THEN 'new/used' ELSE 'technology' END AS kind FROM part) GROUP BY 1",
)
def b21(spark, sf):
    m = C("p_name")
    kind = F.when(C("p_type") == "SMALL", "geography").when(m.contains("ring") | m.contains("bolt"), "end-use").when(m.contains("widget"), "new/used").otherwise("technology")
    return V.table(spark, sf, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b30_drop_bad_tags",
    """WITH x AS (SELECT cik, qn, rev, row_number() OVER (PARTITION BY cik ORDER BY qn) AS i FROM fq_gap WHERE cik NOT IN (SELECT CAST(s_suppkey AS INT) FROM supplier WHERE s_acctbal < 0))
SELECT cik, qn, round(CASE WHEN i <= 4 THEN rev / 2 ELSE rev END, 6) AS cap FROM x""",
)
def b30(spark, sf):
    bad = V.table(spark, sf, "supplier").where(C("s_acctbal") < 0).select(C("s_suppkey").cast("int").alias("cik"))
    d = V.fq_gap(spark, sf).join(bad, "cik", "left_anti")
    early = F.row_number().over(W.series(["cik"], "qn")) <= 4
    return d.select("cik", "qn", F.round(F.when(early, C("rev") / 2).otherwise(C("rev")), 6).alias("cap"))


@query(
    "c26_event_panel_join",
    """WITH ev AS (SELECT cik, qn, CAST(min(filed) AS VARCHAR) AS release FROM (SELECT cik, filed, year(filed)*4 + quarter(filed) - 2 AS qn FROM releases) GROUP BY 1, 2)
SELECT g.cik, g.qn, g.rev, ev.release, CAST(coalesce(b.rpo > 5000000, false) AS INT) AS usable FROM fq_gap g JOIN ev USING (cik, qn) LEFT JOIN fq_bal b USING (cik, qn)""",
)
def c26(spark, sf):
    r = V.releases(spark, sf).withColumn("qn", F.year("filed") * 4 + F.quarter("filed") - 2)
    ev = r.groupBy("cik", "qn").agg(F.min("filed").cast("string").alias("release"))
    d = V.fq_gap(spark, sf).join(ev, ["cik", "qn"]).join(V.fq_bal(spark, sf), ["cik", "qn"], "left")
    return d.select("cik", "qn", "rev", "release", F.coalesce(C("rpo") > 5000000, F.lit(False)).cast("int").alias("usable"))


@query(
    "k14_ticker_statement",
    """WITH y AS (SELECT cik, qn // 4 AS fy, max(CASE WHEN qn % 4 = 0 THEN rev END) AS q1, max(CASE WHEN qn % 4 = 1 THEN rev END) AS q2, max(CASE WHEN qn % 4 = 2 THEN rev END) AS q3, max(CASE WHEN qn % 4 = 3 THEN rev END) AS q4, round(sum(rev), 4) AS fy_rev FROM fq_gap GROUP BY 1, 2)
SELECT y.cik, CAST(y.fy AS INT) AS fy, y.q1, y.q2, y.q3, y.q4, y.fy_rev, round(y.fy_rev / p.fy_rev - 1, 6) AS growth, round(y.q4 / y.fy_rev, 6) AS q4_share FROM y LEFT JOIN y p ON p.cik = y.cik AND p.fy = y.fy - 1""",
)
def k14(spark, sf):
    d = V.fq_gap(spark, sf).withColumn("fy", F.floor(C("qn") / 4).cast("int"))
    qs = [F.max(F.when(C("qn") % 4 == i, C("rev"))).alias(f"q{i + 1}") for i in range(4)]
    y = d.groupBy("cik", "fy").agg(*qs, F.round(F.sum("rev"), 4).alias("fy_rev"))
    g = W.ratio(C("fy_rev"), W.period_offset(C("fy_rev"), ["cik"], "fy", 1)) - 1
    return y.select("cik", "fy", "q1", "q2", "q3", "q4", "fy_rev", F.round(g, 6).alias("growth"), F.round(C("q4") / C("fy_rev"), 6).alias("q4_share"))


_GRID = """p AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS INT) AS qn, CAST(l_linenumber AS INT) AS accn, CAST(max(l_shipdate) AS DATE) AS filed,
  round(sum(l_extendedprice*(1-l_discount)), 4) AS revenue, CASE WHEN l_linenumber % 3 <> 0 THEN round(sum(l_extendedprice*(1-l_discount-l_tax)), 4) END AS gross_profit, round(sum(l_quantity), 2) AS inventory FROM lineitem GROUP BY 1, 2, l_linenumber),
b AS (SELECT cik, qn, 'as_first_reported' AS basis, arg_min(revenue, (filed, accn)) AS revenue, arg_min(gross_profit, (filed, accn)) FILTER (WHERE gross_profit IS NOT NULL) AS gross_profit, arg_min(inventory, (filed, accn)) AS inventory FROM p GROUP BY 1, 2
  UNION ALL SELECT cik, qn, 'latest_filed', arg_max(revenue, (filed, accn)), arg_max(gross_profit, (filed, accn)) FILTER (WHERE gross_profit IS NOT NULL), NULL FROM p GROUP BY 1, 2),
w AS (SELECT b.*, round(round(b.revenue / q.revenue, 6) - 1, 6) AS qoq, round(round(b.revenue / y.revenue, 6) - 1, 6) AS yoy FROM b LEFT JOIN b q ON q.cik = b.cik AND q.basis = b.basis AND q.qn = b.qn - 1 LEFT JOIN b y ON y.cik = b.cik AND y.basis = b.basis AND y.qn = b.qn - 4),
l AS (SELECT cik, qn, basis, 'revenue' AS item, revenue AS v FROM w UNION ALL SELECT cik, qn, basis, 'gross_profit', gross_profit FROM w UNION ALL SELECT cik, qn, basis, 'inventory', inventory FROM w
  UNION ALL SELECT cik, qn, basis, 'gross_margin', round(gross_profit / revenue, 6) FROM w UNION ALL SELECT cik, qn, basis, 'revenue_qoq', qoq FROM w UNION ALL SELECT cik, qn, basis, 'revenue_yoy', yoy FROM w),
g AS (SELECT cik, basis, item, CAST(qn // 4 AS INT) AS fy, max(v) FILTER (WHERE qn % 4 = 0) AS q1, max(v) FILTER (WHERE qn % 4 = 1) AS q2, max(v) FILTER (WHERE qn % 4 = 2) AS q3, max(v) FILTER (WHERE qn % 4 = 3) AS q4 FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT *, CASE WHEN item IN ('revenue', 'gross_profit') THEN round(q1 + q2 + q3 + q4, 4) WHEN item = 'inventory' THEN q4 END AS y0 FROM g)"""


@query(
    "k14_statement_grid",
    f"""WITH {_GRID} SELECT s.cik, s.basis, s.item, s.fy, s.q1, s.q2, s.q3, s.q4,
  CASE s.item WHEN 'gross_margin' THEN round(gp.y0 / rv.y0, 6) WHEN 'revenue_yoy' THEN round(round(rv.y0 / pv.y0, 6) - 1, 6) ELSE s.y0 END AS year
FROM s LEFT JOIN s gp ON gp.cik = s.cik AND gp.basis = s.basis AND gp.fy = s.fy AND gp.item = 'gross_profit' LEFT JOIN s rv ON rv.cik = s.cik AND rv.basis = s.basis AND rv.fy = s.fy AND rv.item = 'revenue'
LEFT JOIN s pv ON pv.cik = s.cik AND pv.basis = s.basis AND pv.fy = s.fy - 1 AND pv.item = 'revenue'""",
)
def k14_grid(spark, sf):
    """Each line number of a filer's quarter is a filing; every third leaves gross profit out."""
    li = V.table(spark, sf, "lineitem")
    net = lambda *less: F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount") - sum(less) if less else 1 - C("l_discount"))), 4)
    p = li.groupBy(C("l_suppkey").cast("int").alias("cik"), quarter_ordinal(C("l_shipdate")).alias("qn"), C("l_linenumber").cast("int").alias("accn")).agg(
        F.max("l_shipdate").cast("date").alias("filed"), net().alias("revenue"), net(C("l_tax")).alias("gross_profit"), F.round(F.sum("l_quantity"), 2).alias("inventory")
    )
    p = p.withColumn("gross_profit", F.when(C("accn") % 3 != 0, C("gross_profit")))
    return statement_grid(
        p, ["cik"], ["revenue", "gross_profit"], ["inventory"], {"gross_margin": ("gross_profit", "revenue")},
        {"revenue_qoq": ("revenue", 1), "revenue_yoy": ("revenue", 4)}, ["filed", "accn"],
    )


@query(
    "k16_implied_market_revenue",
    "WITH t AS (SELECT cik, qn, sum(rev) AS t FROM fq_seg GROUP BY 1, 2), s AS (SELECT cik, qn, segment, round(rev / t * 100, 0) AS pct FROM fq_seg JOIN t USING (cik, qn)) SELECT s.cik, s.qn, segment, pct, round(pct / 100 * rev, 6) AS implied FROM s JOIN fq_rev r ON r.cik = s.cik AND r.qn = s.qn",
)
def k16(spark, sf):
    s = V.fq_seg(spark, sf)
    t = s.groupBy("cik", "qn").agg(F.sum("rev").alias("t"))
    s = s.join(t, ["cik", "qn"]).select("cik", "qn", "segment", F.round(C("rev") / C("t") * 100, 0).alias("pct"))
    return s.join(V.fq_rev(spark, sf), ["cik", "qn"]).select("cik", "qn", "segment", "pct", F.round(C("pct") / 100 * C("rev"), 6).alias("implied"))


@query(
    "i23_result_vs_filing_check",
    """WITH h AS (SELECT cik, qn, CASE WHEN cik % 3 = 0 THEN rev * 1000 WHEN cik % 3 = 1 THEN rev * 1.0625 ELSE rev END AS said FROM fq_rev),
x AS (SELECT h.cik, h.qn, said, rev, coalesce(abs(said / 1000 - rev) <= 0.01 * rev, false) AS thousands FROM h LEFT JOIN fq_gap g ON g.cik = h.cik AND g.qn = h.qn)
SELECT cik, qn, CAST(thousands AS INT) AS thousands, CAST(abs(CASE WHEN thousands THEN said / 1000 ELSE said END - rev) <= 0.01 * rev AS INT) AS verified FROM x""",
)
def i23(spark, sf):
    h = V.fq_rev(spark, sf)
    said = F.when(C("cik") % 3 == 0, C("rev") * 1000).when(C("cik") % 3 == 1, C("rev") * 1.0625).otherwise(C("rev"))
    d = h.select("cik", "qn", said.alias("said")).join(V.fq_gap(spark, sf), ["cik", "qn"], "left")
    d = d.withColumn("thousands", F.coalesce(F.abs(C("said") / 1000 - C("rev")) <= 0.01 * C("rev"), F.lit(False)))
    headline = F.when(C("thousands"), C("said") / 1000).otherwise(C("said"))
    ok = F.abs(headline - C("rev")) <= 0.01 * C("rev")
    return d.select("cik", "qn", C("thousands").cast("int").alias("thousands"), ok.cast("int").alias("verified"))


@query(
    "i17_priority_vintages",
    """WITH p AS (SELECT CAST(l_suppkey AS INT) AS cik, l_returnflag AS metric, CAST(l_linenumber AS INT) AS src, CAST(l_shipdate AS DATE) AS pe, l_orderkey AS filed, l_quantity AS value FROM lineitem),
b AS (SELECT * FROM p x QUALIFY min(src) OVER (PARTITION BY cik, metric, pe) = src) SELECT cik, metric, CAST(pe AS VARCHAR) AS pe, arg_min(value, (filed, value)) AS first, arg_max(value, (filed, value)) AS latest FROM b GROUP BY 1, 2, pe""",
)
def i17(spark, sf):
    p = V.table(spark, sf, "lineitem").select(
        C("l_suppkey").cast("int").alias("cik"), C("l_returnflag").alias("metric"), C("l_linenumber").cast("int").alias("src"),
        C("l_shipdate").cast("date").alias("pe"), C("l_orderkey").alias("filed"), C("l_quantity").alias("value"), F.lit(0).alias("accn"),
    )
    k = ["cik", "metric", "pe"]
    v = N.vintage_agg(N.lowest_priority(p, k, "src"), k)
    return v.select("cik", "metric", day("pe"), "first", "latest")


# ---------------------------------------------------------------- sinks
@query("a22_stage_tables", "SELECT cik, CAST(qn // 4 AS INT) AS cy, qn, rev FROM fq_rev")
def a22(spark, sf):
    """A stage's output written by year and read back: later stages prune by the folder."""
    from tidemark.streaming.jobs import work_folder

    path = work_folder(spark, "stage")
    d = V.fq_rev(spark, sf).withColumn("cy", F.floor(C("qn") / 4).cast("int"))
    d.repartition("cy").write.partitionBy("cy").parquet(path)
    return spark.read.parquet(path).select("cik", "cy", "qn", "rev")


@query(
    "a23_publish_sink",
    "SELECT cik, CAST(cik NOT IN (SELECT cik FROM fq_rev WHERE qn = 8002 AND rev > 1000000) AS INT) AS is_new FROM fq_rev WHERE qn = 8003 AND rev > 1000000",
)
def a23(spark, sf):
    """Two runs' lists published as snapshots; the second is read back marked against the first."""
    from tidemark.streaming.jobs import work_folder

    path = work_folder(spark, "screens")
    d = V.fq_rev(spark, sf).where(C("rev") > 1000000)
    old = S.publish(d.where(C("qn") == 8002).select("cik"), path, "2000-10-01", "csv")
    new = S.publish(d.where(C("qn") == 8003).select("cik"), path, "2001-01-01", "csv")
    a, b = (spark.read.schema("cik int").option("header", "true").csv(p) for p in (old, new))
    return b.join(a.withColumn("seen", F.lit(1)), "cik", "left").select("cik", C("seen").isNull().cast("int").alias("is_new"))
