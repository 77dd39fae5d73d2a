import json

from pyspark.sql import functions as F

from tidemark.functions import dates as D, text as X
from tidemark.plans import guides as G, release_text as T
from tidemark.sources import facts as S, html as H
from tidemark.streaming import jobs as J

C = F.col

GUIDES = {
    "We expect revenue for the third quarter to be between $1.2 billion and $1.4 billion.": ("dollar range", 1300.0, "quarter"),
    "Full-year revenue guidance of $440-460 million.": ("headline range", 450.0, "full_year"),
    "Guidance of $440-460 Million in Revenue": ("headline range", 450.0, "unknown"),
    "The company expects revenue of 440 to 460 million.": ("dollar range", 450.0, "unknown"),
    "Raises Full Year Revenue Guidance to $1.02 Billion": ("headline raise", 1020.0, "full_year"),
    "For the first quarter, revenue is expected to be $650 million, plus or minus $15 million.": ("dollar point", 650.0, "quarter"),
    "For the full year the company expects revenue growth of 7% to 12%.": ("growth range", 9.5, "full_year"),
    "For fiscal 2027, sales are expected to be up 8%.": ("growth point", 8.0, "full_year"),
    "Revenue was $158.3 million in the second quarter.": None,
    "The company expects $1 billion of cost savings and lower cost of sales.": None,
    "Thank you for joining the call.": None,
    None: None,
}


def test_clause_reader(spark):
    d = spark.createDataFrame([(t,) for t in GUIDES], "t string")
    for r in d.select("t", G.guide(C("t")).alias("g")).collect():
        want, g = GUIDES[r.t], r.g
        if want is None:
            assert g is None or g.basis is None, r.t
        else:
            assert (g.basis, g.revenue_mid if g.revenue_mid is not None else g.growth_mid_pct, g.period) == want, (r.t, g)


def test_every_cue_and_every_window_counts(spark):
    text = "Outlook for demand is mixed. The board expects to meet. " + "Filler words go here. " * 30 + "For the quarter the company expects net revenue of $ 450 million."
    d = spark.createDataFrame([(text,), ("The company expects to move offices.",)], "t string")
    assert [r[0] for r in d.select(G.guide_present(C("t"))).collect()] == [True, False]
    two = "We expect sales of widgets in 3 regions. A. B. C. D. E. We forecast revenue of €2 billion to €3 billion for the second half."
    w = G.with_windows(spark.createDataFrame([(two,)], "t string"), "t").select(G.best_window(C("windows")).alias("w"))
    f = G.detail_fields(C("w"))
    r = w.select(*[f[c].alias(c) for c in ("revenue_low", "revenue_high", "revenue_currency", "revenue_period")]).first()
    assert tuple(r) == (2000.0, 3000.0, "€", "h_")


def test_table_guides(spark):
    rows = {
        "Outlook\nRevenue | $8.10 Billion | +/- | $400 Million": (None, 8100.0, None, 400.0, None),
        "Guidance (in millions)\nTotal revenue | $1,200 | $1,300 million": (1200.0, None, 1300.0, None, None),
        "Outlook (in billions)\nNet revenue | 6.5 | +/- | 2%": (None, 6500.0, None, None, 2.0),
        "Results\nRevenue | $5 million | $4 million": None,
        "Outlook\nRevenue | 6,722,238 | 5,841,488 | +15.1%": None,
    }
    d = spark.createDataFrame([(t,) for t in rows], "t string")
    for r in d.select("t", G.table_guide(G.text_lines(C("t"))).alias("g")).collect():
        assert (None if r.g is None else tuple(r.g)[:5]) == rows[r.t], (r.t, r.g)


def test_html_table_rows_stay_on_one_line():
    body = "<html><body><p>Intro <b>text</b></p><table><tr><th>Item</th><th>2024</th></tr><tr><td>Net sales</td><td>$</td><td>1,234</td></tr><tr><td>Loss</td><td>(5.5)</td></tr></table><script>x()</script></body></html>"
    assert H.lines_of(body) == ["Intro text", "Item | 2024", "Net sales | 1,234", "Loss | (5.5)"]


def test_html_nested_and_unclosed_rows():
    assert H.lines_of("<table><tr><td>Outer<table><tr><td>in</td><td>2</td></tr></table></td><td>7</td></tr></table>") == ["in | 2", "Outer | 7"]
    assert H.lines_of("<p>a<table><tr><td>x<td>1<tr><td>y<td>2</table>b") == ["a", "x | 1", "y | 2", "b"]
    assert H.lines_of("<table><tr><td><p>two<br>parts</p></td><td>%</td></tr></table>") == ["two parts"]


def test_members_listings_labels(spark):
    page = "{{NASDAQ|ZZ}}\n== Components ==\n* [[Apple]] (AAPL)\n# Old ([[FB]])\n{|\n|-\n| MSFT || Microsoft\n| Name || {{NASDAQ|GOOG}} || x\n|}\n== Other ==\n* No (NO)"
    d = spark.createDataFrame([(page,), ("no list (ABC)",)], "t string")
    assert [r[0] for r in d.select(S.members_of_page(C("t"))).collect()] == [["AAPL", "FB", "MSFT", "GOOG"], []]
    names = [("A", "A Receipts", "N", "N"), ("B", "B Depositary Shares", "N", "N"), ("C", "C", "Y", "N"), ("D", "D", "N", "Y"), ("E", "7% Debentures", "N", "N"), (None, "x", "N", "N")]
    kinds = S.listing_kinds(spark.createDataFrame(names, "s string, n string, e string, t string"), "s", "n", "e", "t")
    assert {r.symbol: r.kind for r in kinds.collect()} == {"A": "common", "B": "other", "C": "etf", "E": "other"}


def test_keys_stay_known_and_tables_survive_a_restart(spark, tmp_path):
    def add(i, rows):
        spark.createDataFrame(rows, "k long, at timestamp, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))

    import datetime as dt

    def stream():
        return J.file_stream(spark, str(tmp_path / "in" / "*"), "k long, at timestamp, v string", files_per_batch=1)

    first, late = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    add(0, [(1, first, "a"), (1, first, "a"), (2, first, "b")])
    for rows, keys, latest in ([None, [1, 2], {1: "a", 2: "b"}], [None, [1, 2], {1: "a", 2: "b"}], [[(1, late, "c"), (3, late, "d")], [1, 2, 3], {1: "c", 2: "b", 3: "d"}]):
        if rows:
            add(1, rows)
        got = sorted(r.k for r in J.new_releases(stream(), "k", str(tmp_path / "seen")).collect())
        assert got == keys
        state = J.latest_state(stream(), ["k"], "v", ["at"], str(tmp_path / "state"))
        assert {r.k: r.v for r in state.collect()} == latest


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "k long, v string")

    def stored():
        return {(int(p.parent.name[2:]), int(p.name[2:])) for p in (tmp_path / "rows").glob("v=*/b=*")}

    table = J.Buckets(spark, str(tmp_path), "k long, v string", ["k"], 8)
    assert table.current().count() == 0
    table.upsert(batch([(k, "a") for k in range(40)]), 0)
    whole = {b for _, b in stored()}
    assert len(whole) == 8
    table.upsert(batch([(3, "b")]), 1)
    one = {b for v, b in stored() if v == 1}
    assert len(one) == 1
    table.upsert(batch([(3, "c"), (99, "n")]), 2)
    again = stored()
    table.upsert(batch([(3, "c"), (99, "n")]), 2)  # the batch runs once more
    assert stored() == again
    assert {r.k: r.v for r in J.Buckets(spark, str(tmp_path), "k long, v string", ["k"], 8).current().collect()} == {k: "a" for k in range(40)} | {3: "c", 99: "n"}
    table.upsert(batch([]), 3)
    table.upsert(batch([(3, "d")]), 4)
    assert (0, *one) not in stored() and (1, *one) not in stored()  # replaced twice
    assert table.current().count() == 41


def test_numbers_and_names(spark):
    d = spark.createDataFrame([("Net (1,234.5) and $ 7 of 10%", "Reporting Segment Analog (2)", "us-gaap:DataCenterMember")], "line string, seg string, tag string")
    r = d.select(X.numbers(C("line")).alias("n"), X.normalise_name(C("seg")).alias("s"), X.member_words(C("tag")).alias("m")).first()
    assert r.n == [-1234.5, 7.0, 10.0] and r.s == "Analog" and r.m == "Data Center"


def test_printed_share_scales(spark):
    d = spark.createDataFrame([([1.25, 3000.0], [1250.0, 3.0, 99.0])], "n array<double>, v array<double>")
    assert abs(d.select(T.printed_share(C("n"), C("v")).alias("p")).first().p - 2 / 3) < 1e-12


def test_fiscal_quarters(spark):
    d = spark.sql("SELECT date'2024-04-03' AS a, date'2023-10-28' AS b, date'2024-02-14' AS c")
    r = d.select(
        D.snapped_quarter(C("a")).alias("q"), D.fiscal_label(C("b"), 10).alias("f"), D.nearest_quarter_end(C("c")).cast("string").alias("e"), D.duration_months(C("b"), C("a")).alias("m")
    ).first()
    assert (r.q, r.f, r.e, r.m) == (2024 * 4, "Q4 FY2023", "2023-12-31", None)


def test_company_facts_first_and_latest(spark):
    from tidemark.operators import vintage as N

    def obs(start, end, val, filed, form="10-Q", accn="a"):
        return dict(start=start, end=end, val=val, accn=accn, form=form, filed=filed)

    usd = [
        obs("2023-01-01", "2023-03-31", 10e6, "2023-05-01"),
        obs("2023-01-01", "2023-03-31", 11e6, "2024-05-01"),
        obs("2023-01-01", "2023-09-30", 33e6, "2023-11-01"),
        obs("2023-01-01", "2023-12-31", 45e6, "2024-02-01", "10-K"),
        obs("2023-01-01", "2023-12-31", 45e6, "2024-02-01", "8-K"),
    ]
    doc = json.dumps({"cik": 1, "entityName": "X", "facts": {"us-gaap": {"Revenues": {"units": {"USD": usd}}}}})
    c = spark.createDataFrame([("us-gaap", "Revenues", "revenue", 0)], "taxonomy string, concept string, canonical string, priority int")
    v = S.fact_vintages(S.company_facts(spark.createDataFrame([(doc,)], "body string"), "body"), c)
    assert v.count() == 4
    q = N.derive_last_quarter(N.vintage_agg(v, ["cik", "canonical", "period_end", "duration_months"]), ["cik", "canonical"])
    got = {str(r.period_end): (r.first, r.latest, r.source) for r in q.collect()}
    assert got == {"2023-03-31": (10.0, 11.0, "reported 3M"), "2023-12-31": (12.0, 12.0, "derived Q4 = FY - 9M")}


def test_instance_document(spark):
    body = """<xbrl xmlns:xbrli="x" xmlns:xbrldi="d" xmlns:us-gaap="g">
    <xbrli:context id="c1"><xbrli:entity><xbrli:segment>
      <xbrldi:explicitMember dimension="us-gaap:StatementBusinessSegmentsAxis">co:GamingMember</xbrldi:explicitMember>
      <xbrldi:explicitMember dimension="srt:ProductOrServiceAxis">co:ChipsMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
      <xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
    <xbrli:context id="c2"><xbrli:entity><xbrli:segment>
      <xbrldi:explicitMember dimension="srt:ConsolidationItemsAxis">us-gaap:MaterialReconcilingItemsMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
      <xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
    <us-gaap:Revenues contextRef="c1">2000000</us-gaap:Revenues><us-gaap:Revenues contextRef="c2">500000</us-gaap:Revenues></xbrl>"""
    got = S.dimensional_facts(spark.createDataFrame([("d", body)], "doc string, body string"), "doc", "body", {"Revenues": "revenue"}).collect()
    assert sorted((r.axis, r.members, r.value, r.duration_months) for r in got) == [
        ("product_or_service+segment", "Chips+Gaming", 2.0, 3),
        ("segment", "All Other", 0.5, 3),
    ]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tag": "Revenues", "ccp": "CY2024Q2", "data": [{"cik": 1, "entityName": "X", "end": "2024-06-30", "start": "2024-04-01", "val": 5.0, "accn": "z"}]}')
    (tmp_path / "b.json").write_text('{"tag": "Revenues", "ccp": "CY2024", "data": []}')
    docs = S.whole_files(spark, str(tmp_path))
    got = S.frames_scan(docs, "body", {"Revenues": ("rev", 0)}).collect()
    assert [(r.cy, r.cq, r.metric, r.val) for r in got] == [(2024, 2, "rev", 5.0)]
    log = {r.status: r.requests for r in S.fetch_log(docs, "body", {"Revenues": ("rev", 0)}).collect()}
    assert log == {"ok": 1, "empty": 1}
    out = S.publish(spark.createDataFrame(got), str(tmp_path / "screens"), "2024-07-01")
    assert spark.read.parquet(out).count() == 1


def test_alerts_over_several_batches_equal_one_pass(spark, tmp_path):
    for i, days in enumerate([(0, 2, 4), (5, 6, 9), (10, 15)]):
        spark.createDataFrame([("x", d) for d in days], "k string, pos int").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    s = J.file_stream(spark, str(tmp_path / "in" / "*"), "k string, pos int", files_per_batch=1)
    got = sorted(r.pos for r in J.alert_suppression(s, ["k"], "pos", 5, str(tmp_path / "work")).collect())
    assert got == [0, 5, 10, 15]


def test_periods_of_text(spark):
    ends = [f"{y}-{m}" for y in range(2009, 2028) for m in ("03-31", "06-30", "09-30", "12-31")]
    want = {
        "first quarter of fiscal 2027": ("2027-03-31", 3), "nine months of fiscal 26": ("2026-09-30", 9), "fiscal year 2026": ("2026-12-31", 12), " year ended 2012 ": ("2012-12-31", 12),
        "three months ended July 26, 2015": ("2015-06-30", 3), "nine months ended September 28, 2014": ("2014-09-30", 9), "customer list 2012": None, "May 2015 call": None, "none": None,
    }
    d = spark.createDataFrame([(t, ends) for t in want], "t string, e array<string>").withColumn("e", C("e").cast("array<date>"))
    for r in d.select("t", T.fiscal_period(C("t"), C("e"), F.lit(12)).alias("p")).collect():
        assert (None if r.p is None else (str(r.p.period_end), r.p.months)) == want[r.t], (r.t, r.p)


def test_concentration(spark):
    texts = ["Customer A accounted for 22% of total revenue. Two customers were each more than 10% of revenue.", "No customer accounted for 10% or more of total revenue.", "Direct Customer B | 13% | *\nOther | 50%", "Customers owed 30% of accounts receivable and revenue."]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.s.shares, r.s.none) for r in d.select(T.concentration_shares(C("t")).alias("s")).collect()]
    assert got == [([22.0], False), ([], True), ([13.0], False), ([], False)]
    lines = ["Intro", "Customer A accounted for 22% of total revenue:", "A | 22%", "text", "B | 11%", "Major customers", "See below", "Our Asia-based customers were 40% of revenue"]
    e = spark.createDataFrame([(lines,)], "l array<string>")
    assert e.select(T.concentration_paragraphs(C("l")).alias("p")).first().p.split("\n") == ["Customer A accounted for 22% of total revenue:", "A | 22%", "B | 11%", "Major customers", "See below"]


def test_outlook_wordings_and_reconciliation(spark):
    lines = [
        "Fourth Quarter Outlook", "Revenue is expected to be $1.5 billion, plus or minus 2%.", "GAAP gross margin is expected to be 70.5% and, in turn, non-GAAP gross margin is expected to be 71%.",
        "GAAP and non-GAAP operating expenses are expected to be approximately $2.1 billion and $1.4 billion, respectively.", "Reconciliation of GAAP to Non-GAAP Outlook", "(in billions)", "GAAP operating expenses | 2.135", "Non-GAAP operating expenses | 1.402",
    ]
    d = spark.createDataFrame([(lines,)], "l array<string>")
    f = T.outlook_fields(T.outlook_section(C("l")), C("l"))
    r = d.select(*[f[c].alias(c) for c in f]).first()
    assert (r.revenue_mid, r.revenue_pm_pct, r.gm_gaap, r.gm_nongaap, r.opex_gaap, r.opex_nongaap) == (1500.0, 2.0, 70.5, 71.0, 2135.0, 1402.0)


def test_guides_of_long_texts_in_bounded_memory(spark):
    """A megabyte with a cue in every sentence; the only figure stands at the end."""
    filler = "The company expects demand to stay firm in its markets. "
    rows = [(1, filler * 20000), (2, filler * 20000 + "Our outlook is revenue of $5 million."), (3, "$5 " + "x" * 300 + " outlook for revenue")]
    got = spark.createDataFrame(rows, "i int, t string").repartition(3).select("i", G.guide_present(F.col("t")).alias("g"), G.guide_present_strict(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.g for r in got] == [False, True, False]


def test_release_texts_are_dealt_over_all_tasks_and_readers_run_once(spark):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    sf, parts = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("i02_guidance_patterns", "i02_guidance_families", "i07_guide_period"):
        assert entry.queries()[name](spark, sf).rdd.getNumPartitions() == parts
    plan = G.tiered(spark.createDataFrame([("x",)], "t string"), "t").groupBy("status").agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("operating expenses") <= 1 and "Generate inline" in plan


def test_facts_meet_their_contexts_without_a_join(spark):
    from tidemark.sources import facts as S

    docs = spark.createDataFrame([("a", "<x/>")], "doc string, body string")
    plan = S.dimensional_facts(docs, "doc", "body", {"Revenues": "revenue"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_label_documents_and_inline_reports_are_dealt_over_all_tasks(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["a08_row_label_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [o_orderkey" in plan
