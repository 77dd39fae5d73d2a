"""Readers of dated tables against hand-made releases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import release_tables as R

C = F.col


def labels(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(fn(C("s"))).collect()]


def test_kpi_labels_and_footnotes(spark):
    got = labels(spark, R.kpi_metric, ["Net bookings(3)", "Net bookings *", "Net bookings2", "Net bookings (in units) 1, 2", "Value of  net bookings, excluding EUV (EUR)", "Systems backlog, excluding EUV (units)", "Net bookings per head", "Backlog", None, ""])
    assert got == ["bookings_value", "bookings_value", "bookings_value", "bookings_units", "bookings_value_ex_euv", "backlog_units_ex_euv", None, "backlog_value", None, None]


def test_header_dates(spark):
    heads = [["x", "Mar 27, | Dec 31, | Sept 25,", "EUR | 2011 | 2010 | 2010"], ["Jun 30, 42013 | Mar 31, 2013"], ["Mar 27, | Dec 31,", "2011"], ["Feb 30, 2011 | Mar 31, 2011"], []]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, l array<string>").orderBy("i").select(R.header_dates(C("l"))).collect()]
    d = dt.date
    assert got == [[d(2011, 3, 27), d(2010, 12, 31), d(2010, 9, 25)], [d(2013, 6, 30), d(2013, 3, 31)], None, None, None]


def release(spark, *lines, exhibit="EX-99.1", filed=dt.date(2024, 7, 20)):
    return spark.createDataFrame([(1, 1, filed, exhibit, list(lines))], "cik int, accn int, filed date, exhibit string, lines array<string>")


def test_rows_that_do_not_fill_the_columns_are_left_out(spark):
    r = release(spark, "Quarterly Summary Ratios", "Mar 31, 2024 | Jun 30, 2024", "Net bookings (units) | 3 | 10 | 20", "Systems backlog | 5", "Net bookings | 1,000 | (7.5)")
    got = sorted(map(tuple, R.ratio_printings(r, ["accn"]).collect()))
    assert got == [(1, "bookings_units", dt.date(2024, 3, 31), 10.0), (1, "bookings_units", dt.date(2024, 6, 30), 20.0), (1, "bookings_value", dt.date(2024, 3, 31), 1000.0), (1, "bookings_value", dt.date(2024, 6, 30), -7.5)]
    assert R.ratio_printings(release(spark, "Quarterly Summary Ratios under IFRS", "Mar 31, 2024 | Jun 30, 2024", "Net bookings | 11 | 12"), ["accn"]).count() == 0
    assert R.ratio_printings(release(spark), ["accn"]).count() == 0


def test_text_is_used_only_without_a_table(spark):
    a = release(spark, "Q2 2024 net bookings of EUR 1.2 billion, backlog valued at EUR 900 million.")
    b = release(spark, "Quarterly Summary Ratios", "Mar 31, 2024 | Jun 30, 2024", "Net bookings | 55 | 1,180", exhibit="EX-99.3")
    got = {(r.metric, r.period_end.month, r.value, r.source) for r in R.kpi_printings(a.unionByName(b)).collect()}
    assert got == {("bookings_value", 3, 55.0, "EX-99.3 ratios table"), ("bookings_value", 6, 1180.0, "EX-99.3 ratios table"), ("backlog_value", 6, 900.0, "EX-99.1 text")}


def test_reported_quarter_needs_a_near_column(spark):
    labels = {"Net sales": "revenue"}
    far = release(spark, "Quarterly Summary Statements of Operations", "Dec 31, 2023 | Mar 31, 2024", "Net sales | 1 | 2")
    assert R.reported_quarters(far, labels).count() == 0
    near = release(spark, "Q2 2024 | Q1 2024 | 2023", "Net sales 2 | 5 | 6 | 7", "Cost | 1")
    assert [(r.metric, r.value, r.source) for r in R.reported_quarters(near, labels).collect()] == [("revenue", 5.0, "quarter labels")]
    assert R.reported_quarters(release(spark, "Q2 2024 | Q1 2024", "Net sales | 5 | 6 | 7"), labels).count() == 0


def month(spark, *lines):
    return [(r.month_end, r.revenue, r.to_date, r.source) for r in R.monthly_rows(release(spark, *lines), ["accn"]).collect()]


def test_a_month_with_one_wrong_change_is_rejected(spark):
    title, end = "TSM March 2024 Revenue Report", dt.date(2024, 3, 31)
    assert month(spark, title, "Net Revenue | 110 | 100 | 10.0% | 88 | 25.0% | 300 | 1 | 2") == [(end, 110.0, 300.0, "row")]
    assert month(spark, title, "Net Revenue | 110 | 100 | 10.0% | 88 | 24.0% | 300 | 1 | 2") == []
    assert month(spark, title, "Net Revenue | 110 | 100 | 11.0% | 88 | 25.0%", "revenues for March 2024 were approximately NT$0.11 billion.") == [(end, 110.0, None, "sentence")]
    assert month(spark, title, "Net Revenue | 110 | 0 | 11.0% | 88 | 25.0%") == []
    assert month(spark, "No title", "Net Revenue | 110 | 100 | 10.0% | 88 | 25.0%") == []


def test_node_shares(spark):
    text = "Sales rose. 5-nanometer accounted for 21.5% of total wafer revenue and 7nm for 30 percent; advanced technologies, defined as 7-nanometer and more advanced, accounted for 51.5%. 28nm took 9% of total wafer revenue."
    d = spark.createDataFrame([(text,), (None,), ("no share",)], "t string").select(F.explode(R.node_shares(C("t"))).alias("x")).select("x.*")
    assert [tuple(r) for r in d.collect()] == [("5nm", "node", 21.5), ("7nm", "node", 30.0), ("7nm and below", "cumulative", 51.5)]


def test_platform_shares_need_four_that_sum_to_a_hundred(spark):
    day = F.lit("2024-06-30").cast("date")
    rows = [("2Q24 Revenue by Platform HPC 52% Smartphone 33% IoT 6% Automotive 5% Others 4%",), ("2Q24 Revenue by Platform HPC 52% Smartphone 33% IoT 6%",), ("1Q24 Revenue by Platform HPC 52% Smartphone 33% IoT 6% Automotive 9%",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(R.platform_shares(C("t"), day)).collect()]
    assert sum(x.pct for x in got[0]) == 100 and got[1:] == [None, None, None]


def test_release_joins_are_never_gathered_and_texts_are_dealt(spark):
    from tidemark.catalog import q_tables as Q

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert Q.orders(spark, "/root/testdata/sf0.001", 3).rdd.getNumPartitions() == parts
    d = R.first_and_latest(R.kpi_printings(Q.kpi_releases(spark, "/root/testdata/sf0.001")))
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def shuffles(d):
    """Number of exchanges of a plan that reads its tables and nothing written in between."""
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
    return plan.count("Exchange ")


def test_kpi_texts_are_dealt_once_and_never_written(spark):
    from tidemark.catalog import q_tables as Q

    assert shuffles(Q.i17(spark, "/root/testdata/sf0.001")) == 1


def test_a_flattened_table_printed_twice_counts_once(spark):
    line = "Three months ended Dec 31, Mar 31, Jun 30, (Unaudited) 2023 2024 2024 Ratios Net bookings 3 70 80 90 Sales 1 2 3"
    both = release(spark, line, line, exhibit="EX-99.3").unionByName(release(spark, "Q2 2024 net bookings of EUR 1.2 billion.", line))
    got = sorted((r.metric, r.period_end, r.value, r.source) for r in R.kpi_printings(both).collect())
    ends = [dt.date(2023, 12, 31), dt.date(2024, 3, 31), dt.date(2024, 6, 30)]
    assert got == [("bookings_value", d, v, "EX-99.3 ratios (flattened)") for d, v in zip(ends, (70.0, 80.0, 90.0))]


def test_first_and_latest_printing_and_conflicts(spark):
    a, b, end = dt.date(2024, 4, 20), dt.date(2024, 7, 20), dt.date(2024, 3, 31)
    rows = [(1, 1, a, end, "m", 5.0, "y"), (1, 1, a, end, "m", 6.0, "x"), (1, 1, a, end, "m", 6.01, "x"), (1, 2, b, end, "m", 7.0, "x"), (1, 2, b, end, "m", 7.0, "y"),
            (None, 1, a, end, "m", 1.0, "x"), (2, 1, a, None, "m", 1.0, "x"), (3, None, None, end, "m", None, "x"), (3, None, a, end, "m", 2.0, "x")]
    d = spark.createDataFrame(rows, "cik int, accn int, filed date, period_end date, metric string, value double, source string")
    got = sorted(map(tuple, R.first_and_latest(d).collect()))
    assert got == [(1, end, "m", 6.0, "x", 7.0, b, 1), (3, end, "m", None, "x", 2.0, a, 0)]


def test_quarter_texts_are_dealt_once_and_never_written(spark):
    from tidemark.catalog import q_tables as Q

    assert shuffles(Q.i16(spark, "/root/testdata/sf0.001")) == 1
    assert shuffles(Q.i16_printings(spark, "/root/testdata/sf0.001")) == 1


def test_one_table_of_a_release_counts(spark):
    labels = {"Net sales": "revenue", "Gross profit": "gross_profit"}
    head = ["Quarterly Summary Statements of Operations", "Mar 31, 2024 | Jun 30, 2024"]
    later = release(spark, *head, "Gross profit | 8 | 9", "Net sales | 3 | 4", exhibit="EX-99.3")
    first = release(spark, *head, "Net sales | 1 | 10 | 20", "Net sales | 11 | 21", "Gross profit | x", exhibit="EX-99.2")
    tables = release(spark, "Q2 2024 | Q1 2024", "Gross profit | 5 | 6", "Q2 2024 | Q1 2024", "Net sales | 7 | 6", "Net sales | 1 | 1")
    read = lambda d: sorted((r.metric, r.value, r.source) for r in R.reported_quarters(d, labels).collect())
    assert read(later.unionByName(first).unionByName(tables)) == [("revenue", 20.0, "dated columns")]
    assert read(later.unionByName(tables)) == [("gross_profit", 9.0, "dated columns"), ("revenue", 4.0, "dated columns")]
    assert read(tables.unionByName(tables)) == [("gross_profit", 5.0, "quarter labels"), ("revenue", 7.0, "quarter labels")]
    assert read(tables.withColumn("cik", F.lit(None).cast("int"))) == []
    without = release(spark, *head, "Gross profit | 8 | 9", exhibit="EX-99.1")  # the exhibit that is read has no revenue
    assert read(without.unionByName(later)) == []
