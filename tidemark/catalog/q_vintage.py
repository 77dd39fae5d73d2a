"""Printings, derived quarters, concept choice and unit rules."""

from pyspark.sql import functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.functions.dates import duration_months, quarter_end, quarter_ordinal, span_kind
from tidemark.operators import vintage as N

C = F.col


def day(c, name=None):
    return (C(c) if isinstance(c, str) else c).cast("string").alias(name or c)




@query(
    "d01_vintage_agg",
    """WITH o AS (SELECT key_id, duration_code, value, filed, accn,
  row_number() OVER (PARTITION BY key_id, duration_code ORDER BY filed, accn, value) AS a,
  row_number() OVER (PARTITION BY key_id, duration_code ORDER BY filed DESC, accn DESC, value DESC) AS b FROM vintages)
SELECT key_id, duration_code, max(CASE WHEN a = 1 THEN value END) AS first, CAST(max(CASE WHEN a = 1 THEN filed END) AS VARCHAR) AS first_filed,
 max(CASE WHEN a = 1 THEN accn END) AS first_accn, max(CASE WHEN b = 1 THEN value END) AS latest,
 CAST(max(CASE WHEN b = 1 THEN filed END) AS VARCHAR) AS latest_filed, max(CASE WHEN b = 1 THEN accn END) AS latest_accn,
 count(DISTINCT round(value, 3)) AS printings FROM o GROUP BY key_id, duration_code""",
)
def d01(spark, sf):
    v = N.vintage_agg(V.vintages(spark, sf), ["key_id", "duration_code"])
    return v.withColumn("first_filed", day("first_filed")).withColumn("latest_filed", day("latest_filed"))


# cumulative reporting seen from the line items: 3, 6, 9 and 12 month figures of one filer and year, each printed
# again by later filings at a slightly different value
_CUM = """years AS (SELECT cik, qn // 4 AS fy, qn % 4 AS q, qn, rev FROM fq_rev),
cum AS (SELECT a.cik, a.fy, a.qn, CAST((a.q + 1) * 3 AS INT) AS dur,
        (SELECT round(sum(b.rev), 4) FROM years b WHERE b.cik = a.cik AND b.fy = a.fy AND b.q <= a.q) AS v, a.rev, a.q FROM years a),
facts AS (
 SELECT cik, qn, 3 AS dur, rev AS value, qn * 10 AS filed, qn * 100 + 1 AS accn FROM years WHERE q < 3 OR cik % 4 = 0
 UNION ALL SELECT cik, qn, dur, v, qn * 10, qn * 100 + 1 FROM cum WHERE dur IN (9, 12)
 UNION ALL SELECT cik, qn, dur, v + 10, qn * 10 + 40, qn * 100 + 41 FROM cum WHERE dur = 12 AND cik % 3 = 0
 UNION ALL SELECT cik, qn, 3, rev + 5, qn * 10 + 40, qn * 100 + 41 FROM years WHERE q < 3 AND cik % 3 = 1)"""


def cumulative_facts(spark, sf):
    """Quarter, nine-month and full-year printings of each filer, with later restatements."""
    from pyspark.sql import Window

    y = V.fq_rev(spark, sf).withColumn("fy", F.floor(C("qn") / 4)).withColumn("q", C("qn") % 4)
    w = Window.partitionBy("cik", "fy").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("cum", F.round(F.sum("rev").over(w), 4)).withColumn("dur", (C("q") + 1) * 3)

    def fact(dur, value, late, keep):
        return F.when(
            keep,
            F.struct(
                dur.cast("int").alias("duration_months"),
                value.alias("value"),
                (C("qn") * 10 + late * 40).alias("filed"),
                (C("qn") * 100 + 1 + late * 40).alias("accn"),
            ),
        )

    parts = F.array(
        fact(F.lit(3), C("rev"), 0, (C("q") < 3) | (C("cik") % 4 == 0)),
        fact(C("dur"), C("cum"), 0, C("dur").isin(9, 12)),
        fact(C("dur"), C("cum") + 10, 1, (C("dur") == 12) & (C("cik") % 3 == 0)),
        fact(F.lit(3), C("rev") + 5, 1, (C("q") < 3) & (C("cik") % 3 == 1)),
    )
    flat = y.select("cik", "qn", F.inline(F.filter(parts, lambda x: x.isNotNull())))
    return flat.withColumn("period_end", quarter_end(C("qn")))


_V2 = """fv AS (SELECT cik, qn, dur, arg_min(value, filed) AS first, min(filed) AS first_filed, min(accn) AS first_accn,
 arg_max(value, filed) AS latest, max(filed) AS latest_filed, max(accn) AS latest_accn, count(DISTINCT round(value, 3)) AS printings
 FROM facts GROUP BY cik, qn, dur)"""


def fact_vintages(spark, sf):
    return N.vintage_agg(cumulative_facts(spark, sf), ["cik", "qn", "period_end", "duration_months"])


@query(
    "d02_derived_q4",
    f"""WITH {_CUM}, {_V2},
rep AS (SELECT cik, qn, first, first_filed, latest, latest_filed, printings, 'reported 3M' AS source FROM fv WHERE dur = 3),
der AS (SELECT y.cik, y.qn, y.first - n.first, y.first_filed, y.latest - n.latest, y.latest_filed, greatest(y.printings, n.printings), 'derived Q4 = FY - 9M'
        FROM fv y JOIN fv n ON y.cik = n.cik AND y.dur = 12 AND n.dur = 9 AND n.qn = y.qn - 1
        WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.cik = y.cik AND r.qn = y.qn)),
u AS (SELECT * FROM rep UNION ALL SELECT * FROM der)
SELECT cik, qn, round(first, 4) AS first, first_filed, round(latest, 4) AS latest, latest_filed, printings, source FROM u""",
)
def d02(spark, sf):
    q = N.derive_last_quarter(fact_vintages(spark, sf).drop("qn"), ["cik"])
    return q.select(
        "cik",
        quarter_ordinal(C("period_end")).alias("qn"),
        F.round("first", 4).alias("first"),
        "first_filed",
        F.round("latest", 4).alias("latest"),
        "latest_filed",
        "printings",
        "source",
    )


@query(
    "d05_annual_vintage",
    f"""WITH {_CUM}, {_V2} SELECT cik, qn, first, first_filed, latest, latest_filed, printings FROM fv WHERE dur = 12""",
)
def d05(spark, sf):
    f = cumulative_facts(spark, sf).where(C("duration_months") == 12)
    return N.vintage_agg(f, ["cik", "qn"]).drop("first_accn", "latest_accn")


@query(
    "d24_restated_flag",
    f"WITH {_CUM}, {_V2} SELECT cik, qn, dur AS duration_months, CAST(printings > 1 AS INT) AS restated FROM fv",
)
def d24(spark, sf):
    v = fact_vintages(spark, sf)
    return v.select("cik", "qn", "duration_months", (C("printings") > 1).cast("int").alias("restated"))


@query(
    "c11_fy_9m_join",
    f"""WITH {_CUM}, {_V2}
SELECT y.cik, y.qn, y.first AS fy_first, n.first AS nine_first FROM fv y JOIN fv n ON y.cik = n.cik AND y.dur = 12 AND n.dur = 9
WHERE last_day(make_date(CAST(y.qn // 4 AS INT), CAST(y.qn % 4 * 3 + 3 AS INT), 1)) - last_day(make_date(CAST(n.qn // 4 AS INT), CAST(n.qn % 4 * 3 + 3 AS INT), 1)) BETWEEN 80 AND 100""",
)
def c11(spark, sf):
    v = fact_vintages(spark, sf)
    fy = v.where(C("duration_months") == 12).select("cik", "qn", "period_end", C("first").alias("fy_first"))
    nine = v.where(C("duration_months") == 9).select("cik", C("period_end").alias("e9"), C("first").alias("nine_first"))
    return (
        fy.join(nine, "cik")
        .where(F.datediff("period_end", "e9").between(80, 100))
        .select("cik", "qn", "fy_first", "nine_first")
    )


@query(
    "d03_derived_q4_panel",
    """WITH q AS (SELECT * FROM fq_gap WHERE NOT (qn % 4 = 3 AND cik % 2 = 0)),
fy AS (SELECT cik, qn // 4 AS cy, round(sum(rev), 4) AS fy_rev FROM fq_rev GROUP BY 1, 2),
q123 AS (SELECT cik, qn // 4 AS cy, round(sum(rev), 4) AS s FROM q WHERE qn % 4 < 3 GROUP BY 1, 2 HAVING count(*) = 3)
SELECT cik, CAST(cy * 4 + 3 AS INT) AS qn, round(fy_rev - s, 4) AS rev FROM fy JOIN q123 USING (cik, cy)
WHERE fy_rev - s > 0 AND NOT EXISTS (SELECT 1 FROM q WHERE q.cik = fy.cik AND q.qn = cy * 4 + 3)""",
)
def d03(spark, sf):
    q = V.fq_gap(spark, sf).where(~((C("qn") % 4 == 3) & (C("cik") % 2 == 0)))
    fy = (
        V.fq_rev(spark, sf)
        .groupBy("cik", F.floor(C("qn") / 4).alias("cy"))
        .agg(F.round(F.sum("rev"), 4).alias("fy_rev"))
    )
    got = derive_panel_q4(q, fy)
    return got.select("cik", "qn", F.round("rev", 4).alias("rev"))


def derive_panel_q4(q, fy):
    """Fourth quarter = year less its three quarters, only with exactly three, above zero and none reported."""
    q123 = (
        q.where(C("qn") % 4 < 3)
        .groupBy("cik", F.floor(C("qn") / 4).alias("cy"))
        .agg(F.round(F.sum("rev"), 4).alias("s"), F.count(F.lit(1)).alias("n"))
        .where(C("n") == 3)
    )
    d = fy.join(q123, ["cik", "cy"]).select(
        "cik", (C("cy") * 4 + 3).cast("int").alias("qn"), (C("fy_rev") - C("s")).alias("rev")
    )
    return d.where(C("rev") > 0).join(q.select("cik", "qn"), ["cik", "qn"], "left_anti")


@query(
    "c14_anti_existing_q4",
    """WITH q AS (SELECT * FROM fq_gap WHERE NOT (qn % 4 = 3 AND cik % 2 = 0))
SELECT r.cik, r.qn, r.rev FROM fq_rev r WHERE r.qn % 4 = 3 AND NOT EXISTS (SELECT 1 FROM q WHERE q.cik = r.cik AND q.qn = r.qn)""",
)
def c14(spark, sf):
    q = V.fq_gap(spark, sf).where(~((C("qn") % 4 == 3) & (C("cik") % 2 == 0)))
    r = V.fq_rev(spark, sf).where(C("qn") % 4 == 3)
    return r.join(q.select("cik", "qn"), ["cik", "qn"], "left_anti").select("cik", "qn", "rev")


@query(
    "d04_derived_q4_pit",
    """WITH li AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) AS s,
  last_day(CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) + INTERVAL 2 MONTH) AS e, rev FROM
  (SELECT l_suppkey, l_shipdate, l_extendedprice*(1-l_discount) AS rev FROM lineitem)),
q0 AS (SELECT cik, s, CAST(e AS DATE) AS e, round(sum(rev), 4) AS rev FROM li GROUP BY 1, 2, 3),
q AS (SELECT * FROM q0 WHERE month(e) <> 12 OR cik % 3 = 0),
fy AS (SELECT cik, make_date(year(s), 1, 1) AS s, make_date(year(s), 12, 31) AS e, round(sum(rev), 4) AS rev FROM q0 GROUP BY 1, 2, 3),
ins AS (SELECT fy.cik, fy.e, fy.rev, max(q.e) AS last_end, round(sum(q.rev), 4) AS s3, count(*) AS n FROM fy JOIN q ON q.cik = fy.cik
        AND q.s >= fy.s - 7 AND q.e < fy.e - 30 GROUP BY 1, 2, 3)
SELECT cik, CAST(last_end + 1 AS VARCHAR) AS start, CAST(e AS VARCHAR) AS period_end, round(rev - s3, 4) AS rev FROM ins
WHERE n = 3 AND NOT EXISTS (SELECT 1 FROM q WHERE q.cik = ins.cik AND abs(q.e - ins.e) <= 7)""",
)
def d04(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        C("l_suppkey").cast("int").alias("cik"),
        F.trunc("l_shipdate", "quarter").alias("s"),
        (C("l_extendedprice") * (1 - C("l_discount"))).alias("rev"),
    )
    q0 = li.groupBy("cik", "s").agg(F.round(F.sum("rev"), 4).alias("rev"))
    q0 = q0.withColumn("e", F.last_day(F.add_months("s", 2)))
    q = q0.where((F.month("e") != 12) | (C("cik") % 3 == 0))
    fy = q0.groupBy("cik", F.trunc("s", "year").alias("s")).agg(F.round(F.sum("rev"), 4).alias("rev"))
    fy = fy.withColumn("e", F.last_day(F.add_months("s", 11)))
    return last_quarter_inside(q, fy).select("cik", day("start"), day("e", "period_end"), F.round("rev", 4).alias("rev"))


def last_quarter_inside(q, fy):
    """Year less the three quarters inside its span. The join key carries the year, so a filer's quarters meet only
    that year's row; a year that starts up to a week early is found through the neighbour year as well."""
    y = fy.select("cik", C("s").alias("fs"), C("e").alias("fe"), C("rev").alias("frev"))
    y = y.withColumn("yr", F.explode(F.array_distinct(F.array(F.year(F.date_sub("fs", 7)), F.year("fs"), F.year("fe")))))
    inside = (
        y.join(q.withColumn("yr", F.year("s")), ["cik", "yr"])
        .where((C("s") >= F.date_sub("fs", 7)) & (C("e") < F.date_sub("fe", 30)))
        .groupBy("cik", "fe", "frev")
        .agg(F.max("e").alias("last_end"), F.round(F.sum("rev"), 4).alias("s3"), F.count(F.lit(1)).alias("n"))
        .where(C("n") == 3)
    )
    near = q.select("cik", F.explode(F.sequence(F.date_sub("e", 7), F.date_add("e", 7))).alias("fe"))
    got = inside.join(near, ["cik", "fe"], "left_anti")
    return got.select(
        "cik", F.date_add("last_end", 1).alias("start"), C("fe").alias("e"), (C("frev") - C("s3")).alias("rev")
    )


# concepts: the return flag plays the tag a filer reports revenue under
@query(
    "d06_concept_pin",
    """WITH s AS (SELECT cik, segment, count(*) AS n, median(rev) AS med FROM fq_seg WHERE (cik*7 + qn*5 + ascii(segment)) % 9 <> 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, med DESC, segment) AS k FROM s)
SELECT cik, segment FROM r WHERE k = 1""",
)
def d06(spark, sf):
    return N.pin_concept(_tagged(spark, sf), ["cik"], "segment", "rev")


def _tagged(spark, sf):
    return V.fq_seg(spark, sf).where((C("cik") * 7 + C("qn") * 5 + F.ascii("segment")) % 9 != 0)


@query(
    "c01_pinned_concept_join",
    """WITH t AS (SELECT * FROM fq_seg WHERE (cik*7 + qn*5 + ascii(segment)) % 9 <> 0),
s AS (SELECT cik, segment, count(*) AS n, median(rev) AS med FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, med DESC, segment) AS k FROM s)
SELECT t.cik, t.segment, t.qn, t.rev FROM t JOIN r ON t.cik = r.cik AND t.segment = r.segment AND r.k = 1""",
)
def c01(spark, sf):
    t = _tagged(spark, sf)
    return t.join(N.pin_concept(t, ["cik"], "segment", "rev"), ["cik", "segment"]).select("cik", "segment", "qn", "rev")


@query(
    "d07_concept_priority",
    """WITH t AS (SELECT *, CASE segment WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS prio FROM fq_seg WHERE (cik*7 + qn*5 + ascii(segment)) % 9 <> 0)
SELECT cik, qn, segment, rev FROM t WHERE prio = (SELECT min(prio) FROM t x WHERE x.cik = t.cik AND x.qn = t.qn)""",
)
def d07(spark, sf):
    prio = F.when(C("segment") == "N", 0).when(C("segment") == "A", 1).otherwise(2)
    t = _tagged(spark, sf).withColumn("prio", prio)
    return N.lowest_priority(t, ["cik", "qn"], "prio").select("cik", "qn", "segment", "rev")


@query(
    "d08_member_collapse",
    """SELECT l_orderkey AS accn, l_returnflag AS member, round(sum(l_extendedprice), 2) AS value, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS filed
FROM lineitem GROUP BY 1, 2""",
)
def d08(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("accn"),
        C("l_returnflag").alias("member"),
        C("l_extendedprice").alias("value"),
        C("l_shipdate").cast("date").alias("filed"),
    )
    d = N.collapse_members(li, ["accn", "member"], "value", ["filed"], "filed")
    return d.select("accn", "member", F.round("value", 2).alias("value"), day("filed"))


@query(
    "d11_modal_label",
    """WITH n AS (SELECT CAST(l_suppkey AS INT) AS cik, CAST(l_linenumber AS INT) AS label, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, last DESC, label) AS k FROM n)
SELECT cik, label FROM r WHERE k = 1""",
)
def d11(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        C("l_suppkey").cast("int").alias("cik"), C("l_linenumber").cast("int").alias("label"), "l_shipdate"
    )
    return N.modal(li, ["cik"], "label", "l_shipdate")


@query(
    "d19_conflict_count",
    """SELECT CAST(l_partkey AS INT) AS key_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS filed, count(DISTINCT round(l_extendedprice, 1)) AS values_printed
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT round(l_extendedprice, 1)) > 1""",
)
def d19(spark, sf):
    v = V.vintages(spark, sf)
    g = v.groupBy("key_id", day("filed")).agg(F.countDistinct(F.round("value", 1)).alias("values_printed"))
    return g.where(C("values_printed") > 1)


@query(
    "b01_duration_months",
    """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS ln, CAST(o_orderdate AS DATE) AS s, CAST(l_shipdate AS DATE) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE l_shipdate >= o_orderdate),
y AS (SELECT id, ln, CASE WHEN ln = 1 THEN 0 ELSE CAST(round_even((e - s) / 30.44, 0) AS INT) END AS m FROM x)
SELECT m AS months, count(*) AS n FROM y WHERE m IN (0, 3, 6, 9, 12) GROUP BY 1""",
)
def b01(spark, sf):
    d = _spans(spark, sf)
    s = F.when(C("ln") != 1, C("s"))
    d = d.withColumn("months", duration_months(s, C("e"))).where(C("months").isNotNull())
    return d.groupBy("months").agg(F.count(F.lit(1)).alias("n"))


def _spans(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return (
        li.join(o, C("l_orderkey") == C("o_orderkey"))
        .where(C("l_shipdate") >= C("o_orderdate"))
        .select(
            C("l_orderkey").alias("id"),
            C("l_linenumber").alias("ln"),
            C("o_orderdate").cast("date").alias("s"),
            C("l_shipdate").cast("date").alias("e"),
        )
    )


@query(
    "b02_span_band",
    """SELECT CASE WHEN d BETWEEN 80 AND 100 THEN 'quarter' WHEN d BETWEEN 350 AND 380 THEN 'year' END AS span, count(*) AS n
FROM (SELECT CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)
GROUP BY 1""",
)
def b02(spark, sf):
    return _spans(spark, sf).groupBy(span_kind(C("s"), C("e")).alias("span")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b03_unit_scale",
    """SELECT CAST(o_orderkey AS INT) AS accn, CASE WHEN o_orderstatus = 'F' THEN 'USD/shares' ELSE 'USD' END AS unit,
round(CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 1e6 END, 8) AS value FROM orders""",
)
def b03(spark, sf):
    o = V.table(spark, sf, "orders")
    text = F.when(C("o_orderpriority").startswith("1"), F.lit("n/a")).otherwise(C("o_totalprice").cast("string"))
    unit = F.when(C("o_orderstatus") == "F", "USD/shares").otherwise("USD")
    d = o.select(C("o_orderkey").cast("int").alias("accn"), unit.alias("unit"), text.alias("text"))
    return d.select("accn", "unit", F.round(scaled(C("text"), C("unit")), 8).alias("value"))


def scaled(text, unit):
    """Money and counts in millions, per-share values as they are; text that is no number is null."""
    v = text.try_cast("double")
    return F.when(unit.contains("/shares"), v).otherwise(v / 1e6)


@query(
    "b04_unit_repair",
    """WITH s AS (SELECT CAST(l_partkey % 50 AS INT) AS metric, l_orderkey AS accn, CAST(l_linenumber AS INT) AS ln,
  CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice / 1000 ELSE l_extendedprice END AS v FROM lineitem),
m AS (SELECT metric, median(v) AS med FROM s GROUP BY 1)
SELECT s.metric, count(*) AS n, count(*) FILTER (WHERE v < med / 100) AS fixed, round(max(CASE WHEN v < med / 100 THEN v * 1000 ELSE v END), 4) AS top
FROM s JOIN m USING (metric) GROUP BY 1""",
)
def b04(spark, sf):
    from tidemark.operators.ranks import percentiles

    s = V.table(spark, sf, "lineitem").select(
        (C("l_partkey") % 50).cast("int").alias("metric"),
        F.when(C("l_orderkey") % 97 == 0, C("l_extendedprice") / 1000).otherwise(C("l_extendedprice")).alias("v"),
    )
    med = percentiles(s, ["metric"], "v", {"med": 0.5}).drop("n")
    d = N.repair_units(s, ["metric"], "v", F.lit(True), med)
    return d.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("unit_fix").alias("fixed"),
        F.round(F.max("v"), 4).alias("top"),
    )


@query(
    "b05_dominant_unit",
    """WITH x AS (SELECT CAST(o_custkey % 100 AS INT) AS cik, o_orderpriority AS unit, o_totalprice AS v FROM orders),
n AS (SELECT cik, unit, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, unit) AS k FROM n)
SELECT x.cik, x.unit, count(*) AS n, round(sum(v), 2) AS total FROM x JOIN r ON x.cik = r.cik AND x.unit = r.unit AND r.k = 1 GROUP BY 1, 2""",
)
def b05(spark, sf):
    x = V.table(spark, sf, "orders").select(
        (C("o_custkey") % 100).cast("int").alias("cik"), C("o_orderpriority").alias("unit"), C("o_totalprice").alias("v")
    )
    d = N.keep_dominant(x, ["cik"], "unit")
    return d.groupBy("cik", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(
    "b06_form_whitelist",
    "SELECT accn, cik, CAST(filed AS VARCHAR) AS filed, form FROM releases WHERE form IN ('F', 'O')",
)
def b06(spark, sf):
    return V.releases(spark, sf).where(C("form").isin("F", "O")).select("accn", "cik", day("filed"), "form")


@query(
    "b07_null_nonpositive",
    """SELECT CAST(c_custkey AS INT) AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
round(1000 / nullif(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0), 6) AS inv FROM customer""",
)
def b07(spark, sf):
    v = F.when(C("c_acctbal") > 0, C("c_acctbal"))
    return V.table(spark, sf, "customer").select(
        C("c_custkey").cast("int").alias("id"), v.alias("balance"), F.round(1000 / F.nullif(v, F.lit(0.0)), 6).alias("inv")
    )


@query(
    "a05_first_reported_scan",
    """WITH x AS (SELECT CAST(l_suppkey AS INT) AS cik, date_trunc('quarter', CAST(o_orderdate AS DATE)) AS s, CAST(l_shipdate AS DATE) AS e, l_extendedprice AS val,
 CAST(o_orderdate AS DATE) AS filed, l_orderkey AS accn FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY cik, s, e ORDER BY filed, accn, val) AS k FROM x WHERE e - CAST(s AS DATE) BETWEEN 80 AND 100)
SELECT cik, CAST(CAST(s AS DATE) AS VARCHAR) AS start, CAST(e AS VARCHAR) AS period_end, val, CAST(filed AS VARCHAR) AS filed FROM r WHERE k = 1""",
)
def a05(spark, sf):
    li = V.table(spark, sf, "lineitem")
    o = V.table(spark, sf, "orders")
    x = li.join(o, C("l_orderkey") == C("o_orderkey")).select(
        C("l_suppkey").cast("int").alias("cik"),
        F.trunc("o_orderdate", "quarter").alias("s"),
        C("l_shipdate").cast("date").alias("e"),
        C("l_extendedprice").alias("val"),
        C("o_orderdate").cast("date").alias("filed"),
        C("l_orderkey").alias("accn"),
    )
    x = x.where(F.datediff("e", "s").between(80, 100))
    g = x.groupBy("cik", "s", "e").agg(F.min(F.struct("filed", "accn", "val")).alias("r"))
    return g.select("cik", day("s", "start"), day("e", "period_end"), C("r.val").alias("val"), day(C("r.filed"), "filed"))
