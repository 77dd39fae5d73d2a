"""Landed filings to typed tables: frames, company facts, filing indexes, instances, labels, holdings, logs, prices.

Every reader takes a DataFrame with the document in a string column, so the same code serves ``spark.read.text`` with
``wholetext`` and documents that already sit in a table. JSON and XML are parsed by Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.dates import duration_months
from tidemark.functions.text import member_words
from tidemark.session import cut_lineage

C = F.col

# Filing forms whose facts count, and XBRL axis names, consolidation members and labels that are
# subtotals, currency prefixes, name words of securities that are no common share, ticker symbols.
FACT_FORMS = ("10-Q", "10-K", "10-Q/A", "10-K/A", "20-F", "20-F/A", "6-K")
AXES = {
    "StatementBusinessSegmentsAxis": "segment",
    "ProductOrServiceAxis": "product_or_service",
    "StatementGeographicalAxis": "geography",
    "MajorCustomersAxis": "customer",
}
CONSOLIDATION, OPERATING = "ConsolidationItemsAxis", "OperatingSegmentsMember"
SUBTOTAL_MEMBERS = r"(?i)^(OperatingSegments|ReportableSegments|SegmentContinuingOperations|ConsolidatedEntities)"
LABEL_ROLES = ("terseLabel", "verboseLabel", "label")
SUBTOTAL_LABELS = r"(?i)^((reportable|reporting|operating|business) segments?|segments?|total|consolidated|total (net )?(revenue|sales))$"
CURRENCIES = ("USD", "EUR", "TWD", "KRW", "JPY", "CHF")
OTHER_SECURITIES = r"(?i)warrant|unit|right|preferred|depositary shares|notes|debenture|subordinated"
SYMBOL = r"[A-Z][A-Z.]{0,5}"

OBS = "struct<start:date,end:date,val:double,accn:string,form:string,filed:date>"
FACTS = f"struct<cik:int,entityName:string,facts:map<string,map<string,struct<units:map<string,array<{OBS}>>>>>>"
FRAME = "struct<tag:string,ccp:string,data:array<struct<cik:int,entityName:string,start:date,end:date,val:double,accn:string>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of landed files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), C("value").alias("body"))


def frames_scan(docs: DataFrame, body: str, metrics: dict[str, tuple[str, int]]) -> DataFrame:
    """Frame documents to one row per filer observation; ``metrics`` maps a tag to (metric, priority).

    The period reads CY2024Q2, CY2024Q2I (instant) or CY2024 (a year).
    """
    d = docs.select(F.from_json(C(body), FRAME).alias("j")).select("j.tag", C("j.ccp").alias("ccp"), F.inline("j.data"))
    m = F.create_map(*[x for t, (n, p) in metrics.items() for x in (F.lit(t), F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")))])
    hit = m[C("tag")]
    cq = F.coalesce(F.regexp_extract("ccp", r"Q(\d)", 1).try_cast("int"), F.lit(0))
    name = F.when((hit["n"] == "rev") & (cq == 0), "rev_fy").otherwise(hit["n"])
    return d.where(hit.isNotNull()).select(
        "cik", "entityName", "start", "end", "val", "accn", name.alias("metric"), "tag",
        F.regexp_extract("ccp", r"CY(\d{4})", 1).cast("int").alias("cy"), cq.alias("cq"), hit["p"].alias("prio"),
    )


def fetch_log(docs: DataFrame, body: str, metrics: dict[str, tuple[str, int]]) -> DataFrame:
    """Documents and rows per metric and parse status."""
    j = F.from_json(C(body), FRAME)
    m = F.create_map(*[x for t, (n, _) in metrics.items() for x in (F.lit(t), F.lit(n))])
    d = docs.select(m[j["tag"]].alias("metric"), F.size(F.coalesce(j["data"], F.array())).alias("n"))
    status = F.when(C("metric").isNull(), "error").when(C("n") <= 0, "empty").otherwise("ok")
    return d.groupBy("metric", status.alias("status")).agg(F.count(F.lit(1)).alias("requests"), F.sum("n").alias("rows"))


def company_facts(docs: DataFrame, body: str) -> DataFrame:
    """Nested facts to long rows: cik, taxonomy, concept, unit and the observation."""
    d = docs.select(F.from_json(C(body), FACTS).alias("j"))
    d = d.select("j.cik", C("j.entityName").alias("name"), F.explode("j.facts").alias("taxonomy", "concepts"))
    d = d.select("cik", "name", "taxonomy", F.explode("concepts").alias("concept", "c"))
    d = d.select("cik", "name", "taxonomy", "concept", F.explode("c.units").alias("unit", "obs"))
    return d.select("cik", "name", "taxonomy", "concept", "unit", F.inline("obs"))


def fact_vintages(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Canonical facts in millions (per-share values as they are) with their duration in months.

    ``concepts`` (taxonomy, concept, canonical, priority) is a short list. The second taxonomy counts only for filers
    without facts in the first.
    """
    d = facts.join(concepts, ["taxonomy", "concept"]).where(C("form").isin(*FACT_FORMS))
    main = facts.groupBy("cik").agg(F.max(C("taxonomy") == "us-gaap").alias("_main"))
    d = d.join(main, "cik").where((C("taxonomy") == "us-gaap") | ~C("_main"))
    months = duration_months(C("start"), C("end"))
    value = F.when(C("unit").contains("/shares"), C("val")).otherwise(C("val") / 1e6)
    return d.withColumn("duration_months", months).where(C("duration_months").isNotNull()).select(
        "cik", "canonical", "concept", "priority", C("end").alias("period_end"), "duration_months", value.alias("value"), "unit", "accn", "form", "filed"
    )


def balance_facts(facts: DataFrame, names: dict[str, str], currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    """First filing of each balance per filer, metric and date.

    Units count by the currency they begin with. Where a series has instants as well as durations only the instants
    stay; then the unit with the most facts stays (the first by name among equals).
    """
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    d = facts.withColumn("metric", m[C("concept")]).where(C("metric").isNotNull() & C("unit").rlike("^(" + "|".join(currencies) + ")") & C("end").isNotNull())
    k = ["cik", "metric"]
    d = d.join(d.groupBy(*k).agg(F.max(C("start").isNull()).alias("_instants")), k).where(C("start").isNull() | ~C("_instants"))
    units = d.groupBy(*k, "unit").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(units.groupBy(*k).agg(F.min_by("unit", F.struct(-C("_n"), C("unit"))).alias("unit")), [*k, "unit"])
    g = d.groupBy(*k, "unit", "end").agg(F.min(F.struct("filed", "accn", "val")).alias("r"))
    return g.select("cik", "metric", C("end").alias("period_end"), C("r.val").alias("value"), C("r.filed").alias("filed"), "unit")


def filing_index(docs: DataFrame, body: str) -> DataFrame:
    """Parallel arrays of a filing index to one row per filing."""
    cols = "accessionNumber filingDate form primaryDocument items".split()
    s = "struct<cik:int,recent:struct<" + ",".join(f"{c}:array<string>" for c in cols) + ">>"
    d = docs.select(F.from_json(C(body), s).alias("j"))
    z = F.arrays_zip(*[C(f"j.recent.{c}") for c in cols])
    return d.select(C("j.cik").alias("cik"), F.inline(z)).withColumn("filingDate", C("filingDate").cast("date"))


CONTEXTS = (
    "context:array<struct<_id:string,entity:struct<segment:struct<explicitMember:array<struct<_dimension:string,_VALUE:string>>>>,"
    "period:struct<instant:date,startDate:date,endDate:date>>>"
)


def dimensional_facts(docs: DataFrame, key: str, body: str, concepts: dict[str, str]) -> DataFrame:
    """Instance documents: contexts joined to facts cut by reportable axes; distinct rows.

    The operating-segments qualifier adds nothing and is dropped. A fact whose only axis is then consolidation, and
    whose member is no subtotal, is the reconciling row 'All Other' of the segments; beside another axis, or on an axis
    that is not listed, the fact is left out, as are instants. A context's facts and members stay in their document,
    so they are matched inside the document's row.
    """
    one = "array<struct<_contextRef:string,_VALUE:double>>"
    xml = lambda schema: F.from_xml(C(body), f"struct<{schema}>", {"ignoreNamespace": "true"})
    # contexts are read apart from the facts: a figure that is no number ends the reading of the facts only
    d = docs.select(key, xml(CONTEXTS).alias("x"), xml(",".join(f"{c}:{one}" for c in concepts)).alias("y"))
    # a document's contexts and facts meet in its own row; rows of one key are put together first
    d = d.where(C(key).isNotNull()).select(key, "x.context", *[C(f"y.{c}").alias(f"f_{c}") for c in concepts])
    d = d.groupBy(key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("context", *[f"f_{c}" for c in concepts])])

    def named_as(metric: str):
        return lambda f: F.struct(f["_contextRef"].alias("ctx"), f["_VALUE"].alias("value"), F.lit(metric).alias("metric"))

    named_facts = [F.transform(f"f_{c}", named_as(metric)) for c, metric in concepts.items()]
    d = d.select(key, F.concat(*named_facts).alias("facts"), "context")
    d = d.select(key, F.inline("facts"), "context").where("ctx IS NOT NULL AND value IS NOT NULL")
    d = d.select(key, "ctx", "value", "metric", F.explode(F.filter("context", lambda x: x["_id"] == C("ctx"))).alias("x"))
    d = d.select(
        key, "ctx", "value", "metric", F.coalesce("x.period.instant", "x.period.endDate").alias("period_end"), C("x.period.startDate").alias("start"),
        F.coalesce(C("x.entity.segment.explicitMember"), F.array()).alias("dims"),
    )
    last = lambda x: F.regexp_extract(F.trim(x), r"([^:]+)$", 1)
    named = F.transform("dims", lambda m: F.struct(last(m["_dimension"]).alias("dim"), F.trim(m["_VALUE"]).alias("raw")))
    named = F.array_sort(F.filter(named, lambda m: ~((m["dim"] == CONSOLIDATION) & (last(m["raw"]) == OPERATING))))
    j = d.where(C("start").isNotNull()).withColumn("m", named)
    alone = (F.size("m") == 1) & (F.get("m", F.lit(0))["dim"] == CONSOLIDATION)
    j = j.withColumn("recon", alone & ~F.coalesce(last(F.get("m", F.lit(0))["raw"]).rlike(SUBTOTAL_MEMBERS), F.lit(False)))
    listed = F.create_map(*[F.lit(x) for kv in AXES.items() for x in kv])
    j = j.where(C("recon") | ((F.size("m") > 0) & ~F.exists("m", lambda x: listed[x["dim"]].isNull())))
    axis = F.when(C("recon"), "segment").otherwise(F.array_join(F.array_sort(F.transform("m", lambda x: listed[x["dim"]])), "+"))
    members = F.when(C("recon"), "All Other").otherwise(F.array_join(F.transform("m", lambda x: member_words(x["raw"])), "+"))
    j = j.select(
        key, "ctx", "metric", "period_end", duration_months(C("start"), C("period_end")).alias("duration_months"),
        axis.alias("axis"), members.alias("members"), (C("value") / 1e6).alias("value"),
    )
    rest = [c for c in j.columns if c != "ctx"]
    return j.groupBy(*rest).agg(F.min("ctx").alias("ctx"))


def member_labels(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Best label per member by role preference, '[Member]' or '[Domain]' off, labels that only name a subtotal skipped."""
    s = "struct<loc:array<struct<_label:string,_href:string>>,labelArc:array<struct<_from:string,_to:string>>,label:array<struct<_label:string,_role:string,_VALUE:string>>>"
    x = cut_lineage(docs.select(key, F.from_xml(C(body), s, {"ignoreNamespace": "true"}).alias("x")))  # parsed once for three readers
    loc = x.select(key, F.inline("x.loc")).select(key, C("_label").alias("l"), F.regexp_extract("_href", r"#(.+)$", 1).alias("member"))
    arc = x.select(key, F.inline("x.labelArc")).select(key, C("_from").alias("l"), C("_to").alias("t"))
    lab = x.select(key, F.inline("x.label")).select(
        key, C("_label").alias("t"), F.regexp_extract("_role", r"([^/]+)$", 1).alias("role"), F.trim(F.regexp_replace(F.trim("_VALUE"), r"\s*\[(Member|Domain)\]$", "")).alias("label")
    )
    rank = F.array_position(F.array(*[F.lit(r) for r in LABEL_ROLES]), C("role"))
    d = loc.join(arc, [key, "l"]).join(lab, [key, "t"]).withColumn("rank", rank).where((C("rank") > 0) & (C("label") != "") & ~C("label").rlike(SUBTOTAL_LABELS))
    return d.groupBy(key, "member").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))


def fund_holdings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Fund report to one row per position: names, identifiers, amounts, categories, with the report's date, series and assets."""
    row = (
        "struct<name:string,title:string,cusip:string,identifiers:struct<isin:struct<at_value:string>,ticker:struct<at_value:string>>,balance:double,units:string,"
        "valUSD:double,pctVal:double,assetCat:string,issuerCat:string,invCountry:string>"
    )
    s = f"struct<genInfo:struct<repPdDate:date,seriesName:string>,fundInfo:struct<netAssets:double>,invstOrSecs:struct<invstOrSec:array<{row}>>>"
    x = docs.select(key, F.from_xml(C(body), s, {"ignoreNamespace": "true", "attributePrefix": "at_"}).alias("x"))
    x = x.select(key, C("x.genInfo.repPdDate").alias("report_date"), C("x.genInfo.seriesName").alias("series"), C("x.fundInfo.netAssets").alias("net_assets"), F.inline("x.invstOrSecs.invstOrSec"))
    return x.withColumns({"isin": C("identifiers.isin.at_value"), "ticker": C("identifiers.ticker.at_value")}).drop("identifiers")


def last_log_records(lines: DataFrame, line: str, line_no: str, schema: str, record_key: str = "accn") -> DataFrame:
    """Log of JSON lines: unreadable lines skipped, the last record per key wins, with every field of ``schema``."""
    d = lines.select(line_no, F.from_json(C(line), schema).alias("r")).where(C(f"r.{record_key}").isNotNull())
    return d.groupBy(C(f"r.{record_key}").alias("_k")).agg(F.max_by("r", line_no).alias("r")).select("r.*")


def wide_prices(df: DataFrame, date: str = "date") -> DataFrame:
    """A wide price table (a date column and one column per ticker) to (date, ticker, px), empty cells dropped."""
    tickers = [c for c in df.columns if c != date]
    return df.unpivot(date, tickers, "ticker", "px").where(C("px").isNotNull())


def members_of_page(text: Column) -> Column:
    """Ticker symbols of the Components section of an index page, once each: bullets that end a name with the symbol in
    parentheses, and table rows with the symbol in one of the first three cells, bare or in a listing template."""
    heading = r"^={2,3}[^=\n][^\n]*?={2,3}\s*$"
    section = F.regexp_extract(text, rf"(?m)^==\s*Components\s*==\s*$([\s\S]*?)(?={heading}|\z)", 1)
    bullets = F.regexp_extract_all(section, F.lit(rf"(?m)^[*#][^\n]*?\(\s*(?:\[\[)?({SYMBOL})(?:\]\])?\s*\)"), F.lit(1))

    def symbol(row: Column) -> Column:
        cells = F.transform(F.slice(F.split(row, r"\|\|"), 1, 3), lambda c: F.regexp_replace(F.trim(c), r"\{\{\s*(?:NASDAQ|Nasdaq|nasdaq)\s*\|\s*([A-Z.]+)\s*\}\}", "$1"))
        return F.get(F.filter(cells, lambda c: c.rlike(f"^{SYMBOL}$")), F.lit(0))

    rows = F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^\|(?!-)(.*)$"), F.lit(1)), symbol)
    return F.array_distinct(F.concat(bullets, F.array_compact(rows)))


def carried_members(pages: DataFrame, keys: Sequence[str], order: str, text: str, least: int = 90) -> DataFrame:
    """Member list per date; a page with too few members takes the list of the date before."""
    d = pages.withColumn("_m", members_of_page(C(text)))
    d = d.withColumn("_m", F.when(F.size("_m") >= least, C("_m")))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("members", F.last("_m", ignorenulls=True).over(w)).select(*keys, order, "members")


def listing_kinds(df: DataFrame, symbol: str, name: str, etf: str, test: str) -> DataFrame:
    """Exchange listing rows as fund, common share or other; test issues and rows without a symbol are left out."""
    kind = F.when(C(etf) == "Y", "etf").when(F.coalesce(C(name), F.lit("")).rlike(OTHER_SECURITIES), "other").otherwise("common")
    return df.where((C(test) == "N") & C(symbol).isNotNull()).select(C(symbol).alias("symbol"), kind.alias("kind"))


def share_counts(frames: DataFrame) -> DataFrame:
    """One positive share count per filer and date by source priority."""
    d = frames.where(C("val") > 0)
    return d.groupBy("cik", "end").agg(F.min_by(F.struct(C("val").alias("shares"), "prio"), F.struct("prio", "accn")).alias("r")).select("cik", "end", "r.shares", "r.prio")


def listed_profile(df: DataFrame, first: str, last: str, start: str, end: str) -> DataFrame:
    """Counts of listings, of those that ended before a date and of those that began before one."""
    return df.agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(C(last) < F.lit(end).cast("date")).alias("ended"),
        F.count_if(C(first) < F.lit(start).cast("date")).alias("started"),
    )


def publish(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> str:
    """Writes a screen as one snapshot of its run date, beside the earlier ones."""
    target = f"{path}/run_date={run_date}"
    df.write.mode("overwrite").format(fmt).option("header", "true").save(target)
    return target
