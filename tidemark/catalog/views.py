"""Shared inputs: the given tables seen as filers, segments, balances, printings, prices and releases.

Each view exists twice with the same name: as a DataFrame function here and as SQL text for the check. Sums of money
are rounded to the decimals their exact values have, so both engines start from identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.dates import quarter_ordinal

VIEW_SQL: dict[str, str] = {
    "fq_rev": """
SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS INT) AS qn,
       round(sum(l_extendedprice*(1-l_discount)), 4) AS rev
FROM lineitem GROUP BY 1, 2""",
    "fq_seg": """
SELECT CAST(l_suppkey AS INT) AS cik, l_returnflag AS segment,
       CAST(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS INT) AS qn,
       round(sum(l_extendedprice*(1-l_discount)), 4) AS rev
FROM lineitem GROUP BY 1, 2, 3""",
    "fq_gap": "SELECT * FROM fq_rev WHERE (cik*31 + qn*17) % 11 <> 0",
    "fq_bal": """
SELECT CAST(l_suppkey AS INT) AS cik, CAST(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS INT) AS qn,
       round(sum(round(l_extendedprice*l_quantity, 2)), 2) AS rpo
FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2""",
    "vintages": """
SELECT CAST(l_partkey AS INT) AS key_id, CAST(l_linenumber AS INT) AS duration_code, l_extendedprice AS value,
       CAST(l_shipdate AS DATE) AS filed, l_orderkey AS accn FROM lineitem""",
    "px": """
SELECT CAST(n_regionkey AS INT) AS ticker, CAST(l_shipdate AS DATE) AS d,
       round(sum(l_extendedprice), 2) / sum(l_quantity) AS px
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "releases": """
SELECT CAST(o_orderkey AS INT) AS accn, CAST(o_custkey % 100 AS INT) AS cik, CAST(o_orderdate AS DATE) AS filed,
       o_totalprice AS guide_mid, o_orderstatus AS form FROM orders""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _net() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def fq_rev(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("int").alias("cik"), quarter_ordinal(F.col("l_shipdate")).alias("qn"))
        .agg(F.round(F.sum(_net()), 4).alias("rev"))
    )


def fq_seg(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("int").alias("cik"),
            F.col("l_returnflag").alias("segment"),
            quarter_ordinal(F.col("l_shipdate")).alias("qn"),
        )
        .agg(F.round(F.sum(_net()), 4).alias("rev"))
    )


def fq_gap(spark: SparkSession, sf: str) -> DataFrame:
    return fq_rev(spark, sf).where((F.col("cik") * 31 + F.col("qn") * 17) % 11 != 0)


def fq_bal(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_linestatus") == "O")
        .groupBy(F.col("l_suppkey").cast("int").alias("cik"), quarter_ordinal(F.col("l_shipdate")).alias("qn"))
        .agg(F.round(F.sum(F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2)), 2).alias("rpo"))
    )


def vintages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("int").alias("key_id"),
        F.col("l_linenumber").cast("int").alias("duration_code"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_shipdate").cast("date").alias("filed"),
        F.col("l_orderkey").alias("accn"),
    )


def px(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").cast("int").alias("ticker"), F.col("l_shipdate").cast("date").alias("d"))
        .agg((F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("px"))
    )


def releases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("accn"),
        (F.col("o_custkey") % 100).cast("int").alias("cik"),
        F.col("o_orderdate").cast("date").alias("filed"),
        F.col("o_totalprice").alias("guide_mid"),
        F.col("o_orderstatus").alias("form"),
    )


VIEW_SQL["study"] = """
SELECT a.cik, a.qn AS cohort, round(a.rev / b.rev - 1, 2) AS sig, round(n.rev / a.rev - 1, 6) AS ret, round(a.rev / p.rev - 1, 6) AS ctrl, a.rev AS size
FROM fq_rev a JOIN fq_rev b ON a.cik = b.cik AND a.qn = b.qn + 4 JOIN fq_rev n ON a.cik = n.cik AND n.qn = a.qn + 1
JOIN fq_rev p ON a.cik = p.cik AND p.qn = a.qn - 1"""


def study(spark: SparkSession, sf: str) -> DataFrame:
    """Signal (growth a year), next-quarter return and a control per filer and quarterly cohort."""
    from tidemark.operators.windows import period_offset

    d = fq_rev(spark, sf)
    k = ["cik"]
    r = F.col("rev")
    d = d.select(
        "cik",
        F.col("qn").alias("cohort"),
        F.round(r / period_offset(r, k, "qn", 4) - 1, 2).alias("sig"),
        F.round(period_offset(r, k, "qn", -1) / r - 1, 6).alias("ret"),
        F.round(r / period_offset(r, k, "qn", 1) - 1, 6).alias("ctrl"),
        r.alias("size"),
    )
    return d.where("sig IS NOT NULL AND ret IS NOT NULL AND ctrl IS NOT NULL")
