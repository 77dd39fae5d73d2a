import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import ranks as R

ROWS = pd.DataFrame(
    {
        "k": ["a"] * 400 + ["b"] * 7,
        "id": range(407),
        # a third of the rows share one value; negatives, zeros and a wide range of sizes
        "v": [0.5] * 133 + list(np.round(np.linspace(-3, 4, 200), 2)) + [1e9, -1e9, 0.0, -0.0] + [1e-7 * i for i in range(63)] + [7.0, 1, 1, 3, 3, 3, -2],
    }
)


def test_average_rank_matches_pandas(spark):
    got = R.average_rank(spark.createDataFrame(ROWS), ["k"], "v", "r").orderBy("id").toPandas()
    assert np.allclose(got.r, ROWS.groupby("k").v.rank())


def test_position_breaks_ties_by_id(spark):
    got = R.position(spark.createDataFrame(ROWS), ["k"], "v", "id", "p").orderBy("id").toPandas()
    assert (got.p.to_numpy() == ROWS.groupby("k").v.rank(method="first").to_numpy()).all()


def test_percentiles_match_numpy(spark):
    got = R.percentiles(spark.createDataFrame(ROWS), ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).toPandas().set_index("k")
    for k, g in ROWS.groupby("k"):
        assert np.allclose(got.loc[k, ["p1", "p50", "p99"]].astype(float), np.percentile(g.v, [1, 50, 99]), rtol=1e-12)


def test_running_before_is_a_prefix_sum(spark):
    d = ROWS.assign(w=np.arange(len(ROWS)) % 5 + 1.0)
    got = R.running_before(spark.createDataFrame(d), ["k"], "v", "id", F.col("w"), "b").orderBy("id").toPandas()
    o = d.sort_values(["k", "v", "id"])
    want = (o.groupby("k").w.cumsum() - o.w).sort_index()
    assert np.allclose(got.b, want)


def test_quantile_bucket_equals_qcut(spark):
    for n in (7, 12, 23, 100):
        d = spark.range(1, n + 1).withColumn("n", F.lit(n))
        got = d.select("id", R.quantile_bucket(F.col("id"), F.col("n")).alias("q")).orderBy("id").toPandas().q
        assert (got.to_numpy() == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False).to_numpy()).all()


def test_values_close_together_spread_over_all_ranges(spark):
    n = 20000
    d = spark.range(n).select("id", F.lit("a").alias("k"), (1 + F.col("id") * 1e-10).alias("v"))
    ranges = R._dealt(d, ["k"], ["v", "id"]).groupBy("_range").count().toPandas()
    assert len(ranges) == int(spark.conf.get("spark.sql.shuffle.partitions")) and ranges["count"].max() < n / 2
    got = R.position(d, ["k"], "v", "id", "p").where("p != id + 1")
    assert got.count() == 0


def test_one_value_spreads_by_its_tie(spark):
    n = 20000
    d = spark.range(n).select("id", F.lit("a").alias("k"), F.lit(2.0).alias("v"))
    assert R._dealt(d, ["k"], ["v", "id"]).groupBy("_range").count().toPandas()["count"].max() < n / 2
    assert R.position(d, ["k"], "v", "id", "p").where("p != id + 1").count() == 0


def test_nulls_and_empty_groups(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), (None, 3, 1.0)], "k string, id int, v double")
    assert {r.id: r.p for r in R.position(d, ["k"], "v", "id", "p").collect()} == {1: None, 2: 1, 3: None}
    assert R.position(d.limit(0), ["k"], "v", "id", "p").count() == 0
