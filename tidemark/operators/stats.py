"""Cross-sectional tests: rank correlations by cohort, bucket spreads, residuals, seeded placebo draws.

Cohorts may hold any number of rows: ranks and positions come from ``ranks``, which never sorts a whole cohort in one
task. Draws are rows, not loops: a draw is ordered by the hash of (seed, draw, id), so any engine can replay it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators import ranks as R
from tidemark.operators.draws import cross_sums
from tidemark.session import cut_lineage

C = F.col


def safe_corr(a: str, b: str) -> Column:
    """Correlation, null where either side does not vary."""
    return F.when((F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.corr(a, b))


def rank_in(value: Column, keys: Sequence[str]) -> Column:
    """Average rank inside a small group, such as one pair's quarters."""
    tied = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / 2


def cohort_ic(
    df: DataFrame, keys: Sequence[str], sig: str, ret: str, min_n: int = 6, min_distinct: int = 3
) -> DataFrame:
    """Spearman correlation of signal and return per cohort: keys, n, ic."""
    d = df.where(C(sig).isNotNull() & C(ret).isNotNull()).select(*keys, sig, ret)
    d = R.average_rank(d, keys, sig, "_rs")
    d = R.average_rank(d, keys, ret, "_rr")
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr("_rs", "_rr").alias("ic"), F.countDistinct(sig).alias("_k")
    )
    return g.where((C("n") >= min_n) & (C("_k") >= min_distinct)).drop("_k")


def summarise(series: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Mean, standard deviation, t-statistic and positive share of a per-cohort series."""
    g = series.where(C(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.avg((C(value) > 0).cast("double")).alias("positive_share"),
    )
    t = C("mean") / F.nullif(C("sd") / F.sqrt(C("cohorts")), F.lit(0.0))
    return g.where(C("cohorts") >= least).withColumn("t", t)


def bucketed(df: DataFrame, keys: Sequence[str], sig: str, tie: str, buckets: int = 5) -> DataFrame:
    """Adds the equal-count bucket (0-based) of the signal in its cohort, ties broken by ``tie``, and the cohort size."""
    d = df.where(C(sig).isNotNull())
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return R.position(d, keys, sig, tie, "_p").join(n, list(keys)).withColumn(
        "bucket", R.quantile_bucket(C("_p"), C("n"), buckets)
    ).drop("_p")


def quantile_spread(
    df: DataFrame, keys: Sequence[str], sig: str, ret: str, tie: str, buckets: int = 5, min_n: int = 10
) -> DataFrame:
    """Mean return per bucket and top minus bottom, one row per cohort."""
    d = bucketed(df.where(C(ret).isNotNull()), keys, sig, tie, buckets)
    means = [F.avg(F.when(C("bucket") == i, C(ret))).alias(f"q{i + 1}") for i in range(buckets)]
    g = d.where(C("n") >= min_n).groupBy(*keys).agg(F.max("n").alias("n"), *means)
    return g.withColumn("spread", C(f"q{buckets}") - C("q1"))


def residualise(df: DataFrame, keys: Sequence[str], sig: str, ctrl: str, out: str, min_n: int = 6) -> DataFrame:
    """Percentile-rank residual of the signal on the control, cohort by cohort."""
    d = df.where(C(sig).isNotNull() & C(ctrl).isNotNull())
    d = R.average_rank(d, keys, sig, "_y", size="_n")
    d = R.average_rank(d, keys, ctrl, "_x").withColumn("_y", C("_y") / C("_n")).withColumn("_x", C("_x") / C("_n"))
    line = d.groupBy(*keys).agg(
        F.when(F.max("_x") > F.min("_x"), F.covar_samp("_y", "_x") / F.nullif(F.var_samp("_x"), F.lit(0.0))).alias("_b"),
        F.avg("_y").alias("_my"),
        F.avg("_x").alias("_mx"),
    )
    d = d.join(line, list(keys)).where(C("_n") >= min_n)
    return d.withColumn(out, C("_y") - (C("_b") * (C("_x") - C("_mx")) + C("_my"))).drop(
        "_y", "_x", "_n", "_b", "_my", "_mx"
    )


def newey_west(series: DataFrame, keys: Sequence[str], order: str, value: str, lag: int) -> DataFrame:
    """t-statistic of the mean with overlapping-window errors; the series has one row per cohort."""
    keys = list(keys)
    d = series.where(C(value).isNotNull())
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(order)
    d = d.withColumn("_e", C(value) - F.avg(value).over(whole))
    terms = [F.sum(C("_e") * C("_e")).alias("_g0")]
    for i in range(1, lag + 1):
        d = d.withColumn(f"_l{i}", C("_e") * F.lag("_e", i).over(w))
        terms.append(F.coalesce(F.sum(f"_l{i}"), F.lit(0.0)).alias(f"_g{i}"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *terms)
    var = C("_g0") / C("n")
    for i in range(1, lag + 1):
        var = var + F.lit(2 * (1 - i / (lag + 1))) * C(f"_g{i}") / C("n")
    g = g.withColumn("_v", var)
    t = F.when((C("n") >= 4) & (C("_v") > 0), C("mean") / F.sqrt(C("_v") / C("n")))
    return g.select(*keys, "n", "mean", t.alias("t_nw"))


def draw_hash(seed: int, draw: Column, *ids: Column) -> Column:
    """First 32 bits of md5(seed-draw-id...) as a double: the order of a draw."""
    text = F.concat_ws("-", F.lit(str(seed)), draw.cast("string"), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def permuted(df: DataFrame, keys: Sequence[str], id_: str, value: str, draws: int, seed: int, out: str) -> DataFrame:
    """Every draw's shuffle of ``value`` inside its cohort: df's rows times draws, with the shuffled value in ``out``.

    The row at place p by the draw's hash receives the value of the row at place p by id. Draws are made inside the
    tasks; one shuffle by (cohort, draw) orders them, so a large cohort spreads over as many groups as there are draws.
    """
    keys = list(keys)
    base = R.position(df, keys, id_, id_, "_p").select(*keys, "_p", C(value).alias(out))
    d = with_draws(df, draws).withColumn("_h", draw_hash(seed, C("draw"), *[C(k) for k in keys], C(id_)))
    d = d.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "draw").orderBy("_h", id_)))
    return d.join(base, [*keys, "_p"]).drop("_p", "_h")


#: Names of a cohort up to which a task orders its draws; larger cohorts go through a shuffle by (cohort, draw).
MOST_NAMES = 2_000_000
_DRAWS_A_BLOCK = 100


def permuted_products(df: DataFrame, keys: Sequence[str], id_: str, base: str, value: str, draws: int, seed: int, most: int = MOST_NAMES) -> DataFrame:
    """Per cohort and draw: ``cross``, the sum of ``value`` times the shuffled ``base``.

    A cohort's names are sent out once per block of draws, blocks are dealt over the tasks, and a task orders each of its
    draws in place by :func:`draw_hash`, so that one number per (cohort, draw) is all that leaves it. Cohorts of more than
    ``most`` names take :func:`permuted` instead; the draws, and so the results, are the same.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(C("_n") > most).select(*keys)
    rows = df
    if not big.isEmpty():
        rows = df.join(big, keys, "left_anti")
        drawn = permuted(df.join(big, keys, "left_semi"), keys, id_, base, draws, seed, "_pb")
        over = drawn.groupBy(*keys, "draw").agg(F.sum(C("_pb") * C(value)).alias("cross"))
    tail = F.concat(F.concat_ws("-", F.lit(""), *[C(k).cast("string") for k in keys]), F.lit("-"))
    d = rows.select(
        *keys, C(id_).alias("i"), C(id_).cast("string").alias("text"), tail.alias("tail"), C(base).cast("double").alias("b"), C(value).cast("double").alias("v"),
        F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // _DRAWS_A_BLOCK))).alias("_k"),
    )
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("draw", T.IntegerType()), T.StructField("cross", T.DoubleType())])

    def cross(block: pa.Table) -> pa.Table:
        some = range(block["_k"][0].as_py() * _DRAWS_A_BLOCK, min((block["_k"][0].as_py() + 1) * _DRAWS_A_BLOCK, draws))
        cohort = [pa.array([block[k][0].as_py()] * len(some), block.schema.field(k).type) for k in keys]
        return pa.table([*cohort, pa.array(some, pa.int32()), pa.array(cross_sums(block, some, seed), pa.float64())], names=[*keys, "draw", "cross"])

    # a few rows stand for many draws: deal blocks by number, not by their bytes
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, *keys, "_k").groupBy(*keys, "_k").applyInArrow(cross, schema)
    return d if rows is df else d.unionByName(over.select(*keys, "draw", "cross"))


def _placebo_p(mean: DataFrame, obs: DataFrame) -> DataFrame:
    return mean.withColumn("obs", obs.scalar()).agg(
        F.max("obs").alias("obs"),
        F.count(F.lit(1)).alias("draws"),
        ((F.count_if(C("m") >= C("obs")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )


def permutation_test(
    df: DataFrame, keys: Sequence[str], id_: str, sig: str, ret: str, draws: int = 2000, seed: int = 7, least: int = 20, values: int = 3
) -> DataFrame:
    """Observed mean cohort correlation and its placebo p: shuffles within the cohort that do as well, plus one.

    Cohorts of fewer than ``least`` names or ``values`` different signals are left out of both.
    """
    keys = list(keys)
    d = df.where(C(sig).isNotNull() & C(ret).isNotNull())
    usable = d.groupBy(*keys, sig).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_v"))
    d = d.join(usable.where((C("_n") >= least) & (C("_v") >= values)).select(*keys), keys, "left_semi")
    d = R.average_rank(d, keys, sig, "_rs")
    d = R.average_rank(d, keys, ret, "_rr")
    d = d.select(*keys, id_, "_rs", "_rr")
    d = cut_lineage(d)
    spread = lambda x: F.sqrt(F.sum(C(x) * C(x)) - F.count(F.lit(1)) * F.avg(x) * F.avg(x))
    level = (F.count(F.lit(1)) * F.avg("_rs") * F.avg("_rr")).alias("level")
    per = d.groupBy(*keys).agg(F.sum(C("_rs") * C("_rr")).alias("cross"), level, (spread("_rs") * spread("_rr")).alias("scale"))
    ic = (C("cross") - C("level")) / F.nullif(C("scale"), F.lit(0.0))
    obs = per.agg(F.round(F.avg(ic), 12).alias("obs"))
    drawn = permuted_products(d, keys, id_, "_rs", "_rr", draws, seed)
    mean = drawn.join(per.drop("cross"), keys).groupBy("draw").agg(F.round(F.avg(ic), 12).alias("m"))
    return _placebo_p(mean, obs)


def gate_test(
    df: DataFrame, keys: Sequence[str], id_: str, gate: str, ret: str, draws: int = 2000, seed: int = 7
) -> DataFrame:
    """Gated minus the rest per cohort, averaged, against shuffles of the gate within each usable cohort."""
    keys = list(keys)
    d = df.where(C(ret).isNotNull()).withColumn("_g", F.coalesce(C(gate), F.lit(False)).cast("int"))

    def diff(flag: str) -> Column:
        return F.avg(F.when(C(flag) == 1, C(ret))) - F.avg(F.when(C(flag) == 0, C(ret)))

    per = d.groupBy(*keys).agg(
        F.sum("_g").alias("n_gate"), F.sum(1 - C("_g")).alias("n_rest"), diff("_g").alias("diff")
    )
    per = per.where((C("n_gate") >= 2) & (C("n_rest") >= 5))
    use = d.join(per.select(*keys), keys, "left_semi").select(*keys, id_, "_g", ret)
    use = cut_lineage(use)
    drawn = permuted_products(use, keys, id_, "_g", ret, draws, seed)
    whole = use.groupBy(*keys).agg(F.sum(ret).alias("_s"), F.sum("_g").alias("_a"), F.sum(1 - C("_g")).alias("_b"))
    shift = C("cross") / C("_a") - (C("_s") - C("cross")) / C("_b")
    mean = drawn.join(whole, keys).groupBy("draw").agg(F.round(F.avg(shift), 12).alias("m"))
    return _placebo_p(mean, per.agg(F.round(F.avg("diff"), 12).alias("obs")))


def value_quantiles(df: DataFrame, value: str, outcome: str, buckets: int = 5) -> DataFrame:
    """Right-closed buckets cut at the exact percentiles of the value, with each bucket's outcome."""
    probs = {f"e{i}": i / buckets for i in range(1, buckets)}
    edges = R.percentiles(df, [], value, probs).select(F.array(*probs).alias("e"))
    d = df.withColumn("_e", edges.scalar())
    d = d.withColumn("bucket", F.size(F.filter("_e", lambda e: C(value) > e)) + 1)
    base = d.groupBy("bucket").agg(
        F.avg(value).alias("z_mean"),
        F.avg(outcome).alias("mean"),
        F.avg((C(outcome) > 0).cast("double")).alias("hit"),
        F.count(F.lit(1)).alias("rows"),
    )
    return base.join(R.percentiles(d, ["bucket"], outcome, {"median": 0.5}).drop("n"), "bucket")


def _det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = None
    for j in range(len(m)):
        minor = [[row[k] for k in range(len(m)) if k != j] for row in m[1:]]
        term = m[0][j] * _det(minor)
        total = term if total is None else (total + term if j % 2 == 0 else total - term)
    return total


def pooled_r2(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """R-squared of y on a few regressors over complete rows: one aggregation, 1 - det(corr all) / det(corr xs)."""
    names = [y, *xs]
    d = df
    for c in names:
        d = d.where(C(c).isNotNull())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    g = d.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"_{a}_{b}") for a, b in pairs])

    def m(cols):
        def at(a, b):
            if a == b:
                return F.lit(1.0)
            return C(f"_{a}_{b}") if (a, b) in pairs else C(f"_{b}_{a}")

        return [[at(a, b) for b in cols] for a in cols]

    return g.select("n", (1 - _det(m(names)) / _det(m(list(xs)))).alias("r2"))


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t-statistic with whole degrees of freedom (null in, null out; null below one degree).

    With a = atan(t / sqrt(df)) the mass between -t and t is a finite sum of powers of cos(a)^2: each term is the one
    before times cos(a)^2 and a ratio of two successive whole numbers.
    """
    n = F.floor(df).cast("int")
    even = n % 2 == 0
    a = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    c2 = F.cos(a) * F.cos(a)
    terms = F.when(even, n / 2).otherwise((n - 1) / 2).cast("int")
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))

    def step(x: Column, k: Column) -> Column:
        ratio = F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        return state(x["term"] * c2 * ratio, x["total"] + x["term"])

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), state(F.lit(1.0), F.lit(0.0)), step)["total"]
    inside = F.when(even, F.sin(a) * total).otherwise((a + F.sin(a) * F.cos(a) * total) * 2 / math.pi)
    return F.when((n >= 1) & t.isNotNull() & ~F.isnan(t), F.greatest(1 - inside, F.lit(0.0)))
