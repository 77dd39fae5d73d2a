"""Incremental jobs: dedupe on arrival, alert spacing, latest states, refreshed counts, vintages.

State that must be joined is kept as a table of snapshots, one folder per micro-batch. A batch reads the snapshot of the
batch before it and overwrites its own, so a batch that runs again gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import episodes as E
from tidemark.session import checkpoint_dir

C = F.col


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Works off everything that has arrived, then stops."""
    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


class Snapshots:
    """A small table with one version per micro-batch, found again in its folder after a restart.

    Versions are written as partitions ``v``; a batch that runs again overwrites its own. A batch that was cut short is
    run again by the stream before anything is read, so the newest version is always a whole one.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def before(self, batch: int) -> DataFrame:
        if batch <= 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={batch - 1}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={batch}")

    def current(self) -> DataFrame:
        """The newest version; an empty table where no batch ever ran."""
        try:
            versions = self.spark.read.schema(f"{self.schema}, v int").parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.before(0)
        newest = versions.agg(F.max("v")).first()[0]
        return self.before(0) if newest is None else self.before(newest + 1)


class Buckets:
    """A keyed table in hash buckets of which a batch rewrites only those that it touches.

    A batch writes its buckets below ``rows/v=<batch>`` and then a manifest: the version that holds each bucket. It reads the
    manifest of the batch before it, so a batch that runs again, or was cut short, starts from the same table and
    overwrites its own files. Buckets that neither of the last two manifests names are removed. Choose ``buckets`` so that one
    fits a task; the driver holds one number per bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, batch: int) -> dict[int, int]:
        """Version of each bucket after a batch; none before the first."""
        if batch < 0:
            return {}
        m = self.spark.read.schema("b int, version int").parquet(f"{self.folder}/manifest/v={batch}")
        return {r["b"]: r["version"] for r in m.collect()}

    def rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/rows/v={v}/b={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, n: int) -> None:
        """New rows replace stored rows of the same key; at most one new row per key."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch")  # read three times below, computed once
        batch = self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch")
        touched = [r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # one per bucket at most
        before = self.versions(n - 1)
        old = self.rows({b: before[b] for b in touched if b in before})
        new = old.join(batch.select(*self.keys), self.keys, "left_anti").unionByName(batch).withColumn("b", self.bucket())
        if touched:
            new.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.folder}/rows/v={n}")
        m = self.spark.createDataFrame(sorted((before | dict.fromkeys(touched, n)).items()), "b int, version int")
        m.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={n}")
        self._remove(self.versions(n - 2), before)

    def _remove(self, older: dict[int, int], kept: dict[int, int]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for b, v in older.items():
            if kept[b] != v:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows/v={v}/b={b}")
                path.getFileSystem(conf).delete(path, True)

    def current(self) -> DataFrame:
        """The table after the newest batch; empty where none ever ran."""
        try:
            m = self.spark.read.schema("b int, version int, v int").parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.rows({})
        newest = m.agg(F.max("v")).first()[0]
        return self.rows({} if newest is None else self.versions(newest))


def new_releases(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Each key once, as it first arrives, however much later it comes again.

    The keys handed out so far are the earlier batches' own output; a batch appends its new keys and rewrites nothing.
    """
    spark = stream.sparkSession
    schema = f"{key} {dict(stream.dtypes)[key]}"

    def each(batch: DataFrame, n: int) -> None:
        fresh = batch.select(key).distinct()
        if n > 0:
            seen = spark.read.schema(f"{schema}, v int").parquet(f"{folder}/out").where(C("v") < n).select(key)
            fresh = fresh.join(seen, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/out/v={n}")

    run_batches(stream, each, folder)
    return spark.read.schema(f"{schema}, v int").parquet(f"{folder}/out").select(key)


def alert_suppression(stream: DataFrame, keys: Sequence[str], pos: str, spacing: int, folder: str) -> DataFrame:
    """Alerts per key at least ``spacing`` positions after the key's last alert, over any number of batches.

    A batch is reduced to distinct (key, position) first. The stored last alert joins as the first position of its key,
    so it is picked as a start again and dropped.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, pos])
    state = Snapshots(spark, f"{folder}/state", schema)

    def each(batch: DataFrame, n: int) -> None:
        old = state.before(n)
        fresh = batch.select(*keys, pos).distinct()
        late = fresh.join(old.withColumnRenamed(pos, "_last"), list(keys), "left").where(
            C("_last").isNull() | (C(pos) > C("_last"))
        )
        runs = E.starts(late.select(*keys, pos).unionByName(old), keys, pos, F.lit(True), spacing)
        out = runs.join(old, [*keys, pos], "left_anti")
        out.write.mode("overwrite").parquet(f"{folder}/alerts/v={n}")
        newest = spark.read.schema(schema).parquet(f"{folder}/alerts/v={n}").unionByName(old)
        state.write(newest.groupBy(*keys).agg(F.max(pos).alias(pos)), n)

    run_batches(stream, each, folder)
    return spark.read.parquet(f"{folder}/alerts").select(*keys, pos)


def latest_state(stream: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], folder: str) -> DataFrame:
    """Newest value per key, a streaming aggregation whose changed keys replace the stored ones."""
    agg = stream.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_m"))
    flat = agg.select(*keys, C(f"_m.{value}").alias(value), *[C(f"_m.{o}").alias(o) for o in order])
    return upsert_stream(flat, keys, folder, mode="update")


def latest_vintage(stream: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], folder: str) -> DataFrame:
    """First and latest printing per key: a new printing can move the latest, never the first."""
    row = F.struct(*order, value)
    agg = stream.groupBy(*keys).agg(F.min(row).alias("_a"), F.max(row).alias("_b"))
    flat = agg.select(*keys, C(f"_a.{value}").alias("first"), C(f"_b.{value}").alias("latest"))
    return upsert_stream(flat, keys, folder, mode="update")


def upsert_stream(stream: DataFrame, keys: Sequence[str], folder: str, mode: str = "append") -> DataFrame:
    """New rows replace stored rows of the same key; the rest stays, and so do the buckets that no new row falls in."""
    schema = ", ".join(f"{c} {t}" for c, t in stream.dtypes)
    table = Buckets(stream.sparkSession, f"{folder}/table", schema, keys)
    run_batches(stream, table.upsert, folder, mode)
    return table.current()


def breadth_counts(stream: DataFrame, day: Column, low: Column, high: Column, folder: str) -> DataFrame:
    """Daily counts kept up to date: a refreshed day replaces the stored one."""
    daily = stream.groupBy(day.alias("day")).agg(
        F.count_if(low).alias("nl"), F.count_if(high).alias("nh"), F.count(F.lit(1)).alias("n")
    )
    return upsert_stream(daily, ["day"], folder, mode="update")


def breadth_state(counts: DataFrame, span: int, on_above: float, off_below: float) -> DataFrame:
    """Smoothed share of new lows less new highs and the on/off state of each day. One row per day."""
    d = counts.withColumn("market", F.lit("all")).withColumn("x", (C("nl") - C("nh")) / F.nullif(C("n"), F.lit(0)))
    d = E.ewma(d.where(C("x").isNotNull()), ["market"], "day", "x", span, "line").withColumn("line", F.round("line", 9))
    return E.on_off_state(d, ["market"], "day", C("line") > on_above, C("line") < off_below)


def new_entries(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names of the current list that were not on the previous one."""
    return current.join(previous.select(*keys), list(keys), "left_anti")
