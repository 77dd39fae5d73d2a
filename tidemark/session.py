"""Session settings used by the bench and the tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "tidemark") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a fresh local folder serves a local master only; on a cluster the executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-ckpt-")
        _LOCAL[spark.sparkContext.applicationId] = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost executor cannot change or lose them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """As :func:`cut_lineage`, dealt by ``key``; later joins and groups on the key with as many partitions need no shuffle.

    A checkpoint keeps the partitioning that its plan names when it is taken, and an adaptive plan names none before it
    has run, so this one job is planned without.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(parts, key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by ``keys``, for expressions that cost far more than a row's bytes tell.

    The number of partitions is given, so that adaptive execution does not put small rows together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
