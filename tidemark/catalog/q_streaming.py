"""Incremental queries over the events table read as a file stream, worked off with the availableNow trigger."""

from pyspark.sql import functions as F

from tidemark.catalog import views as V
from tidemark.catalog.registry import query
from tidemark.streaming import jobs as J

C = F.col


def events(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return J.file_stream(spark, f"{sf}/events*.parquet", schema)


def day_no():
    return F.datediff(C("ts").cast("date"), F.lit("2024-01-01").cast("date"))


@query("l01_incremental_dedupe", "SELECT DISTINCT event_id // 3 AS accn FROM events")
def l01(spark, sf):
    s = events(spark, sf).select(F.floor(C("event_id") / 3).alias("accn"))
    return J.new_releases(s, "accn", J.work_folder(spark, "l01"))


@query(
    "l02_alert_suppression",
    """WITH RECURSIVE hit AS (SELECT DISTINCT event_type, user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS pos FROM events),
wk AS (SELECT event_type, user_id, min(pos) AS pos FROM hit GROUP BY 1, 2
 UNION ALL SELECT w.event_type, w.user_id, (SELECT min(h.pos) FROM hit h WHERE h.event_type = w.event_type AND h.user_id = w.user_id AND h.pos >= w.pos + 5) FROM wk w WHERE w.pos IS NOT NULL)
SELECT event_type, user_id, pos FROM wk WHERE pos IS NOT NULL""",
)
def l02(spark, sf):
    s = events(spark, sf).select("event_type", "user_id", day_no().alias("pos"))
    return J.alert_suppression(s, ["event_type", "user_id"], "pos", 5, J.work_folder(spark, "l02"))


@query("l03_latest_event_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def l03(spark, sf):
    return J.latest_state(events(spark, sf), ["user_id"], "event_type", ["ts", "event_id"], J.work_folder(spark, "l03")).select(
        "user_id", "event_type"
    )


_CNT = "c AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS nl, count(*) FILTER (WHERE event_type = 'click') AS nh, count(*) AS n FROM events GROUP BY 1)"


def counts(spark, sf, name):
    return J.breadth_counts(
        events(spark, sf), C("ts").cast("date"), C("event_type") == "error", C("event_type") == "click", J.work_folder(spark, name)
    )


@query("l06_upsert_counts", f"WITH {_CNT} SELECT CAST(day AS VARCHAR) AS day, nl, nh, n FROM c")
def l06(spark, sf):
    return counts(spark, sf, "l06").withColumn("day", C("day").cast("string"))


@query(
    "l04_breadth_state",
    f"""WITH RECURSIVE {_CNT}, x AS (SELECT day, CAST(nl - nh AS DOUBLE) / n AS x, row_number() OVER (ORDER BY day) AS i FROM c),
e AS (SELECT day, i, x AS y FROM x WHERE i = 1 UNION ALL SELECT x.day, x.i, 2.0/11 * x.x + (1 - 2.0/11) * e.y FROM e JOIN x ON x.i = e.i + 1),
r AS (SELECT day, i, round(y, 9) AS y FROM e),
s AS (SELECT day, i, y > 0.01 AS st FROM r WHERE i = 1 UNION ALL SELECT r.day, r.i, CASE WHEN NOT s.st THEN r.y > 0.01 ELSE NOT (r.y < 0.0) END FROM s JOIN r ON r.i = s.i + 1)
SELECT CAST(s.day AS VARCHAR) AS day, round(r.y, 6) AS line, CAST(st AS INT) AS is_on FROM s JOIN r USING (i)""",
)
def l04(spark, sf):
    d = J.breadth_state(counts(spark, sf, "l04"), 10, 0.01, 0.0)
    return d.select(C("day").cast("string").alias("day"), F.round("line", 6).alias("line"), C("on").cast("int").alias("is_on"))


@query("l05_latest_vintage_stream", "SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1")
def l05(spark, sf):
    return J.latest_vintage(events(spark, sf), ["user_id"], "value", ["ts", "event_id"], J.work_folder(spark, "l05"))


@query(
    "l07_new_list_entries",
    "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' AND event_type = 'purchase')",
)
def l07(spark, sf):
    e = V.table(spark, sf, "events")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    early = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    old = e.where((C("ts") < early) & (C("event_type") == "purchase")).select("user_id").distinct()
    return J.new_entries(e.where(C("ts") >= cut).select("user_id").distinct(), old, ["user_id"])
