"""WARC records against plain Python."""

import base64
import hashlib
import random

from tests.llm.cases import sentence
from tidemark.llm import lookup, warc

SCHEMA = "page_id long, url string, html string, n long, first string, digest string"


def pages():
    rng = random.Random(3)
    bodies = [f"<p>{sentence(rng, rng.randint(1, 60))}</p>" for _ in range(30)]
    fake = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies += [fake, "before " + fake, fake + fake + "after", fake + warc.MAGIC, warc.MAGIC, warc.MAGIC * 3, "\r\n\r\n" + warc.MAGIC + "\r\n\r\n", "tail" + fake[:-2]]
    bodies += [None, "", "\r\n\r\n", "é😀" * 50, "x" * 300000, bodies[3], bodies[3], bodies[4], "line\nline\r\n", None]
    rows = [(i * 3 + 7, f"http://h/{i}\r\nWARC-Type: x" if i % 7 == 0 else f"http://h/é{i}", t) for i, t in enumerate(bodies)]
    rows += [(1, None, bodies[5]), (1, "http://again", bodies[5]), (None, "http://null", bodies[6]), (None, None, "nobody else's"), (rows[2][0], "u", "other text")]
    return rows


def by_hand(rows, min_bytes):
    least = {}
    data = [(p, (t or "").encode()) for p, _, t in rows]
    for p, b in data:
        if p is not None and len(b) >= min_bytes:
            least[b] = min(p, least.get(b, p))
    out = []
    for p, b in data:
        of = least.get(b)
        of = None if of is None or of == p else of
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if of is not None else "response", of))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(p, u, t, 1, "f", "d") for p, u, t in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    rows = pages()
    for min_bytes in (0, 20):
        got = warc.round_trip(frame(spark, rows), min_bytes).collect()
        assert sorted(map(tuple, got), key=str) == by_hand(rows, min_bytes)
    assert warc.round_trip(frame(spark, rows).limit(0)).count() == 0


def test_small_byte_ranges_and_payloads(spark, tmp_path):
    """Records that lie across many byte ranges, several files, payloads with whole records inside."""
    rows = pages()
    warc.write_warc(frame(spark, rows), f"{tmp_path}/w", records_per_file=11)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = warc.read_warc(spark, f"{tmp_path}/w", payload=True).collect()
        plain = warc.read_warc(spark, f"{tmp_path}/w").drop("payload").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = by_hand(rows, 0)
    assert sorted([(r.page_id, r.length, r.digest, r.type, r.refers_to) for r in got], key=str) == want
    texts = {(p, t or "") for p, _, t in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.type == "response")
    assert all(bytes(r.payload) == b"" for r in got if r.type == "revisit")
    assert sorted([(r.page_id, r.sha1) for r in got], key=str) == sorted([(r.page_id, r.sha1) for r in plain], key=str)
    assert {r.uri for r in got if r.page_id == 7} == {"http://h/0%0D%0AWARC-Type: x"}


def test_reading_stops_at_a_cut_record(spark, tmp_path):
    warc.write_warc(frame(spark, pages()[:20]).coalesce(1), f"{tmp_path}/w")
    [name] = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(name.read_bytes()[:-30])
    assert warc.read_warc(spark, f"{tmp_path}/cut").count() == 19


def test_attach_beyond_the_broadcast_bound(spark):
    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 1, id)) AS k", "id")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", lookup.F.col("n") * 2)
    a = lookup.attach(rows, table, "k", "n").collect()
    b = lookup.attach(rows, table, "k", "n", most=10).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and len(a) == 6000 and all(r.v for r in a)
