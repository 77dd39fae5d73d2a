"""Importance resampling against plain Python."""

import hashlib
import math
import re
from zlib import crc32

from pyspark.sql import functions as F

from tests.llm.cases import documents, empty
from tidemark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def by_hand(docs, target, words, buckets, seed, min_words, percent):
    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x, words)[1]:
                into[crc32(g.encode()) % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        w, f = grams(x, words)
        weight = sum(gain[crc32(g.encode()) % buckets] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k in range(len(able) * percent // 100):
        able[k][5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resample(spark):
    df = documents(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    target = df.where("doc_id % 4 = 1 OR doc_id IS NULL").withColumnRenamed("doc_id", "item_id")
    texts = [r.text for r in target.collect()]
    for words, buckets, percent in ((1, 10000, 10), (3, 97, 60), (2, 5000, 100)):
        got = resample.resample(df, target, "item_id", words, buckets, percent=percent).collect()
        assert sorted(map(tuple, got), key=str) == by_hand(docs, texts, words, buckets, 2024, 20, percent)
    got = resample.resample(df, target.limit(0), "item_id").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(docs, [], 1, 10000, 2024, 20, 10)
    assert resample.resample(empty(spark), target, "item_id").count() == 0


def test_equal_scores_are_ranked_by_id(spark):
    df = spark.range(40).select((F.col("id") * 2).alias("doc_id"), F.lit("a b c d e f g h i j " * 2).alias("text"))
    rows = resample.resample(df, df.withColumnRenamed("doc_id", "i"), "i", percent=100).collect()
    want = sorted(rows, key=lambda r: (-r.score, r.doc_id))
    assert [r.rank for r in want] == list(range(1, 41))


def test_long_and_odd_texts():
    sizes = resample.patterns(2)
    assert resample.features(b"", sizes) == (0, {}) and resample.features(b" .,\n ", sizes) == (0, {})
    assert resample.features(b"x" * 2_000_000, sizes)[0] == 1
    n, found = resample.features("Été B b-B\x00b".encode(), sizes)
    assert n == 5 and found["Été b".encode()] == 1 and found[b"b b"] == 3
    assert resample.features(b"ab " * 300_000, sizes)[0] == 300_000
