"""URL filter: host and path rules, and a logistic regression on hashed character n-grams, in DataFrame functions only.

The regression is trained on a small labelled URL table by gradient steps: each step is one aggregation over the
exploded features of the labelled rows, and only the gradient, at most ``BUCKETS`` numbers, comes to the driver. The
weights then stand in the plan as one constant array, and a URL's score is a sum over its n-grams' weights. URLs that a
rule decides are not scored.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed (there is
nothing to judge); repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The rules, as host and path with their verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SIZES = (3, 4)
BUCKETS = 1 << 12
STEPS = 12
RATE = 0.5
DECAY = 0.002
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Word stems of the labelled table. Each host is a stem of a class, alone or joined with two others of it.
BLOCKED_STEMS = (
    "adult porn sex nude escort webcam erotic casino poker slots jackpot roulette betting lottery pills viagra pharmacy steroid payday loan "
    "cash spam popup banner tracker clicks adserver phish replica warez crack keygen torrent"
).split()
ALLOWED_STEMS = (
    "library university museum weather news council school hospital science garden recipe cooking travel map railway airport chess music "
    "orchestra theatre cinema book history archive research physics chemistry biology medicine court parliament police football tennis "
    "fitness photo painting design engineering software kernel compiler database robotics space astronomy ocean forest mountain river "
    "bridge market bank finance insurance housing energy solar farming bakery coffee fashion puzzle wiki forum blog poetry language "
    "dictionary calendar zeitung schule verein stadt haus garten musique cuisine voyage maison ecole noticias escuela ciudad musica"
).split()
ONSETS, VOWELS = "b c d f g h k l m n p r s t v w st tr br".split(), "a e i o u ie ou".split()
INVENTED = 300  # neutral names of two or three syllables, by rule
HOST_FORMS = ("{}.example.com", "www.{}.org", "blog.{}.net", "m.{}.info")
PATHS = ("", "/", "/en/12", "/de/345.html", "/fr/67/", "/es/890?page=2&ref=x", "/a/b/c.html", "/index.html#top", "/2024/05/01/post")


def _joined(stems: Sequence[str]) -> list[str]:
    return [w for i, s in enumerate(stems) for w in (s, f"{s}-{stems[(i + 1) % len(stems)]}", s + stems[(i + 3) % len(stems)])]


def _invented(i: int) -> str:
    digits = hashlib.md5(f"name-{i}".encode()).digest()
    return "".join(ONSETS[digits[2 * k] % len(ONSETS)] + VOWELS[digits[2 * k + 1] % len(VOWELS)] for k in range(2 + digits[8] % 2)) + "n" * (digits[9] % 2)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, block (1.0 or 0.0), word (the host's own part)."""
    rows = []
    for label, hosts in ((1.0, _joined(BLOCKED_STEMS)), (0.0, _joined(ALLOWED_STEMS) + [_invented(i) for i in range(INVENTED)])):
        for i, h in enumerate(hosts):
            rows += [{"url": "https://" + HOST_FORMS[(i + j) % 4].format(h) + PATHS[(i + 5 * j) % len(PATHS)], "block": label, "word": h} for j in range(2)]
    table = F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,block:double,word:string>>"))
    return spark.range(0, 1, 1, 1).select(table.alias("r")).select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def features(host: Column, path: Column) -> Column:
    """Bucket numbers of the character n-grams of host and path, repeats included."""

    def grams(tag: str, part: Column, n: int) -> Column:
        starts = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(part, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    parts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.when(path != "", F.concat(path, F.lit("$"))).otherwise(F.lit(""))))
    return F.concat(*[grams(tag, part, n) for tag, part in parts for n in SIZES])


def _constant(weights: Sequence[float]) -> Column:
    return F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")


def score(buckets: Column, weights: Sequence[float], bias: float) -> Column:
    """Probability of ``block``."""
    table = _constant(weights)
    z = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.sqrt(F.size(buckets)), F.lit(1.0)) + bias
    return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by full gradient steps with a rate per weight; rows with a null label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("block").isNotNull()).select(F.col("block").cast("double").alias("y"), host.alias("h"), path.alias("p"))
    rows = rows.select("y", features(F.col("h"), F.col("p")).alias("x"))
    weights, bias, seen, seen_bias = [0.0] * BUCKETS, 0.0, [1e-6] * BUCKETS, 1e-6
    total = rows.groupBy("y").count().collect()
    if len(total) < 2:
        return weights, 0.0
    share = {r["y"]: r["count"] for r in total}
    for _ in range(steps):
        error = (score(F.col("x"), weights, bias) - F.col("y")) * F.when(F.col("y") > 0, 0.5 / share[1.0]).otherwise(0.5 / share[0.0])
        parts = rows.select("x", error.alias("e")).select(F.explode(F.concat("x", F.array(F.lit(-1)))).alias("b"), F.when(F.size("x") > 0, F.col("e") / F.sqrt(F.size("x"))).otherwise(F.col("e")).alias("g"), "e")
        for r in parts.groupBy("b").agg(F.sum("g").alias("g"), F.sum("e").alias("e")).collect():  # BUCKETS rows at most
            if r["b"] < 0:
                seen_bias += r["e"] ** 2
                bias -= RATE * r["e"] / math.sqrt(seen_bias)
            else:
                g = r["g"] + DECAY * weights[r["b"]] / BUCKETS
                seen[r["b"]] += g * g
                weights[r["b"]] -= RATE * g / math.sqrt(seen[r["b"]])
    return weights, bias


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    name = verdict = None
    for rule, decision in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, score (null where a rule decides), verdict."""
    weights, bias = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), decided.alias("decided"))
    guess = F.when(F.col("decided").isNull() & ((F.col("host") != "") | (F.col("path") != "")), score(features(F.col("host"), F.col("path")), weights, bias))
    rows = rows.select("*", guess.alias("score"))
    return rows.select("page_id", "host", "path", "rule", "score", F.coalesce("decided", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
