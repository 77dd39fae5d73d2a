"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, codes, decontaminate, language, pii, pseudo, quality, resample, secrets, simhash, substrings, urls, warc

CALLS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        CALLS[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(CALLS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least_id AS (SELECT win, min(doc_id) AS s FROM wins GROUP BY win),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM wins JOIN least_id USING (win) WHERE s < doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM (
    SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) k
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS g, unnest(qs) AS gq FROM gone) WHERE g = k.doc_id AND gq = k.q) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(gone.qs), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op1(spark, sf_dir):
    rows = substrings.remove_repeated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_decontaminate",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, s AS size, array_to_string(list_slice(w, p, p + s - 1), ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS s, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, s, array_to_string(list_slice(w, p, p + s - 1), ' ') AS win FROM (
    SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT size AS s FROM iw) WHERE len(w) >= s)),
hits AS (SELECT doc_id, p, s, item_id FROM dw JOIN iw USING (win) WHERE s = size),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + s)) AS q FROM (SELECT DISTINCT doc_id, p, s FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
    sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op2(spark, sf_dir):
    rows = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _count(kind: str):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_secrets")
def op3(spark, sf_dir):
    rows = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return rows.select("doc_id", *[_count(k) for k in ("assign", "access", "hex")], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


@query("op4_language_id")
def op4(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query(
    "op5_quality_rules",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, p, list_slice(w, p, p + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS caps,
    length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, length(regexp_replace(text, '[^!]', '', 'g')) AS marks
    FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * caps > 30 * word_chars OR 100 * marks > 20 * n_words
        OR 100 * letters < 40 * word_chars) AS kept
FROM m""",
)
def op5(spark, sf_dir):
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.judged(_table(spark, sf_dir, "documents"), base)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.select("doc_id", *base, failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))


@query("op6_bpe")
def op6(spark, sf_dir):
    rows = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_pii")
def op7(spark, sf_dir):
    model = pii.train(pii.labelled_sentences(spark))
    rows = pii.find(_table(spark, sf_dir, "documents"), model)
    base = F.filter("found", lambda s: ~s["kind"].startswith("field-"))
    return rows.select("doc_id", *[_count(k) for k in pii.KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


@query("op8_url_filter")
def op8(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op9_simhash")
def op9(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op10_lm_score")
def op10(spark, sf_dir):
    rows = pseudo.score_documents(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("mean_log_likelihood", 6).alias("mean_log_likelihood"))


@query(
    "op11_importance_resampling",
    r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
vocab AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM b)),
crc AS (SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda i: (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1]), 4294967295), 4294967295) % 10000 AS k FROM (SELECT f, hex(encode(f)) AS hx FROM vocab), tab),
s AS (SELECT k, sum(n)::BIGINT AS n FROM df JOIN crc USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN crc USING (f) GROUP BY k),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS st, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (st + 10000) / ((s.n + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k), totals),
w AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN gain USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, len(d.w)::BIGINT AS n_features, list_reduce(list_transform(range(8), lambda i: strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), i + 1, 1)) - 1), lambda a, x: a * 16 + x, 0::BIGINT) AS h FROM d),
r AS (SELECT h.doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN w USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, sum((n_features >= 20)::INT) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p END AS rank FROM ranked""",
)
def op11(spark, sf_dir):
    rows = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "item_id")
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_warc",
    r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS hx FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((strpos('0123456789abcdef', substr(hx, 5 * i // 4 + 1, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(hx, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f USING (b)""",
)
def op12(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


_ASSIGN = """assign{r} AS MATERIALIZED (SELECT vec_id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT vec_id, part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM cut JOIN book{r} USING (part)) GROUP BY ALL)"""
_BOOK = """book{n} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT part, entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM assign{r}, (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""
_KMEANS = ",\n".join(_ASSIGN.format(r=r) + (",\n" + _BOOK.format(r=r, n=r + 1) if r < 6 else "") for r in range(7))


@query(
    "op13_vector_codes",
    f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM documents_of_vectors),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * 8 + 1 : part * 8 + 8] AS x FROM kept, (SELECT unnest(range(8)) AS part)),
book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16) USING (vec_id)),
{_KMEANS},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assign6 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)""".replace(
        "documents_of_vectors", "embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    ),
)
def op13(spark, sf_dir):
    return codes.summary(*codes.compress(_table(spark, sf_dir, "embeddings")))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
