"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition on one text. Its cost (seconds) and selectivity (share rejected) are estimated on a sample of
``SAMPLE_ROWS`` rows, repeated ``REPEAT`` times so that the time is measurable. Rules are ordered by rejection per cost
and evaluated as one CASE expression, so a row stops at the first rule that rejects it. The order changes the work,
never the verdict: a document is kept if no rule rejects it.

Defined cases: a null or empty text has no words and is rejected by ``few_words``; a document with a null verdict does
not occur; repeated rows are judged alike; on an empty table the rules keep their written order; other columns of the
input are passed on untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 256
REPEAT = 16
# White space that separates words, characters counted as symbols, limits of the rules in per cent.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_DUP_LINES, MAX_CAPITALS, MAX_EXCLAMATIONS, MIN_LETTERS = 50, 50, 10, 50, 30, 20, 40
WORD_LENGTHS = (2, 12)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also inside a CASE branch."""
    return F.transform(F.array(value), body)[0]


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    trimmed = F.btrim(_text(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _stripped(text: Column, characters: str) -> Column:
    out = _text(text)
    for c in characters:
        out = F.replace(out, F.lit(c))
    return F.length(out)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return _stripped(text, SPACE).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - _stripped(text, SYMBOLS)).cast("long")


def _worded(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != ""))


def n_lines(text: Column) -> Column:
    return _worded(F.split(_text(text), "\n")).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(F.split(_text(text), "\n"), lambda x: _worded(x) - _worded(F.array_distinct(x))).cast("long")


def _repeated(keys: Column) -> Column:
    """Words inside 3-word windows whose key occurs twice; keys are one long per window."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"]

    ordered = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(ordered, covered))


def n_repeat_words(text: Column) -> Column:
    keys = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
    return let(words(text), lambda w: let(keys(w), _repeated)).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), r"\P{Lu}+", "")).cast("long")


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), r"\P{L}+", "")).cast("long")


def n_exclamations(text: Column) -> Column:
    return (F.length(_text(text)) - _stripped(text, "!")).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_letters, n_exclamations)
}
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function that gives a measure of the text by name."""

    name: str
    rejects: Callable[[Get], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * MAX_REPEATED),
    Rule("symbols", lambda m: m("n_symbols") * 100 > m("n_words") * MAX_SYMBOLS),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 100 > m("n_lines") * MAX_DUP_LINES),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * WORD_LENGTHS[0]) | (m("word_chars") > m("n_words") * WORD_LENGTHS[1])),
    Rule("capitals", lambda m: m("n_capitals") * 100 > m("word_chars") * MAX_CAPITALS),
    Rule("exclamations", lambda m: m("n_exclamations") * 100 > m("n_words") * MAX_EXCLAMATIONS),
    Rule("few_letters", lambda m: m("n_letters") * 100 < m("word_chars") * MIN_LETTERS),
)


def _inline(text: Column) -> Get:
    return lambda name: MEASURES[name](text)


SHARED = ("n_words", "word_chars")


def _rejection(text: Column, rules: Iterable[Rule]) -> Column:
    """:func:`first_rejection` of a text; the measures that most rules read are taken once, the others where they are met."""
    inline = _inline(text)
    return let(F.struct(*[inline(n).alias(n) for n in SHARED]), lambda m: first_rejection(lambda n: m[n] if n in SHARED else inline(n), rules))


def estimate(documents: DataFrame, rules: Iterable[Rule] = RULES, rows: int = SAMPLE_ROWS, repeat: int = REPEAT) -> dict[str, tuple[float, float]]:
    """Per rule: seconds on the sample, beyond those of a rule that does nothing, and share of rows rejected."""
    spark = documents.sparkSession
    taken = documents.select(F.col("text").cast("string").alias("text")).limit(rows).collect()  # a bounded sample
    if not taken:
        return {}
    sample = spark.createDataFrame(taken, "text string").coalesce(1).select("text", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("k")).drop("k")

    def timed(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(condition.cast("double"))).first()[0]
        return time.perf_counter() - began, share

    timed(F.col("text") == "")
    base = timed(F.col("text") == "")[0]
    out = {}
    for rule in rules:
        seconds, share = timed(rule.rejects(_inline(F.col("text"))))
        out[rule.name] = (max(seconds - base, 1e-4), share)
    return out


def ordered(rules: Iterable[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejection per cost, largest first; rules without an estimate stay behind, in their order."""
    rate = lambda r: -estimates[r.name][1] / estimates[r.name][0] if r.name in estimates else 0.0
    return sorted(rules, key=rate)


def first_rejection(get: Get, rules: Iterable[Rule]) -> Column:
    """Name of the first rule that rejects; null if none does. Later rules are not evaluated for the row."""
    out = None
    for r in rules:
        hit = F.coalesce(r.rejects(get), F.lit(False))
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def cascade(documents: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rules = tuple(rules)
    plan = ordered(rules, estimate(documents, rules))
    return documents.where(_rejection(F.col("text"), plan).isNull())


def judged(documents: DataFrame, measures: Iterable[str], rules: Iterable[Rule] = RULES) -> DataFrame:
    """doc_id, text, the named measures of every document, and ``rejected`` (a rule rejects it, by the cascade)."""
    rules, measures = tuple(rules), tuple(measures)
    plan = ordered(rules, estimate(documents, rules))
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", text.alias("text"), *[MEASURES[m](text).alias(m) for m in measures])
    get = lambda name: F.col(name) if name in measures else MEASURES[name](F.col("text"))
    return rows.withColumn("rejected", first_rejection(get, plan).isNotNull())
