"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, fp long, kept string"
SYLLABLES = "the and on er in th re at en or es ti an ing ly ha st nt sh der die und ein keit lich que les ment ci do ra ñ é ü ß".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [sentence(rng, rng.randint(40, 160)) for _ in range(n)]
    shared = sentence(rng, 70)
    for k in range(0, n, 5):
        out[k] = out[k] + "\n" + shared + " " + out[k + 1][:40]
    out[7] = out[6]
    words = out[8].split()
    words[10:12] = ["changed"]
    out[9] = " ".join(words)
    out += [None, "", "   \n\t ", "one", "a b c", "x" * 20000, sentence(rng, 6000), "😀 é\u00a0\u2003z \x0b\x1c\x85 end", "same line\nsame line\nsame line", out[3], out[3].upper()]
    return out


def documents(spark, extra=(), seed=1):
    rows = [(i, t, "en", "s", len(t or ""), "f", 0, "k") for i, t in enumerate([*texts(seed), *extra])]
    rows += [rows[4], rows[4], (None, rows[2][1], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
