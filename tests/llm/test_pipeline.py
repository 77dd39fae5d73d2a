"""The whole pipeline against plain Python: no stage of the library decides a row here.

Rules, fingerprints and their components, benchmark windows, fixed patterns, redaction and BPE ids are worked out row by
row. Only the spans that the trained field adds come from the library; its decoding is tested by enumeration.
"""

import random
import re
import unicodedata
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import documents, sentence
from tidemark.llm import pii

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def passes_rules(text):
    t = text or ""
    w = WORD.findall(t)
    n, chars = len(w), sum(map(len, w))
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = len({i + k for i in range(n - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    kinds = Counter(unicodedata.category(c) for c in t)
    rejected = (
        n < 50,
        100 * repeated > 50 * n,
        100 * len(re.findall(r"[#*$%&|<>]", t)) > 10 * n,
        100 * (len(lines) - len(set(lines))) > 50 * len(lines),
        chars < 2 * n or chars > 12 * n,
        100 * kinds["Lu"] > 30 * chars,
        100 * t.count("!") > 20 * n,
        100 * sum(v for k, v in kinds.items() if k[0] == "L") < 40 * chars,
    )
    return not any(rejected)


def fingerprint(text):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def first_of_groups(rows):
    """One (id, text) of each group of linked fingerprints; rows without an id stay."""
    prints = [fingerprint(t) for _, t in rows]
    group = {f: {f} for f in prints}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    least = {}
    for (d, t), f in zip(rows, prints):
        if d is not None:
            key = id(group[f])
            least[key] = min(least.get(key, (d, t)), (d, t), key=lambda r: r[0])
    return [*least.values(), *(r for r in rows if r[0] is None)]


def contaminated(text, items):
    w = ITEM_WORD.findall(lower(text))
    for _, v in items:
        v = ITEM_WORD.findall(lower(v))
        size = min(10, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        if wins & {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}:
            return True
    return False


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(only(m.group())) <= 19 and luhn(only(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m.group())) <= 15]


def hidden(text, spans):
    """Each character goes if a span holds it; where a run of hidden characters begins, the first span's kind stands."""
    if text is None:
        return None
    starts, gone = {}, set()
    reach = 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= reach:
            starts[s] = f"<{k.removeprefix('field-').upper()}>"
        reach = max(reach, e)
        gone.update(range(s, e))
    return "".join(starts.get(i, "") + ("" if i in gone else c) for i, c in enumerate(text))


def expected(spark, docs, items):
    rows = [(r.doc_id, r.text) for r in docs.collect() if passes_rules(r.text)]
    kept = [(d, t) for d, t in first_of_groups(rows) if not contaminated(t, items)]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(kept)], "doc_id long, text string")
    field = {r.doc_id: [tuple(f) for f in r.found if f.kind.startswith("field-")] for r in pii.find(frame, pii.train(pii.labelled_sentences(spark))).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = [(d, hidden(t, base_spans(t) + field[k])) for k, (d, t) in enumerate(kept)]
    return sorted(((d, library.encode(t, add_special_tokens=False).ids) for d, t in clean), key=str)


def found(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    return sorted(((r.doc_id, r.ids) for r in rows), key=str)


def test_pipeline_on_the_smallest_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = expected(spark, docs, [(r.item_id, r.text) for r in bench.collect()])
    assert found(spark, SF) == want and len(want) > 50


def test_pipeline_on_planted_rows(spark, tmp_path):
    rng = random.Random(21)
    items = [(1, sentence(rng, 14)), (2, sentence(rng, 10)), (3, sentence(rng, 4)), (4, None), (5, "")]
    body = [sentence(rng, 90) for _ in range(12)]
    near = body[0].split()
    near[40] = "changed"
    planted = [
        body[0], " ".join(near), body[0].upper(), body[0],  # copies and near copies
        f"{body[1]} {items[0][1].upper()} {body[2]}", f"{body[3]} {items[2][1]}, end", f"{body[4]} {' '.join(items[1][1].split()[1:])}",
        f"{body[5]} mail jo.x@mail.example.com or +1 (415) 555-1234, 10.0.0.255 and 10.0.0.256",
        f"{body[6]} card 4111 1111 1111 1111 not 4111-1111-1111-1112 a@b.c@d.e",
        "#$% " * 40 + body[7], "short text", ("same line of words here\n" * 30), "!!! " * 30 + body[8], "A1 B2 C3 " * 40,
        body[9] + " é😀 +49 30 1234567 x" , body[10] * 30,
    ]
    docs = documents(spark, planted)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected(spark, docs, items)
    assert found(spark, str(tmp_path)) == want and len(want) > 20
