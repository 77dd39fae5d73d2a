"""Substring dedup, SimHash near-duplicates and decontamination against plain Python."""

import random
import re

import numpy as np
import xxhash

from tests.llm.cases import documents, empty, sentence
from tidemark.llm import decontaminate, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def kept_by_hand(rows, size):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            if d is not None:
                least[tuple(w[i : i + size])] = min(d, least.get(tuple(w[i : i + size]), d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


def test_removed_windows(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for size, gram, tile in ((50, 20, 20), (12, 4, 5)):
        got = substrings.remove_repeated(df, size, gram, tile).collect()
        assert by_id(got) == by_id(kept_by_hand(rows, size))
    assert substrings.remove_repeated(empty(spark)).count() == 0


def test_windows_found_in_other_than_the_first_context(spark):
    """A window whose earliest document is not the earliest document of its anchor."""
    rng = random.Random(5)
    core = sentence(rng, 6).split()
    rows = []
    for d in range(60):
        left, right = ("l%d " % rng.randint(0, 2)) * 4, ("r%d " % rng.randint(0, 2)) * 4
        rows.append((d, f"{sentence(rng, 3)} {left} {' '.join(core)} {right} {sentence(rng, 3)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substrings.remove_repeated(df, 10, 4, 4).collect()) == by_id(kept_by_hand(rows, 10))


def test_ids_that_several_texts_share(spark):
    """Windows that only one of the rows with a doc_id has are removed from later documents too."""
    rng = random.Random(8)
    a, b, c = (sentence(rng, 90) for _ in range(3))
    rows = [(1, a), (1, b), (1, f"{c} {a}"), (2, f"{sentence(rng, 9)} {a} {b}"), (3, b), (4, c), (4, f"{a} {sentence(rng, 20)}"), (4, f"{a} {sentence(rng, 20)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, 12):
        assert by_id(substrings.remove_repeated(df, size, 8, 8, piece=size + 9).collect()) == by_id(kept_by_hand(rows, size))


def test_long_documents_that_quote_long_ones(spark):
    """Passages of thousands of words in many pieces, quoted whole, in part and in another order."""
    rng = random.Random(9)
    w = sentence(rng, 4000).split()
    rows = [(1, " ".join(w)), (2, " ".join(w[2000:] + w[:2000])), (3, " ".join(w[100:140] + w[900:1300] + ["x"] + w[1300:1349])), (4, " ".join(w[:3000] + w[:3000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (50, 64, 256):
        assert by_id(substrings.remove_repeated(df, piece=piece).collect()) == by_id(kept_by_hand(rows, 50))


def fingerprint_by_hand(text):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, radius):
    root = {f: f for f in set(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_near_duplicates(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fp = [fingerprint_by_hand(t) for _, t in rows]
    root = components_by_hand(fp, 4)
    least = {}
    for (d, _), f in zip(rows, fp):
        least.setdefault(root[f], []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    want = [(d, f"{f:016x}", least[root[f]]) for (d, _), f in zip(rows, fp)]
    assert by_id(simhash.near_duplicates(df).collect()) == by_id(want)
    assert by_id(simhash.near_duplicates(df, chunk=2).collect()) == by_id(want)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({v for v in least.values() if v is not None})


def test_texts_that_share_an_id_are_kept_apart(spark):
    rng = random.Random(6)
    a, b, c = (sentence(rng, 80) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (9, c), (9, a)]
    kept = simhash.keep_first(spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k int"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (5, b), (5, c)])


def test_every_close_pair_meets_in_a_table(spark):
    masks = np.array(simhash.masks(4), np.uint64)
    rng = np.random.default_rng(1)
    assert len(masks) == 31
    for _ in range(3000):
        d = np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
        assert ((masks & d) == 0).any()


def test_crowded_buckets_give_whole_components(spark):
    rng = np.random.default_rng(2)
    base = 0x0123456789ABCDEF
    x = sorted({base ^ sum(1 << int(b) for b in rng.choice(16, int(rng.integers(0, 6)), replace=False)) for _ in range(400)} | {int(v) for v in rng.integers(0, 2**62, 50)})
    root = components_by_hand(x, 4)
    df = spark.createDataFrame([(v,) for v in x], "fp long")
    for chunk in (7, 512):
        got = {r.node: r.root for r in simhash.components(simhash.links(df, 4, chunk)).collect()}
        groups = {}
        for v in x:
            groups.setdefault(root[v], []).append(v)
        assert {v: got.get(v, v) for v in x} == {v: min(g) for g in groups.values() for v in g}


def test_decontamination_both_ways(spark):
    rng = random.Random(9)
    items = [(k, sentence(rng, n)) for k, n in enumerate((15, 10, 9, 4, 2, 30, 1))]
    items += [(7, items[0][1]), (8, None), (9, ""), (10, "...")]
    extra = [
        f"{sentence(rng, 5)} {items[0][1].upper()} tail", "x " + " ".join(items[5][1].split()[3:14]) + " y", items[3][1], f"{items[4][1]} {items[4][1]}",
        "z " + " ".join(items[5][1].split()[3:12]), sentence(rng, 3) + " " + items[6][1] + ", " + sentence(rng, 2),
    ]
    df = documents(spark, extra)
    bench = spark.createDataFrame([(k, t, 1) for k, t in [*items, items[0]]], "item_id long, text string, doc_id int")

    def by_hand(text):
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for k, t in items:
            v = ITEM_WORD.findall(lower(t))
            size = min(10, len(v))
            wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    found.add(k)
                    hit.update(range(i, i + size))
        return len(w), len(hit), sorted(found)

    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = by_id([(d, *by_hand(t)) for d, t in rows])
    assert by_id(decontaminate.decontaminate(df, bench).collect()) == want
    named = df.where("doc_id IS NOT NULL")
    assert by_id(decontaminate.decontaminate(named, bench, max_broadcast=0).collect()) == [r for r in want if r[0] is not None]
    clean = sorted(r[0] for r in want if r[2] == 0 and r[0] is not None)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(named, bench).collect()) == clean
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(named, bench, max_broadcast=0).collect()) == clean
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_each_row_is_judged_by_its_own_text_both_ways(spark):
    """Null and repeated ids: the path for many windows returns what the other one does."""
    rng = random.Random(4)
    items = [(1, sentence(rng, 12)), (2, sentence(rng, 11)), (3, sentence(rng, 3))]
    clean, dirty, twice = sentence(rng, 30), f"{sentence(rng, 4)} {items[0][1]}", f"{items[1][1]} x {items[2][1]}"
    rows = [(None, clean), (None, dirty), (None, twice), (5, clean), (5, dirty), (5, dirty), (6, twice), (6, None), (7, clean), (None, None)]
    df, bench = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string")
    broadcast = by_id(decontaminate.decontaminate(df, bench).collect())
    assert sorted(str(r[3]) for r in broadcast if r[2]) == ["[1]", "[1]", "[1]", "[2, 3]", "[2, 3]"]
    assert by_id(decontaminate.decontaminate(df, bench, max_broadcast=0).collect()) == broadcast
    for most in (0, decontaminate.MAX_BROADCAST):
        kept = decontaminate.drop_contaminated(df, bench, max_broadcast=most)
        assert kept.columns == df.columns and sorted(r.row for r in kept.collect()) == [0, 3, 7, 8, 9]
