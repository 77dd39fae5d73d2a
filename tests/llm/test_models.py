"""BPE, language identification, pseudo-likelihood, chains and the pipeline."""

import itertools
import os

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import documents, empty, texts
from tidemark.llm import bpe, chains, decontaminate, language, pii, pseudo, quality, simhash
from tidemark.llm.words import Grams, Words, covered, fits, sliding_min

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def test_bpe_equals_its_library(spark):
    library = Tokenizer.from_file(PATH)
    special = ["<|endoftext|> x<|endoftext|><|endoftext|>", "<|endoftext|", "aaa aaaaaaa " * 5, "I'm they'll 'S don't", "日本語 😀😀 é́", "\x00\x01 \u200b\u3000b\u2028"]
    df = documents(spark, special)
    rows = bpe.round_trip(df, PATH).collect()
    assert len(rows) == df.count()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in df.collect()}
    for r in rows:
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    assert bpe.round_trip(empty(spark), PATH).count() == 0


def test_bpe_over_code_points():
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Tables(PATH))
    every = [f"a {chr(c)} b{chr(c)}{chr(c)}1{chr(c)} " for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, ends = encoder.encode(every)
    for k, want in enumerate(library.encode_batch(every, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == want.ids, every[k]


def test_chains_against_enumeration():
    r = np.random.default_rng(0)
    sizes = [0, 1, 5, 0, 6, 2, 3]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, t, s = r.normal(size=(first[-1], 3)), r.normal(size=(3, 3)), r.normal(size=3)
    best = chains.viterbi(e, first, t, s)
    for segment in (2, 3, 128):
        f, b, _ = chains.forward_backward(e, first, t, s, segment)
        p = f * b / (f * b).sum(axis=1, keepdims=True)
        for j, n in enumerate(sizes):
            if not n:
                continue
            x, at = e[first[j] : first[j + 1]], slice(first[j], first[j + 1])
            paths = list(itertools.product(range(3), repeat=n))
            score = np.array([s[y[0]] + sum(x[i, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)) for y in paths])
            mass = np.zeros((n, 3))
            for y, w in zip(paths, np.exp(score)):
                mass[np.arange(n), y] += w
            assert np.allclose(mass / mass.sum(axis=1, keepdims=True), p[at])
            assert tuple(best[at]) == paths[int(score.argmax())]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 !!", 0.0), (None, "ñ", 0.0), (4, "ª", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] != "und" and got[4][0] != "und"
    assert language.predict(documents(spark), model).count() == documents(spark).count()
    assert language.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixed_words_get_their_own_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 800 AND lang IN ('de', 'es')").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    parts = [" ".join(by[k].split()[:40]) for k in ("de", "es")]
    p, _ = language.word_probabilities(language._block([" ".join(parts)]), model)
    best = np.array(model.labels)[p.argmax(axis=1)]
    n = len(parts[0].split())
    assert (best[:n] == "de").mean() > 0.8 and (best[n:] == "es").mean() > 0.8


def test_pseudo_likelihood(spark):
    df = documents(spark)
    counts = pseudo.word_counts(df)
    v = pseudo.vocabulary(counts)
    p = pseudo.train(df, v, rate=1)
    rows = {r.doc_id: r for r in pseudo.score(df, v, p).collect()}
    assert len(rows) == len({r.doc_id for r in df.collect()})
    words = {}
    for t in [r.text for r in df.collect()]:
        for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split():
            words[w] = words.get(w, 0) + 1
    assert {r.n for r in counts.collect()} == set(words.values()) and counts.count() == len(words)
    # In a context, the probabilities of all words sum to one.
    joined = " ".join(w.decode() for w in words).encode()
    _, h, ending = pseudo._tokens(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    _, of_class, share = pseudo.encode(v, h, ending)
    z = pseudo.forward(p, np.full((1, 2 * pseudo.SIDE), pseudo.INPUTS - 1))[2][0]
    assert abs(np.exp(z[np.unique(of_class)]).sum() - np.exp(z[of_class] + share).sum()) < 1e-4
    # One document, word by word.
    text = (df.where("doc_id = 3").first().text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    _, h, ending = pseudo._tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    ids, of_class, share = pseudo.encode(v, h, ending)
    edge, total = pseudo.INPUTS - 1, 0.0
    for i in range(len(ids)):
        around = [ids[j] if 0 <= j < len(ids) else edge for j in (i - 2, i - 1, i + 1, i + 2)]
        x = np.concatenate([p["embed"][a] for a in around])
        y = np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
        total += y[of_class[i]] - np.log(np.exp(y).sum()) + share[i]
    assert abs(rows[3].log_likelihood - total) < 1e-3 * max(1, abs(total)) and rows[3].n_tokens == len(ids)
    assert rows[40].n_tokens == 0 and rows[40].log_likelihood == 0 and rows[40].mean_log_likelihood is None
    untrained = pseudo.score(df, v, pseudo.new_parameters()).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r.log_likelihood for r in rows.values()) > untrained
    assert pseudo.score_documents(empty(spark)).count() == 0


def test_every_document_trains_the_network(spark):
    """As registered: the inputs of all words move, whatever the ids and however few the documents."""
    start = pseudo.new_parameters()["embed"]
    for ids in (range(40), [None] * 40, [7], [None]):
        rows = [(d, f"a{k} b{k} c{k}") for k, d in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        v = pseudo.vocabulary(pseudo.word_counts(df))
        moved = (pseudo.train(df, v)["embed"] != start).any(axis=1)
        assert moved[: 3 * len(rows)].all() and moved[pseudo.INPUTS - 1]


def test_pipeline_against_its_stages_by_hand(spark):
    """run() equals the stages applied one by one with plain Python over collected rows."""
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.judged(docs, ()).where("NOT rejected").collect()}
    near = simhash.near_duplicates(docs.where(F.col("doc_id").isin(kept))).where("doc_id = component_id")
    kept = {r.doc_id for r in near.collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r.doc_id for r in decontaminate.decontaminate(docs.where(F.col("doc_id").isin(kept)), bench).where("n_hit = 0").collect()}
    library, model = Tokenizer.from_file(PATH), pii.train(pii.labelled_sentences(spark))
    clean = {r.doc_id: r.text for r in pii.redact(docs.where(F.col("doc_id").isin(kept)), model).collect()}
    assert {r.doc_id: r.ids for r in rows} == {d: library.encode(t, add_special_tokens=False).ids for d, t in clean.items()}
    assert len(rows) == len(clean) > 50


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    df = documents(spark)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (df, empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == df.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (last.count() > 0) == (start is df)


def test_words_and_grams():
    raw = [(t or "").encode() for t in texts()]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), language._SEPARATORS)
    assert w.counts().tolist() == [len(r.split()) for r in raw]
    flat = [x for r in raw for x in r.split()]
    assert len(set(w.hashes().tolist())) == len(set(flat))
    g, ok = Grams(w.hashes()).of(3), fits(w.first, 3)
    seen = {}
    for i in np.flatnonzero(ok):
        assert seen.setdefault(int(g[i]), tuple(flat[i : i + 3])) == tuple(flat[i : i + 3])
    x = np.random.default_rng(0).integers(0, 99, 50)
    for k in (1, 2, 5, 31):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(51 - k)]
    assert np.flatnonzero(covered(np.array([1, 2, 8]), 3, 10)).tolist() == [1, 2, 3, 4, 8, 9]


def test_optional_part_is_registered():
    import __spark_entry__ as entry

    assert os.path.exists(corpus_pipeline.__file__)
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
