"""Language identification against enumeration and labels; the pipeline against brute force."""

import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm.langid import START, UNKNOWN, fit_all, identify, labelled_texts, learn_languages, op8_langid, pieces, train, usual_fit, word_scores
from framewise.llm.line_dedup import dedup_lines
from test_tokens import check_pieces, reference

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def enumerated(word, probs, vocab):
    """Probability of a word as the sum over all of its segmentations."""
    text, total = START + word, 0
    for n in range(len(text)):
        for cuts in combinations(range(1, len(text)), n):
            edges = [0, *cuts, len(text)]
            product = 1.0
            for a, b in zip(edges, edges[1:]):
                at = vocab.find(np.array([vocab.hash_of(text[a:b])], np.uint64))[0]
                product *= probs[at] if at >= 0 else UNKNOWN if b - a == 1 else 0
            total += product
    return np.log(total)


def test_forward_sums_all_segmentations():
    vocab = pieces(PATH)
    probs = train(["the", "there", "other", "öl"], np.array([5, 2, 1, 1]), vocab, 3)
    words = ["there", "x", "öther", "日本", "thetheth"]
    want = [enumerated(w, probs, vocab) for w in words]
    assert np.allclose(word_scores(words, vocab, probs[:, None])[:, 0], want)
    assert abs(probs[:-1].sum() - 1) < 1e-9


def plain_forward(word, probs, vocab):
    """Log-probability of a word by a forward pass on logarithms, a position at a time."""
    text = START + word
    alpha = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - vocab.longest), end):
            at = vocab.find(np.array([vocab.hash_of(text[start:end])], np.uint64))[0]
            p = probs[at] if at >= 0 else UNKNOWN if end - start == 1 else 0
            if p:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + np.log(p))
    return alpha[-1]


@pytest.mark.parametrize("size", [40, 33, 32, 5000])
def test_long_words_are_summed_whole(size):
    vocab = pieces(PATH)
    probs = train(["the", "there", "other", "öl", "and" * 20], np.array([5, 2, 1, 1, 3]), vocab, 3)
    word = ("thereandother日" * (size // 14 + 1))[:size]
    assert np.isclose(word_scores([word], vocab, probs[:, None])[0, 0], plain_forward(word, probs, vocab))


def test_long_words_train_like_short_ones(monkeypatch):
    vocab = pieces(PATH)
    words, counts = ["thereandother", "the", "brother", "öther"], np.array([2, 3, 1, 1])
    short = train(words, counts, vocab, 3)
    monkeypatch.setattr("framewise.llm.langid.LONG", 2)
    assert np.allclose(train(words, counts, vocab, 3), short)


def test_op8_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op8_langid(spark, FOLDER).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert len(out) > 40 and np.mean([truth[r.doc_id] == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_edge_rows(spark):
    rows = [(i, t, g, "x") for i, (t, g) in enumerate(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("", "fr"), ("123 !?", None), ("the dog", None), ("日" * 500, None)])]
    docs = spark.createDataFrame(rows + [(None, "le chien", "fr", "y")], "doc_id long, text string, lang string, SCORE string")
    model = learn_languages(docs, PATH)
    assert model.langs == ["en", "fr"]
    found = identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "SCORE", "lang_pred", "_score"]
    got = {r.doc_id: (r.lang_pred, r["_score"]) for r in found.collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 5, None)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert got[2][1] == 0 and got[6][0] in ("en", "fr") and np.isclose(got[6][1], 0.5)
    nothing = learn_languages(docs.limit(0), PATH)
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def five_words(text):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_language_stage_rejects_other_texts_and_keeps_clean_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "qzx vrrk pltt zzgh wwqk bnmt " * 5, None), (-2, "Ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", None), (-3, "0123 !!", "en")]
    out = corpus_pipeline.known_language(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), FOLDER)
    left = {r.doc_id for r in out.collect()}
    assert min(left) >= 0 and len(left) >= 0.99 * docs.count()


def test_fit_in_spark_equals_training_on_all_words(spark):
    texts = {"aa": ["the cat and the dog", "the öther " + "thereandother" * 4, None], "bb": ["le chat et le chien"] * 3 + [""], "cc": ["12 !"]}
    rows = [(i, t, g) for g, ts in texts.items() for i, t in enumerate(ts * 5)] + [(None, "the bird", "aa"), (7, "nobody's", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_all(labelled_texts(docs).repartition(3), PATH)
    assert model.langs == ["aa", "bb", "cc"]
    for k, lang in enumerate(model.langs):
        words = [w for _, t, g in rows if g == lang and t for w in re.findall(r"[^\W\d_]+", t)]
        names = sorted(set(words))
        want = train(names, np.array([words.count(w) for w in names], np.int64), pieces(PATH), 5)
        assert np.allclose(model.probs[:, k], want, rtol=1e-9, atol=0)
    nothing = fit_all(labelled_texts(docs.limit(0)), PATH)
    assert nothing.langs == [] and usual_fit(labelled_texts(docs), nothing) == {}


def test_language_stage_learns_from_and_measures_on_all_documents(spark):
    """A quarter of a language's documents, none of which a sample of 1000 ids by their hash takes, has words of its own."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    text = F.when(place > 0.8, "zqxv wkjq vbnzk qrrt").otherwise("the cat sat on the mat")
    docs = spark.range(4500).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("aa").alias("lang"))
    rare = docs.where("text like 'z%'")
    assert 600 < rare.count() and corpus_pipeline.known_language(spark, docs, FOLDER).count() == 4500
    model = fit_all(labelled_texts(docs.where("text not like 'z%'")), PATH)
    assert usual_fit(labelled_texts(docs), model)["aa"] < usual_fit(labelled_texts(docs.where("text not like 'z%'")), model)["aa"] - 1


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = {r.doc_id for r in corpus_pipeline.known_language(spark, table, FOLDER).collect()}
    docs = {r.doc_id: r.text for r in table.collect() if r.doc_id in known}
    lines = {d: t.split("\n") for d, t in docs.items()}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d in sorted(lines):
        for x in lines[d]:
            first.setdefault(key(x), d)
    texts = {d: "\n".join(x for x in ls if len(key(x)) < 10 or first[key(x)] == d) for d, ls in lines.items()}
    ids = sorted(texts)
    sets = [five_words(texts[d]) for d in ids]
    top = list(range(len(ids)))
    for i, j in combinations(range(len(ids)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and top[i] != top[j]:
            a, b = sorted((top[i], top[j]))
            top = [a if t == b else t for t in top]
    kept = [d for i, d in enumerate(ids) if top[i] == i]
    want = dict(zip(kept, reference("byte_bpe_50k.json", [texts[d] for d in kept], 0)))
    got = corpus_pipeline.run(spark, FOLDER)
    check_pieces([tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], want, 1024)


@pytest.mark.parametrize("k", range(3))
def test_stages_keep_columns_and_edge_rows(spark, k):
    rows = [(1, "the cat sat on the mat\nand the dog", "en", "s", 5), (2, None, None, None, None), (3, "le chat et le chien", "fr", "s", 1),
            (3, "le chat et le chien", "fr", "s", 1), (None, "the dog", "en", None, 2), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, FOLDER)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert out.count() == [4, 6, 4][k]
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), FOLDER).count() == 0


def test_line_stage_uses_the_operator(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    a = {r.doc_id: r.text for r in corpus_pipeline.distinct_lines(spark, docs, FOLDER).collect()}
    assert a == {r.doc_id: r.text for r in dedup_lines(docs).collect()}
