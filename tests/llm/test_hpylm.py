"""The Pitman-Yor model: seating against simulation, normalisation, exact base and held-out gain."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm.hpylm import EXACT, draw_tables, log_stirling, op6_hpylm, score_texts

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w] + ["\n"]


def test_op6_counts_base_and_gain(spark):
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    seen = Counter(t for d, ts in docs.items() if not out[d] for t in ts)
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in op6_hpylm(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    for d, ts in docs.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[d], len(ts), n)
        assert r.n_known == sum(seen[t] > 0 for t in ts)
        assert r.base_score == pytest.approx(sum(log10((seen[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    assert sum(got[d].score for d in docs if out[d]) > 0.9 * sum(got[d].base_score for d in docs if out[d])
    again = {r.doc_id: r.score for r in op6_hpylm(spark, FOLDER).collect()}
    assert again == {d: r.score for d, r in got.items()}


def test_probabilities_sum_to_one(spark):
    """The texts "w" over all known words and an unknown one, less their ends, and the empty text."""
    learn = ["a b a c", "a b b", "c a", "b"]
    words = ["a", "b", "c", "unseen"]
    # P("p w", end) = P(p) P(w | p) P(end | w); "p q w" and "q w" differ by P(q after p) alone in w
    ask = ["", *words, *[f"a {w}" for w in words], "a"]
    texts = [*learn, *ask]
    docs = spark.createDataFrame([(i, t, i < len(learn)) for i, t in enumerate(texts)], "doc_id long, text string, learns boolean")
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("learns"), contexts=16).collect()}
    p = {t: 10 ** got[i] for i, t in enumerate(texts) if i >= len(learn)}
    # every term of sum over w of P(w | start) P(end | w) + P(end | start) is at most P(w | start)
    assert sum(p[w] for w in words) + p[""] <= 1 + 1e-6
    assert sum(p[f"a {w}"] for w in words) + p["a"] <= 1 + 1e-6


def test_predictive_law_is_normalised():
    """With the formulas of the scorer, any seating gives a law over known words, end and unknown."""
    import pyarrow as pa

    from framewise.llm.hpylm import CHUNKS, STATE, Numbers, batch_of, first_state, merge_counts, pack, pack_words, pair_scorer, rows_of, sweep, unpack

    contexts, rng = 4, np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    keys = np.arange(30 * contexts)
    count = rng.integers(0, 200, len(keys)) * (rng.random(len(keys)) < 0.5)
    count[::contexts] += 1
    row = {"kind": 0, "chunk": 1, "bucket": 0, "lo": 0, "words": pack_words(words),
           "word": pack(keys // contexts, "steps"), "context": pack(keys % contexts, "<u2"), "count": pack(count, "<i8")}
    table = pa.Table.from_batches([batch_of([row], CHUNKS)])
    merged, _, kept = merge_counts(table, contexts)
    assert len(merged) == 30 and kept.sum() == count.sum()
    state = first_state(contexts)((pa.scalar(0, pa.int32()),), table)
    r = next(rows_of(state.to_batches()[0]))
    total = r["totals"].as_py()
    numbers = Numbers(0.6, 0.5, 1.0, 0.5, 30, int(count.sum()), np.array(r["context_count"].as_py()), np.array(r["context_tables"].as_py()), total[0], total[1])
    for i in range(3):
        batch = next(sweep(numbers, contexts, 1, i, True)(iter(state.to_batches())))
        state = pa.Table.from_batches([batch])
        r = next(rows_of(batch))
        total = r["totals"].as_py()
        numbers.context_tables, numbers.root_count, numbers.root_tables = np.array(r["context_tables"].as_py()), total[0], total[1]
        numbers.samples.append((numbers.context_tables, total[0], total[1]))
    asked = [*words, "never"]
    ask = np.arange(31 * contexts)
    row |= {"words": pack_words(asked), "word": pack(ask // contexts, "steps"), "context": pack(ask % contexts, "<u2"),
            "count": pack(np.zeros(len(ask)), "<i8")}
    final = batch_of([{n: r[n].as_py() for n in r} | {"words": pack_words(merged.to_pylist())}], STATE)
    table = pa.Table.from_batches([batch_of([row], CHUNKS)])
    out = pair_scorer(numbers, contexts)[0](table, pa.Table.from_batches([final])).to_pylist()[0]
    law = 10.0 ** unpack(out["logs"], "<f4").astype(float).reshape(31, contexts)
    assert np.allclose(law.sum(0), 1, atol=1e-5)


def test_seating_follows_the_restaurant():
    """Draws agree with the law enumerated from the recursion, below and above the exact limit."""
    rng = np.random.default_rng(3)
    d, theta, base, others = 0.6, 1.0, 0.01, 50
    c = 5
    weights = np.exp(log_stirling(d)[c, 1 : c + 1]) * base ** np.arange(1, c + 1)
    weights *= np.array([np.prod(theta + d * (others + (t - 1) / 2)) ** t for t in range(1, c + 1)])
    draws = draw_tables(np.full(40_000, c), np.full(40_000, base), np.full(40_000, others), d, theta, log_stirling(d), rng)
    share = np.bincount(draws, minlength=c + 1)[1:] / len(draws)
    assert np.allclose(share, weights / weights.sum(), atol=0.01)
    n = 8 * EXACT
    exact = log_stirling(d, n)[n, 1:]
    t = np.arange(1, n + 1)
    for a in (0.3, 3, 30, 300, 3000):
        weights = exact + t * np.log(a)
        weights = np.exp(weights - weights.max())
        weights /= weights.sum()
        mean = (weights * t).sum()
        sd = np.sqrt((weights * (t - mean) ** 2).sum())
        draws = draw_tables(np.full(4000, n), np.full(4000, 1e-6), np.full(4000, (a / 1e-6 - theta) / d), d, theta, log_stirling(d), rng)
        assert abs(draws.mean() - mean) < 0.2 + 0.02 * mean and abs(draws.std() - sd) < 0.2 + 0.15 * sd
        assert (draws >= 1).all() and (draws <= n).all()
    assert np.isclose(np.exp(log_stirling(0.0)[4, 2]), 11)


def test_chunks_do_not_change_scores_of_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    small = {r.doc_id: r for r in score_texts(docs, F.lit(True), chunk_bytes=20_000).collect()}
    for d, r in {r.doc_id: r for r in score_texts(docs, F.lit(True)).collect()}.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (small[d].n_tokens, small[d].n_known, small[d].train_tokens)
        assert r.base_score == pytest.approx(small[d].base_score) and r.score == pytest.approx(small[d].score, rel=0.02)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "A b", "y"), (4, "a B", "y"), (4, "a B", "y"), (5, "word " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = score_texts(docs, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 3, 100_001]
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.n_tokens == 3}) == 1
    none = score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in none)
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_every_word_is_a_context_of_its_own(spark):
    """A chain of 3000 words, each seen once: all seats are certain, so the law is known in closed form."""
    chain = [f"w{i}" for i in range(3000)]
    ask = ["", None, "w7 w8", "w8 w7", "w7 never w9", "W2999", " ".join(chain[1000:2000]), " ".join(chain[::-1])]
    docs = spark.createDataFrame([(i, t, i == 0) for i, t in enumerate([" ".join(chain), *ask])], "doc_id long, text string, learns boolean")
    tables, d, theta = len(chain) + 1, 0.95, 1.0  # discounts are capped, as every pair is seen once
    after = dict(zip([None, *chain], [*chain, "\n"]))

    def prob(word, context):
        base = 0.5 / tables if word in chain or word == "\n" else 0.5
        known = word in chain or word == "\n"
        root = ((1 - d) * known + (theta + d * tables) * base) / (theta + tables)
        seen = context in after
        return ((1 - d) * (after.get(context) == word) * seen + (theta + d * seen) * root) / (theta + seen)

    for block_bytes in (1 << 25, 1000):
        got = {r.doc_id: r for r in score_texts(docs, F.col("learns"), block_bytes=block_bytes).collect()}
        for i, t in enumerate([" ".join(chain), *ask]):
            words = tokens(t)
            want = sum(log10(prob(w, c)) for c, w in zip([None, *words], words))
            assert got[i].score == pytest.approx(want, rel=1e-6), (block_bytes, i)
            assert (got[i].n_tokens, got[i].n_known) == (len(words), sum(w != "never" for w in words))


def test_words_of_one_hash_class_differ_as_contexts(spark):
    import xxhash

    classes = {}
    for i in range(10_000):
        classes.setdefault(xxhash.xxh64_intdigest(f"c{i}") % 511, []).append(f"c{i}")
    p, q = classes[0][:2]
    texts = [*[f"{p} x"] * 50, *[f"{q} y"] * 50]
    docs = spark.createDataFrame([(i, t, i < 100) for i, t in enumerate([*texts, f"{p} x", f"{q} x"])], "doc_id long, text string, learns boolean")
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("learns")).collect()}
    assert got[100] - got[101] > 1
    coarse = {r.doc_id: r.score for r in score_texts(docs, F.col("learns"), contexts=512).collect()}
    assert abs(coarse[100] - coarse[101]) < 0.1
    with pytest.raises(ValueError, match="65536"):
        score_texts(docs, F.col("learns"), contexts=70_000)


def test_scores_do_not_depend_on_chunks_and_gain_over_classes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("learns", F.col("doc_id") % 7 != 2)
    score = lambda df, **options: {r.doc_id: r.score for r in score_texts(df, F.col("learns"), **options).collect()}
    whole = score(docs.coalesce(1), block_bytes=1 << 18)
    parts = score(docs.repartition(3), block_bytes=1 << 18, chunk_bytes=50_000)
    assert whole.keys() == parts.keys() and all(parts[k] == pytest.approx(v, rel=1e-9) for k, v in whole.items())
    coarse, held = score(docs, contexts=512), [k for k in whole if k % 7 == 2]
    assert sum(whole[k] for k in held) > 0.95 * sum(coarse[k] for k in held)


def test_tables_follow_the_exact_law_in_small_restaurants():
    rng = np.random.default_rng(5)
    d, theta, base, c = 0.8, 0.1, 0.3, 12
    for others in (0, 3):
        rising = np.cumprod(theta + d * (others + np.arange(c)))
        weights = np.exp(log_stirling(d)[c, 1 : c + 1]) * base ** np.arange(1, c + 1) * rising
        draws = draw_tables(np.full(40_000, c), np.full(40_000, base), np.full(40_000, others), d, theta, log_stirling(d), rng)
        share = np.bincount(draws, minlength=c + 1)[1:] / len(draws)
        assert np.allclose(share, weights / weights.sum(), atol=0.01)


def test_packed_numbers():
    import pyarrow as pa

    from framewise.llm.hpylm import pack_numbers, unpack_numbers

    for values in ([], [0], [255, 256, 0], [1 << 40, 3], [5, 5, 9]):
        assert unpack_numbers(pa.scalar(pack_numbers(np.array(values, np.int64)))).tolist() == values
    assert unpack_numbers(pa.scalar(pack_numbers(np.array([5, 5, 9]), True)), True).tolist() == [5, 5, 9]
