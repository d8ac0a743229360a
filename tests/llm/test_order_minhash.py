"""Order MinHash against a plain version, and its use over neighbouring documents."""

import hashlib

import numpy as np
import pytest
import xxhash

from framewise.llm import order_minhash
from framewise.llm.order_minhash import FEW, ODD, as_text, edited, fingerprint_edits, likeness, mix, op7_order_minhash, orders, signatures

FOLDER = "/root/testdata/sf0.001"
K, LENGTH, SLOTS = 2, 2, 128


def word(x):
    return np.array([x], np.uint64)


def plain_signature(text, slots=SLOTS):
    """One text and one slot at a time: every k-mer with its occurrence number, ordered, picked and hashed."""
    words = text.split()
    marks = [xxhash.xxh64_intdigest(w) for w in words]
    if 0 < len(words) < FEW:
        marks = [int(mix(word(ord(c) + (1 << 32)))[0]) for c in text]
    runs = [marks[i : i + K] for i in range(len(marks) - K + 1)] or ([marks] if marks else [])
    seen, values = {}, []
    for run in runs:
        h = word(0)
        for i in range(K):
            h = mix(h * ODD + (word(run[i]) if i < len(run) else word(i)))
        number = seen[tuple(run)] = seen.get(tuple(run), -1) + 1
        values.append(int(mix(h + word(number) * ODD)[0]))
    out = np.zeros(slots, np.uint32)
    a, b = orders(slots)
    for s in range(slots if values else 0):
        ranked = sorted(range(len(values)), key=lambda p: (values[p] ^ int(b[s])) * int(a[s]) % (1 << 64))
        h = word(0)
        for p in sorted(ranked[:LENGTH]):
            h = mix(h * ODD + word(values[p]) + np.uint64(1))
        out[s] = max(1, int(h[0]) >> 32)
    return out


@pytest.mark.parametrize("n", [20, 80, 128, 250, 2000])
def test_swapped_halves_keep_about_half(n):
    words = [f"w{i}" for i in range(n)]
    a, b = (signatures([" ".join(w)], K, LENGTH, 512) for w in (words, words[n // 2 :] + words[: n // 2]))
    assert (a > 0).all() and 0.38 < likeness(a, b)[0] < 0.6


def test_short_and_unspaced_texts_are_ordered_by_characters():
    unspaced = "日本語の文章には空白がないので文字で数える必要がある"
    a, b, c = (signatures([t], K, LENGTH, 512) for t in (unspaced, unspaced[12:] + unspaced[:12], unspaced[:-1]))
    assert 0.3 < likeness(a, b)[0] < 0.65 and likeness(a, c)[0] > 0.75


def test_signatures_equal_the_plain_form():
    rng = np.random.default_rng(1)
    texts = ["", " ", "a", "ab", "one two", "x " * 500, "😀 b", "\ud800 lone"] + [
        " ".join(f"w{i}" for i in rng.integers(0, 30, rng.integers(1, 300))) for _ in range(40)
    ]
    texts.remove("\ud800 lone")
    for chunk in (1, 100, 1 << 15):
        order_minhash.CHUNK = chunk
        assert (signatures(texts, K, LENGTH, 16) == np.stack([plain_signature(t, 16) for t in texts])).all()


def test_op7_equals_plain_version(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        changed = edited(t, following)
        a, b, c = (plain_signature(x)[None] for x in (t, changed, following))
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b)[0], likeness(a, c)[0]))
    got = sorted(map(tuple, op7_order_minhash(spark, FOLDER).collect()))
    assert got == want
    assert np.mean([g[5] for g in got]) > 5 * np.mean([g[6] for g in got])


def test_order_matters_and_copies_agree():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{(i + 200) % 400}" for i in range(400))
    c = " ".join(f"v{i}" for i in range(400))
    prints = signatures([a, a, b, c, "", " \n"], K, LENGTH, SLOTS)
    assert (prints[0] == prints[1]).all()
    assert likeness(prints[:1], prints[2:3])[0] < 0.65 and likeness(prints[:1], prints[3:4])[0] < 0.05
    assert likeness(prints[4:5], prints[5:6])[0] == 1 and likeness(prints[:1], prints[4:5])[0] == 0


def test_edges_and_neighbours(spark):
    texts = {None: "no id", 1: None, 2: "", 3: "é日本 x", 5: "one", 9: "long words " * 50_000}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(5, "one", "y"), (5, "zwei", "y")], "doc_id long, text string, tail string")
    got = fingerprint_edits(docs, rows_per_bucket=1).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == [
        (False, 0, 5), (True, 1, 0), (True, 2, 0), (True, 3, 5), (True, 5, 3), (True, 5, 3), (True, 5, 4), (True, 9, 550_000)]
    by = {r.doc_id: r for r in got}
    assert by[9].edited_sha256 == hashlib.sha256((texts[9][:275_000] + "no id").encode()).hexdigest()
    assert by[1].near_next == by[1].near_edited == 1 and by[2].near_next == 0
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1
    alone = fingerprint_edits(docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fingerprint_edits(docs.limit(0)).count() == 0
