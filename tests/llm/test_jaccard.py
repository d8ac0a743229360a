"""Near-duplicates by Jaccard similarity against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from framewise.llm.jaccard import jaccard_groups

FOLDER = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Smallest index reachable over pairs at 0.8 or above, by the sets themselves."""
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def near_copies(seed, groups, copies, least=30, most=150):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(least, most)))]
        for _ in range(copies):
            some = list(base)
            for at in rng.integers(0, len(some), int(rng.integers(0, 4))):
                some[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(some))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("groups, copies", [(40, 4), (1, 150), (3, 60)])
def test_groups_equal_all_pairs(spark, groups, copies):
    texts = [*near_copies(groups, groups, copies), "", None, " ", "a b", "a b", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()}
    want = plain_groups(texts)
    assert len(set(want)) < 0.7 * len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_stage_drops_planted_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
    copy, far = list(base), list(base)
    copy[50] = "other"
    far[20] = far[40] = far[60] = far[80] = "other"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([base, copy, far])], "doc_id long, text string")
    kept = corpus_pipeline.distinct_documents(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_blocks_and_large_cells_keep_all_pairs(spark):
    texts = near_copies(9, 2, 120, 60, 80)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = plain_groups(texts)
    got = {r.doc_id: r.component_id for r in jaccard_groups(docs, carry=["doc_id"], block_rows=16).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_fingerprints_link_what_the_similarity_leaves(make, spark):
    """A pair under the similarity whose SimHash fingerprints are near is linked with a radius only."""
    from framewise.llm.simhash import fingerprint

    body = ["w1", "w2", "w3"] * 400  # three shingles, so no bit is near half of the hashes
    one, other = " ".join(body), " ".join(body + [f"z{i}" for i in range(60)])
    apart = " ".join(f"q{i}" for i in range(300))
    a, b = (fingerprint(t.encode(), 5) for t in (one, other))
    assert (a ^ b).bit_count() <= 3
    docs = make("doc_id long, text string", (1, one), (2, other), (3, apart), (4, None))

    def groups(**how):
        return {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, **how).collect()}

    assert groups() == {1: 1, 2: 2, 3: 3, 4: 4}
    assert groups(radius=3) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_fingerprints_of_hashes_are_those_of_the_operator():
    from framewise.llm.jaccard import shingle_hashes
    from framewise.llm.simhash import fingerprint, majority

    for text in (b"", b"one", b"a b c a b c a b c d e f", b" ".join(b"w%d" % (i % 700) for i in range(70_000))):
        assert majority(shingle_hashes(text, 5)) == fingerprint(text, 5)
