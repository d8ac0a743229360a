"""SimHash groups against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from framewise.llm.components import components
from framewise.llm.simhash import bit_counts, enough_groups, grid_masks, near_links, op4_simhash, simhash_groups, unary

FOLDER = "/root/testdata/sf0.001"


def brute_print(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """Smallest position reachable from each position."""
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    labels = np.arange(len(values))
    while True:
        new = np.where(near, labels[None, :], len(values)).min(1)
        if (new == labels).all():
            return labels.tolist()
        labels = new


def test_op4_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    prints = [brute_print(t, 3) for _, t in docs]
    want = [(d, f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, brute_groups(prints, 3))]
    assert sorted(map(tuple, op4_simhash(spark, FOLDER).collect())) == want


def test_groups_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(100_000))
    rows = [
        (5, "one two three four", "a", 1), (3, "One  TWO\tthree\nfour", "a", 2), (3, "One  TWO\tthree\nfour", "a", 2),
        (9, None, None, 3), (8, "", "b", 4), (None, " \n ", "b", 5), (4, long, "c", 6), (6, long + " more", "c", 7),
        (7, "two words", "d", 8), (None, "nobody names this text", "d", 9), (11, "É one two", "e", 10), (12, "é one two", "e", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, PRINT int")
    got = simhash_groups(docs)
    assert got.columns == ["doc_id", "text", "fingerprint", "PRINT", "_fingerprint", "component_id", "is_first"]
    by = {}
    for r in got.collect():
        by.setdefault(r.PRINT, []).append((r.component_id, r.is_first, r["_fingerprint"]))
    assert [c for c, *_ in by[1] + by[2]] == [3, 3, 3] and sorted(f for _, f, _ in by[1] + by[2]) == [False, False, True]
    assert {by[i][0][2] for i in (3, 4, 5)} == {"0" * 16} and {by[i][0][0] for i in (3, 4, 5)} == {8}
    assert by[6][0][0] == by[7][0][0] == 4 and by[9][0][0] is None and by[9][0][1]
    assert by[10][0][2] != by[11][0][2]
    assert simhash_groups(docs.limit(0)).count() == 0
    assert simhash_groups(docs, carry=["PRINT"]).columns[0] == "PRINT"


@pytest.mark.parametrize("blocks", [4, 64, 1024])
def test_dense_groups_and_blocks(spark, blocks):
    """Fingerprints round a few centres: the links' components are those of all pairs."""
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    values = set()
    for c in centres:
        for _ in range(120):
            flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            values.add(int(c) ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    labels = brute_groups(values, 3)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "print long")
    found = {r.node: r.label for r in components(near_links(frame, 3, block_rows=blocks)).collect()}
    groups, want = {}, {}
    for v, label in zip(values, labels):
        signed = int(np.uint64(v).view(np.int64))
        groups.setdefault(found.get(signed, signed), set()).add(v)
        want.setdefault(label, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bound_and_grid(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.int64)
    frame = spark.createDataFrame([(int(x),) for x in a], "print long")
    codes = [r[0] for r in frame.select(bit_counts(frame["print"])).collect()]
    assert (np.array(codes, np.int64) == unary(a.view(np.uint64)).view(np.int64)).all()
    bits = (a.view(np.uint64)[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    counts = np.bitwise_count(bits).astype(int)
    manhattan = np.abs(counts[0] - counts[1:]).sum(1)
    u = unary(a.view(np.uint64))
    assert (np.bitwise_count(u[0] ^ u[1:]) == manhattan).all()
    assert len(grid_masks(3, 6)) == 20 and enough_groups(10, 3) <= enough_groups(10**9, 3)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (2000, 2001), (2001, 2000)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(1000, 1400)} == {1000}
    assert found[2001] == found[2000] == 2000 and len(found) == 61 + 400 + 2
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
