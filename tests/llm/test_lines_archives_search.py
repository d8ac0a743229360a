"""Line deduplication, archives and exact search: oracle on the test tables, edge rows by hand."""

import gzip
import hashlib

import numpy as np
import pytest

from check import normal, oracle
from framewise.llm import catalog
from framewise.llm.line_dedup import dedup_lines
from framewise.llm.maxscore import top_k
from framewise.llm.warc import base32_sha1, read_archives, read_warc_files, warc_bytes, write_archives

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert normal(got) == normal(want) and len(got)


def test_lines_edge_rows(spark):
    shared, other = "A line that is shared", " a LINE that is shared\t"
    rows = [
        (4, f"{shared}\nown text of four\nshort", 1, "x"),
        (2, f"{other}\n{shared}\n\nshort", 2, None),
        (2, f"{other}\n{shared}\n\nshort", 2, None),
        (2, f"second text of two\n{shared}", 3, "y"),
        (None, f"{shared}", 4, "z"),
        (5, None, 5, None),
        (6, "", 6, None),
        (7, "\n".join(["long line number %d" % i for i in range(20000)] + [shared]), 7, None),
        (8, "É line that is shared\né line that is shared", 8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int, doc string")
    got = {(r.doc_id, r.N_LINES): r for r in dedup_lines(docs).collect()}
    assert got[4, 1].text == "own text of four\nshort" and got[4, 1]["_n_lines"] == 3
    assert got[2, 2].text == rows[1][1] and got[2, 3].text == rows[3][1]
    assert got[None, 4].text == shared and got[5, 5].text == got[6, 6].text == ""
    assert got[7, 7].n_dropped == 1 and got[7, 7].text == "\n".join(rows[7][1].split("\n")[:-1])
    assert got[8, 8].n_dropped == 0
    assert dedup_lines(docs).count() == len(rows)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert {r.n_dropped for r in dedup_lines(docs, min_docs=4).collect()} == {0}


def test_a_url_of_any_length_is_read_back(spark, tmp_path):
    urls = {1: "http://a/" + "x" * 2_000_000, 2: "http://b/\u00e9" * 150_000, 3: "http://c"}
    pages = spark.createDataFrame([(i, u, "text" * i) for i, u in urls.items()], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    assert {r.page_id: r.url for r in read_archives(spark, str(tmp_path / "w")).collect()} == urls


def test_archives_edge_rows(spark, tmp_path):
    big = "<p>" + "é" * 3_000_000
    rows = [
        (3, "http://a\r\nX: 1", "same", 0), (1, None, "same", 1), (1, None, "same", 1), (9, "u", big, 2),
        (2, "u", None, 3), (7, "u", "", 4), (None, "n", "same", 5), (None, "n", "alone\r\n\r\nWARC/1.1\r\n", 6),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    path = str(tmp_path / "warc")
    write_archives(pages, path)
    got = sorted(
        ((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.url) for r in read_archives(spark, path).collect()),
        key=str,
    )
    digest = lambda t: base32_sha1(hashlib.sha1(t.encode()).digest())
    alone = "alone\r\n\r\nWARC/1.1\r\n"
    assert got == sorted([
        (3, "revisit", 1, 4, digest("same"), "http://a%0D%0AX: 1"), (1, "response", None, 4, digest("same"), None),
        (1, "response", None, 4, digest("same"), None), (9, "response", None, len(big.encode()), digest(big), "u"),
        (2, "response", None, 0, digest(""), "u"), (7, "revisit", 2, 0, digest(""), "u"),
        (None, "revisit", 1, 4, digest("same"), "n"), (None, "response", None, len(alone), digest(alone), "n"),
    ], key=str)
    assert max(len(r.data) for r in warc_bytes(spark, path).collect()) <= 1 << 20
    files = tmp_path / "files"
    files.mkdir()
    data = b"".join(bytes(r.data) for r in warc_bytes(spark, path).orderBy("archive", "place").collect())
    (files / "a.warc").write_bytes(data)
    (files / "b.warc.gz").write_bytes(gzip.compress(data))
    assert read_warc_files(spark, str(files)).count() == 2 * len(rows)
    none = str(tmp_path / "none")
    write_archives(pages.limit(0), none)
    assert read_archives(spark, none).count() == 0


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "ab" if i < 3 else "long enough") for i in range(6)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    write_archives(pages, path, min_bytes=5)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in read_archives(spark, path).collect()}
    assert kinds == {**{i: ("response", None) for i in range(4)}, 4: ("revisit", 3), 5: ("revisit", 3)}


def test_a_cut_record_is_an_error(spark, tmp_path):
    path, cut = str(tmp_path / "warc"), str(tmp_path / "cut")
    write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.read.parquet(path).where("chunk <> 1").write.parquet(cut)
    with pytest.raises(Exception, match="cut short|two line ends"):
        read_archives(spark, cut).collect()


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(700, 12)) * (rng.random((700, 12)) < 0.6)
    vectors[100:400] = vectors[5]
    rows = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [(900, None, ""), (901, [1.0, None] + [0.0] * 10, ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] * 12, ""), (None, [9.0] * 12, "")]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, top_k(table, table.vec_id % 50 == 0, k=10, shard_rows=100, block_rows=4).collect()))
    whole = np.floor(1024 * vectors).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_search_small_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5]), (2, [])], "vec_id long, embedding array<double>")
    found = top_k(table, table.vec_id == 0, k=5).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1024 * 512), (0, 2, 2, 0)]
    assert top_k(table.limit(0), table.vec_id == 0).count() == 0
