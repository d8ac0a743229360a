"""Token files and packing against the tokenizers library, text by text."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framewise.llm.packing import op5_packing, pack, plan_windows
from framewise.llm.token_files import decode_blocks, encode_blocks, op2_token_files, read_token_files, write_token_files
from framewise.llm.tokens import Encoder

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "", None, " a", "a ", "a  b", "x \n y", "don't  'S it'll", "<|endoftext|> hi", "İstanbul ΣΑΣ", "a\x1cb",
    "日本語 text", "é é", "²x 12½", "\n\n a", "ab\n\ncd\t e", "ŉa ǅ", "a b", "'", "x" * 5000, "A. b, c! " * 300,
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def reference(name, texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encoder = Encoder(public_tokenizers.path(name))
    assert encoder.layout
    got = [x.tolist() for x in encoder.encode(pa.array(TEXTS))]
    assert got == [x[:-1] for x in reference(name, TEXTS, 0)]
    assert encoder.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("values", [[], [5], [7] * 256, list(range(1000)), [3] * 300 + [2**31, 0] * 20])
def test_blocks_round_trip(values):
    body = memoryview(encode_blocks(np.array(values, np.int64)))
    assert decode_blocks(body).tolist() == values
    assert decode_blocks(body, 1, 2).tolist() == values[256:512]


def test_op2_equals_library(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for row, ids in zip(docs, reference("word_bpe_49k.json", [d.text for d in docs], 2)):
        want.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op2_token_files(spark, FOLDER).collect())) == want


def test_token_files_edge_rows(spark, tmp_path):
    rows = [(i, t, "lost") for i, t in enumerate(TEXTS)] + [(None, "a b", ""), (3, "a ", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START string")
    path = str(tmp_path / "ids")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), segment_tokens=100)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    empty = str(tmp_path / "none")
    write_token_files(docs.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert read_token_files(spark, empty).count() == 0


def check_pieces(rows, want, window):
    """Every id lies in one piece, sequences are gapless and full but for the last."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, check, total, sequence, offset in rows:
        assert 0 < length <= window
        assert (check, total) == (crc(want[doc][start : start + length]), len(want[doc]))
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        assert sum(n for _, n in parts) == len(want[doc])
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    fill = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert sorted(by_sequence) == list(range(len(fill))) and max(fill) <= window
    assert sum(n < window for n in fill) <= 1


def test_op5_packs_every_id_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], reference("byte_bpe_50k.json", [d.text for d in docs], 0)))
    check_pieces([tuple(r) for r in op5_packing(spark, FOLDER).collect()], want, 1024)


def test_pack_edge_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    want = dict(enumerate(reference("byte_bpe_50k.json", TEXTS, 0)))
    got = [(*r[:3], crc(r.ids), *r[3:6]) for r in pack(docs, path, window=16).collect()]
    check_pieces(got, want, 16)
    assert pack(docs.limit(0), path).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.length for r in pack(twice, path).collect()) == [1, 2, 2]


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    window = 64
    counts = np.zeros(window, np.int64)
    counts[rng.integers(1, window, 20)] = rng.integers(1, 10 ** (seed + 1), 20)
    rows = plan_windows(counts, window)
    fill = np.zeros(int((rows[:, 5] + rows[:, 2]).max()), np.int64)
    for _, _, count, _, length, sequence, _ in rows.tolist():
        fill[sequence : sequence + count] += length
    assert fill.sum() == (counts * np.arange(window)).sum() and (np.sort(fill)[1:] == window).all()
