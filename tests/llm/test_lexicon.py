"""The transducer, the merges and the op3 digests against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkFiles
from tokenizers import Tokenizer

from framewise.llm.lexicon import Automaton, Lexicon, build_lexicon, compile_words, decode, encode, encode_batch, lexicon_bytes, merges, op3_bpe
from test_tokens import TEXTS

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
MORE = ["<|startoftext|>A<|endoftext|> B <|endoftext|", "İİ ΑΣ ς K Å ﬁ", "áȩ ñ", " x y\x85z\x1f!", "ǅ ß ẞ", "👩‍👩‍👧 ok", "\0 a\0b", "x" * 300 + " " + "ab" * 5000]


def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(3))
def test_transducer_ranks(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 7))) for _ in range(400)})
    found = Automaton(compile_words(words))
    others = [bytes(rng.choices(b"abcd", k=rng.randint(1, 8))) for _ in range(400)]
    asked = np.array(words + others, "S9")
    place = {w: i for i, w in enumerate(words)}
    assert found.ranks(asked).tolist() == [place.get(w, -1) for w in words + others]
    assert (Automaton(compile_words([])).ranks(asked) == -1).all()


def test_suffixes_are_shared():
    words = sorted(f"{a}{b}ation".encode() for a in "abcdefgh" for b in "stuvw")
    assert len(Automaton(compile_words(words)).ends) == 1 + 1 + 1 + 5


def test_encode_equals_library_with_any_lexicon(tmp_path):
    rng = random.Random(5)
    noise = ["".join(chr(rng.choice([*range(32, 128), *range(160, 900), 0x3000, 0x4E00, 0x1F600])) for _ in range(80)) for _ in range(300)]
    texts = TEXTS + MORE + noise
    want = [library().encode(t or "", add_special_tokens=False).ids for t in texts]
    for words in ([], ["hi", "the", "don", "x", "é", "'"], [w for t in noise for w in t.lower().split()]):
        path = tmp_path / f"lexicon{len(words)}"
        path.write_bytes(lexicon_bytes(words, merges(PATH)))
        got = encode_batch(pa.array(texts), merges(PATH), Lexicon(str(path)))
        assert [g.tolist() for g in got] == want


def test_op3_equals_library(spark):
    tokenizer = library()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op3_bpe(spark, FOLDER).collect())) == sorted(want)


def test_encode_decode_edge_rows(spark):
    docs = spark.createDataFrame([(i % 7 if i else None, t, 1) for i, t in enumerate(TEXTS + MORE)], "doc_id long, text string, IDS int")
    ids = encode(docs, PATH, build_lexicon(docs, PATH, words=8))
    assert ids.columns == ["doc_id", "text", "IDS", "_ids"]
    tokenizer = library()
    for r in decode(ids, PATH, "_ids").collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r["_ids"] == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    none = docs.limit(0)
    assert encode(none, PATH, build_lexicon(none, PATH)).count() == 0


def test_lexicon_takes_whole_levels_of_frequent_words(spark):
    docs = spark.createDataFrame([("cat " * 9 + "dog " * 9 + "owl " * 4 + "elk elk bee",)], "text string")
    for words, want in [(1, 0), (2, 2), (3, 3), (4, 4), (9, 5)]:
        assert len(Lexicon(SparkFiles.get(build_lexicon(docs, PATH, words=words))).starts) == want
