"""BPE with a minimal acyclic transducer of frequent words and exact merges for all others."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import unicodedata
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import fresh, stored, table
from framewise.llm.tokens import BYTE_LETTERS, ODD, csr, gather, slices

# White space of Unicode, written out so that the pattern means the same in every library.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPECIAL = " "  # in front of special tokens; no word holds a blank
LONG = 48  # bytes; longer words are merged one at a time


# ------------------------------------------------------------------ the automaton


def compile_words(words: list[bytes]) -> bytes:
    """A minimal acyclic transducer from sorted distinct words to their ranks, as bytes.

    Words are added in order and the states that the next word cannot change are merged with equal
    ones, so suffixes are shared.  An arc adds the number of words that come before its own, and
    the sum on a word's path is its rank.  Layout: counts, then for each arc (by state and byte)
    its key ``state * 256 + byte``, target and addend, then the states that end a word.
    """
    finals, arcs = [False], [{}]
    register: dict[tuple, int] = {}
    path = [0]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (finals[state], tuple(arcs[state].items()))
            same = register.setdefault(key, state)
            label = next(reversed(arcs[path[-1]]))
            arcs[path[-1]][label] = same

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        for byte in word[common:]:
            arcs[path[-1]][byte] = len(arcs)
            path.append(len(arcs))
            arcs.append({})
            finals.append(False)
        finals[path[-1]] = True
        last = word
    settle(0)

    number, order, todo = {0: 0}, [0], [0]
    while todo:
        for target in arcs[todo.pop()].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
                todo.append(target)
    sizes: dict[int, int] = {}

    def size(root: int) -> int:
        stack = [root]
        while stack:
            state = stack[-1]
            missing = [t for t in arcs[state].values() if t not in sizes]
            if missing:
                stack.extend(missing)
            else:
                sizes[state] = finals[state] + sum(sizes[t] for t in arcs[state].values())
                stack.pop()
        return sizes[root]

    size(0)
    keys, targets, adds = [], [], []
    for i, state in enumerate(order):
        before = int(finals[state])
        for byte, target in sorted(arcs[state].items()):
            keys.append(i * 256 + byte)
            targets.append(number[target])
            adds.append(before)
            before += sizes[target]
    ends = np.array([finals[s] for s in order], "u1")
    return struct.pack("<II", len(keys), len(ends)) + b"".join(
        [np.array(keys, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(adds, "<u4").tobytes(), ends.tobytes()]
    )


class Automaton:
    """Looks up many words at a time in a compiled transducer, in place."""

    def __init__(self, body: memoryview | bytes | mmap.mmap, at: int = 0):
        arcs, states = struct.unpack_from("<II", body, at)
        at += 8
        self.keys, self.targets, self.adds = (np.frombuffer(body, "<u4", arcs, at + 4 * arcs * i) for i in range(3))
        self.ends = np.frombuffer(body, "u1", states, at + 12 * arcs)
        self.stop = at + 12 * arcs + states

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Ranks of byte strings (a fixed-width array), -1 for words that are not in it."""
        n, width = len(words), words.dtype.itemsize
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        rows, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        codes = words.view(np.uint8).reshape(n, width)
        for i in range(width + 1):
            code = codes[rows, i] if i < width else np.zeros(len(rows), np.uint8)
            over = code == 0  # words hold no zero byte
            done = over & (self.ends[state] > 0)
            out[rows[done]] = total[done]
            key = state * 256 + code
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = ~over & (self.keys[arc] == key)
            rows, arc = rows[go], arc[go]
            state, total = self.targets[arc].astype(np.int64), total[go] + self.adds[arc]
        return out


# ------------------------------------------------------------------ exact merges


class Merges:
    """The vocabulary and merge ranks of a word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told["added_tokens"]
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        pre = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        if not end or pre != ["NFC", "Replace", "Lowercase"] or model.get("dropout") is not None or told["decoder"] is not None:
            raise ValueError("this layout is not a lower-cased BPE with word ends")
        self.special = {a["content"]: a["id"] for a in added}
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.inside = np.array([self.vocab[BYTE_LETTERS[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[BYTE_LETTERS[b] + end] for b in range(256)], np.int64)
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        ranks = np.array(list(self.pairs.values()), np.int64)[order]
        self.keys, self.ranks, self.made = keys[order], ranks[:, 0], ranks[:, 1]
        self.texts = np.full(self.size, "", object)
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.texts[i] = text
        self.digits = np.array([str(i) for i in range(self.size)], object)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def one(self, word: bytes) -> list[int]:
        """Merges of one word by a queue of pairs; for long words."""
        ids = [*self.inside[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        queue: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (found := self.pairs.get((ids[i], ids[right[i]]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[right[i]], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = made, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def many(self, words: list[bytes]) -> list:
        """Merges of all words at once: in each round every word merges its first best pair."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self.one(words[i])
        none = np.iinfo(np.int64).max
        for size in np.unique(sizes[sizes <= LONG]).tolist():
            for rows in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // 16384)):
                codes = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), size)
                ids = self.inside[codes]
                ids[:, -1] = self.last[codes[:, -1]]
                width = np.full(len(rows), size)
                live = np.arange(len(rows))
                while len(live) and ids.shape[1] > 1:
                    now = ids[live]
                    key = now[:, :-1] * self.size + now[:, 1:]
                    key[np.arange(size - 1) >= (width[live] - 1)[:, None]] = -1
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    rank = np.where(self.keys[at] == key, self.ranks[at], none)
                    best = rank.argmin(1)
                    line = np.arange(len(live))
                    can = rank[line, best] < none
                    live, now, best, at = live[can], now[can], best[can], at[can]
                    line = np.arange(len(live))
                    made = self.made[at[line, best]]
                    columns = np.arange(size)
                    source = np.minimum(columns + (columns > best[:, None]), size - 1)
                    now = np.take_along_axis(now, source, 1)
                    now[line, best] = made
                    ids[live] = now
                    width[live] -= 1
                for i, row, n in zip(rows.tolist(), ids.tolist(), width.tolist()):
                    out[i] = row[:n]
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


# ------------------------------------------------------------------ texts to words


def split_texts(texts: pa.Array, tables: Merges) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the words of the texts in order, and how many each text has.

    Texts of common characters are cut at blanks first, and only distinct parts meet the pattern.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD)
    easy = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
    parts = easy.flatten().dictionary_encode()
    number: dict[str, int] = {}
    found = [WORDS.findall(p) for p in parts.dictionary.to_pylist()]
    starts, sizes, flat = csr([[number.setdefault(w, len(number)) for w in ws] for ws in found])
    index = parts.indices.to_numpy().astype(np.int64)
    words = gather(index, starts, sizes, flat)
    edges = np.concatenate([[0], np.cumsum(sizes[index])])[easy.offsets.to_numpy()]
    done = iter(np.split(words, edges[1:-1]) if len(easy) else [])
    hard = iter(texts.filter(odd).to_pylist())

    def whole(text: str) -> np.ndarray:
        out, at = [], 0
        for m in [*(tables.cut.finditer(text) if tables.cut else ()), None]:
            plain = unicodedata.normalize("NFC", text[at : m.start() if m else len(text)])
            out += WORDS.findall("".join([c.lower() for c in plain]))
            if m:
                out.append(SPECIAL + m[0])
                at = m.end()
        return np.array([number.setdefault(w, len(number)) for w in out], np.int32)

    rows = [whole(next(hard)) if o else next(done) for o in odd.to_pylist()]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return list(number), np.concatenate(rows) if rows else np.zeros(0, np.int32), counts


def count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0):
                words, index, _ = split_texts(some.column(0), merges(path))
                counts = np.bincount(index, minlength=len(words))
                keep = [i for i, w in enumerate(words) if w[0] != SPECIAL]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in keep], pa.string()), pa.array(counts[keep])], names=["word", "n"]
                )

    return run


# ------------------------------------------------------------------ the lexicon file


def lexicon_bytes(words: list[str], tables: Merges) -> bytes:
    """The automaton of the words and, by rank, their ids."""
    keys = sorted({w.encode() for w in words if w and "\0" not in w})
    body = compile_words(keys)
    body += b"\0" * (-len(body) % 4)
    starts, sizes, flat = csr(tables.many(keys))
    edges = np.append(starts, len(flat)).astype("<u4")
    return struct.pack("<I", len(body)) + body + struct.pack("<I", len(keys)) + edges.tobytes() + flat.astype("<u4").tobytes()


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        (size,) = struct.unpack_from("<I", self.map)
        self.automaton = Automaton(self.map, 4)
        (n,) = struct.unpack_from("<I", self.map, 4 + size)
        edges = np.frombuffer(self.map, "<u4", n + 1, 8 + size).astype(np.int64)
        self.starts, self.sizes = edges[:-1], np.diff(edges)
        self.flat = np.frombuffer(self.map, "<u4", int(edges[-1]), 12 + size + 4 * n)


@lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = 1 << 16) -> str:
    """Compile at most ``words`` of the most frequent words of all documents; the name of the file on executors.

    Words are counted over the whole corpus.  A histogram of their counts, with 16 levels an octave,
    tells the lowest level down to which no more than ``words`` words lie, and only these words
    reach the driver.  The file's size is bounded by ``words``, which only decides how many words
    need no merging, never what their ids are; Spark ships it to executors.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count_words(tokenizer), "word string, n long")
    summed = found.groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(summed.withColumn("level", F.floor(16 * F.log2("n")).cast("int")), "words")
    sizes = sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True)  # at most 16 * 63 levels
    ends = np.cumsum([n for _, n in sizes])
    levels = [level for (level, _), end in zip(sizes, ends) if end <= words]
    top = counted.where(F.col("level") >= levels[-1]).select("word").collect() if levels else []
    body = lexicon_bytes([r.word for r in top], merges(tokenizer))
    name = f"lexicon-{uuid.uuid4().hex}"  # a session takes each file name once
    path = os.path.join(tempfile.mkdtemp(prefix="framewise-"), name)
    with open(path, "wb") as f:
        f.write(body)
    spark.sparkContext.addFile(path)
    return name


def encode_batch(texts: pa.Array, tables: Merges, known: Lexicon) -> list[np.ndarray]:
    """Ids of each text: words by automaton, the others by exact merges."""
    words, index, counts = split_texts(texts, tables)
    raw = [w.encode() if w[0] != SPECIAL else b"" for w in words]
    short = np.array([w if len(w) <= LONG and b"\0" not in w else b"" for w in raw], f"S{LONG}")
    rank = known.automaton.ranks(short)
    hit = np.flatnonzero(rank >= 0)
    miss = [i for i in np.flatnonzero(rank < 0).tolist()]
    merged = iter(tables.many([raw[i] for i in miss if raw[i]]))
    extra = [next(merged) if raw[i] else [tables.special[words[i][1:]]] for i in miss]
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    own_starts, own_sizes, own = csr(extra)
    starts[hit], sizes[hit] = known.starts[rank[hit]], known.sizes[rank[hit]]
    starts[miss], sizes[miss] = own_starts + len(known.flat), own_sizes
    ids = gather(index, starts, sizes, np.concatenate([known.flat.astype(np.int32), own]))
    ends = np.concatenate([[0], np.cumsum(sizes[index])])
    return np.split(ids, ends[np.cumsum(counts)][:-1]) if len(counts) else []


def encoder(path: str, name: str, text: int, carried: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text):
                rows = encode_batch(some.column(text), merges(path), lexicon(name))
                edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in carried], ids], names=names)

    return run


def encode(
    docs: DataFrame, tokenizer: str, lexicon_name: str, text_col: str = "text", carry: list[str] | None = None,
    then=None, result: str | None = None,
) -> DataFrame:
    """Append ``ids`` (under another name if taken) to the columns ``carry``.

    The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False).ids`` without
    truncation and padding, whatever the lexicon holds: special tokens are cut out first, the text
    is normalised and split into words, and a word's ids come from the transducer or from merging.
    ``then`` maps these batches further inside the same task; ``result`` is its schema.

    Defined cases: NULL text is empty and has no ids; texts of any length are encoded whole.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col(f"`{c}`") for c in carry])
    out, text = fresh(kept, "ids", "words")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).alias(text))
    n = len(carry)
    run = encoder(tokenizer, lexicon_name, n, list(range(n)), schema.names)
    return source.mapInArrow((lambda batches: then(run(batches))) if then else run, result or schema)


def decode_ids(ids: np.ndarray, tables: Merges) -> str:
    """As ``Tokenizer.decode(ids, skip_special_tokens=False)``: this layout has no decoder step."""
    return " ".join(tables.texts[ids].tolist())


def decode(frame: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Append ``decoded`` (under another name if taken): the text of the ids; NULL ids are empty."""
    (out,) = fresh(frame, "decoded")
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.StringType())])
    at = frame.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.values.to_numpy() if x.is_valid else np.zeros(0, int), merges(tokenizer)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def digests(path: str):
    """Rows (doc_id, ids) to the digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = merges(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = [x.values.to_numpy() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([sha(" ".join(tables.digits[r].tolist())) for r in rows], pa.string()),
                 pa.array([sha(decode_ids(r, tables)) for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, path, build_lexicon(docs, path), carry=["doc_id"], then=digests(path), result=schema)
