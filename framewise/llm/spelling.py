"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import ascii_lower, partitions, stored, table

LONG = 64  # words of this length or more share a shard
LANES = 8  # a block is 8 lanes of 32 bits, and a word sets one bit in each
BITS = 20  # bits of filter a word
SEGMENT = 2048  # blocks that one task fills
FILTER_BYTES = 16 << 20  # of all filters that are broadcast at a time
PROBES = 1 << 20  # edits that are tested at a time

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value (the splitmix64 finaliser)."""
    x = (x + _U(0x9E3779B97F4A7C15)).astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SALTS = (_mix(np.arange(LANES, dtype=_U)) & _U(0xFFFFFFFF)) | _U(1)


def letter_hash(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Share of a code point at a place; a word's hash is the sum of its shares."""
    return _mix((place.astype(_U) << _U(21)) | code.astype(_U))


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and code points (rows x length) of the words of each length."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        if length:
            codes = np.frombuffer("".join([texts[r] for r in rows]).encode("utf-32-le"), "<u4")
            yield int(length), rows, codes.reshape(len(rows), length)


def word_hash(codes: np.ndarray) -> np.ndarray:
    return letter_hash(np.arange(codes.shape[1]), codes).sum(axis=1, dtype=_U)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of the filter's parts holds a word."""
    return (_mix(hashes) >> _U(33)) % _U(parts)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(blocks)) >> _U(32)


def lane_bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return (((hashes & _U(0xFFFFFFFF)) * SALTS[lane]) & _U(0xFFFFFFFF)) >> _U(27)


def fill(hashes: np.ndarray, blocks: int, first: int, count: int) -> np.ndarray:
    """The blocks from ``first`` of a filter of ``blocks`` that holds the hashes."""
    lanes = np.zeros((count, LANES), np.uint32)
    at = (block_of(hashes, blocks) - _U(first)).astype(np.int64)
    for k in range(LANES):
        np.bitwise_or.at(lanes[:, k], at, np.uint32(1) << lane_bit(hashes, k).astype(np.uint32))
    return lanes


def held(lanes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that a filter holds (with few that it does not)."""
    at = block_of(hashes, len(lanes)).astype(np.int64)
    alive = np.arange(len(hashes))
    for k in range(LANES):
        bits = lanes[at[alive], k] >> lane_bit(hashes[alive], k).astype(np.uint32)
        alive = alive[(bits & np.uint32(1)) == 1]
    return alive


def edits(codes: np.ndarray, alphabets: dict[int, np.ndarray], lengths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Edits of words of one length: ``length, rows, hashes, place, codes`` a batch.

    An edit drops a code point or puts a larger one in its place (codes -1 for a drop), so each
    pair of words one edit apart is met once, from its longer or its smaller word.  Of equal code
    points in a row only the first is dropped.  Only lengths and code points that the vocabulary
    has are tried.  A hash follows from that of the whole word without reading the word again.
    """
    count, length = codes.shape
    places = np.arange(length)
    shares = letter_hash(places, codes)
    whole = shares.sum(axis=1, dtype=_U)
    if length > 1 and min(length - 1, LONG) in lengths:
        moved = letter_hash(places[1:] - 1, codes[:, 1:])
        tail = moved.sum(axis=1, dtype=_U)
        head = np.zeros(count, _U)
        for i in range(length):
            if i:
                head = head + shares[:, i - 1]
                tail = tail - moved[:, i - 1]
            rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(count)
            yield length - 1, rows, (head + tail)[rows], i, np.full(len(rows), -1, np.int64)
    letters = alphabets.get(min(length, LONG))
    if letters is None:
        return
    step = max(1, PROBES // len(letters))
    for i in range(length):
        new = letter_hash(np.full(len(letters), i), letters)
        for lo in range(0, count, step):
            part = codes[lo : lo + step, i]
            rows, which = np.nonzero(letters[None, :] > part[:, None])
            rows += lo
            yield length, rows, whole[rows] - shares[rows, i] + new[which], i, letters[which].astype(np.int64)


def edited(codes: np.ndarray, place: int, new: np.ndarray) -> list[str]:
    """The words with the code point at ``place`` dropped (-1) or replaced."""
    if not len(codes):
        return []
    if new[0] < 0:
        codes = np.delete(codes, place, axis=1)
    else:
        codes = codes.copy()
        codes[:, place] = new
    text, width = codes.astype("<u4").tobytes().decode("utf-32-le"), codes.shape[1]
    return [text[k : k + width] for k in range(0, len(text), width)]


def _filters(words: DataFrame, blocks: dict[int, int], parts: int, part: int) -> dict[int, np.ndarray]:
    """The filters of one part of the vocabulary, by shard, filled in Spark a segment at a time."""

    def deal(batches):
        for batch in batches:
            rows = []
            for length, _, codes in by_length(batch.column("word")):
                hashes = word_hash(codes)
                hashes = hashes[part_of(hashes, parts) == part]
                shard = min(length, LONG)
                segment = block_of(hashes, blocks[shard]) // _U(SEGMENT)
                for s in np.unique(segment):
                    rows.append((shard, int(s), hashes[segment == s].tobytes()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "segment", "hashes"), r)) for r in rows],
                pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("hashes", pa.binary())]),
            )

    def fill_segment(key, group):
        shard, segment = key[0].as_py(), key[1].as_py()
        first = segment * SEGMENT
        count = min(SEGMENT, blocks[shard] - first)
        lanes = np.zeros((count, LANES), np.uint32)
        for h in group.column("hashes"):
            lanes |= fill(np.frombuffer(h.as_buffer(), _U), blocks[shard], first, count)
        return pa.table({"shard": [shard], "segment": [segment], "lanes": [lanes.tobytes()]}, pa.schema(
            [("shard", pa.int32()), ("segment", pa.int32()), ("lanes", pa.binary())]
        ))

    dealt = words.mapInArrow(deal, "shard int, segment int, hashes binary")
    filled = dealt.groupBy("shard", "segment").applyInArrow(fill_segment, "shard int, segment int, lanes binary")
    out = {shard: np.zeros((n, LANES), np.uint32) for shard, n in blocks.items()}
    for r in filled.toLocalIterator():
        lanes = np.frombuffer(bytes(r["lanes"]), np.uint32).reshape(-1, LANES)
        out[r["shard"]][r["segment"] * SEGMENT :][: len(lanes)] = lanes
    return out


def near_words(vocab: DataFrame, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """``word, n, other, other_n``: each pair of words of ``vocab`` (``word, n``) one edit apart, once.

    The vocabulary becomes blocked Bloom filters, one per word length, which are broadcast; every
    word's edits are generated in its task and only those that a filter holds are shuffled to an
    exact join with the vocabulary.  All filters together take ``filter_bytes`` at most: a larger
    vocabulary is dealt into parts by hash, and the words are probed once per part.

    Defined cases: words are distinct; NULL and the empty word take no part.
    """
    spark = vocab.sparkSession
    words = vocab.where(F.col("word") != "").select("word", "n")
    shard = F.least(F.char_length("word"), F.lit(LONG))
    # at most 64 rows, and the distinct code points by length
    counts = {r[0]: r[1] for r in words.groupBy(shard.alias("shard")).count().collect()}
    letters: dict[int, list[int]] = {}
    for r in words.select(shard.alias("shard"), F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct().collect():
        letters.setdefault(r["shard"], []).append(ord(r["c"]))
    alphabets = {s: np.sort(np.array(c, np.uint32)) for s, c in letters.items()}
    width = LANES * 32
    parts = max(1, -(-sum(counts.values()) * bits // 8 // filter_bytes))
    blocks = {s: max(1, -(-n * bits // (width * parts))) for s, n in counts.items()}
    spread = words.repartition(partitions(spark), "word")
    out = None
    for part in range(parts):
        shared = spark.sparkContext.broadcast(_filters(words, blocks, parts, part))

        def probe(batches, part=part, shared=shared):
            filters = shared.value
            for batch in batches:
                for length, rows, codes in by_length(batch.column("word")):
                    at, others = [], []
                    for to, src, hashes, place, new in edits(codes, alphabets, set(filters)):
                        if parts > 1:
                            mine = np.flatnonzero(part_of(hashes, parts) == part)
                            src, hashes, new = src[mine], hashes[mine], new[mine]
                        hit = held(filters[min(to, LONG)], hashes)
                        at.append(src[hit])
                        others += edited(codes[src[hit]], place, new[hit])
                    picked = pa.array(rows[np.concatenate(at)] if at else [], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("word").take(picked), batch.column("n").take(picked), pa.array(others, pa.string())],
                        ["word", "n", "other"],
                    )

        found = spread.mapInArrow(probe, "word string, n long, other string")
        exact = found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        exact = stored(exact.select("word", "n", "other", "other_n"), "near")
        shared.unpersist()
        out = exact if out is None else out.unionByName(exact)
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """``word, n`` of the contract's words: runs of Latin letters, some with a letter dropped by hash.

    NULL text has no words; in a row without id no letter is dropped.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower(F.col("run")))
    run = run.select("id", lowered.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = run.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def spelling_groups(vocab: DataFrame, factor: int = 10, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocab`` (``word, n``).

    A word's form is its near word of largest n (ties: the smallest word) if that is ``factor``
    times its own n or more.  Forms are followed to the last by doubling: counts grow by the
    factor each time, so a chain is at most as long as the counts have digits.

    Defined cases: words are distinct; NULL and the empty word are left out; an empty vocabulary
    gives an empty table.
    """
    vocab = stored(vocab.where(F.col("word") != "").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = near_words(vocab, filter_bytes, bits)
    here, there = F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        pairs.select(F.inline(F.array(here, there))).groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    )
    best_n = -F.col("best.minus")
    chosen = best_n >= factor * F.col("n")
    rows = stored(
        vocab.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, best_n).alias("form_n"),
        ),
        "forms",
    )
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        steps = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = stored(roots.join(steps, "root", "left"), "roots")
        roots = followed.select("word", F.coalesce("next", "root").alias("root"))
        if followed.where(F.col("next").isNotNull()).isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling_groups(word_counts(docs).where(F.col("n") >= 2))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'), lambda r:
      translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT run, n, hex(id || ':' || run) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN vocab b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN vocab b ON a.cut = b.word),
ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
         CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN ranked k ON v.word = k.word AND r = 1),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
