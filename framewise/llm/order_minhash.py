"""Order MinHash fingerprints, sensitive to edits that move or replace text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import partitions, table

EMPTY = 0  # slot of a text without words
FEW = 8  # texts of fewer words go by characters
CHUNK = 1 << 17  # k-mers handled at a time
BATCH_CHARS = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def orders(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of each slot's own order of 64-bit values: ``(value ^ b) * a`` with a odd."""
    i = np.arange(slots, dtype=np.uint64)
    return mix(i * ODD + np.uint64(1)) | np.uint64(1), mix(i * ODD + np.uint64(2))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens and how many each text has.

    Tokens are words; a text of fewer than ``FEW`` words has its characters instead.
    """
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[keep.to_numpy(zero_copy_only=False)]
    words = flat.filter(keep).dictionary_encode()
    table_ = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    hashes = table_[words.indices.to_numpy()] if len(table_) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(texts))
    few = (sizes < FEW) & (sizes > 0)
    if not few.any():
        return hashes, sizes
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    for i in np.flatnonzero(few):
        codes = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4")
        parts[i] = mix(codes.astype(np.uint64) + np.uint64(1 << 32))
    return np.concatenate(parts), np.array([len(p) for p in parts])


def kmers(hashes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts' occurrence-numbered k-mers in text order, and how many each text has.

    A k-mer is ``k`` successive tokens (a shorter text is one k-mer) with its occurrence number.
    """
    starts = np.cumsum(sizes) - sizes
    n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), n)
    at = starts[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    kmer = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = i < sizes[doc]
        kmer = mix(kmer * ODD + np.where(inside, hashes[np.minimum(at + i, len(hashes) - 1)], np.uint64(i))) if len(at) else kmer
    # equal k-mers of a text stand together, in text order
    order = np.lexsort((kmer, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (kmer[order][1:] != kmer[order][:-1])
    number = np.empty(len(order), np.uint64)
    run = np.arange(len(order))
    number[order] = (run - np.maximum.accumulate(np.where(fresh, run, 0))).astype(np.uint64)
    return mix(kmer + number * ODD), n


def signatures(texts: list[str], k: int, length: int, slots: int) -> np.ndarray:
    """Signatures of all texts, ``slots`` 32-bit values each (all 0: a text without words).

    Each slot orders all occurrence-numbered k-mers of the whole text in a way of its own.  Its
    ``length`` smallest are put back into text order, and the ordered tuple is hashed.
    """
    value, n = kmers(*tokens(texts), k)
    ends = np.cumsum(n)
    out = np.zeros((len(texts), slots), np.uint32)
    a, b = orders(slots)
    lo = 0
    while lo < len(texts):  # some texts at a time, so that a slot's work stays in the cache
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + CHUNK, "right")))
        rows = lo + np.flatnonzero(n[lo:hi])
        part = value[ends[lo] - n[lo] : ends[hi - 1]]
        lo = hi
        if not len(rows):
            continue
        out[rows] = _slots(part, n[rows], a, b, length)
    return out


def _slots(value: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """All slots of texts whose k-mers stand one after the other, ``size`` of each."""
    starts, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    places = np.full((len(a), length, len(size)), len(value), np.int64)
    enough = [size > r for r in range(length)]
    for s in range(len(a)):
        rank = (value ^ b[s]) * a[s]
        for r in range(length):
            least = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero(rank == least[owner])
            if len(hit) == len(size) and enough[r].all():
                places[s, r] = hit
                rank[hit] = top
            else:  # ties, of which the first is taken, or texts with fewer k-mers
                hit = hit[enough[r][owner[hit]]][::-1]
                places[s, r, owner[hit]] = hit
                rank[places[s, r][enough[r]]] = top
    places.sort(axis=1)
    value = np.append(value, np.uint64(0))
    h = np.zeros((len(a), len(size)), np.uint64)
    for r in range(length):
        h = np.where(places[:, r] < len(value) - 1, mix(h * ODD + value[places[:, r]] + np.uint64(1)), h)
    return np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32).T


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either text fills; 1 if neither has any k-mer."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    return np.where(n > 0, ((a == b) & some).sum(1) / np.maximum(n, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one, or all."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def printer(k: int, length: int, slots: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows: list[tuple[int | None, str]], following: tuple[int | None, str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        others = [*texts[1:], following[1]]
        changed = [edited(t, o) for t, o in zip(texts, others)]
        # texts, edited texts and the first text of the next batch in one go
        all_prints = signatures([*texts, following[1], *changed], k, length, slots)
        own, after, altered = all_prints[: len(rows)], all_prints[1 : len(rows) + 1], all_prints[len(rows) + 1 :]
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
             pa.array([as_text(s) for s in own]), pa.array([as_text(s) for s in altered]),
             pa.array(likeness(own, altered)), pa.array(likeness(own, after))],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        chars, now = 0, None
        for batch in batches:
            for bucket, tail, doc, text in zip(*[batch.column(i) for i in range(4)]):
                bucket, row = bucket.as_py(), (doc.as_py(), text.as_py() or "")
                if bucket != now and held:
                    raise ValueError(f"bucket {now} has no closing row")
                now = bucket
                if held and (tail.as_py() or chars > BATCH_CHARS):
                    yield finish(held, row)
                    held, chars = [], 0
                if not tail.as_py():
                    held.append(row)
                    chars += len(row[1])
        if held:
            raise ValueError(f"bucket {now} has no closing row")

    return run


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    k: int = 2, length: int = 2, slots: int = 128, rows_per_bucket: int | None = None,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and two likenesses.

    The edited text has its last half replaced by the start of the next document by id (after the
    last the first).  Documents are dealt into buckets by quantiles of the id; the first document
    of each bucket also closes the bucket before it, so neighbours meet although each bucket is a
    sorted stream of its own, whatever its length.  There are four buckets a shuffle partition (or
    one every ``rows_per_bucket`` rows), and the driver holds one id a bucket.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Defined cases: NULL text is empty; rows without id come first; rows of one id
    follow each other by a hash of their text; a single row is its own next document; texts
    without words are alike.  Equal texts have equal fingerprints.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    buckets = -(-n // rows_per_bucket) if rows_per_bucket else 4 * partitions(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.arrow_udf("int")
    def number(ids: pa.Array) -> pa.Array:
        """The cuts at or below an id; ids of NULL open the first bucket."""
        values = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(cuts, values, "right").astype(np.int32))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), number("doc_id").alias("bucket"))
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.min(own)).collect())  # a row a bucket
    # each head closes the bucket before its own, the first head the last bucket
    closes = {(head["doc_id"], head["tie"]): heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.arrow_udf("int")
    def closed(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([closes.get(x) for x in zip(ids.to_pylist(), ties.to_pylist())], pa.int32())

    tails = rows.select(closed("doc_id", "tie").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "text", "tie")
    tails = tails.where(F.col("bucket").isNotNull()).dropDuplicates(["bucket", "doc_id", "tie"])
    dealt = rows.select("bucket", F.lit(False).alias("tail"), "doc_id", "text", "tie").union(tails)
    return (
        dealt.repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "tail", "doc_id", "tie")
        .select("bucket", "tail", "doc_id", "text")
        .mapInArrow(printer(k, length, slots), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents").select("doc_id", "text"))
