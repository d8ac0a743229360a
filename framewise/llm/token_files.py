"""Token ids as patched frame-of-reference blocks in an ordered, indexed table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import partitions, shared_path, table
from framewise.llm.tokens import encoder, slices

MAGIC = b"PFR1"
BLOCK = 256
SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<bigint>, body binary"
DOCS = "doc_id long, start long, n_tokens long, ids array<int>"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below ``2**width`` as ``width`` 64-bit words each."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((width, values.shape[0]), np.uint64)
    for j in range(64 if width else 0):
        word, bit = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - bit)
    return out.T


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((64, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, bit = divmod(j * width, 64)
        out[j] = columns[word] >> np.uint64(bit)
        if bit + width > 64:
            out[j] |= columns[word + 1] << np.uint64(64 - bit)
        out[j] &= mask
    return out.T


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Blocks of 256 values: minimum, width and packed low bits, then the exceptions' high bits.

    The width of a block is the bit length that ``percentile`` of its values need after the
    minimum is subtracted; longer values keep their low bits in place and list place and high bits.
    An index of the blocks' starts stands in front.  The last block is filled up with its minimum.
    """
    n = len(ids)
    count = -(-n // BLOCK)
    values = np.zeros(count * BLOCK, np.int64)
    values[:n] = ids
    if n:
        values[n:] = ids[(count - 1) * BLOCK :].min()
    values = values.reshape(count, BLOCK)
    low = values.min(1) if count else np.zeros(0, np.int64)
    rest = values - low[:, None]
    bits = bit_lengths(rest)
    place = int(np.ceil(percentile * BLOCK)) - 1
    widths = np.partition(bits, place, 1)[:, place] if count else np.zeros(0, np.int64)
    packed: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        words = pack_words((rest[rows] & ((1 << width) - 1)).reshape(-1, 64), width).astype("<u8")
        for row, body in zip(rows.tolist(), words.reshape(len(rows), -1)):
            packed[row] = body.tobytes()
    rows, places = np.nonzero(bits > widths[:, None])
    high = (rest[rows, places] >> widths[rows]).astype("<u4").tobytes()
    extra = np.bincount(rows, minlength=count)
    ends = np.cumsum(extra)
    places = places.astype("u1").tobytes()
    blocks = [
        struct.pack("<IBH", least, width, b - a) + body + places[a:b] + high[4 * a : 4 * b]
        for least, width, body, a, b in zip(low.tolist(), widths.tolist(), packed, (ends - extra).tolist(), ends.tolist())
    ]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return struct.pack("<QI", n, count) + starts.astype("<u4").tobytes() + b"".join(blocks)


def decode_blocks(body: memoryview, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks ``first`` to ``last`` (all by default), found by the index."""
    n, count = struct.unpack_from("<QI", body)
    last = count if last is None else min(last, count)
    starts = np.frombuffer(body, "<u4", count, 12).astype(np.int64) + 12 + 4 * count
    chosen = starts[first:last].tolist()
    heads = [struct.unpack_from("<IBH", body, at) for at in chosen]
    out = np.empty((len(chosen), BLOCK), np.int64)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        size = BLOCK // 64 * width * 8
        words = np.frombuffer(b"".join(bytes(body[chosen[r] + 7 : chosen[r] + 7 + size]) for r in rows), "<u8")
        out[rows] = unpack_words(words.reshape(len(rows) * (BLOCK // 64), width), width).reshape(len(rows), BLOCK)
    for r, (at, (low, width, extra)) in enumerate(zip(chosen, heads)):
        if extra:
            at += 7 + BLOCK // 64 * width * 8
            places = np.frombuffer(body, "u1", extra, at)
            out[r, places] |= np.frombuffer(body, "<u4", extra, at + extra).astype(np.int64) << width
        out[r] += low
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def segment_body(docs: list[np.ndarray]) -> bytes:
    sizes = np.array([len(d) for d in docs], "<u8")
    return MAGIC + struct.pack("<I", len(docs)) + sizes.tobytes() + encode_blocks(np.concatenate(docs))


def segment_docs(body: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the documents and all their ids."""
    if body[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    (docs,) = struct.unpack_from("<I", body, 4)
    return np.frombuffer(body, "<u8", docs, 8).astype(np.int64), decode_blocks(body[8 + 8 * docs :])


def segment_writer(path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, held, names, docs = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([segment_body(docs)], pa.binary())],
                names=["part", "segment", "n_tokens", "doc_ids", "body"],
            )

        for batch in batches:
            for some in slices(batch, 1):
                for name, ids in zip(some.column(0).to_pylist(), encoder(path).encode(some.column(1))):
                    names.append(name)
                    docs.append(np.append(ids, np.int32(end_id)))
                    held += len(docs[-1])
                    if held >= segment_tokens:
                        yield close()
                        segment, held, names, docs = segment + 1, 0, [], []
        if docs:
            yield close()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = 1 << 20,
) -> None:
    """Write the ids of all documents in ascending id order as segments below ``path``.

    Documents are range-partitioned by id (ties by a hash of the text, so that no id is too large
    for a task), and ``part, segment`` number the segments in that order; a segment ends with the
    document that reaches ``segment_tokens``.

    Defined cases: NULL text is empty, so only the end id; rows without id come first; rows that
    repeat an id all stay, in the order of a hash of their text.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    (
        rows.repartitionByRange(partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(segment_writer(tokenizer, end_id, segment_tokens), SEGMENTS)
        .write.parquet(path)
    )


def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, names, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            sizes, ids = segment_docs(memoryview(body.as_buffer()))
            starts = np.cumsum(sizes) - sizes
            flat = pa.array(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(base + starts), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, sizes.sum()).astype(np.int32)), flat)],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def crc_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the checksum of their ids in place of the ids."""
    for batch in batches:
        crcs = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def segment_index(spark: SparkSession, path: str) -> DataFrame:
    """``part, segment, base``: how many ids stand before each segment.

    Sums run inside a part; only one total a part meets the others in a single window.
    """
    sizes = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(parts, "part").select("part", "segment", (F.col("local") + F.col("part_base")).alias("base"))


def read_token_files(spark: SparkSession, path: str, then=None, schema: str = DOCS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files.

    ``then`` maps these batches further inside the same task; ``schema`` is that of its result.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    placed = segments.join(segment_index(spark, path), ["part", "segment"]).select("base", "doc_ids", "body")
    return placed.mapInArrow((lambda batches: then(read_docs(batches))) if then else read_docs, schema)


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, crc_docs, "doc_id long, start long, n_tokens long, ids_crc32 long")
