"""SimHash near-duplicates by a grid over per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import LOWER, UPPER, fresh, stored, table
from framewise.llm.components import components

SEGMENTS = 32  # of two bits each
ODD_BITS = 0x5555555555555555
STEP = 1 << 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is set if over half of the shingles' hashes have it; no word gives 0."""
    words = text.translate(LOWERED).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        some = words[at : min(at + STEP, total) + shingle - 1]
        runs = zip(*[some[i:] for i in range(shingle)])
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set if over half of them have it; none give 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        some = hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def printer(text: int, carried: list[int], shingle: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(text).cast(pa.binary())
            prints = np.array([fingerprint(x.as_py() or b"", shingle) for x in column], "<u8").view("<i8")
            rows = np.arange(row, row + len(batch))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in carried], pa.array(prints), pa.array(rows)], names=names)

    return run


def bit_counts(value: Column) -> Column:
    """Every two-bit segment's count of set bits, in unary: 0, 1, 3.

    The Hamming distance of two such codes is the Manhattan distance of the counts, a lower bound
    of the Hamming distance of the fingerprints.
    """
    odd = F.lit(ODD_BITS)
    high = F.shiftrightunsigned(value, 1)
    some = value.bitwiseOR(high).bitwiseAND(odd)
    both = value.bitwiseAND(high).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def unary(values: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(ODD_BITS), np.uint64(1)
    high = values >> one
    return ((values | high) & odd) | ((values & high & odd) << one)


def grid_masks(radius: int, groups: int) -> list[int]:
    """Masks of all choices of ``groups - radius`` groups of neighbouring segments.

    Counts within Manhattan distance ``radius`` differ in at most ``radius`` groups, so they share
    the grid cell of at least one choice.
    """
    parts = np.array_split(np.arange(SEGMENTS), groups)
    masks = [sum(3 << (2 * int(s)) for s in p) for p in parts]
    chosen = [sum(c) for c in combinations(masks, groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def enough_groups(n: int, radius: int) -> int:
    """The fewest groups with which a fingerprint is expected to meet under one other by chance."""
    alike = 0.375  # two random segments have equal counts: (1 + 4 + 1) / 16
    for groups in range(radius + 2, 4 * radius + 5):
        if n * comb(groups, radius) * alike ** (SEGMENTS * (groups - radius) / groups) <= 1:
            break
    return groups


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are near: the bound by counts first, the exact distance of those it leaves."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= radius
    near[near] = np.bitwise_count((a ^ b)[near]) <= radius
    return near


def link_cells(radius: int):
    """Rows (members, blocks, i, j) of cells to links; a large block gives a spanning star each."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def big(values: np.ndarray, blocks: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        near = near_pairs(*np.broadcast_arrays(values[:, None], values[None, :]), radius)
        if i != j:
            near &= blocks[:, None] != blocks[None, :]
        labels = np.arange(len(values))
        while True:
            new = np.minimum(labels, np.where(near, labels[None, :], len(values)).min(1))
            if (new == labels).all():
                break
            labels = new[new]
        moved = labels != np.arange(len(values))
        return values[moved], values[labels[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            starts = batch.column(0).offsets.to_numpy()[:-1]
            flat = batch.column(0).values.to_numpy().view(np.uint64)
            blocks = batch.column(1).values.to_numpy()
            i, j = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size <= 32:
                    first, second = np.triu_indices(size, 1)
                    for some in np.array_split(rows, -(-len(rows) * len(first) // STEP) or 1):
                        places = starts[some][:, None] + np.arange(size)
                        values, block = flat[places], blocks[places]
                        near = near_pairs(values[:, first], values[:, second], radius)
                        near &= (i[some] == j[some])[:, None] | (block[:, first] != block[:, second])
                        us.append(values[:, first][near])
                        vs.append(values[:, second][near])
                else:
                    for r in rows.tolist():
                        part = slice(starts[r], starts[r] + size)
                        u, v = big(flat[part], blocks[part], i[r], j[r])
                        us.append(u)
                        vs.append(v)
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def near_links(prints: DataFrame, radius: int = 3, groups: int | None = None, block_rows: int = 1024) -> DataFrame:
    """Links ``u, v`` that connect all pairs of distinct values ``print`` at ``radius`` or fewer bits.

    Values become points of 32 bit counts, points fall into grid cells, and only points that share
    a cell are compared, by Manhattan distance and then exactly.  Cells are counted first; a cell
    of more than ``block_rows`` points is dealt into blocks, and each pair of blocks is a task of
    its own that returns a star per group instead of its pairs.
    """
    groups = groups or enough_groups(prints.count(), radius)
    if groups <= radius:
        raise ValueError("the grid needs more groups than the radius")
    masks = F.lit(np.array(grid_masks(radius, groups), np.int64))
    cells = prints.select("print", F.posexplode(F.transform(masks, lambda m: bit_counts(F.col("print")).bitwiseAND(m))).alias("choice", "cell"))
    counts = stored(
        cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 1), "cells"
    )
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    shared = cells.join(counts, ["choice", "cell"]).select(
        "choice", "cell", "print", blocks.alias("blocks"), F.pmod(F.xxhash64("print"), blocks).cast("int").alias("block")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = shared.select("choice", "cell", "print", "block", other).select(
        "choice", "cell", "print", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    # block pairs (i, i) hold the pairs inside a block, (i, j) those across
    tasks = dealt.groupBy("choice", "cell", "i", "j").agg(F.collect_list(F.struct("print", "block")).alias("m"))
    rows = tasks.where(F.size("m") > 1).select("m.print", "m.block", "i", "j")
    return rows.mapInArrow(link_cells(radius), "u long, v long").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Near-duplicate groups of documents by 64-bit fingerprints of word shingles.

    Returns the columns ``carry`` (default: all of ``docs``) with ``fingerprint`` (16 hex digits),
    ``component_id`` (the smallest id reachable over links of at most ``radius`` differing bits) and
    ``is_first`` (one row a component, the smallest id's first) appended, under other names if taken.

    Texts are read once, and each distinct fingerprint is one point, so copies cost nothing
    further; links, components and fingerprints stay distributed.

    Defined cases: words are runs without blanks after lower-casing A to Z; a text of fewer words
    than a shingle is one shingle; NULL, empty or blank text has fingerprint zero, which links like
    any other.  A row without id joins its component but names it only if no row has an id (then
    ``component_id`` is NULL).  Rows that repeat an id are rows like others.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col(f"`{c}`") for c in carry])
    out_print, out_id, out_first = fresh(kept, "fingerprint", "component_id", "is_first")
    name, text, mark, row = fresh(kept, "id", "words", "print", "row")
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(id_col).alias(name), F.col(text_col).alias(text))
    schema = T.StructType([
        *source.schema.fields[:-1], T.StructField(mark, T.LongType()), T.StructField(row, T.LongType())
    ])
    width = len(source.columns) - 1
    prints = stored(source.mapInArrow(printer(width, list(range(width)), shingle, schema.names), schema), "prints")
    own = F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("id"), F.col(row).alias("row"))
    classes = stored(prints.groupBy(F.col(mark).alias("print")).agg(F.min(own).alias("first")), "classes")
    labels = components(near_links(classes.select("print"), radius))
    labelled = classes.join(labels, classes["print"] == labels["node"], "left").select(
        "print", "first", F.coalesce("label", "print").alias("label")
    )
    tops = labelled.groupBy("label").agg(F.min("first").alias("top"))
    named = stored(labelled.join(tops, "label").select("print", "top"), "named")
    return prints.join(named, prints[mark] == named["print"]).select(
        *[prints[c] for c in carry],
        F.lower(F.lpad(F.hex(prints[mark]), 16, "0")).alias(out_print),
        F.col("top.id").alias(out_id),
        (prints[row] == F.col("top.row")).alias(out_first),
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simhash_groups(docs, shingle=3, radius=3, carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")
