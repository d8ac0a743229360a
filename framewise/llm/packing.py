"""Packing of token sequences into windows by non-negative least squares on length counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import shared_path, table
from framewise.llm.tokens import encoder, slices

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids array<int>"
)


# ------------------------------------------------------------------ the plan, on the histogram


def shallow_combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of present lengths that fill a window; one row each, 0 for no third."""
    lengths = np.unique(lengths)
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    pairs = [(a, window - a, 0) for a in lengths.tolist() if 2 * a <= window and present[window - a]]
    triples = []
    for a in lengths[3 * lengths <= window].tolist():
        second = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        third = window - a - second
        second, third = second[present[third]], third[present[third]]
        triples.append(np.stack([np.full(len(second), a), second, third], 1))
    return np.concatenate([np.array(pairs, np.int64).reshape(-1, 3), *triples]).astype(np.int64)


def nonnegative_least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|A x - counts|``; A counts a combination's lengths.

    Accelerated projected gradient; a row of ``combos`` is a sparse column of A, and bin 0 takes
    the missing thirds.
    """
    size = len(counts)

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, i], x, size) for i in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos].sum(1)

    target = counts.astype(np.float64)
    target[0] = 0
    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A, for the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * top))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


class Pool:
    """Items by length, as runs ``[length of the item, first rank, count, start of the rest]``."""

    def __init__(self, counts: np.ndarray):
        self.runs: list[list[list[int]]] = [[[n, 0, int(c), 0]] if n and c else [] for n, c in enumerate(counts)]
        self.left = np.array([0, *map(int, counts[1:])], np.int64)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """``n`` items of a length as runs."""
        out = []
        self.left[length] -= n
        while n:
            run = self.runs[length][-1]
            part = min(n, run[2])
            out.append((run[0], run[1], part, run[3]))
            run[1] += part
            run[2] -= part
            n -= part
            if not run[2]:
                self.runs[length].pop()
        return out

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs[length].append(list(run))
        self.left[length] += run[2]


def plan_windows(counts: np.ndarray, window: int) -> np.ndarray:
    """Where each part of each item goes.

    ``counts[n]`` items have ``n < window`` tokens.  A row ``(n, rank, count, start, length, sequence,
    offset)`` sends the tokens from ``start`` of the items ``rank, rank + 1, ...`` of length n to
    successive sequences.  First the rounded repeats of full combinations, then windows filled
    greedily with the longest item that fits, the last one cut where none fits.  All windows but
    one are full.
    """
    pool, rows, sequence = Pool(counts), [], 0

    def place(runs: list[tuple[int, int, int, int]], length: int, offset: int, at: int) -> None:
        for n, rank, count, start in runs:
            rows.append((n, rank, count, start, length, at, offset))
            at += count

    combos = shallow_combinations(np.flatnonzero(pool.left), window)
    if len(combos):
        solved = np.rint(nonnegative_least_squares(combos, pool.left)).astype(np.int64)
        for i in np.argsort(-solved, kind="stable"):
            if not solved[i]:
                break
            lengths, uses = np.unique(combos[i][combos[i] > 0], return_counts=True)
            n = int(min(solved[i], (pool.left[lengths] // uses).min()))
            if n:
                offset = 0
                for length in combos[i][combos[i] > 0].tolist():
                    place(pool.take(length, n), length, offset, sequence)
                    offset += length
                sequence += n
    while pool.left.any():
        room, slots, free = window, [], pool.left.copy()
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(room // length, int(free[length]))
            slots += [length] * n
            free[length] -= n
            room -= n * length
        longer = np.flatnonzero(free)
        cut = int(longer[0]) if room and len(longer) else 0
        used = np.bincount(slots + ([cut] if cut else []), minlength=len(free))
        wanted = used > 0
        n = int((pool.left[wanted] // used[wanted]).min())
        offset = 0
        for length in slots:
            place(pool.take(length, n), length, offset, sequence)
            offset += length
        if cut:
            runs = pool.take(cut, n)
            place(runs, room, offset, sequence)
            for origin, rank, count, start in runs:
                pool.put(cut - room, (origin, rank, count, start + room))
        sequence += n
    return np.array(rows, np.int64).reshape(-1, 7)


class Plan:
    """Finds the parts of an item by its length and rank."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        self.by_length = {}
        for n in np.unique(rows[:, 0]).tolist():
            own = self.rows[self.rows[:, 0] == n]
            edges = np.unique(np.concatenate([own[:, 1], own[:, 1] + own[:, 2]]))
            parts: list[list[tuple]] = [[] for _ in edges]
            for _, rank, count, start, length, sequence, offset in own.tolist():
                for i in range(np.searchsorted(edges, rank), np.searchsorted(edges, rank + count)):
                    parts[i].append((start, length, sequence - rank, offset))
            self.by_length[n] = edges, parts

    def parts(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of each part of the item."""
        edges, parts = self.by_length[length]
        found = parts[int(np.searchsorted(edges, rank, "right")) - 1]
        return [(start, n, base + rank, offset) for start, n, base, offset in found]


# ------------------------------------------------------------------ the corpus


def tokenize(path: str, end_id: int, slice_bytes: int = 1 << 23):
    """Rows (id, text) to numbered rows with ids as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1, slice_bytes):
                width = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
                ids = [np.append(x, end_id) for x in encoder(path).encode(some.column(1))]
                rows = np.arange(row, row + len(some))
                row += len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), part)), pa.array(rows), some.column(0),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(width).tobytes() for x in ids])],
                    names=["part", "row", "doc_id", "n", "ids"],
                )

    return run


def cutter(plan: Plan, window: int, first: int, item_schema: pa.Schema):
    """Rows (doc_id, n, full, rank, ids) to pieces; ``first`` sequences hold whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, flats, held = [], [], 0
            for doc, n, full, rank, raw in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                whole, rest = divmod(n, window)
                parts = [(k * window, window, full + k, 0) for k in range(whole)]
                if rest:
                    parts += [(whole * window + s, m, first + q, o) for s, m, q, o in plan.parts(rest, rank)]
                for start, length, sequence, offset in parts:
                    out.append((doc, start, length, n, sequence, offset))
                    flats.append(ids[start : start + length].astype(np.int32))
                held += n
                if held > 1 << 20:
                    yield pieces(out, flats, item_schema)
                    out, flats, held = [], [], 0
            if out:
                yield pieces(out, flats, item_schema)

    return run


def pieces(rows: list[tuple], flats: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flats])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flats)))
    return pa.RecordBatch.from_arrays([*columns, ids], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    then=None,
    schema: str = PIECES,
    slice_bytes: int = 1 << 23,
) -> DataFrame:
    """Pack the ids of all documents, each ended by ``end_id``, into sequences of ``window`` ids.

    A document fills whole windows first.  What is left of each document is one item; the items
    meet the driver only as a histogram of ``window`` bins, on which the plan is made.  Items of a
    length are numbered by sums over parts of the table (windows inside a part, one row a part and
    length across parts), and the number finds the item's places in the plan.  Returns a row a
    piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; all sequences but the
    last are full.  ``then`` maps these batches further inside the same task; ``schema`` is that of
    its result.  A task encodes about ``slice_bytes`` of text at a time.

    Defined cases: NULL text is empty and still gives its end id; rows without id and rows that
    repeat an id are packed like others; an empty table gives no piece.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = "part long, row long, doc_id long, n long, ids binary"
    path = shared_path(spark, "ids")
    rows.mapInArrow(tokenize(tokenizer, end_id, slice_bytes), stored).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(stored).parquet(path)
    sizes = tokens.select(
        "part", "row", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("whole")
    )
    counts = np.zeros(window, np.int64)
    for rest, n in sizes.groupBy("rest").count().collect():  # at most one row a length
        counts[rest] = n
    whole = sizes.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    plan = Plan(plan_windows(counts, window))

    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranks = sizes.groupBy("part", "rest").agg(F.count("*").alias("n"))
    ranks = ranks.select("part", "rest", total("n", before("rest").orderBy("part")).alias("rank_base"))
    wholes = sizes.groupBy("part").agg(F.sum("whole").alias("n"))
    wholes = wholes.select("part", total("n", before().orderBy("part")).alias("full_base"))
    numbered = (
        sizes.withColumn("local_full", total("whole", before("part").orderBy("row")))
        .withColumn("local_rank", F.row_number().over(Window.partitionBy("part", "rest").orderBy("row")) - 1)
        .join(ranks, ["part", "rest"])
        .join(wholes, "part")
        .select(
            "part", "row",
            (F.col("local_full") + F.col("full_base")).alias("full"),
            (F.col("local_rank") + F.col("rank_base")).alias("rank"),
        )
    )
    item_schema = pa.schema([
        *[(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")],
        ("ids", pa.list_(pa.int32())),
    ])
    cut = cutter(plan, window, whole, item_schema)
    return (
        tokens.join(numbered, ["part", "row"])
        .select("doc_id", "n", "full", "rank", "ids")
        .mapInArrow((lambda batches: then(cut(batches))) if then else cut, schema)
    )


def crc_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column("ids")]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = [pa.array(crcs, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


DIGESTS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, path, window=1024, end_id=0, then=crc_pieces, schema=DIGESTS)
