"""Near-duplicates by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import fresh, release, stored
from framewise.llm.components import components
from framewise.llm.langid import pieces
from framewise.llm.simhash import LOWERED, majority, near_links
from framewise.llm.tokens import encoder

COARSE, BUCKETS, WIDE = 16, 128, 2048  # numbers of buckets of a sketch
SMALL = 32  # cells of more members give links in two rounds
STEP = 1 << 14  # pairs compared at a time
SLICE = 512  # texts or cells handled at a time


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; a shorter text is one shingle, no word gives none."""
    words = text.translate(LOWERED).split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    return np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def prefix_size(n: int, num: int, den: int) -> int:
    """How many first hashes of a set of ``n``, in any order, hold one of any set at ``num / den`` or above."""
    return n - -(-num * n // den) + 1 if n else 0


def sketch(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Hashes a bucket, up to 255: the Manhattan distance is at most the number of differing hashes."""
    return np.minimum(np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def prefix_of(hashes: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first hashes of a sorted set when those of the sorted array ``common`` come last."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: prefix_size(len(hashes), num, den)]


def common_hashes(texts: DataFrame, shingle: int, sample: int = 16_000, least: int = 4, most: int = 1 << 16) -> np.ndarray:
    """Sorted hashes that at least ``least`` of about ``sample`` different sets have, ``most`` at most.

    ``texts`` has ``id, text``.  They only order the hashes of sets: with common ones last, fewer sets
    that are not alike share one of their first hashes.  Links do not depend on them.
    """
    n = texts.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = texts.where(share < min(1.0, sample / max(n, 1))).select(printer(shingle, 7, 10)("text").alias("p"))
    sets = drawn.select("p.print", "p.prefix").dropDuplicates(["print"])
    counts = sets.select(F.explode("prefix").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "h").limit(most).collect()
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


def printer(shingle: int, num: int, den: int, common: np.ndarray = np.empty(0, np.uint64)):
    """A column function: text to a digest of its set, the set's size, prefix, sketch and SimHash fingerprint.

    Only the text goes to Python, and a few hundred bytes of each come back.
    """

    @F.arrow_udf("struct<print:binary,size:int,prefix:array<bigint>,sketch:binary,finger:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        release(encoder, pieces)
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64())
        parts = []
        for at in range(0, len(texts), SLICE):
            sets, fingers = [], []
            for x in texts.slice(at, SLICE).cast(pa.binary()):
                hashes = shingle_hashes(x.as_py() or b"", shingle)
                sets.append(np.unique(hashes))
                fingers.append(majority(hashes))
            parts.append([
                [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                [len(s) for s in sets],
                [prefix_of(s, common, num, den).view(np.int64) for s in sets],
                [sketch(s).tobytes() for s in sets],
                np.array(fingers, np.uint64).view(np.int64),
            ])
        columns = [pa.concat_arrays([pa.array(p[i], k) for p in parts]) if parts else pa.array([], k) for i, k in enumerate(kinds)]
        release()
        return pa.StructArray.from_arrays(columns, ["print", "size", "prefix", "sketch", "finger"])

    return run


def candidates(num: int, den: int, cross: bool):
    """Rows (members, n, i, j) of cells to pairs that the sketches leave.

    A cell of up to ``SMALL`` members gives all of them.  Of a larger cell each member gives the
    nearest one before it, or with ``cross`` all of another label.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists, n = batch.column(0), batch.column(1).to_numpy()
            across = batch.column(2).to_numpy() != batch.column(3).to_numpy()
            flat = lists.flatten()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            node, size, block, label = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("node", "size", "block", "label" if cross else "node"))
            fine = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            coarse = fine.reshape(len(fine), COARSE, -1).sum(2, dtype=np.int32)
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                """Whether the least number of differing hashes allows the similarity."""
                most = (size[p] + size[q]) * (den - num) // (den + num)
                ok = np.flatnonzero(np.abs(size[p] - size[q]) <= most)
                for s in (coarse, fine):
                    parts = np.array_split(ok, len(ok) // STEP + 1)
                    ok = np.concatenate([x[np.abs(s[p[x]] - s[q[x]]).sum(1, dtype=np.int64) <= most[x]] for x in parts])
                return ok

            def keep(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                ok = near(p, q)
                found.append((node[p[ok]], node[q[ok]]))
                return ok

            sizes = np.diff(offsets)
            little = n <= SMALL
            for m in np.unique(sizes[little]).tolist() if not cross else []:
                first, second = np.triu_indices(m, 1)
                rows = np.flatnonzero(little & (sizes == m))
                for some in np.array_split(rows, len(rows) * len(first) // STEP + 1):
                    at = offsets[some][:, None]
                    keep((at + first).ravel(), (at + second).ravel())
            for r in np.flatnonzero(~little).tolist():
                part = offsets[r] + np.argsort(node[offsets[r] : offsets[r + 1]], kind="stable")
                left = part
                for k in range(1, len(part)):
                    at = np.arange(k, len(part)) if cross else left[left >= k] if k > 1 else np.arange(1, len(part))
                    p, q = part[at], part[at - k]
                    fits = np.ones(len(at), bool)
                    if across[r]:
                        fits &= block[p] != block[q]
                    if cross:
                        fits &= label[p] != label[q]
                    fit = np.flatnonzero(fits)
                    ok = keep(p[fit], q[fit])
                    if not cross:
                        linked = np.zeros(len(at), bool)
                        linked[fit[ok]] = True
                        left = at[~linked]
                        if not len(left):
                            break
            us, vs = zip(*found) if found else ((), ())
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def wide_filter(num: int, den: int):
    """Rows (u, v, size and wide sketch of u, of v) to the pairs that the wide sketches leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDE).astype(np.int16) for i in (3, 5))
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            mask = pa.array(np.abs(a - b).sum(1, dtype=np.int64) <= both * (den - num) // (den + num))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["u", "v"])

    return run


def verifier(num: int, den: int):
    """Rows (u, v, set of u, set of v) to the pairs whose similarity is ``num / den`` or above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both * den >= num * (len(a) + len(b) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["u", "v"])

    return run


def set_reader(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s, WIDE).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "size", "wide", "set"],
            )

    return run


def near_set_links(classes: DataFrame, texts: DataFrame, shingle: int, num: int, den: int, block_rows: int = 1024) -> DataFrame:
    """Links ``u, v`` that connect all pairs of sets ``node, size, prefix, sketch`` at ``num / den`` or above.

    Two such sets share one of the first hashes that ``prefix`` holds, so only members of a
    prefix hash's cell are compared, by sketch, and the pairs it leaves by a wider sketch and then
    their whole sets, read from ``texts`` (``node, text``).  Large cells first link each member to the nearest one before
    it; then all their pairs across the components found are compared too.
    """
    prefixes = classes.select("node", F.explode("prefix").alias("h"))
    counts = stored(prefixes.groupBy("h").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "cells")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    shared = stored(prefixes.join(counts, "h").select(
        "h", "node", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")
    ), "shared")

    def pairs(rows: DataFrame, members: DataFrame, cross: bool) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = rows.join(members, "node").select("*", other)
        member = F.struct("node", "size", "sketch", "block", *["label"] * cross)
        tasks = dealt.groupBy("h", "n", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        tasks = tasks.agg(F.collect_list(member).alias("m")).where(F.size("m") > 1).select("m", "n", "i", "j")
        found = tasks.mapInArrow(candidates(num, den, cross), "u long, v long")
        return stored(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")

    def verified(found: DataFrame) -> DataFrame:
        nodes = found.select(F.col("u").alias("node")).union(found.select("v")).distinct()
        sets = stored(texts.join(nodes, "node").select("node", "text").mapInArrow(set_reader(shingle), "node long, size int, wide binary, set binary"), "sets")
        wide = sets.select("node", "size", "wide")
        joined = found.join(wide.toDF("u", "n", "a"), "u").join(wide.toDF("v", "m", "b"), "v").select("u", "v", "n", "a", "m", "b")
        found = stored(joined.mapInArrow(wide_filter(num, den), "u long, v long"), "candidates")
        whole = sets.select("node", "set")
        joined = found.join(whole.toDF("u", "a"), "u").join(whole.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return stored(joined.mapInArrow(verifier(num, den), "u long, v long"), "links")

    members = classes.select("node", "size", "sketch")
    links = verified(pairs(shared, members, False))
    large = shared.where(F.col("n") > SMALL)
    if large.isEmpty():
        return links
    labels = components(links)
    labelled = members.join(labels, "node", "left").select("node", "size", "sketch", F.coalesce("label", "node").alias("label"))
    return links.union(verified(pairs(large, labelled, True)))


def finger_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links ``u, v`` that connect all nodes whose fingerprints ``finger`` differ in ``radius`` bits or fewer."""
    firsts = stored(classes.groupBy("finger").agg(F.min("node").alias("first")), "fingers")
    same = classes.join(firsts, "finger").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = near_links(firsts.select(F.col("finger").alias("print")), radius)
    near = near.join(firsts.toDF("u", "a"), "u").join(firsts.toDF("v", "b"), "v")
    return same.union(near.select(F.greatest("a", "b"), F.least("a", "b")))


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5,
    carry: list[str] | None = None, block_rows: int = 1024, radius: int | None = None,
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``num / den`` or more of word shingles.

    Returns the columns ``carry`` (default: all of ``docs``) with ``component_id`` (the smallest id
    reachable over links) and ``is_first`` (one row a component, the smallest id's first) appended,
    under other names if taken.  No pair at the similarity is missed, none below it is linked.
    Words and rows without words or id are those of ``simhash_groups``; texts without words are
    alike.  Equal sets are one point, so copies cost nothing further.  With ``radius`` texts are linked
    too whose SimHash fingerprints, of the same shingles, differ in so many bits or fewer.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*[F.col(f"`{c}`") for c in carry])
    out_id, out_first = fresh(kept, "component_id", "is_first")
    name, text, mark, row, size, prefix, drawn, finger = fresh(
        kept, "id", "words", "print", "row", "size", "prefix", "sketch", "finger"
    )
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(id_col).alias(name))
    if text_col in carry:
        text = text_col  # not stored twice
    else:
        source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(id_col).alias(name), F.col(text_col).alias(text))
    common = common_hashes(source.select(F.col(name).alias("id"), F.col(text).alias("text")), shingle)
    made = source.select("*", F.monotonically_increasing_id().alias(row), printer(shingle, num, den, common)(F.col(text)).alias(mark))
    prints = stored(made.select(
        *[F.col(f"`{c}`") for c in [*source.columns, row]], F.col(f"{mark}.print").alias(mark), F.col(f"{mark}.size").alias(size),
        F.col(f"{mark}.prefix").alias(prefix), F.col(f"{mark}.sketch").alias(drawn),
        F.col(f"{mark}.finger").alias(finger),
    ), "prints", "zstd")
    own = F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("id"), F.col(row).alias("row"))
    classes = stored(
        prints.groupBy(F.col(mark).alias("print")).agg(
            F.min(own).alias("first"), F.first(size).alias("size"), F.first(prefix).alias("prefix"), F.first(drawn).alias("sketch"),
            F.first(finger).alias("finger"),
        ).withColumn("node", F.col("first.row")),
        "classes",
    )
    texts = prints.select(F.col(row).alias("node"), F.col(text).alias("text"))
    links = near_set_links(classes.drop("finger"), texts, shingle, num, den, block_rows)
    if radius is not None:
        links = links.union(finger_links(classes.select("node", "finger"), radius))
    labels = components(links)
    labelled = classes.select("print", "first", "node").join(labels, "node", "left").select(
        "print", "first", F.coalesce("label", "node").alias("label")
    )
    tops = labelled.groupBy("label").agg(F.min("first").alias("top"))
    named = stored(labelled.join(tops, "label").select("print", "top"), "named")
    return prints.join(named, prints[mark] == named["print"]).select(
        *[prints[c] for c in carry],
        F.col("top.id").alias(out_id),
        (prints[row] == F.col("top.row")).alias(out_first),
    )
