"""Hierarchical Pitman-Yor language model, trained and applied by blocks of pairs of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import dealt, held_out, partitions, shared_path, stored, table
from framewise.llm.tokens import slices

END = "\n"  # no word holds it
EXACT = 64  # customers up to which tables are drawn from their exact law
CHUNKS = (
    "kind int, chunk long, bucket int, lo long, words binary, word binary, context binary, count binary, "
    "doc_ids array<long>, sizes array<long>, body binary"
)
STATE = (
    "bucket int, words binary, word binary, context binary, count binary, tables binary, root_tables binary, "
    "tables_sum binary, roots array<binary>, context_tables array<long>, context_count array<long>, "
    "totals array<long>"
)
TOTALS = ("root_count", "root_tables", "tokens", "vocabulary", "ones", "twos", "root_ones", "root_twos")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed bytes; ``kind`` is a dtype, or ``steps`` for ascending numbers."""
    if kind == "steps":
        values, kind = np.diff(values, prepend=0), "<i4"
    return zstandard.compress(np.ascontiguousarray(values, kind).tobytes(), 3)


def unpack(value: pa.Scalar | bytes, kind: str) -> np.ndarray:
    body = zstandard.decompress(value.as_py() if isinstance(value, pa.Scalar) else value)
    return np.cumsum(np.frombuffer(body, "<i4")) if kind == "steps" else np.frombuffer(body, kind)


def pack_words(words: list[str]) -> bytes:
    """Words joined by blanks, which no word holds."""
    return zstandard.compress(" ".join(words).encode(), 3)


def unpack_words(value: pa.Scalar) -> pa.Array:
    text = zstandard.decompress(value.as_py()).decode()
    return pa.array(text.split(" ") if text else [], pa.string())


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
        "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def batch_of(rows: list[dict], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


# ------------------------------------------------------------------ texts to counts


def tokenize(some: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts, the end last; the texts' tokens as their numbers; tokens a text."""
    texts = pc.fill_null(some.column(2).cast(pa.large_string()), "")
    low = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))  # the kernel wants no slice
    lists = pc.ascii_split_whitespace(low)
    flat = lists.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(lists.offsets.to_numpy()))[keep]
    del texts, low, lists
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    del flat, keep
    words = [*coded.dictionary.to_pylist(), END]
    sizes = np.bincount(owner, minlength=len(some)) + 1
    token = np.full(int(sizes.sum()), len(words) - 1, np.int32)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = coded.indices.to_numpy()
    return words, token, sizes


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def chunker(contexts: int, buckets: int, chunk_bytes: int):
    """Rows (doc_id, learns, text) to the chunk table.

    A chunk is a bounded slice of documents.  Its distinct (word, context) pairs are numbered by
    the word's bucket and become a row a bucket (kind 0); its texts become one row of pair numbers
    (kind 1).  The context of a token is a hash class of the word before it, 0 at the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for some in slices(batch, 2, chunk_bytes):
                chunk += 1
                words, token, sizes = tokenize(some)
                hashes = word_hashes(words)
                stops = np.cumsum(sizes) - 1
                classes = 1 + (hashes % np.uint64(contexts - 1)).astype(np.int32)
                context = np.zeros(len(token), np.int32)
                context[1:] = classes[token[:-1]]
                context[stops - sizes + 1] = 0
                # words by bucket, pairs by word
                bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                pair = place[token] * contexts + context
                del token, context
                pairs, index = np.unique(pair, return_inverse=True)
                del pair
                index = index.astype(np.int32)
                learns = np.repeat(some.column(1).to_numpy(zero_copy_only=False), sizes)
                count = np.bincount(index[learns], minlength=len(pairs)).astype(np.int64)
                pair_word, pair_context = pairs // contexts, pairs % contexts
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(words)]):
                    lo, hi = np.searchsorted(pair_word, [a, b]).tolist()
                    rows.append({
                        "kind": 0, "chunk": chunk, "bucket": int(bucket[order[a]]), "lo": lo,
                        "words": pack_words([words[i] for i in order[a:b]]),
                        "word": pack(pair_word[lo:hi] - a, "steps"),
                        "context": pack(pair_context[lo:hi], "<u2"),
                        "count": pack(count[lo:hi], "<i8"),
                    })
                rows.append({
                    "kind": 1, "chunk": chunk, "doc_ids": some.column(0).to_pylist(), "sizes": sizes.tolist(),
                    "body": pack(index, "<i4"),
                })
                out = batch_of(rows, CHUNKS)
                del rows, words, index, pairs, learns
                pa.default_memory_pool().release_unused()
                yield out

    return run


def merge_counts(rows: pa.Table, contexts: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words with training tokens, and keys and counts of their pairs, of one bucket."""
    parts = [r for b in rows.to_batches() for r in rows_of(b)]
    named = [unpack_words(r["words"]) for r in parts]
    every = pc.unique(pa.concat_arrays(named))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, words in zip(parts, named):
        at = pc.index_in(words, value_set=every).to_numpy()
        count = unpack(r["count"], "<i8")
        some = count > 0
        keys.append(at[unpack(r["word"], "steps")[some]].astype(np.int64) * contexts + unpack(r["context"], "<u2")[some])
        counts.append(count[some])
    keys, index = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(index, np.concatenate(counts), len(keys)).astype(np.int64)
    seen, word = np.unique(keys // contexts, return_inverse=True)
    return every.take(pa.array(seen)), word * contexts + keys % contexts, counts


# ------------------------------------------------------------------ seating


@dataclass
class Numbers:
    """What all restaurants share: a fixed number of values, however large the corpus."""

    discount: float
    root_discount: float
    strength: float
    unknown_share: float
    vocabulary: int
    tokens: int
    context_count: np.ndarray
    context_tables: np.ndarray
    root_count: int
    root_tables: int
    samples: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def base(self, known: bool = True) -> float:
        """Base probability of a known word, or of the unknown word."""
        if not self.vocabulary:
            return 0.0 if known else 1.0
        return (1 - self.unknown_share) / self.vocabulary if known else self.unknown_share

    def root(self, customers: np.ndarray, tables: np.ndarray, base: float, count: int, total: int) -> np.ndarray:
        own = customers - self.root_discount * tables
        return (own + (self.strength + self.root_discount * total) * base) / (self.strength + count)


def log_stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, n + 1)
    for c in range(1, n):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - discount * t, 0)) + out[c, 1:]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def draw_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float,
                log_counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish in its restaurant, given its customers and all other tables there.

    A Gibbs step reseats all customers of a dish, the other dishes' tables being fixed.  Up to
    ``EXACT`` customers the number of tables is drawn from its exact conditional.  Beyond, it is
    drawn from the saddle point of the same law: with ``a`` the weight of a new table, the tables
    are a Poisson number of ``a / d`` groups of Sibuya size, tilted so that the expected customers
    are those seated; the number then has the tilted mean, one more, and its conditional variance.
    """
    tables = np.ones(len(customers), np.int64)
    log_base = np.log(base)
    for size in np.unique(customers[(customers > 1) & (customers <= EXACT)]).tolist():
        t = np.arange(1, size + 1)
        rows = np.flatnonzero(customers == size)
        for some in np.array_split(rows, -(-len(rows) * size // (1 << 20))):
            open_up = log_base[some, None] + np.log(strength + discount * (others[some, None] + t - 1))
            weight = log_counts[size, 1 : size + 1] + np.cumsum(open_up, 1)
            tables[some] = 1 + (weight + rng.gumbel(size=weight.shape)).argmax(1)
    big = np.flatnonzero(customers > EXACT)
    if len(big):
        n, d = customers[big].astype(np.float64), discount
        weight = base[big] * (strength + d * others[big])
        low, high = np.full(len(big), -600.0), np.full(len(big), 0.0)  # log of 1 - tilt
        for _ in range(60):
            y = (low + high) / 2
            over = np.log(weight) + np.log1p(-np.exp(np.minimum(y, -1e-15))) + (d - 1) * y > np.log(n)
            low, high = np.where(over, y, low), np.where(over, high, y)
        y = np.exp(high)
        mean = weight / d * (1 - y**d)
        variance = mean - n / (1 + (1 - d) * (1 - y) / y)
        share = np.clip(1 - variance / mean, 1e-6, 1 - 1e-6)
        trials = np.maximum(1, np.rint(mean / share)).astype(np.int64)
        tables[big] = np.clip(1 + rng.binomial(trials, np.minimum(1, mean / trials)), 1, customers[big])
    return tables


def summary(word: np.ndarray, context: np.ndarray, count: np.ndarray, tables: np.ndarray, root_tables: np.ndarray, contexts: int) -> dict:
    root = np.bincount(word, tables, len(root_tables)).astype(np.int64)
    totals = [root.sum(), root_tables.sum(), count.sum(), len(root), (count == 1).sum(), (count == 2).sum(), (root == 1).sum(), (root == 2).sum()]
    return {
        "context_tables": np.bincount(context, tables, contexts).astype(np.int64).tolist(),
        "context_count": np.bincount(context, count, contexts).astype(np.int64).tolist(),
        "totals": [int(x) for x in totals],
    }


def first_state(contexts: int):
    """All chunk rows of a bucket to its state: every dish at one table."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words, keys, count = merge_counts(rows, contexts)
        word, context = keys // contexts, keys % contexts
        tables, root_tables = np.ones(len(keys), np.int64), np.ones(len(words), np.int64)
        state = {
            "bucket": key[0].as_py(), "words": pack_words(words.to_pylist()), "word": pack(word, "steps"),
            "context": pack(context, "<u2"), "count": pack(count, "<i8"), "tables": pack(tables, "<i4"),
            "root_tables": pack(root_tables, "<i4"), "tables_sum": pack(np.zeros(len(keys)), "<i4"), "roots": [],
        }
        return pa.Table.from_batches([batch_of([state | summary(word, context, count, tables, root_tables, contexts)], STATE)])

    return run


def sweep(numbers: Numbers, contexts: int, seed: int, round_: int, keep: bool):
    """One Gibbs sweep over the buckets; totals of other buckets are those of the last sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_counts, root_counts = log_stirling(numbers.discount), log_stirling(numbers.root_discount)
        for batch in batches:
            for r in rows_of(batch):
                rng = np.random.default_rng([seed, round_, r["bucket"].as_py()])
                word, context, count = unpack(r["word"], "steps"), unpack(r["context"], "<u2"), unpack(r["count"], "<i8")
                tables, root_tables = unpack(r["tables"], "<i4"), unpack(r["root_tables"], "<i4")
                customers = np.bincount(word, tables, len(root_tables))
                root = numbers.root(customers, root_tables, numbers.base(), numbers.root_count, numbers.root_tables)
                others = np.maximum(numbers.context_tables[context] - tables, 0)
                tables = draw_tables(count, root[word], others, numbers.discount, numbers.strength, log_counts, rng)
                customers = np.bincount(word, tables, len(root_tables)).astype(np.int64)
                others = np.maximum(numbers.root_tables - root_tables, 0)
                base = np.full(len(root_tables), numbers.base())
                root_tables = draw_tables(customers, base, others, numbers.root_discount, numbers.strength, root_counts, rng)
                roots = r["roots"].as_py()
                if keep:
                    roots = [*roots, pack(np.concatenate([customers, root_tables]), "<i8")]
                # the words stay in the first state
                state = {n: r[n].as_py() for n in ("bucket", "word", "context", "count")} | {
                    "tables": pack(tables, "<i4"), "root_tables": pack(root_tables, "<i4"), "roots": roots,
                    "tables_sum": pack(unpack(r["tables_sum"], "<i4") + (tables if keep else 0), "<i4"),
                }
                yield batch_of([state | summary(word, context, count, tables, root_tables, contexts)], STATE)

    return run


def read_totals(state: DataFrame, contexts: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Sums over all buckets; every task adds its buckets up and sends one row."""
    sizes = {"context_tables": contexts, "context_count": contexts, "totals": len(TOTALS)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(size, np.int64) for n, size in sizes.items()}
        for batch in batches:
            for r in rows_of(batch):
                for n in sums:
                    sums[n] += r[n].values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64())) for v in sums.values()], names=list(sums))

    parts = state.select(*sizes).mapInArrow(add, ", ".join(f"{n} array<long>" for n in sizes)).collect()
    total = [sum((np.array(p[n]) for p in parts), np.zeros(size, np.int64)) for n, size in sizes.items()]
    return total[0], total[1], dict(zip(TOTALS, total[2].tolist()))


# ------------------------------------------------------------------ scores by context classes


def pair_scorer(numbers: Numbers, contexts: int):
    """Chunk rows and the state of a bucket to the pairs' probabilities and the words' counts."""
    ddl = "chunk long, lo long, logs binary, count binary"

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        state = next((r for b in states.to_batches() for r in rows_of(b)), None)
        known = unpack_words(state["words"]) if state else pa.array([], pa.string())
        field = lambda n, kind: unpack(state[n], kind).astype(np.int64) if state else np.zeros(0, np.int64)
        word, context, count = field("word", "steps"), field("context", "<u2"), field("count", "<i8")
        samples = len(numbers.samples)
        mean_tables = field("tables_sum", "<i4") / max(samples, 1)
        roots = [unpack(x, "<i8").reshape(2, -1) for x in state["roots"].as_py()] if state else []
        keys, words = word * contexts + context, np.bincount(word, count, len(known))
        out = []
        for r in (r for b in rows.to_batches() for r in rows_of(b)):
            at = pc.fill_null(pc.index_in(unpack_words(r["words"]), value_set=known), -1).to_numpy().astype(np.int64)
            at = at[unpack(r["word"], "steps")]
            own = unpack(r["context"], "<u2").astype(np.int64)
            key = at * contexts + own
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = (at >= 0) & (keys[place] == key) if len(keys) else np.zeros(len(at), bool)
            direct = np.zeros(len(at))
            direct[hit] = count[place[hit]] - numbers.discount * mean_tables[place[hit]]
            back = np.zeros(len(at))
            for (tables, root_count, root_tables), (customers, open_tables) in zip(numbers.samples, roots or [np.zeros((2, 0), np.int64)] * samples):
                root = np.full(len(at), numbers.root(0, 0, numbers.base(False), root_count, root_tables))
                seen = at >= 0
                root[seen] = numbers.root(customers[at[seen]], open_tables[at[seen]], numbers.base(), root_count, root_tables)
                back += (numbers.strength + numbers.discount * tables[own]) * root / samples
            prob = (direct + back) / (numbers.strength + numbers.context_count[own])
            total = np.where(at >= 0, words[np.maximum(at, 0)] if len(words) else 0, 0)
            out.append({
                "chunk": r["chunk"].as_py(), "lo": r["lo"].as_py(),
                "logs": pack(np.log10(prob), "<f4"), "count": pack(total, "<i8"),
            })
        schema = pa.schema([("chunk", pa.int64()), ("lo", pa.int64()), ("logs", pa.binary()), ("count", pa.binary())])
        return pa.Table.from_pylist(out, schema=schema)

    return run, ddl


def doc_scorer(numbers: Numbers):
    """The texts of a chunk and the scores of its pairs to a row a document."""
    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([(n, pa.float64() if k == "double" else pa.int64()) for n, k in (f.split() for f in ddl.split(", "))])

    def run(texts: pa.Table, scores: pa.Table) -> pa.Table:
        scores = scores.sort_by("lo")
        logs = np.concatenate([unpack(x, "<f4") for x in scores["logs"].to_pylist()] or [np.zeros(0)]).astype(np.float64)
        count = np.concatenate([unpack(x, "<i8") for x in scores["count"].to_pylist()] or [np.zeros(0, np.int64)])
        base = np.log10((count + 1) / (numbers.tokens + numbers.vocabulary + 1))
        out = []
        for r in (r for b in texts.to_batches() for r in rows_of(b)):
            index = unpack(r["body"], "<i4")
            sizes = np.array(r["sizes"].as_py(), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda x: np.bincount(owner, x[index], len(sizes))
            out.append(pa.table([
                pa.array(r["doc_ids"].as_py(), pa.int64()), pa.array(sizes), pa.array(total(count > 0).astype(np.int64)),
                pa.array(np.full(len(sizes), numbers.tokens, np.int64)), pa.array(total(base)), pa.array(total(logs)),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run, ddl


# ------------------------------------------------------------------ words as contexts
#
# Known words have ids, the frequent ones small ids; 0 is any unknown word, 1 the start of a text.
# An id belongs to the group of its remainder by ``groups``, where its place is the quotient.  The
# pairs (word, context) of a group of words and a group of contexts are a block, so neither a
# frequent word nor a frequent context is one task.  A node is a group of words (its number) or of
# contexts (its number and ``groups`` more).

START, FIRST = 1, 2
SLICES = "kind int, chunk long, bucket int, words binary, count binary, doc_ids array<long>, sizes array<long>, learns binary, body binary"
IDS = "chunk long, part int, ids binary, count binary, logs binary, tokens long, vocabulary long"
PAIRS = "block int, chunk long, word binary, context binary, count binary"
BLOCKS = "kind int, block int, node int, ids binary, word binary, context binary, count binary, ones long, twos long"
SEATS = (
    "kind int, round int, block int, node int, tables binary, root_tables binary, customers binary, "
    "root_count long, root_total long, root_ones long, root_twos long"
)
PARTIAL, OWN = 0, 1  # kinds of seats: sums that go between a block and a node, what either keeps


def pack_numbers(values: np.ndarray, steps: bool = False) -> bytes:
    """Numbers from zero, or the steps of ascending ones, byte by byte: all lowest bytes, then the next."""
    values = np.ascontiguousarray(np.diff(values, prepend=0) if steps else values, "<i8")
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.compress(bytes([width]) + planes.tobytes(), 3)


def unpack_numbers(value: pa.Scalar, steps: bool = False) -> np.ndarray:
    body = np.frombuffer(zstandard.decompress(value.as_py()), np.uint8)
    planes = body[1:].reshape(int(body[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    out = out.reshape(-1).view("<i8")
    return np.cumsum(out) if steps else out


def table_rows(rows: pa.Table) -> list[dict]:
    return [r for b in rows.to_batches() for r in rows_of(b)]


def word_chunker(buckets: int, chunk_bytes: int):
    """Rows (doc_id, learns, text) to chunks: the words of every bucket (kind 0) and the texts (kind 1).

    The word of rank r in bucket b of a chunk has the number r * buckets + b there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for some in slices(batch, 2, chunk_bytes):
                chunk += 1
                words, token, sizes = tokenize(some)
                bucket = ((word_hashes(words) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                learns = some.column(1).to_numpy(zero_copy_only=False).astype(bool)
                count = np.bincount(token[np.repeat(learns, sizes)], minlength=len(words))
                order = np.lexsort((-np.bincount(token, minlength=len(words)), bucket))
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ends = np.append(edges[1:], len(words))
                number = np.empty(len(words), np.int64)
                number[order] = (np.arange(len(words)) - np.repeat(edges, ends - edges)) * buckets + bucket[order]
                rows = [{
                    "kind": 0, "chunk": chunk, "bucket": int(bucket[order[a]]),
                    "words": pack_words([words[i] for i in order[a:b]]), "count": pack_numbers(count[order[a:b]]),
                } for a, b in zip(edges.tolist(), ends.tolist())]
                rows.append({
                    "kind": 1, "chunk": chunk, "doc_ids": some.column(0).to_pylist(), "sizes": sizes.tolist(),
                    "learns": pack(learns, "u1"), "body": pack_numbers(number[token]),
                })
                out = batch_of(rows, SLICES)
                del rows, words, token, order, number
                pa.default_memory_pool().release_unused()
                yield out

    return run


def word_ids(buckets: int):
    """The chunks' words of a bucket to their ids and counts of training tokens; both are 0 if unknown."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts, bucket = table_rows(rows), key[0].as_py()
        named = [unpack_words(r["words"]) for r in parts]
        every = pc.unique(pa.concat_arrays(named))
        places = [pc.index_in(w, value_set=every).to_numpy() for w in named]
        total = np.zeros(len(every), np.int64)
        for r, at in zip(parts, places):
            total[at] += unpack_numbers(r["count"])
        order = pc.sort_indices(
            pa.table({"count": total, "word": every}), sort_keys=[("count", "descending"), ("word", "ascending")]
        ).to_numpy()
        known = int((total > 0).sum())
        ids = np.zeros(len(every), np.int64)
        ids[order[:known]] = FIRST + np.arange(known) * buckets + bucket
        out = [{
            "chunk": r["chunk"].as_py(), "part": bucket, "ids": pack_numbers(ids[at]), "count": pack_numbers(total[at]),
            "tokens": 0, "vocabulary": 0,
        } for r, at in zip(parts, places)]
        out[0] |= {"tokens": int(total.sum()), "vocabulary": known}
        return pa.Table.from_batches([batch_of(out, IDS)])

    return run


@dataclass
class Grid:
    """How ids fall into groups; a group's places are below ``span``."""

    buckets: int
    groups: int
    span: int

    def keys(self, text: dict, ids: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Every token's pair as a number, blocks in order, and its word's count."""
        number = unpack_numbers(text["body"])
        word, count = np.zeros((2, int(number.max(initial=0)) + 1), np.int64)
        for r in ids:
            own = slice(r["part"].as_py(), None, self.buckets)
            some = unpack_numbers(r["ids"])
            word[own][: len(some)] = some
            count[own][: len(some)] = unpack_numbers(r["count"])
        word, count = word[number], count[number]
        context = np.empty(len(word), np.int64)
        context[1:] = word[:-1]
        sizes = text["sizes"].values.to_numpy()
        context[np.cumsum(sizes) - sizes] = START
        block = word % self.groups * self.groups + context % self.groups
        return (block * self.span + word // self.groups) * self.span + context // self.groups, count

    def merge(self, rows: list[dict]) -> tuple[np.ndarray, ...]:
        """Distinct pairs of a block's rows and their counts, and the place of each row's pairs among them."""
        parts = [unpack_numbers(r["word"], True) * self.span + unpack_numbers(r["context"]) for r in rows]
        keys, index = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(index, np.concatenate([unpack_numbers(r["count"]) for r in rows]), len(keys)).astype(np.int64)
        return keys, count, np.split(index, np.cumsum([len(x) for x in parts])[:-1])


def chunk_pairs(grid: Grid):
    """The texts of a chunk and its words' ids to its distinct pairs, a row a block."""

    def run(texts: pa.Table, ids: pa.Table) -> pa.Table:
        out = []
        for text in table_rows(texts):
            keys, _ = grid.keys(text, table_rows(ids))
            keys, index = np.unique(keys, return_inverse=True)
            learns = np.repeat(unpack(text["learns"], "u1").astype(bool), text["sizes"].values.to_numpy())
            count = np.bincount(index[learns], minlength=len(keys))
            block, inside = np.divmod(keys, grid.span**2)
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
                out.append({
                    "block": int(block[a]), "chunk": text["chunk"].as_py(), "word": pack_numbers(inside[a:b] // grid.span, True),
                    "context": pack_numbers(inside[a:b] % grid.span), "count": pack_numbers(count[a:b]),
                })
        return pa.Table.from_batches([batch_of(out, PAIRS)])

    return run


def first_blocks(grid: Grid):
    """A block's pairs, merged (kind 0), and the places it shares with its two nodes (kind 1)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys, count, _ = grid.merge(table_rows(rows))
        words, word = np.unique(keys // grid.span, return_inverse=True)
        contexts, context = np.unique(keys % grid.span, return_inverse=True)
        own = {"kind": 0, "block": block, "word": pack_numbers(word, True), "context": pack_numbers(context), "count": pack_numbers(count)}
        own |= {"ones": int((count == 1).sum()), "twos": int((count == 2).sum())}
        group, other = divmod(block, grid.groups)
        shared = [(group, words, word), (grid.groups + other, contexts, context)]
        links = [{
            "kind": 1, "block": block, "node": node, "ids": pack_numbers(ids, True),
            "word": pack_numbers(np.bincount(at, count > 0)), "count": pack_numbers(np.bincount(at, count)),
        } for node, ids, at in shared]
        return pa.Table.from_batches([batch_of([own, *links], BLOCKS)])

    return run


def node_seats(numbers: Numbers, groups: int, seed: int, round_: int):
    """Partial sums of the blocks to those of a node; words are seated anew in the root.

    ``tables`` of words are their customers in the root.  In round 0 each word has one table there.
    """

    def run(key: tuple, links: pa.Table, rows: pa.Table) -> pa.Table:
        node = key[0].as_py()
        places = {r["block"].as_py(): unpack_numbers(r["ids"], True) for r in table_rows(links)}
        size = 1 + max(int(x[-1]) for x in places.values())
        sums, customers, root = np.zeros(size, np.int64), np.zeros(size, np.int64), None
        for r in table_rows(rows):
            if r["kind"].as_py() == OWN:
                root = unpack_numbers(r["root_tables"])
                continue
            at = places[r["block"].as_py()]
            sums[at] += unpack_numbers(r["tables"])
            if r["customers"].is_valid:
                customers[at] += unpack_numbers(r["customers"])
        out = []
        if node < groups:
            seen = sums > 0
            if root is None:
                root = seen.astype(np.int64)
            else:
                base, others = np.full(int(seen.sum()), numbers.base()), np.maximum(numbers.root_tables - root[seen], 0)
                rng = np.random.default_rng([seed, round_, 1, node])
                root[seen] = draw_tables(
                    sums[seen], base, others, numbers.root_discount, numbers.strength, log_stirling(numbers.root_discount), rng
                )
            totals = {"root_count": sums, "root_total": root, "root_ones": sums == 1, "root_twos": sums == 2}
            out.append({"kind": OWN, "round": round_, "node": node, "root_tables": pack_numbers(root)})
            out[0] |= {n: int(x.sum()) for n, x in totals.items()}
        for block, at in places.items():
            mine = {"root_tables": pack_numbers(root[at])} if node < groups else {} if round_ else {"customers": pack_numbers(customers[at])}
            out.append({"kind": PARTIAL, "round": round_, "block": block, "node": node, "tables": pack_numbers(sums[at])} | mine)
        return pa.Table.from_batches([batch_of(out, SEATS)])

    return run


def block_seats(numbers: Numbers, groups: int, seed: int, round_: int, keep: bool):
    """One Gibbs sweep over a block; its own row holds its tables and, as customers, their sum over kept sweeps."""

    def run(key: tuple, blocks: pa.Table, rows: pa.Table) -> pa.Table:
        block, pairs = key[0].as_py(), table_rows(blocks)[0]
        word, context, count = unpack_numbers(pairs["word"], True), unpack_numbers(pairs["context"]), unpack_numbers(pairs["count"])
        seen = count > 0
        tables, kept = seen.astype(np.int64), np.zeros(len(count), np.int64)
        for r in table_rows(rows):
            if r["kind"].as_py() == OWN:
                tables, kept = unpack_numbers(r["tables"]), unpack_numbers(r["customers"])
            elif r["node"].as_py() < groups:
                customers, root_tables = unpack_numbers(r["tables"]), unpack_numbers(r["root_tables"])
            else:
                open_tables = unpack_numbers(r["tables"])
        root = numbers.root(customers, root_tables, numbers.base(), numbers.root_count, numbers.root_tables)
        others = np.maximum(open_tables[context] - tables, 0)
        rng = np.random.default_rng([seed, round_, 0, block])
        tables = np.zeros(len(count), np.int64)
        tables[seen] = draw_tables(
            count[seen], root[word[seen]], others[seen], numbers.discount, numbers.strength, log_stirling(numbers.discount), rng
        )
        out = [{"kind": OWN, "block": block, "tables": pack_numbers(tables), "customers": pack_numbers(kept + tables if keep else kept)}]
        group, other = divmod(block, groups)
        for node, at, size in ((group, word, len(customers)), (groups + other, context, len(open_tables))):
            out.append({"kind": PARTIAL, "block": block, "node": node, "tables": pack_numbers(np.bincount(at, tables, size))})
        return pa.Table.from_batches([batch_of([r | {"round": round_} for r in out], SEATS)])

    return run


def block_scorer(numbers: Numbers, grid: Grid, rounds: list[int]):
    """A block's pairs by chunk and its last seats to the logarithms of the pairs' probabilities."""

    def run(key: tuple, pairs: pa.Table, rows: pa.Table) -> pa.Table:
        block, parts = key[0].as_py(), table_rows(pairs)
        keys, count, places = grid.merge(parts)
        words, word = np.unique(keys // grid.span, return_inverse=True)
        context = np.unique(keys % grid.span, return_inverse=True)[1]
        unknown = words * grid.groups + block // grid.groups == 0
        roots, opened = {}, {}
        for r in table_rows(rows):
            round_, at = r["round"].as_py(), r["node"].as_py()
            if r["kind"].as_py() == OWN:
                tables = unpack_numbers(r["customers"]) / len(rounds)
            elif at >= grid.groups:
                opened[round_] = unpack_numbers(r["tables"])
                if r["customers"].is_valid:
                    customers = unpack_numbers(r["customers"])
            elif round_ in rounds:
                roots[round_] = unpack_numbers(r["tables"]), unpack_numbers(r["root_tables"])
        prob = np.where(count > 0, count - numbers.discount * tables, 0)
        for round_, (_, root_count, root_tables) in zip(rounds, numbers.samples):
            root = numbers.root(*roots[round_], numbers.base(), root_count, root_tables)
            root[unknown] = numbers.root(0, 0, numbers.base(False), root_count, root_tables)
            prob += (numbers.strength + numbers.discount * opened[round_][context]) * root[word] / len(rounds)
        logs = np.log10(prob / (numbers.strength + customers[context]))
        out = [{"chunk": r["chunk"].as_py(), "part": block, "logs": pack(logs[at], "<f4")} for r, at in zip(parts, places)]
        return pa.Table.from_batches([batch_of(out, IDS)])

    return run


def text_scorer(numbers: Numbers, grid: Grid):
    """The texts of a chunk, its words' ids and its pairs' scores to a row a document."""
    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([(n, pa.float64() if k == "double" else pa.int64()) for n, k in (f.split() for f in ddl.split(", "))])

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        found, out = table_rows(rows), []
        scores = sorted((r["part"].as_py(), r["logs"]) for r in found if r["logs"].is_valid)
        logs = np.concatenate([unpack(x, "<f4") for _, x in scores]).astype(np.float64)
        for text in table_rows(texts):
            keys, count = grid.keys(text, [r for r in found if r["ids"].is_valid])
            index = np.unique(keys, return_inverse=True)[1]
            sizes = text["sizes"].values.to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((count + 1) / (numbers.tokens + numbers.vocabulary + 1))
            total = lambda x: np.bincount(owner, x, len(sizes))
            out.append(pa.table([
                pa.array(text["doc_ids"].as_py(), pa.int64()), pa.array(sizes), pa.array(total(count > 0).astype(np.int64)),
                pa.array(np.full(len(sizes), numbers.tokens, np.int64)), pa.array(total(base)), pa.array(total(logs[index])),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run, ddl


def score_by_words(
    rows: DataFrame, burn_in: int, samples: int, strength: float, unknown_share: float, seed: int, chunk_bytes: int, block_bytes: int,
) -> DataFrame:
    """``score_texts`` with every word as a context of its own."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(math.sqrt(size / block_bytes)))
    blocks, parts = groups * groups, 1 + size // chunk_bytes
    chunks = dealt(rows.mapInArrow(word_chunker(blocks, chunk_bytes), SLICES), "chunks", "chunk", parts)
    texts = chunks.where("kind = 1").select("chunk", "doc_ids", "sizes", "learns", "body").groupBy("chunk")
    named = chunks.where("kind = 0").select("chunk", "bucket", "words", "count")
    ids = stored(named.groupBy("bucket").applyInArrow(word_ids(blocks), IDS), "ids")
    tokens, vocabulary, most = (x or 0 for x in ids.agg(F.sum("tokens"), F.sum("vocabulary"), F.max("vocabulary")).first())
    grid = Grid(blocks, groups, (FIRST + most * blocks) // groups + 1)
    if blocks * grid.span**2 >= 1 << 63:
        raise ValueError(f"pairs of {vocabulary} words do not fit 64 bits")
    pairs = texts.cogroup(ids.groupBy("chunk")).applyInArrow(chunk_pairs(grid), PAIRS)
    pairs = dealt(pairs.repartition(blocks, "block"), "pairs", "block", blocks)
    first = dealt(pairs.groupBy("block").applyInArrow(first_blocks(grid), BLOCKS), "blocks", "block", blocks)
    static = first.where("kind = 0").select("block", "word", "context", "count").groupBy("block")
    shared = first.where("kind = 1")
    links = dealt(shared.select("node", "block", "ids").repartition(2 * groups, "node"), "links", "node", 2 * groups).groupBy("node")

    def reseat(partial: DataFrame, round_: int) -> DataFrame:
        nodes = stored(links.cogroup(partial.groupBy("node")).applyInArrow(node_seats(numbers, groups, seed, round_), SEATS), "nodes")
        found = nodes.agg(*[F.sum(n) for n in ("root_count", "root_total", "root_ones", "root_twos")]).first()
        numbers.root_count, numbers.root_tables, *ones = (x or 0 for x in found)
        totals.append(ones)
        return nodes

    rate = lambda ones, twos: min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
    ones, twos = (x or 0 for x in first.agg(F.sum("ones"), F.sum("twos")).first())
    none = np.zeros(0, np.int64)
    numbers, totals = Numbers(rate(ones, twos), 0.5, strength, unknown_share, vocabulary, tokens, none, none, 0, 0), []
    begin = shared.select(F.lit(PARTIAL).alias("kind"), "block", "node", F.col("word").alias("tables"), F.col("count").alias("customers"))
    nodes = [reseat(begin, 0)]
    numbers.root_discount = rate(*totals[0])
    own = nodes[0].where(F.lit(False))
    for i in range(1, burn_in + samples + 1):
        answers = nodes[-1].where(f"kind = {PARTIAL}")
        sweep_ = block_seats(numbers, groups, seed, i, i > burn_in)
        swept = stored(static.cogroup(own.union(answers).groupBy("block")).applyInArrow(sweep_, SEATS), "seats")
        own = swept.where(f"kind = {OWN}")
        nodes.append(reseat(swept.where(f"kind = {PARTIAL}").union(nodes[-1].where(f"kind = {OWN}")), i))
        if i > burn_in:
            numbers.samples.append((none, numbers.root_count, numbers.root_tables))
    rounds = list(range(burn_in + 1, burn_in + samples + 1))
    last = own
    for i in (0, *rounds):
        last = last.union(nodes[i].where(f"kind = {PARTIAL}" + ("" if i else f" and node >= {groups}")))
    scores = pairs.groupBy("block").cogroup(last.groupBy("block")).applyInArrow(block_scorer(numbers, grid, rounds), IDS)
    run, ddl = text_scorer(numbers, grid)
    return texts.cogroup(ids.union(scores).groupBy("chunk")).applyInArrow(run, ddl)


def score_texts(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", contexts: int | None = None,
    burn_in: int = 2, samples: int = 3, strength: float = 1.0, unknown_share: float = 0.5, seed: int = 7,
    chunk_bytes: int = 1 << 24, block_bytes: int = 1 << 25,
) -> DataFrame:
    """Train a hierarchical Pitman-Yor model on the rows where ``learns`` holds and score all rows.

    Tokens are words after lower-casing A to Z, then one end.  A token's restaurant is that of the
    word before it, or of the start for the first token; all context restaurants share the root
    restaurant, whose base is even over the known words and gives the unknown word
    ``unknown_share``.  After a word that training never met, the root alone decides.  Discounts
    follow from the counts of once and twice seen pairs.  Seats are resampled in sweeps; a word's
    score averages the predictive probabilities of the last ``samples`` sweeps, and a text's score
    is the log10 of their product.

    Words have numbers, and their pairs lie in a grid of blocks, by the group of the word and that of
    the context, of about ``block_bytes`` of text each.  A sweep draws the tables of every pair
    from the totals of the last sweep; blocks send sums a word and a context to the groups, which
    send back the totals.  The blocks' pairs and the texts stay in buckets, so only sums are shuffled.
    Chunks of the corpus are counted before they are shuffled.  Sweeps are seeded by round and
    block and written to the shared folder, so a lost executor changes nothing, and the chunks
    do not change the result.

    With ``contexts`` a number, words are dealt by hash to so many classes (65,536 at most) that
    stand for them as contexts: a coarser model whose size is bounded.  All contexts of a word then
    lie in the bucket of its hash.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.  Defined cases: NULL
    text is empty, so only its end; without training rows every token is unknown with probability
    one; rows without id, or that repeat one, are rows like others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), learns.alias("learns"), F.col(text_col).alias("text"))
    if contexts is None:
        return score_by_words(rows, burn_in, samples, strength, unknown_share, seed, chunk_bytes, block_bytes)
    if not 1 < contexts <= 1 << 16:
        raise ValueError("contexts is from 2 to 65536")
    buckets = 2 * partitions(spark)
    path = shared_path(spark, "chunks")
    rows.mapInArrow(chunker(contexts, buckets, chunk_bytes), CHUNKS).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    pairs = chunks.where("kind = 0").select("chunk", "bucket", "lo", "words", "word", "context", "count")
    counted = pairs.select("bucket", "words", "word", "context", "count")
    first = state = stored(counted.groupBy("bucket").applyInArrow(first_state(contexts), STATE), "seats")
    tables, count, totals = read_totals(state, contexts)
    rate = lambda ones, twos: min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
    numbers = Numbers(
        rate(totals["ones"], totals["twos"]), rate(totals["root_ones"], totals["root_twos"]), strength, unknown_share,
        totals["vocabulary"], totals["tokens"], count, tables, totals["root_count"], totals["root_tables"],
    )
    for i in range(burn_in + samples):
        keep = i >= burn_in
        state = stored(state.mapInArrow(sweep(numbers, contexts, seed, i, keep), STATE), "seats")
        numbers.context_tables, _, totals = read_totals(state, contexts)
        numbers.root_count, numbers.root_tables = totals["root_count"], totals["root_tables"]
        if keep:
            numbers.samples.append((numbers.context_tables, numbers.root_count, numbers.root_tables))
    run, ddl = pair_scorer(numbers, contexts)
    final = state.select("bucket", "word", "context", "count", "tables_sum", "roots").join(first.select("bucket", "words"), "bucket")
    scored = pairs.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(run, ddl)
    run, ddl = doc_scorer(numbers)
    texts = chunks.where("kind = 1").select("chunk", "doc_ids", "sizes", "body")
    return texts.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(run, ddl)


def op6_hpylm(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    scored = score_texts(table(spark, folder, "documents").select("doc_id", "text"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
