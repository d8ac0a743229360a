"""Language identification by piece probabilities, summed over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import fresh, held_out, release, shared_path, table
from framewise.llm.tokens import encoder, slices
from framewise.sources.files import remove

UNDETERMINED = "und"
START = "▁"
LONG = 32  # longer words are scored one by one with logarithms, as their probabilities underflow
UNKNOWN = 1e-8  # of one character outside the vocabulary
SHARE = 0.01  # of all pieces' probability, spread evenly
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces, lower-cased, found by a rolling hash of their code points."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        texts = sorted({model.id_to_piece(i).lower() for i in ids})
        self.longest = max(map(len, texts))
        hashes = np.array([self.hash_of(t) for t in texts], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.size = hashes[self.order], len(texts)
        self.marked = np.zeros(1 << 20, bool)
        self.marked[self.mark_of(hashes)] = True

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def mark_of(hashes: np.ndarray) -> np.ndarray:
        """20 bits that depend on all bits of a hash."""
        return (hashes * BASE) >> np.uint64(44)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none; few but pieces are marked, and only those are looked for."""
        out = np.full(len(hashes), -1, self.order.dtype)
        some = np.flatnonzero(self.marked[self.mark_of(hashes)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), self.size - 1)
        out[some] = np.where(self.hashes[at] == hashes[some], self.order[at], -1)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Group:
    """Words of one length and where pieces occur: ``(start, end, words, piece)`` each."""

    rows: np.ndarray
    length: int
    spans: list[tuple[int, int, np.ndarray, np.ndarray]]


def occurrences(words: list[str], vocab: Pieces) -> list[Group]:
    """All pieces in all words (each with the start sign in front), by word length.

    A character that is no piece counts as the piece ``vocab.size``.
    """
    marked = [START + w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    out = []
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        codes = np.array([marked[r] for r in rows], f"<U{length}").view(np.uint32).reshape(len(rows), length)
        codes = codes.astype(np.uint64).T + np.uint64(1)
        spans = []
        for start in range(length):
            h = np.zeros(len(rows), np.uint64)
            for end in range(start + 1, min(length, start + vocab.longest) + 1):
                h = h * BASE + codes[end - 1]
                found = vocab.find(h)
                if end == start + 1:
                    found[found < 0] = vocab.size
                here = np.flatnonzero(found >= 0)
                if len(here):
                    spans.append((start, end, here, found[here]))
        out.append(Group(rows, length, spans))
    return out


def forward(group: Group, probs: np.ndarray) -> np.ndarray:
    """``alpha[i]``: probability of the first i characters over all segmentations; words by languages."""
    alpha = np.zeros((group.length + 1, len(group.rows), probs.shape[1]))
    alpha[0] = 1
    for start, end, words, piece in sorted(group.spans, key=lambda s: s[0]):
        alpha[end, words] += alpha[start, words] * probs[piece]
    return alpha


def piece_table(word: str, vocab: Pieces) -> np.ndarray:
    """The piece at each start and length of a long word (with the start sign in front), -1 for none."""
    codes = np.frombuffer((START + word).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    size = len(codes)
    h, table_ = np.zeros(size, np.uint64), np.full((size, min(vocab.longest, size)), -1, np.int32)
    for k in range(table_.shape[1]):
        h = h[: size - k] * BASE + codes[k:]
        table_[: size - k, k] = vocab.find(h)
    table_[table_[:, 0] < 0, 0] = vocab.size
    return table_


def forward_log(table_: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """``forward`` of one long word, as logarithms: positions by languages."""
    alpha = np.full((len(table_) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for start, row in enumerate(table_):
        k = np.flatnonzero(row >= 0)
        alpha[start + 1 + k] = np.logaddexp(alpha[start + 1 + k], alpha[start] + logs[row[k]])
    return alpha


def backward_log(table_: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of the rest of one long word from each position on."""
    beta = np.zeros((len(table_) + 1, logs.shape[1]))
    for start in range(len(table_) - 1, -1, -1):
        k = np.flatnonzero(table_[start] >= 0)
        beta[start] = np.logaddexp.reduce(beta[start + 1 + k] + logs[table_[start, k]], axis=0)
    return beta


def word_scores(words: list[str], vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, a row a word."""
    out = np.zeros((len(words), probs.shape[1]))
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
    for group in occurrences([words[i] for i in short], vocab):
        out[short[group.rows]] = np.log(forward(group, probs)[group.length])
    logs = np.log(probs)
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = forward_log(piece_table(w, vocab), logs)[-1]
    return out


def arranged(words: list[str], counts: np.ndarray, vocab: Pieces) -> tuple[np.ndarray, list[Group], list]:
    """Short words' counts and groups, and the long words with their counts: what ``expected`` goes over."""
    short = [(w, n) for w, n in zip(words, counts.tolist()) if len(w) <= LONG]
    long = [(w, n) for w, n in zip(words, counts.tolist()) if len(w) > LONG]
    return np.array([n for _, n in short], np.float64), occurrences([w for w, _ in short], vocab), long


def expected(weights: np.ndarray, groups: list[Group], long: list, vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all their segmentations."""
    out = np.zeros(vocab.size + 1)
    for group in groups:
        alpha = forward(group, probs[:, None])[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[group.length] = weights[group.rows] / alpha[group.length]
        for start, end, some, piece in sorted(group.spans, key=lambda s: -s[1]):
            passed = beta[end, some] * probs[piece]
            beta[start, some] += passed
            np.add.at(out, piece, alpha[start, some] * passed)
    logs = np.log(probs)[:, None]
    for word, n in long:
        table_ = piece_table(word, vocab)
        alpha, beta = forward_log(table_, logs)[:, 0], backward_log(table_, logs)[:, 0]
        start, k = np.nonzero(table_ >= 0)
        piece = table_[start, k]
        np.add.at(out, piece, n * np.exp(alpha[start] + logs[piece, 0] + beta[start + 1 + k] - alpha[-1]))
    return out


def first_probs(vocab: Pieces) -> np.ndarray:
    """Equal probabilities to begin with."""
    probs = np.full(vocab.size + 1, 1 / vocab.size)
    probs[-1] = UNKNOWN
    return probs


def renewed(counts: np.ndarray, vocab: Pieces) -> np.ndarray:
    """Piece probabilities from expected counts; those of unknown characters do not count."""
    counts = counts[:-1]
    return np.append((1 - SHARE) * counts / max(counts.sum(), 1e-9) + SHARE / vocab.size, UNKNOWN)


def train(words: list[str], counts: np.ndarray, vocab: Pieces, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations."""
    found, probs = arranged(words, counts, vocab), first_probs(vocab)
    for _ in range(rounds):
        probs = renewed(expected(*found, vocab, probs), vocab)
    return probs


@dataclass(frozen=True)
class Model:
    """Languages and their piece probabilities; size: languages times vocabulary."""

    path: str
    langs: list[str]
    probs: np.ndarray


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case runs of letters of all texts, and which text each is of."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, r"[^\p{L}]+", " "))
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    return flat.filter(keep).dictionary_encode(), owner[keep.to_numpy(zero_copy_only=False)]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to one row a slice of a batch and language with its words and their counts."""
    release(encoder)
    for batch in (x for batch in batches for x in slices(batch, 1, 1 << 22)):
        langs, out = batch.column(0), []
        for lang in pc.unique(langs).to_pylist():
            words, _ = split_words(batch.column(1).filter(pc.equal(langs, lang)))
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            out.append((lang, words.dictionary.to_pylist(), counts.tolist()))
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts"])
    release()


def trainer(path: str, rounds: int):
    def run(rows: pa.Table) -> pa.Table:
        flat = pa.table({"word": pc.list_flatten(rows["words"]), "n": pc.list_flatten(rows["counts"])})
        total = flat.group_by("word").aggregate([("n", "sum")]).sort_by("word")
        probs = train(total["word"].to_pylist(), total["n_sum"].to_numpy(), pieces(path), rounds)
        return pa.table({"lang": rows["lang"][:1].cast(pa.string()), "probs": pa.array([probs], pa.list_(pa.float64()))})

    return run


def labelled_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, text`` of all labelled documents, an id or not; rows without text or language are left out."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def labelled_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1000
) -> DataFrame:
    """``lang, text`` of about ``sample`` labelled documents a language, whatever the corpus.

    Of a language's documents, those stay whose id's hash falls below ``sample`` in their number.
    Rows without id, text or language are left out.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row a language
    if not sizes:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(0)
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    return rows.where(place <= share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def learn_languages(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = 1000, rounds: int = 5,
) -> Model:
    """Fit piece probabilities per language on a bounded sample of labelled documents."""
    return fit_languages(labelled_sample(docs, id_col, text_col, lang_col, sample), path, rounds)


def fit_languages(chosen: DataFrame, path: str, rounds: int = 5) -> Model:
    """Fit piece probabilities on ``lang, text``: words are counted in Spark, a task fits a language."""
    counts = chosen.mapInArrow(count_words, "lang string, words array<string>, counts array<long>")
    fitted = counts.groupBy("lang").applyInArrow(trainer(path, rounds), "lang string, probs array<double>").collect()
    fitted = sorted((r.lang, r.probs) for r in fitted)
    if not fitted:
        return Model(path, [], np.zeros((0, 0)))
    return Model(path, [k for k, _ in fitted], np.array([p for _, p in fitted]).T.copy())


def joined(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, but for the last: many short words are gone over faster at once."""
    kept, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            kept.append(batch)
            size += len(batch)
        if size >= rows or batch is None:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches() if size else []
            kept, size = [], 0


def expecter(path: str, probs: dict[str, np.ndarray]):
    """Rows (lang, word, n) to one row a language and piece with how often the task's words expect it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(encoder)
        vocab, sums = pieces(path), {}
        for batch in joined(batches):
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                some = batch.filter(pc.equal(langs, lang))
                found = arranged(some.column(1).to_pylist(), some.column(2).to_numpy(), vocab)
                sums[lang] = sums.get(lang, 0) + expected(*found, vocab, probs[lang])
        for lang, counts in sums.items():
            piece = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(piece), pa.string()), pa.array(piece, pa.int64()), pa.array(counts[piece])], names=["lang", "piece", "n"]
            )
        release()

    return run


def fit_all(labelled: DataFrame, path: str, rounds: int = 5) -> Model:
    """``fit_languages`` on any number of documents: words are dealt over tasks in the rounds, too.

    Words are counted over all tasks and kept in a shared folder meanwhile.  In each round tasks add up how often
    their words expect each piece, and the driver gets one number a language and piece.
    """
    spark = labelled.sparkSession
    folder, vocab = shared_path(spark, "words"), pieces(path)
    counted = labelled.select("lang", "text").mapInArrow(count_words, "lang string, words array<string>, counts array<long>")
    one = counted.select("lang", F.explode_outer(F.arrays_zip("words", "counts")).alias("one"))
    try:
        one.groupBy("lang", F.col("one.words").alias("word")).agg(F.sum("one.counts").alias("n")).write.parquet(folder)
        words = spark.read.schema("lang string, word string, n long").parquet(folder)
        langs = sorted(r.lang for r in words.select("lang").distinct().collect())
        probs = dict.fromkeys(langs, first_probs(vocab))
        for _ in range(rounds if langs else 0):
            found = words.where("word is not null").mapInArrow(expecter(path, probs), "lang string, piece long, n double")
            sums = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
            for lang in langs:
                counts, some = np.zeros(vocab.size + 1), sums.filter(pc.equal(sums["lang"], lang))
                counts[some["piece"].to_numpy()] = some["n"].to_numpy()
                probs[lang] = renewed(counts, vocab)
    finally:
        remove(spark, folder)
    return Model(path, langs, np.array([probs[k] for k in langs]).T.copy() if langs else np.zeros((0, 0)))


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its share of the probability of all languages."""
    return likelihoods(texts, model)[:2]


def likelihoods(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``predict``, and the text's log-probability a letter in its language (NaN without letters)."""
    n, langs = len(texts), len(model.langs)
    if not langs:
        return [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan)
    words, owner = split_words(texts)
    scores = word_scores(words.dictionary.to_pylist(), pieces(model.path), model.probs)
    index = words.indices.to_numpy()
    logs = np.stack([np.bincount(owner, scores[index, k], n) for k in range(langs)], 1)
    shares = np.exp(logs - logs.max(1, keepdims=True))
    shares /= shares.sum(1, keepdims=True)
    best, some = shares.argmax(1), np.bincount(owner, minlength=n) > 0
    letters = np.bincount(owner, pc.utf8_length(words.dictionary).to_numpy()[index], n)
    fit = np.divide(logs.max(1), letters, out=np.full(n, np.nan), where=letters > 0)
    return [model.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, shares.max(1), 0.0), fit


def predictor(model: Model, text: int, carried: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for batch in batches for x in slices(batch, text, 1 << 22)):
            langs, scores = predict(some.column(text), model)
            columns = [some.column(i) for i in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], names=names)

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score`` (under other names if taken) to the columns ``carry``.

    A word's probability in a language sums over all its segmentations into vocabulary pieces
    (forward algorithm); a text's is the product over its words, and the score is the share of the
    best language, all being equally likely beforehand.  Equal scores go to the first language by
    name.  Only the text is read.

    Defined cases: a text that is NULL, empty or has no letter, and every text under a model
    without languages, is ``und`` with score 0.
    """
    carry = docs.columns if carry is None else carry
    names = [*carry, *fresh(docs.select(carry), "lang_pred", "score")]
    schema = T.StructType([
        *docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields,
        T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.DoubleType()),
    ])
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])])
    at = source.columns.index
    return source.mapInArrow(predictor(model, at(text_col), [at(c) for c in carry], names), schema)


def judge(model: Model):
    """A column function: text to ``lang``, ``score`` and ``fit`` (log-probability a letter in ``lang``).

    Only the text goes to Python and only these three values come back.
    """

    @F.arrow_udf("struct<lang:string,score:double,fit:double>")
    def run(texts: pa.Array) -> pa.Array:
        release(encoder)
        found = [likelihoods(some.column(0), model) for some in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0, 1 << 20)]
        langs, scores, fits = (list(chain.from_iterable(x)) for x in zip(*found)) if found else ([], [], [])
        release()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], ["lang", "score", "fit"]
        )

    return run


def usual_fit(labelled: DataFrame, model: Model, at: float = 0.01) -> dict[str, float]:
    """Of each language, the log-probability a letter that all but ``at`` of its documents reach.

    ``labelled`` has ``lang, text`` of labelled documents, each judged once; the result has a row a language.
    The rank is exact to one in 100,000 documents.
    """
    rows = labelled.select(F.col("lang").alias("label"), judge(model)(F.col("text")).alias("j"))
    own = F.when((F.col("label") == F.col("j.lang")) & ~F.isnan("j.fit"), F.col("j.fit"))
    found = rows.groupBy("label").agg(F.percentile_approx(own, at, 100_000)).collect()
    return {r[0]: r[1] for r in found if r[1] is not None}


def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = learn_languages(docs.where(~out), public_tokenizers.path("piece_bpe_32k.model"))
    found = identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
