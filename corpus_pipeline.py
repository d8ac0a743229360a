"""Corpus preparation: language, repeated lines, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import fresh, held_out, release, stored, table
from framewise.llm.jaccard import jaccard_groups
from framewise.llm.langid import fit_all, judge, labelled_texts, usual_fit
from framewise.llm.line_dedup import dedup_lines
from framewise.llm.packing import DIGESTS, crc_pieces, pack
from framewise.llm.tokens import encoder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5, below: float = 1.0) -> DataFrame:
    """Documents in a learned language.

    The best language must have ``least`` of the probability, and a letter of the text must be no
    less likely in it, by ``below`` on the logarithmic scale, than in all but one in a hundred of
    that language's labelled documents; so text in no learned language goes too.  All labelled documents
    of two thirds of the ids, and those without id, are learned from (``fit_all``), and all of the other
    third are measured on; a language without a measured document has no such bound.

    Text that is NULL, empty or without a letter goes, as does everything if no document is
    labelled.  Repeated rows stay as often as they come; an empty table stays empty.
    """
    apart = held_out(F.col("doc_id"), 3, 1)
    model = fit_all(labelled_texts(docs.where(~apart)), public_tokenizers.path("piece_bpe_32k.model"))
    (mark,) = fresh(docs, "judged")
    lang, score, fit = (F.col(f"{mark}.{c}") for c in ("lang", "score", "fit"))
    usual = F.lit(True)
    for name, value in usual_fit(labelled_texts(docs.where(apart)), model).items():
        usual = usual & ((lang != name) | (fit >= value - below))
    return docs.withColumn(mark, judge(model)(F.col("text"))).where((score >= least) & usual).select(docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; ``n_chars`` follows the text.

    NULL text becomes the empty text.  Rows without id neither count nor lose lines; rows that
    repeat an id are one document.  A document may end empty and stays.
    """
    out = dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by SimHash and by Jaccard similarity.

    Linked are documents whose SimHash fingerprints over five words differ in three bits or fewer, and
    those of a Jaccard similarity of 0.8 or more, of which the fingerprints miss some.
    Texts without words are alike, so one of them stays.  Of rows that repeat an id one stays; a row
    without id comes after all others of its group.
    """
    groups = jaccard_groups(docs, shingle=5, num=4, den=5, radius=3)
    return groups.where(F.col(groups.columns[-1])).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row a piece with its place and checksum.

    NULL text is the empty text, whose only id is the end.  An empty table gives no pieces.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, path, window=1024, end_id=0, then=digests, schema=DIGESTS, slice_bytes=1 << 20)


def digests(batches):
    """Checksums of the pieces, in workers that no longer need the encoder of the stage's first step."""
    release(encoder)
    yield from crc_pieces(batches)
    release()


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("packing", packed),
]

# Fingerprints, trained probabilities and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
