"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import BLANKS, ascii_lower, fresh, stored, table


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """Drop lines that ``min_docs`` or more documents share, but in the smallest id holding them.

    A line's key is the line without outer blanks, A to Z lower-cased; shorter keys never count.
    Returns the rows of ``docs`` with the text replaced and ``n_lines`` (before dropping) and
    ``n_dropped`` appended (under another name if ``docs`` has these).

    Lines become rows of hashes only: distinct documents are counted per 128-bit hash, the kept
    hashes go to a stored table, and a join (which Spark splits where a line is hot) names the
    positions to drop.  The text itself is shuffled once, as an array of lines to which the
    positions are applied.

    Defined cases: NULL or empty text is one empty line; NULL text becomes the empty text.  Rows
    without id neither count nor lose lines.  Rows that repeat an id are one document.  An empty
    table gives an empty table.
    """
    key, total, dropped = fresh(docs, "row_key", "n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("row"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).where(F.col("doc").isNotNull())
    line = F.btrim(ascii_lower(F.col("line")), F.lit(BLANKS))
    lines = (
        rows.withColumn("line", line)
        .where(F.char_length("line") >= min_chars)
        .select("doc", "row", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    )
    shared = stored(
        lines.groupBy("a", "b")
        .agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("a", "b", "first"),
        "lines",
    )
    drop = (
        lines.join(shared, ["a", "b"])
        .where(F.col("doc") > F.col("first"))
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("drop"))
    )
    left = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        F.xxhash64(text).alias(key),
        F.split(text, "\n").alias(text_col),
    )
    joined = left.join(drop, (left[id_col] == drop["doc"]) & (left[key] == drop["row"]), "left")
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size(text_col) - 1), gone)
    kept = F.array_join(F.transform(places, lambda p: F.get(F.col(text_col), p)), "\n")
    return joined.select(
        *[kept.alias(c) if c == text_col else left[c] for c in docs.columns],
        F.size(text_col).cast("long").alias(total),
        F.size(gone).cast("long").alias(dropped),
    )


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         trim(translate(t.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM documents, LATERAL (
    SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) t),
shared AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, coalesce(l.doc_id > s.first, false) AS gone FROM lines l LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
