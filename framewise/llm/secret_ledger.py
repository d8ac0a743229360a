"""Secret scans that read each distinct text once per rule version."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import fresh, shared_path, stored, table

LEDGER = "blob string, rule string, version int, spans array<struct<start:long,stop:long>>"

# Below so many unseen texts (a 64-character address each) their addresses are broadcast.
BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has at least ``least`` characters.

    A pattern must not match the empty text.  A changed pattern needs a new ``version``.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values of the contract; a run of 16 or more is a run whose length is tested.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
# Further credentials with a form of their own.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", 1, r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)


def content_address(text: Column) -> Column:
    """SHA-256 of a text; NULL is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches that count, in code points, end exclusive.

    The pieces between matches and the matches themselves are read in step, so offsets are sums of
    their lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start:long,stop:long>>")

    def step(state: Column, piece: Column) -> Column:
        start = (state["at"] + F.char_length(piece["gap"])).cast("long")
        stop = (start + F.char_length(piece["match"])).cast("long")
        part = piece["match"] if rule.group == 0 else F.regexp_extract(piece["match"], rule.pattern, rule.group)
        counts = F.char_length(part) >= rule.least
        span = F.struct(start.alias("start"), stop.alias("stop"))
        found = F.when(counts, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    found = F.aggregate(pieces, begin, step, lambda state: state["found"])
    return F.when(F.size(matches) == 0, none).otherwise(found)


def scan_unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: str, text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger's rows for ``rules``.

    The ledger is a Parquet folder in a shared store with a row per content address, rule and rule
    version, findings or not.  Every text of ``versions`` (any number of paths and revisions) is
    addressed; addresses that some rule version has not seen are kept in a stored table, and only
    their texts are matched, once each and only by those rules.

    Copies of a text are combined inside tasks before it is shuffled.  When few texts are unseen
    their addresses are broadcast (at most ``BROADCAST_BLOBS``), so that known texts are not
    shuffled at all.  A run that is lost before its rows are committed leaves the ledger as it was.
    Two runs at the same time may append a pair twice with equal rows, which reading tolerates.

    Defined cases: NULL text is the empty text.  Empty input appends nothing.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(ledger)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = versions.select(content_address(F.col(f"`{text_col}`")).alias("blob"), text.alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    wanted = reduce(lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules])
    known = spark.read.schema(LEDGER).parquet(ledger).where(wanted)
    done = known.groupBy("blob").agg(F.collect_set("rule").alias("done"))
    unseen = stored(
        texts.select("blob").distinct().join(done, "blob", "left")
        .select("blob", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        .where(F.size("todo") > 0),
        "unseen",
    )
    if unseen.count() <= BROADCAST_BLOBS:
        texts = texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
    single = texts.groupBy("blob").agg(F.any_value("text").alias("text")).join(unseen, "blob")
    rows = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", r.name), spans_of(F.col("text"), r)).alias("spans"),
        )
        for r in rules
    ])
    scanned = single.select("blob", F.inline(rows)).where(F.col("spans").isNotNull())
    scanned.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).where(wanted)


def findings_by_path(versions: DataFrame, found: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """``versions`` with an array ``findings`` of ``start, kind, stop, rule`` in place of the text.

    ``kind`` is the rule's place in ``rules``; the array is in order of start and place.  Findings
    are gathered to one row a text before they meet its paths, and the join moves addresses only.
    Each row of ``versions`` comes out once, with an empty array where nothing was found.
    """
    blob, address, spans_col, out = fresh(versions, "blob", "address", "spans", "findings")
    place = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
    spans = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), place.alias("kind"), s["stop"].alias("stop"), F.col("rule").alias("rule"))
    )
    by_blob = (
        found.where(F.size("spans") > 0).select("blob", spans.alias("spans"))
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias(spans_col))
    )
    by_blob = stored(by_blob.withColumnRenamed("blob", address), "findings")
    keep = [F.col(f"`{c}`") for c in versions.columns if c != text_col]
    paths = versions.select(*keep, content_address(F.col(f"`{text_col}`")).alias(blob))
    joined = paths.join(by_blob, F.col(blob) == F.col(address), "left")
    nothing = F.array().cast(by_blob.schema[spans_col].dataType)
    return joined.select(*keep, F.coalesce(spans_col, nothing).alias(out))


def op12_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = (*BASE_RULES, *MORE_RULES)
    found = scan_unseen(docs, rules, shared_path(spark, "ledger"))
    by_path = findings_by_path(docs, found, rules)

    def joined(findings: Column) -> Column:
        return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")

    findings = F.col("findings")
    kinds = F.transform(findings, lambda s: s["rule"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.name))).cast("long").alias(f"n_{r.name}") for r in BASE_RULES]
    base = F.filter(findings, lambda s: s["kind"] <= len(BASE_RULES))
    return by_path.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(findings).alias("spans"))


def _sql() -> str:
    """Offsets from the lengths of the pieces between matches, one rule at a time."""
    parts = []
    for place, r in enumerate((*BASE_RULES, *MORE_RULES)):
        pattern = r.pattern.replace("'", "''")
        group = f"regexp_extract(m[i], '{pattern}', {r.group})"
        parts.append(f"""
  SELECT doc_id, '{r.name}' AS kind, {place} AS place, m[i] AS match, length({group}) AS chars, {r.least} AS least,
         list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM texts))""")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
found AS (
  SELECT doc_id, kind, place, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(match) AS BIGINT) AS span
  FROM matches WHERE chars >= least)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id GROUP BY t.doc_id
"""


OP12_SQL = _sql()
