"""How filters interact: who removes a row, in every order in which they can be applied."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import BLANKS, fresh, stored, table, wide_hash

COUNTS = "kept long, removed long, redundant long, unique_fails long, shapley long"


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Min-plus product of a mask matrix (masks x filters) and positions (filters x orders).

    A filter that a row fails costs nothing and one that it passes costs more than any position,
    so the minimum over filters of cost plus position is the step (from 0) that removes the row,
    or the number of filters if none does.
    """
    never = len(place)
    cost = np.where(fails, 0, never)
    return np.minimum((cost[:, :, None] + place[None]).min(axis=1), never)


def order_places(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of k filters (orders x steps) and the inverse permutations (filters x orders)."""
    orders = np.array(list(permutations(range(k))), dtype=np.int64).reshape(-1, k)
    return orders, np.argsort(orders, axis=1).T


def _tables(fails: np.ndarray, weights: np.ndarray, orders: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per order and step of one part; ``weights`` has rows and the further counts by mask."""
    k, n_orders = place.shape
    step = removal_steps(fails, place)
    at = np.broadcast_to(np.arange(n_orders), step.shape)
    lost = np.zeros((weights.shape[1], n_orders, k + 1), dtype=np.int64)
    for table_, weight in zip(lost, weights.T):
        np.add.at(table_, (at, step), weight[:, None])
    removed = lost[0, :, :k]
    # rows that fail the filter of a step, removed before it
    failing = fails.T.astype(np.int64) * weights[:, 0]
    total = failing.sum(axis=1)
    alone = failing[:, fails.sum(axis=1) == 1].sum(axis=1)
    early = np.stack([((step < place[f]) * failing[f][:, None]).sum(axis=0) for f in range(k)])
    every = np.arange(n_orders)[:, None]
    share = np.array([removed[np.arange(n_orders), place[f]].sum() for f in range(k)])
    assert (early[orders, every] + removed == total[orders]).all()
    return {
        "kept": weights[:, 0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": early[orders, every],
        "unique_fails": alone[orders],
        "shapley": share[orders],
        "lost": lost[1:, :, :k],
    }


def audit_filters(rows: DataFrame, part: str, filters: dict[str, Column], weights: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step, with what that step does.

    ``filters`` maps one-letter names to failure conditions, ``weights`` names further conditions
    whose removed rows are counted.  Returns ``part, filter_order, step`` (from 1), ``kept`` rows
    after the step, ``removed`` here, ``redundant`` (failing this filter but removed earlier),
    ``unique_fails`` (failing this filter alone), ``shapley`` (removed by this filter over all
    orders) and one count of removed rows per weight.

    Rows become counts per part and mask of failed filters, combined inside tasks before they are
    shuffled; a part then has at most two to the number of filters of them.  Removal steps are a
    min-plus product of masks and inverse permutations, and counts are scattered by step.

    Defined cases: an unknown condition counts as passed, an unknown weight as not met.  A part of
    NULL is a part.  An empty table has no parts and gives no rows.  Repeated rows count each.
    """
    names = list(filters)
    extra, k = list(weights), len(names)
    mask = reduce(
        lambda a, b: a + b,
        [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values())],
    )
    met = [F.when(c, 1).otherwise(0).cast("long").alias(f"_w{i}") for i, c in enumerate(weights.values())]
    masks = rows.select(F.col(f"`{part}`").alias("part"), mask.alias("_mask"), *met).groupBy("part", "_mask").agg(
        F.count("*").alias("_n"), *[F.sum(f"_w{i}").alias(f"_w{i}") for i in range(len(weights))]
    )
    cell = F.array(F.col("_mask").cast("long"), "_n", *[f"_w{i}" for i in range(len(weights))])
    parts = masks.groupBy("part").agg(F.collect_list(cell).alias("_cells"))
    orders, place = order_places(k)
    texts = ["".join(names[f] for f in order) for order in orders]

    def tables(batches):
        for batch in batches:
            for name, cells in zip(batch["part"], batch["_cells"]):
                cells = np.array([list(c) for c in cells], dtype=np.int64)
                fails = (cells[:, :1] >> np.arange(k)) & 1 == 1
                found = _tables(fails, cells[:, 1:], orders, place)
                out = {
                    "part": [name] * orders.size,
                    "filter_order": np.repeat(texts, k),
                    "step": np.tile(np.arange(1, k + 1), len(orders)),
                    **{c: found[c].ravel() for c in ("kept", "removed", "redundant", "unique_fails", "shapley")},
                    **{w: lost.ravel() for w, lost in zip(extra, found["lost"])},
                }
                yield pd.DataFrame(out)

    lost = "".join(f", `{w}` long" for w in weights)
    kind = rows.schema[part].dataType.simpleString()
    return parts.mapInPandas(tables, f"part {kind}, filter_order string, step int, {COUNTS}{lost}")


def failing_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with booleans A to E of the filters that a document fails appended.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of the code points in
    A to Z; D: one of ``#$%&*|``; E: the text of a document with a smaller id.  NULL text is the
    empty text; a row without id neither has nor is an earlier copy.  A name that ``docs`` has already
    gets a leading underscore.

    Each text is read once, and only its conditions and a 128-bit hash go to a stored table.  The
    first id of a repeated text comes from a grouped minimum; the join that returns it is split by
    Spark where a text has very many copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    blank = trimmed == ""
    n_words = F.when(blank, 0).otherwise(F.size(words))
    n_distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    kept = [c for c in docs.columns if c != text_col]
    *fails, h1, h2, first, last = fresh(docs, *"ABCDE", "h1", "h2", "first", "last")
    conditions = [
        n_words < 200,
        100 * n_distinct < 50 * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    key = wide_hash(text)
    rows = stored(
        docs.select(
            *[F.col(f"`{c}`") for c in kept],
            *[c.alias(name) for c, name in zip(conditions, fails)],
            key["a"].alias(h1),
            key["b"].alias(h2),
        ),
        "failing",
    )
    copied = stored(
        rows.groupBy(h1, h2).agg(F.min(id_col).alias(first), F.max(id_col).alias(last))
        .where(F.col(first) < F.col(last)).select(h1, h2, first),
        "copies",
    )
    later = F.coalesce(F.col(id_col) > F.col(first), F.lit(False))
    joined = rows.join(copied, [h1, h2], "left")
    return joined.select(*[F.col(f"`{c}`") for c in [*kept, *fails[:4]]], later.alias(fails[4]))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    labels = (
        table(spark, folder, "labels").groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    rows = failing_texts(docs).join(labels, "doc_id", "left")
    audit = audit_filters(
        rows, "part", {f: F.col(f) for f in "ABCDE"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
    )
    return audit.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
gone AS (
  SELECT part, fails, n, good, toxic, filter_order,
         CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))) END AS gone_at
  FROM masks, orders),
audit AS (
  SELECT part, g.filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (WHERE gone_at > step), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE gone_at = step), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE gone_at < step AND contains(fails, f)), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fails = f), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE gone_at = step), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE gone_at = step), 0) AS BIGINT) AS toxic_lost
  FROM gone g JOIN steps s ON g.filter_order = s.filter_order GROUP BY part, g.filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audit
"""
