"""Shared pieces of the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def tidy_types(df: DataFrame, digits: int = 9) -> DataFrame:
    """Whole numbers as BIGINT, measures as rounded DOUBLE: the types both sides share."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(build, sql: str | None = None, digits: int = 9) -> Query:
    return Query(lambda spark, folder: tidy_types(build(spark, folder), digits), sql)


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- relations in SQL

PEOPLE = """people AS (
  SELECT c_custkey AS subject, r_name AS site, CAST(c_nationkey AS BIGINT) AS age,
         c_mktsegment AS sex, c_custkey % 2 AS wearer
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

OBS_ORDERS = PEOPLE + """,
obs AS (
  SELECT site, subject, age, l_orderkey AS frame, p_name AS item,
         split_part(p_name, ' ', 1) AS category, o_orderdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN people ON o_custkey = subject)"""


def events_sql(unit: str) -> str:
    return f"""raw_events AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, date_trunc('{unit}', ts) AS fts
  FROM events),
fact AS (
  SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, user_id AS subject,
         user_id % 49 AS age, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS wearer,
         CAST(fts AS TIMESTAMP) AS frame,
         CASE WHEN k % 20 = 0 THEN 'Exclude' WHEN k % 20 = 1 THEN 'None' END AS reason,
         CASE WHEN k % 20 > 1 THEN event_type END AS category,
         CASE WHEN k % 20 > 1 THEN event_type || '-' || CAST(k // 25 AS VARCHAR) END AS item,
         CAST(fts AS TIMESTAMP) AS ts
  FROM raw_events),
obs AS (
  SELECT *, CAST(hour(ts) AS BIGINT) AS hour FROM fact
  WHERE reason IS NULL AND category IS NOT NULL)"""


EV_HOUR = events_sql("hour")
EV_DAY = events_sql("day")
