"""The library's relations expressed over a star schema and an event stream.

Orders play the observed frames: the customer is the subject, an order a frame, a part
name an item and its first word the category.  Events play time-stamped frames: one
frame per user and hour or day.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.domain import Domain
from framewise.operators.tasks import dealt, tasks_for

ORDERS_DOMAIN = Domain(
    sites=("ASIA", "EUROPE"),
    categories=("blue", "cold", "hot", "large", "new", "old", "red", "small"),
    labels=("Blue", "Cold", "Hot", "Large", "New", "Old", "Red", "Small"),
    short_labels=("B", "C", "H", "L", "N", "O", "R", "S"),
    excluded_items=("blue ring", "hot rod", "old anvil"),
    strip=("small ", "-M"),
)

EVENTS_DOMAIN = Domain(
    sites=("A", "B"),
    categories=("view", "click", "purchase", "signup", "error"),
    excluded_items=("view-0", "error-3"),
    strip=("-0", "-1"),
)


# Declared columns: reading needs no job that looks into files for a schema.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, "
    "props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "labels": "doc_id LONG, quality INT, toxic INT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Participants: one row per customer."""
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "customer")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("subject"),
            F.col("r_name").alias("site"),
            F.col("c_nationkey").cast("long").alias("age"),
            F.col("c_mktsegment").alias("sex"),
            (F.col("c_custkey") % 2).alias("wearer"),
        )
    )


def line_tasks(spark: SparkSession, folder: str) -> int:
    """Tasks for jobs over the order lines, from the number of lines (Parquet keeps it)."""
    return tasks_for(spark, table(spark, folder, "lineitem").count())


def obs_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis view over order lines.

    The lines move once, by order; the subject's columns come with the orders, of which there are fewer.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    known = orders.join(people(spark, folder), F.col("o_custkey") == F.col("subject"))
    return (
        dealt(named, ["l_orderkey"], line_tasks(spark, folder))
        .join(known, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "site",
            "subject",
            "age",
            F.col("l_orderkey").alias("frame"),
            F.col("p_name").alias("item"),
            F.substring_index("p_name", " ", 1).alias("category"),
            F.col("o_orderdate").alias("ts"),
        )
    )


def events_fact(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    """Clean fact over events; a frame is one user and one hour or day (``unit``).

    Some events stand for excluded records and carry a reason instead of an item.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(F.col("k") % 20 == 0, "Exclude").when(F.col("k") % 20 == 1, "None")
    item = F.concat("event_type", F.lit("-"), F.floor(F.col("k") / 25).cast("string"))
    free = F.col("reason").isNull()
    return (
        table(spark, folder, "events")
        .select("user_id", "event_type", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"), k.alias("k"))
        .withColumn("reason", reason)
        .select(
            F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("site"),
            F.col("user_id").alias("subject"),
            (F.col("user_id") % 49).alias("age"),
            F.when(F.col("user_id") % 3 == 0, 0).otherwise(1).alias("wearer"),
            F.col("ts").alias("frame"),
            "reason",
            F.when(free, F.col("event_type")).alias("category"),
            F.when(free, item).alias("item"),
            "ts",
        )
        .distinct()
    )


def obs_events(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    """Analysis view over events."""
    from framewise.plans.prep import analysis_view

    return analysis_view(events_fact(spark, folder, unit))


def event_people(spark: SparkSession, folder: str) -> DataFrame:
    """Participants of the event stream."""
    user = F.col("user_id")
    return (
        table(spark, folder, "events")
        .select(
            F.when(user % 2 == 0, "A").otherwise("B").alias("site"),
            user.alias("subject"),
            (user % 49).alias("age"),
        )
        .distinct()
    )


def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Codeable hours: every waking hour (6 to 21) of every user seen."""
    hours = F.explode(F.sequence(F.lit(6).cast("long"), F.lit(21).cast("long")))
    users = table(spark, folder, "events").select(F.col("user_id").alias("subject")).distinct()
    return users.select("subject", hours.alias("hour"))


# ---------------------------------------------------------------- hand-coded records


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records: an order with its item list as text and 0/1 flags."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    entry = F.struct("l_linenumber", "p_name")
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    listed = (
        dealt(named, ["l_orderkey"], line_tasks(spark, folder))
        .groupBy("l_orderkey")
        .agg(F.array_join(F.sort_array(F.collect_set(entry)).getField("p_name"), ", ").alias("text"))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")

    def flag(m: int):
        return F.when(key % m == 0, 1).otherwise(0)

    return orders.join(listed, key == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("subject"),
        key.alias("frame"),
        F.when(key % 41 == 0, F.lit("please Exclude"))
        .when(key % 43 == 0, F.lit(None))
        .otherwise(F.col("text"))
        .alias("item"),
        flag(29).alias("none"),
        flag(31).alias("exclude"),
        flag(37).alias("unsure"),
        flag(3).alias("tool_meal"),
        flag(4).alias("tool_work"),
    )


def _orders(spark: SparkSession, folder: str, m: int) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .where(F.col("o_orderkey") % m == 0)
        .withColumns({"subject": F.col("o_custkey"), "frame": F.col("o_orderkey")})
    )


def checked_unsure(spark: SparkSession, folder: str) -> DataFrame:
    """Checked unsure frames: an item and flags."""
    rows = _orders(spark, folder, 74)
    return rows.select(
        "subject",
        "frame",
        F.when(F.col("frame") % 3 != 0, F.col("o_orderpriority")).alias("item"),
        F.when(F.col("frame") % 3 == 0, 1).otherwise(0).alias("exclude"),
        F.when(F.col("frame") % 5 == 0, 1).otherwise(0).alias("none"),
        F.lit(0).alias("unsure"),
    )


def immovable(spark: SparkSession, folder: str) -> DataFrame:
    """Overlay with replacement items, some of them missing, and reasons."""
    rows = _orders(spark, folder, 50)
    return rows.select(
        "subject",
        "frame",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("new_item"),
        F.when(F.col("frame") % 100 == 0, "Exclude").alias("new_reason"),
    )


def no_items(spark: SparkSession, folder: str) -> DataFrame:
    """Checked frames without items; every second one is unknown to the records."""
    rows = _orders(spark, folder, 47)
    return rows.select(
        "subject",
        F.when(F.col("frame") % 2 == 0, -F.col("frame")).otherwise(F.col("frame")).alias("frame"),
        F.when(F.col("frame") % 5 == 0, F.col("o_orderpriority")).alias("item"),
        F.when(F.col("frame") % 3 == 0, 1).when(F.col("frame") % 7 != 0, 0).alias("exclude"),
        F.when(F.col("frame") % 5 != 0, 1).otherwise(0).alias("none"),
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label dictionary: a new name, a list of two, or nothing."""
    noun = F.substring_index("p_name", " ", -1)
    return (
        table(spark, folder, "part")
        .select("p_name")
        .distinct()
        .where(noun != "widget")
        .select(
            F.col("p_name").alias("item"),
            F.when(noun == "bolt", F.concat(F.substring_index("p_name", " ", 1), F.lit(" nut")))
            .when(noun == "gear", F.concat(F.col("p_name"), F.lit(" , cog")))
            .alias("new_item"),
        )
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """Category dictionary over the regularised names; plates have no category."""
    first = F.substring_index("p_name", " ", 1)
    noun = F.substring_index("p_name", " ", -1)
    name = F.when(noun == "bolt", F.concat(first, F.lit(" nut"))).otherwise(F.col("p_name"))
    return (
        table(spark, folder, "part")
        .where(noun != "plate")
        .select(name.alias("item"), first.alias("category"))
        .distinct()
    )


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Authoritative corrections: an item list or a reason."""
    rows = _orders(spark, folder, 53)
    odd = F.col("frame") % 2 == 1
    return rows.select(
        "subject",
        "frame",
        F.when(odd, F.concat(F.lit("hand axe, "), F.col("o_orderstatus"), F.lit(", old anvil, rope"))).alias("new_item"),
        F.when(~odd, "Unsure").alias("new_reason"),
    )


def timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderkey").alias("frame"),
        F.col("o_orderdate").alias("ts"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects recorded twice: customer keys that share all but the last two digits."""
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .where(key % 100 < 2)
        .select(F.floor(key / 100).alias("person"), key.alias("subject"))
    )


def second_coding(spark: SparkSession, folder: str) -> DataFrame:
    """A second coder: some items differ, some events were not seen."""
    k = F.get_json_object("props", "$.k").cast("int")
    other = F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("event_type"))
    return _coding(
        table(spark, folder, "events").where(
            (F.col("event_id") % 17 != 0) & (F.col("user_id") % 3 != 0)
        ),
        k,
        other,
    )


def first_coding(spark: SparkSession, folder: str) -> DataFrame:
    """The main coder, all users."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _coding(table(spark, folder, "events"), k, F.col("event_type"))


def _coding(events: DataFrame, k, category) -> DataFrame:
    reason = F.when(k % 20 == 0, "Exclude").when(k % 20 == 1, "None")
    rows = events.select(
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("site"),
        F.col("user_id").alias("subject"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("frame"),
        reason.alias("reason"),
        category.alias("category"),
        F.concat(category, F.lit("-"), F.floor(k / 50).cast("string")).alias("item"),
    )
    free = F.col("reason").isNull()
    return rows.withColumns(
        {
            "category": F.when(free, F.col("category")),
            "item": F.when(free, F.col("item")),
        }
    ).distinct()
