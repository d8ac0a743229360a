"""Delimited-text and Parquet sources and sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def schema(**fields: str) -> T.StructType:
    """Declared columns as ``name="long" | "int" | "double" | "string"``."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in fields.items()])


# Column layouts of the working files.
PARTICIPANTS = schema(
    subject="long", site="string", age="int", sex="string", n="int", wearer="int"
)
HOURS = schema(subject="long", hour="int")
TIMESTAMPS = schema(subject="long", frame="string", ts="string")
LABELS = schema(
    item="string", new_item="string", check_again="int", viewed_image="int", from_second="int"
)
CATEGORIES = schema(item="string", category="string")
IMMOVABLE = schema(
    subject="long", frame="string", new_item="string", new_reason="string", category="string"
)
NO_ITEMS = schema(
    frame="string", item="string", comments="string", none="int", exclude="int",
    original_comments="string", subject="long",
)
CORRECTIONS = schema(
    frame="string", new_item="string", new_reason="string", new_category="string",
    comments="string", from_second="int", subject="long",
)
AGREEMENT = schema(
    site="string", subject="long", n_frames="long", category_agreement="double",
    item_agreement="double",
)


RECORDS = schema(
    subject="long", frame="string", item="string", none="int", exclude="int", unsure="int",
    tool_meal="int", tool_work="int",
)


def _parsed(text: Column, kind: T.DataType) -> Column:
    """A trimmed field under its type; NULL where it has none.  ``1.0`` is a whole number."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.LongType, T.IntegerType)):
        text = F.regexp_replace(text, r"^([+-]?\d+)\.0*$", "$1")
    return text.try_cast(kind)


def read_annotations(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multiline: bool = False,
    bad: str | None = None,
    observe: Observation | None = None,
) -> DataFrame:
    """Comma-separated text with a header, read under a declared schema.

    Columns bind by name if the header has every declared name, in any order and beside others; by
    position if it has none of them and as many columns, so the schema may rename them; anything
    else is an error.  Every file must have the same header.  The token ``NA``, an empty field and
    a quoted empty field all read as NULL; outer blanks are trimmed.

    A field that is not of its column's type stops the query with its text.  With ``bad`` it reads
    as NULL and that column tells what was wrong in the row (NULL if nothing); ``observe`` counts
    ``rows`` and ``bad_rows`` during the run that reads them.

    Files are split over tasks; ``multiline`` allows line breaks in quotes, at one task a file.
    """
    reader = (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    header = reader.csv(path).columns
    known = {h.strip().lower(): h for h in header}
    named = [f.name for f in schema.fields if f.name.lower() in known]
    if len(named) == len(schema.fields):
        source = [known[f.name.lower()] for f in schema.fields]
    elif not named and len(header) == len(schema.fields):
        source = header
    else:
        raise ValueError(f"{path}: header {header} does not fit the columns {schema.names}")
    text = T.StructType([T.StructField(h, T.StringType()) for h in header])
    rows = reader.schema(text).option("enforceSchema", False).csv(path)
    fields, wrong = [], []
    for h, f in zip(source, schema.fields):
        raw = F.nullif(F.trim(F.col(f"`{h}`")), F.lit(""))
        value = _parsed(raw, f.dataType)
        off = raw.isNotNull() & value.isNull()
        told = F.concat(F.lit(f"{f.name}: "), raw)
        if bad is None:
            value = F.when(off, F.raise_error(told).cast(f.dataType)).otherwise(value)
        wrong.append(F.when(off, told))
        fields.append(value.alias(f.name))
    if bad is not None:
        fields.append(F.nullif(F.concat_ws("; ", *wrong), F.lit("")).alias(bad))
    out = rows.select(*fields)
    if observe is not None:
        lost = F.count_if(F.col(f"`{bad}`").isNotNull()) if bad is not None else F.count_if(F.lit(False))
        out = out.observe(observe, F.count(F.lit(1)).alias("rows"), lost.alias("bad_rows"))
    return out


def time_of_day(text: Column) -> Column:
    """``HH:mm:ss`` as a time stamp of one fixed day; NULL for anything else."""
    return F.try_to_timestamp(text, F.lit("HH:mm:ss"))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] = []) -> DataFrame:
    """Write a table and hand the input back, so a step can both store and go on."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    if form == "csv":
        writer.option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    else:
        writer.format(form).save(path)
    return df


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer needed, such as one of ``scratch_folder``."""
    system, at = _files(spark, path)
    system.delete(at, True)


def publish(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Write a table in one run and put it in place only whole and only if it has rows.

    Rows are counted while they are written, to a folder beside ``path`` that takes its name at
    the end; an empty one is removed and leaves what was there.  Returns the number of rows.
    """
    spark = df.sparkSession
    seen = Observation()
    pending = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), pending, form)
    rows = seen.get["rows"]
    system, source = _files(spark, pending)
    if rows == 0:
        system.delete(source, True)
        return 0
    target = _files(spark, path)[1]
    system.delete(target, True)
    if not system.rename(source, target):
        raise OSError(f"cannot move {pending} to {path}")
    return rows


def write_if_any(df: DataFrame, path: str, form: str = "csv") -> bool:
    """Write only a non-empty table, in one run of its plan; tells whether it did."""
    return publish(df, path, form) > 0


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster needs it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="framewise-")
    return os.path.join(root, f"framewise-{name}-{uuid.uuid4().hex}")
