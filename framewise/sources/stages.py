"""Stages of a long run, stored so that a later run goes on after the last whole one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.sources.files import exists

MANIFEST = "name string, params string, inputs string, rows long"


def file_state(spark: SparkSession, path: str) -> list[list]:
    """Names, sizes and times of the files below a path: what a stage that reads them depends on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "length", F.unix_micros("modificationTime")).collect()
    return sorted([list(r) for r in rows])


@dataclass(frozen=True)
class Stage:
    """A stored stage: its table, its key and whether this run had to compute it."""

    key: str
    table: DataFrame
    computed: bool


class StageStore:
    """Stored stages below a shared folder.

    A stage is known by its name, its parameters and the keys of its inputs, so a changed parameter
    or input makes it and all that follow it new.  Its table is written first and its manifest last;
    a stage without a manifest was not finished and is computed again over what it left.  A run may
    skip everything before a stored stage: the inputs of a stored stage are never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stage(
        self, name: str, build: Callable[..., DataFrame], inputs: list[Stage] = [], params: object = None
    ) -> Stage:
        """The table of ``build(*tables of the inputs)``, stored or computed now.

        ``params`` is anything that JSON can hold and that the result depends on, the states of
        source files (``file_state``) included.
        """
        told = {"name": name, "params": json.dumps(params, sort_keys=True), "inputs": " ".join(i.key for i in inputs)}
        key = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
        folder = f"{self.root}/{name}-{key[:24]}"
        computed = not self._whole(folder)
        if computed:
            build(*[i.table for i in inputs]).write.mode("overwrite").parquet(f"{folder}/data")
            rows = self.spark.read.parquet(f"{folder}/data").count()
            manifest = self.spark.createDataFrame([(*told.values(), rows)], MANIFEST)
            manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return Stage(key, self.spark.read.parquet(f"{folder}/data"), computed)

    def _whole(self, folder: str) -> bool:
        # Spark adds this file when all tasks of a write are done
        return exists(self.spark, f"{folder}/manifest/_SUCCESS")
