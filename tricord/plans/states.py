"""Numbered states of an iteration in the shared folder, from which a run goes on after its driver was lost."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tricord.plans.storage import remove


class States:
    """Folders ``path/000012`` with a table and values; one counts once its values, which are written last, are there.

    Only the last state and the one before it are kept. ``path`` belongs to one run: what it holds decides where that goes on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        """The numbers of committed states."""
        home = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(home)]
        mark = lambda n: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/values/_SUCCESS")
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(mark(n)))

    def save(self, number: int, values: dict, table: DataFrame | None = None) -> DataFrame | None:
        """Write a state; returns its table as it is read back. Numbers are kept exactly: a double's JSON is its shortest repr."""
        folder = f"{self.path}/{number:06d}"
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/table")
            table = self.spark.read.schema(table.schema).parquet(f"{folder}/table")
        self.spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/values")
        for old in self._numbers()[:-2]:
            remove(self.spark, f"{self.path}/{old:06d}")
        return table

    def last(self, schema: str | None = None) -> tuple[int, dict, DataFrame | None] | None:
        """(number, values, table) of the last committed state, or None."""
        numbers = self._numbers()
        if not numbers:
            return None
        folder = f"{self.path}/{numbers[-1]:06d}"
        values = json.loads(self.spark.read.text(f"{folder}/values").first()[0])
        return numbers[-1], values, self.spark.read.schema(schema).parquet(f"{folder}/table") if schema else None
