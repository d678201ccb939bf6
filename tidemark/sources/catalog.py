"""Tables and indexes by name. Their definitions are rows of a version log like any other, so they commit, recover and replay with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import Result, VersionedTable

#: kind: table, primary or secondary; of: an index's table; columns: comma-joined keys.
ENTRIES = "name string, kind string, of string, schema string, columns string, path string"


@dataclass
class Catalog:
    """Definitions below one folder, where the tables lie too."""

    path: str

    def entries(self) -> VersionedTable:
        return VersionedTable(f"{self.path}/_definitions", ["name"])

    def create(self, spark: SparkSession) -> Catalog:
        self.entries().create(spark, ENTRIES)
        return self

    def _define(self, spark: SparkSession, rows: list[tuple]) -> None:
        log = self.entries()
        staged = spark.createDataFrame(rows, ENTRIES).withColumn("op", F.lit("I"))
        if (found := log.commit(spark, staged, log.watermark(spark))) is not Result.OK:
            raise ValueError(f"{rows[0][0]}: {found.value}")

    def create_table(self, spark: SparkSession, name: str, schema: str, key: Sequence[str]) -> VersionedTable:
        """A table and its primary index, in one commit; fails if the name is taken."""
        where = f"{self.path}/{name}"
        self._define(spark, [(name, "table", None, schema, ",".join(key), where), (f"{name}.primary", "primary", name, None, ",".join(key), None)])
        return VersionedTable(where, list(key)).create(spark, schema)

    def create_index(self, spark: SparkSession, name: str, of: str, columns: Sequence[str], unique: bool = False) -> None:
        """A secondary index: a column list that lookups and sorted copies use, and that a unique one holds commits to."""
        self.table(spark, of)
        self._define(spark, [(name, "unique" if unique else "secondary", of, None, ",".join(columns), f"{self.path}/{of}.{name}")])

    def _entry(self, spark: SparkSession, name: str):
        found = self.entries().at(spark).filter(F.col("name") == name).collect()  # one row or none
        if not found:
            raise KeyError(name)
        return found[0]

    def table(self, spark: SparkSession, name: str) -> VersionedTable:
        """The table of that name, with its unique indexes."""
        e = self._entry(spark, name)
        unique = self.entries().at(spark).filter((F.col("of") == name) & (F.col("kind") == "unique")).collect()  # an index a row
        return VersionedTable(e.path, e.columns.split(","), [u.columns.split(",") for u in unique])

    def drop(self, spark: SparkSession, name: str) -> None:
        """The name and its indexes go; earlier stamps still show them."""
        log = self.entries()
        gone = log.at(spark).filter((F.col("name") == name) | (F.col("of") == name)).drop("commit_ts").withColumn("op", F.lit("D"))
        if (found := log.commit(spark, gone, log.watermark(spark))) is not Result.OK:
            raise ValueError(f"{name}: {found.value}")

    def build(self, spark: SparkSession, name: str) -> DataFrame:
        """An index's sorted copy of its table's newest state, made anew: files hold ranges of the index's columns, so a scan of a range reads few of them."""
        e = self._entry(spark, name)
        columns = e.columns.split(",")
        rows = self.table(spark, e.of).at(spark).drop("op", "commit_ts")
        rows.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(e.path)
        return spark.read.parquet(e.path)
