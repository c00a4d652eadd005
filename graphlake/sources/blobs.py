"""Binary objects by id: a table of (id, data), changed by whole-table versions like nodes are."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, data binary"


@dataclass(frozen=True)
class Blobs:
    """A value: inserting, updating or deleting gives another."""

    spark: SparkSession
    df: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Blobs:
        return Blobs(spark, spark.createDataFrame([], SCHEMA))

    @staticmethod
    def of_files(spark: SparkSession, path: str) -> Blobs:
        """All files below a folder; an id is the hash of the path."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return Blobs(spark, files.select(F.xxhash64("path").alias("id"), F.col("content").alias("data")))

    def get(self, id: int) -> bytes | None:
        row = self.df.where(F.col("id") == id).first()
        return bytes(row.data) if row else None

    def insert(self, *data: bytes) -> tuple[Blobs, list[int]]:
        """New ids follow the largest there is."""
        last = self.df.agg(F.max("id")).first()[0] or 0
        ids = list(range(last + 1, last + 1 + len(data)))
        return replace(self, df=self.df.unionByName(self.spark.createDataFrame(list(zip(ids, map(bytearray, data))), SCHEMA))), ids

    def update(self, id: int, data: bytes) -> Blobs:
        if self.get(id) is None:
            raise ValueError(f"Unknown blob: {id}")
        return replace(self, df=self.delete(id).df.unionByName(self.spark.createDataFrame([(id, bytearray(data))], SCHEMA)))

    def delete(self, id: int) -> Blobs:
        return replace(self, df=self.df.where(F.col("id") != id))
