"""Keyed tables that streams write to: appended per batch, folded on read, merged in generations.

A batch costs what it holds. Its rows are written under the batch's number, one folder per value of a partition column (a date, or a bucket of
the key), and a manifest of the batch names, per partition value, the parts that make up the table. When a partition has ``fan`` parts of one
generation, the batch that brings the last of them folds them into one part of the next, so a row is rewritten once per generation
and a partition never has more than ``fan`` parts per generation. Only partitions of the batch are touched.

Nothing is looked up to insert or update: what a key holds is decided by folding its rows in the order of their batches, at merges and on
read. Rows count however late they land. A replayed batch starts from the manifest before it and replaces its own parts and manifest;
readers see manifests only, so a batch that was lost half way is invisible. Old parts are left in place, so earlier manifests stay readable.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fold = Callable[[DataFrame], DataFrame]
VERSION = "__version"  # the number of the batch a row came with; a merged part has that of its newest batch
_MANIFEST = "part string, version long, generation int"


def keep_first(key: Sequence[str], position: Sequence[str]) -> Fold:
    """Insert if absent: the first row of a key stays; within a batch the least by ``position``."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, VERSION)]
        return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(VERSION, *position)).alias("__b")).select(*key, "__b.*")

    return fold


def keep_last(key: Sequence[str], position: Sequence[str]) -> Fold:
    """Upsert: each column has its newest value that is not null; within a batch the greatest by ``position``."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, VERSION)]
        newest = F.struct(VERSION, *position)
        return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in rest])

    return fold


def newest_row(key: Sequence[str]) -> Fold:
    """Replace: the row of the newest batch, nulls and all. A batch has one row per key."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, VERSION)]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), VERSION).alias("__b")).select(*key, "__b.*")

    return fold


def bucket(key: Sequence[str], buckets: int = 64) -> Column:
    """A partition column for keys without a date."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeyedLog:
    """A table under ``path``, partitioned by ``partition``, whose keys' rows are combined by ``fold``."""

    path: str
    partition: str
    fold: Fold
    fan: int = 8

    def _part(self, version: int, generation: int) -> str:
        return f"{self.path}/data/version={version:012d}/generation={generation}"

    def manifest(self, spark: SparkSession, batch_id: int | None = None) -> list[tuple[str, int, int]]:
        """(partition value, version, generation) of the table's parts after a batch, or after the last one."""
        folder = f"{self.path}/manifest"
        if batch_id is None:
            rows = spark.read.schema(f"{_MANIFEST}, batch long").parquet(folder)
            rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())
        else:
            rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/batch={batch_id:012d}")
        # as many rows as the table has parts: fan x generations x partition values at most
        return sorted((r["part"], r["version"], r["generation"]) for r in rows.where("version >= 0").collect())

    def _rows(self, spark: SparkSession, parts: Sequence[tuple[str, int, int]], schema: T.StructType) -> DataFrame:
        """The rows of parts, with their version."""
        whole = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("generation", T.IntegerType())])
        paths = [f"{self._part(v, g)}/{p}" for p, v, g in parts]
        read = spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths)
        return read.withColumnRenamed("version", VERSION).drop("generation")

    def _write(self, rows: DataFrame, version: int, generation: int) -> list[str]:
        """Writes a part for each partition value; their folders' names."""
        place = self._part(version, generation)
        rows.write.mode("overwrite").partitionBy(self.partition).parquet(place)
        # the files are listed, not read; one that is in no partition's folder has no rows
        found = (re.search(f"/({self.partition}=[^/]*)/", f) for f in rows.sparkSession.read.schema(rows.schema).parquet(place).inputFiles())
        return sorted({m[1] for m in found if m})

    def sink(self, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
        """Sink of a stream; ``prepare`` makes rows of the table from a batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(prepare(batch) if prepare else batch, batch_id)

        return write

    def append(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        held = self.manifest(spark, batch_id - 1) if batch_id else []
        folded = self.fold(rows.withColumn(VERSION, F.lit(batch_id).cast("long"))).select(*rows.columns)
        fresh = self._write(folded, batch_id, 0)
        parts = held + [(p, batch_id, 0) for p in fresh]
        generation = 0
        while full := self._full(parts, fresh, generation):
            merged = self.fold(self._rows(spark, full, rows.schema)).select(*rows.columns)
            done = self._write(merged, batch_id, generation + 1)
            gone = set(full)
            parts = [x for x in parts if x not in gone] + [(p, batch_id, generation + 1) for p in done]
            generation += 1
        # an empty table has a manifest, too
        listed = spark.createDataFrame(parts or [("", -1, 0)], _MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id:012d}")

    def _full(self, parts: list[tuple[str, int, int]], touched: Sequence[str], generation: int) -> list[tuple[str, int, int]]:
        """Parts of a generation in touched partitions that have ``fan`` of them."""
        mine = set(touched)
        found: dict[str, list[tuple[str, int, int]]] = {}
        for x in parts:
            if x[2] == generation and x[0] in mine:
                found.setdefault(x[0], []).append(x)
        return [x for p in found.values() if len(p) >= self.fan for x in p]

    def read(self, spark: SparkSession, schema: T.StructType, values: Sequence | None = None) -> DataFrame:
        """The table after the last batch; of partitions ``values`` only, where given."""
        parts = self.manifest(spark)
        if values is not None:
            wanted = {f"{self.partition}={v}" for v in values}
            parts = [x for x in parts if x[0] in wanted]
        if not parts:
            return spark.createDataFrame([], schema)
        return self.fold(self._rows(spark, parts, schema)).select(*schema.names)

    def newest(self, spark: SparkSession, schema: T.StructType, batch_id: int) -> DataFrame:
        """The rows that a batch brought."""
        return spark.read.schema(schema).parquet(self._part(batch_id, 0))
