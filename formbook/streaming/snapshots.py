"""The snapshot log as Structured Streaming jobs.

Keyed results go to a ``KeyedLog``, whose batches cost what they hold, take rows however late they land, and replace
themselves when they are replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.operators.grading import settle_tickets
from formbook.session import checkpointed
from formbook.streaming.logs import KeyedLog, bucket, keep_last, newest_row


def landing_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, work: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that has landed, then stop; restarts continue from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{work}/_checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def firewall(path: str, ts: str, start: str) -> Callable[[DataFrame, int], None]:
    """Sink: rows stamped at or before the start to ``pregame``, the others to ``late``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.coalesce(F.col(ts) <= F.col(start), F.lit(False))
        name = f"batch={batch_id:012d}"
        batch.where(ok).write.mode("overwrite").parquet(f"{path}/pregame/{name}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{path}/late/{name}")

    return write


def line_parts(key: Sequence[str], ts: str, tie: str, start: str, line: str) -> Callable[[DataFrame], DataFrame]:
    """What rows say of the lines of their keys: newest and closing row, and their number."""

    def parts(rows: DataFrame) -> DataFrame:
        said = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(line).alias("line"))
        return rows.groupBy(*key).agg(
            F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(line).alias("line"), F.col(start).alias("start"))).alias("newest"),
            F.max(F.when(F.col(ts) <= F.col(start), said)).alias("closing"),
            F.count(F.lit(1)).alias("n"),
        )

    return parts


def fold_lines(key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Puts ``line_parts`` together, in whatever order their rows were stamped."""
    return lambda parts: parts.groupBy(*key).agg(F.max("newest").alias("newest"), F.max("closing").alias("closing"), F.sum("n").alias("n"))


def line_columns(parts: DataFrame, key: Sequence[str]) -> DataFrame:
    return parts.select(
        *key, F.col("newest.line").alias("current_line"), F.col("newest.ts").alias("current_ts"), F.col("newest.start").alias("scheduled_start"),
        F.col("n").alias("n_snapshots"), F.col("closing.line").alias("closing_line"),
    )


@dataclass(frozen=True)
class Resettlement:
    """Legs that wait for facts of their keys (a result, a closing line), and the tickets they belong to.

    Facts arrive in any order, one or several at a time, and may be corrected. Each batch adds its facts to a keyed log in which every column keeps its newest value,
    then grades all legs of the tickets that have a leg among the batch's keys, from all that is known so far. So a result that comes before its closing line
    is graded at once and gets its closing line with the batch that brings it, and a correction settles its tickets anew.
    """

    path: str
    legs: DataFrame
    leg_key: Sequence[str]
    leg_id: Sequence[str]
    ticket: Sequence[str]
    facts: T.StructType
    graded: Callable[[DataFrame], dict[str, Column]]
    result: str = "result"
    # one scan of the legs for each batch; of the facts only the buckets that their legs need are read

    @property
    def known(self) -> KeyedLog:
        return KeyedLog(f"{self.path}/facts", "__bucket", keep_last(["__bucket", *self.leg_key], ["__pos"]))

    def _log(self, name: str, key: Sequence[str]) -> KeyedLog:
        return KeyedLog(f"{self.path}/{name}", "__bucket", newest_row(["__bucket", *key]))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Sink of a stream of facts; the greatest row of a key within a batch wins."""
        spark = batch.sparkSession
        names = [f.name for f in self.facts.fields]
        rest = [c for c in names if c not in self.leg_key]
        rows = batch.select(*names, F.struct(*rest).alias("__pos"), bucket(self.leg_key).alias("__bucket"))
        self.known.append(rows, batch_id)
        touched = rows.select(*self.leg_key).distinct().withColumn("__hit", F.lit(1))
        marked = self.legs.join(touched, list(self.leg_key), "left")
        mine = Window.partitionBy(*self.ticket)
        open_legs = checkpointed(marked.withColumn("__any", F.max("__hit").over(mine)).where("__any = 1").drop("__hit", "__any"))
        buckets = [r[0] for r in open_legs.select(bucket(self.leg_key)).distinct().collect()]  # 64 at most
        facts = self.known.read(spark, rows.schema, buckets).select(*names)
        legs = open_legs.join(facts, list(self.leg_key), "left")
        legs = legs.withColumns(self.graded(legs))
        self._log("legs", self.leg_id).append(legs.withColumn("__bucket", bucket(self.leg_id)), batch_id)
        # graded once: tickets are settled from the legs as they were written
        written = self._log("legs", self.leg_id)
        newest = written.newest(spark, legs.withColumn("__bucket", bucket(self.leg_id)).schema, batch_id).drop("__bucket")
        settled = settle_tickets(newest, self.ticket, self.result)
        self._log("tickets", self.ticket).append(settled.withColumn("__bucket", bucket(self.ticket)), batch_id)

    def read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        """``legs`` or ``tickets`` after the last batch."""
        key = self.leg_id if name == "legs" else self.ticket
        whole = T.StructType([*schema.fields, T.StructField("__bucket", T.IntegerType())])
        return self._log(name, key).read(spark, whole).drop("__bucket")
