"""Columnar scans, sinks, and keyed writes to Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.functions.text import to_utc, utc_text
from formbook.operators.quality import require_unique

TEAM_GAMES = (
    "team string, season int, gameId bigint, opposingTeam string, gameDate string, situation string, iceTime double, "
    "xGoalsFor double, shotAttemptsFor double, unblockedShotAttemptsFor double, xGoalsAgainst double, "
    "shotAttemptsAgainst double, unblockedShotAttemptsAgainst double, playoffGame int"
)
GOALIE_SITUATIONS = (
    "playerId bigint, gameId bigint, season int, playerTeam string, gameDate string, situation string, "
    "xGoals double, ongoal double, rebounds double, highDangerShots double"
)


def read_game_csv(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str], key: Sequence[str], season_floor: int, check: bool = True
) -> DataFrame:
    """Header CSV pruned to ``columns`` with yyyyMMdd dates and a season floor."""
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False).where(F.col("season") >= season_floor)
    out = rows.withColumn("gameDate", F.to_date("gameDate", "yyyyMMdd")).select(*columns)
    return require_unique(out, key) if check else out


def parse_game_csv(df: DataFrame, column: str, schema: str, columns: Sequence[str], season_floor: int) -> DataFrame:
    """The same for CSV lines held in a string column (landed logs, zipped members)."""
    rows = df.select(F.from_csv(F.col(column), schema).alias("__r")).select("__r.*").where(F.col("season") >= season_floor)
    return rows.withColumn("gameDate", F.to_date("gameDate", "yyyyMMdd")).select(*columns)


def audited_scan(df: DataFrame, columns: Sequence[str], predicate: Column, date: str) -> tuple[DataFrame, DataFrame]:
    """The pruned scan and its one-row audit: rows, date range and an order-free content hash."""
    rows = df.where(predicate).select(*columns)
    return rows, content_audit(rows, date)


def content_audit(rows: DataFrame, date: str) -> DataFrame:
    """Rows, date range, schema hash, and a hash of the rows as a multiset.

    Each row is digested with its values' lengths, so no two rows are written alike, and both 64-bit halves of the digests are summed: the order of rows and
    partitions does not count, repeats do, and sums of parts merge by addition.
    """
    names = sorted(rows.columns)
    values = [F.col(c).cast("string") for c in names]
    digest = F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))
    halves = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17)]
    schema = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.to_date(date)).alias("min_date"), F.max(F.to_date(date)).alias("max_date"),
        F.concat_ws("-", *halves).alias("content_hash"), F.md5(F.lit(schema)).alias("schema_hash"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet, CSV or JSON lines."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.format(fmt).save(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import os
    import tempfile

    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="formbook-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def snapshot_rows(df: DataFrame, fetched_at: str) -> DataFrame:
    """Log rows with normalised time stamps and the older odds column names accepted."""
    have = set(df.columns)

    def either(a: str, b: str) -> Column:
        options = [F.col(c) for c in (a, b) if c in have]
        return F.coalesce(*options) if options else F.lit(None).cast("int")

    return df.withColumns(
        {
            "fetched_at_utc": utc_text(to_utc(F.col(fetched_at))),
            "odds_over": either("odds_over", "line_over"),
            "odds_under": either("odds_under", "line_under"),
        }
    )


def append_snapshots(df: DataFrame, path: str, fetched_at: str) -> None:
    snapshot_rows(df, fetched_at).write.mode("append").parquet(path)


def _null_safe(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def insert_new(target: DataFrame, batch: DataFrame, key: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not in the target; the first of a repeated key.  NULL key parts match."""
    rest = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("__b")).select(*key, "__b.*")
    held = target.select(*key).distinct()
    return first.join(held, _null_safe(first, held, key), "left_anti").select(*batch.columns)


def upsert(target: DataFrame, patch: DataFrame, key: Sequence[str], values: Sequence[str], only_null: bool = False) -> DataFrame:
    """Target with the patch applied by key, optionally only where a value is still missing."""
    p = patch.select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(v).alias(f"__p_{v}") for v in values], F.lit(True).alias("__hit"))
    cond = reduce(lambda x, y: x & y, [target[k].eqNullSafe(p[f"__k_{k}"]) for k in key])
    joined = target.join(p, cond, "left")
    out = {}
    for v in values:
        new, old = F.col(f"__p_{v}"), F.col(v)
        out[v] = F.coalesce(old, new) if only_null else F.when(F.col("__hit"), F.coalesce(new, old)).otherwise(old)
    return joined.withColumns(out).select(*target.columns)


def upsert_partitions(
    spark: SparkSession, live: str, patch: DataFrame, key: Sequence[str], values: Sequence[str], partition: str, only_null: bool = False
) -> None:
    """Rewrite only the partitions the patch touches.

    The merged partitions are staged in a separate folder first, so the live path is never
    read and overwritten by one job and a failed run leaves it whole.
    """
    target = spark.read.parquet(live)
    touched = target.join(patch.select(partition).distinct(), partition, "left_semi").select(*target.columns)
    stage = work_folder(spark, "upsert")
    upsert(touched, patch, key, values, only_null).write.parquet(stage)
    (
        spark.read.schema(target.schema).parquet(stage).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(live)
    )


def build_tickets(df: DataFrame, stake: str, multiplier: str, payout: str, reason: str) -> DataFrame:
    """Derive the missing one of multiplier and payout; a ticket needs a stake and a reason."""
    m = F.coalesce(F.col(multiplier), F.try_divide(F.col(payout), F.nullif(F.col(stake), F.lit(0.0))))
    p = F.coalesce(F.col(payout), F.col(stake) * F.col(multiplier))
    problem = (
        F.when(F.col(reason).isNull() | (F.trim(reason) == ""), F.lit("missing reason"))
        .when(F.col(stake).isNull() | (F.col(stake) <= 0), F.lit("bad stake"))
        .otherwise(F.lit(""))
    )
    return df.withColumns({"payout_multiplier": m, "potential_payout": p, "problem": problem})


def read_bets(spark: SparkSession, path: str, min_date=None, pending_only: bool = False, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Tracker scan; both predicates reach the Parquet reader."""
    return filter_bets(spark.read.parquet(path), "game_date", "result", min_date, pending_only).select(*columns)


def filter_bets(bets: DataFrame, date: str, result: str, min_date=None, pending_only: bool = False) -> DataFrame:
    out = bets if min_date is None else bets.where(F.col(date) >= F.lit(min_date))
    return out.where(F.col(result).isNull()) if pending_only else out


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN from other writers is converted at ingest."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
