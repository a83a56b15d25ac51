"""Documents to a training mix: toxicity, near-duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet and read again as the next stage's documents.
All but the last return the columns of ``documents``. The rows are the documents that the mix takes at least once, with the words it takes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm import decontaminate, minhash, mixing, secrets, toxicity
from formbook.llm.common import held_out, table
from formbook.session import tune
from formbook.sources.tables import work_folder

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a toxicity score of at least ``THRESHOLD`` go. The lexicon comes from the labelled documents."""
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"), ~held_out("doc_id", 4, 2))
    return docs.where(toxicity.toxicity_score(lexicon) < THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    found = decontaminate.with_hits(docs, table(spark, folder, "benchmark"), into="_leaks")
    return found.where(F.size("_leaks") == 0).drop("_leaks")


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; the documents stay, with ``n_chars`` of what is left."""
    found = secrets.with_spans(docs, secrets.discoveries(docs), into="_spans").withColumn("_all", F.concat("_spans", "_spans_random"))
    changed = F.size("_all") > 0
    out = found.withColumn("text", F.when(changed, secrets.redacted(F.col("text"), F.col("_all"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of the documents in the mix."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

# Hashes, learned weights and edit distances are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    place = work_folder(spark, "corpus")
    for n, (name, stage) in enumerate(STAGES):
        kept = f"{place}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(kept)
        docs = spark.read.parquet(kept)
    return docs
