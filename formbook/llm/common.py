"""What several operators share: reading, splits, bounded labelled samples, byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows handed to Python at once. Whole texts travel, so the batch is kept short.
BATCH_ROWS = 1000
# Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = f"_{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; a null key has none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(key, modulus) == F.lit(value), F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``limit`` labelled keys, chosen by a hash of the key.

    ``limit`` bounds the sample, so the chosen keys may be broadcast. Keys labelled twice count
    as 1 if either label is 1; labels other than 0 and 1 and null keys are left out.
    """
    chosen = (
        labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_k").agg(F.max("_y").alias("_y"))
        .withColumnRenamed("_k", key).where(usable).withColumnRenamed(key, "_k")
        .orderBy(F.xxhash64("_k"), "_k").limit(limit)
    )
    texts = docs.select(F.col(key).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias(text))
    return texts.join(F.broadcast(chosen), F.col("_d") == F.col("_k")).select(F.col("_k").alias(key), text, F.col("_y").alias("label"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each row starts (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_CODES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 29)]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 0 to n."""
    if which not in _POWERS or len(_POWERS[which][0]) < n + 1:
        size = max(n + 1, STEP_BYTES + 4096)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``which`` picks one of two independent families."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[which][data] * powers(len(data), which)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[start:end], whatever stands around."""
    return mix((sums[end] - sums[start]) * powers(len(sums) - 1, which)[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
