"""Helpers that the training-data operators share: scratch tables, text scans and exchanges of packed keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.sources.scratch import scratch_path

#: A-Z to a-z; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and all that is neither a digit, a letter nor part of a non-ASCII character becomes a space.
ALNUM = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, and survives lost executors. The files
    are there until sources.scratch.drop_scratch()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches, rows: int = 1000):
    """The batches in slices of at most that many rows, so that what a function makes of them stays small. Spark itself
    bounds a batch by bytes (64 MB unless set otherwise), so long texts come in batches of few rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def groups_of(batches, key: str):
    """From record batches sorted by an integer column: (key, table) for each key, one group in memory at a time."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            k = int(keys[lo])
            if held and k != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = k
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


def by_group(df: DataFrame, key: str, *order: str, parts: int | None = None) -> DataFrame:
    """Rows of a key in one task and next to each other, for groups_of()."""
    return df.repartition(parts or shuffle_partitions(df.sparkSession), F.col(key)).sortWithinPartitions(key, *order)
