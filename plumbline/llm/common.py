"""Shared plumbing: tables, keys, and what may be broadcast.

Nothing here keeps state outside the session's shared folder. Intermediate
tables are Parquet written below ``spark.checkpoint.dir``; a task that is lost
is computed again from those files or from the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import materialize, release, shared_path
from ..functions.workers import find_package

#: What a table that is broadcast may take in memory.
BROADCAST_BYTES = 64 << 20
#: Rows that Spark hands to Python at once, and their bytes; a row may hold a long text.
ARROW_ROWS = 500
ARROW_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch of whole texts can take in a Python worker, by rows and by bytes.

    These are settings of the session and stay, as a frame is run after this
    returns. Workers must also find this package where the driver did.
    """
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def memory_bytes(df: DataFrame) -> int:
    """What a written table takes in a broadcast: 16 bytes for each value and each row, and its texts' bytes."""
    values = sum(len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1 for f in df.schema.fields)
    long = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lists = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    sizes = [F.sum(F.octet_length(c).cast("long")) for c in long] + [F.sum(F.size(c).cast("long") * 32) for c in lists]
    found = df.agg(F.count(F.lit(1)), *sizes).first()
    return found[0] * 16 * (values + 1) + sum(x or 0 for x in found[1:])


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return memory_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def join_by_keys(df: DataFrame, keys: DataFrame, on, how: str, limit: int | None = None) -> DataFrame:
    """Join with a written table of keys or of a row per key.

    Its size is taken first: up to ``limit`` bytes it is broadcast, so the wide
    side doesn't move; beyond it both sides are shuffled, and as neither is an
    aggregate by the same key, adaptive execution can split a hot one.
    """
    return df.join(F.broadcast(keys) if is_small(keys, limit) else keys.hint("merge"), on, how)


__all__ = ["BROADCAST_BYTES", "free_name", "is_small", "join_by_keys", "materialize", "memory_bytes", "release", "shared_path", "small_batches", "table"]
