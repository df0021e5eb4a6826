"""What the operators share: words, row identities, batches, safe column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import forget, ranked, scratch_path, shared_folder, written

__all__ = [
    "WORD", "batches_of", "forget", "identity", "lower_ascii", "only", "ranked", "scratch_path", "shared_folder", "task_count", "text_of", "written",
]

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker gets at a time, so that long texts don't add up; Arrow batches are bounded by rows.
BATCH_ROWS = 1000


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so extra columns of any name can't clash."""
    return df.select(*[df[f"`{n}`"] for n in names])


def text_of(column: str = "text") -> Column:
    """The whole text; a null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def identity(df: DataFrame, *names: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of the named columns, or of all of them: rows agree in both where they are equal.

    128 bits tell 10**12 rows apart but for a chance of one in 10**14. Null is a value of its own.
    """
    parts = []
    for n in names or df.columns:
        column = F.col(f"`{n}`")
        # maps have no hash and no order of their own
        parts += [column.isNull(), F.to_json(F.struct(column)) if _has_map(df.schema[n].dataType) else column]
    return F.xxhash64(*parts), F.xxhash64(F.lit(77), *reversed(parts))


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, jobs hand at most so many rows at a time to Python workers; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
