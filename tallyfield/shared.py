"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is absent, a local run gets a folder of its own; on a cluster that is an error, as executors
    would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tallyfield/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one written table of this application, never used before."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran,
    and later readers get only the columns they ask for. by: a column of few values that readers
    filter on; each value has files of its own, so the size of a part is known when joins are planned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that written() made and nothing reads any more."""
    _delete(df.sparkSession, df.written_path)


def release(spark: SparkSession) -> None:
    """Delete everything that this application has written to the shared folder; frames made of it can't be read any more."""
    _delete(spark, _own_folder(spark))


def ranked(values: DataFrame, by: str, name: str) -> DataFrame:
    """values with the place of each row in the order of `by`, from 0 without a gap, as the column `name`.

    Rows are dealt out by range and numbered within their range, so no task sees more than
    one range; only the ranges' counts, one row for each, are put in one order.
    """
    dealt = values.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    kept = written(dealt, "ranked").withColumn("_range", F.shiftrightunsigned("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = (F.col("_first") + F.col("_at").bitwiseAND(2**33 - 1)).cast("long")
    return kept.join(firsts, "_range").withColumn(name, place).drop("_at", "_range", "_first")
