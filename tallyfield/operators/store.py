"""Stored tables without a transaction log: versioned Parquet, published by one pointer.

A write makes a new version folder, then a small pointer file names it; readers follow the pointer, so
they see a whole version or the one before. Old versions stay for reading as of a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import first_of_each


def _published(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_published")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted((int(v), int(again or 0)) for v, _, again in (n.partition(".") for n in names))


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions of a table, ascending."""
    return sorted({v for v, _ in _published(spark, root)})


def publish(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None, replace: bool = False) -> None:
    """Write a version and publish it. One that was published before is refused, or with replace, followed by a revision under its number.

    Readers see the revision from its pointer on; the files before it stay until reset(), so a reader that has begun goes on.
    """
    spark = df.sparkSession
    before = [again for v, again in _published(spark, root) if v == version]
    if before and not replace:
        raise ValueError(f"version {version} of {root} exists")
    name = f"{version}.{before[-1] + 1}" if before else str(version)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/v={name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_published/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()


def read(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame | None:
    """The newest published version, or the newest one up to as_of, in its last revision; None where there is none."""
    found = [(v, again) for v, again in _published(spark, root) if as_of is None or v <= as_of]
    return spark.read.parquet(f"{root}/v={found[-1][0]}" + (f".{found[-1][1]}" if found[-1][1] else "")) if found else None


def write_import(rows: DataFrame, root: str, number: int) -> None:
    """Rows of one import as a partition of their own; an import that is done again replaces its partition and touches no other."""
    own = rows.withColumn("import_id", F.lit(number).cast("long"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(root)


def read_import(spark: SparkSession, root: str, number: int) -> DataFrame:
    """The rows of one import; only its partition is read."""
    return spark.read.parquet(root).where(F.col("import_id") == F.lit(number).cast("long"))


def append_log(entries: DataFrame, root: str) -> None:
    """Add events to a log, each with the time it was written; what stands in it is never changed."""
    entries.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(root)


def reset(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Delete the tables under a folder but those to keep; the names of what went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted(f.getPath().getName() for f in store.listStatus(path) if f.getPath().getName() not in keep) if store.exists(path) else []
    for name in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return gone


def compare(incoming: DataFrame, stored: DataFrame, key: str = "natural_key", fingerprint: str = "fingerprint") -> DataFrame:
    """(key, action): INSERT, UPDATE (another fingerprint), DUPLICATE or ABSENT (stored, not incoming)."""
    new = incoming.select(key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_in"))
    old = stored.select(key, F.col(fingerprint).alias("_old"), F.lit(True).alias("_was"))
    action = (
        F.when(F.col("_was").isNull(), "INSERT").when(F.col("_in").isNull(), "ABSENT")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "DUPLICATE").otherwise("UPDATE")
    )
    return new.join(old, key, "full_outer").select(key, action.alias("action"))


def upsert(
    incoming: DataFrame, stored: DataFrame, batch: int, order: Column,
    key: str = "natural_key", fingerprint: str = "fingerprint",
) -> tuple[DataFrame, DataFrame]:
    """The table after a batch, and what the batch did: (merged, counters by action).

    Of rows that share a key within the batch the first counts, others are IN_FILE. New keys get first_batch_id;
    every key of the batch gets last_batch_id. An equal fingerprint keeps the stored values.
    """
    values = [c for c in incoming.columns if c != key]
    once = first_of_each(incoming, [key], [order])
    new = once.select(key, F.struct(*values).alias("_new"))
    old = stored.select(key, F.struct(*values).alias("_old"), "first_batch_id", "last_batch_id")
    both = new.join(old, key, "full_outer")
    touched = F.col("_new").isNotNull()
    same = F.col(f"_old.{fingerprint}").eqNullSafe(F.col(f"_new.{fingerprint}"))
    kept = F.when(F.col("_old").isNull() | (touched & ~same), F.col("_new")).otherwise(F.col("_old"))
    merged = both.select(
        key, kept.alias("_v"), F.coalesce("first_batch_id", F.lit(batch)).alias("first_batch_id"),
        F.when(touched, F.lit(batch)).otherwise(F.col("last_batch_id")).alias("last_batch_id"),
    ).select(key, "_v.*", "first_batch_id", "last_batch_id")
    repeats = incoming.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("IN_FILE").alias("action"), "n")
    counters = compare(once, stored, key, fingerprint).groupBy("action").agg(F.count("*").alias("n")).unionByName(repeats)
    return merged, counters


def as_of(rows: DataFrame, batch: int) -> DataFrame:
    """Accumulated tables as a batch saw them: rows that had come by then."""
    return rows.where(F.col("first_batch_id") <= batch)


def snapshot(rows: DataFrame, batch: int) -> DataFrame:
    """Snapshot tables: the rows that the batch itself carried."""
    return rows.where(F.col("last_batch_id") == batch)


def latest_batch_with(batches: DataFrame, file_column: str, before: int | None = None) -> DataFrame:
    """(batch_id): the greatest id that has a file of a type, below a bound if there is one."""
    rows = batches if before is None else batches.where(F.col("batch_id") < before)
    return rows.agg(F.max(F.when(F.col(file_column).isNotNull(), F.col("batch_id"))).alias("batch_id"))


def current_files(files: DataFrame, batches: DataFrame, up_to: int) -> DataFrame:
    """The latest file of every type up to a batch, of batches that did not fail."""
    good = batches.where((F.col("batch_id") <= up_to) & (F.col("status") != "ERROR")).select("batch_id")
    known = files.join(good, "batch_id")
    return known.groupBy("file_type").agg(F.max_by(F.struct("batch_id", "file_name"), F.struct("batch_id", "file_name")).alias("f")).select("file_type", "f.*")


def dimension(rows: DataFrame, stored: DataFrame | None, key: str, attributes: list[str], order: Column) -> DataFrame:
    """Get or create: a dimension's rows with the newest attributes; keys that rows don't have stay as stored."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*attributes), order).alias("_a")).select(key, "_a.*")
    return last if stored is None else last.unionByName(stored.select(key, *attributes).join(last.select(key), key, "left_anti"))


def contract_dimension(rows: DataFrame, stored: DataFrame, order: Column) -> DataFrame:
    """Contracts with the newest quantity; a stored one changes only where both are known and differ by more than 0.01."""
    last = rows.where("contract_number is not null").groupBy("contract_number").agg(F.max_by(F.struct("contract_qty"), order).alias("_a")).select("contract_number", F.col("_a.contract_qty").alias("_new"))
    both = last.join(stored.select("contract_number", F.col("contract_qty").alias("_old"), F.lit(True).alias("_was")), "contract_number", "full_outer")
    changed = F.col("_was").isNull() | F.coalesce(F.abs(F.col("_new") - F.col("_old")) > 0.01, F.lit(False))
    return both.select("contract_number", F.when(changed, F.col("_new")).otherwise(F.col("_old")).alias("contract_qty"))


def unseen_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """binaryFile rows whose bytes were not imported before, each content once."""
    hashed = files.select("path", "content", F.sha2("content", 256).alias("source_hash"))
    return first_of_each(hashed, ["source_hash"], ["path"]).join(seen.select("source_hash"), "source_hash", "left_anti")


def batches_of_day(batches: DataFrame, day: Column) -> DataFrame:
    """(batches): how many batches that did not fail a report day has."""
    return batches.where((F.col("report_date") == day) & (F.col("status") != "ERROR")).agg(F.count("*").alias("batches"))


def taken_slugs(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, slug): entries to be saved whose slug another entry has, stored or in the same set; an entry's own stored row is no obstacle."""
    mine = entries.select("id", "slug")
    theirs = stored.select(F.col("id").alias("_id"), F.col("slug").alias("_slug")).unionByName(entries.select(F.col("id").alias("_id"), F.col("slug").alias("_slug")))
    # of a slug the least and the greatest owner are enough to know of another one
    owners = theirs.groupBy("_slug").agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
    return mine.join(owners, mine.slug == owners._slug).where((F.col("least") != F.col("id")) | (F.col("most") != F.col("id"))).select("id", "slug")


def retention(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """A history view: the newest n rows."""
    return rows.orderBy(*order).limit(n)
