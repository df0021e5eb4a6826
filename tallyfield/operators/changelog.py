"""Keyed tables as change logs: a batch writes its own rows, compaction folds them into validity intervals.

Rows lie in buckets by the hash of their key. A row holds a key's values from a batch on (`_from`) until the batch that changed
them (`_to`, null while they hold). A batch adds one row for each of its keys and rewrites nothing; a bucket whose added rows have
grown beyond a share of what it holds is compacted by itself: its intervals are closed and written anew. So bytes written follow the
changes, not the table, and so does storage.

A manifest names the files of every bucket. It is published by one rename, so readers see all of a batch or nothing
of it. Reading as of a batch is a filter on intervals over the newest manifest; only rows added since a bucket's compaction need
a join, and those are few by the rule of compaction. There is one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import forget, written

#: Buckets of a table, rows that a file holds at most, and the share of added rows from which on a bucket is compacted.
BUCKETS = 64
FILE_ROWS = 4_000_000
COMPACT_SHARE = 0.5
_OWN = T.StructType([T.StructField("first_batch_id", T.LongType()), T.StructField("last_batch_id", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType())])


@dataclass
class Manifest:
    """What a published state is made of; parts are folders by the number of the manifest that wrote them."""

    number: int
    batch: int
    key: str
    fingerprint: str
    buckets: int
    schema: str
    rows: int = 0
    oldest: int = 0
    base: dict[str, int] = field(default_factory=dict)
    added: dict[str, list[int]] = field(default_factory=dict)
    base_rows: dict[str, int] = field(default_factory=dict)
    added_rows: dict[str, int] = field(default_factory=dict)
    did: dict[str, int] = field(default_factory=dict)

    def stored(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _store(spark: SparkSession, path: str):  # noqa: ANN202 - a Java object
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, root: str) -> list[int]:
    store, where = _store(spark, f"{root}/_manifest")
    names = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest published state."""
    numbers = _numbers(spark, root)
    return Manifest(**json.loads(spark.read.text(f"{root}/_manifest/{numbers[-1]:012d}.json", wholetext=True).first()[0])) if numbers else None


def _publish(spark: SparkSession, root: str, state: Manifest) -> None:
    store, draft = _store(spark, f"{root}/_manifest/{state.number:012d}.draft")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(asdict(state)), "utf-8"))
    out.close()
    if not store.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{state.number:012d}.json")):
        raise RuntimeError(f"another writer has published {root} number {state.number}")


def _files(spark: SparkSession, root: str, state: Manifest, parts: list[tuple[str, int]]) -> DataFrame:
    """The rows of (bucket, number) parts, with _bucket."""
    schema = state.stored()
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())]))
    paths = [f"{root}/data/number={n}/_bucket={b}" for b, n in parts]
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).drop("number")


def _state(spark: SparkSession, root: str, state: Manifest, as_of: int | None = None, buckets: list[str] | None = None) -> DataFrame:
    """The rows that hold as of a batch, one for each key, with _from, _to and _bucket."""
    own = lambda b: buckets is None or b in buckets
    at = state.batch if as_of is None else as_of
    held = _files(spark, root, state, [(b, n) for b, n in state.base.items() if own(b)])
    held = held.where((F.col("_from") <= at) & (F.col("_to").isNull() | (F.col("_to") > at)))
    parts = [(b, n) for b, ns in state.added.items() for n in ns if own(b)]
    if not parts:
        return held
    added = _files(spark, root, state, parts).where(F.col("_from") <= at)
    rest = [c for c in added.columns if c != state.key]
    last = added.groupBy(state.key).agg(F.max_by(F.struct(*rest), "_from").alias("_r")).select(state.key, "_r.*")
    return held.join(last.select(state.key), state.key, "left_anti").unionByName(last)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.drop("_from", "_to", "_bucket")


def read(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame | None:
    """The table as of a batch, its own included: values, first_batch_id and last_batch_id as they stood then; None before the first one."""
    state = manifest(spark, root)
    if state is None:
        return None
    if as_of is not None and as_of < state.oldest:
        raise ValueError(f"{root} remembers batch {state.oldest} and later")
    return _shown(_state(spark, root, state, as_of))


def snapshot(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The rows that a batch itself carried."""
    return read(spark, root, batch).where(F.col("last_batch_id") == batch)


def history(spark: SparkSession, root: str) -> DataFrame:
    """Every interval: key, values, and the batches from and to which (exclusive) they held."""
    state = manifest(spark, root)
    return _closed(_files(spark, root, state, [*state.base.items(), *((b, n) for b, ns in state.added.items() for n in ns)]), state.key).drop("_bucket")


def _closed(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose intervals end where the next one of their key begins."""
    return rows.withColumn("_to", F.lead("_from").over(Window.partitionBy("_bucket", key).orderBy("_from")))


def _write(rows: DataFrame, root: str, number: int, most: int) -> None:
    """Files by bucket, each of FILE_ROWS at most where a bucket holds `most` rows."""
    piece = F.pmod(F.xxhash64("_piece"), F.lit(max(1, -(-most // FILE_ROWS))))
    dealt = rows.withColumn("_piece", piece).repartition("_bucket", "_piece").drop("_piece")
    dealt.write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(f"{root}/data/number={number}")


def merge(
    incoming: DataFrame, root: str, batch: int, order: Column | str,
    key: str = "natural_key", fingerprint: str = "fingerprint", buckets: int = BUCKETS, share: float | None = COMPACT_SHARE,
) -> dict[str, int]:
    """Merge a batch into the table under root; how many keys it did what to: INSERT, UPDATE, DUPLICATE, ABSENT, and rows IN_FILE and NO_KEY.

    Of rows that share a key the first by order counts, others are IN_FILE; rows without a key are NO_KEY. A new key gets
    first_batch_id, every key of the batch last_batch_id; an equal fingerprint keeps the stored values. Stored keys that the batch lacks
    stay and are counted as ABSENT. Batches come in ascending order; the newest one again changes nothing and
    gives its counts, so a writer that starts over is safe. Buckets whose added rows exceed the share are compacted, none if it is None.
    """
    spark = incoming.sparkSession
    state = manifest(spark, root)
    if state and batch == state.batch:
        return state.did
    if state and batch < state.batch:
        raise ValueError(f"batch {batch} comes after batch {state.batch} in {root}")
    taken = {"first_batch_id", "last_batch_id", "_from", "_to", "_bucket", "_piece", "_seen", "_new", "_old", "_first", "_came", "number"} & set(incoming.columns)
    if taken:
        raise ValueError(f"columns that the table uses itself: {sorted(taken)}")
    if state is None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in incoming.schema] + _OWN.fields)
        state = Manifest(0, batch, key, fingerprint, buckets, schema.json(), oldest=batch)
    values = [f.name for f in state.stored() if f.name not in {key, *_OWN.names}]
    if {key, *values} != set(incoming.columns):
        raise ValueError(f"{root} holds {sorted({key, *values})}, the batch {sorted(incoming.columns)}")
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(state.buckets)).cast("int"))
    once = incoming.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("_new"), F.count("*").alias("_came"))
    once = written(once.withColumn("_bucket", bucket), "batch")

    # only the keys of the batch are looked up, in the buckets that they lie in
    came = {r["_bucket"]: r for r in once.groupBy("_bucket").agg(F.count("*").alias("keys"), F.sum("_came").alias("rows")).collect()}
    no_key = came.pop(None, None)
    found = _state(spark, root, state, buckets=[str(b) for b in came]).join(once.select(key), key, "left_semi")
    known = found.select(key, F.struct(*values).alias("_old"), F.col("first_batch_id").alias("_first"))
    both = once.where("_bucket is not null").join(known, key, "left")
    same = F.col(f"_old.{fingerprint}").eqNullSafe(F.col(f"_new.{fingerprint}"))
    action = F.when(F.col("_first").isNull(), "INSERT").when(same, "DUPLICATE").otherwise("UPDATE")
    rows = both.select(
        key, F.when(action == "DUPLICATE", F.col("_old")).otherwise(F.col("_new")).alias("_v"), F.coalesce("_first", F.lit(batch)).cast("long").alias("first_batch_id"),
        F.lit(batch).cast("long").alias("last_batch_id"), F.lit(batch).cast("long").alias("_from"), F.lit(None).cast("long").alias("_to"), "_bucket", action.alias("_seen"),
    )
    done = written(rows.select(key, "_v.*", *_OWN.names, "_bucket", "_seen"), "changes")
    # a row for each bucket and action
    counts = done.groupBy("_bucket", "_seen").agg(F.count("*").alias("n")).collect()
    forget(once)
    by_bucket: dict[str, int] = {}
    did = dict.fromkeys(("INSERT", "UPDATE", "DUPLICATE"), 0)
    for r in counts:
        by_bucket[str(r["_bucket"])] = by_bucket.get(str(r["_bucket"]), 0) + r["n"]
        did[r["_seen"]] += r["n"]
    number = state.number + 1
    most = max(by_bucket.values(), default=0)
    if counts:
        _write(done.drop("_seen").withColumn("_piece", F.col(key)), root, number, most)
    forget(done)
    repeats = sum(r["rows"] - r["keys"] for r in came.values())
    did |= {"ABSENT": state.rows - did["UPDATE"] - did["DUPLICATE"], "IN_FILE": repeats, "NO_KEY": no_key["rows"] if no_key else 0}
    for b, n in by_bucket.items():
        if b in state.base or b in state.added:
            state.added.setdefault(b, []).append(number)
            state.added_rows[b] = state.added_rows.get(b, 0) + n
        else:  # the first rows of a bucket are its base
            state.base[b], state.base_rows[b] = number, n
    state.number, state.batch, state.rows, state.did = number, batch, state.rows + did["INSERT"], did
    _publish(spark, root, state)
    if share is not None:
        compact(spark, root, share)
    return did


def compact(spark: SparkSession, root: str, share: float = 0.0, forget_before: int | None = None) -> list[int]:
    """Close the intervals of the buckets whose added rows exceed a share of their base and write them anew; those buckets.

    forget_before: intervals that ended at or before this batch are left out, in all buckets, and reading as of earlier batches ends.
    """
    state = manifest(spark, root)
    full = [b for b, n in state.added_rows.items() if forget_before is not None or n > share * state.base_rows.get(b, 0)]
    if forget_before is not None:
        full = sorted({*state.base, *state.added})
        state.oldest = max(state.oldest, min(forget_before, state.batch))
    if not full:
        return []
    parts = [(b, state.base[b]) for b in full] + [(b, n) for b in full for n in state.added.get(b, [])]
    rows = _closed(_files(spark, root, state, parts), state.key).where(F.col("_to").isNull() | (F.col("_to") > state.oldest))
    state.number += 1
    most = max(state.base_rows[b] + state.added_rows.get(b, 0) for b in full)
    _write(rows.withColumn("_piece", F.col(state.key)), root, state.number, most)
    written_rows = _files(spark, root, state, [(b, state.number) for b in full]).groupBy("_bucket").agg(F.count("*").alias("n")).collect()
    for r in written_rows:
        b = str(r["_bucket"])
        state.base[b], state.base_rows[b] = state.number, r["n"]
        state.added.pop(b, None)
        state.added_rows.pop(b, None)
    _publish(spark, root, state)
    return sorted(map(int, full))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete what only manifests before the newest `keep` name; how many folders went. Readers that began on an older state fail."""
    numbers = _numbers(spark, root)
    store, data = _store(spark, f"{root}/data")
    if not numbers or not store.exists(data):
        return 0
    kept = [Manifest(**json.loads(r[0])) for r in spark.read.text([f"{root}/_manifest/{n:012d}.json" for n in numbers[-keep:]], wholetext=True).collect()]
    needed = {(b, n) for m in kept for b, n in [*m.base.items(), *((b, n) for b, ns in m.added.items() for n in ns)]}
    gone = 0
    for part in store.listStatus(data):
        number = int(part.getPath().getName().removeprefix("number="))
        if number > numbers[-1]:
            continue  # a batch that is being written
        folders = [f.getPath() for f in store.listStatus(part.getPath()) if f.getPath().getName().startswith("_bucket=")]
        left = [f for f in folders if (f.getName().removeprefix("_bucket="), number) in needed]
        for f in folders:
            if f not in left:
                store.delete(f, True)
                gone += 1
        if not left:
            store.delete(part.getPath(), True)
    for n in numbers[:-keep]:
        store.delete(_store(spark, f"{root}/_manifest/{n:012d}.json")[1], False)
    return gone
