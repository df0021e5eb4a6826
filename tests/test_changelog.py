"""Change logs: merges against the whole-table upsert, bytes written, as-of reads, compaction, replays."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import changelog, store
from tallyfield.streaming import upserts

SCHEMA = "natural_key string, fingerprint string, note string, source_row long"
ORDER = "source_row"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted(tuple(r) for r in df.select("natural_key", "fingerprint", "note", "source_row", "first_batch_id", "last_batch_id").collect())


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def batches(seed=1, n=6):
    rng = random.Random(seed)
    return [[(f"k{rng.randrange(40)}", str(rng.randrange(3)), f"b{b}", i) for i in range(rng.choice([0, 5, 30, 60]))] for b in range(1, n + 1)]


@pytest.mark.parametrize("share", [None, 0.0, 0.5])
def test_merges_equal_the_upsert_of_whole_tables(spark, tmp_path, share):
    root, states = f"file://{tmp_path}/t", {}
    whole = frame(spark, []).withColumns({"first_batch_id": F.lit(0), "last_batch_id": F.lit(0)})
    for b, rows in enumerate(batches(), 1):
        whole, did = store.upsert(frame(spark, rows), whole, b, ORDER)
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        got = changelog.merge(frame(spark, rows), root, b, ORDER, buckets=4, share=share)
        want = {r["action"]: r["n"] for r in did.collect()}
        assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
        states[b] = shown(whole)
        for past, rows_then in states.items():  # every earlier batch reads as it was
            assert shown(changelog.read(spark, root, past)) == rows_then
    assert shown(changelog.snapshot(spark, root, 4)) == [r for r in states[4] if r[5] == 4]


def test_a_small_batch_writes_little(spark, tmp_path):
    root, folder = f"file://{tmp_path}/t", f"{tmp_path}/t"
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("natural_key"), F.lit("1").alias("fingerprint"), F.sha2(F.concat(F.lit("n"), "id"), 256).alias("note"), F.col("id").alias("source_row"))
    changelog.merge(rows, root, 1, ORDER, buckets=8)
    first = size(folder)
    one = rows.where("source_row % 100 = 0").withColumn("fingerprint", F.lit("2"))
    assert changelog.merge(one, root, 2, ORDER)["UPDATE"] == 2000
    assert size(folder) - first < 0.02 * first
    assert changelog.read(spark, root).count() == 200_000 and changelog.read(spark, root).where("fingerprint = '2'").count() == 2000
    assert changelog.read(spark, root, 1).where("fingerprint = '2'").count() == 0


def test_compaction_by_bucket_history_and_vacuum(spark, tmp_path):
    root, folder = f"file://{tmp_path}/t", f"{tmp_path}/t"
    keys = [(f"k{i}", "1", "x", i) for i in range(50)]
    changelog.merge(frame(spark, keys), root, 1, ORDER, buckets=4, share=None)
    changelog.merge(frame(spark, [("k7", "2", "y", 1)]), root, 2, ORDER, share=None)
    changelog.merge(frame(spark, [("k7", "3", "z", 1)]), root, 3, ORDER, share=None)
    done = changelog.compact(spark, root)
    assert len(done) == 1  # only the bucket that has changed
    assert [(r["_from"], r["_to"]) for r in changelog.history(spark, root).where("natural_key = 'k7'").orderBy("_from").collect()] == [(1, 2), (2, 3), (3, None)]
    before, want = size(folder), [shown(changelog.read(spark, root, b)) for b in (1, 2, 3)]
    assert changelog.vacuum(spark, root, keep=1) == 3 and size(folder) < before
    assert [shown(changelog.read(spark, root, b)) for b in (1, 2, 3)] == want
    changelog.compact(spark, root, forget_before=3)
    assert shown(changelog.read(spark, root)) == want[2] and changelog.history(spark, root).count() == 50
    with pytest.raises(ValueError, match="remembers"):
        changelog.read(spark, root, 2)


def test_odd_batches(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert changelog.read(spark, root) is None and changelog.vacuum(spark, root) == 0
    assert changelog.merge(frame(spark, []), root, 1, ORDER, buckets=3)["INSERT"] == 0
    assert changelog.read(spark, root).count() == 0
    rows = [(None, "1", "x", 1), (None, "2", "x", 2), ("", None, None, 3), ("a", None, "y", 4)]
    did = changelog.merge(frame(spark, rows), root, 2, ORDER)
    assert (did["INSERT"], did["NO_KEY"], did["IN_FILE"]) == (2, 2, 0)
    assert changelog.merge(frame(spark, rows), root, 2, ORDER) == did  # again: nothing happens
    assert changelog.merge(frame(spark, [("a", None, "z", 1)]), root, 3, ORDER)["DUPLICATE"] == 1
    assert [r["note"] for r in changelog.read(spark, root).where("natural_key = 'a'").collect()] == ["y"]
    with pytest.raises(ValueError, match="comes after"):
        changelog.merge(frame(spark, rows), root, 1, ORDER)
    with pytest.raises(ValueError, match="holds"):
        changelog.merge(frame(spark, rows).drop("note"), root, 4, ORDER)
    with pytest.raises(ValueError, match="uses itself"):
        changelog.merge(frame(spark, rows).withColumn("_from", F.lit(1)), root, 4, ORDER)


def test_a_batch_that_failed_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    changelog.merge(frame(spark, [("a", "1", "x", 1)]), root, 1, ORDER, buckets=2)
    # files without a manifest, as a writer that was lost leaves them
    state = changelog.manifest(spark, root)
    spark.range(1).write.parquet(f"{root}/data/number={state.number + 1}/_bucket=0")
    assert changelog.read(spark, root).count() == 1
    changelog.merge(frame(spark, [("b", "1", "x", 1)]), root, 2, ORDER)
    assert [r[0] for r in shown(changelog.read(spark, root))] == ["a", "b"]


def test_stream_merges(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/table"
    frame(spark, [("a", "1", "x", 1), ("b", "1", "x", 2)]).coalesce(1).write.parquet(source)
    run = lambda: upserts.merge_into(upserts.incoming(spark, source, SCHEMA), root, ORDER, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    frame(spark, [("b", "2", "y", 1), ("c", "1", "z", 2)]).coalesce(1).write.mode("append").parquet(source)
    assert run() and run()
    assert [(r[0], r[2], r[4], r[5]) for r in shown(changelog.read(spark, root))] == [("a", "x", 1, 1), ("b", "y", 1, 2), ("c", "z", 2, 2)]
    assert [r[0] for r in shown(changelog.read(spark, root, 1))] == ["a", "b"]


def test_an_import_done_again_replaces_its_partition(spark, tmp_path):
    root, folder = f"file://{tmp_path}/t", f"{tmp_path}/t"
    for n in range(1, 6):
        store.write_import(spark.range(n), root, n)
    files = lambda: {p: os.listdir(f"{folder}/{p}") for p in os.listdir(folder) if p.startswith("import_id")}
    before = files()
    store.write_import(spark.range(40), root, 3)
    after = files()
    assert [p for p in before if before[p] != after[p]] == ["import_id=3"]
    assert [store.read_import(spark, root, n).count() for n in (2, 3)] == [2, 40]
    plan = store.read_import(spark, root, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(import_id" in plan
