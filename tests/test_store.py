"""Stored tables, the stream over them, and small operators."""

import pytest
from pyspark.sql import functions as F

from tallyfield.config import EngineConfig
from tallyfield.operators import quality as Q
from tallyfield.operators import relational as R
from tallyfield.operators import store
from tallyfield.streaming import upserts

SCHEMA = "natural_key string, fingerprint string, note string, source_row long"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upsert_counts_and_values(spark):
    empty = frame(spark).withColumns({"first_batch_id": F.lit(0), "last_batch_id": F.lit(0)}).limit(0)
    one, _ = store.upsert(frame(spark, ("a", "1", "x", 1), ("b", "1", "x", 2), ("b", "9", "later", 3)), empty, 1, F.col("source_row"))
    two, did = store.upsert(frame(spark, ("a", "1", "stale", 1), ("b", "2", "new", 2), ("c", "1", "x", 3)), one, 2, F.col("source_row"))
    assert {r["action"]: r["n"] for r in did.collect()} == {"DUPLICATE": 1, "UPDATE": 1, "INSERT": 1, "IN_FILE": 0}
    rows = {r["natural_key"]: (r["note"], r["first_batch_id"], r["last_batch_id"]) for r in two.collect()}
    # an equal fingerprint keeps what is stored
    assert rows == {"a": ("x", 1, 2), "b": ("new", 1, 2), "c": ("x", 2, 2)}
    assert store.as_of(two, 1).count() == 2 and store.snapshot(two, 2).count() == 3


def test_versions_are_published_whole(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert store.read(spark, root) is None
    store.publish(spark.range(1), root, 1)
    store.publish(spark.range(5), root, 2)
    assert [store.read(spark, root, v).count() for v in (1, 2, 9)] == [1, 5, 5]
    with pytest.raises(ValueError, match="exists"):
        store.publish(spark.range(1), root, 2)


def test_stream_upserts(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/table"
    frame(spark, ("a", "1", "x", 1), ("b", "1", "x", 2)).coalesce(1).write.parquet(source)
    run = lambda: (
        upserts.upsert_into(upserts.incoming(spark, source, SCHEMA), root, F.col("source_row"), f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    )
    assert run()
    frame(spark, ("b", "2", "y", 1), ("c", "1", "z", 2)).coalesce(1).write.mode("append").parquet(source)
    assert run() and run()
    rows = {r["natural_key"]: (r["note"], r["first_batch_id"], r["last_batch_id"]) for r in store.read(spark, root).collect()}
    assert rows == {"a": ("x", 1, 1), "b": ("y", 1, 2), "c": ("z", 2, 2)}


def test_current_files_pass_over_failed_batches(spark):
    batches = spark.createDataFrame([(1, "COMPLETED"), (2, "ERROR"), (3, "COMPLETED"), (4, "COMPLETED")], "batch_id long, status string")
    files = spark.createDataFrame([("b", 1, "b1"), ("b", 2, "b2"), ("p", 3, "p3"), ("b", 4, "b4")], "file_type string, batch_id long, file_name string")
    got = {tuple(r) for r in store.current_files(files, batches, 3).collect()}
    assert got == {("b", 1, "b1"), ("p", 3, "p3")}


def test_unseen_files(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "path string, content binary")
    first = store.unseen_files(files, spark.createDataFrame([], "source_hash string"))
    assert sorted(r["path"] for r in first.collect()) == ["a", "c"]
    assert store.unseen_files(files, first).count() == 0


def test_dimension_keeps_the_newest(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "k int, name string, at int")
    stored = spark.createDataFrame([(1, "older"), (9, "kept")], "k int, name string")
    assert sorted(tuple(r) for r in store.dimension(rows, stored, "k", ["name"], F.col("at")).collect()) == [(1, "new"), (2, "x"), (9, "kept")]


def test_first_of_each_and_marks(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 1, "z"), (None, 1, "n"), (None, 2, "m")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in R.first_of_each(rows, ["k"], ["o"]).collect()} == {("a", None), ("b", "z"), (None, "n")}
    assert {(r["k"], r["v"]) for r in R.last_of_each(rows, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z"), (None, "m")}
    assert R.mark_repeats(rows, ["k"], ["o"]).where("is_duplicate").count() == 2


def test_null_rules(spark):
    rows = spark.createDataFrame([(1, None), (2, -1), (3, 5)], "id int, x int")
    found = Q.issues(rows, [Q.Rule("RED", "NEGATIVE", F.col("x") < 0), Q.Rule("INFO", "MISSING", F.col("x").isNull())], "T", F.col("id"), F.col("id"))
    assert sorted((r["row"], r["code"]) for r in found.collect()) == [(1, "MISSING"), (2, "NEGATIVE")]
    assert Q.overall(found).first()["status"] == "RED"
    assert Q.overall(found.where("false")).first()["status"] == "GREEN"


def test_weighted_mean_and_distribution(spark):
    rows = spark.createDataFrame([(10.0, 2.0, "a"), (5.0, None, None), (None, 3.0, "a")], "a double, b double, g string")
    assert rows.agg(R.weighted_mean(F.col("a"), F.col("b")).alias("m")).first()["m"] == 5.0
    assert rows.where("false").agg(R.weighted_mean(F.col("a"), F.col("b")).alias("m")).first()["m"] is None
    assert {(r["value"], r["n"]) for r in R.distribution(rows, F.col("g"), "none").collect()} == {("a", 2), ("none", 1)}


def test_config_is_checked():
    with pytest.raises(ValueError):
        EngineConfig(refresh_minutes=45)
    with pytest.raises(ValueError):
        EngineConfig(weight_column="moon")


def test_a_version_is_done_again_under_its_number(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    store.publish(spark.range(3), root, 1)
    store.publish(spark.range(5), root, 2)
    with pytest.raises(ValueError, match="exists"):
        store.publish(spark.range(1), root, 2)
    before = store.read(spark, root)
    store.publish(spark.range(9), root, 2, replace=True)
    assert store.versions(spark, root) == [1, 2]
    assert before.count() == 5  # who read before goes on
    assert [store.read(spark, root, v).count() for v in (1, 2)] == [3, 9]
    assert store.read(spark, root, 0) is None


def test_log_grows_and_reset_keeps_what_is_asked(spark, tmp_path):
    log = f"file://{tmp_path}/all/log"
    for n in (1, 2):
        store.append_log(spark.createDataFrame([(f"file {n}", "ok")], "name string, status string"), log)
    assert sorted(r["name"] for r in spark.read.parquet(log).collect()) == ["file 1", "file 2"]
    store.publish(spark.range(3), f"file://{tmp_path}/all/settings", 1)
    assert store.reset(spark, f"file://{tmp_path}/all", keep=("settings",)) == ["log"]
    assert store.read(spark, f"file://{tmp_path}/all/settings").count() == 3
    assert store.reset(spark, f"file://{tmp_path}/none") == []


def test_directory_is_saved_and_read(spark, tmp_path):
    entries = spark.createDataFrame([(2, "B", None), (1, "A", "11")], "ord long, display_name string, tax_id string")
    store.publish(entries, f"file://{tmp_path}/directory", 1)
    assert [r["display_name"] for r in store.read(spark, f"file://{tmp_path}/directory").orderBy("ord").collect()] == ["A", "B"]


def test_newest_of_a_history(spark):
    rows = spark.range(20).withColumnRenamed("id", "n")
    assert [r["n"] for r in store.retention(rows, 3, rows.n.desc()).collect()] == [19, 18, 17]
