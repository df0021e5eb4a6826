"""Streams: sessions with timers, progress as a log, repeats and windows with late rows."""

import datetime
import time

from pyspark.sql import functions as F

from tallyfield.streaming import sessions, upserts

T0 = datetime.datetime(2026, 9, 18, 8, 0)
FILES = "user_id string, kind string, file_name string, at timestamp"


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def steps(spark, tmp_path, make, schema, *batches, mode="append"):
    """The rows that a stream gives for one folder of files after another."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode(mode).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        got.append(spark.read.schema(stream.schema).parquet(out).collect())
    return got


def test_sessions_open_complete_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = sessions.KINDS
    first = [("u", kinds[0], "b1", at(0)), ("u", kinds[0], "b2", at(1)), *[("v", k, k, at(1 + i / 10)) for i, k in enumerate(kinds)], ("w", kinds[1], "p", at(1))]
    late = [("u", kinds[2], "a", at(23)), ("x", kinds[0], "b", at(23.5))]
    day_after = [("x", kinds[1], "p", at(30)), ("w", kinds[1], "again", at(31))]
    last = [("z", kinds[0], "b", at(60))]
    try:
        all_rows = steps(spark, tmp_path, sessions.sessions, FILES, first, late, day_after, last)[-1]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda u: [(r["opened_at"], r["status"], r["waiting_for"], r["files"], r["replaced"]) for r in all_rows if r["user_id"] == u]
    assert (at(0), "WAITING", "PAYMENTS", 1, True) in of("u") and (at(0), "WAITING", "PAYMENTS", 2, False) in of("u")
    assert [r for r in of("u") if r[1] == "EXPIRED"] == [(at(0), "EXPIRED", None, 2, False)]
    assert [r[1] for r in of("v")].count("COMPLETE") == 1 and "EXPIRED" not in [r[1] for r in of("v")]
    # the file that came a day later began a session of its own
    assert {(r[0], r[1]) for r in of("w")} == {(at(1), "WAITING"), (at(1), "EXPIRED"), (at(31), "WAITING"), (at(31), "EXPIRED")}
    assert (at(23.5), "EXPIRED") in {(r[0], r[1]) for r in of("x")}


def test_progress_is_logged(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    listener = sessions.ProgressLog(spark, log)
    spark.streams.addListener(listener)
    try:
        steps(spark, tmp_path, lambda s: s.where("kind <> ''"), FILES, [("u", "BASKET", "b", at(0))] * 3, [("u", "BASKET", "b", at(1))] * 2)
        for _ in range(60):
            rows = spark.read.parquet(log).where("event = 'BATCH' and rows > 0").collect() if (tmp_path / "log").exists() else []
            if len(rows) == 2:
                break
            time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r["batch"], r["rows"]) for r in rows) == [(0, 3), (1, 2)]


def test_repeats_within_the_watermark(spark, tmp_path):
    rows = [("u", "BASKET", "b", at(0)), ("u", "BASKET", "b", at(0.1)), ("v", "BASKET", "b", at(0))]
    got = steps(spark, tmp_path, lambda s: upserts.exact_repeats_dropped(s, "at", ["user_id", "kind"]), FILES, rows, [("u", "BASKET", "b", at(1)), ("w", "BASKET", "b", at(1))])
    assert [sorted(r["user_id"] for r in step) for step in got] == [["u", "v"], ["u", "v", "w"]]


def test_windows_of_net_payments(spark, tmp_path):
    schema = "at timestamp, debit long, credit long"
    rows = [(at(0), 10, 0), (at(0.5), 5, 2), (at(1.2), 7, 0)]
    got = steps(spark, tmp_path, lambda s: upserts.windowed_net(s, "at", "1 hour", "10 minutes").select(F.col("window.start").alias("start"), "net", "legs"), schema, rows, [(at(9), 1, 0)], [(at(0.2), 99, 0), (at(20), 1, 0)])
    final = {(r["start"], r["net"], r["legs"]) for r in got[-1]}
    assert {(at(0), 13, 2), (at(1), 7, 1), (at(9), 1, 1)} == final  # the row of 99 came too late
