"""Sharding: the law of near equal bytes, numbering, and groups."""

import zlib

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import sharding

SF = "/root/testdata/sf0.1"


def check(df, rows, shards):
    texts = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == texts
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(shards))
    return {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)}


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_bytes_are_near_equal(spark, shards):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    weights = check(df, sharding.sharded(df, shards=shards).collect(), shards)
    mean = sum(weights.values()) / shards
    assert max(weights.values()) < 1.03 * mean and min(weights.values()) > 0.97 * mean


def test_target_bytes_settle_the_number(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.sharded(df, target_bytes=500_000).collect()
    total = sum(r["size"] for r in rows)
    weights = check(df, rows, -(-total // 500_000))
    assert max(weights.values()) <= 500_000 * 1.05
    with pytest.raises(ValueError, match="target_bytes"):
        sharding.sharded(df)


def split_groups(got):
    return got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()


def test_groups_stay_together_while_shards_can_be_even(docs):
    pairs = [(i, f"text number {i // 2} " * 5) for i in range(2000)]
    # three groups of a fourteenth of all bytes or so
    groups = [(10_000 + 1000 * k + i, f"the words of group {k} again and again") for k in range(3) for i in range(400)]
    got = sharding.sharded(docs(*pairs, *groups), shards=4)
    weights = check(docs(*pairs, *groups), got.collect(), 4)
    assert max(weights.values()) < 1.02 * sum(weights.values()) / 4
    assert split_groups(got) == 0


def test_a_group_above_a_shard_is_dealt_out(docs):
    rows = [(i, f"text number {i // 2} " * 5) for i in range(2000)] + [(10_000 + i, "the same words again and again " * 3) for i in range(1500)]
    got = sharding.sharded(docs(*rows), shards=4)
    weights = check(docs(*rows), got.collect(), 4)
    assert max(weights.values()) < 1.02 * sum(weights.values()) / 4
    assert split_groups(got) == 1


def plain_tree(points, shards):
    """points (weight, coordinates) -> shard of each, by recursive cuts at the weighted median of the widest dimension."""
    out = {}

    def part(some, first, n):
        if n == 1 or not some:
            out.update(dict.fromkeys(some, first))
            return
        width = [max(points[i][1][d] for i in some) - min(points[i][1][d] for i in some) for d in range(len(points[some[0]][1]))]
        dim = width.index(max(width))
        order = sorted(some, key=lambda i: points[i][1][dim])
        want, sums = sum(points[i][0] for i in some) * (n // 2) / n, [0]
        for i in order:
            sums.append(sums[-1] + points[i][0])
        cut = min(range(len(sums)), key=lambda k: abs(sums[k] - want))
        part(order[:cut], first, n // 2)
        part(order[cut:], first + n // 2, n - n // 2)

    part(list(range(len(points))), 0, shards)
    return [out[i] for i in range(len(points))]


def test_tree_against_a_plain_one(spark, docs):
    # distinct texts, coordinates far enough apart that no two share a code
    rows = [(i, f"{i:04d}") for i in range(900)]
    df = docs(*rows).withColumns({"x": (F.col("doc_id") * 37 % 901).cast("double"), "y": (F.col("doc_id") * 53 % 907).cast("double") * 0.9})
    got = {r["doc_id"]: r["shard"] for r in sharding.sharded(df, shards=8, dimensions={"x": F.col("x"), "y": F.col("y")}).collect()}
    xs, ys = [i * 37 % 901 for i in range(900)], [(i * 53 % 907) * 0.9 for i in range(900)]
    scale = lambda v, all_v: int((v - min(all_v)) / (max(all_v) - min(all_v)) * (2**20 - 1))
    wanted = plain_tree([(5, (scale(xs[i], xs), scale(ys[i], ys))) for i in range(900)], 8)
    assert sum(got[i] == wanted[i] for i in range(900)) >= 890


def test_sources_alike_in_their_first_bytes_are_told_apart(docs):
    ranks = sharding._ranks(docs(*[(i, "x", f"source_{i % 5}") for i in range(20)], (20, "x", None)), "source")
    assert sorted((r["value"], r["rank"]) for r in ranks.collect()) == [(f"source_{i}", i) for i in range(5)]


def test_odd_rows(odd):
    check(odd, sharding.sharded(odd, shards=8).collect(), 8)
    assert sharding.sharded(odd.limit(0), shards=8).count() == 0
