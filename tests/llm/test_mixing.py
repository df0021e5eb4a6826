"""Mixing: targets, the splitting tree, and whole mixes."""

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import mixing

SF = "/root/testdata/sf0.01"


def targets_of(sizes, weights, passes=3):
    """Targets that share the sum of all sizes by weight, none above passes times its own size."""
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(sum(sizes))
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if level * weights[i] > passes * sizes[i]}
        for i in full or free:
            out[i] = float(passes * sizes[i]) if full else level * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def found_targets(spark, sizes, weights=(5, 2, 1), passes=3):
    sized = spark.createDataFrame([(f"s{i:06d}", n) for i, n in enumerate(sizes)], "source string, size long")
    return [r["target"] for r in sorted(mixing.targets(sized, weights, passes).collect(), key=lambda r: r["source_no"])]


def test_targets_share_all_words(spark):
    assert found_targets(spark, [100, 100, 100]) == [187.5, 75.0, 37.5]
    assert found_targets(spark, [10, 1000, 0]) == [30.0, 980.0, 0.0]
    assert found_targets(spark, [0]) == [0.0] and found_targets(spark, []) == []
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in np.exp(rng.normal(8, 3, 3000))]
    assert np.allclose(found_targets(spark, sizes), targets_of(sizes, [(5, 2, 1)[i % 3] for i in range(3000)]), rtol=1e-9)
    assert found_targets(spark, [10, 20], passes=1) == [10.0, 20.0]


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(4)
    draws = np.array([mixing.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    wanted = rng.hypergeometric(30, 70, 20, 20_000)
    assert abs(draws.mean() - 6) < 0.05 and abs(draws.var() - wanted.var()) < 0.15
    assert [mixing.hypergeometric(rng, *x) for x in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (4, 4, 0))] == [3, 0, 4, 0]
    # across the sizes at which other samplers change their way
    for total in (10**9 - 2, 10**9 + 2, 4 * 10**10):
        good, n = total // 3, total // 2
        sd = (n * (1 / 3) * (2 / 3) * (1 / 2)) ** 0.5
        z = (np.array([mixing.hypergeometric(rng, good, total - good, n) for _ in range(40)]) - n * good / total) / sd
        assert abs(z.mean()) < 0.6 and 0.5 < z.std() < 1.6


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 0, 37, 5, 2_000_000_000])
    parts = mixing.split_quotas(quotas, 7, 1)
    assert (parts.sum(0) == quotas).all() and (parts >= 0).all()
    total = parts.sum(1)
    assert total.max() - total.min() <= 7
    assert (parts == mixing.split_quotas(quotas, 7, 1)).all() and (parts != mixing.split_quotas(quotas, 7, 2)).any()
    assert abs(parts[:, 0] - 1000 / 7).max() < 1000


def check(df, **options):
    blocks = mixing.mixed(df, **options).cache()
    shares = mixing.shares(blocks).collect()
    texts = [(r["doc_id"], r["source"], len([w for w in (r["text"] or "").encode().split()])) for r in df.collect()]
    assert sorted((str(r["doc_id"]), r["size"]) for r in shares) == sorted((str(d), n) for d, _, n in texts)
    sources = sorted({s for _, s, _ in texts}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, s, n in texts if s == name) for name in sources]
    targets = targets_of(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    taken = {}
    for r in blocks.where("words > 0").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
    for name, target in zip(sources, targets, strict=True):
        assert abs(taken.get(name, 0) - target) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in shares)
    return blocks, shares


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    blocks, shares = check(df, block_words=100)
    again = mixing.shares(mixing.mixed(df.repartition(7), block_words=100)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, again)) == sorted(map(key, shares))
    drawn = blocks.where("words > 0")
    per = [r["count"] for r in drawn.groupBy("shard").count().collect()]
    assert len(per) == mixing.SHARDS and max(per) - min(per) <= mixing.SHARDS
    # no block is drawn twice
    assert drawn.select("doc_id", "key", "copy", "pass", "start").distinct().count() == drawn.count()


def test_odd_rows(odd):
    check(odd)
    assert mixing.mixed(odd.limit(0)).count() == 0
    documents = mixing.mixed_documents(odd)
    assert documents.columns == odd.columns
    taken = {}
    for r in mixing.shares(mixing.mixed(odd, identified_by=tuple(odd.columns))).collect():
        taken[str(r["doc_id"])] = taken.get(str(r["doc_id"]), 0) + r["taken"]
    words = {}
    for r in documents.collect():
        words[str(r["doc_id"])] = words.get(str(r["doc_id"]), 0) + len((r["text"] or "").split())
    assert words == {k: v for k, v in taken.items() if v}


def test_rows_that_differ_in_other_columns_keep_them(docs):
    both = docs((1, "a b c d"), (2, "x y")).unionByName(docs((1, "a b c d"), lang="fr"))
    got = mixing.mixed_documents(both, passes=1).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(1, "en"), (1, "fr"), (2, "en")]


def test_many_sources_share_the_tree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    check(docs(*[(i, "w " * (i % 50 + 1), f"s{i % 37}") for i in range(200)]), block_words=5)


def test_hot_source_in_many_cells(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    check(docs(*[(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]), block_words=4)


def test_documents_come_as_often_as_taken(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = {r["doc_id"]: r["taken"] for r in mixing.shares(mixing.mixed(df, identified_by=tuple(df.columns))).collect()}
    got = {}
    for r in mixing.mixed_documents(df).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert got == {k: v for k, v in wanted.items() if v}


def test_documents_stand_in_order_of_shards_and_places(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    takes = {}
    for r in mixing.mixed(df, identified_by=tuple(df.columns)).where("words > 0").collect():
        takes.setdefault((r["doc_id"], r["copy"], r["pass"]), []).append((r["shard"], r["place"]))
    first = {}
    for (doc, _, _), t in takes.items():
        first.setdefault(doc, []).append((min(s for s, _ in t), min(p for _, p in t)))
    parts = mixing.mixed_documents(df).select("doc_id", F.spark_partition_id().alias("part")).collect()
    for part in {r["part"] for r in parts}:
        ids = [r["doc_id"] for r in parts if r["part"] == part]
        order, at = [], (-1, -(2**63))
        for doc in ids:  # each is a take that does not stand before the last one
            at = min(x for x in first[doc] if x >= at)
            order.append(at)
        assert order == sorted(order)
