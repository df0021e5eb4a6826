"""Mixing sources to target weights with exact quotas of blocks.

A source's target in words is its weighted share, at most a fixed number of passes over
it. The words are drawn as blocks: whole passes first, then blocks of documents in
a permuted order until the target is met to the word. How many of a source's blocks each
output shard gets is decided by a splitting tree: at each node a multivariate-
hypergeometric draw parts the exact counts of all sources between the two halves, so
counts add up at every level and each shard is a random sample of the mix. Shards then
take disjoint runs of each source's permuted blocks, and order them by a hash of their own.

Sources are rows of a table, as many as there may be: they are numbered and given targets by aggregates.
The tree parts at most BUCKETS runs of sources; within a run, one task parts its shards' counts among its sources
by the same draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, identity, ranked, task_count, written

#: Weights by rank of the source, repeating; and the most passes over a source.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 1024
SHARDS = 16
#: Runs of sources that the tree's root sees at most.
BUCKETS = 1024
#: Rows that a cell of a distributed running sum holds on average.
CELL_ROWS = 500
_LOWEST = -(2**63)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n, drawn without replacement from good + bad, are good: one way for populations of any size.

    The distribution is inverted over twelve deviations on both sides of its mode, beyond which less than
    10**-30 of it lies; its ratios from one count to the next are exact to rounding.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 50 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=float)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(upto) - 1)


def drawn_counts(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """One multivariate draw of n from counts without replacement, kind by kind."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, own in enumerate(map(int, counts)):
        out[i] = hypergeometric(rng, own, rest - own, n)
        n, rest = n - int(out[i]), rest - own
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, kinds): how many blocks of each kind go to each shard; columns add up to quotas.

    The tree's nodes have seeds of their own, so any part of it can be drawn again alone.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def part(node: int, low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid = (low + high) // 2
        # both halves get their share of all blocks; a remainder goes left or right with the shards
        n = int(counts.sum()) * (mid - low) // (high - low)
        left = drawn_counts(np.random.default_rng([seed, node]), counts, n)
        part(2 * node + 1, low, mid, left)
        part(2 * node + 2, mid, high, counts - left)

    part(0, 0, shards, np.asarray(quotas, np.int64))
    return out


def word_count(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; null has none."""
    marks = F.regexp_replace(text.cast("string"), WORD, "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _running(rows: DataFrame, by: str, order: Column, amount: Column, name: str, count: str) -> DataFrame:
    """rows with the sum of amount over the rows before, within `by`, in the order of a hash; count: how many rows `by` has.

    The hash's top bits cut every group into cells of CELL_ROWS rows or so, however large it is. Cells are summed, and
    put in order in two steps, runs of cells and cells of a run, so neither rows nor cells of a hot group meet in one task.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col(count) / CELL_ROWS)).cast("long")
    # 31 bits of the hash, uniform and in its order
    place = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(_LOWEST)), 33)
    rows = rows.withColumn("_h", order).withColumn("_amount", amount)
    rows = rows.withColumn("_cell", F.shiftright(place * cells, 31))
    rows = rows.withColumn("_run", F.floor(F.col("_cell") / F.ceil(F.sqrt(cells))).cast("long"))
    upto = lambda *keys: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(by, "_run", "_cell").agg(F.sum("_amount").alias("_sum"))
    runs = sums.groupBy(by, "_run").agg(F.sum("_sum").alias("_sum")).select(by, "_run", upto(by, "_run").alias("_before_run"))
    firsts = sums.select(by, "_run", "_cell", upto(by, "_run", "_cell").alias("_before_cell")).join(runs, [by, "_run"])
    firsts = firsts.select(by, "_cell", (F.col("_before_run") + F.col("_before_cell")).alias("_first"))
    within = Window.partitionBy(by, "_cell").orderBy("_h", "doc_id", "key", "key2", "copy", "pass", "start")
    inside = F.coalesce(F.sum("_amount").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.withColumn(name, inside)
        .join(firsts, [by, "_cell"])
        .withColumn(name, F.col(name) + F.col("_first"))
        .drop("_h", "_run", "_cell", "_amount", "_first")
    )


def sizes(docs: DataFrame, *identified_by: str) -> DataFrame:
    """docs -> (doc_id, source, key, key2, size, copy): a row for every row; copy tells equal rows apart, from 1.

    key and key2 identify a row by the named columns, by default doc_id, source and text.
    """
    key, key2 = identity(docs, *(identified_by or ("doc_id", "source", "text")))
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), key2.alias("key2"), word_count(F.col("text")).alias("size")
    )
    once = rows.groupBy("doc_id", "source", "key", "key2", "size").count()
    return once.withColumn("copy", F.explode(F.expr("sequence(1L, count)"))).drop("count")


def _level(sources: DataFrame, passes: int) -> float:
    """The words for each unit of weight at which all sources together take as many words as they have.

    Each step shares what capped sources leave; the level rises and more sources are
    capped, until none is new. A step is one aggregate over the sources.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, -1
    while True:
        capped = F.col("source_size") * passes < F.lit(level) * F.col("weight")
        now = sources.where("source_size > 0").agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * passes)), F.lit(0)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if now["n"] == last:
            return level
        if not now["free"]:
            return float("inf")
        level, last = (total - now["full"]) / now["free"], now["n"]


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """sizes() -> (name, source_no, source_size, n, target, whole, rest), a row for each source.

    whole passes take all words of the source, and rest words of one more pass make up the target.
    """
    totals = written(sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    known = ranked(totals.where("name is not null"), "name", "source_no")
    numbered = known.unionByName(totals.where("name is null").withColumn("source_no", F.lit(known.count()).cast("long")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    numbered = written(numbered.withColumn("weight", weight), "sources")
    size, share = F.col("source_size"), F.lit(_level(numbered, passes)) * F.col("weight")
    target = F.when(size > 0, F.least((size * passes).cast("double"), share)).otherwise(0.0)
    whole = F.when(size > 0, F.least(F.floor(F.round("target") / size), F.lit(passes))).otherwise(0).cast("long")
    rows = numbered.withColumn("target", target).withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * size)
    return written(rows.drop("weight"), "targets")


def _shard_ends(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, ends): after how many of a source's blocks each shard's run of them ends."""
    quotas = written(blocks.groupBy("source_no").agg(F.count("*").alias("blocks")), "quotas")
    last = quotas.agg(F.max("source_no")).first()[0]
    every = -(-((last or 0) + 1) // BUCKETS)
    quotas = quotas.withColumn("bucket", F.floor(F.col("source_no") / every).cast("long"))
    found = sorted(quotas.groupBy("bucket").agg(F.sum("blocks").alias("blocks")).collect())  # BUCKETS rows at most
    split = split_quotas(np.array([r["blocks"] for r in found], np.int64), shards, seed)
    spark = blocks.sparkSession
    schema = "bucket long, counts array<long>"
    rows = [(r["bucket"], split[:, i].tolist()) for i, r in enumerate(found)]
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["bucket", "counts"]), schema)) if rows else spark.createDataFrame([], schema)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_no")
        left, ends = np.array(pdf["counts"].iloc[0], np.int64), []
        rng = np.random.default_rng([seed, 1, int(pdf["bucket"].iloc[0])])
        for n in pdf["blocks"]:
            own = drawn_counts(rng, left, int(n))
            left = left - own
            ends.append(np.cumsum(own))
        return pd.DataFrame({"source_no": pdf["source_no"], "ends": ends})

    return quotas.join(table, "bucket").groupBy("bucket").applyInPandas(part, "source_no long, ends array<long>")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    passes: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 42,
    identified_by: tuple[str, ...] = (),
) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the blocks of the mix, and a row without words for each row of docs.

    Columns: doc_id, source, size, source_size, target, key, key2, copy (rows of docs that are
    equal in all of doc_id, source and text, or in the columns of identified_by, are numbered from 1), pass (from 0),
    start and words (the block's place in the document), shard, place (the order within the shard). Rows of
    documents as such have words 0 and nulls in pass, start, shard and place.

    Sources are ranked by code point, null last, and weigh as `weights` says, repeating. Each
    source's words come within one word of its target; a document's words are taken at most
    `passes` times. Null and empty texts have size 0 and no block. Very long texts give
    many blocks. Everything is decided by hashes of the rows and the seed, so reruns agree; ties of a hash
    go by doc_id. Repeated rows take part as often as they occur. An empty table gives an empty result. Other columns
    are not looked at, whatever their names.
    """
    sized = written(sizes(docs, *identified_by), "sizes")
    drawn = sized.join(targets(sized, weights, passes), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    order = F.xxhash64(F.lit(seed), "doc_id", "key", "copy")
    placed = _running(
        drawn.withColumn("pass", F.lit(0)).withColumn("start", F.lit(0)), "source_no", order, F.col("size"), "before", "n"
    ).drop("pass", "start")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    columns = ["doc_id", "source", "size", "source_size", "target", "source_no", "key", "key2", "copy"]
    takes = placed.select(*columns, F.explode(F.expr(f"sequence(0L, {passes - 1}L)")).alias("pass"), "whole", last.alias("last"))
    taken = F.when(F.col("pass") < F.col("whole"), F.col("size")).when(F.col("pass") == F.col("whole"), F.col("last")).otherwise(0)
    takes = takes.withColumn("taken", taken).where("taken > 0").drop("whole", "last")
    starts = F.expr(f"sequence(0L, taken - 1, {block_words}L)")
    blocks = takes.withColumn("start", F.explode(starts))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words), F.col("taken") - F.col("start"))).drop("taken")
    blocks = written(blocks, "blocks")
    deal = F.xxhash64(F.lit(seed + 1), "doc_id", "key", "copy", "pass", "start")
    counted = blocks.join(blocks.groupBy("source_no").agg(F.count("*").alias("_blocks")), "source_no")
    numbered = _running(counted, "source_no", deal, F.lit(1), "rank", "_blocks")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    dealt = numbered.join(_shard_ends(blocks, shards, seed), "source_no").select(
        *columns, "pass", "start", "words",
        shard.alias("shard"),
        F.xxhash64(F.lit(seed + 2), "doc_id", "key", "copy", "pass", "start").alias("place"),
    )
    bare = drawn.select(
        *columns, *[F.lit(None).cast(t).alias(n) for n, t in (("pass", "long"), ("start", "long"))],
        F.lit(0).cast("long").alias("words"), *[F.lit(None).cast(t).alias(n) for n, t in (("shard", "int"), ("place", "long"))],
    )
    return dealt.union(bare).drop("source_no")


def shares(blocks: DataFrame) -> DataFrame:
    """mixed() -> doc_id, size, source_size, target, taken; one row for every row of the documents."""
    return (
        blocks.groupBy("doc_id", "source", "key", "key2", "copy")
        .agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], F.sum("words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """docs as the mix takes them: a row for every pass that takes words of a document, other columns unchanged.

    A text of which a pass takes a part is cut after its last word taken; one document of
    a source at most is. Documents that the mix doesn't take go, those with null or empty texts among them. Rows are told
    apart by all their columns, so rows that differ in any of them are mixed each with its own, and
    rows that repeat come as often as they are taken. Very long texts come whole. Columns may have any
    names. An empty table gives an empty result.

    Rows are dealt out by shard and the leading bits of the place, and stand in the order of shards and places
    within every partition.
    """
    names = {c: f"_tallyfield_{c}" for c in ("key", "key2", "copy", "pass", "taken", "size", "shard", "place")}
    blocks = mixed(docs, identified_by=tuple(docs.columns), **options).where("words > 0")
    takes = blocks.groupBy("key", "key2", "copy", "pass").agg(
        F.sum("words").alias("taken"), F.max("size").alias("size"), F.min("shard").alias("shard"), F.min("place").alias("place")
    )
    key, key2 = identity(docs)
    # rows equal in all columns are one row here; their copies come back with the takes
    once = docs.withColumns({names["key"]: key, names["key2"]: key2}).dropDuplicates([names["key"], names["key2"]])
    out = once.join(takes.withColumnsRenamed(names), [names["key"], names["key2"]])
    taken = F.col(names["taken"])
    words = F.regexp_extract_all("text", F.lit(rf"(?s)([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    part = F.array_join(F.slice(words, F.lit(1), taken.cast("int")), "")
    out = out.withColumn("text", F.when(taken < F.col(names["size"]), part).otherwise(F.col("text")))
    bits = max(1, task_count(docs.sparkSession) - 1).bit_length()
    lead = F.shiftrightunsigned(F.col(names["place"]).bitwiseXOR(F.lit(_LOWEST)), 64 - bits)
    out = out.withColumn("_tallyfield_lead", lead).repartition(names["shard"], "_tallyfield_lead")
    out = out.sortWithinPartitions(*[names[c] for c in ("shard", "place", "key", "key2", "copy", "pass")])
    return out.select(*[f"`{c}`" for c in docs.columns])
