"""Sharding by a k-d tree over document metadata, in DataFrame functions alone.

Equal texts form a group; groups are the points of the tree, weighted by their bytes. A
node is cut at the weighted median along its widest dimension, all nodes of a level
at once, until a leaf has the target bytes. A median is found digit by digit:
each step sums bytes by the next fifteen bits of the sort key, so it moves sums and no
rows. Ties on a dimension are ordered by the hash of the text, so a dimension with
few values still divides evenly.

Groups that are heavy for a node, five hundred at most, are parted at their own weighted median; the light points of the node are
then cut where both sides come out even. Groups are parted only where no tree of whole groups comes near the law of equal bytes.
The tree itself is a table with a row for each node, so nothing about it passes through the driver.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import forget, ranked, task_count, text_of, written

#: A group above this share of a node's bytes is heavy there; parts of a group that is dealt out have this share of a shard's.
HEAVY, PART = 0.002, 0.01
#: Shards may differ from their mean by this share before groups of several rows are parted.
NEAR = 0.02
#: Sort keys: bits of the dimension, then bits of the hash; together a multiple of DIGIT.
CODE_BITS, HASH_BITS, DIGIT = 20, 40, 15
#: A median is close enough when the digit that holds it weighs at most this share of its node.
CLOSE = 0.0005
#: A table of at most so many nodes, a hundred bytes each, is broadcast; beyond it there are as many keys, and it is joined as any other.
SMALL_TREE = 50_000


def _nodes(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if most <= SMALL_TREE else table


def _ranks(docs: DataFrame, column: str) -> DataFrame:
    """(value, rank): the place of every distinct value of a text column by code point, from 0."""
    values = docs.select(F.col(f"`{column}`").cast("string").alias("value")).where("value is not null").distinct()
    return ranked(values, "value", "rank")


def _points(rows: DataFrame, names: list[str], share: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """rows -> (rows with their part, points): a point for each group, or for each part of one of several rows above the limit."""
    weights = rows.groupBy("key", "key2").agg(F.sum("size").alias("all"), F.count("*").alias("n")).where((F.col("all") > limit) & (F.col("n") > 1))
    parts = weights.select("key", "key2", F.ceil(F.col("all") / max(1, int(PART * share))).alias("parts"))
    dealt = rows.join(parts, ["key", "key2"], "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("long")
    )
    points = dealt.groupBy("key", "key2", "part").agg(F.sum("size").alias("weight"), *[F.min(n).alias(n) for n in names])
    return dealt.drop("parts"), points


def _coded(points: DataFrame, names: list[str]) -> DataFrame:
    """Sort keys in place of coordinates: the place in the dimension's whole range, then the hash."""
    ends = points.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    hashed = F.shiftrightunsigned(F.xxhash64("key", "key2", "part", F.lit(7)), 64 - HASH_BITS)
    keys = []
    for n in names:
        low, high = ends[f"min_{n}"], ends[f"max_{n}"]
        share = (F.col(n) - low) / (high - low) if low is not None and high > low else F.lit(0.0)
        code = F.floor(share * (2**CODE_BITS - 1)).cast("long")
        keys.append((F.shiftleft(code, HASH_BITS) + hashed).alias(n))
    return points.select("key", "key2", "part", "weight", *keys)


def _at(names: list[str]) -> Column:
    return F.element_at(F.array(*names), F.col("dim") + 1)


def _is_heavy() -> Column:
    return F.col("weight") > F.col("all") * HEAVY


def _states(points: DataFrame, names: list[str], nodes: DataFrame, most: int) -> DataFrame:
    """(node, dim, all, heavy_cut, want) for nodes of several shards: the widest dimension, where heavy points part, and what light ones add on the left.

    nodes: node, first (shard), n (shards); the left side gets its share of the
    node's bytes, half of them where the number is even.
    """
    code = lambda c: F.shiftright(c, HASH_BITS)
    widths = [(F.max(code(n)) - F.min(code(n))).alias(n) for n in names]
    inner = nodes.where("n > 1")
    found = points.join(_nodes(inner.select("node"), most), "node").groupBy("node").agg(F.sum("weight").alias("all"), *widths)
    wide = (F.array_position(F.array(*names), F.array_max(F.array(*names))) - 1).cast("int")
    share = lambda c: F.expr(f"({c} div n) * (n div 2) + (({c} % n) * (n div 2)) div n")
    state = written(found.join(_nodes(inner, most), "node").select("node", "n", wide.alias("dim"), "all", share("`all`").alias("want")), "nodes")
    heavy = points.join(_nodes(state, most), "node").where(_is_heavy()).select("node", "n", "weight", _at(names).alias("at"))
    order = Window.partitionBy("node").orderBy("at")  # 1 / HEAVY rows for each node at most
    run = heavy.withColumn("upto", F.sum("weight").over(order)).withColumn("sum", F.sum("weight").over(Window.partitionBy("node")))
    left = F.col("upto") - F.col("weight") / 2 <= share("`sum`")
    parted = run.groupBy("node").agg((F.max(F.when(left, F.col("at"))) + 1).alias("heavy_cut"), F.sum(F.when(left, F.col("weight"))).alias("taken"), F.max("sum").alias("heavy"))
    taken, light = F.coalesce("taken", F.lit(0)), F.col("all") - F.coalesce("heavy", F.lit(0))
    want = F.greatest(F.lit(0), F.least(light, F.col("want") - taken)).cast("long")
    return written(state.join(parted, "node", "left").select("node", "dim", "all", F.coalesce("heavy_cut", F.lit(0)).alias("heavy_cut"), want.alias("want")), "nodes")


def _cuts(points: DataFrame, names: list[str], state: DataFrame, most: int) -> DataFrame:
    """_states() with cut: the sort key of the dimension below which about `want` bytes of the node's light points lie.

    A node without light points has no cut. Each digit's sums are written, so a plan holds one digit.
    """
    zero = F.lit(0).cast("long")
    state = state.withColumns({"high": zero, "less": zero, "cut": F.lit(None).cast("long")})
    for shift in range(CODE_BITS + HASH_BITS - DIGIT, -1, -DIGIT):
        joined = points.join(_nodes(state.where("cut is null"), most), "node").where(~_is_heavy()).withColumn("at", _at(names))
        inside = joined.where(F.shiftright("at", shift + DIGIT) == F.col("high"))
        digit = F.shiftright("at", shift).bitwiseAND(2**DIGIT - 1).alias("digit")
        sums = inside.groupBy("node", "less", "want", digit).agg(F.sum("weight").alias("sum"))
        run = sums.withColumn("upto", F.col("less") + F.sum("sum").over(Window.partitionBy("node").orderBy("digit")))
        hit = run.where("upto >= want").groupBy("node").agg(F.min_by(F.struct("digit", "sum", "upto"), "digit").alias("x"))
        high, less = F.shiftleft("high", DIGIT) + F.col("x.digit"), F.col("x.upto") - F.col("x.sum")
        nearer = (F.col("x.upto") - F.col("want") <= F.col("want") - less).cast("long")
        close = (F.col("x.sum") <= CLOSE * F.col("all")) if shift else F.lit(True)
        cut = F.when(F.col("x").isNull() | close, F.coalesce(F.shiftleft(high + nearer, shift), zero))
        seen = Observation()
        state = state.join(hit, "node", "left").select(
            "node", "dim", "all", "heavy_cut", "want",
            F.coalesce(high, F.col("high")).alias("high"), F.coalesce(less, F.col("less")).alias("less"), F.coalesce("cut", cut).alias("cut"),
        )
        state = written(state.observe(seen, F.count(F.when(F.col("cut").isNull(), 1)).alias("open")), "medians")
        if not seen.get["open"]:
            break
    return state.select("node", "dim", "all", "heavy_cut", "cut")


def _leaves(points: DataFrame, names: list[str], shards: int) -> DataFrame:
    """(key, key2, part, shard) for every point."""
    zero = F.lit(0).cast("long")
    now = points.withColumn("node", zero)
    nodes = points.sparkSession.range(1).select(zero.alias("node"), zero.alias("first"), F.lit(shards).cast("long").alias("n"))
    for level in range((shards - 1).bit_length()):
        most = min(2 ** (level + 1), 2 * shards)
        cuts = _nodes(_cuts(now, names, _states(now, names, nodes, most), most), most)
        # a leaf goes on as the left child of its own
        left = F.col("dim").isNull() | (_at(names) < F.when(_is_heavy(), F.col("heavy_cut")).otherwise(F.col("cut")))
        now = now.join(cuts, "node", "left").withColumn("node", 2 * F.col("node") + F.when(left, 1).otherwise(2)).drop("dim", "all", "heavy_cut", "cut")
        half = F.floor(F.col("n") / 2)
        children = F.when(F.col("n") < 2, F.array(F.struct((2 * F.col("node") + 1).alias("node"), F.col("first").alias("first"), F.col("n").alias("n")))).otherwise(
            F.array(
                F.struct((2 * F.col("node") + 1).alias("node"), F.col("first").alias("first"), half.alias("n")),
                F.struct((2 * F.col("node") + 2).alias("node"), (F.col("first") + half).alias("first"), (F.col("n") - half).alias("n")),
            )
        )
        nodes = nodes.select(F.inline(children))
        # each level is read several times, and a plan that holds them all would broadcast all their cuts
        now, nodes = written(now, "points"), written(nodes, "nodes")
    return now.join(_nodes(nodes, 2 * shards), "node").select("key", "key2", "part", F.col("first").cast("int").alias("shard"))


def _placed(rows: DataFrame, names: list[str], shards: int) -> DataFrame:
    """rows with their shard. Groups are parted as little as the law of near equal bytes allows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // shards)
    several = rows.groupBy("key", "key2").agg(F.sum("size").alias("all"), F.count("*").alias("n")).where("n > 1").agg(F.max("all")).first()[0] or 0
    limit = share
    while True:
        dealt, points = _points(rows, names, share, limit)
        points = written(_coded(written(points, "points"), names), "points")
        leaves = _leaves(points, names, shards)
        placed = written(dealt.join(leaves, ["key", "key2", "part"]).select("row", "doc_id", "size", "text_crc32", "shard"), "placed")
        bytes_of = placed.groupBy("shard").agg(F.sum("size").alias("bytes"))
        apart = bytes_of.agg(F.max(F.abs(F.col("bytes") - share)), F.count("*")).first()
        even = (apart[0] or 0) <= NEAR * share and apart[1] == shards
        smaller = max(int(limit / 4), int(PART * share))
        if even or smaller >= limit or several <= smaller:
            return placed
        limit = smaller
        forget(placed)


def sharded(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, shard, slot; one row for every row of docs.

    size: UTF-8 bytes of the text and one more. Give the number of shards, or the
    bytes that a shard should reach. dimensions: numeric columns by name; by default
    the bytes on a log scale, and the ranks of lang and source among their values, where docs has them. Shards are
    numbered along the tree from 0, slots within a shard from 0 without a gap.

    Null and empty texts have size 1 and the checksum of no bytes. Null ids and null
    dimensions keep their rows; a null lies below all values. Equal texts stay in one shard, unless the bytes of
    shards would differ by more than NEAR with every group whole; then groups above a shard's bytes, or
    above a fourth, a sixteenth and so on of them, are dealt out row by row. A single row is never cut, however long. An empty
    table gives an empty result. Columns of other names are not looked at.
    """
    text = text_of()
    size = (F.octet_length(text) + 1).cast("long")
    given = docs
    dims = dict(dimensions or {"bytes": F.log2(F.octet_length(text) + F.lit(1.0))})
    if dimensions is None:
        for c in (c for c in ("lang", "source") if c in docs.columns):
            ranks = _ranks(docs, c).select(F.col("value").alias(f"_tallyfield_{c}_value"), F.col("rank").alias(f"_tallyfield_{c}"))
            given = given.join(ranks, F.col(f"`{c}`").cast("string") == F.col(f"_tallyfield_{c}_value"), "left")
            dims[c] = F.col(f"_tallyfield_{c}")
    axes = {f"axis{i}": c for i, c in enumerate(dims.values())}
    rows = written(
        given.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, size).alias("key"),
            F.xxhash64(F.lit(77), size, text).alias("key2"),
            *[F.coalesce(c.cast("double"), F.lit(-1.0)).alias(n) for n, c in axes.items()],
        ),
        "sizes",
    )
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = _placed(rows, list(axes), shards)
    cells = max(32, task_count(docs.sparkSession))
    in_cells = placed.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = in_cells.groupBy("shard", "cell").count().select(
        "shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "cell").orderBy("row")
    return (
        in_cells.withColumn("n", F.row_number().over(within))
        .join(firsts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
    )
