"""Secret scans: spans by pattern, judged by how many owners hold the same value.

Every match of a base pattern is a span. Besides them, long mixed-case tokens with digits
are candidates: a candidate becomes a span of its own only when the whole corpus shows
it in the hands of few owners. The same count separates base spans that look
live from examples that are copied widely.

All of it is DataFrame functions: a pattern is matched together with the gap before
it, so the lengths of gaps and matches give every position without a UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identity, text_of, written

#: The kinds in the order in which they are listed, and their patterns.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
TOKEN = r"([A-Za-z0-9_-]{24,})"
KINDS = ("assign", "access", "hex", "owned")
#: Shortest value of an assignment.
LEAST_ASSIGNED = 12
#: A value that more owners or repositories than these hold is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 4
#: Characters of a text that are masked at a time, so that a text with many spans is not copied once for each.
BLOCK = 4096
#: What stands in the place of a span in redacted().
MASKS = {True: "<secret>", False: "<example>"}


def either_case(word: str) -> str:
    """A pattern for the ASCII letters of word in either case, alike in every regex dialect."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"(?:{'|'.join(map(either_case, WORDS))}){ASSIGNED}"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))


def _found(text: Column, pattern: str) -> Column:
    """Every match, in order, as (gap: characters since the last match, size, value: a digest, shape)."""
    # `$` would also match before a last line break
    with_gap = F.lit(rf"(?s)(.*?)(?:{pattern}|\z)")
    whole, gap, value = (F.regexp_extract_all(text, with_gap, F.lit(g)) for g in range(3))
    found = F.transform(
        F.arrays_zip(whole.alias("w"), gap.alias("g"), value.alias("v")),
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"),
            (F.length(x["w"]) - F.length(x["g"])).alias("size"),
            F.length(x["v"]).alias("chars"),
            F.sha2(x["v"], 256).alias("value"),
            (x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]")).alias("mixed"),
            (~x["v"].rlike(r"(?i)example|sample|xxxx|0000|1234567|(.)\1{5}")).alias("live"),
        ),
    )
    return F.when(text.rlike(pattern), found)


def _rows(docs: DataFrame, owner: list[str], repository: list[str], **more: Column) -> DataFrame:
    """docs without texts: a number for each row, doc_id, who holds it, and what each pattern found."""
    text = text_of()
    held = [F.xxhash64(*[F.col(f"`{c}`").isNull() for c in k], *[F.col(f"`{c}`") for c in k]) for k in (owner, repository)]
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        held[0].alias("owner"),
        held[1].alias("repository"),
        *[c.alias(name) for name, c in more.items()],
        *[_found(text, p).alias(kind) for kind, p in PATTERNS.items()],
    )


def _spans(rows: DataFrame) -> DataFrame:
    """rows -> (row, owner, repository, no, start, end, value, live), base spans and candidates alike."""
    each = None
    for no, kind in enumerate(KINDS):
        one = rows.where(F.size(kind) > 0).select("row", "owner", "repository", F.lit(no).alias("no"), F.posexplode(kind))
        each = one if each is None else each.union(one)
    before = Window.partitionBy("row", "no").orderBy("pos")
    placed = each.withColumn("end", F.sum(F.col("col.gap") + F.col("col.size")).over(before))
    found = placed.select(
        "row", "owner", "repository", "no",
        (F.col("end") - F.col("col.size")).alias("start"), "end", "col.chars", "col.value", "col.mixed", "col.live",
    ).where("chars > 0")
    enough = F.when(F.col("no") == 0, F.col("chars") >= LEAST_ASSIGNED).when(F.col("no") == 3, F.col("mixed")).otherwise(True)
    return found.where(enough).drop("chars", "mixed")


def _ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repositories): how many distinct ones hold each value, over the whole corpus."""
    held = spans.select("value", "owner", "repository").distinct()
    return held.groupBy("value").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )


def _judged(spans: DataFrame) -> DataFrame:
    """Spans that count, each with `live`: base ones all, candidates that few own and that no base span touches."""
    known = spans.join(_ownership(spans), "value")
    few = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    by_start = Window.partitionBy("row").orderBy("start", "no")
    last_end = F.max(F.when(F.col("no") < 3, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # the same order from its end, so that what follows is what went before
    from_end = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("no")).rowsBetween(Window.unboundedPreceding, -1)
    next_start = F.min(F.when(F.col("no") < 3, F.col("start"))).over(from_end)
    free = (F.coalesce(last_end, F.lit(0)) <= F.col("start")) & (F.coalesce(next_start, F.col("end")) >= F.col("end"))
    return (
        known.withColumn("live", F.col("live") & few)
        .withColumn("free", free)
        .where("no < 3 or (live and free)")
        .select("row", "no", "start", "end", "live")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["no"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _by_row(rows: DataFrame) -> DataFrame:
    """(row, spans): the spans of each row that has any, by start, then kind."""
    spans = written(_spans(rows), "spans")
    return _judged(spans).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", "live"))).alias("spans"))


def _of_kind(no: int) -> Callable[[Column], Column]:
    return lambda span: span["no"] == no


def secrets(
    docs: DataFrame, owner: tuple[str, ...] = ("source",), repository: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """docs (doc_id, text, owner and repository columns) -> one row for every row of docs.

    Columns: doc_id, n_assign, n_access, n_hex, n_owned, n_live, n_example, base_sha256,
    spans. Positions count code points, the end is exclusive. Texts are read whole.

    Null and empty texts have no span. A null owner or repository counts as one of
    its own. Null ids keep their rows. Repeated rows are each scanned and count
    once for their owner. An empty table gives an empty result. Columns other than
    those named are not looked at. Ties in the start go by the order of KINDS.
    """
    rows = written(_rows(docs, list(owner), list(repository)), "secrets")
    every = rows.select("row", "doc_id").join(_by_row(rows), "row", "left")
    spans = F.coalesce("spans", F.expr("array()").cast("array<struct<start:bigint,no:int,end:bigint,live:boolean>>"))
    out = every.select("doc_id", spans.alias("spans"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return out.select(
        "doc_id",
        *[count(_of_kind(no)).alias(f"n_{kind}") for no, kind in enumerate(KINDS)],
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        F.sha2(_listed(F.filter("spans", lambda s: s["no"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(
    docs: DataFrame, owner: tuple[str, ...] = ("source",), repository: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """docs with every span of its texts masked; rows and all other columns stay as they are.

    Spans that look live become <secret>, widely copied ones <example>. Spans that
    overlap are masked as one, live if any of them is. Null texts stay null, empty ones empty, very long ones are
    masked whole. Ties in the start go by the order of KINDS. Rows are told apart by all their columns; rows
    that repeat are masked alike. Columns may have any names. An empty table gives an empty result.
    """
    keys = dict(zip(("_tallyfield_key", "_tallyfield_key2"), identity(docs), strict=True))
    rows = written(_rows(docs, list(owner), list(repository), **keys), "secrets")
    spans = _judged(written(_spans(rows), "spans"))
    # one row of those that repeat stands for all
    first = rows.groupBy(*keys).agg(F.min("row").alias("row"))
    held = _masks(spans).join(first, "row").select(*keys, F.col("block").alias("_tallyfield_block"), "masks")
    keyed = docs.withColumns(keys)
    blocks = F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("_tallyfield_block", "_tallyfield_text")
    # only texts that hold spans are cut, each once, and every block is masked by itself
    marked = keyed.join(held.select(*keys).distinct(), list(keys), "left_semi").select(*keys, "text").dropDuplicates(list(keys))
    done = written(marked, "held").select(*keys, blocks).join(held, [*keys, "_tallyfield_block"], "left")
    block = F.struct("_tallyfield_block", _masked(F.col("_tallyfield_text"), F.col("masks")).alias("t")).alias("b")
    whole = done.select(*keys, block).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "").alias("_tallyfield_masked"))
    # the whole corpus meets the masked texts once
    return keyed.join(whole, list(keys), "left").withColumn("text", F.coalesce("_tallyfield_masked", "text")).select(*[f"`{c}`" for c in docs.columns])


def _masks(spans: DataFrame) -> DataFrame:
    """(row, block, masks): where spans lie in each block of BLOCK characters, those that overlap as one, live if any of them is.

    masks: (low, high, mask) by low, within the block; the mask stands in the block where the span begins.
    """
    order = Window.partitionBy("row").orderBy("start", "no")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("apart", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("long"))
    joined = apart.withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("live").alias("live"))
    cut = joined.select("row", "start", "end", "live", F.explode(F.expr(f"sequence(start div {BLOCK}, (end - 1) div {BLOCK})")).alias("block"))
    low, high = F.col("start") - F.col("block") * BLOCK, F.col("end") - F.col("block") * BLOCK
    mask = F.when(low < 0, "").when(F.col("live"), MASKS[True]).otherwise(MASKS[False])
    placed = F.struct(F.greatest(low, F.lit(0)).cast("int").alias("low"), F.least(high, F.lit(BLOCK)).cast("int").alias("high"), mask.alias("mask"))
    return cut.groupBy("row", F.col("block").cast("int").alias("block")).agg(F.array_sort(F.collect_list(placed)).alias("masks"))


def _masked(text: Column, masks: Column) -> Column:
    """One block: the pieces between the masks, and the masks."""
    piece = lambda m, i: F.concat(F.substring(text, F.coalesce(F.get(masks, i - 1)["high"], F.lit(0)) + 1, m["low"] - F.coalesce(F.get(masks, i - 1)["high"], F.lit(0))), m["mask"])
    rest = F.substring(text, F.element_at(masks, -1)["high"] + 1, F.lit(BLOCK))
    return F.when(masks.isNull(), text).otherwise(F.concat(F.array_join(F.transform(masks, piece), ""), rest))
