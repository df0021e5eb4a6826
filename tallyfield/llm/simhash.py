"""SimHash near-duplicates: positional byte index, count filter, verification.

A fingerprint has 64 bits, eight bytes by position. Two fingerprints that differ in at
most 4 bits share at least 4 positional bytes, the guaranteed minimum of the
count filter. A posting list for each single byte would hold a 256th of all
fingerprints, so its pairs would grow with the square of the corpus. The lists here are
kept for three positional bytes at a time: of the 56 triples of positions, 20 suffice,
because every set of 4 positions contains one of them (a covering of the 4-sets
by triples). A list then holds about one fingerprint in 16.8 million by chance.
For each pair that meets in a list the shared positional bytes are tallied over all eight positions; only pairs that
reach 4, the guaranteed minimum, are retained and verified on the bits. Whoever meets in single-byte
lists with a tally of 4 meets in one of the triples as well, so the lists of triples lose nothing that
single ones would find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, identity, only, written
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
#: Fingerprints of one list that a task compares at once; longer lists are cut into blocks.
BLOCK = 1024
#: Parts that a component's rows are dealt to when its id comes back to them.
SALT = 16


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any 4 of the 8 positions contain one.

    Positions fall into three classes; a triple is taken if it lies in one class, or
    has two positions in a class and the third in the next. Four positions put
    two in some class, and one of the cases then always holds.
    """
    kind = [p % 3 for p in range(8)]
    taken = []
    for t in combinations(range(8), 3):
        counts = [sum(kind[p] == c for p in t) for c in range(3)]
        if 3 in counts or (2 in counts and counts[(counts.index(2) + 1) % 3] == 1):
            taken.append(t)
    return taken


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of one whole text, given in UTF-8."""
    words = (text or b"").lower().split()  # on bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        np.uint64,
        last,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, last, 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, *identified_by: str) -> DataFrame:
    """(doc_id, key, key2, fp) for every row of docs, written: fp as a signed long, the keys hashes of the named columns."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=["doc_id", "key", "key2", "fp"])

    key, key2 = identity(docs, *(identified_by or ("doc_id", "text")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key"), key2.alias("key2"), docs["text"].cast("string").cast("binary").alias("text"))
    with batches_of(docs.sparkSession):
        return written(rows.mapInArrow(batches, "doc_id long, key long, key2 long, fp long"), "fingerprints")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the tally of shared positional bytes and, of those, differ in few enough bits."""
    x = (a ^ b).view(np.uint64)
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = tally >= LEAST_BYTES
    retained = np.flatnonzero(near)
    near[retained] = np.bitwise_count(x[retained]) <= MOST_BITS
    return near


def _forest(fps: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the verified pairs of one long list or pair of blocks connect.

    At most one link for each fingerprint comes out, so dense lists do not
    multiply; left marks the first block where two blocks meet.
    """
    n = len(fps)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        a = np.repeat(fps[i : i + 256], n)
        near[i : i + 256] = _verified(a, np.tile(fps, len(a) // n)).reshape(-1, n)
    if not left.all():
        near &= left[:, None] != left[None]
    root = np.full(n, -1)
    for s in range(n):
        if root[s] >= 0:
            continue
        root[s] = s
        edge = np.array([s])
        while len(edge):
            new = near[edge].any(0) & (root < 0)
            root[new] = s
            edge = np.flatnonzero(new)
    linked = root != np.arange(n)
    return fps[root[linked]], fps[linked]


def _links_of_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) -> links within each list. A list never spans more than 2 * BLOCK rows or so."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        head = np.ones(len(rows), bool)
        head[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(rows)))
        group = np.repeat(np.arange(len(first)), count)
        small = count[group] <= 32
        fps, out_a, out_b = np.ascontiguousarray(rows[:, 2]), [], []
        at = np.flatnonzero(small)
        for d in range(1, 32):
            at = at[at + d < len(rows)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            ok = _verified(fps[at], fps[at + d]) & (fps[at] != fps[at + d])
            out_a.append(fps[at[ok]])
            out_b.append(fps[at[ok] + d])
        for g in np.flatnonzero(count > 32):
            part = slice(first[g], first[g] + count[g])
            a, b = _forest(fps[part], rows[part, 3].astype(bool))
            out_a.append(a)
            out_b.append(b)
        a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in it:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)], axis=1)
        held.append(rows)
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
        if same.all():
            continue
        cut = len(rows) - int(np.argmin(same[::-1]))
        held[-1] = rows[:cut]
        yield solve(np.concatenate(held))
        held = [rows[cut:]]
    if held:
        yield solve(np.concatenate(held))


def posting_lists(fps: DataFrame) -> DataFrame:
    """Distinct fps -> (key, i, j, fp, first): the shared lists, long ones cut into pairs of blocks.

    key is the triple's number and its three bytes. Lists with one entry link nothing and
    go. A list of more than BLOCK entries is cut into blocks by hash, and each pair
    of blocks (i <= j) becomes a list of its own, so no task holds a hot list whole.
    """
    keys = F.array(
        *[
            F.lit(n * 2**24)
            + sum(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) * 256**k for k, p in enumerate(t))
            for n, t in enumerate(covering_triples())
        ]
    )
    entries = fps.select("fp", F.explode(keys).alias("key"))
    long = entries.groupBy("key").count().where("count > 1")
    cut = entries.join(long, "key").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return pairs.select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "fp",
        (F.col("own") <= F.col("other")).alias("first"),
    )


def links(fps: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints; they connect all that link.

    Short lists give every verified pair, long ones at most one link a fingerprint.
    """
    lists = posting_lists(fps).select(
        "key", (F.col("i") * F.lit(2**31) + F.col("j")).alias("ij"), "fp", F.col("first").cast("long").alias("first")
    )
    dealt = lists.repartition("key", "ij").sortWithinPartitions("key", "ij")
    return dealt.mapInArrow(_links_of_lists, "a long, b long")


def classes(own: DataFrame) -> DataFrame:
    """fingerprints() -> (fp, component, least, component_id), one row for each distinct fingerprint."""
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    part = connected_components(links(distinct.select("fp")))
    linked = distinct.join(part, distinct["fp"] == part["node"]).select("fp", "least", "component")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # a large component is one key: its rows are dealt to SALT parts, and its id goes to each
    salted = linked.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)))
    spread = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    placed = salted.join(spread, ["component", "_salt"]).select("fp", "component", "least", "component_id")
    alone = distinct.join(part, distinct["fp"] == part["node"], "left_anti")
    return placed.unionByName(alone.select("fp", F.col("fp").alias("component"), "least", F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id, one row for every row.

    component_id is the least doc_id among all rows whose fingerprints are
    reached through links of at most 4 differing bits, the row itself included.
    Null and empty texts have fingerprint zero and link like any other. A null
    doc_id keeps its row; it is a component_id only where all ids of the
    component are null. Repeated rows stay. An empty table gives an empty result.
    Other columns are not looked at, whatever their names. Texts are read whole.
    """
    own = fingerprints(only(docs, "doc_id", "text"), shingle)
    return own.join(classes(own).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs that stay when each near-duplicate group keeps one document.

    The document with the least doc_id stays, null ids last. Where several rows bear that id, one of those with other
    texts or other columns stays, by a hash of all columns, so reruns agree; rows equal in all columns
    are one document. Null and empty texts are one group. Very long texts are read whole. All columns
    of docs are returned as they are, whatever their names. An empty table gives an empty result.
    """
    own = fingerprints(docs, shingle, *docs.columns)
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("key"), F.col("key2"))
    first = own.groupBy("fp").agg(F.min(order).alias("first"))
    kept = (
        first.join(classes(own).select("fp", "component"), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("_tallyfield_key"), F.col("first.key2").alias("_tallyfield_key2"))
    )
    key, key2 = identity(docs)
    keyed = docs.withColumns({"_tallyfield_key": key, "_tallyfield_key2": key2})
    once = keyed.join(kept, ["_tallyfield_key", "_tallyfield_key2"], "left_semi").dropDuplicates(["_tallyfield_key", "_tallyfield_key2"])
    return once.select(*[f"`{c}`" for c in docs.columns])
