"""Periodic runs in word sequences by harmonic grid probing.

A run of period p that is at least four periods long holds three grid points jp, (j+1)p, (j+2)p with equal words and
everything between them agrees at distance p. So for each p only the words at multiples of p are compared, n/p of them, n log n over all p.
Where three in a row are equal, the words between them are compared too, a few at first, then
chunks of growing size; what survives is extended to both sides, in chunks again, and the grid points within the run that is found are skipped. Grid points in a run of a smaller period that divides p
belong to that run and are skipped as well.

The texts of a batch are laid one after the other with a word of its own between two, which equals nothing, so one
pass over the periods serves all of them and no run crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, batches_of, only, text_of

#: A run holds so many periods at least, and so many words.
LEAST_PERIODS = 4
LEAST_WORDS = 6
#: Words between grid points that are compared before a candidate is extended, and the first chunk of an extension.
PROBES = 7
CHUNK = 32
#: Words that are compared at once.
MOST_GATHERED = 2**20
#: Bytes of text that are looked at in one pass; a longer text is looked at alone.
PASS_BYTES = 2**22
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _agreeing(x: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch [low, high) around `at` whose words equal those p after them, compared in chunks that double."""
    low, chunk = at, CHUNK
    while low:
        from_ = max(0, low - chunk)
        differ = np.flatnonzero(x[from_:low] != x[from_ + p : low + p])
        if len(differ):
            low = from_ + int(differ[-1]) + 1
            break
        low, chunk = from_, chunk * 2
    high, chunk, end = at + 1, CHUNK, len(x) - p
    while high < end:
        to = min(end, high + chunk)
        differ = np.flatnonzero(x[high:to] != x[high + p : to + p])
        if len(differ):
            return low, high + int(differ[0])
        high, chunk = to, chunk * 2
    return low, high


def _outside(points: np.ndarray, p: int, found: dict[int, np.ndarray]) -> np.ndarray:
    """The points but those that lie, with the point p after them, in one found run whose period divides p: the run of p there is that run."""
    for q, runs_of in found.items():
        if len(points) and p % q == 0 and runs_of[:, 1].max() > p:
            start, length = runs_of[runs_of[:, 1] > p, :2].T
            depth = np.zeros(len(points) + 1, np.int64)
            low = np.searchsorted(points, start)
            np.add.at(depth, low, 1)
            np.add.at(depth, np.maximum(low, np.searchsorted(points, start + length - p)), -1)
            points = points[depth[:-1].cumsum() == 0]
    return points


def _repeated(x: np.ndarray, points: np.ndarray, p: int, span: int) -> np.ndarray:
    """The points from which on `span` words agree with those p after them: a few probes, then chunks of growing size."""
    for k in range(1, PROBES + 1):
        if len(points):
            at = points + k * span // (PROBES + 1)
            points = points[x[at] == x[at + p]]
    done, chunk = 0, CHUNK
    while len(points) and done < span:
        to = min(span, done + chunk)
        kept, rows = [], max(1, MOST_GATHERED // (to - done))
        for i in range(0, len(points), rows):
            at = points[i : i + rows, None] + np.arange(done, to)
            kept.append(points[i : i + rows][(x[at] == x[at + p]).all(1)])
        points, done, chunk = np.concatenate(kept), to, chunk * 2
    return points


def runs(x: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) rows, by start and period: the maximal runs of a sequence, each with its smallest period.

    longest: no run is longer, so periods end at a fourth of it.
    """
    found: dict[int, np.ndarray] = {}
    for p in range(1, longest // LEAST_PERIODS + 1):
        same = x[:-p:p] == x[p::p]
        # so many grid points in a row lie in the part of a run that agrees with what stands p after it
        asked = (max(LEAST_WORDS, LEAST_PERIODS * p) - p) // p
        n = len(same) - asked + 1
        if n < 1:
            continue
        streak = same[:n].copy()
        for k in range(1, asked):
            streak &= same[k : n + k]
        points = np.flatnonzero(streak)
        if not len(points):
            continue
        points = _repeated(x, _outside(points * p, p, found), p, (asked - 1) * p)
        at, new = 0, []
        while at < len(points):
            low, high = _agreeing(x, int(points[at]), p)
            if high - low + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                new.append((low, high - low + p, p))
            at = int(np.searchsorted(points, high))
        if new:
            found[p] = np.array(new, np.int64)
    rows = np.concatenate([np.empty((0, 3), np.int64), *found.values()])
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _passes(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows that hold PASS_BYTES together, or one row that holds more."""
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > PASS_BYTES:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def _scanned(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and collapsed of each text."""
    lists = pc.ascii_split_whitespace(texts)
    ends, flat = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(), lists.flatten()
    word = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate([[0], np.cumsum(word)])
    ends, flat = before[ends], flat.filter(pa.array(word))
    n = np.diff(ends)
    ids = np.asarray(flat.dictionary_encode().indices)
    # after each text a word that occurs nowhere else
    row = np.repeat(np.arange(len(n)), n)
    x = np.empty(len(ids) + len(n), np.int32)
    x[np.arange(len(ids)) + row] = ids
    x[ends[1:] + np.arange(len(n))] = -1 - np.arange(len(n))
    found = runs(x, int(n.max(initial=0)))
    firsts = ends[:-1] + np.arange(len(n))
    of = np.searchsorted(firsts, found[:, 0], side="right") - 1
    start = found[:, 0] - firsts[of]
    kept = np.ones(len(ids), bool)
    for low, (_, length, period) in zip((ends[of] + start).tolist(), found.tolist(), strict=True):
        kept[low + period : low + length] = False
    items = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["start", "length", "period"])
    owned = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32()), items)
    left = np.concatenate([[0], np.cumsum(kept)])[ends]
    words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
    return pa.array(n, pa.int64()), owned, pc.binary_join(words, " ")


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, runs [(start, length, period)], collapsed; one row for every row.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of words with smallest period
    q, LEAST_PERIODS of it and LEAST_WORDS words at least, that neither neighbour extends; runs stand by start, then period, and may
    overlap. collapsed: the words, one space between two, without those that any run contains
    after its first q words.

    Null and empty texts have no words, no runs and an empty collapsed text. Texts are read whole, and the work grows as
    n log n, whatever repeats in them. Null ids and repeated rows stay. An
    empty table gives an empty result. Other columns are not looked at, whatever their names. There is no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)))
            for low, high in _passes(sizes):
                columns = [batch.column(0).slice(low, high - low), *_scanned(batch.column(1).slice(low, high - low))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(docs.sparkSession):
        return docs.select("doc_id", text_of(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, {FOUND}")


def planted(docs: DataFrame) -> DataFrame:
    """docs with repetition planted in every tenth text, by a hash of its id, to hold the operator against.

    With h = crc32(doc_id), g = floor(h / 10) and n words, where h % 10 = 0 and n > 0: from word a = g % n on, the
    p = 1 + floor((n - a) / (3 + g % 8)) words there repeat to the end of the text. A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = only(docs, "doc_id", "text").withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)))})
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("left", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(block, F.expr("left div p").cast("int")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), again, F.slice("words", F.col("a") + 1, F.col("left") % F.col("p")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs() -> a row of figures and digests for each document; the run shown is the one with the most periods."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
