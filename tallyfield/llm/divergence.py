"""Source divergence audit: how the words of a source differ from those of the other sources of its language.

Occurrences are counted per language, source and term, each task adding up its own first. Every term is then pivoted into one
wide row: an array with a cell for each source that has the term. With add-one smoothing, all sources without a term give it the same
share, so a pair of sources differs from that base only where one of them has the term:

- the base: both lack the term, times all kept terms;
- one has it: worked out once for each count that occurs in a source, times the terms with that count;
- both have it: higher-order functions turn the wide row's counts into shares and its cells into pairs, and what these add beyond the
  two corrections above is summed map-side by pair.

So a term costs the pairs of the sources that have it, not of all sources, and no list of terms is gathered anywhere. All numbers are
whole and exact.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, text_of, written

#: Fixed value: shares are counted in billionths.
SCALE = 1_000_000_000
#: Fixed value: a term is a run of ASCII letters and of all signs beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept where so many documents of its language hold it; so many terms of a source are listed.
LEAST_DOCUMENTS = 3
MOST_TERMS = 200
#: Counts that a Python worker holds before it hands them on.
HELD = 500_000
COUNTED = "lang string, source string, term string, n long, docs long"
#: TERM and the lower-casing of A-Z, byte by byte: what is no part of a term becomes a space.
_LETTERS = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source, ...) -> lang, source, term, n (occurrences), docs (documents that hold it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                names = [x.split()[0] for x in COUNTED.split(", ")]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [d[t] for t in n]]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            held.clear()

        for batch in batches:
            texts, langs, sources = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, lang, source in zip(texts, langs, sources, strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(_LETTERS).split()
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    named = docs.select(text_of().alias("text"), _name("lang"), _name("source"))
    with batches_of(docs.sparkSession):
        counted = named.mapInArrow(count, COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(column: str) -> Column:
    return text_of(column).alias(column)


def _share(n: str, total: str, kinds: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 1) / (total + kinds)), by long arithmetic wherever a long holds it."""
    exact = f"CAST((CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) DIV CAST({total} + {kinds} AS DECIMAL(19, 0)) AS BIGINT)"
    return f"(1L + CASE WHEN {n} < {2**62 // SCALE} THEN ({SCALE}L * ({n} + 1L)) DIV ({total} + {kinds}) ELSE {exact} END)"


def _gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p} - {q}) * ({p} - {q})) DIV {q})"


def _wide(docs: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """lang, term, cells [(no, n)]: the kept terms, each with a cell for every source of its language that has it."""
    numbered = term_counts(docs).join(sources, ["lang", "source"])
    cells = F.collect_list(F.struct("no", "n")).alias("cells")
    return numbered.groupBy("lang", "term").agg(cells, F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least).drop("docs")


def _sources(docs: DataFrame) -> DataFrame:
    """lang, source, no: the sources of each language, numbered from 0 in their order; one row a source."""
    groups = docs.select(_name("lang"), _name("source")).distinct()
    return groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def _languages(sources: DataFrame, counts: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, kinds (kept terms), total, groups [(no, source, total, base)]; base is the share of a term that the source lacks."""
    totals = counts.groupBy("lang", "no").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    kinds = wide.groupBy("lang").agg(F.count("*").alias("kinds"))
    known = sources.join(totals, ["lang", "no"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
    known = known.withColumn("base", F.expr(f"CASE WHEN kinds = 0 THEN 1L ELSE {_share('0L', 'total', 'kinds')} END"))
    groups = F.array_sort(F.collect_list(F.struct("no", "source", "total", "base"))).alias("groups")
    return known.groupBy("lang").agg(F.first("kinds").alias("kinds"), F.sum("total").alias("total"), groups)


def _pair_values(languages: DataFrame, counts: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, a, b, value: for sources a and b of a language by number, the sum over all kept terms."""
    others = "filter(groups, g -> g.no <> a.no)"
    base = languages.select("lang", "kinds", "groups", F.explode("groups").alias("a")).select("lang", "kinds", "a", F.explode(F.expr(others)).alias("b"))
    base = base.select("lang", F.col("a.no").alias("a"), F.col("b.no").alias("b"), F.expr(f"kinds * {_gap('a.base', 'b.base')}").alias("value"))

    # one of the two has the term: a source's count stands for all terms with that count
    own = counts.join(languages, "lang").withColumn("a", F.expr("groups[no]")).withColumn("p", F.expr(_share("n", "a.total", "kinds")))
    one = own.select("lang", "terms", "a", "p", F.explode(F.expr(others)).alias("b"))
    there = f"terms * ({_gap('p', 'b.base')} - {_gap('a.base', 'b.base')})"
    back = f"terms * ({_gap('b.base', 'p')} - {_gap('b.base', 'a.base')})"
    one = _both_ways(one, there, back)

    # both have it: the cells of a wide row, each with the cells after it
    cells = f"transform(cells, c -> named_struct('no', c.no, 'p', {_share('c.n', 'groups[c.no].total', 'kinds')}, 'base', groups[c.no].base))"
    shares = wide.join(languages, "lang").select("lang", F.expr(cells).alias("cells"))
    first = shares.select("lang", "cells", F.posexplode("cells").alias("at", "a"))
    two = first.select("lang", "a", F.explode(F.expr("slice(cells, at + 2, size(cells))")).alias("b"))
    mixed = lambda x, y: f"{_gap(f'{x}.p', f'{y}.p')} - {_gap(f'{x}.p', f'{y}.base')} - {_gap(f'{x}.base', f'{y}.p')} + {_gap(f'{x}.base', f'{y}.base')}"
    two = _both_ways(two, mixed("a", "b"), mixed("b", "a"))

    each = lambda df: df.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    flat = lambda df: df.select("lang", "a", "b", F.col("there").alias("value")).unionByName(df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))
    summed = written(each(one).unionByName(each(two)), "pairs")
    return base.unionByName(flat(summed)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _both_ways(pairs: DataFrame, there: str, back: str) -> DataFrame:
    return pairs.select("lang", F.col("a.no").alias("a"), F.col("b.no").alias("b"), F.expr(there).alias("there"), F.expr(back).alias("back"))


def _term_values(languages: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, a, item, value: the terms that a source has with a greater share than its language."""
    q = F.expr(_share("n", "total", "kinds"))
    rows = wide.join(languages, "lang").withColumn("q", q).select("lang", "term", "kinds", "groups", "q", F.explode("cells").alias("c"))
    shares = rows.select("lang", F.col("c.no").alias("a"), F.col("term").alias("item"), "q", F.expr(_share("c.n", "groups[c.no].total", "kinds")).alias("p"))
    return shares.where("p > q").select("lang", "a", "item", F.expr(_gap("p", "q")).alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs (text, lang, source, ...) -> lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and of all signs beyond ASCII; only A-Z are lower-cased. A language keeps the terms that
    at least so many of its documents hold. A share is p = 1 + floor(10^9 (n + 1) / (N + V)) with n the occurrences of the term in the
    group, N those of all kept terms, V the kept terms of the language.

    part `pair`: item is another source of the language, value the sum of floor((p - q)^2 / q) over all kept terms, q the
    other's share; 0 without kept terms. part `term`: item is a kept term that the source has with p > q, q the share in the whole
    language; the most_terms largest. Ranks count from 1 by value, descending, then by item in the order of its bytes.

    Null texts, languages and sources are empty ones; a source without terms is compared too. A language with one source
    has no pairs. Very long texts are read whole. Repeated rows count as often as they occur. Rows of a
    third of the corpus in one source, or a term in every document, are added up in each task first. An empty table
    gives an empty result. Other columns are not looked at, whatever their names.
    """
    sources = written(_sources(docs), "sources")
    wide = written(_wide(docs, sources, least_documents), "terms")
    cells = wide.select("lang", F.explode("cells").alias("c")).select("lang", "c.no", "c.n")
    counts = written(cells.groupBy("lang", "no", "n").agg(F.count("*").alias("terms")), "counts")
    languages = written(_languages(sources, counts, wide), "languages")
    names = sources.select("lang", F.col("no").alias("a"), "source")
    others = sources.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")
    pairs = _pair_values(languages, counts, wide).join(others, ["lang", "b"]).drop("b")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = _term_values(languages, wide).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    found = pairs.unionByName(terms).join(names, ["lang", "a"])
    return found.select("lang", "source", "part", "item", "value", "rank")
