"""The source divergence audit against plain loops over all terms and all pairs of sources."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tallyfield.llm import divergence
from tallyfield.llm.queries import QUERIES, SQL
from tests.conftest import SF, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=200):
    """rows (text, lang, source) -> the audit's rows, all shares worked out one by one."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, g, s in rows if g == lang]
        held = Counter(t for terms, _ in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= 3)
        sources = sorted({s for _, s in own}, key=str.encode)

        def shares(terms, kept=kept):
            n = Counter(t for t in terms if t in set(kept))
            total = sum(n.values()) + len(kept)
            return n, {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}

        by = {s: shares([t for terms, x in own if x == s for t in terms]) for s in sources}
        q = shares([t for terms, _ in own for t in terms])[1]
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            n, p = by[s]
            pairs = [(-sum(gap(p[t], by[x][1][t]) for t in kept), x.encode(), x) for x in sources if x != s]
            terms = [(-gap(p[t], q[t]), t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit(df, **how):
    return sorted(map(tuple, divergence.divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


def made(seed=3, n=240):
    import random

    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)] + ["Éa", "éa", "ßx", "日本", "İk", "STRASSE", "strasse"]
    weigh = {s: [rng.random() ** (i % 4 + 1) for i in range(len(words))] for s in ("a", "b", "é", "c")}
    sources = ["a"] * 4 + ["b", "é", "c"]
    return [
        (" ,".join(rng.choices(words, weigh[s], k=rng.choice([0, 3, 40]))), rng.choice(["en", "en", "fr"]), s)
        for s in (rng.choice(sources) for _ in range(n))
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS)


def test_against_plain_loops(spark):
    rows = made() + [("onlyhere onlyhere", "en", "lonely"), ("", "de", "x"), ("ab cd", "de", "y"), ("zz " * 4, "it", "alone")] * 2
    assert audit(frame(spark, rows)) == plain(rows)
    assert audit(frame(spark, rows), most_terms=5) == plain(rows, 5)


def test_odd_rows(spark):
    long = "Word9word " * 40_000
    rows = [(None, None, None), ("", "", ""), ("a b a", None, "s"), ("a b a", None, "s"), ("A\u0000b-c", "", None), (long, "", "s"), (None, "en", None), ("a", "en", "t"), ("a", "en", "t"), ("a", "en", "u")]
    df = frame(spark, rows).withColumns({c: F.lit(9) for c in ("a", "b", "no", "n", "terms", "cells", "groups", "item", "value", "rank", "part", "term", "kinds", "total")})
    assert audit(df) == plain(rows)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_counts_beyond_a_long_product(spark):
    big = 3 * 10**17
    df = spark.createDataFrame([(big, 7 * 10**17, 11), (4, 10, 3), (2**62 // 10**9, 2**61, 5), (2**62 // 10**9 - 1, 2**61, 5)], "n long, total long, kinds long")
    got = df.select("n", "total", "kinds", F.expr(divergence._share("n", "total", "kinds")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["kinds"]) for r in got)


def test_workers_hand_on_counts_that_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = made(5)
    with_small_batches = frame(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audit(with_small_batches) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_against_sql(spark, duck):
    got = rows_of(QUERIES["op13_source_divergence"](spark, SF).toPandas())
    assert got == rows_of(duck.sql(SQL["op13_source_divergence"]).df())
