"""Periodic runs against a search of all periods at all places."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfield.llm import repeats
from tallyfield.llm.queries import QUERIES
from tests.conftest import SF


def plain_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(plain_collapsed(words, found)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def digested(df):
    return sorted((tuple(r) for r in repeats.digests(repeats.periodic_runs(repeats.planted(df))).select(*COLUMNS).collect()), key=str)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 3)), max_size=70), st.integers(1, 9), st.integers(1, 12))
def test_runs_of_small_sequences(x, period, times):
    whole = x[:20] + (x[:period] or [0]) * times + x[20:]
    got = [tuple(r) for r in repeats.runs(np.array(whole, np.int32), len(whole)).tolist()]
    assert got == plain_runs(whole)


def test_runs_of_sparse_breaks():
    rng = random.Random(4)
    for _ in range(60):
        block = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        whole = block * rng.randint(1, 14) + [rng.choice("abc") for _ in range(rng.randint(0, 9))] + block * rng.randint(0, 9)
        for _ in range(rng.randint(0, 2)):
            whole[rng.randrange(len(whole))] = "z"
        got = [tuple(r) for r in repeats.runs(np.array([ord(w) for w in whole], np.int32), len(whole)).tolist()]
        assert got == plain_runs(whole)


def test_texts_of_a_batch_stay_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BYTES", 60)
    rows = [(i, t) for i, t in enumerate(["x y z w"] * 9 + [" a a a", "a a a ", "a\ta\na  a\x0ba\x0ca", "", None, "a b " * 30, "é é é é " * 6, "Ab ab " * 5])]
    got = {r["doc_id"]: r for r in repeats.periodic_runs(docs(*rows)).collect()}
    for i, text in rows:
        words = words_of(text)
        assert [tuple(r) for r in got[i]["runs"]] == plain_runs(words) and got[i]["n_words"] == len(words)
        assert got[i]["collapsed"] == plain_collapsed(words, plain_runs(words))


def test_odd_rows(spark, docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("length(text) < 1000 or text is null").collect()]
    assert digested(odd.where("length(text) < 1000 or text is null")) == sorted((plain_row(*r) for r in rows), key=str)
    wide = odd.withColumns({c: F.lit(1) for c in ("g", "words", "n", "a", "p", "left", "runs", "best", "collapsed", "n_words")})
    assert digested(wide) == digested(odd)
    assert repeats.periodic_runs(odd.limit(0)).count() == 0


def test_long_texts_take_no_square(docs):
    n = 400_000
    rng = random.Random(5)
    texts = ["word " * n, "a b c d e f g " * (n // 7), ("a " * 999 + "b ") * (n // 1000), " ".join(rng.choice("ab") for _ in range(n // 4))]
    began = time.time()
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in repeats.periodic_runs(docs(*enumerate(texts))).select("doc_id", "runs").collect()}
    assert time.time() - began < 60
    assert got[0] == [(0, n, 1)] and got[1] == [(0, n // 7 * 7, 7)]
    assert len(got[2]) == n // 1000 + 1 and (0, n, 1000) in got[2]
    assert len(got[3]) > 1000


def test_query_against_plain_search(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"] for r in rows if len(words_of(r["text"])) <= 700}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).select(*COLUMNS).collect()}
    assert len(got) == len(rows) and len(short) > 50 and any(got[d][1] for d in short)
    for r in rows:
        if r["doc_id"] in short:
            assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])
