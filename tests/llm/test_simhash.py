"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import corpus_pipeline  # noqa: F401 - the pipeline belongs to this subpackage
import xxhash

from tallyfield.llm import simhash
from tallyfield.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{p:016x}", str(least.get(find(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def found(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(df).collect())


def test_every_four_positions_hold_a_triple():
    triples = [set(t) for t in simhash.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(df) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain_components(rows)


def test_case_and_white_space(docs):
    rows = [(1, "Ä B\x0bc  d\te"), (2, "ä b c d e"), (3, "Ä b c d E"), (4, "x y")]
    assert found(docs(*rows)) == plain_components(rows)


def test_dense_group_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    part = connected_components(simhash.links(spark.createDataFrame(signed, "fp long")))
    got = {r["node"] % 2**64: r["component"] for r in part.collect()}
    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            assert got[a] == got[b]
    assert len(set(got.values())) == 1


def test_one_of_each_group_stays(odd):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    components = {r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert sorted(map(str, ids)) == sorted(map(str, components))


def test_rows_of_one_id_and_text_keep_their_columns(docs):
    both = docs((1, "a b c d"), (2, "other words stand here")).unionByName(docs((1, "a b c d"), lang="fr"))
    got = [tuple(r) for r in simhash.deduplicated(both).collect()]
    assert len(got) == 2 and set(got) <= {tuple(r) for r in both.collect()}
    again = [tuple(r) for r in simhash.deduplicated(both.repartition(3)).collect()]
    assert sorted(got) == sorted(again)


def test_empty_table(odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.deduplicated(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 400)} == {7}
    assert 5 not in got and 3 not in got
