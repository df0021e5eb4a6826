"""Candidates for names: the most similar of all unique names, held against brute force."""

import random

from tallyfield.operators import matching as M


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def found(spark, asked, names):
    left = spark.createDataFrame([(a,) for a in asked], "name string")
    right = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "key string, inn string")
    return {r["key"]: (r["candidate_key"], r["candidate_inn"], r["similarity"]) for r in M.candidates(left, "name", right).collect()}


def test_names_mistyped_at_the_start(spark):
    got = found(spark, ["aolvon", "aolvon", "qb", None, ""], ["polvon", "aorta", "aziz karim"])
    assert got == {"aolvon": ("polvon", "0", 0.8333), "qb": ("polvon", "0", 0.0)}
    assert found(spark, ["aolvon"], []) == {} and found(spark, [], ["polvon"]) == {}


def test_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(M, "NAME_BLOCK", 7)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))
    names, asked = (sorted({" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(50)}) for _ in range(2))
    tokens = lambda n: " ".join(sorted(n.split()))
    near = lambda a, b: round(1 - distance(tokens(a), tokens(b)) / max(len(a), len(b)), 4)
    best = {a: max((near(a, n), n, str(i)) for i, n in enumerate(names)) for a in asked}
    assert found(spark, asked, names) == {a: (n, i, s) for a, (s, n, i) in best.items()}


def test_best_of_all_by_the_index(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    names = sorted({" ".join(word() for _ in range(rng.randrange(2, 4))) for _ in range(400)})

    def mistyped(n, times):
        for _ in range(times):
            at = rng.randrange(len(n) + 1)
            n = n[:at] + rng.choice(["", "x", "qz"]) + n[at + rng.randrange(2) :]
        return " ".join(n.split()) or "x"

    asked = sorted({mistyped(n, rng.choice([0, 1, 1, 2, 3, 6])) for n in names[::2]} | {"b", "zz", "qqqqqqqq"})
    tokens = lambda n: " ".join(sorted(n.split()))
    near = lambda a, b: round(1 - distance(tokens(a), tokens(b)) / max(len(tokens(a)), len(tokens(b))), 4)
    best = {a: max((near(a, n), n, str(i)) for i, n in enumerate(names)) for a in asked}
    got = found(spark, asked, names)
    assert got == {a: (n, i, s) for a, (s, n, i) in best.items()}


def test_few_pairs_are_compared(spark):
    rng = random.Random(9)
    names = sorted({" ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(7)) for _ in range(3)) for _ in range(600)})
    left = spark.createDataFrame([(n[:-1] + "z",) for n in names], "name string")
    right = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "key string, inn string")
    done = M.candidate_work(left, "name", right).first()
    assert done["pairs"] == len(names) ** 2 and done["compared"] < 0.05 * done["pairs"]


def in_order(left, right, left_names, right_names, least=3):
    """The loop that assign_in_order() stands for."""
    days = sorted({d for _, d, _, _ in left + right})
    of = lambda rows: {k: {(d, m): v for key, d, m, v in rows if key == k and v} for k in {r[0] for r in rows}}
    mine, theirs, used, out = of(left), of(right), set(), set()
    for key, _, name in sorted(left_names, key=lambda r: r[1]):
        own, found = mine.get(key, {}), None
        for n in range(len(days), least - 1, -1):
            part = lambda s, n=n: {c: v for c, v in s.items() if c[0] in days[:n]}
            free = [k for k in theirs if k not in used and part(theirs[k]) == part(own)]
            if not found and part(own) and len(free) == 1:
                found = (free[0], "SERIES" if n == len(days) else "LEADING_DAYS", n)
        if not found:
            free = [k for k, other in right_names if k not in used and other == name]
            found = (free[0], "NAME", 0) if len(free) == 1 else None
        if found:
            used.add(found[0])
            out.add((key, *found))
    return out


def test_partners_in_order(spark):
    rng = random.Random(11)
    for least, seed in ((3, 1), (2, 2)):
        rng.seed(seed)
        patterns = [[rng.choice([0, 0, 1, 2]) for _ in range(6)] for _ in range(25)]
        rows = lambda keys: [(k, d + 1, "HM"[d % 2], v) for k in keys for d, v in enumerate(rng.choice(patterns)[: rng.choice([4, 5, 6, 6])])]
        left, right = rows(range(40)), rows(range(100, 130))
        left_names = [(k, (k * 7) % 40, rng.choice(["alpha", "beta", f"delta {k % 9}", f"gamma {k % 15}"])) for k in range(40)]
        right_names = [(k, rng.choice(["beta", f"delta {k % 9}", f"gamma {k % 15}"])) for k in range(100, 130)]
        frame = lambda r: spark.createDataFrame(r, "key long, day int, method string, kg int")
        got = M.assign_in_order(frame(left), frame(right), spark.createDataFrame(left_names, "key long, ord int, name string"), spark.createDataFrame(right_names, "key long, name string"), least)
        wanted = in_order(left, right, left_names, right_names, least)
        assert {tuple(r) for r in got.collect()} == wanted and len(wanted) > 4
    none = M.assign_in_order(frame(left).limit(0), frame(right).limit(0), spark.createDataFrame([], "key long, ord int, name string"), spark.createDataFrame([], "key long, name string"))
    assert none.count() == 0
