"""Nearest neighbours against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import neighbours
from tallyfield.llm.queries import QUERIES, SQL
from tests.conftest import SF, rows_of
from tests.llm.test_vectors import ODD


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def plain(rows, k=20, each=20):
    ok = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in {i for i, _ in ok if i % each == 0}:
        own = min(v for i, v in ok if i == q)
        scores = sorted((-product(own, v), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(df, k=20):
    return sorted(tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


def small(monkeypatch, **more):
    for name, value in ({"TILE_ROWS": 30, "QUERY_ROWS": 4, "SHELF_TILES": 3, "SAMPLE": 60, "PIVOTS": 8, "CENTRE_ROWS": 2} | more).items():
        monkeypatch.setattr(neighbours, name, value)


def test_against_brute_force(vectors, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(v, 1).tolist()) for i, v in enumerate(rng.normal(size=(450, 8)) * rng.uniform(0.1, 5, size=(450, 1)))]
    assert found(vectors(*rows)) == plain(rows)
    assert found(vectors(*rows), 3) == plain(rows, 3)


def test_ties_copies_and_few_candidates(vectors, monkeypatch):
    small(monkeypatch)
    rows = [(i, [1.0, float(i % 3)]) for i in range(90)] + [(40, [0.5, 0.5])] * 2 + [(200 + i, [1.0, 2.0, 3.0]) for i in range(3)]
    assert found(vectors(*rows)) == plain(rows)
    assert len([r for r in found(vectors(*rows)) if r[0] == 200]) == 2


def test_odd_rows(vectors):
    rows = [*ODD, (20, [1.0, 0.0]), (40, [-0.5, 0.5]), (60, None), (80, []), (100, [0.0, 0.0]), (120, [1e-40, 2e-40])]
    df = vectors(*rows).withColumns({c: F.lit(3) for c in ("id", "v", "q", "tile", "dim", "n", "ids", "data", "rank", "score", "shelf")})
    assert found(df) == plain(rows)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_long_vectors_are_bounded_by_components(vectors, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(140, 4096)).astype(np.float32).astype(float))]
    small(monkeypatch, TILE_ROWS=4096, TILE_VALUES=2**17, SAMPLE_VALUES=2**17)
    assert found(vectors(*rows)) == plain(rows)


def test_clustered_tiles_are_not_moved(vectors, monkeypatch):
    small(monkeypatch, TILE_ROWS=40, SAMPLE=300, PIVOTS=20)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 5
    rows = [(i, (centres[i * 7 % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(2000)]
    done = neighbours.work_done(vectors(*rows), F.col("vec_id") % 20 == 0).first()
    assert found(vectors(*rows)) == plain(rows)
    # of 25 tiles of queries and 50 tiles of candidates or more; 100 queries and 2000 candidates
    assert done["products"] < 100 * 2000 * 0.8 and done["again"] < 100 * 2000 * 0.1


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)) * rng.uniform(0.01, 90, size=(300, 1))
    codes, scale, error = neighbours.quantised(x)
    row = {"n": 300, "dim": 24, "ids": np.arange(300).tobytes(), "data": x.tobytes(), "codes": codes.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "norm": np.sqrt((x * x).sum(1)).tobytes()}
    tile = neighbours.Tile(row)
    for floors in (rng.normal(size=300) * 50, np.full(300, -np.inf), np.sort(x @ x.T, axis=1)[:, -5]):
        i, j = neighbours.possible(tile, 0, 300, tile, floors)
        may = np.zeros((300, 300), bool)
        may[i, j] = True
        assert not ((x @ x.T >= floors[:, None] + 1e-9) & ~may).any()
    assert may.mean() < 0.2


def test_query_against_sql(spark, duck):
    got = rows_of(QUERIES["op12_nearest_neighbours"](spark, SF).toPandas())
    assert got == rows_of(duck.sql(SQL["op12_nearest_neighbours"]).df())
