"""Embedding near-duplicates and exact search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import topk, vector_links


def plain_links(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near), strict=True):
            if part[i] > part[j]:
                part[i], changed = part[j], True
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if part[k] == part[i] and rows[k][0] is not None]
        component = min(ids) if ids else None
        out.append((str(vec), int(near[i].sum()), str(component), vec == component))
    return sorted(out)


def found(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vector_links.near_duplicates(df).collect())


def near_rows(seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 6] + rng.normal(size=16) * 0.18).tolist()) for i in range(80)]
    rows += [(300 + i, base[3].tolist()) for i in range(9)] + [(400, (base[7] * 5).tolist())]
    return rows


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
    (None, [1.0, 0.01]), (None, None), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e30, 0.0]), (11, [0.0, -0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]),
]


def test_links_against_brute_force(vectors):
    rows = near_rows()
    assert found(vectors(*rows)) == plain_links(rows)


def test_links_over_cells_and_tiles(vectors, monkeypatch):
    monkeypatch.setattr(vector_links, "CELL_ROWS", 20)
    monkeypatch.setattr(vector_links, "TILE_ROWS", 7)
    monkeypatch.setattr(vector_links, "BLOCK_TILES", 2)
    rows = near_rows(6)
    assert found(vectors(*rows)) == plain_links(rows)


def test_code_products_are_exact():
    rng = np.random.default_rng(7)
    p, q = (rng.integers(-127, 128, size=(40, 3000)).astype(np.int8) for _ in range(2))
    p[0], q[0] = 127, 127
    assert (vector_links.code_products(p, q) == p.astype(np.int64) @ q.astype(np.int64).T).all()


def test_forest_joins_what_the_pairs_join():
    rng = np.random.default_rng(8)
    i, j = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    a, b = vector_links.forest(i, j, np.arange(60), np.arange(100, 160))
    assert len(a) < 110 and len(set(zip(a, b, strict=True))) == len(a)

    def parts(pairs):
        root = {x: x for x in [*range(60), *range(100, 160)]}
        for _ in range(120):
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert parts([*zip(a.tolist(), b.tolist(), strict=True)]) == parts([*zip(i.tolist(), (j + 100).tolist(), strict=True)])


def test_links_odd_rows(vectors):
    assert found(vectors(*ODD)) == plain_links(ODD)
    assert vector_links.near_duplicates(vectors(*ODD).limit(0)).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    unit = vector_links._units(rng.normal(size=(300, 24)) * rng.uniform(0.1, 9, size=(1, 24)))
    tile = {"codes": vector_links.quantised(unit), "n": len(unit), "unit": unit, "cls": np.arange(len(unit))}
    for threshold in (0.1, 0.5, 0.9):
        i, j = vector_links.possible(tile, tile, threshold)
        may = np.zeros((len(unit), len(unit)), bool)
        may[i, j] = True
        assert not ((unit @ unit.T >= threshold) & ~may).any()


def plain_top(rows, k=10):
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i % 100 == 0}:
        own = next(v for i, v in ok if i == q)
        scores = sorted((-int(own @ v), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def top(df):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_against_brute_force(vectors, monkeypatch):
    for name, value in (("TILE_ROWS", 50), ("QUERY_ROWS", 2), ("SHELF_TILES", 2), ("SAMPLE", 60), ("PIVOTS", 20), ("STEP", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(v, 1).tolist()) for i, v in enumerate(rng.normal(size=(450, 8)))]
    assert top(vectors(*rows)) == plain_top(rows)


def test_top_k_odd_rows(vectors):
    rows = [*[r for r in ODD if r[0] != 10], (100, [1.0, 0.0]), (200, [0.5, 0.5]), (300, None), (400, []), (500, [])]
    assert top(vectors(*rows)) == plain_top(rows)
    assert topk.top_k(vectors(*rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_clustered_tiles_are_passed_over(vectors, monkeypatch):
    for name, value in (("TILE_ROWS", 40), ("SAMPLE", 200)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 5
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(2000)]
    is_query = F.col("vec_id") % 100 == 0
    done = topk.work_done(vectors(*rows), is_query).first()
    # of 20 queries against 2000 candidates and 50 tiles or more
    assert done["evaluated"] < 20 * 2000 * 0.4 and done["visited"] < 20 * 50 * 0.6
    assert top(vectors(*rows)) == plain_top(rows)


def test_pairs_of_tiles_are_eliminated_before_they_move(vectors, monkeypatch):
    for name, value in (("TILE_ROWS", 25), ("QUERY_ROWS", 1), ("SAMPLE", 300)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 16)) * 5
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(2000)]
    near = topk.work_done(vectors(*rows), F.col("vec_id") % 100 == 0).first()["moved"]
    apart = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    far = topk.work_done(vectors(*apart), F.col("vec_id") % 100 == 0).first()["moved"]
    assert near < 0.6 * far and top(vectors(*apart)) == plain_top(apart)


def test_long_vectors(vectors, monkeypatch):
    monkeypatch.setattr(topk, "TILE_VALUES", 2**16)
    monkeypatch.setattr(topk, "SAMPLE_VALUES", 2**16)
    rng = np.random.default_rng(13)
    rows = [(i, np.round(v, 2).tolist()) for i, v in enumerate(rng.normal(size=(210, 4096)))]
    assert top(vectors(*rows)) == plain_top(rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    q, x = np.floor(1024 * rng.normal(size=(5, 8))), np.floor(1024 * rng.normal(size=(400, 8)))
    for pivots in (topk.far_pivots(x, 16), x[:0]):
        q_table, table = topk.distances(q, pivots), topk.distances(x, pivots)
        tile = topk.Tile(np.arange(400), x, table)
        for i in range(5):
            assert (topk.upper_bounds(q[i], q_table[i], tile.squares, table) >= x @ q[i]).all()
            assert tile.bound(q[i], q_table[i]) >= (x @ q[i]).max()


def test_cells_that_do_not_part_are_given_up():
    """Random vectors would be guests everywhere: they stay in one cell. Vectors in clusters get cells, and few guests."""
    rng = np.random.default_rng(3)
    unit = vector_links._units(rng.normal(size=(500, 48)))
    assert len(vector_links.parting(unit, 32, 0.95)) == 1
    around = vector_links._units(np.repeat(rng.normal(size=(32, 48)), 16, axis=0) + rng.normal(size=(512, 48)) * 0.02)
    centres = vector_links.parting(around, 32, 0.95)
    assert len(centres) == 32 and vector_links._open_cells(around, centres, 0.95)[1].sum(1).mean() < 1.5


def test_sample_of_centres_is_bounded_by_components(vectors, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(vector_links, "CELL_ROWS", 10)
    monkeypatch.setattr(vector_links, "SAMPLE_VALUES", 16 * 5)
    assert found(vectors(*rows)) == plain_links(rows)
    monkeypatch.setattr(vector_links, "SAMPLE_VALUES", 1)
    assert found(vectors(*rows)) == plain_links(rows)


def test_a_hot_component_and_rows_of_one_vector(vectors):
    """Rows meet their class by a key of the vector, and a component's id is joined in parts."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=12)
    rows = [(1000 + i, base.tolist()) for i in range(90)] + [(i, (base + rng.normal(size=12) * 0.01).tolist()) for i in range(60)] + [(500, None), (501, (-base).tolist())]
    assert found(vectors(*rows)) == plain_links(rows)
