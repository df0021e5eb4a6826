"""Embedding near-duplicates by quantised tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale and an exact error norm each. The products
of the codes of two tiles are whole numbers and exact; with the scales, plus the bound that follows from the error norms, they tell which
pairs may reach the threshold; only these are computed again in double precision.

Vectors live in cells around centres. A vector is at home in the cell of its nearest
centre and a guest in every other cell where the bisector of the two centres
leaves room for a partner, so a vector meets all its partners in its home cell and
counts them there. Tiles of one cell are dealt to blocks, and blocks meet in pairs, so a tile is
moved once for each block of its cell and not for each tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, written
from .components import connected_components
from .tiles import is_sound

THRESHOLD = 0.95
TILE_ROWS = 4096
#: Components in a tile at most, so that tiles of long vectors have fewer rows.
TILE_VALUES = 2**19
#: Vectors that a cell has on average, the most cells, and the sample that centres are taken from.
CELL_ROWS = 65_536
MOST_CELLS = 2048
SAMPLE_PER_CELL = 8
#: Components of that sample at most, as the driver holds it: 32 MB.
SAMPLE_VALUES = 2**22
#: Parts that the rows of a component are dealt to when its id is joined to them.
SALT = 64
#: Tiles that a block of a cell has on average; two blocks are one task's work.
BLOCK_TILES = 8
#: Components of a vector whose products of codes add up exactly in single precision: 127 * 127 * 1024 < 2**24.
EXACT = 1024
PLACED = "dim int, cell int, home boolean, cls long, copies long, v array<double>"
TILE = "dim int, cell int, home boolean, part long, n int, cls binary, copies binary, codes binary, scale binary, error binary, data binary"
FOUND = "a long, b long, links long"


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what the codes miss, for unit vectors in rows."""
    scale = np.abs(unit).max(1, initial=0) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    missed = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((missed * missed).sum(1)) + 1e-12


def code_products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The products of int8 codes in rows, exact whole numbers: of EXACT components at a time in single precision, which holds them."""
    total = None
    for at in range(0, p.shape[1], EXACT):
        part = p[:, at : at + EXACT].astype(np.float32) @ q[:, at : at + EXACT].astype(np.float32).T
        total = part if total is None else total.astype(float) + part
    return np.zeros((len(p), len(q)), np.float32) if total is None else total


def possible(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two quantised tiles whose unit vectors may have a product at or above the threshold.

    With x = x' + e and y = y' + f the product is x'y' + x'f + ey' + ef, and |x'| <= 1 + |e|. The largest
    errors of the tiles bound all pairs at once; a pair within that bound is held against the errors of its own two
    vectors.
    """
    (p, s, e), (q, t, f) = a["codes"], b["codes"]
    room = lambda e, f: (1 + e) * f + e * (1 + f) + e * f + 1e-9
    near = code_products(p, q)
    # a row's own scale and the other tile's outermost one: one number a row to compare with, rounded down
    bound = threshold - room(e.max(), f.max())
    least = bound / (s * (t.max() if bound > 0 else t.min()))
    i, j = np.nonzero(near >= (least - np.abs(least) * 1e-6).astype(np.float32)[:, None])
    own = near[i, j] * s[i] * t[j] + room(e[i], f[j]) >= threshold
    return i[own], j[own]


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs of columns in double precision, component by component in order: a pair's value depends on the pair alone."""
    out = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def linked(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two tiles that link, by double precision wherever the bound leaves it open."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    mine, theirs = np.ascontiguousarray(a["unit"].T), np.ascontiguousarray(b["unit"].T)
    for low in range(0, a["n"], 512):
        part = {"codes": tuple(x[low : low + 512] for x in a["codes"])}
        i, j = possible(part, b, threshold)
        for at in range(0, len(i), 500_000):
            some, other = i[at : at + 500_000] + low, j[at : at + 500_000]
            sure = (cosines(mine, theirs, some, other) >= threshold) & (a["cls"][some] != b["cls"][other])
            found.append((some[sure], other[sure]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def forest(i: np.ndarray, j: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs (i, j) of rows and columns join: one for each vector at most, from the first of its part."""
    mark = np.arange(len(rows) + len(columns))
    j = j + len(rows)
    while True:
        low = np.minimum(mark[i], mark[j])
        new = mark.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == mark).all():
            break
        mark = new
    names = np.concatenate([rows, columns])
    own = np.flatnonzero(mark != np.arange(len(mark)))
    first, other = names[mark[own]], names[own]
    differ = first != other
    return first[differ], other[differ]


def _open_cells(units: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and which cells the bisectors leave open for partners of it, home among them."""
    near = units @ centres.T
    own = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[own]
    return own, near.max(1)[:, None] - near <= (np.sqrt(2 - 2 * threshold) + 1e-9) * apart + 1e-9


def parting(units: np.ndarray, cells: int, threshold: float) -> np.ndarray:
    """Centres among unit vectors, each farthest from those before it: as many, up to cells, as move the least data.

    In c cells in which a vector stands g times on average, a tile is moved g times for each block of a cell, of which
    there are in proportion to g / c; so g * g / c is what counts. Vectors that no cells part stay in one.
    """
    taken, best = [0], units @ units[0]
    while len(taken) < min(cells, len(units)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        taken.append(far)
        best = np.maximum(best, units @ units[far])
    found = units[taken]
    sizes = sorted({len(found) >> k or 1 for k in range(len(found).bit_length())})
    return found[: min(sizes, key=lambda c: _open_cells(units, found[:c], threshold)[1].sum(1).mean() ** 2 / c)]


def _centres(classes: DataFrame, cells: int, longest: int, threshold: float) -> dict[int, np.ndarray]:
    """Centres by length of vector, from a sample bounded in rows and in components; what links does not depend on it."""
    if cells < 2:
        return {}
    most = min(cells * SAMPLE_PER_CELL, max(1, SAMPLE_VALUES // longest))
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(most).collect()
    by_length = {dim: np.array([r["v"] for r in sample if len(r["v"]) == dim], float) for dim in {len(r["v"]) for r in sample}}
    return {dim: parting(_units(x), cells, threshold) for dim, x in by_length.items()}


def _placed(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Every class in its home cell and in those where it is a guest."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            values, dims = np.asarray(lists.flatten(), float), np.diff(ends)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                where, cell, home = np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool)
                if dim in centres:
                    own, may = _open_cells(_units(values[ends[at][:, None] + np.arange(dim)]), centres[dim], threshold)
                    where, cell = np.nonzero(may)
                    home = cell == own[where]
                some = batch.take(pa.array(at[where]))
                columns = [pa.array(np.full(len(where), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home)]
                yield pa.RecordBatch.from_arrays([*columns, *some.columns], names=["dim", "cell", "home", "cls", "copies", "v"])

    return classes.select("cls", "copies", "v").mapInArrow(place, PLACED)


def _tiles(placed: DataFrame) -> DataFrame:
    """Tiles of one cell and kind each. A cell of any size is spread over tasks by the hash in the range."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def tile(key: tuple) -> pa.RecordBatch:
            cls, copies, data = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            codes, scale, error = quantised(_units(data))
            if (data.astype(np.float32) == data).all():  # half the bytes, and the same values
                data = data.astype(np.float32)
            row = [*key, int(cls[0]), len(cls), *[x.tobytes() for x in (cls, copies, codes, scale, error, data)]]
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            names = [f.split()[0] for f in TILE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            dim, cell, home, cls, copies = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(5))
            lists = batch.column(5)
            start = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            values = np.asarray(lists.flatten(), float)
            keys = np.stack([dim, cell, home.astype(int)], axis=1)
            for d, c, h in np.unique(keys, axis=0).tolist():
                key, rows = (d, c, bool(h)), max(1, min(TILE_ROWS, TILE_VALUES // max(d, 1)))
                at = np.flatnonzero((keys == (d, c, h)).all(1))
                for low in range(0, len(at), rows):
                    some = at[low : low + rows]
                    held.setdefault(key, []).append((cls[some], copies[some], values[start[some][:, None] + np.arange(d)]))
                    if sum(len(x[0]) for x in held[key]) >= rows:
                        yield tile(key)
            for key in [k for k in held if k != tuple([*keys[-1][:2].tolist(), bool(keys[-1][2])])]:
                yield tile(key)  # rows come sorted, so this cell and kind is over
        for key in list(held):
            yield tile(key)

    dealt = placed.repartitionByRange("dim", "cell", "home", F.xxhash64("cls")).sortWithinPartitions("dim", "cell", "home")
    return dealt.mapInArrow(pack, TILE)


def _tile(row: dict) -> dict:
    kind = np.float32 if len(row["data"]) == 4 * row["n"] * row["dim"] else float
    data = np.frombuffer(row["data"], kind).reshape(row["n"], row["dim"]).astype(float)
    codes = np.frombuffer(row["codes"], np.int8).reshape(row["n"], row["dim"])
    return {
        "n": row["n"], "unit": _units(data), "cls": np.frombuffer(row["cls"], np.int64), "copies": np.frombuffer(row["copies"], np.int64),
        "codes": (codes, np.frombuffer(row["scale"], float), np.frombuffer(row["error"], float)),
    }


def _block_links(tiles: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, who, links): links that join, and how many vectors a vector at home links with, over tiles of two blocks.

    Pairs of tiles within one block are left to the task that has this block alone.
    """
    ends, counts = [], []
    for x, one in enumerate(tiles):
        for two in tiles[x:]:
            if not (one["home"] or two["home"]) or (one["own"] == two["own"]) != (one["i"] == one["j"]):
                continue
            i, j = linked(one, two, threshold)
            ends.append(forest(i, j, one["cls"], two["cls"]))
            if one["home"]:
                counts.append((one["cls"], np.bincount(i, two["copies"][j], one["n"])))
            if two["home"] and one is not two:
                counts.append((two["cls"], np.bincount(j, one["copies"][i], two["n"])))
    join = lambda parts, k: np.concatenate([np.empty(0, np.int64), *[p[k].astype(np.int64) for p in parts]])
    who, links = join(counts, 0), join(counts, 1)
    who, at = np.unique(who, return_inverse=True)
    links = np.bincount(at, links, len(who)).astype(np.int64)
    return join(ends, 0), join(ends, 1), who[links > 0], links[links > 0]


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, null): links that join; (a, null, links): how many vectors a links with."""

    def found(tiles: list[dict]) -> pa.RecordBatch:
        a, b, who, links = _block_links(tiles, threshold)
        nulls = lambda n: pa.nulls(n, pa.int64())
        columns = [pa.concat_arrays([pa.array(a), pa.array(who)]), pa.concat_arrays([pa.array(b), nulls(len(who))]), pa.concat_arrays([nulls(len(a)), pa.array(links)])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                key = (row["dim"], row["cell"], row["i"], row["j"])
                if key != at and held:
                    yield found(held)
                    held = []
                at = key
                held.append(_tile(row) | {k: row[k] for k in ("home", "own", "i", "j")})
        if held:
            yield found(held)

    # blocks of a cell by the hash of a tile's number; there are at most MOST_CELLS cells for each length
    blocks = tiles.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_TILES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("part", "home"), F.col("blocks")).cast("int")
    dealt = tiles.join(blocks, ["dim", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")
    return dealt.repartition("dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j", "part", "home").mapInArrow(compare, FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; one row for every row.

    Two vectors link when their cosine in double precision is at least the threshold (above
    0). n_links counts the other rows that a row links with, equal vectors among them;
    component_id is the least vec_id that links reach, its own included.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing; vectors of different lengths don't link. Equal vectors are one class, so
    a vector with a third of all rows is compared once. Null ids keep their rows and are a component_id
    only where there is no other; kept then holds. Repeated rows link with each other. An
    empty table gives an empty result. Other columns are not looked at, whatever their names.
    """
    full = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    sound = is_sound() & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id"), F.when(sound, full).alias("v"))
    # equal vectors have one key, 128 bits of their components
    keys = {k: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v")) for k, seed in (("k1", 1), ("k2", 77))}
    grouped = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(grouped.withColumns({**keys, "cls": F.monotonically_increasing_id()}), "classes")
    many, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    cells = min(MOST_CELLS, -(-many // CELL_ROWS))
    tiles = written(_tiles(_placed(classes, _centres(classes, cells, longest or 1, threshold), threshold)), "tiles")
    with batches_of(vectors.sparkSession, 4):  # a row holds a tile
        found = written(_links(tiles, threshold), "links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    known = classes.select(F.col("cls").alias("node"), "copies", "least", "k1", "k2").join(counts, "node", "left")
    within = known.join(parts, "node")
    least = within.groupBy("component").agg(F.min("least").alias("component_id"))
    # a large component is one key: its rows are dealt to SALT parts, and its id goes to each
    salted = within.withColumn("_salt", F.pmod(F.col("k1"), F.lit(SALT)))
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    links = (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    placed = salted.join(spread, ["component", "_salt"]).select("k1", "k2", links, "component_id")
    placed = placed.unionByName(known.join(parts, "node", "left_anti").select("k1", "k2", links, F.col("least").alias("component_id")))
    # rows meet their class by its key: no vector is moved a second time
    out = rows.select("vec_id", *[c.alias(k) for k, c in keys.items()]).join(placed.withColumn("placed", F.lit(True)), ["k1", "k2"], "left")
    component = F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
