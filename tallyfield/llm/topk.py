"""Exact top-k search by inner product with pivot-table elimination.

The pivot table, distances from every vector to pivots far from each other, is worked out once and kept beside the vectors. For a
query, the largest difference of distances to a common pivot is a lower bound on the
distance to a candidate, hence |q|^2 + |x|^2 - bound^2, halved, is an upper bound on the
inner product. Candidates stand in tiles ordered by their nearest pivot and its distance; the least and greatest distance of a tile
to each pivot bound all of it at once.

A first pass over the pivots' sample gives every query a score that k candidates reach, so its k-th score is no less. What bounds whole
tiles, a few hundred bytes each, is held against those scores before any vector moves: a tile of candidates goes to a tile of queries
only where one of them may find something in it. Tiles come to a task one by one, the most promising first, with the k best so far carried
from tile to tile, and candidates of a tile are evaluated in the order of their bounds. What lies below a query's k-th score is passed over, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, written
from .tiles import is_sound, sampled, tiles, unpacked

SCALE = 1024
#: Pivots for each length of vector, and the candidates that they are chosen from and that give first scores.
PIVOTS = 64
SAMPLE = 4096
#: Pivots that are looked at for all candidates of a tile; the others only for those that are left.
FIRST_PIVOTS = 8
#: Components of the sample, and of a tile, at most.
SAMPLE_VALUES = 2**21
TILE_VALUES = 2**19
#: Vectors in a tile of candidates, tiles that one task visits for a tile of queries, and queries in a tile of theirs.
TILE_ROWS = 4096
SHELF_TILES = 16
QUERY_ROWS = 1024
#: Tiles whose bounds are held against a tile of queries at a time.
BOUND_ROWS = 2048
#: Candidates of a query that are evaluated at a time.
STEP = 256
FOUND = "query_id long, vec_id long, score long, visited long, evaluated long"


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def far_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each farthest from those before it."""
    if not len(sample):
        return sample
    taken, near = [0], distances(sample, sample[:1])[:, 0]
    while len(taken) < min(n, len(sample)):
        far = int(near.argmax())
        if near[far] <= 0:
            break
        taken.append(far)
        near = np.minimum(near, distances(sample, sample[far : far + 1])[:, 0])
    return sample[taken]


def upper_bounds(q: np.ndarray, q_table: np.ndarray, squares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner products of one query with candidates, from pivot distances alone, with room for rounding."""
    own = float(q @ q)
    near = np.abs(table - q_table).max(1, initial=0)
    return _bound(own, squares, near)


def _bound(own: float, squares: np.ndarray, near: np.ndarray) -> np.ndarray:
    # distances are rounded by less than this: square roots of sums that are off by some 1e-15 of their terms
    room = 1e-6 * (1 + own**0.5 + squares**0.5)
    half = (own + squares - np.maximum(near - room, 0) ** 2) / 2
    return half + 1e-9 * np.abs(half) + 1e-3


class Tile:
    """Candidates with their part of the pivot table, and what bounds all of them at once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray):
        self.ids, self.x, self.table = ids, x, table
        self.squares = (x * x).sum(1)
        self.low, self.high = table.min(0, initial=np.inf), table.max(0, initial=-np.inf)
        self.most = float(self.squares.max(initial=0))

    def bound(self, q: np.ndarray, q_table: np.ndarray) -> float:
        """No product of q with a candidate of this tile is above it."""
        gap = float(np.maximum(self.low - q_table, q_table - self.high).max(initial=0))
        own = float(q @ q)
        # a candidate is as far from q as its norm differs, and as its pivot distances say
        return float(min(_bound(own, np.array([self.most]), np.array([gap]))[0], (own * self.most) ** 0.5 * (1 + 1e-9) + 1e-3))


class Asked:
    """A tile of queries with the k best of each so far, as (-score, id) in order, and their floors: scores that k candidates are known to reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, table: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.q, self.table, self.floors, self.k = ids, q, table, floors.copy(), k
        self.top: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.visited, self.evaluated = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def visit(self, tile: Tile) -> None:
        for i in range(len(self.ids)):
            if tile.bound(self.q[i], self.table[i]) >= self.floors[i]:
                self.visited[i] += 1
                self._look(i, tile)

    def _look(self, i: int, tile: Tile) -> None:
        """Candidates of a tile for one query, in the order of their bounds."""
        q, floor = self.q[i], self.floors[i]
        left = np.flatnonzero(tile.ids != self.ids[i])
        for pivots in (slice(0, FIRST_PIVOTS), slice(None)):
            bound = upper_bounds(q, self.table[i][pivots], tile.squares[left], tile.table[left, pivots])
            left = left[bound >= floor]
            bound = bound[bound >= floor]
        small = (float(q @ q) * tile.most) ** 0.5 < 2.0**52
        while len(left) and bound.max() >= floor:
            step = min(STEP, len(left))
            if step < len(left):
                split = np.argpartition(-bound, step - 1)
                now, left, bound = left[split[:step]], left[split[step:]], bound[split[step:]]
            else:
                now, left, bound = left, left[:0], bound[:0]
            # whole numbers below 2**53 in doubles are exact; others are added up as integers
            scores = tile.x[now] @ q if small else tile.x[now].astype(np.int64) @ q.astype(np.int64)
            self.evaluated[i] += len(now)
            good = scores >= floor
            if good.any():
                found = zip((-scores[good].astype(np.int64)).tolist(), tile.ids[now][good].tolist(), strict=True)
                self.top[i] = sorted([*self.top[i], *found])[: self.k]
                if len(self.top[i]) == self.k:
                    floor = max(floor, -self.top[i][-1][0])
        self.floors[i] = floor

    def rows(self) -> pa.RecordBatch:
        found = [(q, c, -s, None, None) for q, top in zip(self.ids.tolist(), self.top, strict=True) for s, c in top]
        found += [(q, None, None, v, e) for q, v, e in zip(self.ids.tolist(), self.visited.tolist(), self.evaluated.tolist(), strict=True)]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])


def _table_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(n, -1) if n and len(data) else np.zeros((n, 0))


def _with_table(tiled: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """tiles with the pivot table of their vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for row in batch.to_pylist():
                _, _, x = unpacked(row)
                tables.append(distances(x, pivots.get(row["dim"], np.zeros((0, row["dim"])))).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, pa.binary())], names=[*batch.schema.names, "pivot_table"])

    return tiled.mapInArrow(work, "tile long, dim int, n int, ids binary, copies binary, data binary, pivot_table binary")


def _ordered(own: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Vectors dealt out and sorted by length, nearest pivot and the distance to it, so that a tile's distances lie close together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten(), float)
            dims = np.diff(ends)
            nearest, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    away = distances(values[ends[at][:, None] + np.arange(dim)], pivots[dim])
                    nearest[at], far[at] = away.argmin(1), away.min(1)
            columns = [*batch.columns, pa.array(dims.astype(np.int32)), pa.array(nearest), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "copies", "v", "dim", "nearest", "far"])

    placed = own.select("id", "copies", "v").mapInArrow(work, "id long, copies int, v array<double>, dim int, nearest int, far double")
    return placed.repartitionByRange("dim", "nearest", "far", F.xxhash64("id")).sortWithinPartitions("dim", "nearest", "far").select("id", "copies", "v")


def _first_scores(queries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Tiles of queries with floors: the k-th score of each over the sample, or minus infinity where the sample has fewer candidates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for row in batch.to_pylist():
                q_ids, _, q = unpacked(row)
                ids, x = sample.get(row["dim"], (np.empty(0, np.int64), np.zeros((0, row["dim"]))))
                scores = q @ x.T
                scores[q_ids[:, None] == ids[None]] = -np.inf
                # rounded down where products are beyond what doubles hold
                floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
                floors.append((floor - np.where(np.abs(floor) > 2.0**52, np.abs(floor) * 1e-9, 0)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary())], names=[*batch.schema.names, "floors"])

    columns = "tile long, dim int, n int, ids binary, copies binary, data binary, pivot_table binary, floors binary"
    return queries.mapInArrow(work, columns)


def _tile(row: dict) -> Tile:
    ids, _, x = unpacked(row)
    return Tile(ids, x, _table_of(row["pivot_table"], len(x)))


def _tile_bounds(candidates: DataFrame) -> DataFrame:
    """tile, dim, low, high, most: what bounds all candidates of a tile at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["tile"], r["dim"], t.low.tolist(), t.high.tolist(), t.most) for r in batch.to_pylist() for t in [_tile(r)]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "dim", "low", "high", "most"])

    return candidates.mapInArrow(work, "tile long, dim int, low array<double>, high array<double>, most double")


def _open_pairs(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """q_tile, tile, reach: the pairs of tiles in which a query may still find something; no vector of a candidate is looked at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, q = unpacked(row)
                table, floors, tiles_of = _table_of(row["pivot_table"], len(q)), np.frombuffer(row["floors"], float), row["bounds"]
                low, high = (np.array([t[k] for t in tiles_of]).reshape(len(tiles_of), -1) for k in ("low", "high"))
                most, reach = np.array([t["most"] for t in tiles_of]), np.full(len(tiles_of), -np.inf)
                for i in range(len(q)):
                    gap = np.maximum(low - table[i], table[i] - high).max(1, initial=0)
                    own = float(q[i] @ q[i])
                    bound = np.minimum(_bound(own, most, gap), (own * most) ** 0.5 * (1 + 1e-9) + 1e-3)
                    reach = np.maximum(reach, np.where(bound >= floors[i], bound - max(floors[i], -1e300), -np.inf))
                at = np.flatnonzero(reach > -np.inf)
                columns = [pa.array(np.full(len(at), row["tile"])), pa.array([tiles_of[t]["tile"] for t in at.tolist()], pa.int64()), pa.array(reach[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["q_tile", "tile", "reach"])

    # a shelf of bounds has a fixed size: tiles that follow each other in one partition of the table
    shelf = F.struct(F.shiftright("tile", 32 + 6), F.floor(F.col("tile").bitwiseAND(2**32 - 1) * 64 / BOUND_ROWS))
    shelves = bounds.groupBy("dim", shelf.alias("shelf")).agg(F.collect_list(F.struct("tile", "low", "high", "most")).alias("bounds"))
    return queries.join(shelves, "dim").select(*queries.columns, "bounds").mapInArrow(work, "q_tile long, tile long, reach double")


def _search(vectors: DataFrame, is_query: Column, k: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """FOUND rows: the best of each query in each shelf, and a row for each query and shelf that says how much was looked at; and the pairs of tiles that were moved."""
    spark = vectors.sparkSession
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    sound = vectors.where(F.col("vec_id").isNotNull() & is_sound())
    own = written(sound.select(F.col("vec_id").alias("id"), F.lit(1).alias("copies"), whole.alias("v"), is_query.alias("q")), "vectors")
    # pivots and first scores come of a sample; the results don't depend on it
    sample = sampled(own, SAMPLE, SAMPLE_VALUES)
    pivots = {dim: far_pivots(x, PIVOTS) for dim, (_, x) in sample.items() if dim}
    with batches_of(spark):
        candidates = written(_with_table(tiles(_ordered(own, pivots), TILE_ROWS, TILE_VALUES), pivots), "candidates")
        asked = tiles(own.where("q").drop("q").dropDuplicates(["id", "v"]), QUERY_ROWS, TILE_VALUES)
        queries = written(_first_scores(_with_table(asked, pivots), sample, k), "queries")
    with batches_of(spark, 4):
        bounds = written(_tile_bounds(candidates), "bounds")
    with batches_of(spark, 1):  # a row holds a tile and a shelf of bounds
        pairs = written(_open_pairs(queries, bounds), "pairs")

    # the tiles of a tile of queries are dealt to shelves by their hash; a shelf is one task's work
    shelves = pairs.groupBy("q_tile").agg(F.ceil(F.count("*") / SHELF_TILES).cast("int").alias("shelves"))
    dealt = pairs.join(shelves, "q_tile").withColumn("shelf", F.pmod(F.xxhash64("tile"), F.col("shelves")).cast("int"))
    columns = ["q_tile", "shelf", "reach", "tile", "dim", "n", "ids", "data", "pivot_table", "floors"]
    theirs = dealt.select("q_tile", "shelf", "reach", "tile").join(candidates, "tile").withColumn("floors", F.lit(None).cast("binary"))
    mine = queries.withColumnRenamed("tile", "q_tile").join(shelves, "q_tile").withColumn("shelf", F.explode(F.expr("sequence(0, shelves - 1)")))
    mine = mine.withColumns({"tile": F.col("q_tile"), "reach": F.lit(float("inf"))})
    work = mine.select(columns).unionByName(theirs.select(columns))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["floors"] is None:
                    now.visit(_tile(row))
                    continue
                if now:
                    yield now.rows()
                ids, _, q = unpacked(row)
                now = Asked(ids, q, _table_of(row["pivot_table"], len(q)), np.frombuffer(row["floors"], float), k)
        if now:
            yield now.rows()

    ordered = work.repartition("q_tile", "shelf").sortWithinPartitions("q_tile", "shelf", F.col("floors").isNull(), F.desc("reach"), "tile")
    with batches_of(spark, 4):
        return written(ordered.mapInArrow(search, FOUND), "found"), pairs


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k best of every query row.

    Components become floor(scale * x); the score is the integer inner product and must
    fit a long. Candidates are all rows but those of the query's own id, and of its length.

    Null ids, null vectors and vectors with a null or non-finite component take no part. Empty vectors take part with
    each other, at a score of 0. Repeated rows take part as often as they occur, queries once. Ties go to the smaller
    id. Fewer candidates than k are all returned; an empty table gives an empty
    result. Other columns are not looked at, whatever their names.
    """
    found = _search(vectors, is_query, k, scale)[0].where("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def work_done(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """One row: pairs of tiles that were moved, tiles that queries visited and candidates that they evaluated, the rest being eliminated by bounds."""
    found, pairs = _search(vectors, is_query, k, scale)
    looked = found.agg(F.sum("visited").alias("visited"), F.sum("evaluated").alias("evaluated"))
    return looked.crossJoin(pairs.agg(F.count("*").alias("moved")))  # one row each
