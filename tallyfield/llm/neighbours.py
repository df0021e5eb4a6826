"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with a scale and an exact error norm each. The products of the codes of a tile of queries and a tile of
candidates are whole numbers and exact; scales and error norms turn them into bounds, and only pairs whose upper bound reaches a
query's k-th best score are computed again in double precision and pushed on the query's heap. So nothing is lost: what is found is exact.

Data is moved late. A query's score over a bounded sample is a first floor. Candidates stand in tiles by
the pivot they are nearest to, each with its centre and radius, and a tile goes to a tile of queries only where centre and
radius leave room above one of the floors; those tables of centres are small and are compared first. Tiles come to a task one by one, the most
promising first, so the floors rise early; heaps of different tasks meet in one ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, written
from .tiles import is_sound, sampled, tiles, unpacked
from .topk import distances, far_pivots
from .vector_links import code_products, cosines

#: Vectors and components in a tile of candidates at most, and in a tile of queries.
TILE_ROWS = 4096
QUERY_ROWS = 1024
TILE_VALUES = 2**19
#: The sample that pivots and first floors come of: rows and components at most. Results don't depend on it.
SAMPLE = 4096
SAMPLE_VALUES = 2**21
PIVOTS = 256
#: Tiles of candidates that one task visits for a tile of queries, and centres that are compared at once.
SHELF_TILES = 16
CENTRE_ROWS = 2048
#: Pairs that are computed again at a time.
STEP = 500_000
BOUNDED = "tile long, dim int, n int, ids binary, data binary, codes binary, scale binary, error binary, norm binary"
FOUND = "query_id long, vec_id long, score double, tiles long, products long, again long"


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what the codes miss, of vectors in rows."""
    scale = np.maximum(np.abs(x).max(1, initial=0) / 127, 1e-300)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, _norms(x - codes * scale[:, None]) * (1 + 1e-9)


class Tile:
    """Vectors with their codes and what bounds the codes' products."""

    def __init__(self, row: dict):
        self.n, self.ids = row["n"], np.frombuffer(row["ids"], np.int64)
        kind = np.float32 if len(row["data"]) == 4 * row["n"] * row["dim"] else float
        self.x = np.frombuffer(row["data"], kind).reshape(row["n"], row["dim"]).astype(float)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(row["n"], row["dim"])
        self.scale, self.error, self.norm = (np.frombuffer(row[k], float) for k in ("scale", "error", "norm"))


def possible(q: Tile, low: int, high: int, c: Tile, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the rows low..high of a query tile and rows of a tile whose product may reach the query's floor.

    With q = q' + e and x = x' + f the product is q'x' + q'f + ex' + ef, |q'| <= |q| + |e|. The largest errors and norms
    of the tile bound a whole row of pairs at once; what is left is held against its own errors.
    """
    s, e, own = q.scale[low:high], q.error[low:high], q.norm[low:high]
    room = lambda e, own, f, norm: (own + e) * f + e * (norm + f) + e * f + 1e-9 * own * norm
    near = code_products(q.codes[low:high], c.codes)
    with np.errstate(all="ignore"):
        bound = floors[low:high] - room(e, own, c.error.max(), c.norm.max())
        least = bound / (s * np.where(bound > 0, c.scale.max(), c.scale.min()))
        # rounded down, so that single precision loses none
        i, j = np.nonzero(~(near < (least - np.abs(least) * 1e-6).astype(np.float32)[:, None]))
        reach = near[i, j] * s[i] * c.scale[j] + room(e[i], own[i], c.error[j], c.norm[j])
        left = ~(reach < floors[low:high][i])
    return i[left] + low, j[left]


class Heaps:
    """The k best of each query so far: the heap's first is the worst, of equal scores that with the largest id."""

    def __init__(self, queries: Tile, floors: np.ndarray, k: int):
        self.q, self.k, self.floors = queries, k, floors.copy()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(queries.n)]
        self.columns = np.ascontiguousarray(queries.x.T)
        self.tiles = self.products = self.again = 0

    def visit(self, c: Tile) -> None:
        columns = np.ascontiguousarray(c.x.T)
        self.tiles += 1
        for low in range(0, self.q.n, 512):
            high = min(low + 512, self.q.n)
            i, j = possible(self.q, low, high, c, self.floors)
            self.products += (high - low) * c.n
            for at in range(0, len(i), STEP):
                self._push(i[at : at + STEP], j[at : at + STEP], c.ids, columns)

    def _push(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        self.again += len(i)
        with np.errstate(all="ignore"):
            scores = cosines(self.columns, columns, i, j)
        scores = np.where(np.isnan(scores), -np.inf, scores)
        good = (scores >= self.floors[i]) & (self.q.ids[i] != ids[j])
        i, scores, ids = i[good], scores[good], ids[j[good]]
        for row, score, vec in zip(i.tolist(), scores.tolist(), ids.tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        for row in np.unique(i).tolist():
            if len(self.heaps[row]) == self.k:
                self.floors[row] = max(self.floors[row], self.heaps[row][0][0])

    def rows(self) -> pa.RecordBatch:
        found = [(q, -v, s, None, None, None) for q, heap in zip(self.q.ids.tolist(), self.heaps, strict=True) for s, v in heap]
        found.append((None, None, None, self.tiles, self.products, self.again))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])


def _placed(own: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Vectors dealt out by length, nearest pivot and the distance to it, so that a tile holds what lies together."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
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

    kind = "id long, copies int, v array<double>, dim int, nearest int, far double"
    near = own.select("id", F.lit(1).alias("copies"), "v").mapInArrow(place, kind)
    return near.repartitionByRange("dim", "nearest", "far", F.xxhash64("id")).sortWithinPartitions("dim", "nearest", "far").select("id", "copies", "v")


def _bounded(tiled: DataFrame) -> DataFrame:
    """tiles with codes, scales, errors and norms; the vectors in single precision where that is the same."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BOUNDED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            for row in batch.to_pylist():
                _, _, x = unpacked(row)
                codes, scale, error = quantised(x)
                single = x.astype(np.float32)
                data = single if (single == x).all() else x
                cells = [row["tile"], row["dim"], row["n"], row["ids"], *[a.tobytes() for a in (data, codes, scale, error, _norms(x) * (1 + 1e-12))]]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return tiled.mapInArrow(work, BOUNDED)


def _with_floors(queries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Tiles of queries with floors: scores that k candidates of the sample reach, or minus infinity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for q in map(Tile, batch.to_pylist()):
                ids, x = sample.get(q.x.shape[1], (np.empty(0, np.int64), np.zeros((0, q.x.shape[1]))))
                with np.errstate(all="ignore"):
                    scores = q.x @ x.T
                    scores[(q.ids[:, None] == ids[None]) | np.isnan(scores)] = -np.inf
                    floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(q.n, -np.inf)
                    floor = floor - 1e-9 * q.norm * _norms(x).max(initial=0)  # products are added up in another order here
                floors.append(np.where(np.isnan(floor), -np.inf, floor).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary())], names=[*batch.schema.names, "floors"])

    return queries.mapInArrow(work, f"{BOUNDED}, floors binary")


def _centres(candidates: DataFrame) -> DataFrame:
    """tile, dim, centre, radius of every tile of candidates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                x = Tile(row).x
                centre = x.mean(0)
                radius = float(_norms(x - centre).max()) * (1 + 1e-9)
                rows.append((row["tile"], row["dim"], centre.tolist(), radius))
            tile, dim, centre, radius = zip(*rows, strict=True)
            columns = [pa.array(tile, pa.int64()), pa.array(dim, pa.int32()), pa.array(centre, pa.list_(pa.float64())), pa.array(radius, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "dim", "centre", "radius"])

    return candidates.mapInArrow(work, "tile long, dim int, centre array<double>, radius double")


def _open_pairs(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """q_tile, tile, reach: the pairs of tiles in which a candidate may reach a floor, by centre and radius alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, floors = Tile(row), np.frombuffer(row["floors"], float)
                centre, radius = np.array([c["centre"] for c in row["centres"]]), np.array([c["radius"] for c in row["centres"]])
                with np.errstate(all="ignore"):
                    reach = q.x @ centre.T
                    reach = reach + q.norm[:, None] * radius + 1e-9 * q.norm[:, None] * (radius + _norms(centre))
                    gap = (reach - np.where(np.isfinite(floors), floors, 0)[:, None]).max(0)
                    at = np.flatnonzero(~(reach < floors[:, None]).all(0))
                columns = [pa.array(np.full(len(at), row["tile"])), pa.array([row["centres"][i]["tile"] for i in at.tolist()], pa.int64()), pa.array(gap[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["q_tile", "tile", "reach"])

    # a shelf of centres has a fixed size, and so has a tile of queries
    shelf = F.floor(F.col("no") / F.greatest(F.lit(1), F.least(F.lit(CENTRE_ROWS), F.floor(F.lit(TILE_VALUES) / F.greatest(F.col("dim"), F.lit(1))))))
    numbered = centres.withColumn("no", F.col("tile").bitwiseAND(2**32 - 1)).withColumn("shelf", F.struct(F.shiftright("tile", 32 + 6), shelf))
    shelves = numbered.groupBy("dim", "shelf").agg(F.collect_list(F.struct("tile", "centre", "radius")).alias("centres"))
    rows = queries.join(shelves, "dim").select(*queries.columns, "centres")
    return rows.mapInArrow(work, "q_tile long, tile long, reach double")


def _search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """FOUND rows: the k best of each query over each shelf of tiles, and a row for each shelf that says how much was looked at."""
    spark = vectors.sparkSession
    sound = vectors.where(F.col("vec_id").isNotNull() & is_sound() & F.exists("embedding", lambda x: x != 0))
    own = written(sound.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")), "vectors")
    sample = sampled(own, SAMPLE, SAMPLE_VALUES)
    pivots = {dim: far_pivots(x, min(PIVOTS, max(1, TILE_VALUES // dim))) for dim, (_, x) in sample.items()}
    asked = own.where("q").groupBy("id").agg(F.min("v").alias("v")).select("id", F.lit(1).alias("copies"), "v")
    asked = asked.repartition(max(1, -(-own.where("q").count() // QUERY_ROWS)))
    with batches_of(spark):
        candidates = written(_bounded(tiles(_placed(own, pivots), TILE_ROWS, TILE_VALUES)), "candidates")
        queries = written(_with_floors(_bounded(tiles(asked, QUERY_ROWS, TILE_VALUES)), sample, k), "queries")
    with batches_of(spark, 4):
        centres = written(_centres(candidates), "centres")
    with batches_of(spark, 1):  # a row holds a tile and a shelf of centres
        pairs = written(_open_pairs(queries, centres), "pairs")

    # tiles of a tile of queries are dealt to shelves by their hash; a shelf is one task's work
    shelves = pairs.groupBy("q_tile").agg(F.ceil(F.count("*") / SHELF_TILES).cast("int").alias("shelves"))
    dealt = pairs.join(shelves, "q_tile").withColumn("shelf", F.pmod(F.xxhash64("tile"), F.col("shelves")).cast("int"))
    theirs = dealt.select("q_tile", "shelf", "reach", "tile").join(candidates, "tile").withColumn("floors", F.lit(None).cast("binary"))
    mine = queries.withColumnRenamed("tile", "q_tile").join(shelves, "q_tile").withColumn("shelf", F.explode(F.expr("sequence(0, shelves - 1)")))
    mine = mine.withColumns({"tile": F.col("q_tile"), "reach": F.lit(float("inf"))})
    columns = ["q_tile", "shelf", "reach", *candidates.columns, "floors"]
    work = mine.select(columns).unionByName(theirs.select(columns))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["floors"] is None:
                    heaps.visit(Tile(row))
                    continue
                if heaps:
                    yield heaps.rows()
                heaps = Heaps(Tile(row), np.frombuffer(row["floors"], float), k)
        if heaps:
            yield heaps.rows()

    ordered = work.repartition("q_tile", "shelf").sortWithinPartitions("q_tile", "shelf", F.col("floors").isNull(), F.desc("reach"), "tile")
    with batches_of(spark, 4):
        return written(ordered.mapInArrow(search, FOUND), "found")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k nearest of every query row, exactly.

    Nearest is the largest inner product in double precision, added up component by component. Candidates are all rows but those of the
    query's own id, and of its length.

    Null ids, and vectors that are null, empty, zero or hold a null or non-finite component take no part. Repeated rows take
    part as often as they occur; a query whose id repeats is asked once, with its least vector. Ties go to the smaller id. A sum
    that leaves what doubles hold is infinite, and where it is no number it counts as least. Fewer candidates than k are all
    returned; an empty table gives an empty result. Other columns are not looked at, whatever their names.
    """
    found = _search(vectors, is_query, k).where("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def work_done(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """One row: tiles that were moved to tiles of queries, products of codes, and products computed again."""
    return _search(vectors, is_query, k).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tiles", "products", "again")])
