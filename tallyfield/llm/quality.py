"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, and only the bag has a label. Every passage is encoded;
gated attention, a softmax over passages of w . (tanh(V h) * sigmoid(U h)), weighs the encodings;
the weighted sum gives the score. Encoder, attention and output are learned together from the
labels of documents, by gradient descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, forget, written

#: Bytes of a passage; a word counts for the passage where it starts.
PASSAGE = 512
#: Most labelled documents that are learned from, each with all its passages, and most bytes of their passages' features (200 a passage).
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 2**26
HIDDEN, GATES, EPOCHS, BATCH, SEED = 24, 12, 40, 64, 42
THRESHOLD = 0.7
#: The classes of bytes that are counted, other bytes by their kind.
MARKS = ".,;:!?'\"-_/\\|#$%&*+=<>@~^()[]{}"


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    kinds = [range(97, 123), range(65, 91), range(48, 58), (32,), (10,), (9, 11, 12, 13), range(128, 192), range(192, 256)]
    for i, kind in enumerate(kinds):
        table[list(kind)] = i + 1
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = i + 1 + len(kinds)
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
LAGS = 4
FEATURES = N_CLASSES + 5 + LAGS + 1


def passage_features(data: np.ndarray) -> np.ndarray:
    """A row of features for each passage of one piece of text: shares of byte classes, shapes of words, repeats."""
    n = -(-len(data) // PASSAGE)
    kinds = CLASSES[data]
    owner = np.arange(len(data)) // PASSAGE
    counts = np.bincount(owner * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = counts.sum(1, keepdims=True)
    space = (kinds >= 4) & (kinds <= 6)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    home = owner[starts] if len(starts) else starts
    words = np.maximum(np.bincount(home, minlength=n), 1)
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(home, x, n) / words
    mean = per(length)
    first, last = kinds[starts], kinds[ends - 1]
    # words with equal ends, length and sum of bytes pass as equal
    total = np.concatenate([[0], np.cumsum(data.astype(np.int64) ** 2)])
    key = ((total[ends] - total[starts]) * 512 + np.minimum(length, 511).astype(np.int64)) * 65536 + data[starts].astype(np.int64) * 256 + data[ends - 1]
    repeats = []
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(key))
        same[lag:] = key[lag:] == key[:-lag]
        repeats.append(per(same))
    shape = [mean / 10, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 10, words / 100, per(first == 2), per(last > 8)]
    return np.column_stack([counts / size, *shape, *repeats, np.ones(n)]).astype(np.float32)


def encoded(text: bytes | None) -> np.ndarray:
    """Features of every passage of a whole text; an empty text is one passage without any."""
    if not text:
        return np.zeros((1, FEATURES), np.float32)
    data = np.frombuffer(text, np.uint8)
    step = PASSAGE * 2048
    return np.concatenate([passage_features(data[i : i + step]) for i in range(0, len(data), step)])


class Model:
    """Weights of encoder (W, b), gated attention (V, U, w) and output (o, c)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.mean, self.spread = mean, spread
        self.p = {
            "W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES),
            "w": init(GATES, 1)[:, 0], "o": init(HIDDEN, 1)[:, 0], "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: passages of several bags, one after another; starts: the first passage of each bag."""
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return score, (x, h, v, u, a, z, size)

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (x, h, v, u, a, z, size) = self.forward(x, starts)
        d = (score - label) / len(label)
        dz = np.repeat(d[:, None] * p["o"], size, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "o": z.T @ d, "c": d.sum(keepdims=True),
        }


def fitted(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model learned from bags of passages and their labels by Adam; without bags it scores one half or so for all."""
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    model = Model(every.mean(0), every.std(0) + 0.01, seed)
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs if bags else 0):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            x = np.concatenate([bags[i] for i in some]).astype(float)
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])[:-1]])
            step += 1
            for k, g in model.gradients(x, starts, labels[some]).items():
                g = g + 1e-4 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of at most `most` labelled documents, chosen by a hash of their ids: of those, the first whose bags hold SAMPLE_BYTES at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("y")).where("low = y")
    some = one.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most).select(F.col("doc_id").alias("labelled"), "y")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bags = [encoded(text).tobytes() for text in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "bag"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    # the sample has `most` rows at most, each two numbers
    mine = docs.select(F.col("doc_id"), text).join(F.broadcast(some), F.col("doc_id") == F.col("labelled"))
    rows = mine.select("doc_id", F.col("y").cast("long"), "text").mapInArrow(batches, "doc_id long, y long, bag binary")
    kept = written(rows.orderBy("doc_id", "bag").limit(most), "bags")
    # the sample has `most` rows at most: their sizes, without the bags, are added up in one task
    sizes = kept.select("doc_id", F.octet_length("bag").alias("size")).groupBy("doc_id").agg(F.sum("size").alias("size"))
    so_far = Window.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = sizes.withColumn("held", F.sum("size").over(so_far)).where(F.col("held") <= SAMPLE_BYTES).select("doc_id")
    found = kept.join(F.broadcast(within), "doc_id", "left_semi").orderBy("doc_id", "bag").collect()
    forget(kept)
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found]
    return bags, np.array([r["y"] for r in found], float)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled rows of docs that are not held out, `most` of them at most."""
    with batches_of(docs.sparkSession):
        return fitted(*_sample(docs, labels, label, most))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, written: a row for every row.

    Documents are scored one by one: in products of several at once, the last bits of a score would depend on its neighbours.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                scores[i] = model.forward(encoded(text.as_py()), np.array([0]))[0][0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    with batches_of(docs.sparkSession):
        return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(batches, "doc_id long, score double"), "scores")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, labels (doc_id, quality) -> doc_id, held_out, score, predicted; one row for every row of docs.

    score: 0 to 1, higher where label 1 is likelier; predicted: 1 from the threshold on. The
    text alone decides a score. Null and empty texts are scored as a bag of one empty passage. Very
    long texts have all their passages scored. Labels that are null, neither 0 nor 1, or that disagree
    for one id are not learned from; without any label all scores come from the untrained model. A null id
    is not held out. Repeated rows have equal scores. An empty table gives an empty result. Other columns are not looked at.
    """
    return scored(docs, learned(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, written.

    Null and empty texts are scored as a bag of one empty passage, very long ones with all their passages. Repeated rows
    are accepted or rejected alike; ties with the threshold are accepted. Null ids are no matter: the text
    alone decides. Columns may have any names. An empty table gives an empty result.
    """
    model = learned(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            good = [model.forward(encoded((t.as_py() or "").encode()), np.array([0]))[0][0] >= threshold for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    with batches_of(docs.sparkSession):
        return written(docs.mapInArrow(keep, docs.schema), "accepted")
