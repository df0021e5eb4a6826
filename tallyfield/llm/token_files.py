"""Token ids in binary files: each document a zstandard frame with one shared dictionary.

A folder holds `dictionary.zdict`, `manifest.json` and shards, named after the range of doc_ids and the number of the shard
in it: a range starts a new shard where the last one has SHARD_BYTES, so the index that a task holds is bounded.
A shard is: 8 bytes of magic, the SHA-256 of the dictionary (zeros without one), the frames one
after the other, then the index (for every document its id, a flag for a null
id, its number of ids, its first byte and its size), and last the index's place, the
number of documents, the width of an id and the magic again. A frame is the ids as little-endian unsigned integers of
2 bytes where the vocabulary fits, else 4. So one document takes two short reads and one small
decompression.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, forget, only, scratch_path, text_of, written
from .tokens import encoder

#: Fixed values of the format.
MAGIC = b"TFIDS001"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i8"), ("at", "<i8"), ("size", "<i8")])
TAIL = struct.Struct("<qqq8s")
END_ID = 2
#: The dictionary's bytes; the documents it is trained on at most, and the bytes of each that are looked at.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 * 1024
LEVEL = 3
#: A shard that has so many bytes of frames, or so many documents, is closed.
SHARD_BYTES = 256 * 2**20
SHARD_DOCS = 1_000_000
FRAMES = "doc_id long, n long, frame binary"


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialized id arrays; where there are too few to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; the same on driver and executors."""
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the file system that Spark finds it in, so that a bare path means the same to driver and executors."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def id_width(tokenizer: str, end_id: int = END_ID) -> int:
    """Bytes of an id: 2 where the vocabulary and the end id fit, else 4."""
    largest = max(encoder(tokenizer, False).tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(largest, end_id) < 2**16 else 4


def _sampled(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> list[bytes]:
    """The first ids of a bounded sample of documents, by a hash of their ids."""
    total = docs.count()
    every = max(1, total // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for batch in it:
            ids = [_narrow(x, end_id, width)[:SAMPLE_BYTES] for x in enc.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    rows = some.select(text_of()).mapInArrow(batches, "ids binary")
    return [r["ids"] for r in rows.limit(SAMPLE_DOCS).collect()]


def _narrow(ids: bytes, end_id: int, width: int) -> bytes:
    return np.append(np.frombuffer(ids, "<u4"), end_id).astype(f"<u{width}").tobytes()


def _frames(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int, width: int) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False)
        for batch in it:
            ids = [_narrow(x, end_id, width) for x in enc.encode(batch.column(1).to_pylist())]
            columns = [pa.array([len(x) // width for x in ids], pa.int64()), pa.array([frames.compress(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "frame"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, FRAMES)


def shard_name(part: int, number: int) -> str:
    return f"shard-{part:05d}-{number:05d}.ids"


def _write_shard(path: str, rows: Iterator[tuple], dictionary: bytes, width: int) -> tuple[int, int]:
    """Write one shard under a name of this attempt, then give it its own; a second attempt replaces it whole.

    Rows are taken until the shard is full.
    """
    store, place = _store(path)
    attempt = f"{place}.{TaskContext.get().taskAttemptId()}"
    index, at = [], len(MAGIC) + 32
    with store.open_output_stream(attempt) as out:
        out.write(MAGIC + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)))
        for doc, n, frame in rows:
            index.append((doc or 0, doc is None, n, at, len(frame)))
            out.write(frame)
            at += len(frame)
            if at >= SHARD_BYTES or len(index) >= SHARD_DOCS:
                break
        out.write(np.array(index, INDEX).tobytes())
        out.write(TAIL.pack(at, len(index), width, MAGIC))
    store.move(attempt, place)
    return len(index), sum(x[2] for x in index)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int | None = None) -> dict:
    """Write the ids of every whole text in ascending doc_id order under path; the manifest is returned.

    path: a folder that driver and executors share. width: bytes of an id, 2 or 4; by default what
    the vocabulary needs. A width that is too small is refused.
    Each text's ids end with end_id. Null and empty texts have that id alone; null ids come first.
    Very long texts are one document of any number of ids. Rows with equal ids, repeated ones among them, stand in any
    order beside each other. Other columns are not looked at, whatever their names. An empty table gives no shard.
    """
    spark = docs.sparkSession
    needed = id_width(tokenizer, end_id)
    width = width or needed
    if width not in (2, 4) or width < needed:
        raise ValueError(f"ids of this tokenizer need {needed} bytes, not {width}")
    path = _qualified(spark, path)
    own = only(docs, "doc_id", "text")
    store, place = _store(path)
    store.create_dir(place, recursive=True)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        while first is not None:
            made = _write_shard(f"{path}/{shard_name(part, number)}", chain([first], rows), dictionary, width)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, *made)], names=["part", "number", "docs", "ids"])
            first, number = next(rows, None), number + 1

    with batches_of(spark, 500):
        dictionary = trained_dictionary(_sampled(own, tokenizer, end_id, width))
        made_frames = written(_frames(own, tokenizer, dictionary, end_id, width), "frames")
        # a row number spreads rows of one id over ranges too
        frames = made_frames.withColumn("row", F.monotonically_increasing_id())
        dealt = frames.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "n", "frame")
        made = sorted(dealt.mapInArrow(shards, "part long, number long, docs long, ids long").collect())  # a row for each shard
    forget(made_frames)
    manifest = {
        "width": width, "end_id": end_id, "dictionary_sha256": hashlib.sha256(dictionary).hexdigest() if dictionary else None,
        "shards": [{"file": shard_name(p, k), "docs": d, "ids": i} for p, k, d, i in made],
    }
    for name, data in (("dictionary.zdict", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with store.open_output_stream(f"{place}/{name}") as out:
            out.write(data)
    return manifest


class Shard:
    """One shard opened for reading: documents by place, without reading the others."""

    def __init__(self, path: str, dictionary: bytes):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no shard")
        if self.file.read_at(32, len(MAGIC)) != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError(f"{path} was written with another dictionary")
        end = self.file.size() - TAIL.size
        start, n, self.width, _ = TAIL.unpack(self.file.read_at(TAIL.size, end))
        self.index = np.frombuffer(self.file.read_at(end - start, start), INDEX, n)
        self.frames = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, place: int) -> np.ndarray:
        x = self.index[place]
        return self._ids(self.file.read_at(int(x["size"]), int(x["at"])), int(x["n"]))

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.frames.decompress(frame, max_output_size=n * self.width), f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place, ids) in order, read in runs of about 4 MB."""
        low = 0
        while low < len(self.index):
            first = int(self.index["at"][low])
            high = max(low + 1, int(np.searchsorted(self.index["at"] + self.index["size"], first + 2**22)))
            data = self.file.read_at(int(self.index["at"][high - 1] + self.index["size"][high - 1]) - first, first)
            for k in range(low, high):
                x = self.index[k]
                at = int(x["at"]) - first
                yield None if x["null"] else int(x["doc_id"]), k, self._ids(data[at : at + int(x["size"])], int(x["n"]))
            low = high


def read_manifest(path: str) -> tuple[dict, bytes]:
    store, place = _store(path)
    with store.open_input_stream(f"{place}/manifest.json") as a, store.open_input_stream(f"{place}/dictionary.zdict") as b:
        return json.load(io.BytesIO(a.read())), b.read()


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The files under path -> doc_id, start (ids of all documents before it), n_tokens, and ids or ids_crc32.

    ids and their crc32 are over little-endian unsigned 32-bit integers. A task reads one shard as a stream.
    """
    path = _qualified(spark, path)
    manifest, dictionary = read_manifest(path)
    start, rows = 0, []
    for s in manifest["shards"]:
        rows.append((s["file"], start))
        start += s["ids"]
    value, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    schema = f"doc_id long, start long, n_tokens long, {value} {kind}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)],
                names=["doc_id", "start", "n_tokens", value],
            )

        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                for doc, _, ids in Shard(f"{path}/{name}", dictionary).documents():
                    held.append((doc, at, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.tobytes()))
                    at += len(ids)
                    size += len(ids)
                    if len(held) >= 1000 or size > 2**22:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    if not rows:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame(rows, "file string, at long").repartition(len(rows), "file")
    return shards.mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """docs -> doc_id, start, n_tokens, ids_crc32 as write_token_files() writes them into the shared folder and read_token_files() reads them.

    A row for every row of docs. Null and empty texts have one id, null ids come first, repeated rows stay, very long texts
    are whole, other columns are not looked at whatever their names, and an empty table gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, digest=True)
