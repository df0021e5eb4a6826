"""Packing by powers of two: every document is cut into binary-length pieces.

A document of n tokens gives n // 4096 pieces of 4096 and one piece for each set bit
of the rest, longest first. Pieces of equal length share a bucket, so a batch taken
from a bucket needs no padding and no attention crosses documents: each
sequence is one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, only, task_count, text_of, written
from .tokens import encoder

LONGEST = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of a document of n tokens, in order."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(
    docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = END_ID, longest: int = LONGEST
) -> DataFrame:
    """docs -> one row for each piece, written, with its ids (little-endian unsigned 32 bit) and their crc32."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    last = np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drops_space)
        for batch in it:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += last
                    start, total = 0, len(ids) // 4
                    for n in binary_lengths(total, longest):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((doc, start, n, own, zlib.crc32(own), total))
                        start += n
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])

    with batches_of(docs.sparkSession, 512):
        return written(only(docs, "doc_id", "text").select("doc_id", text_of()).mapInArrow(batches, PIECES), "pieces")


def packed(
    docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = END_ID, longest: int = LONGEST
) -> DataFrame:
    """docs (doc_id, text, ...) -> pieces with sequence_id and offset, tokenised once.

    Columns: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.
    sequence_id is gapless from 0 and ascends with the bucket, longest first, so
    a reader takes each bucket as one range. offset is 0: a sequence holds one piece.

    Null and empty texts give one piece, the end id. A null doc_id stays null.
    Repeated rows are packed as often as they occur. Very long texts become
    many pieces of the longest length. An empty table gives no piece. Other columns are
    not looked at.

    Numbering needs no global sort: pieces are dealt into (length, hash) cells, the
    cells' counts (one row a cell, not a document) give each cell its first id,
    and a piece is numbered within its cell.
    """
    rows = pieces(docs, tokenizer, drops_space, end_id, longest)
    cells = max(32, task_count(docs.sparkSession))
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)))
    counts = dealt.groupBy("length", "_cell").count()
    before = Window.orderBy(F.desc("length"), "_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_cell").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("_n", F.row_number().over(within))
        .join(firsts, ["length", "_cell"])
        .select(
            "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
            (F.col("_first") + F.col("_n") - 1).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
