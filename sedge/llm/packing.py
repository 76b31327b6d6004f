"""Best-fit packing of token pieces into sequences, in bounded space and on line.

Pieces are dealt by a hash of their row number into streams of about STREAM rows, so that no task
grows with the input; rows that repeat an id, or have none, are dealt like all others. A stream is
read once, in the order of its rows. At most OPEN bins are open; an integer used as a bitset has bit f
set while some open bin has f tokens free, so the tightest bin that fits is one shift and the lowest
set bit. When one bin too many is open, the fullest closes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm import common, tokens

SIZE, OPEN, STREAM = 2048, 64, 65_536
END = np.zeros(1, dtype="<u4").tobytes()


class Bins:
    """The open bins of one stream. made: bins so far, numbered from 0; most: open at once, at most."""

    def __init__(self, size: int = SIZE, open_bins: int = OPEN):
        self.size, self.open_bins = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.free_bits = self.count = self.made = self.most = 0

    def take(self, free: int) -> int:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        self.count -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n tokens, 1 to size."""
        fits = self.free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = self.take(free)
        else:
            b, free = self.made, self.size
            self.made += 1
        if left := free - n:
            if self.count == self.open_bins:  # room for one more: the fullest closes, be it this one
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1 if self.free_bits else left
                if left <= fullest:
                    return b, self.size - free
                self.take(fullest)
            self.by_free[left].append(b)
            self.free_bits |= 1 << left
            self.count += 1
            self.most = max(self.most, self.count)
        return b, self.size - free


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and an id 0, cut only if longer than size.

    The first piece of a cut document takes the rest of the division by size, all others are full.
    Returns doc_id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers) and with with_ids the ids. A null text counts as empty and gives one piece of
    length 1; rows that repeat a doc_id give pieces each; other columns do not matter.
    """

    def run(batches):
        coder = tokens.loaded(path)
        for batch in common.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = coder.encode(text) + END
                n, start = len(ids) // 4, 0
                end = n % size or min(n, size)
                k = 0
                while start < n:
                    part = ids[4 * start : 4 * end]
                    rows.append((doc_id, k, start, end - start, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None))
                    start, end, k = end, end + size, k + 1
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(cut: DataFrame, rows: int, size: int = SIZE, open_bins: int = OPEN, stream: int = STREAM) -> DataFrame:
    """cut (length from 1 to size, and more columns; rows of them, about) with sequence_id and offset.

    Columns of cut with these two names are replaced, all others pass through, whatever they hold:
    null and repeated ids are pieces like any other. Of equally free bins the newest is taken. An
    empty table gives an empty table. A row keeps its stream if its task runs again.
    """
    cut = common.without(cut, "sequence_id", "offset")
    plain = cut.select(*[F.col(f"`{c}`").alias("length" if c == "length" else f"_{i}") for i, c in enumerate(cut.columns)])
    numbered = common.stash(plain.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    dealt = numbered.repartition(max(1, -(-rows // stream)), F.xxhash64("_row", F.lit(11))).sortWithinPartitions("_row")

    def run(batches):
        bins, first = Bins(size, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            found = [pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType([*plain.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema).toDF(*cut.columns, "sequence_id", "offset")


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of docs with their places in sequences of at most SIZE tokens."""
    return pack(pieces(docs, path), docs.count())


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
