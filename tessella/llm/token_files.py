"""Token-id files: segments of concatenated ids with Elias-Fano coded document boundaries.

A segment holds the ids of consecutive documents, in ascending id order, as one array of unsigned
16-bit (or 32-bit) integers. The boundaries (and the document ids) are monotone sequences in
Elias-Fano form: the low bits packed, the high parts as a bit vector with a one for each value, and
a count of ones for each block of 512 bits by which ``select`` finds any value without decoding the
others. That is about 2 + log2(average length) bits for each document instead of 64.

Layout of a segment (little-endian): the header ``HEADER``, then for boundaries and document ids
each: first value and value range (two int64), number of values, low width (uint32), low bits,
high bits and block counts with their byte lengths (uint32); then the ids.

Segments are rows of a Parquet table, so that any store Spark can write to can hold them and a lost
task is simply written again. Range partitioning by document id orders segments across the table.

Defined cases: a null text is empty and has the end id alone; null ids come first, as in Spark's
ascending order; rows with the same id are ordered by the crc32 of their texts, then by text; bytes that
are not UTF-8 are read as U+FFFD; a very long text is one document in one segment; an empty table gives no
segments; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import short_batches, step, table, tasks_for, text_of, texts_of
from tessella.llm.tokens import encoder, tokenizer_path
from tessella.session import scratch_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"TIDS"
HEADER = struct.Struct("<4sHHIIQ")  # magic, version, bytes of an id, documents, of them with null id, ids
SERIES = struct.Struct("<qqIIIII")  # first value, range, values, low width, bytes of low bits, high bits and counts
BLOCK = 512
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
#: Documents of one partition.
PARTITION_DOCS = 20_000


class EliasFano:
    """Ascending integers in near-minimal space, with access to any of them."""

    def __init__(self, first: int, span: int, count: int, width: int, low: bytes, high: bytes, ones: bytes) -> None:
        self.first, self.span, self.count, self.width = first, span, count, width
        self.low, self.high, self.ones = low, high, ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        if not len(values):
            return cls(0, 0, 0, 0, b"", b"", b"")
        first, span = int(values[0]), int(values[-1]) - int(values[0])
        width = max(0, (span // len(values)).bit_length() - 1)
        rest = (values.view(np.uint64) - np.uint64(first & (2**64 - 1)))
        bits = (rest[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        places = (rest >> np.uint64(width)).astype(np.int64) + np.arange(len(values))
        ones = np.zeros(-(-(int(places[-1]) + 1) // BLOCK) * BLOCK, np.uint8)
        ones[places] = 1
        counts = np.concatenate([[0], np.cumsum(ones.reshape(-1, BLOCK).sum(1, dtype=np.int64))]).astype("<u4")
        return cls(first, span, len(values), width, low, np.packbits(ones, bitorder="little").tobytes(), counts.tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        index = np.asarray(index, np.int64)
        counts = np.frombuffer(self.ones, "<u4").astype(np.int64)
        block = np.searchsorted(counts, index, "right") - 1
        wanted, which = np.unique(block, return_inverse=True)
        high = np.frombuffer(self.high, np.uint8).reshape(-1, BLOCK // 8)
        rows = np.unpackbits(high[wanted], axis=1, bitorder="little")
        # Places of ones, block after block; the k-th one of a block follows the ones of the blocks before.
        places = np.flatnonzero(rows.ravel())
        skipped = np.concatenate([[0], np.cumsum(rows.sum(1, dtype=np.int64))[:-1]])
        place = places[skipped[which] + index - counts[block]]
        high_part = place % BLOCK + block * BLOCK - index
        if not self.width:
            low_part = np.zeros(len(index), np.uint64)
        else:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.count * self.width].reshape(-1, self.width)[index]
            low_part = (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        value = (high_part.astype(np.uint64) << np.uint64(self.width)) + low_part + np.uint64(self.first & (2**64 - 1))
        return value.view(np.int64)

    def to_bytes(self) -> bytes:
        head = SERIES.pack(self.first, self.span if self.span < 2**63 else -1, self.count, self.width, len(self.low), len(self.high), len(self.ones))
        return head + self.low + self.high + self.ones

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        first, span, count, width, a, b, c = SERIES.unpack_from(data, at)
        at += SERIES.size
        return cls(first, span, count, width, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c]), at + a + b + c


class Segment:
    """A segment opened from its bytes: ids of any document without reading the others."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, self.documents, self.nulls, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.from_bytes(data, HEADER.size)
        self.names, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def bounds(self, index: np.ndarray) -> np.ndarray:
        """Where documents begin; index ``documents`` gives the end."""
        return self.ends.select(index)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(np.array([k, k + 1]))
        return self.ids[a:b]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self.names.select(np.arange(self.documents - self.nulls)).tolist()


def write_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    lengths = np.array([len(x) // width for x in ids], np.int64)
    ends = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    head = HEADER.pack(MAGIC, 1, width, len(doc_ids), len(doc_ids) - len(known), int(lengths.sum()))
    return b"".join([head, ends.to_bytes(), EliasFano.encode(known).to_bytes(), *ids])


SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])
ROWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _write(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, f"<u{width}")
        end = np.array([end_id], f"<u{width}").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size, number, part = 0, 0, -1

        def close() -> pa.RecordBatch:
            return table({"part": [part], "segment": [number], "n_ids": [size], "data": [write_segment(names, held, width)]}, SEGMENTS)

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for name, ids in zip(batch.column(0).to_pylist(), tool.encode(texts_of(batch.column(1))), strict=True):
                names.append(name)
                held.append(ids + end)
                size += len(held[-1]) // width
                if size >= SEGMENT_IDS:
                    yield close()
                    names, held, size, number = [], [], 0, number + 1
        if names:
            yield close()
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            segment = Segment(data)
            bounds = segment.bounds(np.arange(segment.documents + 1))
            wide = segment.ids.astype("<u4")
            view = memoryview(wide).cast("B")
            crcs = [crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield table({"id": segment.doc_ids(), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds), "ids_crc32": crcs}, ROWS)


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the segments, in ascending id order, below ``folder``."""
    short_batches(docs.sparkSession)
    path = path or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    parts = tasks_for(docs, docs.count(), PARTITION_DOCS)
    # Many null or equal ids are spread by their texts.
    ordered = rows.withColumn("crc", F.crc32("text")).repartitionByRange(parts, "id", "crc").sortWithinPartitions("id", "crc", "text")
    ordered = ordered.select("id", "text", F.spark_partition_id().alias("part"))
    segments = ordered.mapInArrow(_write(path, end_id, width), "part int, segment int, n_ids long, data binary")
    segments.write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: ``id``, ``start``, ``n_tokens``, ``ids_crc32``, read from the segments."""
    segments = spark.read.schema("part int, segment int, n_ids long, data binary").parquet(folder)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", base.alias("base"))  # one row for each partition
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = step(segments.select("part", "segment", "n_ids").withColumn("inside", inside).join(sizes, "part").select("part", "segment", (F.col("inside") + F.col("base")).alias("base")))
    return segments.join(starts, ["part", "segment"]).select("base", "data").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a new shared folder and return what they hold."""
    folder = scratch_folder(docs.sparkSession) + "/tokens"
    write_token_files(docs, folder, path, end_id, 2, id_col, text_col)
    return read_token_files(docs.sparkSession, folder).withColumnRenamed("id", id_col)
