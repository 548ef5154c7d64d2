"""Best-fit packing by patterns fitted with non-negative least squares.

Documents are tokenised, ended with an end id, and cut into pieces of at most ``size`` tokens: only
longer documents are cut, the first piece takes what is left over and all others are full. All that
the driver sees is the histogram of piece lengths (``size`` counts). It enumerates the patterns of
two and three lengths that fill a sequence exactly, fits how often each is used by non-negative
least squares against the histogram (multiplicative updates), rounds the counts, and packs what is
left by best fit, longest first, also on counts. The plan is a list of runs "so many pieces of this
length go to sequences numbered from here, at this place". Its size is bounded by the number of
patterns, not by the number of documents.

Each placed piece carries its token ids (``ids``, little-endian unsigned 32-bit integers), so the sequences
are there: the ids of a ``sequence_id`` in order of ``offset``.

Pieces take their number within their length from bucket counts, so no task holds a whole length.

Defined cases: a null text is empty and gives the end id alone; bytes that are not UTF-8 are read as
U+FFFD; null ids and repeated rows are packed like all others, and pieces of equal length are told apart by
id, piece and ids; a very long text gives as many pieces as it needs; an empty table gives none; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import short_batches, step, table, tasks_for, text_of, texts_of
from tessella.llm.tokens import encoder, tokenizer_path

SIZE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
ROUNDS = 300
#: Rows of one bucket in which pieces of a length are numbered.
BUCKET_ROWS = 50_000

PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED_DDL = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` tokens."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, "<u4")
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, number, start, length, parts = [], [], [], [], []
            for key, ids in zip(batch.column(0).to_pylist(), tool.encode(texts_of(batch.column(1))), strict=True):
                ids += end
                for k, (at, n) in enumerate(cut_points(len(ids) // 4, size)):
                    keys.append(key)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    parts.append(ids[4 * at : 4 * (at + n)])
            yield table({"id": keys, "piece": number, "start": start, "length": length, "ids_crc32": map(crc32, parts), "ids": parts}, PIECES)
    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill ``size`` with two or three of the lengths: rows (a, b, c), a >= b >= c, c = 0 for pairs."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    a = lengths[lengths < size]
    pairs = a[(a * 2 >= size) & there[size - a]]
    found = [np.stack([pairs, size - pairs, np.zeros_like(pairs)], 1)]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = size - x - y
    good = (x >= y) & (y >= z) & (z > 0) & there[np.maximum(z, 0)]
    found.append(np.stack([x[good], y[good], z[good]], 1))
    return np.concatenate(found)


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that brings the use of each length, A x, close to the histogram."""
    size = len(histogram)
    flat, owner = shapes.T.ravel(), np.tile(np.arange(len(shapes)), 3)
    used = flat > 0
    flat, owner = flat[used], owner[used]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, x[owner], size)

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(owner, y[flat], len(shapes))

    target = back(histogram.astype(float))
    x = np.full(len(shapes), histogram.sum() / max(1, len(flat)))
    for _ in range(rounds):
        x *= target / np.maximum(back(forward(x)), 1e-12)
    return x


def round_counts(shapes: np.ndarray, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes, longest first, with whole counts: running sums are rounded among shapes of one longest length."""
    order = np.lexsort((-fitted, -shapes[:, 0]))
    shapes, fitted = shapes[order], fitted[order]
    sums = np.cumsum(fitted)
    before = np.concatenate([[0.0], sums])[np.searchsorted(-shapes[:, 0], -shapes[:, 0])]
    rounded = np.floor(sums - before + 0.5)
    rounded -= np.where(np.append(True, shapes[1:, 0] != shapes[:-1, 0]), 0, np.append(0, rounded[:-1]))
    return shapes[rounded > 0], rounded[rounded > 0].astype(np.int64)


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Runs (length, first number, pieces, first sequence, offset) that place every piece once.

    Patterns are fitted in stages, each to what the stages before have left: those of two documents
    and then those of three, or all at once. The plan with fewer sequences is returned.
    """
    plans = [_plan(counts, size, stages) for stages in (((2,), (3,)), ((2,),), ((2, 3),))]
    return min(plans, key=lambda plan: int((plan[:, 3] + plan[:, 2]).max(initial=0)))


def _plan(counts: dict[int, int], size: int, stages: tuple[tuple[int, ...], ...]) -> np.ndarray:
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    taken = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, times: int, sequence: int, offset: int) -> None:
        runs.append((length, int(taken[length]), times, sequence, offset))
        taken[length] += times
        left[length] -= times

    if left[size]:
        times = int(left[size])
        put(size, times, 0, 0)
        sequences = times
    for documents in stages:
        shapes = patterns(np.flatnonzero(left), size)
        shapes = shapes[np.isin((shapes > 0).sum(1), documents)]
        if not len(shapes):
            continue
        for shape, times in zip(*round_counts(shapes, fit_counts(shapes, left)), strict=True):
            parts = [p for p in shape.tolist() if p]
            times = min([int(times), *(int(left[p]) // parts.count(p) for p in parts)])
            if times > 0:
                offset = 0
                for p in parts:
                    put(p, times, sequences, offset)
                    offset += p
                sequences += times
    # Residuals: longest first, into the open sequences with the smallest sufficient room.
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length]:
            fit = next((r for r in range(length, size) if room[r]), None)
            if fit is None:
                times, first, offset = int(left[length]), sequences, 0
                times = max(1, min(times, -(-times // max(1, size // length))))
                sequences += times
            else:
                first, open_count = room[fit].pop()
                times, offset = min(open_count, int(left[length])), size - fit
                if open_count > times:
                    room[fit].append((first + times, open_count - times))
            put(length, times, first, offset)
            if size - offset - length:
                room[size - offset - length].append((first, times))
    return np.array(runs, np.int64).reshape(-1, 5)


def _place(runs: np.ndarray, size: int):
    """Give each numbered piece its sequence and offset. ``runs`` is bounded by the patterns."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    length, first, _, sequence, offset = runs[order].T
    begin = np.searchsorted(length, np.arange(size + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = np.asarray(batch.column("length")), np.asarray(batch.column("number"))
            found = np.empty(len(n), np.int64)
            for value in np.unique(n):
                mine = n == value
                low, high = begin[value], begin[value + 1]
                found[mine] = low + np.searchsorted(first[low:high], number[mine], "right") - 1
            out = {name: batch.column(name) for name in PLACED.names[:5]}
            yield table(out | {"sequence_id": sequence[found] + number - first[found], "offset": offset[found], "ids": batch.column("ids")}, PLACED)
    return run


def number_within(pieces: DataFrame, total: int) -> DataFrame:
    """Add ``number``: 0, 1, ... within each length, from counts of small buckets."""
    buckets = tasks_for(pieces, total, BUCKET_ROWS)
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    return spread.withColumn("inside", inside).join(counts, ["length", "bucket"]).withColumn("number", F.col("inside") + F.col("before"))


def pack(
    docs: DataFrame, size: int = SIZE, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, ``ids``."""
    path = path or tokenizer_path(TOKENIZER)
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    pieces = step(rows.mapInArrow(_pieces(path, end_id, size), PIECES_DDL))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    runs = plan_sequences(counts, size)
    placed = number_within(pieces, sum(counts.values())).mapInArrow(_place(runs, size), PLACED_DDL)
    return placed.withColumnRenamed("id", id_col)
