"""Substring dedup: repeated word windows found by compressed FM-indexes, one per shard.

A window is a run of ``words`` consecutive words. All windows with the same words must meet in one
shard, so windows are dealt by content: the key of a window is the smallest hash among its word
pairs (pairs of long, rare words first). Neighbouring windows mostly share their key and travel as
one piece. Only pieces whose key occurs in several documents are sent at all. Each shard builds an
FM-index over its distinct pieces and streams the same pieces through it: backward search gives
the suffix range of each window, i.e. whether its matching statistic reaches the threshold, and the
smallest document of that range.

Exact copies of a whole document are covered by its first copy, which alone is sent on. Identical pieces are merged before they are dealt. If very many different pieces share a key, its
pieces are cut into windows, which are merged and dealt by the hash of the whole window, so no shard
grows with one frequent pair.

Defined cases: a null text has no words; a null id is never smaller than another and its rows are
left as they are; rows with the same id never count against each other; shorter documents than one
window have none; equal windows of one id do not count; words are compared as bytes; a very long text is cut
into pieces and windows that are spread; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_of, lists, short_batches, step, table, tasks_for, text_of
from tessella.llm.fm_index import FMIndex

WORDS = 13
#: Words of a key: few enough to hold over many windows, enough to be rare. At most three.
GRAM = 2
#: Words of fewer bytes than this are avoided in keys.
SHORT = 6
#: Different pieces of one key above which its windows are dealt one by one. Only balances the shards.
HOT_PIECES = 1000
#: Pieces of one shard.
SHARD_PIECES = 50_000
WHOLE = (1 << 31) - 1
#: Distinct words whose hashes one worker keeps.
CACHE_WORDS = 300_000
LOW62 = np.uint64((1 << 62) - 1)
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hash of a word; the top bit is set for a short word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) >> 1 | (len(word) < SHORT) << 63
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


HASHES = _Hashes()


def window_keys(words: list[bytes], window: int) -> np.ndarray:
    """Key of every window of a document (one value for each start)."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    grams = min(GRAM, window)
    short = h >> np.uint64(63)
    keys, demoted = h[: len(h) - grams + 1] * MIX_A, short[: len(h) - grams + 1].copy()
    for k in range(1, grams):
        keys = (keys ^ keys >> np.uint64(29)) * MIX_B + h[k : len(h) - grams + 1 + k]
        demoted += short[k : len(h) - grams + 1 + k]
    keys ^= keys >> np.uint64(29)
    keys = (keys * MIX_A & LOW62) | (demoted << np.uint64(62))
    width, done = window - grams + 1, 1
    while done < width:
        more = min(done, width - done)
        keys = np.minimum(keys[:-more], keys[more:])
        done += more
    return keys


def key_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(keys)))


RUNS = pa.schema([("id", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64())])
PIECES = pa.schema([("id", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("route", pa.int64()), ("piece", pa.binary())])
CUT = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("at", pa.int32()), ("first", pa.int64()), ("piece", pa.binary())])
FOUND = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("first", pa.int64())])
KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _emit_runs(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            starts, lengths, keys, sizes = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = window_keys(text.split(), window)
                at, n = key_runs(found)
                starts.append(at)
                lengths.append(n)
                keys.append(found[at])
                sizes.append(len(at))
            if sum(sizes):
                yield table({
                    "id": np.repeat(ids, sizes), "crc": np.repeat(crcs, sizes), "start": np.concatenate(starts).astype(np.int32),
                    "n": np.concatenate(lengths).astype(np.int32),
                    "key": np.concatenate(keys).view(np.int64),
                }, RUNS)
    return run


def _emit_pieces(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
            runs = column.flatten()
            start, length, key = (np.asarray(runs.field(name)) for name in ("start", "n", "key"))
            rows: dict[str, list] = {name: [] for name in PIECES.names}
            sizes = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = text.split()
                # Rows of the same id and text repeat their runs.
                starts, one = np.unique(start[offsets[k] : offsets[k + 1]], return_index=True)
                one += offsets[k]
                ends = starts + length[one] + window - 1
                sizes.append(len(starts))
                rows["start"] += starts.tolist()
                rows["route"] += key[one].tolist()
                rows["piece"] += [b" ".join(words[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            rows["id"], rows["crc"] = np.repeat(np.asarray(batch.column(0)), sizes), np.repeat(np.asarray(batch.column(1)), sizes)
            yield table(rows, PIECES)
    return run


def _emit_windows(window: int) -> Callable:
    """Windows of pieces: the piece's name, place in it, first document and the window as a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [piece.split(b" ") for piece in batch.column(2).to_pylist()]
            sizes = [len(words) - window + 1 for words in split]
            repeated = {name: np.repeat(np.asarray(batch.column(k)), sizes) for k, name in ((0, "p"), (1, "q"), (3, "first"))}
            yield table(repeated | {
                "at": [at for n in sizes for at in range(n)],
                "piece": [b" ".join(words[at : at + window]) for words, n in zip(split, sizes, strict=True) for at in range(n)],
            }, CUT)
    return run


def search_shard(pieces: list[bytes], first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same smallest document: piece, offset, windows, document."""
    numbers: dict[bytes, int] = {}
    symbols: list[int] = []
    sizes = []
    for piece in pieces:
        words = piece.split(b" ")
        sizes.append(len(words))
        symbols += [numbers.setdefault(w, len(numbers) + 1) for w in words]
        symbols.append(0)
    length = np.array(sizes, np.int64)
    index = FMIndex(np.array(symbols, np.int64), window)
    del symbols, numbers
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    windows = length - window + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    smallest = first[owner].copy()
    for at in range(0, len(owner), 200_000):
        part = slice(at, at + 200_000)
        low, high = index.search(begin[owner[part]] + offset[part], window)
        many = np.flatnonzero(high - low > 1)
        if not len(many):
            continue
        # Ranges of windows are disjoint or equal, so one minimum for each distinct range will do.
        starts, which = np.unique(low[many], return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[which] = high[many]
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange((ends - starts).sum())
        documents = first[np.searchsorted(begin, index.order[places], "right") - 1]
        least = np.minimum.reduceat(documents, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        smallest[at + many] = least[which]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1])
    runs = np.flatnonzero(new)
    return owner[runs], offset[runs], np.diff(np.append(runs, len(owner))), smallest[runs]


def _search(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2).to_pylist(), np.asarray(b.column(3))) for b in batches if b.num_rows]
        if not parts:
            return
        p, q = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        pieces, first = [t for x in parts for t in x[2]], np.concatenate([x[3] for x in parts])
        del parts
        owner, offset, count, smallest = search_shard(pieces, first, window)
        for at in range(0, len(owner), 50_000):
            s = slice(at, at + 50_000)
            yield table({"p": p[owner[s]], "q": q[owner[s]], "at": offset[s].astype(np.int32), "n": count[s].astype(np.int32), "first": smallest[s]}, FOUND)
    return run


def _remove(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, spans = lists(batch.column(2))
            n_words, removed, kept = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = text.split()
                span = spans[offsets[k] : offsets[k + 1]]
                n_words.append(len(words))
                if len(span) and len(words) >= window:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, span >> 32, 1)
                    np.add.at(depth, np.minimum(span & WHOLE, len(words)), -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    removed.append(len(words) - int(keep.sum()))
                    words = compress(words, keep)
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield table({"id": batch.column(0), "n_words": n_words, "n_removed": removed, "kept": kept}, KEPT)
    return run


def _later_copies(rows: DataFrame) -> DataFrame:
    """id, crc of documents whose whole text is also that of a smaller id."""
    names = step(rows.select("id", "crc", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    first = step(names.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a", "b", "low"))
    return step(names.join(first, ["a", "b"]).where("id > low").select("id", "crc"), first)


def repeated_spans(docs: DataFrame, window: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word spans that also occur in a document with a smaller id: id, crc, ``start``, ``end`` (exclusive).

    ``crc`` is the crc32 of the text; spans may overlap. A copy of a whole document has the span
    (0, ``WHOLE``), to be cut to the document; it counts only if the document has a window at all.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), crc_of(text_col).alias("crc"), text_of(text_col).alias("text"))
    copies = _later_copies(rows)
    runs = step(rows.mapInArrow(_emit_runs(window), "id long, crc long, start int, n int, key long"))
    shared = step(runs.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"))
    hits = runs.join(shared, "key", "left_semi").groupBy("id", "crc").agg(F.collect_list(F.struct("start", "n", "key")).alias("starts"))
    hits = step(hits.join(copies, ["id", "crc"], "left_anti"), runs, shared)
    pieces = rows.join(hits, ["id", "crc"]).select("id", "crc", "text", "starts")
    pieces = step(pieces.mapInArrow(_emit_pieces(window), "id long, crc long, start int, route long, piece binary"), hits)
    name = [F.xxhash64("piece").alias("p"), F.xxhash64(F.lit(1), "piece").alias("q")]
    distinct = pieces.groupBy("piece").agg(F.min("id").alias("first"), F.min("route").alias("route"))
    distinct = step(distinct.select("route", "piece", "first"))

    hot = distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PIECES).select("route")
    hot = step(hot)
    cut = distinct.join(hot, "route", "left_semi").select(*name, "piece", "first")
    cut = step(cut.mapInArrow(_emit_windows(window), "p long, q long, at int, first long, piece binary"))
    windows = cut.groupBy("piece").agg(F.min("first").alias("first"))
    dealt = distinct.join(hot, "route", "left_anti").select("route", "piece", "first")
    dealt = dealt.unionByName(windows.select(F.xxhash64("piece").alias("route"), "piece", "first"))
    shards = tasks_for(docs, distinct.count(), SHARD_PIECES)
    found = dealt.repartition(shards, "route").select(*name, "piece", "first")
    found = step(found.mapInArrow(_search(window), "p long, q long, at int, n int, first long"), distinct, hot)
    back = cut.select(F.col("p").alias("in_p"), F.col("q").alias("in_q"), F.col("at").alias("in_at"), *name)
    back = back.join(found.select("p", "q", "n", "first"), ["p", "q"]).select(F.col("in_p").alias("p"), F.col("in_q").alias("q"), F.col("in_at").alias("at"), "n", "first")
    found = found.unionByName(back)
    spans = pieces.select("id", "crc", "start", *name).join(found, ["p", "q"]).where("first < id")
    start = F.col("start") + F.col("at")
    spans = spans.select("id", "crc", start.alias("start"), (start + F.col("n") - 1 + window).alias("end"))
    return spans.unionByName(copies.select("id", "crc", F.lit(0).alias("start"), F.lit(WHOLE).alias("end")))


def remove_repeats(docs: DataFrame, window: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the words covered by repeated spans: id, ``n_words``, ``n_removed``, ``text``.

    One row for each input row; kept words are joined by one space.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    packed = (F.col("start").cast("long") * (1 << 32) + F.col("end")).alias("span")
    by_doc = step(spans.select("id", "crc", packed).groupBy("id", "crc").agg(F.collect_set("span").alias("spans")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), crc_of(text_col).alias("crc"), text_of(text_col).alias("text"))
    merged = rows.join(by_doc.hint("merge"), ["id", "crc"], "left").select("id", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    kept = merged.mapInArrow(_remove(window), "id long, n_words long, n_removed long, kept binary")
    return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("text"))
