"""SimHash near-dedup over segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. One differing bit
moves one count by one, so the Manhattan distance of two count vectors is never above the number of
differing bits. The range join under that bound runs on a grid: each distinct fingerprint is entered
in the cell of its own vector and in all cells one step away, so two vectors at distance two or less
always share a cell. Fingerprints alone in all their cells are done.

The rest is verified exactly without forming pairs: two fingerprints differ in at most two bits if
and only if some fingerprint differs from both in at most one. At most 65 fingerprints are that close
to one point, so these groups are bounded, and a star of links in each gives the components.

Defined cases: a null text has no words; documents without words have fingerprint zero and link like
any other; a row with a null id has a fingerprint but links with nothing and has no component;
repeated rows are equal documents; of equal ids the one with the smaller crc32 of its text stays; a very long
text is fingerprinted whole; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_of, short_batches, step, table, text_of
from tessella.operators.components import connected_components

SHINGLE = 3
SEED = 42
SEGMENTS = 32
FIELDS = 0x5555555555555555
BLOCK = 50_000
PRINTS = pa.schema([("id", pa.int64()), ("crc", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text: majority of its shingles' hash bits."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        to = min(count, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist() if len(words) >= shingle else [len(joined)], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text, shingle) for text in batch.column(2).to_pylist()]
            yield table({"id": batch.column(0), "crc": batch.column(1), "fp": np.array(values, np.uint64).view(np.int64)}, PRINTS)
    return run


def segment_counts(fp: Column) -> Column:
    """Bit counts (0, 1, 2) of the 32 segments, one in each two bits of a long."""
    next_bit = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(FIELDS))
    two = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(FIELDS))
    return F.shiftleft(two, 1).bitwiseOR(one)


def grid_cells(vector: Column) -> Column:
    """The cell of a count vector and the cells at Manhattan distance one."""
    cells = [vector]
    for k in range(SEGMENTS):
        count = F.shiftrightunsigned(vector, 2 * k).bitwiseAND(F.lit(3))
        cells.append(F.when(count < 2, vector.bitwiseXOR(F.lit(_signed(1 << 2 * k)))))  # 0 to 1, 1 to 0
        cells.append(F.when(count > 0, vector.bitwiseXOR(F.lit(_signed(3 << 2 * k)))))  # 1 to 2, 2 to 1
    return F.array_compact(F.array(*cells))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def link_prints(prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect fingerprints ``fp`` (distinct) at two or fewer differing bits."""
    placed = prints.select("fp", segment_counts(F.col("fp")).alias("v")).select("fp", F.explode(grid_cells(F.col("v"))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("cell")
    near = step(placed.join(step(shared), "cell", "left_semi").select("fp").distinct())
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    stars = near.select("fp", F.explode(around).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def _components(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, crc (of the text), fp, component_id, and ``class``: a fingerprint that names the component.

    Where ids repeat, the smallest id of two components can be the same; their classes differ.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), crc_of(text_col).alias("crc"), text_of(text_col).alias("text"))
    prints = step(rows.mapInArrow(_prints(shingle), "id long, crc long, fp long"))
    distinct = step(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("low")))
    links = step(link_prints(distinct))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = connected_components(ends, links)
    linked = found.join(distinct, found["node"] == distinct["fp"]).select("fp", "component", "low")
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component", "component_id")
    classes = step(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"), F.coalesce("component_id", "low").alias("component_id")))
    out = prints.join(classes, "fp", "left")
    return out.select("id", "crc", "fp", "class", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``fingerprint`` (long), ``component_id`` (smallest linked id)."""
    found = _components(docs, shingle, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id (then smallest crc32 of the text).

    Rows without an id stay.
    """
    found = _components(docs, SHINGLE, id_col, text_col)
    first = step(found.where("id = component_id").groupBy("class").agg(F.min(F.struct("id", "crc")).alias("least")).select("least.id", "least.crc"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("tag"), F.struct("*").alias("row"))
    stay = rows.where("id IS NOT NULL").join(first, ["id", "crc"], "left_semi").dropDuplicates(["id", "tag"])
    stay = stay.select("row").unionByName(rows.where("id IS NULL").select("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
