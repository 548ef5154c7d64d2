"""Line dedup: every run of three consecutive lines is kept once in the whole corpus.

Lines are split at newlines. Lines of blanks only take no part: windows pass over them and they are
kept. Each window of three consecutive other lines is hashed (128 bits); the first occurrence is the
one with the smallest (id, place). In every later occurrence the lines it covers are removed, and
overlapping occurrences are merged. Windows are judged on the input.

Defined cases: a null text is empty; documents of fewer than three such lines are left as they are;
null ids come after all others; rows with the same id and text count as one document and keep the
same lines; equal windows of one document are ordered by place; bytes that are not UTF-8 are compared as they
are; a very long text is one row and its windows are spread; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lists, short_batches, step, table, text_of

WINDOW = 3
KEPT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def kept_lines(text: bytes, starts: np.ndarray, window: int) -> tuple[bytes, int]:
    """Text without the lines of the windows that begin at ``starts``, and the lines removed."""
    lines = text.split(b"\n")
    solid = np.flatnonzero([bool(line.strip(b" \t\r")) for line in lines])
    keep = np.ones(len(lines), bool)
    for i in range(window):
        keep[solid[starts + i]] = False
    return b"\n".join(line for line, stays in zip(lines, keep, strict=True) if stays), len(lines) - int(keep.sum())


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, starts = lists(batch.column(2))
            out: dict[str, list] = {"n_lines": [], "n_removed": [], "kept": []}
            for k, text in enumerate(batch.column(1).to_pylist()):
                out["n_lines"].append(text.count(b"\n") + 1)
                found = starts[offsets[k] : offsets[k + 1]]
                kept, removed = kept_lines(text, found, window) if len(found) else (text, 0)
                out["n_removed"].append(removed)
                out["kept"].append(kept)
            yield table(out | {"id": batch.column(0)}, KEPT)
    return run


def line_windows(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Windows of lines: nul, id, tag, ``at``, and their hash ``a``, ``b``."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^ \t\r]"))
    rows = docs.select(*_key(id_col, text_col), lines.alias("lines")).where(F.size("lines") >= window)

    def hashed(i):
        parts = [F.get("lines", i + k) for k in range(window)]
        return F.struct(i.alias("at"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))

    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - window), hashed)
    return rows.select("nul", "id", "tag", F.inline(windows))


def _key(id_col: str, text_col: str) -> list:
    """A document: rows of the same id and text are one."""
    return [
        F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tag"),
    ]


def repeated_lines(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Documents with later occurrences: nul, id, tag, ``starts`` (places among lines that are not blank)."""
    windows = step(line_windows(docs, window, id_col, text_col))
    place = F.struct("nul", "id", "tag", "at")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = step(first.where("n > 1").drop("n"))
    later = windows.join(first, ["a", "b"]).where(place != F.col("first"))
    return step(later.groupBy("nul", "id", "tag").agg(F.collect_set("at").alias("starts")))


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without later occurrences of line windows: id, ``n_lines``, ``n_removed``, ``text``."""
    short_batches(docs.sparkSession)
    later = repeated_lines(docs, window, id_col, text_col)
    rows = docs.select(*_key(id_col, text_col), text_of(text_col).alias("text"))
    merged = rows.join(later.hint("merge"), ["nul", "id", "tag"], "left").select(
        F.when(~F.col("nul"), F.col("id")).alias("id"), "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts")
    )
    kept = merged.mapInArrow(_remove(window), "id long, n_lines long, n_removed long, kept binary")
    return kept.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("kept").cast("string").alias("text"))


def without_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, its texts without later occurrences; a null text stays null."""
    short_batches(docs.sparkSession)
    later = repeated_lines(docs, window, id_col, text_col)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([text if at is None else kept_lines(text, np.asarray(at), window)[0] for text, at in zip(texts, starts, strict=True)], dtype=object)

    rows = docs.select(*_key(id_col, text_col), F.struct("*").alias("row")).join(later.hint("merge"), ["nul", "id", "tag"], "left")
    text = F.col("row").getField(text_col).cast("string")
    new = F.when(F.col("starts").isNull(), text).otherwise(cut(F.when(F.col("starts").isNotNull(), text.cast("binary")), F.col("starts")).cast("string"))
    return rows.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
