"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A window is 13 consecutive words of an item (a shorter item is one window). A document holds a
window only if it holds all of its shingles (four words, or the whole window if it is shorter), so
with all shingles required the necessary prefix is a single one, and the best choice is the rarest.

1. Document shingles meet the items' shingles; matches carry their place, and each document its number of words.
2. Counts of matches order each window's shingles by rarity; the rarest one is joined.
3. Its place in the window fixes where the window would start: places before the first word or
   beyond the document's length are dropped.
4. What is left is compared word by word with the document; only documents with something left are read again.

Windows are distinct by words, so items that share text are compared once.

Defined cases: null texts have no words; items without words or without an item_id are ignored, and
rows with the same item_id are one item; rows of the same id and text are one document, null ids
included; equally rare shingles of a window are taken by place; a very long text is one row while it is cut into
shingles; without items nothing is contaminated; an empty table gives an empty table; other columns are ignored,
whatever their names.

Rarity is counted over all documents, so all shingles of the items meet the documents once, in step 1. What the
prefix saves is the comparison of windows after that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import step
from tessella.session import broadcast_if

WORDS = 13
SHINGLE = 4
#: Part of a document's words that must be hit: one in so many.
HIT_SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text column; only A-Z are lower-cased."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tag"),
    ]


def _runs(array: str, size: Column | int, make) -> Column:
    """``make(i)`` for every start of a run of ``size`` elements; none if the array is shorter."""
    count = F.size(array) - size
    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), make)).otherwise(F.array().cast("array<struct<off:int,s:bigint>>"))


def _shingles(array: str, size: Column | int) -> Column:
    length = size if isinstance(size, Column) else F.lit(size)
    return _runs(array, size, lambda i: F.struct(i.alias("off"), F.xxhash64(length, F.slice(array, i + 1, length)).alias("s")))


def item_windows(items: DataFrame, words: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items: ``window`` (words), ``len``, ``items`` (sorted ids as strings)."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(text_col).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(words)))
    window = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("len")), lambda i: F.slice("words", i + 1, F.col("len")))
    rows = rows.select("item", "len", F.explode(window).alias("window"))
    return rows.groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _judged(docs: DataFrame, items: DataFrame, words: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """One row for each document: nul, id, tag, ``n_words``, ``n_hit``, ``items``, ``contaminated``."""
    windows = step(item_windows(items, words, item_col, item_text).withColumn("size", F.least(F.col("len"), F.lit(SHINGLE))))
    parts = windows.select("window", "size", F.inline(_shingles("window", F.col("size"))))
    # One more token, held by every document, carries its number of words past the join.
    mark = F.xxhash64(F.lit("number of words"))
    tokens = step(parts.select("size", "s").distinct())
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())  # at most four
    wanted = tokens.select("s").unionByName(docs.sparkSession.range(1).select(mark.alias("s"))).distinct()
    rows = docs.select(*_key(id_col, text_col), words_of(text_col).alias("words"))
    placed = rows.select("nul", "id", "tag", F.size("words").alias("n"), F.inline(F.concat(
        F.array(F.struct(F.lit(-1).alias("off"), mark.alias("s"))), *[_shingles("words", size) for size in sizes])))
    matches = step(placed.join(wanted, "s").select("nul", "id", "tag", "n", "off", "s"))
    judged, matches = matches.where("off < 0").select("nul", "id", "tag", "n"), matches.where("off >= 0")
    rarity = matches.groupBy("s").agg(F.count(F.lit(1)).alias("seen"))
    # A window with a shingle that no document holds cannot occur.
    ordered = parts.join(rarity, "s", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "s")).alias("rare"))
    prefix = step(ordered.where("rare.seen > 0").join(windows, "window").select(F.col("rare.s").alias("s"), F.col("rare.off").alias("back"), "window", "len", "items"))
    start = F.col("off") - F.col("back")
    found = matches.join(prefix, "s").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    found = found.select("nul", "id", "tag", F.struct(start.alias("start"), "len", "window", "items").alias("hit"))
    found = step(found.groupBy("nul", "id", "tag").agg(F.collect_set("hit").alias("hits")))

    # Texts are read again only where something was found.
    texts = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    texts = texts.join(broadcast_if(found.select("nul", "id", "tag"), found.count()), ["nul", "id", "tag"], "left_semi")
    joined = texts.join(found.hint("merge"), ["nul", "id", "tag"]).select("nul", "id", "tag", words_of("text").alias("words"), "hits")
    exact = F.filter("hits", lambda h: F.slice("words", h["start"] + 1, h["len"]) == h["window"])
    checked = joined.select("nul", "id", "tag", F.sort_array(F.transform(exact, lambda h: F.struct(
        h["start"].alias("start"), h["len"].alias("len"), h["items"].alias("items")))).alias("hits"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(acc["end"], h["start"]))).alias("n"),
            F.greatest(acc["end"], h["start"] + h["len"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    hit = checked.select("nul", "id", "tag", covered.alias("n_hit"), named.alias("items")).dropDuplicates(["nul", "id", "tag"])
    out = judged.join(hit, ["nul", "id", "tag"], "left").select(
        "nul", "id", "tag", F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words")))


def decontaminate(
    docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document: id, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``contaminated``."""
    found = _judged(docs, items, words, id_col, text_col, item_col, item_text)
    return found.select(F.when(~F.col("nul"), F.col("id")).alias(id_col), "n_words", "n_hit", "items", "contaminated")


def clean(
    docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns as they were."""
    bad = step(_judged(docs, items, words, id_col, text_col, item_col, item_text).where("contaminated").select("nul", "id", "tag").distinct())
    packed = docs.select(*_key(id_col, text_col), F.struct("*").alias("row")).join(bad.hint("merge"), ["nul", "id", "tag"], "left_anti")
    return packed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
