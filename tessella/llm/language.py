"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary: text of that language which the compressor may refer
back to. A text is cut into blocks, each block is compressed with each dictionary, and the language
whose dictionary gives the fewest bytes in all is chosen. Blocks are independent, so a long text
cannot hide the dictionaries behind its own content. Where the best two languages come out too
close, the text is rejected: ``accepted`` is false.

Dictionaries are learned from at most ``SAMPLE_DOCS`` slices of ``SLICE`` characters for each
language, chosen by hash. The number of languages is taken to be small (they are listed on the
driver).

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and rejected; rows
with a null id are scored like others, count as held out and are never learned from; repeated rows
are scored alike; ties go to the language with more training rows, then by name; with nothing to
learn from all is ``und``; bytes that are not UTF-8 are read as U+FFFD; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import held_out, short_batches, table, text_of, texts_of

SAMPLE_DOCS = 300
SLICE = 400
BLOCK = 2048
#: Matches of four bytes count: syllables tell languages apart, not long repeats.
LEVEL, SHORTEST_MATCH = 6, 4
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Least advantage over the second language, as a share of its bytes, for a text to be accepted.
MARGIN = 0.002
UNKNOWN = "und"
SCHEMA = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


@dataclass(frozen=True)
class Languages:
    """Dictionaries, most frequent language first."""

    names: tuple[str, ...]
    texts: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST_MATCH, write_content_size=0)
        out = []
        for text in self.texts:
            content = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            out.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=content))
        return out


def letters(text: str) -> bytes:
    """What is compared: letters in lower case, everything between them as one space."""
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Dictionaries from a bounded sample of the rows that may be learned from."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts, key=lambda name: (-counts[name], name))
    # Hashes are uniform; one slot in so many gives a few more rows than are needed. All languages come from one scan.
    slots = F.create_map(*[F.lit(v) for name in names for v in (name, max(1, counts[name] // (2 * SAMPLE_DOCS)))]) if names else F.create_map().cast("map<string,int>")
    spare = F.greatest(F.length("text") - SLICE, F.lit(0)) + 1
    part = F.substring("text", F.pmod(F.xxhash64("h"), spare).cast("int") + 1, F.lit(SLICE))
    sample = rows.where(F.pmod("h", slots[F.col("lang")]) == 0).select("lang", "h", part.alias("text"))
    sample = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= SAMPLE_DOCS)
    texts: dict[str, list[tuple[int, bytes]]] = {name: [] for name in names}
    for r in sample.collect():
        texts[r["lang"]].append((r["h"], letters(r["text"])))
    return Languages(tuple(names), tuple(b" ".join(t for _, t in sorted(texts[name])) for name in names))


def judge(text: str | None, languages: Languages, compressors: list[zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """Language, score and acceptance of one text."""
    if not text or not languages.names or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    data = letters(text)
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    sizes = [sum(len(tool.compress(block)) for block in blocks) for tool in compressors]
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    second = min((s for k, s in enumerate(sizes) if k != best), default=None)
    if second is None:
        return languages.names[best], 1.0, True
    gain = second - sizes[best]
    return languages.names[best], 1.0 / (1.0 + math.exp(-min(50.0, gain / 4))), gain >= max(1, MARGIN * second)


def _identify(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = languages.compressors()
        for batch in batches:
            found = [judge(text, languages, tools) for text in texts_of(batch.column(2))]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield table({"id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": score, "accepted": accepted}, SCHEMA)
    return run


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``held_out``, ``lang_pred``, ``score``, ``accepted``."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_identify(languages), "id long, held_out boolean, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_col)


def _keep(languages: Languages, columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = languages.compressors()
        for batch in batches:
            texts = texts_of(batch.column(columns.index(text_col)))
            yield batch.filter(pa.array([judge(text, languages, tools)[2] for text in texts], pa.bool_()))
    return run


def keep_accepted(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is accepted, all columns as they were."""
    short_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(languages, docs.columns, text_col), docs.schema)
