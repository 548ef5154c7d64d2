"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, dialogue, impact, language, lines, packing, pivots, pseudonyms, quality, simhash, substring, token_files, whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register("op1_substring_dedup", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM t WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM x JOIN f USING (s), range(13) r(k) WHERE first < doc_id),
a AS (SELECT doc_id, w[i] AS word, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos GROUP BY a.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_register("op2_line_dedup", r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
a AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM a WHERE regexp_matches(line, '[^ \t\r]')),
w AS (SELECT doc_id, pos, line AS x, lead(line, 1) OVER o AS y, lead(line, 2) OVER o AS z FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT x, y, z, min((doc_id, pos)) AS first FROM w WHERE z IS NOT NULL GROUP BY x, y, z),
c AS (SELECT DISTINCT w.doc_id, w.pos + k AS pos FROM w JOIN f ON w.x = f.x AND w.y = f.y AND w.z = f.z, range(3) r(k) WHERE (w.doc_id, w.pos) <> first),
g AS (SELECT s.doc_id, s.i FROM s JOIN c USING (doc_id, pos)),
k AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.i) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT t.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.remove_repeated_lines(_read(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_register("op3_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM v),
p AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
q AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM p),
m AS (SELECT doc_id, q.n, i, item_id FROM q JOIN x ON q.n = x.n AND q.s = x.s),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    joined = F.array_join("items", ",").cast("binary")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


@_register("op9_simhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, folder, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@_register("op4_quality_classifier")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return quality.classify(docs, quality.learn(docs, _read(spark, folder, "labels")))


@_register("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack(_read(spark, folder, "documents"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_register("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read_back(_read(spark, folder, "documents"))


@_register("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


#: Key of the registered query; a user brings a secret one.
PSEUDONYM_KEY = "tessella"


@_register("op7_pii_pseudonyms")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(_read(spark, folder, "documents"), PSEUDONYM_KEY)


@_register("op10_embedding_near_dedup", r"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(_read(spark, folder, "embeddings"))


@_register("op11_topk_search", """
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings")
    return impact.search(impact.build_index(vectors), vectors.where("vec_id % 50 = 0"))


@_register("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = whiten.whiten(_read(spark, folder, "embeddings"))
    each = out.select("vec_id", F.posexplode("whitened").alias("k", "whitened"), "n", "deviation", "explained", "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


@_register("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    given = _read(spark, folder, "conversations")
    report, rows = dialogue.repair(dialogue.damage(given))
    report = report.withColumnRenamed("conv_id", "reported")
    hashed = dialogue.digests(rows).withColumnRenamed("conv_id", "hashed")
    out = given.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("reported")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
