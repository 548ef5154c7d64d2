"""Content signatures, manifests, split parts and file preferences as joins over file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, content, size_bytes) of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("name"), "content", F.col("length").alias("size_bytes"))


def content_kind(content: Column) -> Column:
    """Kind of a file from its first bytes; JSON must parse as a whole."""
    head = F.hex(F.substring(content, 1, 8))
    # A cast never fails on bytes that are not text, unlike decoding them.
    text = F.lower(F.ltrim(F.substring(content, 1, 512).cast("string"), F.lit(" \t\r\n\f\x0b")))
    whole = content.cast("string")
    # Leading bytes of the file kinds.
    return (
        F.when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("504B0304") | head.startswith("504B0506") | head.startswith("504B0708"), "zip")
        .when(head.startswith("1F8B"), "gzip")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "html")
        .when(text.startswith("<?xml") | text.startswith("<errorbean"), "xml")
        .when((text.startswith("{") | text.startswith("[")) & F.try_parse_json(whole).isNotNull(), "json")
        .otherwise("unknown")
    )


def file_audit(files: DataFrame) -> DataFrame:
    """Rows (name, content, expected_kind) with actual kind, validity, size and digests."""
    return files.withColumn("actual_kind", content_kind(F.col("content"))).select(
        "name", "expected_kind", "actual_kind", (F.col("expected_kind") == F.col("actual_kind")).alias("valid"),
        F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
    )


def audit_status(audit: DataFrame) -> DataFrame:
    """PASS or FAIL per expected kind with the number of invalid files."""
    return audit.groupBy("expected_kind").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"),
        F.when(F.bool_and("valid"), "PASS").otherwise("FAIL").alias("status"),
    )


def manifest_build(files: DataFrame, own_name: str) -> DataFrame:
    """Path, size and SHA-256 of every file except the manifest itself."""
    return files.where(F.col("name") != own_name).select(
        F.col("name").alias("relative_path"), F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def manifest_verify(expected: DataFrame, observed: DataFrame, digest: str = "md5", length: int = 32, hash_below: int | None = None) -> DataFrame:
    """Expected against observed files: present, size, digest, or why the digest was not computed.

    ``expected``: (name, size_bytes, digest); ``observed``: the same, digest may be NULL.
    """
    e = expected.select("name", F.col("size_bytes").alias("expected_size"), F.col(digest).alias("expected_digest"))
    o = observed.select("name", F.col("size_bytes").alias("observed_size"), F.col(digest).alias("observed_digest"))
    both = e.join(o, "name", "full_outer")
    listed, present = F.col("expected_size").isNotNull(), F.col("observed_size").isNotNull()
    small = F.lit(True) if hash_below is None else F.col("observed_size") < hash_below
    status = (
        F.when(~listed, "UNLISTED")
        .when(~present, "MISSING")
        .when(F.length("expected_digest") != length, "EXPECTED_DIGEST_MALFORMED")
        .when(~small, "NOT_COMPUTED_BY_CONFIGURATION")
        .when(F.col("observed_digest") == F.col("expected_digest"), "MATCH")
        .otherwise("MISMATCH")
    )
    return both.select(
        "name", listed.alias("listed"), present.alias("present"),
        F.coalesce(F.col("expected_size") == F.col("observed_size"), F.lit(False)).alias("size_matches"),
        status.alias("digest_status"),
    )


def manifest_roll_up(verified: DataFrame) -> DataFrame:
    """One row: all present, all verified, all digests computed."""
    listed = verified.where("listed")
    return listed.agg(
        F.count(F.lit(1)).alias("files"), F.bool_and("present").alias("all_present"),
        F.bool_and(F.col("present") & F.col("size_matches") & F.col("digest_status").isin("MATCH", "NOT_COMPUTED_BY_CONFIGURATION")).alias("all_verified"),
        F.bool_and(F.col("digest_status").isin("MATCH", "MISMATCH")).alias("all_digests_computed"),
    )


def parts_verify(manifest: DataFrame, parts: DataFrame, source: str = "source") -> DataFrame:
    """Split parts per source: one-based contiguous index, size and digest match, summed size.

    ``manifest``: (source, source_size, index, size_bytes, sha256); ``parts``: (source, index, size_bytes, sha256).
    """
    seen = parts.select(source, "index", F.col("size_bytes").alias("o_size"), F.col("sha256").alias("o_sha"))
    joined = manifest.join(seen, [source, "index"], "left")
    # Indices 1..n without repeats: n distinct values, lowest 1, highest n.
    return joined.groupBy(source).agg(
        F.count(F.lit(1)).alias("parts"),
        ((F.min("index") == 1) & (F.max("index") == F.count(F.lit(1))) & (F.count_distinct("index") == F.count(F.lit(1)))).alias("contiguous"),
        F.bool_and(F.coalesce(F.col("o_size") == F.col("size_bytes"), F.lit(False))).alias("sizes_match"),
        F.bool_and(F.coalesce(F.col("o_sha") == F.col("sha256"), F.lit(False))).alias("digests_match"),
        (F.sum("o_size") == F.max("source_size")).alias("total_matches"),
    )


def first_available(inventory: DataFrame, preferences: DataFrame, small_csv_bytes: int = 100_000_000) -> DataFrame:
    """Per bundle: the first present alternative of each requirement plus small analysis CSVs.

    ``inventory``: (bundle, member, size_bytes, is_dir); ``preferences``: (requirement, name, preference).
    """
    named = inventory.where("NOT is_dir").withColumn("name", F.regexp_extract("member", r"([^/]+)$", 1))
    best = Window.partitionBy("bundle", "requirement").orderBy("preference", "member")
    chosen = named.join(preferences, "name").withColumn("rn", F.row_number().over(best)).where("rn = 1")
    lower = F.lower("member")
    extras = named.where(lower.endswith(".csv") & F.concat(F.lit("/"), lower).contains("/analysis/") & (F.col("size_bytes") <= small_csv_bytes))
    return chosen.select("bundle", "member").union(extras.select("bundle", "member")).distinct()
