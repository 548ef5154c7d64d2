"""Readers, gates, manifests and the composed section plan."""

from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from checks.sqlkit import aligned, clip, logq, otsu, scale
from tessella.plans.section import score_cells
from tessella.sources import integrity as si
from tessella.sources import quality as sq
from tessella.sources import tables as st
from tessella.streaming import feature_stream as fs

def event_cells(spark, folder):
    return st.read_cells(spark, f"{folder}/events.parquet", {
        "cell_id": F.concat(F.lit("cell-"), F.col("event_id")), "x_centroid": F.col("user_id"), "y_centroid": F.col("value"),
        "cell_area": F.col("user_id") % 50 + 1, "nucleus_area": F.col("user_id") % 20 + 1,
    })


@register("read_cells", "SELECT 'cell-' || event_id AS cell_id, CAST(user_id AS DOUBLE) AS x_um, value AS y_um, CAST(user_id % 50 + 1 AS DOUBLE) AS cell_area, CAST(user_id % 20 + 1 AS DOUBLE) AS nucleus_area FROM events")
def read_cells(spark, folder):
    return event_cells(spark, folder)


@register("triplet_inventory", """WITH p AS (SELECT 'S' || c_custkey AS sample, kind FROM customer, (VALUES ('metadata'), ('expression'), ('polygons')) AS k(kind) WHERE NOT (kind = 'polygons' AND c_nationkey % 4 = 0) AND NOT (kind = 'expression' AND c_custkey % 6 = 0)), c AS (SELECT sample FROM p GROUP BY 1 HAVING count(DISTINCT kind) = 3)
SELECT sample, kind FROM p WHERE sample IN (SELECT sample FROM c)""")
def triplets(spark, folder):
    paths = table(spark, folder, "customer").selectExpr("c_nationkey", "c_custkey", "inline(array(struct('metadata' AS kind, '_metadata_file.csv.gz' AS ending), struct('expression' AS kind, '_exprMat_file.csv.gz' AS ending), struct('polygons' AS kind, '_polygons.csv' AS ending)))")
    paths = paths.where("NOT (kind = 'polygons' AND c_nationkey % 4 = 0) AND NOT (kind = 'expression' AND c_custkey % 6 = 0)")
    return st.triplet_inventory(paths.selectExpr("concat('data/x/S', c_custkey, '_run', ending) AS path")).select("sample", "kind")


@register("read_cell_groups", "SELECT 'customer' AS sample, CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS \"group\" FROM customer")
def cell_groups(spark, folder):
    return st.read_cell_groups(spark, f"{folder}/customer.parquet", r"\.parquet$", {"cell_id": F.col("c_custkey"), "group": F.col("c_mktsegment")})


@register("read_outcomes", "SELECT CASE WHEN c_acctbal > 0 THEN 'success' ELSE 'failure' END AS outcome, c_mktsegment AS indication, count(*) AS programmes, round(sum(c_acctbal), 2) AS gap FROM customer GROUP BY ALL")
def outcomes(spark, folder):
    target = st.scratch_folder(spark) + "/outcomes"
    source = table(spark, folder, "customer")
    values = {c: F.lit("x") for c in st.OUTCOME_COLUMNS} | {
        "programme_id": F.col("c_name"), "outcome": F.when(F.col("c_acctbal") > 0, "success").otherwise("failure"), "indication": F.col("c_mktsegment"), "gap": F.col("c_acctbal"),
    }
    source.select(*[v.alias(c) for c, v in values.items()]).write.option("header", True).csv(target)
    return st.read_outcomes(spark, target).groupBy("outcome", "indication").agg(F.count("*").alias("programmes"), F.round(F.sum("gap"), 2).alias("gap"))


@register("write_parts", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def write_parts(spark, folder):
    target = st.scratch_folder(spark) + "/parts"
    st.write_parts(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), target, 1000)
    return st.read_parts(spark, target)


TEXTS = """txt AS (SELECT 'page-' || page_id AS name, html AS t, 'html' AS expected_kind FROM pages UNION ALL SELECT 'event-' || event_id, props, 'json' FROM events
UNION ALL SELECT 'doc-' || doc_id, CASE doc_id % 6 WHEN 0 THEN '%PDF-1.7' || text WHEN 1 THEN 'PK' || chr(3) || chr(4) || text WHEN 2 THEN '  <?xml ' || text WHEN 3 THEN '{"a": ' || doc_id || '}' ELSE 'note ' || text END, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'xml' WHEN 3 THEN 'pdf' ELSE 'unknown' END FROM documents)"""
KIND = """CASE WHEN t LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' WHEN starts_with(t, 'PK' || chr(3) || chr(4)) THEN 'zip' WHEN starts_with(lower(ltrim(t)), '<!doctype html') OR starts_with(lower(ltrim(t)), '<html') THEN 'html' WHEN starts_with(lower(ltrim(t)), '<?xml') THEN 'xml'
WHEN (starts_with(ltrim(t), '{') OR starts_with(ltrim(t), '[')) AND json_valid(t) THEN 'json' ELSE 'unknown' END"""


def texts(spark, folder):
    doc = table(spark, folder, "documents").selectExpr("concat('doc-', doc_id) AS name", "CASE doc_id % 6 WHEN 0 THEN concat('%PDF-1.7', text) WHEN 1 THEN concat('PK', chr(3), chr(4), text) WHEN 2 THEN concat('  <?xml ', text) WHEN 3 THEN concat('{\"a\": ', doc_id, '}') ELSE concat('note ', text) END AS t", "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'xml' WHEN 3 THEN 'pdf' ELSE 'unknown' END AS expected_kind")
    page = table(spark, folder, "pages").selectExpr("concat('page-', page_id) AS name", "html AS t", "'html' AS expected_kind")
    event = table(spark, folder, "events").selectExpr("concat('event-', event_id) AS name", "props AS t", "'json' AS expected_kind")
    return page.unionByName(event).unionByName(doc).selectExpr("name", "encode(t, 'UTF-8') AS content", "expected_kind")


@register("file_audit", f"WITH {TEXTS} SELECT name, expected_kind, {KIND} AS actual_kind, {KIND} = expected_kind AS valid, CAST(strlen(t) AS BIGINT) AS size_bytes, sha256(t) AS sha256, md5(t) AS md5 FROM txt")
def file_audit(spark, folder):
    return si.file_audit(texts(spark, folder))


@register("audit_status", f"WITH {TEXTS}, a AS (SELECT expected_kind, {KIND} = expected_kind AS valid FROM txt) SELECT expected_kind, count(*) AS files, count(*) FILTER (WHERE NOT valid) AS invalid, CASE WHEN bool_and(valid) THEN 'PASS' ELSE 'FAIL' END AS status FROM a GROUP BY 1")
def audit_status(spark, folder):
    return si.audit_status(si.file_audit(texts(spark, folder)))


@register("manifest_build", "SELECT url AS relative_path, CAST(strlen(html) AS BIGINT) AS size_bytes, sha256(html) AS sha256 FROM pages WHERE url <> (SELECT min(url) FROM pages)")
def manifest_build(spark, folder):
    pages = table(spark, folder, "pages").selectExpr("url AS name", "encode(html, 'UTF-8') AS content")
    own = pages.agg(F.min("name")).first()[0]
    return si.manifest_build(pages, own)


EXPECTED = """e AS (SELECT 'p' || page_id AS name, strlen(html) + CASE WHEN page_id % 11 = 3 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN page_id % 13 = 4 THEN substr(md5(html), 2) WHEN page_id % 17 = 5 THEN md5(url) ELSE md5(html) END AS md5 FROM pages WHERE page_id % 19 <> 6),
o AS (SELECT 'p' || page_id AS name, strlen(html) AS size_bytes, md5(html) AS md5 FROM pages WHERE page_id % 23 <> 7),
v AS (SELECT name, e.name IS NOT NULL AS listed, o.name IS NOT NULL AS present, coalesce(e.size_bytes = o.size_bytes, false) AS size_matches, CASE WHEN e.name IS NULL THEN 'UNLISTED' WHEN o.name IS NULL THEN 'MISSING' WHEN length(e.md5) <> 32 THEN 'EXPECTED_DIGEST_MALFORMED' WHEN o.size_bytes >= 2000 THEN 'NOT_COMPUTED_BY_CONFIGURATION' WHEN e.md5 = o.md5 THEN 'MATCH' ELSE 'MISMATCH' END AS digest_status FROM e FULL JOIN o USING (name))"""


def verified(spark, folder):
    pages = table(spark, folder, "pages").withColumn("size", F.octet_length("html"))
    expected = pages.where("page_id % 19 <> 6").selectExpr("concat('p', page_id) AS name", "size + IF(page_id % 11 = 3, 1, 0) AS size_bytes", "CASE WHEN page_id % 13 = 4 THEN substring(md5(html), 2) WHEN page_id % 17 = 5 THEN md5(url) ELSE md5(html) END AS md5")
    observed = pages.where("page_id % 23 <> 7").selectExpr("concat('p', page_id) AS name", "size AS size_bytes", "md5(html) AS md5")
    return si.manifest_verify(expected, observed, hash_below=2000)


@register("manifest_verify", f"WITH {EXPECTED} SELECT * FROM v")
def manifest_verify(spark, folder):
    return verified(spark, folder)


@register("manifest_roll_up", f"WITH {EXPECTED} SELECT count(*) AS files, bool_and(present) AS all_present, bool_and(present AND size_matches AND digest_status IN ('MATCH', 'NOT_COMPUTED_BY_CONFIGURATION')) AS all_verified, bool_and(digest_status IN ('MATCH', 'MISMATCH')) AS all_digests_computed FROM v WHERE listed")
def manifest_roll_up(spark, folder):
    return si.manifest_roll_up(verified(spark, folder))


@register("parts_verify", """WITH b AS (SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CAST(l_quantity AS BIGINT) AS size, sha256(CAST(l_partkey AS VARCHAR)) AS sha FROM lineitem),
m AS (SELECT source, i + CASE WHEN source % 31 = 2 AND i > 1 THEN 1 ELSE 0 END AS ix, size, sha, sum(size) OVER (PARTITION BY source) + CASE WHEN source % 37 = 3 THEN 1 ELSE 0 END AS total FROM b), p AS (SELECT source, i AS ix, size + CASE WHEN source % 41 = 4 THEN 1 ELSE 0 END AS size, sha FROM b)
SELECT m.source, count(*) AS parts, min(m.ix) = 1 AND max(m.ix) = count(*) AS contiguous, bool_and(coalesce(p.size = m.size, false)) AS sizes_match, bool_and(coalesce(p.sha = m.sha, false)) AS digests_match, CAST(sum(p.size) AS BIGINT) = max(total) AS total_matches FROM m LEFT JOIN p ON p.source = m.source AND p.ix = m.ix GROUP BY 1""")
def parts_verify(spark, folder):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    base = table(spark, folder, "lineitem").withColumn("i", F.row_number().over(order)).selectExpr("l_orderkey AS source", "i", "CAST(l_quantity AS BIGINT) AS size", "sha2(CAST(l_partkey AS STRING), 256) AS sha256")
    totals = base.groupBy("source").agg(F.sum("size").alias("t"))
    manifest = base.join(totals, "source").selectExpr("source", "t + IF(source % 37 = 3, 1, 0) AS source_size", "i + IF(source % 31 = 2 AND i > 1, 1, 0) AS index", "size AS size_bytes", "sha256")
    parts = base.selectExpr("source", "i AS index", "size + IF(source % 41 = 4, 1, 0) AS size_bytes", "sha256")
    return si.parts_verify(manifest, parts)


@register("first_available", """WITH inv AS (SELECT o_custkey AS bundle, CASE o_orderkey % 6 WHEN 0 THEN 'out/cells.parquet' WHEN 1 THEN 'out/cells.csv.gz' WHEN 2 THEN 'out/metrics_summary.csv' WHEN 3 THEN 'out/analysis/pca.csv' WHEN 4 THEN 'out/analysis/big.csv' ELSE 'out/transcripts.parquet' END AS member, CAST(o_totalprice * 300 AS BIGINT) AS size_bytes, o_orderkey % 50 = 7 AS is_dir FROM orders),
pr AS (SELECT * FROM (VALUES ('cells', 'cells.parquet', 1), ('cells', 'cells.csv.gz', 2), ('metrics', 'metrics_summary.csv', 1)) AS t(requirement, name, preference)),
c AS (SELECT bundle, member, row_number() OVER (PARTITION BY bundle, requirement ORDER BY preference, member) AS rn FROM inv JOIN pr ON split_part(member, '/', -1) = name WHERE NOT is_dir)
SELECT bundle, member FROM c WHERE rn = 1 UNION SELECT bundle, member FROM inv WHERE NOT is_dir AND member LIKE '%/analysis/%.csv' AND size_bytes <= 100000000""")
def first_available(spark, folder):
    inventory = table(spark, folder, "orders").selectExpr(
        "o_custkey AS bundle", "CASE o_orderkey % 6 WHEN 0 THEN 'out/cells.parquet' WHEN 1 THEN 'out/cells.csv.gz' WHEN 2 THEN 'out/metrics_summary.csv' WHEN 3 THEN 'out/analysis/pca.csv' WHEN 4 THEN 'out/analysis/big.csv' ELSE 'out/transcripts.parquet' END AS member",
        "CAST(round(o_totalprice * 300) AS BIGINT) AS size_bytes", "o_orderkey % 50 = 7 AS is_dir",
    )
    preferences = spark.createDataFrame([("cells", "cells.parquet", 1), ("cells", "cells.csv.gz", 2), ("metrics", "metrics_summary.csv", 1)], "requirement string, name string, preference int")
    return si.first_available(inventory, preferences)


@register("key_identity_check", """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 5000), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax < 0.08), l AS (SELECT k FROM a EXCEPT SELECT k FROM b), r AS (SELECT k FROM b EXCEPT SELECT k FROM a)
SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM l) AS only_left, (SELECT count(*) FROM r) AS only_right, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM l ORDER BY k LIMIT 10)) AS left_examples,
(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM r ORDER BY k LIMIT 10)) AS right_examples, (SELECT count(*) FROM l) = 0 AND (SELECT count(*) FROM r) = 0 AS identical""")
def key_identity(spark, folder):
    left = table(spark, folder, "orders").where("o_totalprice > 5000").select(F.col("o_orderkey").alias("k"))
    right = table(spark, folder, "lineitem").where("l_tax < 0.08").select(F.col("l_orderkey").alias("k"))
    found = sq.key_identity(left, right, "k")
    return found.withColumns({c: F.col(c).cast("long") for c in ("left_keys", "right_keys", "only_left", "only_right")})


@register("quality_gates", "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys, count(*) FILTER (WHERE l_tax = 0) AS bad_rate, CAST(0 AS BIGINT) AS bad_l_quantity FROM lineitem")
def gates(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("rate", F.expr("CASE WHEN l_tax > 0 THEN 1 / l_tax WHEN l_discount > 0.05 THEN double('NaN') END"))
    return sq.gate_report(rows, ["l_orderkey", "l_linenumber"], ["rate", "l_quantity"])


@register("validated_join", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def validated_join(spark, folder):
    nations = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    joined = sq.validated_join(table(spark, folder, "customer"), nations, ["c_nationkey"], "many_to_one")
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("stable_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('17/' || o_orderkey), o_orderkey LIMIT 2000")
def stable_sample(spark, folder):
    return st.stable_sample(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 17, "o_orderkey", 2000)


@register("build_target_tables", """WITH c AS (SELECT *, contains(lower(CASE user_id % 3 WHEN 0 THEN 'Tumor' WHEN 1 THEN 'Stroma' ELSE '' END), 'tumor') AS tum FROM events), t AS (SELECT 'click' AS target, *, ln(1 + value) AS s, 'protein_intensity' AS m FROM c UNION ALL SELECT 'view', *, CAST(user_id AS DOUBLE) / 8, 'rna_proxy' FROM c)
SELECT target, CAST(event_id AS VARCHAR) AS cell_id, CAST(user_id AS DOUBLE) AS x_um, value AS y_um, tum AS is_tumour, round(s, 6) AS target_signal, CAST(user_id % 4 AS DOUBLE) / 4 AS vessel_signal, CAST(user_id % 8 AS DOUBLE) / 8 AS ecm_score, CAST(user_id % 16 AS DOUBLE) / 16 AS caf_score, value > 100 AS cell_is_malignant_proxy, value AS distance_to_vessel_um, m AS target_measurement, 'pathology_tumour_polygon' AS tumour_region_definition FROM t""")
def target_tables(spark, folder):
    scored = table(spark, folder, "events").selectExpr(
        "event_id AS cell_id", "CAST(user_id AS DOUBLE) AS x_um", "value AS y_um", "CASE user_id % 3 WHEN 0 THEN 'Tumor' WHEN 1 THEN 'Stroma' END AS pathology_region", "ln(1 + value) AS a", "user_id / 8 AS b", "CAST(user_id % 4 AS DOUBLE) / 4 AS vessel_signal",
        "CAST(user_id % 8 AS DOUBLE) / 8 AS local_ecm_score", "CAST(user_id % 16 AS DOUBLE) / 16 AS local_caf_score", "value > 100 AS cell_is_malignant_proxy", "value AS distance_to_vessel_um",
    )
    return rounded(st.build_target_tables(scored, {"click": ("a", "protein_intensity"), "view": ("b", "rna_proxy")}), "target_signal")


@register("concat_samples", "SELECT 'customer' AS sample, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def concat_samples(spark, folder):
    return st.concat_samples({
        "customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
    })


@register("read_case_documents", """SELECT 'ID' || event_id AS case_id, CAST(user_id % 4 AS INT) AS score, event_type AS result, value AS positive_cell_percentage_reported, CASE WHEN event_id % 5 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'tumor_cells' ELSE 'tissue' END AS mask_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '20x' END AS magnification, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'img' || user_id END AS image_file, event_id % 5 <> 0 AND user_id % 3 = 0 AS mask_is_denominator_valid FROM events""")
def case_documents(spark, folder):
    docs = table(spark, folder, "events").selectExpr("""to_json(named_struct('case_id', concat('ID', event_id), 'diagnostic_assessment', map('HER2/neu', named_struct('her2_score', user_id % 4, 'result', event_type, 'positive_cell_percentage', value)),
        'images', array(named_struct('marker_name', 'H&E', 'mask_type', 'tissue', 'magnification', '5x', 'image_file', 'he'), named_struct('marker_name', IF(event_id % 5 = 0, 'KI67', 'Her2/Neu'), 'mask_type', IF(user_id % 3 = 0, 'tumor_cells', 'tissue'), 'magnification', '20x', 'image_file', concat('img', user_id))))) AS value""")
    return st.case_records(docs, "value", "HER2/neu")


@register("validate_manifest_rows", """SELECT event_id, concat_ws('|', CASE WHEN event_id % 7 = 1 THEN 'EXTRA_FIELD' END, CASE WHEN event_id % 5 = 2 THEN 'COORDINATE_UNIT' END, CASE WHEN event_id % 11 = 3 THEN 'CALIBRATION' END) AS issues, NOT (event_id % 7 = 1 OR event_id % 5 = 2 OR event_id % 11 = 3) AS valid FROM events""")
def manifest_rows(spark, folder):
    rows = table(spark, folder, "events").selectExpr("event_id", """concat('{"source":"s', user_id, '"', IF(event_id % 7 = 1, ',"note":1', ''), IF(event_id % 5 = 2, ',"coordinate_unit":"px"', IF(event_id % 2 = 0, ',"coordinate_unit":"um"', '')), IF(event_id % 11 = 3, ',"calibration":-1', IF(event_id % 3 = 0, ',"calibration":2.5', '')), '}') AS doc""")
    found = st.manifest_row_issues(rows, "doc", ["source", "coordinate_unit", "calibration"])
    return found.select("event_id", F.array_join("issues", "|").alias("issues"), "valid")


@register("feature_summary_stream", "SELECT l_partkey AS feature_index, sum(l_quantity) AS total, count(*) AS positive_cells, count(*) FILTER (WHERE l_quantity > 0) AS positive_value_cells FROM lineitem GROUP BY 1")
def summary_stream(spark, folder):
    schema = table(spark, folder, "lineitem").schema
    rows = fs.stream_measurements(spark, folder, schema, {"feature_index": F.col("l_partkey"), "value": F.col("l_quantity")}, "lineitem.parquet")
    return fs.run_available(fs.feature_totals(rows))


# Section plan: cells are orders at (customer, price), features are summed lineitem columns.
SEC = f"""sig AS (SELECT o_orderkey AS cell_id, CAST(o_custkey AS DOUBLE) / 2 AS x, o_totalprice / 1000 AS y, coalesce(sum(l_quantity), 0) AS q, coalesce(round(sum(l_extendedprice), 2), 0) AS p, coalesce(round(sum(l_discount), 2), 0) AS d, coalesce(round(sum(l_tax), 2), 0) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
qs AS (SELECT {", ".join(f"{logq(c, 0.05)} AS lo_{c}, {logq(c, 0.99)} AS hi_{c}" for c in "qpdt")} FROM sig), sc AS (SELECT cell_id, x, y, {", ".join(f"{scale(c, 'lo_' + c, 'hi_' + c)} AS {c}" for c in "qpdt")} FROM sig, qs),
gs AS (SELECT cell_id, x, y, (q + p) / 2 AS endo, d AS peri, (q + t) / 2 AS caf, d AS ecm, t AS mal FROM sc), raw AS (SELECT *, greatest(endo, 0.5 * peri) AS raw FROM gs), {otsu('ov', 'raw', 'raw')}, {otsu('om', 'gs', 'mal')},
vc AS (SELECT raw.*, {aligned('raw', clip('ov.threshold', 0.25, 0.85))} AS signal, mal >= {clip('om.threshold', 0.2, 0.85)} AS malignant FROM raw, ov, om),
vs AS (SELECT DISTINCT x, y FROM vc WHERE signal >= 0.5), ms AS (SELECT DISTINCT x, y FROM vc WHERE malignant), qp AS (SELECT DISTINCT x, y FROM vc),
dv AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS dist FROM qp q, vs s GROUP BY ALL), dm AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS dmal FROM qp q, ms s GROUP BY ALL),
pr AS (SELECT a.cell_id, b.cell_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, b.caf, b.ecm, b.signal >= 0.5 AS v FROM vc a, vc b WHERE abs(a.x-b.x) <= 12 AND abs(a.y-b.y) <= 12),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, other) AS rn FROM pr WHERE d <= 12), lm AS (SELECT cell_id, avg(caf) FILTER (WHERE rn <= 24) AS lcaf, avg(ecm) FILTER (WHERE rn <= 24) AS lecm, least(count(*) FILTER (WHERE v), 32) / 32.0::DOUBLE AS density FROM rk GROUP BY 1)"""


@register("score_cells", f"WITH {SEC} SELECT cell_id, round(signal, 6) AS vessel_signal, signal >= 0.5 AS vessel_positive, round(dist, 6) AS distance_to_vessel_um, round(density, 6) AS local_vessel_density, round(lcaf, 6) AS local_caf_score, round(lecm, 6) AS local_ecm_score, malignant AS cell_is_malignant_proxy, dmal <= 15 AS in_molecular_tumour_neighbourhood FROM vc JOIN dv USING (x, y) JOIN dm USING (x, y) JOIN lm USING (cell_id)")
def score(spark, folder):
    cells = table(spark, folder, "orders").selectExpr("o_orderkey AS cell_id", "o_custkey / 2 AS x_um", "o_totalprice / 1000 AS y_um")
    wide = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"), F.round(F.sum("l_discount"), 2).alias("d"), F.round(F.sum("l_tax"), 2).alias("t")
    )
    groups = {"endothelial": ["q", "p"], "pericyte": ["d"], "caf": ["q", "t"], "ecm": ["d"], "malignant": ["t"], "immune": ["p"]}
    found = score_cells(cells, wide, groups, 24, 12.0, 15.0)
    return rounded(found, "vessel_signal", "distance_to_vessel_um", "local_vessel_density", "local_caf_score", "local_ecm_score").select(
        "cell_id", "vessel_signal", "vessel_positive", "distance_to_vessel_um", "local_vessel_density", "local_caf_score", "local_ecm_score", "cell_is_malignant_proxy", "in_molecular_tumour_neighbourhood"
    )


@register("read_sample_triplets", "SELECT c_mktsegment AS sample, count(*) AS cells, round(sum(c_acctbal), 2) AS signal, CAST(sum(c_nationkey) AS BIGINT) AS fov_sum FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def sample_triplets(spark, folder):
    """Writes three CSV tables per segment (one segment without polygons) and reads them back."""
    target = st.scratch_folder(spark)
    source = table(spark, folder, "customer")
    for segment in sorted(r[0] for r in source.select("c_mktsegment").distinct().collect()):
        one = source.where(F.col("c_mktsegment") == segment)
        key = [F.col("c_nationkey").alias("fov"), F.col("c_custkey").alias("cell_ID")]
        parts = {"_metadata_file": [*key, F.lit(1).alias("Unnamed: 0")], "_exprMat_file": [*key, F.col("c_acctbal").alias("ERBB2"), F.lit(0).alias("ACTB")], "_polygons": key}
        for ending, columns in parts.items():
            if not (segment == "BUILDING" and ending == "_polygons"):
                one.select(*columns).write.option("header", True).csv(f"{target}/{segment}_run{ending}.csv")
    read = st.read_sample_triplets(spark, target, ["ERBB2"])
    return read.groupBy("sample").agg(F.count("*").alias("cells"), F.round(F.sum("ERBB2"), 2).alias("signal"), F.sum(F.col("fov").cast("long")).alias("fov_sum"))


@register("read_parts", "SELECT o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def read_parts(spark, folder):
    target = st.scratch_folder(spark) + "/parts"
    st.write_parts(table(spark, folder, "orders").select("o_orderstatus", "o_totalprice"), target)
    return st.read_parts(spark, target).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("require_columns", "SELECT event_id, user_id, value FROM events")
def require_columns(spark, folder):
    return sq.require_columns(table(spark, folder, "events"), ["event_id", "user_id", "value"]).select("event_id", "user_id", "value")


@register("assert_unique", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def assert_unique(spark, folder):
    return sq.assert_unique(table(spark, folder, "events"), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("rows"))


@register("assert_finite", "SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def assert_finite(spark, folder):
    rows = sq.assert_finite(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"])
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
