"""Summaries of scored events, samples (nations) and polygons."""

from pyspark.sql import functions as F

from checks.geometry import POLY, metrics
from checks.pixels import PIX, PTS, WIN, cells as pixel_cells, pixels
from checks.registry import r6, register, rounded, table
from checks.spatial import P, points, sources
from checks.sqlkit import avg_rank, logq, otsu, scale
from tessella.operators import neighbours as nb
from tessella.operators import pixels as px
from tessella.operators import scaling as sc
from tessella.operators import summaries as su
from tessella.operators.order import spearman

BASE = """base AS (SELECT event_id AS cell_id, CAST(user_id AS DOUBLE) AS x, value AS y, event_type, user_id, value, CASE user_id % 4 WHEN 0 THEN 'Tumor core' WHEN 1 THEN 'Stroma' WHEN 2 THEN 'tumor rim' END AS region,
value > 150 AS malignant, CAST(user_id % 10 AS DOUBLE) / 8 AS immune, CAST(user_id % 7 AS DOUBLE) / 8 AS caf, CAST(user_id % 3 AS DOUBLE) / 2 AS ecm FROM events),
dist AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS distance FROM (SELECT DISTINCT x, y FROM base) q, (SELECT DISTINCT x, y FROM base WHERE event_type = 'error') s GROUP BY ALL),
scored AS (SELECT base.*, distance FROM base JOIN dist USING (x, y))"""
COLUMNS = [
    "event_id AS cell_id", "CAST(user_id AS DOUBLE) AS x", "value AS y", "event_type", "user_id", "value",
    "CASE user_id % 4 WHEN 0 THEN 'Tumor core' WHEN 1 THEN 'Stroma' WHEN 2 THEN 'tumor rim' END AS region", "value > 150 AS malignant",
    "CAST(user_id % 10 AS DOUBLE) / 8 AS immune", "CAST(user_id % 7 AS DOUBLE) / 8 AS caf", "CAST(user_id % 3 AS DOUBLE) / 2 AS ecm",
]


def base(spark, folder):
    return table(spark, folder, "events").selectExpr(*COLUMNS)


def scored(spark, folder):
    cells = base(spark, folder)
    return nb.nearest_distance(cells, sources(cells))


CALLS = """calls AS (SELECT *, 'PD-L1' AS target, 'protein_intensity' AS measurement, ln(1 + value) / 7 AS signal, value > 40 AS positive FROM scored UNION ALL SELECT *, 'LAG-3', 'rna_proxy', immune, user_id % 3 = 0 FROM scored)"""
SUB = """sub AS (SELECT c.*, s.subset FROM calls c, (VALUES ('all_cells'), ('tumour_region'), ('malignant_proxy'), ('immune_high')) AS s(subset) WHERE subset = 'all_cells' OR (subset = 'tumour_region' AND contains(lower(coalesce(region, '')), 'tumor')) OR (subset = 'malignant_proxy' AND malignant) OR (subset = 'immune_high' AND immune >= 0.5))"""


def subsets():
    return {"all_cells": F.lit(True), "tumour_region": F.col("in_tumour"), "malignant_proxy": F.col("malignant"), "immune_high": F.col("immune") >= 0.5}


def calls(cells):
    items = F.expr("array(named_struct('target', 'PD-L1', 'measurement', 'protein_intensity', 'signal', ln(1 + value) / 7, 'positive', value > 40), named_struct('target', 'LAG-3', 'measurement', 'rna_proxy', 'signal', immune, 'positive', user_id % 3 = 0))")
    return cells.select("*", F.inline(items))


A1 = """round(avg(CAST(positive AS INT)), 6) AS positive_fraction, round(avg(CAST(distance <= 25 AS INT)) FILTER (WHERE positive), 6) AS positive_within_25um, round(avg(CAST(distance <= 50 AS INT)) FILTER (WHERE positive), 6) AS positive_within_50um,
round(avg(CAST(distance <= 100 AS INT)) FILTER (WHERE positive), 6) AS positive_within_100um, round(quantile_cont(signal, 0.5), 6) AS median_signal, round(quantile_cont(distance, 0.5) FILTER (WHERE positive), 6) AS median_distance_positive"""


@register("target_spatial_summary", f"""WITH {BASE}, {CALLS}, {SUB} SELECT target, measurement, subset, count(*) AS cells, count(*) FILTER (WHERE positive) AS positive_cells, {A1},
round(quantile_cont(caf, 0.5) FILTER (WHERE positive), 6) AS median_local_caf_positive, round(quantile_cont(ecm, 0.5) FILTER (WHERE positive), 6) AS median_local_ecm_positive FROM sub GROUP BY ALL""")
def target_spatial_summary(spark, folder):
    cells = su.with_tumour(scored(spark, folder), "region", "malignant")
    rows = calls(cells).withColumnsRenamed({"caf": "local_caf", "ecm": "local_ecm"})
    found = su.target_spatial_summary(rows, subsets())
    return rounded(found, *[c for c in found.columns if c not in ("target", "measurement", "subset", "cells", "positive_cells")])


@register("section_summary", P + f""", {otsu('o', 'p', 'y')}, d AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM (SELECT DISTINCT x, y FROM q) q, s GROUP BY ALL),
j AS (SELECT event_type, p.y >= threshold AS positive, d FROM p JOIN d USING (x, y), o)
SELECT event_type AS target, count(*) AS cells, round(avg(CAST(positive AS INT)), 6) AS positive_fraction, round(quantile_cont(d, 0.5) FILTER (WHERE positive), 6) AS median_distance, round(avg(CAST(d <= 25 AS INT)) FILTER (WHERE positive), 6) AS within_25,
round(avg(CAST(d <= 50 AS INT)) FILTER (WHERE positive), 6) AS within_50, round(avg(CAST(d <= 100 AS INT)) FILTER (WHERE positive), 6) AS within_100 FROM j GROUP BY 1""")
def section_summary(spark, folder):
    """Flagship: data-driven call, nearest source, distance shares per type."""
    cells = points(spark, folder)
    measured = nb.nearest_distance(cells, sources(cells))
    called = sc.with_threshold(measured, "y", 0.0, 1e9, "t").withColumn("positive", F.col("y") >= F.col("t"))
    d = F.when(F.col("positive"), F.col("distance"))
    found = su.summarise(called, ["event_type"], [
        F.count("*").alias("cells"), su.share(F.col("positive")).alias("positive_fraction"), su.share(d <= 25).alias("within_25"), su.share(d <= 50).alias("within_50"), su.share(d <= 100).alias("within_100"),
    ], {"median_distance": (d, 0.5)})
    return rounded(found, "positive_fraction", "within_25", "within_50", "within_100", "median_distance").withColumnRenamed("event_type", "target")


@register("pair_concordance", f"""WITH r AS (SELECT l_returnflag, l_discount, l_tax, {avg_rank('l_discount', 'l_returnflag')} AS a, {avg_rank('l_tax', 'l_returnflag')} AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 6) AS spearman, round(avg(CAST(l_discount > 0 AS INT)), 6) AS x_nonzero_fraction, round(avg(CAST(l_tax > 0 AS INT)), 6) AS y_nonzero_fraction, round(CAST(count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS DOUBLE) / count(*) FILTER (WHERE l_discount > 0 OR l_tax > 0), 6) AS nonzero_jaccard,
round(avg(CAST(l_discount > 0 AND l_tax <= 0 AS INT)), 6) AS x_only_fraction, round(avg(CAST(l_tax > 0 AND l_discount <= 0 AS INT)), 6) AS y_only_fraction FROM r GROUP BY 1""")
def pair_concordance(spark, folder):
    found = su.pair_concordance(table(spark, folder, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return rounded(found, *[c for c in found.columns if c != "l_returnflag"])


@register("spearman", f"""WITH r AS (SELECT {avg_rank('l_quantity')} AS a, {avg_rank('l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS pairs, round(corr(a, b), 6) AS rho FROM r""")
def spearman_query(spark, folder):
    return rounded(spearman(table(spark, folder, "lineitem"), [], "l_quantity", "l_extendedprice"), "rho")


@register("safe_spearman", f"""WITH k AS (SELECT o_orderpriority, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey END AS c FROM orders), r AS (SELECT o_orderpriority, o_orderstatus, {avg_rank('o_totalprice', 'o_orderpriority, o_orderstatus')} AS a, {avg_rank('c', 'o_orderpriority, o_orderstatus')} AS b FROM k)
SELECT o_orderpriority, o_orderstatus, count(*) AS pairs, CASE WHEN o_orderstatus <> 'P' THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY o_orderpriority, o_orderstatus""")
def safe_spearman(spark, folder):
    rows = table(spark, folder, "orders").withColumn("c", F.expr("CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey END"))
    return rounded(spearman(rows, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "c"), "rho")


@register("region_summary", f"""WITH {BASE} SELECT region, count(*) AS cells, """ + ", ".join(
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS {c}_median, round(quantile_cont(CAST({c} AS DOUBLE), 0.9), 6) AS {c}_q90" for c in ("distance", "immune", "caf", "malignant")) + " FROM scored GROUP BY 1")
def region_summary(spark, folder):
    found = su.region_summary(scored(spark, folder), "region", ["distance", "immune", "caf", "malignant"])
    return rounded(found, *[c for c in found.columns if c not in ("region", "cells")])


DEFS = {"inclusive": "event_type IN ('error', 'click')", "errors": "event_type = 'error'", "strict": "event_type = 'error' AND value > 30"}
A4 = "{BASE}, dd AS (" + " UNION ALL ".join(f"SELECT '{n}' AS definition, *, {c} AS source FROM base" for n, c in DEFS.items()) + """),
ds AS (SELECT q.definition, q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM (SELECT DISTINCT definition, x, y FROM dd) q JOIN (SELECT DISTINCT definition, x, y FROM dd WHERE source) s USING (definition) GROUP BY ALL),
de AS (SELECT dd.*, d, contains(lower(coalesce(region, '')), 'tumor') AS tum FROM dd JOIN ds USING (definition, x, y)),
bs AS (SELECT definition, count(*) FILTER (WHERE source) AS source_cells, avg(CAST(source AS INT)) AS source_fraction, quantile_cont(d, 0.5) AS all_median, quantile_cont(d, 0.9) AS all_q90, quantile_cont(d, 0.5) FILTER (WHERE tum) AS tumour_median, quantile_cont(d, 0.9) FILTER (WHERE tum) AS tumour_q90 FROM de GROUP BY 1),
tg AS (SELECT definition, 'PD-L1' AS target, d, value > 40 AND tum AS hit FROM de UNION ALL SELECT definition, 'LAG-3', d, user_id % 3 = 0 AND tum FROM de),
pt AS (SELECT definition, target, count(*) FILTER (WHERE hit) AS target_positive_tumour_cells, avg(CAST(d <= 25 AS INT)) FILTER (WHERE hit) AS within_25, avg(CAST(d <= 50 AS INT)) FILTER (WHERE hit) AS within_50, avg(CAST(d <= 100 AS INT)) FILTER (WHERE hit) AS within_100, quantile_cont(d, 0.5) FILTER (WHERE hit) AS target_median, quantile_cont(d, 0.9) FILTER (WHERE hit) AS target_q90 FROM tg GROUP BY ALL),
sens AS (SELECT * FROM pt JOIN bs USING (definition))""".replace("{BASE}", "")
A4 = A4.replace("{BASE}", BASE)
METRICS = ["source_fraction", "all_median", "all_q90", "tumour_median", "tumour_q90", "within_25", "within_50", "within_100", "target_median", "target_q90"]


def sensitivity(spark, folder):
    rows = sc.definition_rows(base(spark, folder), {n: F.expr(c) for n, c in DEFS.items()})
    tumour = F.lower(F.coalesce("region", F.lit(""))).contains("tumor")
    return su.definition_sensitivity(rows, {"PD-L1": F.col("value") > 40, "LAG-3": F.col("user_id") % 3 == 0}, tumour)


@register("definition_sensitivity", f"WITH {A4} SELECT definition, target, target_positive_tumour_cells, source_cells, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM sens")
def definition_sensitivity(spark, folder):
    return rounded(sensitivity(spark, folder), *METRICS)


@register("robustness_ranges", f"WITH {A4} SELECT target, count(DISTINCT definition) AS definitions, " + ", ".join(f"round({f}({m}), 6) AS {n}_{m}" for m in ("target_median", "within_50", "within_100") for n, f in (("minimum", "min"), ("maximum", "max"))) + " FROM sens GROUP BY 1")
def robustness_ranges(spark, folder):
    found = su.robustness_ranges(sensitivity(spark, folder), ["target_median", "within_50", "within_100"])
    return rounded(found, *[c for c in found.columns if c not in ("target", "definitions")])


@register("segmentation_robustness", f"""WITH {POLY}, j AS (SELECT o_orderpriority, vertices, area, compactness, abs(area - o_totalprice / 100) / greatest(o_totalprice / 100, 1e-9) AS err FROM orders LEFT JOIN poly ON cell_id = o_orderkey)
SELECT o_orderpriority, count(*) AS cells, round(avg(CAST(area IS NOT NULL AS INT)), 6) AS coverage, round(avg(CAST(coalesce(err <= 0.01, false) AS INT)), 6) AS within_1pct, round(avg(CAST(coalesce(err <= 0.05, false) AS INT)), 6) AS within_5pct, round(avg(CAST(coalesce(err <= 0.1, false) AS INT)), 6) AS within_10pct,
round(quantile_cont(err, 0.5), 6) AS median_error, round(quantile_cont(err, 0.95), 6) AS q95_error, quantile_cont(CAST(vertices AS DOUBLE), 0.5) AS median_vertices, round(quantile_cont(compactness, 0.5), 6) AS median_compactness FROM j GROUP BY 1""")
def segmentation(spark, folder):
    cells = table(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id"), "o_orderpriority", (F.col("o_totalprice") / 100).alias("stated"))
    found = su.segmentation_robustness(cells, metrics(spark, folder), "cell_id", "stated", ["o_orderpriority"])
    return rounded(found, *[c for c in found.columns if c not in ("o_orderpriority", "cells", "median_vertices")])


@register("segmentation_by_sample", f"""WITH {POLY}, j AS (SELECT c_nationkey AS sample, area, abs(area - o_totalprice / 100) / greatest(o_totalprice / 100, 1) AS ae, CASE WHEN area IS NOT NULL THEN sqrt(pow(centroid_x - 25, 2) + pow(centroid_y - 200, 2)) END AS ce FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN poly ON cell_id = o_orderkey)
SELECT sample, count(*) AS cells, round(avg(CAST(area IS NOT NULL AS INT)), 6) AS matched_fraction, round(avg(CAST(ae <= 0.1 AS INT)), 6) AS area_within_10pct, round(avg(CAST(ce <= 2 AS INT)), 6) AS centroid_within_2px,
round(quantile_cont(ae, 0.5), 6) AS median_area_error, round(quantile_cont(ae, 0.95), 6) AS q95_area_error, round(quantile_cont(ce, 0.5), 5) AS median_centroid_error, round(quantile_cont(ce, 0.95), 4) AS q95_centroid_error FROM j GROUP BY 1""")
def segmentation_by_sample(spark, folder):
    cells = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")).selectExpr(
        "o_orderkey AS cell_id", "c_nationkey AS sample", "o_totalprice / 100 AS stated", "25D AS cx", "200D AS cy"
    )
    found = su.segmentation_by_sample(cells, metrics(spark, folder), ["cell_id"], "stated", "cx", "cy")
    found = rounded(found, "matched_fraction", "area_within_10pct", "centroid_within_2px", "median_area_error", "q95_area_error")
    return found.withColumns({"median_centroid_error": F.round("median_centroid_error", 5), "q95_centroid_error": F.round("q95_centroid_error", 4)})


# Fields: sample = event type, fov = user_id % 10, four markers from user and value.
FIELD = """fld AS (SELECT event_type AS sample, user_id % 10 AS fov, CAST(user_id AS DOUBLE) AS x, value AS y, CAST(value > 60 AS INT) + CAST(user_id % 5 = 0 AS INT) + CAST(user_id % 7 = 0 AS INT) + CAST(value > 90 AS INT) AS m, value - 60 AS ta, user_id % 4 AS tb, 5 - user_id % 8 AS tc FROM events),
fd AS (SELECT fld.*, definition, required, m >= required AS proxy FROM fld, (VALUES ('inclusive', 2), ('balanced', 3), ('strict', 4)) AS v(definition, required)),
fn AS (SELECT q.sample, q.definition, q.fov, q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM (SELECT DISTINCT sample, definition, fov, x, y FROM fd) q LEFT JOIN (SELECT DISTINCT sample, definition, fov, x, y FROM fd WHERE proxy) s USING (sample, definition, fov) GROUP BY ALL),
fm AS (SELECT fd.*, d FROM fd JOIN fn USING (sample, definition, fov, x, y)), tr AS (SELECT sample, definition, d, 'ta' AS target, ta > 0 AS hit FROM fm UNION ALL SELECT sample, definition, d, 'tb', tb > 0 FROM fm UNION ALL SELECT sample, definition, d, 'tc', tc > 0 FROM fm),
geo AS (SELECT sample, definition, target, count(*) AS cells, count(*) FILTER (WHERE hit) AS positive_cells, avg(CAST(hit AS INT)) AS positive_fraction, count(d) FILTER (WHERE hit) AS positive_with_distance, avg(CAST(d <= 25 AS INT)) FILTER (WHERE hit AND d IS NOT NULL) AS within_25px, avg(CAST(d <= 100 AS INT)) FILTER (WHERE hit AND d IS NOT NULL) AS within_100px, quantile_cont(d, 0.5) FILTER (WHERE hit) AS median_distance_px, quantile_cont(d, 0.9) FILTER (WHERE hit) AS q90_distance_px FROM tr GROUP BY ALL),
ratio AS (SELECT sample, target, min(median_distance_px) AS minimum_median, max(median_distance_px) AS maximum_median, min(within_100px) AS minimum_near, max(within_100px) AS maximum_near, max(median_distance_px) / nullif(min(median_distance_px), 0) AS definition_distance_ratio FROM geo GROUP BY ALL),
bal AS (SELECT a.sample AS sample_left, b.sample AS sample_right, a.median_distance_px AS l, b.median_distance_px AS r FROM geo a JOIN geo b USING (target) WHERE a.definition = 'strict' AND b.definition = 'strict' AND a.sample < b.sample),
rks AS (SELECT sample_left, sample_right, """ + avg_rank("l", "sample_left, sample_right") + " AS rl, " + avg_rank("r", "sample_left, sample_right") + """ AS rr FROM bal WHERE l IS NOT NULL AND r IS NOT NULL),
stab AS (SELECT sample_left, sample_right, count(*) AS targets_compared, CASE WHEN count(*) >= 3 AND stddev_pop(rl) > 0 AND stddev_pop(rr) > 0 THEN corr(rl, rr) END AS rho FROM rks GROUP BY ALL)"""


def field_cells(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_type AS sample", "user_id % 10 AS fov", "CAST(user_id AS DOUBLE) AS x", "value AS y", "CAST(value > 60 AS INT) AS m1", "CAST(user_id % 5 = 0 AS INT) AS m2",
        "CAST(user_id % 7 = 0 AS INT) AS m3", "CAST(value > 90 AS INT) AS m4", "value - 60 AS ta", "user_id % 4 AS tb", "5 - user_id % 8 AS tc",
    )


MARKERS, REQUIRED = ["m1", "m2", "m3", "m4"], {"inclusive": 2, "balanced": 3, "strict": 4}


def geometry(spark, folder):
    return su.relative_geometry(field_cells(spark, folder), MARKERS, REQUIRED, ["ta", "tb", "tc"])


@register("relative_geometry", f"WITH {FIELD} SELECT sample, definition, target, cells, positive_cells, positive_with_distance, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("positive_fraction", "within_25px", "within_100px", "median_distance_px", "q90_distance_px")) + " FROM geo")
def relative_geometry(spark, folder):
    return rounded(geometry(spark, folder)[0], "positive_fraction", "within_25px", "within_100px", "median_distance_px", "q90_distance_px")


@register("relative_geometry_definitions", f"WITH {FIELD} SELECT sample, definition, CAST(required AS INT) AS required, count(*) FILTER (WHERE proxy) AS proxy_cells, round(avg(CAST(proxy AS INT)), 6) AS proxy_fraction, count(DISTINCT CASE WHEN proxy THEN fov END) AS fovs_with_proxy FROM fd GROUP BY ALL")
def geometry_definitions(spark, folder):
    return rounded(su.definition_table(sc.marker_count_call(field_cells(spark, folder), MARKERS, REQUIRED)), "proxy_fraction")


@register("definition_ratio", f"WITH {FIELD} SELECT sample, target, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("minimum_median", "maximum_median", "minimum_near", "maximum_near", "definition_distance_ratio")) + " FROM ratio")
def definition_ratio(spark, folder):
    return rounded(su.definition_ratio(geometry(spark, folder)[0]), "minimum_median", "maximum_median", "minimum_near", "maximum_near", "definition_distance_ratio")


@register("sample_rank_stability", f"WITH {FIELD} SELECT sample_left, sample_right, targets_compared, round(rho, 6) AS spearman_target_rank FROM stab")
def rank_stability(spark, folder):
    return rounded(su.sample_rank_stability(geometry(spark, folder)[0], "strict"), "spearman_target_rank")


@register("stability_verdict", f"""WITH {FIELD}, a AS (SELECT quantile_cont(definition_distance_ratio, 0.5) AS med, max(definition_distance_ratio) AS mx, count(definition_distance_ratio) AS nr FROM ratio), b AS (SELECT quantile_cont(rho, 0.5) AS mr, coalesce(bool_and(rho >= 0.7), true) AS ok, count(rho) AS n FROM stab)
SELECT round(med, 6) AS median_ratio, round(mx, 6) AS maximum_ratio, round(mr, 6) AS median_rank_spearman, n > 0 AND ok AS generalises, CASE WHEN nr > 0 AND (med > 2 OR NOT ok) THEN 'DEFINITION_SENSITIVE_AND_TARGET_RANKING_NOT_STABLE' ELSE 'RELATIVELY_STABLE_WITHIN_TESTED_DEFINITIONS' END AS interpretation FROM a, b""")
def verdict(spark, folder):
    from tessella.session import cut_lineage

    geo = cut_lineage(geometry(spark, folder)[0])
    return rounded(su.stability_verdict(su.definition_ratio(geo), su.sample_rank_stability(geo, "strict")), "median_ratio", "maximum_ratio", "median_rank_spearman")


GRP = "grp AS (SELECT n_name AS sample, c_custkey AS cell_id, CAST(c_custkey % 3 AS VARCHAR) || '_' || c_mktsegment AS \"group\", c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def groups(spark, folder):
    joined_tables = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined_tables.selectExpr("n_name AS sample", "c_custkey AS cell_id", "concat(c_custkey % 3, '_', c_mktsegment) AS group", "c_acctbal")


@register("group_composition", f"WITH {GRP}, c AS (SELECT sample, substr(\"group\", 3) AS broad_group, count(*) AS cells FROM grp GROUP BY ALL) SELECT *, round(CAST(cells AS DOUBLE) / sum(cells) OVER (PARTITION BY sample), 6) AS fraction FROM c")
def composition(spark, folder):
    return rounded(su.group_composition(groups(spark, folder)), "fraction")


@register("sample_summary", f"WITH {GRP} SELECT sample, count(*) AS cells, count(DISTINCT \"group\") AS provider_groups, count(DISTINCT substr(\"group\", 3)) AS broad_groups FROM grp GROUP BY 1")
def sample_summary(spark, folder):
    return su.sample_summary(groups(spark, folder))


FBG = f"{GRP}, fb AS (SELECT sample, substr(\"group\", 3) AS broad, count(*) AS cells, avg(c_acctbal) AS mean, sum(c_acctbal) AS total, avg(CAST(c_acctbal > 0 AS INT)) AS positive_fraction, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.9) AS q90 FROM grp GROUP BY ALL)"


def by_group(spark, folder):
    return su.feature_by_group(groups(spark, folder).withColumn("broad", F.expr("substring(group, 3)")), "c_acctbal", ["sample", "broad"])


@register("feature_by_group", f"WITH {FBG} SELECT sample, broad, cells, round(mean, 4) AS mean, round(total, 2) AS total, round(positive_fraction, 6) AS positive_fraction, round(median, 4) AS median, round(q90, 4) AS q90 FROM fb")
def feature_by_group(spark, folder):
    found = by_group(spark, folder)
    return found.withColumns({"mean": F.round("mean", 4), "total": F.round("total", 2), "positive_fraction": r6("positive_fraction"), "median": F.round("median", 4), "q90": F.round("q90", 4)})


@register("group_fold", f"WITH {FBG} SELECT a.broad, round(a.mean / nullif(b.mean, 0), 6) AS fold FROM fb a JOIN fb b USING (broad) WHERE a.sample = 'NATION_1' AND b.sample = 'NATION_2'")
def group_fold(spark, folder):
    return rounded(su.group_fold(by_group(spark, folder), "broad", "sample", "NATION_1", "NATION_2"), "fold")


@register("assignment_agreement", f"""WITH {BASE}, {CALLS}, {SUB}, z AS (SELECT *, signal > 0.6 AS img FROM sub) SELECT target, subset, count(*) AS cells, round(avg(CAST(positive AS INT)), 6) AS reference_positive_fraction, round(avg(CAST(img AS INT)), 6) AS image_positive_fraction, round(avg(CAST(positive AND img AS INT)), 6) AS both_positive_fraction,
round(avg(CAST(positive AND NOT img AS INT)), 6) AS reference_only_fraction, round(avg(CAST(NOT positive AND img AS INT)), 6) AS image_only_fraction, round(quantile_cont(distance, 0.5) FILTER (WHERE positive AND img), 6) AS median_distance, round(quantile_cont(caf, 0.5) FILTER (WHERE positive AND img), 6) AS median_caf FROM z GROUP BY ALL""")
def agreement(spark, folder):
    rows = calls(su.with_tumour(scored(spark, folder), "region", "malignant")).withColumn("img", F.col("signal") > 0.6)
    found = su.assignment_agreement(rows, subsets(), "positive", "img", {"median_distance": "distance", "median_caf": "caf"})
    return rounded(found, *[c for c in found.columns if c not in ("target", "subset", "cells")])


STEPS = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dr, dc)"
CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dr, dc)"
IDS = f"""{PIX}, {PTS}, smp AS (SELECT pts.*, pix.v FROM pts JOIN pix USING ("row", col)), lv AS (SELECT quantile_cont(v, 0.99) FILTER (WHERE event_type <> 'error') AS a, quantile_cont(v, 0.995) FILTER (WHERE event_type <> 'error') AS b, quantile_cont(v, 0.999) FILTER (WHERE event_type <> 'error') AS c FROM smp),
defs AS (SELECT 'inclusive_1pct' AS definition, a AS threshold FROM lv UNION ALL SELECT 'balanced_0_5pct', b FROM lv UNION ALL SELECT 'strict_0_1pct', c FROM lv), dim AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w, count(*) AS n FROM pix),
msk AS (SELECT definition, "row", col FROM pix, defs WHERE v > threshold),
reach(definition, r1, c1, r2, c2) AS (SELECT definition, "row", col, "row", col FROM msk UNION SELECT m.definition, reach.r1, reach.c1, m."row", m.col FROM reach, {STEPS} JOIN msk m ON true WHERE m.definition = reach.definition AND m."row" = reach.r2 + s.dr AND m.col = reach.c2 + s.dc),
cmp AS (SELECT definition, r1 AS "row", c1 AS col, min(CAST(r2 AS BIGINT) * 64 + c2) AS id, count(*) AS n FROM reach GROUP BY ALL), kp AS (SELECT definition, "row", col FROM cmp WHERE n >= 3),
dil AS (SELECT DISTINCT definition, "row" + dr AS "row", col + dc AS col FROM kp, {CROSS}, dim WHERE "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1),
clo AS (SELECT d.definition, d."row" - dr AS "row", d.col - dc AS col FROM dil d, {CROSS}, dim WHERE d."row" - dr BETWEEN 0 AND h - 1 AND d.col - dc BETWEEN 0 AND w - 1 GROUP BY ALL HAVING count(*) = 5),
reach2(definition, r1, c1, r2, c2) AS (SELECT definition, "row", col, "row", col FROM clo UNION SELECT m.definition, reach2.r1, reach2.c1, m."row", m.col FROM reach2, {STEPS} JOIN clo m ON true WHERE m.definition = reach2.definition AND m."row" = reach2.r2 + s.dr AND m.col = reach2.c2 + s.dc),
cmp2 AS (SELECT definition, id, count(*) AS n FROM (SELECT definition, r1, c1, min(CAST(r2 AS BIGINT) * 64 + c2) AS id FROM reach2 GROUP BY ALL) GROUP BY ALL), k2 AS (SELECT definition, count(*) AS k, sum(n) AS px, quantile_cont(n, 0.5) AS md FROM cmp2 GROUP BY 1), k1 AS (SELECT definition, count(DISTINCT id) AS k FROM cmp GROUP BY 1),
di AS (SELECT defs.definition, defs.threshold, smp.*  FROM smp, defs),
dp AS (SELECT p.definition, p."row", p.col, 3.4 * sqrt(min((CAST(p."row" AS DOUBLE) - c."row") * (p."row" - c."row") + (CAST(p.col AS DOUBLE) - c.col) * (p.col - c.col))) AS d FROM (SELECT DISTINCT definition, "row", col FROM di) p LEFT JOIN clo c ON c.definition = p.definition GROUP BY ALL),
ms AS (SELECT di.definition, threshold, event_type, value, d FROM di JOIN dp USING (definition, "row", col)),
bs AS (SELECT definition, any_value(threshold) AS threshold, avg(CAST(d <= 3.4 AS INT)) FILTER (WHERE event_type = 'error') AS pn, avg(CAST(d <= 3.4 AS INT)) FILTER (WHERE event_type <> 'error') AS nn, quantile_cont(d, 0.5) AS am, quantile_cont(d, 0.5) FILTER (WHERE value > 20) AS tm FROM ms GROUP BY 1),
tg AS (SELECT definition, 'PD-L1' AS target, d, value > 40 AND value > 20 AS hit FROM ms UNION ALL SELECT definition, 'LAG-3', d, event_type = 'view' AND value > 20 FROM ms),
pt AS (SELECT definition, target, count(*) FILTER (WHERE hit) AS target_positive_tumour_cells, avg(CAST(d <= 25 AS INT)) FILTER (WHERE hit AND d IS NOT NULL) AS a, avg(CAST(d <= 50 AS INT)) FILTER (WHERE hit AND d IS NOT NULL) AS b, avg(CAST(d <= 100 AS INT)) FILTER (WHERE hit AND d IS NOT NULL) AS c, quantile_cont(d, 0.5) FILTER (WHERE hit) AS m, quantile_cont(d, 0.9) FILTER (WHERE hit) AS q FROM tg GROUP BY ALL)"""


@register("image_definition_sensitivity", f"""WITH RECURSIVE {IDS} SELECT definition, target, target_positive_tumour_cells, round(pt.a, 6) AS target_within_25, round(pt.b, 6) AS target_within_50, round(pt.c, 6) AS target_within_100, round(m, 6) AS target_median, round(q, 6) AS target_q90, round(pn, 6) AS positive_within_near, round(nn, 6) AS negative_within_near, round(am, 6) AS all_cell_median, round(tm, 6) AS tumour_cell_median,
3 AS minimum_component_pixels, k1.k AS raw_components, coalesce(k2.k, 0) AS retained_components, round(coalesce(px, 0) / CAST(dim.n AS DOUBLE), 6) AS pixel_fraction, round(coalesce(md, 0) * 3.4 * 3.4, 6) AS median_component_area_um2, threshold FROM pt JOIN bs USING (definition) LEFT JOIN k1 USING (definition) LEFT JOIN k2 USING (definition), dim""")
def image_sensitivity(spark, folder):
    cells = px.pixel_at_points(pixel_cells(spark, folder), pixels(spark, folder), ["v"]).withColumn("sampled", F.col("v").cast("double"))
    found, _ = su.image_definition_sensitivity(
        cells, pixels(spark, folder), "v", "sampled", F.col("event_type") != "error", {"inclusive_1pct": 0.99, "balanced_0_5pct": 0.995, "strict_0_1pct": 0.999},
        {"PD-L1": F.col("value") > 40, "LAG-3": F.col("event_type") == "view"}, F.col("value") > 20, 3.4, 25.0,
    )
    keep = ("definition", "target", "target_positive_tumour_cells", "minimum_component_pixels", "raw_components", "retained_components", "threshold")
    return rounded(found, *[c for c in found.columns if c not in keep])


CHN = f"""{WIN}, cc AS (SELECT event_type AS channel, value AS ref, local_mean AS smp FROM pts JOIN win USING (cell_id)), ck AS (SELECT channel, {logq('ref', 0.05)} AS lo, {logq('ref', 0.99)} AS hi FROM cc GROUP BY 1),
cs AS (SELECT channel, ref, smp, {scale('ref', 'lo', 'hi')} AS s FROM cc JOIN ck USING (channel)), {otsu('ot', 'cs', 's', 'channel')}, cp AS (SELECT cs.*, threshold, s >= threshold AS pos FROM cs JOIN ot USING (channel)),
lv AS (SELECT channel, quantile_cont(smp, 0.995) FILTER (WHERE NOT pos) AS t FROM cp GROUP BY 1), rr AS (SELECT channel, {avg_rank('smp', 'channel')} AS a, {avg_rank('ref', 'channel')} AS b FROM cc), rh AS (SELECT channel, corr(a, b) AS rho FROM rr GROUP BY 1),
ch AS (SELECT channel, v, "row" % 11 = 0 AS qc FROM pix, (SELECT DISTINCT event_type AS channel FROM events)), md AS (SELECT channel, v FROM (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, v) AS rn FROM ch WHERE v > 0 AND NOT qc GROUP BY channel, v) WHERE rn = 1), qf AS (SELECT channel, avg(CAST(qc AS INT)) AS q FROM ch GROUP BY 1)"""


@register("channel_concordance", f"""WITH {CHN} SELECT channel, CAST(any_value(md.v) AS DOUBLE) AS baseline_mode, round(any_value(q), 6) AS qc_mask_fraction, round(any_value(threshold), 6) AS reference_threshold, round(any_value(t), 6) AS image_threshold, round(avg(CAST(pos AS INT)), 6) AS reference_positive_fraction, round(avg(CAST(smp > t AS INT)), 6) AS image_positive_fraction,
round(avg(CAST(smp > t AS INT)) FILTER (WHERE NOT pos), 6) AS false_positive_rate, round(avg(CAST(smp > t AS INT)) FILTER (WHERE pos), 6) AS true_positive_rate, round(any_value(rho), 6) AS cell_image_spearman FROM cp JOIN lv USING (channel) JOIN rh USING (channel) JOIN md USING (channel) JOIN qf USING (channel) GROUP BY 1""")
def channel_concordance(spark, folder):
    p = pixels(spark, folder)
    cells = px.window_mean_at_points(pixel_cells(spark, folder), p, "v", 1).withColumnsRenamed({"event_type": "channel"})
    names = table(spark, folder, "events").select(F.col("event_type").alias("channel")).distinct()
    every = names.agg(F.collect_set("channel").alias("names"))
    from tessella.session import attach

    images = attach(p, every).select("row", "col", "v", F.explode("names").alias("channel"), (F.col("row") % 11 == 0).alias("qc"))
    found = su.channel_concordance(cells, images, "value", "local_mean", "v")
    return rounded(found, *[c for c in found.columns if c not in ("channel", "baseline_mode")])


@register("label_group_summary", "SELECT p_size, count(*) AS observations, round(min(p_retailprice), 6) AS minimum_p_retailprice, round(max(p_retailprice), 6) AS maximum_p_retailprice, round(quantile_cont(p_retailprice, 0.5), 6) AS median_p_retailprice FROM part GROUP BY 1")
def label_groups(spark, folder):
    found = su.label_group_summary(table(spark, folder, "part"), "p_size", ["p_retailprice"], True)
    return rounded(found, "minimum_p_retailprice", "maximum_p_retailprice", "median_p_retailprice")


@register("match_rate", "SELECT c_nationkey, count(*) AS rows, count(o_custkey) AS matched, round(avg(CAST(o_custkey IS NOT NULL AS INT)), 6) AS matched_fraction FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1")
def match_rate(spark, folder):
    orders = table(spark, folder, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return rounded(su.match_rate(table(spark, folder, "customer"), orders, ["c_custkey"], ["c_nationkey"]), "matched_fraction")


@register("prior_bounds", "SELECT s_nationkey, count(v) AS values, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM (SELECT s_nationkey, unnest([s_acctbal * 10, s_acctbal * 8, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 13 END]) AS v FROM supplier) GROUP BY 1")
def prior_bounds(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_nationkey", "s_acctbal AS c", "s_acctbal * 0.8 AS l", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 1.3 END AS u")
    return rounded(su.prior_bounds(rows, "c", "l", "u", ["s_nationkey"]), "minimum", "maximum")


