"""Scales, thresholds and calls over events and per-order sums of lineitem."""

from pyspark.sql import functions as F

from checks.registry import r6, register, rounded, table
from checks.sqlkit import aligned, clip, logq, otsu, scale
from tessella.operators import scaling as sc
from tessella.session import cut_lineage


def signals(spark, folder):
    """One cell per order with four non-negative signals."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"),
        F.round(F.sum("l_discount"), 2).alias("d"), F.round(F.sum("l_tax"), 2).alias("t"),
    )


SIG = "sig AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p, round(sum(l_discount), 2) AS d, round(sum(l_tax), 2) AS t FROM lineitem GROUP BY 1)"
QS = "qs AS (SELECT " + ", ".join(f"{logq(c, 0.05)} AS lo_{c}, {logq(c, 0.99)} AS hi_{c}" for c in "qpdt") + " FROM sig)"
SCALED = "sc AS (SELECT cell_id, " + ", ".join(f"{scale(c, 'lo_' + c, 'hi_' + c)} AS {c}" for c in "qpdt") + " FROM sig, qs)"
SCORES = f"{SIG}, {QS}, {SCALED}, scores AS (SELECT cell_id, (q + p) / 2 AS endothelial, d AS pericyte, t AS malignant, (q + t) / 2 AS caf FROM sc)"


def scores(spark, folder, cells=None):
    found = sc.group_score(signals(spark, folder) if cells is None else cells, {"endothelial": ["q", "p"], "pericyte": ["d"], "malignant": ["t"], "caf": ["q", "t"]})
    return found.select("cell_id", "endothelial", "pericyte", "malignant", "caf")


@register("robust_scale", f"WITH k AS (SELECT event_type, {logq('value', 0.05)} AS lo, {logq('value', 0.99)} AS hi FROM events GROUP BY 1) SELECT event_id, round({scale('value', 'lo', 'hi')}, 6) AS scaled FROM events JOIN k USING (event_type)")
def robust(spark, folder):
    found = sc.robust_scale(table(spark, folder, "events"), {"value": "scaled"}, ["event_type"])
    return found.select("event_id", r6("scaled").alias("scaled"))


@register("otsu_threshold", f"WITH {otsu('o', 'events', 'value', 'event_type')}, {otsu('a', 'events', 'value')} SELECT event_type, round(threshold, 6) AS threshold FROM o UNION ALL SELECT 'all', round(threshold, 6) FROM a")
def otsu_query(spark, folder):
    events = table(spark, folder, "events")
    per_type = sc.otsu_threshold(events, "value", ["event_type"])
    return rounded(per_type.unionByName(sc.otsu_threshold(events, "value").withColumn("event_type", F.lit("all"))), "threshold")


@register("group_score", f"WITH {SCORES} SELECT cell_id, round(endothelial, 6) AS endothelial, round(pericyte, 6) AS pericyte, round(malignant, 6) AS malignant, round(caf, 6) AS caf FROM scores")
def group_score(spark, folder):
    return rounded(scores(spark, folder), "endothelial", "pericyte", "malignant", "caf")


@register("threshold_aligned_scale", f"SELECT event_id, round({aligned('value / 500', '0.3')}, 6) AS signal FROM events")
def aligned_scale(spark, folder):
    return table(spark, folder, "events").select("event_id", r6(sc.threshold_aligned(F.col("value") / 500, F.lit(0.3))).alias("signal"))


VESSEL = f"""{SCORES}, raw AS (SELECT cell_id, greatest(endothelial, 0.5 * pericyte) AS raw FROM scores), {otsu('o', 'raw', 'raw')},
th AS (SELECT {clip('threshold', 0.25, 0.85)} AS t, (SELECT quantile_cont(raw, 0.99) FROM raw) AS q99 FROM o),
sh AS (SELECT avg(CAST({aligned('raw', 't')} >= 0.5 AS INT)) AS share FROM raw, th),
vessel AS (SELECT cell_id, CASE WHEN share < 0.001 THEN {aligned('raw', 'greatest(q99, 1e-6)')} ELSE {aligned('raw', 't')} END AS signal FROM raw, th, sh)"""


@register("vessel_call", f"WITH {VESSEL} SELECT cell_id, round(signal, 6) AS vessel_signal, signal >= 0.5 AS vessel_positive FROM vessel")
def vessel(spark, folder):
    found = sc.vessel_call(scores(spark, folder), "endothelial", "pericyte")
    return rounded(found, "vessel_signal").select("cell_id", "vessel_signal", "vessel_positive")


@register("malignant_proxy", f"WITH {SCORES}, {otsu('o', 'scores', 'malignant')} SELECT cell_id, malignant >= {clip('threshold', 0.2, 0.85)} AS cell_is_malignant_proxy FROM scores, o")
def malignant(spark, folder):
    return sc.malignant_proxy(scores(spark, folder), "malignant").select("cell_id", "cell_is_malignant_proxy")


TARGETS = f"""{SIG}, {QS}, {SCALED}, long AS (SELECT cell_id, 'PD-L1' AS target, 'protein_intensity' AS measurement, q AS raw FROM sc UNION ALL SELECT cell_id, 'VISTA', 'protein_intensity', (p + d) / 2 FROM sc UNION ALL SELECT cell_id, 'LAG-3', 'rna_proxy', t FROM sc),
{otsu('o', 'long', 'raw', 'target')}, calls AS (SELECT cell_id, target, measurement, {aligned('raw', clip('threshold', 0.1, 0.9))} AS signal FROM long JOIN o USING (target))"""


def target_long(spark, folder):
    """Target columns resolved from a catalogue of columns: protein first, otherwise RNA."""
    resolved = spark.createDataFrame(
        [("PD-L1", "protein__q"), ("PD-L1", "rna__t"), ("VISTA", "protein__p"), ("VISTA", "protein__d"), ("LAG-3", "rna__t")],
        "target string, column string",
    )
    active = sc.prefer_protein(resolved)
    scaled = sc.robust_scale(signals(spark, folder), {c: f"s_{c}" for c in "qpdt"})
    long = scaled.select("cell_id", F.expr("stack(4, 'protein__q', s_q, 'protein__p', s_p, 'protein__d', s_d, 'rna__t', s_t) AS (column, scaled)"))
    return long.join(F.broadcast(active), "column").groupBy("cell_id", "target", "measurement").agg(F.avg("scaled").alias("raw"))


@register("target_call", f"WITH {TARGETS} SELECT cell_id, target, measurement, round(signal, 6) AS signal, signal >= 0.5 AS positive FROM calls")
def target_call(spark, folder):
    return rounded(sc.target_call(target_long(spark, folder)), "signal").select("cell_id", "target", "measurement", "signal", "positive")


@register("scoring_diagnostics", f"WITH {TARGETS} SELECT target, measurement, count(*) AS cells, round({clip('any_value(threshold)', 0.1, 0.9)}, 6) AS threshold, count(*) FILTER (WHERE signal >= 0.5) AS positive_cells, round(avg(CAST(signal >= 0.5 AS INT)), 6) AS positive_fraction, '' AS warning FROM calls JOIN o USING (target) GROUP BY target, measurement")
def diagnostics(spark, folder):
    called = sc.target_call(target_long(spark, folder))
    return rounded(sc.scoring_diagnostics(called, "positive", "raw_threshold", ["target", "measurement"]), "threshold", "positive_fraction")


@register("marker_count_call", """SELECT definition, count(*) AS cells, count(*) FILTER (WHERE m >= required) AS proxy_cells FROM (SELECT CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0 AS INT) + CAST(l_tax > 0 AS INT) + CAST(l_extendedprice > 50000 AS INT) AS m FROM lineitem),
(VALUES ('inclusive', 2), ('balanced', 3), ('strict', 4)) AS v(definition, required) GROUP BY 1""")
def marker_count(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.greatest(F.col("l_quantity") - 25, F.lit(0)).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"),
        F.greatest(F.col("l_extendedprice") - 50000, F.lit(0)).alias("e"),
    )
    called = sc.marker_count_call(rows, ["a", "b", "c", "e"], {"inclusive": 2, "balanced": 3, "strict": 6})
    return called.groupBy("definition").agg(F.count("*").alias("cells"), F.count_if("proxy").alias("proxy_cells"))


@register("definition_masks", f"""WITH {VESSEL}, {otsu('c', 'sc', 'p')}, {otsu('e', 'scores', 'endothelial')},
m AS (SELECT s.cell_id, v.signal >= 0.5 AS a, s.endothelial >= {clip('e.threshold', 0.1, 0.9)} AS b, sc.p >= {clip('c.threshold', 0.1, 0.9)} AS c, sc.p >= 0.5 AS d,
CAST(sig.d > 0.3 AS INT) + CAST(sig.t > 0.2 AS INT) + CAST(sig.q > 100 AS INT) AS n FROM scores s JOIN vessel v USING (cell_id) JOIN sc USING (cell_id) JOIN sig USING (cell_id), e, c)
SELECT definition, count(*) FILTER (WHERE x) AS source_cells, round(avg(CAST(x AS INT)), 6) AS source_fraction FROM (
SELECT 'inclusive_endothelial_or_pericyte' AS definition, a AS x FROM m UNION ALL SELECT 'endothelial_score_otsu', b FROM m UNION ALL SELECT 'cd31_otsu', c FROM m
UNION ALL SELECT 'cd31_high_robust_0_5', d FROM m UNION ALL SELECT 'cd31_plus_any_endothelial_rna', c AND n >= 1 FROM m UNION ALL SELECT 'cd31_plus_two_endothelial_rna', c AND n >= 2 FROM m) GROUP BY 1""")
def masks(spark, folder):
    held = cut_lineage(signals(spark, folder))
    cells = sc.vessel_call(scores(spark, folder, held), "endothelial", "pericyte").join(held, "cell_id")
    cells = cells.selectExpr("*", "greatest(d - 0.3, 0) AS rd", "greatest(t - 0.2, 0) AS rt", "greatest(q - 100, 0) AS rq")
    rows = sc.definition_masks(cells, "p", "endothelial", "vessel_positive", ["rd", "rt", "rq"])
    return rows.groupBy("definition").agg(F.count_if("source").alias("source_cells"), r6(F.avg(F.col("source").cast("double"))).alias("source_fraction"))


REF = f"k AS (SELECT event_type, {logq('value', 0.05)} AS lo, {logq('value', 0.99)} AS hi FROM events GROUP BY 1), s AS (SELECT event_id, event_type, value, {scale('value', 'lo', 'hi')} AS scaled FROM events JOIN k USING (event_type)), {otsu('o', 's', 'scaled', 'event_type')}"


@register("reference_positive", f"WITH {REF} SELECT event_id, scaled >= threshold AS reference_positive FROM s JOIN o USING (event_type)")
def reference(spark, folder):
    return sc.reference_positive(table(spark, folder, "events"), "value", ["event_type"]).select("event_id", "reference_positive")


@register("calibrate_threshold", """WITH p AS (SELECT event_type, value, user_id % 3 = 0 AS pos FROM events), t AS (SELECT event_type, quantile_cont(value, 0.995) FILTER (WHERE NOT pos) AS t FROM p GROUP BY 1)
SELECT event_type, round(any_value(t), 6) AS image_threshold, round(avg(CAST(pos AS INT)), 6) AS reference_positive_fraction, round(avg(CAST(value > t AS INT)), 6) AS image_positive_fraction,
round(avg(CAST(value > t AS INT)) FILTER (WHERE NOT pos), 6) AS false_positive_rate, round(avg(CAST(value > t AS INT)) FILTER (WHERE pos), 6) AS true_positive_rate, 'COMPUTED' AS status FROM p JOIN t USING (event_type) GROUP BY 1""")
def calibrate(spark, folder):
    rows = table(spark, folder, "events").withColumn("pos", F.col("user_id") % 3 == 0)
    found = sc.calibrate_threshold(rows, "value", "pos", 0.995, ["event_type"])
    return rounded(found, "image_threshold", "reference_positive_fraction", "image_positive_fraction", "false_positive_rate", "true_positive_rate")


@register("minmax_scale", """SELECT event_id, round((value - lo) / (hi - lo), 6) AS up, round(1 - (value - lo) / (hi - lo), 6) AS down FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)""")
def minmax(spark, folder):
    up = sc.minmax_scale(table(spark, folder, "events"), "value", "up", ["event_type"])
    return rounded(sc.minmax_scale(up, "value", "down", ["event_type"], False), "up", "down").select("event_id", "up", "down")
