"""Pixel tables from embeddings: row = vec_id, col = position, value scaled to 0-255."""

import numpy as np
from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from checks.sqlkit import avg_rank, otsu
from tessella.operators import components as co
from tessella.operators import pixels as px
from tessella.session import attach

V = "CAST(least(greatest(floor((e + 0.6) / 1.2 * 255), 0), 255) AS INT)"
PIX = f"""pix AS (SELECT "row", col, label, e, {V} AS v FROM (SELECT CAST(vec_id AS INT) AS "row", label, unnest(range(64))::INT AS col, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings))"""
#: The last position fills all channels of its pixel.
RGB = f"""{PIX}, pos AS (SELECT "row", col, label, v FROM pix UNION ALL SELECT "row", CAST(col + k AS INT), label, v FROM pix, (VALUES (1), (2)) AS f(k) WHERE col = 63),
rgb AS (SELECT label AS image, "row", CAST(col // 3 AS INT) AS col, max(CASE WHEN col % 3 = 0 THEN v END) AS r, max(CASE WHEN col % 3 = 1 THEN v END) AS g, max(CASE WHEN col % 3 = 2 THEN v END) AS b FROM pos GROUP BY ALL)"""
PTS = """pts AS (SELECT event_id AS cell_id, CAST(user_id % 64 AS INT) AS col, CAST(event_id % (SELECT count(*) FROM embeddings) AS INT) AS "row", value, event_type FROM events)"""


def pixels(spark, folder):
    wide = table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("row"), "label", F.posexplode("embedding").alias("col", "e"))
    return wide.select("row", "col", "label", F.col("e").cast("double").alias("e")).withColumn("v", F.expr(V))


def rgb(spark, folder):
    """Three positions a pixel; the last position fills all channels of its pixel."""
    part = "col % 3 = {}"
    rows = pixels(spark, folder)
    rows = rows.unionByName(rows.where("col = 63").withColumn("col", F.explode(F.array(F.lit(64), F.lit(65)))))
    return rows.groupBy(F.col("label").alias("image"), "row", F.floor(F.col("col") / 3).cast("int").alias("col")).agg(
        *[F.max(F.when(F.expr(part.format(i)), F.col("v"))).alias(n) for i, n in enumerate("rgb")]
    )


def cells(spark, folder):
    number = table(spark, folder, "embeddings").agg(F.count("*").alias("n"))
    return attach(table(spark, folder, "events"), number).selectExpr(
        "event_id AS cell_id", "CAST(user_id % 64 AS INT) AS col", "CAST(event_id % n AS INT) AS row", "value", "event_type"
    )


@register("image_mode", f"WITH {PIX}, c AS (SELECT label, v, count(*) AS n FROM pix WHERE v > 0 GROUP BY ALL) SELECT label, CAST(v AS DOUBLE) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rn FROM c) WHERE rn = 1")
def image_mode(spark, folder):
    return px.image_mode(pixels(spark, folder), "v", ["label"], F.col("v") > 0)


WIN = f"""{PIX}, {PTS}, dim AS (SELECT max("row") AS h, max(col) AS w FROM pix), o AS (SELECT cell_id, least(greatest(pts."row" + dr, 0), h) AS r, least(greatest(pts.col + dc, 0), w) AS c FROM pts, dim, (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc)),
win AS (SELECT cell_id, avg(v) AS local_mean FROM o JOIN pix ON pix."row" = r AND pix.col = c GROUP BY 1)"""


@register("window_mean_at_points", f"WITH {WIN} SELECT cell_id, round(local_mean, 6) AS local_mean FROM win")
def window_mean(spark, folder):
    found = px.window_mean_at_points(cells(spark, folder), pixels(spark, folder), "v", 1)
    return rounded(found, "local_mean").select("cell_id", "local_mean")


@register("pixel_at_points", f"""WITH {PIX}, p AS (SELECT event_id, CAST(round_even(CAST(user_id % 60 AS DOUBLE) * 1.7 / 1.7, 0) AS INT) AS col, CAST(round_even(value * 0.5, 0) AS INT) AS "row" FROM events) SELECT event_id, v FROM p LEFT JOIN pix USING ("row", col)""")
def pixel_at_points(spark, folder):
    placed = table(spark, folder, "events").select("event_id", (F.col("user_id") % 60 * 1.7).alias("x"), F.col("value").alias("y"))
    return px.pixel_at_points(px.pixel_positions(placed, 1.7, 2.0), pixels(spark, folder), ["v"]).select("event_id", "v")


MODE = "mode AS (SELECT label, v AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rn FROM (SELECT label, v, count(*) AS n FROM pix WHERE v > 0 GROUP BY ALL)) WHERE rn = 1)"


@register("excess_signal", f"""WITH {PIX}, {MODE} SELECT label, count(*) AS pixels, CAST(sum(greatest(v - m, 0)) AS DOUBLE) AS excess FROM pix JOIN mode USING (label) GROUP BY 1""")
def excess(spark, folder):
    p = pixels(spark, folder)
    lifted = attach(p, px.image_mode(p, "v", ["label"], F.col("v") > 0), ["label"])
    return lifted.groupBy("label").agg(F.count("*").alias("pixels"), F.sum(px.excess_signal(F.col("v"), F.col("mode"))).alias("excess"))


SIGMA = 2.5
RADIUS = int(4 * SIGMA + 0.5)


@register("kernel_signal_at_points", f"""WITH {PIX}, {PTS}, m AS (SELECT v AS m FROM (SELECT v, count(*) AS n FROM pix WHERE v > 0 GROUP BY 1 ORDER BY n DESC, v LIMIT 1)),
x AS (SELECT "row", col, CAST(greatest(v - m, 0) AS DOUBLE) AS s FROM pix, m), dim AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM pix),
k AS (SELECT d, exp(-0.5 * pow(d / {SIGMA}, 2)) / (SELECT sum(exp(-0.5 * pow(d / {SIGMA}, 2))) FROM generate_series(-{RADIUS}, {RADIUS}) AS t(d)) AS wt FROM generate_series(-{RADIUS}, {RADIUS}) AS t(d)),
hz AS (SELECT t."row", t.c0, sum(wt * s) AS s FROM (SELECT a."row", a.col AS c0, CASE WHEN a.col + d < 0 THEN -1 - (a.col + d) WHEN a.col + d >= w THEN 2 * w - 1 - (a.col + d) ELSE a.col + d END AS c, wt FROM x a, k, dim) t JOIN x ON x."row" = t."row" AND x.col = t.c GROUP BY ALL),
vt AS (SELECT t.r0 AS "row", t.c0 AS col, sum(wt * s) AS s FROM (SELECT a."row" AS r0, a.c0, CASE WHEN a."row" + d < 0 THEN -1 - (a."row" + d) WHEN a."row" + d >= h THEN 2 * h - 1 - (a."row" + d) ELSE a."row" + d END AS r, wt FROM hz a, k, dim) t JOIN hz ON hz."row" = t.r AND hz.c0 = t.c0 GROUP BY ALL)
SELECT cell_id, round(s, 5) AS kernel_signal FROM pts JOIN vt USING ("row", col)""")
def kernel(spark, folder):
    p = pixels(spark, folder)
    mode = px.image_mode(p, "v", valid=F.col("v") > 0)
    found = px.kernel_signal_at_points(cells(spark, folder), p, "v", 15.0, 15.0 / SIGMA, mode)
    return found.select("cell_id", F.round("kernel_signal", 5).alias("kernel_signal"))


@register("pixel_components", f"""WITH RECURSIVE {PIX}, msk AS (SELECT "row", col FROM pix WHERE v > 160), reach(r1, c1, r2, c2) AS (SELECT "row", col, "row", col FROM msk UNION
SELECT reach.r1, reach.c1, m."row", m.col FROM reach, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dr, dc) JOIN msk m ON true WHERE m."row" = reach.r2 + s.dr AND m.col = reach.c2 + s.dc),
comp AS (SELECT r1 AS "row", c1 AS col, min(CAST(r2 AS BIGINT) * 64 + c2) AS component FROM reach GROUP BY ALL),
sz AS (SELECT component, count(*) AS pixels FROM comp GROUP BY 1) SELECT pixels, count(*) AS components FROM sz GROUP BY 1""")
def pixel_components(spark, folder):
    found = co.pixel_components(pixels(spark, folder).where("v > 160"))
    return co.component_sizes(found).groupBy("pixels").agg(F.count("*").alias("components"))


DISC = [(-2, 0), (-1, -1), (-1, 0), (-1, 1), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (2, 0)]
DV = ", ".join(f"({r}, {c})" for r, c in DISC)


@register("mask_close", f"""WITH {PIX}, msk AS (SELECT "row", col FROM pix WHERE v > 190), dim AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM pix), el AS (SELECT * FROM (VALUES {DV}) AS t(dr, dc)),
dil AS (SELECT DISTINCT "row" + dr AS "row", col + dc AS col FROM msk, el, dim WHERE "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1)
SELECT CAST(p."row" AS INT) AS "row", CAST(p.col AS INT) AS col FROM pix p, el JOIN dil d ON true WHERE d."row" = p."row" + dr AND d.col = p.col + dc GROUP BY ALL HAVING count(*) = {len(DISC)}""")
def mask_close(spark, folder):
    p = pixels(spark, folder)
    mask = attach(p.where("v > 190").select("row", "col"), px._image_size(p, []))
    return px.mask_close(mask, 2).select("row", "col")


# Structures: very bright pixels; distances in units of 6 per pixel, per image (label).
DIST = f"""{PIX}, msk AS (SELECT label, "row" AS mr, col AS mc FROM pix WHERE v > 195), dst AS (SELECT label, "row", col, v, e, 6 * sqrt(min((CAST("row" AS DOUBLE) - mr) * ("row" - mr) + (CAST(col AS DOUBLE) - mc) * (col - mc))) AS d FROM pix LEFT JOIN msk USING (label) GROUP BY ALL)"""
BAND = "CASE WHEN d < 10 THEN 0 WHEN d < 25 THEN 1 WHEN d < 50 THEN 2 WHEN d < 100 THEN 3 WHEN d >= 100 THEN 4 END"
NAMES = "(VALUES (0, '0-10'), (1, '10-25'), (2, '25-50'), (3, '50-100'), (4, '>=100')) AS b(band, distance_band_um)"


def distances(spark, folder):
    p = pixels(spark, folder)
    return px.mask_distance(p, p.where("v > 195"), 6.0, ["label"], "d")


@register("distance_band_summary", f"""WITH {DIST}, f AS (SELECT label, {BAND} AS band, count(*) AS pixels, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.9) AS q FROM dst WHERE v > 20 GROUP BY ALL)
SELECT l.label, b.band, distance_band_um, coalesce(pixels, 0) AS pixels, round(m, 6) AS v_median, round(q, 6) AS v_q90 FROM (SELECT DISTINCT label FROM pix) l CROSS JOIN {NAMES} LEFT JOIN f ON f.label = l.label AND f.band = b.band""")
def band_summary(spark, folder):
    return rounded(px.distance_band_summary(distances(spark, folder), "d", ["v"], ["label"], F.col("v") > 20), "v_median", "v_q90")


# Perfusion: green structures, blue signal minus alpha times red.
PERF = f"""{RGB}, gm AS (SELECT image, "row" AS mr, col AS mc FROM rgb WHERE g > 190), gd AS (SELECT image, "row", col, r, g, b, 6 * sqrt(min((CAST("row" AS DOUBLE) - mr) * ("row" - mr) + (CAST(col AS DOUBLE) - mc) * (col - mc))) AS d FROM rgb LEFT JOIN gm USING (image) GROUP BY ALL),
al AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.1), (0.3)) AS t(alpha)), cb AS (SELECT *, greatest(b - alpha * r, 0) AS c FROM gd, al), qs AS (SELECT image, alpha, quantile_cont(c, 0.99) AS q FROM cb GROUP BY ALL),
pf AS (SELECT cb.*, least(greatest(c / q, 0), 1) AS perfusion FROM cb JOIN qs USING (image, alpha)),
mn AS (SELECT image, alpha, avg(perfusion) FILTER (WHERE d < 10) AS near_mean, avg(perfusion) FILTER (WHERE d >= 50 AND d < 100) AS far_mean FROM pf GROUP BY ALL),
rk AS (SELECT image, alpha, {avg_rank('d', 'image, alpha')} AS rd, {avg_rank('perfusion', 'image, alpha')} AS rp FROM pf WHERE d IS NOT NULL AND ("row" * 22 + col) % 3 = 0),
rho AS (SELECT image, alpha, count(*) AS pairs, CASE WHEN stddev_pop(rd) > 0 AND stddev_pop(rp) > 0 THEN corr(rd, rp) END AS rho FROM rk GROUP BY ALL)"""
ALPHAS = (0.0, 0.1, 0.3)


def perfusion(spark, folder, alphas=ALPHAS):
    p = rgb(spark, folder)
    measured = px.mask_distance(p, p.where("g > 190"), 6.0, ["image"], "d")
    return px.perfusion_signal(measured, alphas, ["image"])


@register("perfusion_profile", f"""WITH {PERF}, f AS (SELECT image, {BAND} AS band, count(*) AS pixels, avg(perfusion) AS a, quantile_cont(perfusion, 0.5) AS m, quantile_cont(perfusion, 0.9) AS q FROM pf WHERE alpha = 0.1 AND greatest(r, g, b) > 0 GROUP BY ALL)
SELECT l.image, b.band, distance_band_um, coalesce(pixels, 0) AS pixels, round(a, 6) AS perfusion_mean, round(m, 6) AS perfusion_median, round(q, 6) AS perfusion_q90 FROM (SELECT DISTINCT image FROM rgb) l CROSS JOIN {NAMES} LEFT JOIN f ON f.image = l.image AND f.band = b.band""")
def perfusion_profile(spark, folder):
    one = perfusion(spark, folder, (0.1,))
    found = px.distance_band_summary(one, "d", ["perfusion"], ["image"], F.col("tissue"), means=True)
    return rounded(found, "perfusion_mean", "perfusion_median", "perfusion_q90")


@register("near_far_ratio", f"""WITH {PERF} SELECT image, alpha, round(near_mean, 6) AS near_mean, round(far_mean, 6) AS far_mean, round(near_mean / nullif(far_mean, 0), 6) AS near_to_far, CAST(pairs AS BIGINT) AS pairs, round(rho, 6) AS distance_spearman FROM mn LEFT JOIN rho USING (image, alpha)""")
def near_far(spark, folder):
    found = px.near_far_ratio(perfusion(spark, folder), "d", "perfusion", 22, ["image", "alpha"], 3)
    return rounded(found, "near_mean", "far_mean", "near_to_far", "distance_spearman")


@register("perfusion_robustness", f"""WITH {PERF}, j AS (SELECT image, rho, near_mean / nullif(far_mean, 0) AS ratio FROM mn LEFT JOIN rho USING (image, alpha))
SELECT image, count(*) AS settings, bool_and(coalesce(rho < 0, false)) AS all_negative, bool_and(coalesce(ratio > 1, false)) AS all_near_enriched, round(min(rho), 6) AS min_rho, round(max(rho), 6) AS max_rho, round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio FROM j GROUP BY 1""")
def robustness(spark, folder):
    settings = px.near_far_ratio(perfusion(spark, folder), "d", "perfusion", 22, ["image", "alpha"], 3)
    return rounded(px.perfusion_robustness(settings, ["image"]), "min_rho", "max_rho", "min_ratio", "max_ratio")


@register("perfusion_medians", f"""WITH {PERF}, j AS (SELECT image, alpha, rho, near_mean / nullif(far_mean, 0) AS ratio FROM mn LEFT JOIN rho USING (image, alpha))
SELECT alpha, count(*) AS images, bool_and(coalesce(rho < 0, false)) AS all_negative, bool_and(coalesce(ratio > 1, false)) AS all_near_enriched, round(quantile_cont(rho, 0.5), 6) AS median_distance_spearman, round(quantile_cont(ratio, 0.5), 6) AS median_near_to_far FROM j GROUP BY 1""")
def perfusion_medians(spark, folder):
    images = px.near_far_ratio(perfusion(spark, folder), "d", "perfusion", 22, ["image", "alpha"], 3)
    return rounded(px.perfusion_medians(images), "median_distance_spearman", "median_near_to_far")


@register("segment_bright", f"""WITH RECURSIVE {PIX}, sc AS (SELECT quantile_cont(v, 0.995) AS scale FROM pix WHERE v > 0), sp AS (SELECT "row", col, least(greatest(v / scale, 0), 1) AS s FROM pix, sc), po AS (SELECT s FROM sp WHERE s > 0), {otsu('o', 'po', 's')},
msk AS (SELECT "row", col FROM sp, o WHERE s >= greatest(threshold, 0.05) AND s > 0.85), lv AS (SELECT greatest(threshold, 0.05) AS t FROM o)
SELECT round(t, 6) AS otsu_threshold, round(scale, 6) AS scale, (SELECT count(*) FROM sp WHERE s >= t) AS bright_pixels FROM lv, sc""")
def segment_bright(spark, folder):
    mask, level = px.segment_bright(pixels(spark, folder), "v", minimum_pixels=1)
    count = mask.agg(F.count("*").alias("bright_pixels"))
    return rounded(attach(level, count), "otsu_threshold", "scale")


# Published optical densities of haematoxylin, eosin and DAB.
INV = np.linalg.inv(np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]]))


def stain(index: int) -> str:
    low = repr(float(np.log(1e-6)))
    terms = " + ".join(f"ln(greatest({c} / 255.0::DOUBLE, 1e-6)) / {low}::DOUBLE * {float(INV[i, index])!r}::DOUBLE" for i, c in enumerate("rgb"))
    return f"greatest({terms}, 0)"


BROWN = "greatest((r - b) / 255.0::DOUBLE + 0.5 * ((g - b) / 255.0::DOUBLE), 0)"


@register("stain_features", f"""WITH {RGB}, s AS (SELECT image, r > 60 AS m, {stain(2)} AS d, {BROWN} AS br FROM rgb) SELECT image, round(avg(CAST(m AS INT)), 6) AS mask_fraction, round(quantile_cont(d, 0.5) FILTER (WHERE m), 6) AS dab_median, round(quantile_cont(d, 0.9) FILTER (WHERE m), 6) AS dab_q90,
round(quantile_cont(d, 0.95) FILTER (WHERE m), 6) AS dab_q95, round(quantile_cont(br, 0.5) FILTER (WHERE m), 6) AS brown_median, round(quantile_cont(br, 0.9) FILTER (WHERE m), 6) AS brown_q90 FROM s GROUP BY 1""")
def stain_features(spark, folder):
    found = px.stain_features(rgb(spark, folder), F.col("r") > 60, ["image"])
    return rounded(found, *[c for c in found.columns if c != "image"])


@register("region_morphology", f"""WITH {RGB}, s AS (SELECT CASE WHEN "row" % 5 < 3 THEN 'zone ' || ("row" % 5) ELSE 'UNANNOTATED' END AS region, r + g > 200 AS t, {stain(0)} AS h, {stain(1)} AS e, b > 150 AS c FROM rgb)
SELECT region, count(*) AS region_pixels, count(*) FILTER (WHERE t) AS tissue_pixels, count(*) FILTER (WHERE c) AS candidate_pixels, round(avg(h) FILTER (WHERE t), 6) AS h_mean, round(avg(e) FILTER (WHERE t), 6) AS e_mean,
round(quantile_cont(h, 0.5) FILTER (WHERE t), 6) AS h_median, round(quantile_cont(h, 0.1) FILTER (WHERE t), 6) AS h_q10, round(quantile_cont(h, 0.9) FILTER (WHERE t), 6) AS h_q90,
round(quantile_cont(e, 0.5) FILTER (WHERE t), 6) AS e_median, round(quantile_cont(e, 0.1) FILTER (WHERE t), 6) AS e_q10, round(quantile_cont(e, 0.9) FILTER (WHERE t), 6) AS e_q90,
round(count(*) FILTER (WHERE t) / CAST(count(*) AS DOUBLE), 6) AS tissue_fraction, round(count(*) FILTER (WHERE t) * 11.56 / 1e6, 6) AS tissue_area_mm2, round(count(*) FILTER (WHERE c) / CAST(count(*) FILTER (WHERE t) AS DOUBLE), 6) AS candidate_fraction FROM s GROUP BY 1""")
def region_morphology(spark, folder):
    p = rgb(spark, folder).withColumns({
        "region": F.expr("CASE WHEN row % 5 < 3 THEN concat('zone ', row % 5) END"), "t": F.expr("r + g > 200"),
        "h": px.stain_density(0), "e": px.stain_density(1), "c": F.expr("b > 150"),
    })
    found = px.region_morphology(p, "region", "t", ["h", "e"], "c", 11.56)
    return rounded(found, *[c for c in found.columns if c != "region" and "pixels" not in c])


BACK = f"""{PIX}, m AS (SELECT label, v AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rn FROM (SELECT label, v, count(*) AS n FROM pix WHERE v > 0 GROUP BY ALL)) WHERE rn = 1),
bg AS (SELECT label, "row", col, CAST(lead(v) OVER (PARTITION BY "row" ORDER BY col) AS DOUBLE) AS background FROM pix WHERE label % 4 <> 0),
st AS (SELECT label, CAST(greatest(v - m, 0) AS DOUBLE) AS residual, background FROM pix JOIN m USING (label) JOIN bg USING (label, "row", col) WHERE ("row" * 64 + col) % 5 = 0 AND background IS NOT NULL),
al AS (SELECT label, {avg_rank('residual', 'label')} AS x, {avg_rank('background', 'label')} AS y FROM st), lo AS (SELECT st.* FROM st JOIN (SELECT label, quantile_cont(residual, 0.9) AS q FROM st GROUP BY 1) USING (label) WHERE residual <= q),
lr AS (SELECT label, {avg_rank('residual', 'label')} AS x, {avg_rank('background', 'label')} AS y FROM lo), a AS (SELECT label, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM al GROUP BY 1), l AS (SELECT label, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM lr GROUP BY 1)"""


@register("background_correlation", f"""WITH {BACK} SELECT p.label, CASE WHEN p.label % 4 <> 0 THEN 'COMPUTED_RELATIVE_QC' ELSE 'NOT_COMPUTED' END AS status, CASE WHEN p.label % 4 = 0 THEN 'MATCHED_BACKGROUND_QC_IMAGE_NOT_PROVIDED' END AS reason,
round(a.c, 6) AS spearman_all, round(l.c, 6) AS spearman_low_signal FROM (SELECT DISTINCT label FROM pix) p LEFT JOIN a USING (label) LEFT JOIN l USING (label)""")
def background(spark, folder):
    p = pixels(spark, folder)
    shifted = p.where("label % 4 <> 0").select("label", "row", (F.col("col") - 1).alias("col"), F.col("v").cast("double").alias("background"))
    found = px.background_correlation(p, shifted, "v", 64, ["label"], 5)
    return rounded(found, "spearman_all", "spearman_low_signal")


@register("tissue_mask_colour")
def tissue_mask(spark, folder):
    return px.tissue_mask_colour(rgb(spark, folder), ["image"])


@register("intensity_features", f"""WITH {PIX}, q AS (SELECT label, quantile_cont(v, 0.99) AS q FROM pix GROUP BY 1), s AS (SELECT label, least(greatest(v / greatest(q, 1), 0), 1) AS s FROM pix JOIN q USING (label)), {otsu('o', 's', 's', 'label')}
SELECT label, round(avg(s), 6) AS intensity_mean, round(any_value(threshold), 6) AS otsu_threshold, round(avg(CAST(s > threshold AS INT)), 6) AS positive_fraction, round(quantile_cont(s, 0.9), 6) AS intensity_q90 FROM s JOIN o USING (label) GROUP BY 1""")
def intensity(spark, folder):
    found = px.intensity_features(pixels(spark, folder), "v", ["label"])
    return rounded(found, "intensity_mean", "otsu_threshold", "positive_fraction", "intensity_q90")


@register("panel_distance_features", f"""WITH {RGB}, l AS (SELECT image, quantile_cont(r, 0.6) FILTER (WHERE r > 0) AS rq, quantile_cont(g, 0.99) FILTER (WHERE g > 0) AS gq, max("row") + 1 AS h, max(col) + 1 AS w FROM rgb GROUP BY 1),
k AS (SELECT image, "row", col, r >= greatest(5, rq) AND r > 1.1 * g AND r > 1.1 * b AS vessel, least(g / gq, 1) > 0.2 AS positive, sqrt(CAST(h AS DOUBLE) * h + w * w) AS diag FROM rgb JOIN l USING (image)),
d AS (SELECT k.image, k."row", k.col, k.vessel, k.positive, diag, sqrt(min((CAST(k."row" AS DOUBLE) - m."row") * (k."row" - m."row") + (k.col - m.col) * (k.col - m.col))) AS d FROM k JOIN (SELECT image, "row", col FROM k WHERE vessel) m USING (image) GROUP BY ALL)
SELECT image, round(avg(CAST(vessel AS INT)), 6) AS vascular_fraction, round(avg(CAST(positive AS INT)), 6) AS positive_fraction, round(avg(d / diag) FILTER (WHERE positive), 6) AS distance_mean, round(quantile_cont(d / diag, 0.5) FILTER (WHERE positive), 6) AS distance_median, round(quantile_cont(d / diag, 0.9) FILTER (WHERE positive), 6) AS distance_q90 FROM d GROUP BY 1""")
def panel(spark, folder):
    found = px.panel_distance_features(rgb(spark, folder), ["image"])
    return rounded(found, *[c for c in found.columns if c != "image"])

