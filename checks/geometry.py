"""Polygons from lineitem (one per order) and supplier (annotations), points from events."""

from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from checks.spatial import P, points
from checks.sqlkit import uniform
from tessella.operators import geometry as ge
from tessella.sources import tables as st

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
VERT = "vert AS (SELECT l_orderkey AS cell_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS vertex_ix, l_quantity AS x, sqrt(l_extendedprice) AS y FROM lineitem)"
#: Edges relative to the first vertex of their ring, so that small polygons far from the origin keep their digits.
EDGE = f"""{VERT}, rel AS (SELECT cell_id, vertex_ix, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM vert WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ix)),
edge AS (SELECT cell_id, fx, fy, x AS x1, y AS y1, coalesce(lead(x) OVER w, 0) AS x2, coalesce(lead(y) OVER w, 0) AS y2 FROM rel WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ix))"""
POLY = f"""{EDGE}, agg AS (SELECT cell_id, count(*) AS vertices, sum(x1 * y2 - x2 * y1) AS a, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS p, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS cy, avg(x1) AS mx, avg(y1) AS my, min(fx) AS fx, min(fy) AS fy FROM edge GROUP BY 1),
poly AS (SELECT cell_id, vertices, CASE WHEN vertices >= 3 THEN abs(a) / 2 END AS area, CASE WHEN vertices >= 3 THEN p END AS perimeter, CASE WHEN vertices >= 3 AND p > 0 THEN 4 * pi() * (abs(a) / 2) / (p * p) END AS compactness,
fx + CASE WHEN abs(a) / 2 <= 1e-12 THEN mx ELSE cx / (3 * a) END AS centroid_x, fy + CASE WHEN abs(a) / 2 <= 1e-12 THEN my ELSE cy / (3 * a) END AS centroid_y FROM agg)"""


def polygons(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("y", F.sqrt("l_extendedprice"))
    return st.boundaries(rows, "l_orderkey", "l_quantity", "y", ORDER)


def metrics(spark, folder):
    return ge.polygon_metrics(polygons(spark, folder), ["cell_id"], "vertex_x", "vertex_y")


@register("read_boundaries", f"WITH {VERT} SELECT cell_id, CAST(vertex_ix AS INT) AS vertex_ix, x AS vertex_x, round(y, 6) AS vertex_y FROM vert")
def read_boundaries(spark, folder):
    return rounded(polygons(spark, folder), "vertex_y")


@register("polygon_metrics", f"WITH {POLY} SELECT cell_id, vertices, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(compactness, 6) AS compactness FROM poly")
def polygon_metrics(spark, folder):
    return rounded(metrics(spark, folder), "area", "perimeter", "compactness").drop("centroid_x", "centroid_y")


@register("polygon_centroid", f"WITH {POLY} SELECT cell_id, round(centroid_x, 4) AS centroid_x, round(centroid_y, 4) AS centroid_y FROM poly")
def polygon_centroid(spark, folder):
    return metrics(spark, folder).select("cell_id", F.round("centroid_x", 4).alias("centroid_x"), F.round("centroid_y", 4).alias("centroid_y"))


def annotation_documents(spark, folder):
    """One GeoJSON collection per supplier: a diamond, some with a hole, a second part, or a point only."""
    ring = "format_string('[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]', {x}-{r},{y}, {x},{y}+{r}, {x}+{r},{y}, {x},{y}-{r}, {x}-{r},{y})"
    one, hole, two = ring.format(x="cx", y="cy", r="r"), ring.format(x="cx", y="cy", r="(r-4)"), ring.format(x="(cx+20)", y="cy", r="r")
    base = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS doc", "CAST(s_suppkey * 37 % 150 AS INT) AS cx", "CAST(floor(abs(s_acctbal) / 40) AS INT) AS cy", "CAST(8 + s_suppkey % 10 AS INT) AS r", "s_nationkey",
    )
    geometry = f"""CASE WHEN doc % 7 = 6 THEN format_string('{{"type":"Point","coordinates":[%d,%d]}}', cx, cy)
        WHEN doc % 5 = 0 THEN concat('{{"type":"MultiPolygon","coordinates":[[', {one}, '],[', {two}, ']]}}')
        WHEN doc % 3 = 0 THEN concat('{{"type":"Polygon","coordinates":[', {one}, ',', {hole}, ']}}')
        ELSE concat('{{"type":"Polygon","coordinates":[', {one}, ']}}') END"""
    properties = """CASE WHEN doc % 4 = 0 THEN format_string('{"name":"Tumor %d"}', s_nationkey) WHEN doc % 4 = 1 THEN format_string('{"classification":{"name":"Stroma %d"}}', s_nationkey) ELSE '{}' END"""
    return base.selectExpr("doc", f"""concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":', {geometry}, ',"properties":', {properties}, '}}]}}') AS value""")


ANN = """sup AS (SELECT s_suppkey AS doc, CAST(s_suppkey * 37 % 150 AS INT) AS cx, CAST(floor(abs(s_acctbal) / 40) AS INT) AS cy, CAST(8 + s_suppkey % 10 AS INT) AS r, CASE s_suppkey % 4 WHEN 0 THEN 'Tumor ' || s_nationkey WHEN 1 THEN 'Stroma ' || s_nationkey ELSE 'UNLABELLED' END AS name FROM supplier WHERE s_suppkey % 7 <> 6),
rings AS (SELECT doc, name, 0 AS polygon_ix, 0 AS ring_ix, cx, cy, r FROM sup UNION ALL SELECT doc, name, 1, 0, cx + 20, cy, r FROM sup WHERE doc % 5 = 0 UNION ALL SELECT doc, name, 0, 1, cx, cy, r - 4 FROM sup WHERE doc % 5 <> 0 AND doc % 3 = 0),
ann AS (SELECT doc, name, polygon_ix, ring_ix, v - 1 AS vertex_ix, CAST(CASE v WHEN 1 THEN cx - r WHEN 2 THEN cx WHEN 3 THEN cx + r WHEN 4 THEN cx ELSE cx - r END AS DOUBLE) AS x, CAST(CASE v WHEN 2 THEN cy + r WHEN 4 THEN cy - r ELSE cy END AS DOUBLE) AS y FROM rings, generate_series(1, 5) AS g(v)),
ae AS (SELECT doc, name, polygon_ix, ring_ix, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ann WINDOW w AS (PARTITION BY doc, polygon_ix, ring_ix ORDER BY vertex_ix))"""
MET = """((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) AS c, ((x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) AS e"""


def annotations(spark, folder):
    return st.geojson_features(annotation_documents(spark, folder)).drop("feature_ix")


@register("read_geojson", f"WITH {ANN} SELECT doc, name, CAST(polygon_ix AS INT) AS polygon_ix, CAST(ring_ix AS INT) AS ring_ix, CAST(vertex_ix AS INT) AS vertex_ix, x, y FROM ann")
def read_geojson(spark, folder):
    return annotations(spark, folder)


@register("read_geojson_lines", f"WITH {ANN} SELECT name, CAST(polygon_ix AS INT) AS polygon_ix, CAST(ring_ix AS INT) AS ring_ix, CAST(vertex_ix AS INT) AS vertex_ix, count(*) AS features, sum(x) AS x, sum(y) AS y FROM ann GROUP BY ALL")
def read_geojson_lines(spark, folder):
    """One collection with a feature on each line, written and read back."""
    target = st.scratch_folder(spark) + "/lines"
    feature = F.concat(F.expr("""substring(value, 41, length(value) - 42)"""), F.lit(","))
    lines = annotation_documents(spark, folder).select(feature.alias("value"))
    ends = spark.range(2).select(F.when(F.col("id") == 0, '{"type":"FeatureCollection","features":[').otherwise("]}").alias("value"))
    lines.unionByName(ends).write.text(target)
    found = st.read_geojson(spark, target, lines=True)
    return found.groupBy("name", "polygon_ix", "ring_ix", "vertex_ix").agg(F.count_distinct("feature_ix").alias("features"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@register("point_in_polygon", P + f""", {ANN}, m AS (SELECT cell_id, doc, name, polygon_ix, {MET.replace('px', 'p.x').replace('py', 'p.y')} FROM p, ae),
h AS (SELECT cell_id, name FROM m WHERE c OR e GROUP BY cell_id, doc, name, polygon_ix HAVING bool_or(e) OR count(*) FILTER (WHERE c) % 2 = 1)
SELECT cell_id, coalesce(string_agg(DISTINCT name, '|' ORDER BY name), 'UNANNOTATED') AS pathology_region FROM p LEFT JOIN h USING (cell_id) GROUP BY 1""")
def point_in_polygon(spark, folder):
    return ge.point_in_polygon(points(spark, folder), annotations(spark, folder), "cell_id", ["doc"]).select("cell_id", "pathology_region")


MATRIX = [[0.9, 0.1, 5.0], [-0.1, 1.1, -3.0], [0.0, 0.0, 1.0]]


@register("affine_transform", "SELECT event_id, round((0.9 * user_id + 0.1 * value + 5) * 0.5, 6) AS x, round((-0.1 * user_id + 1.1 * value - 3) * 0.25, 6) AS y FROM events")
def affine(spark, folder):
    cells = table(spark, folder, "events").select("event_id", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return rounded(ge.affine_transform(cells, MATRIX, (0.5, 0.25)), "x", "y")


CAND = P + f""", {ANN}, mats AS (SELECT * FROM (VALUES ('identity', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('affine', 0.9, 0.1, 5, -0.1, 1.1, -3), ('inverse_affine', 1.1::DOUBLE / 1.0, -0.1::DOUBLE / 1.0, -(1.1 * 5 + -0.1 * -3), 0.1::DOUBLE / 1.0, 0.9::DOUBLE / 1.0, -(0.1 * 5 + 0.9 * -3))) AS t(n, m0, m1, m2, m3, m4, m5)),
scl AS (SELECT * FROM (VALUES (1.0::DOUBLE, '1'), (0.2125, '0.2125'), (0.425, '0.425'), (0.5, '0.5')) AS t(s, label)),
box AS (SELECT min(x) AS cx0, max(x) AS cx1, min(y) AS cy0, max(y) AS cy1 FROM p),
mv AS (SELECT n || '_scale_' || label AS candidate, ((m0 / d) * x + (m1 / d) * y + m2 / d) * s AS tx, ((m3 / d) * x + (m4 / d) * y + m5 / d) * s AS ty FROM ann, mats, scl, LATERAL (SELECT CASE WHEN n = 'inverse_affine' THEN 0.9 * 1.1 + 0.1 * 0.1 ELSE 1.0 END AS d)),
st AS (SELECT candidate, avg(CAST(tx BETWEEN cx0 - greatest((cx1 - cx0) * 0.1, 100) AND cx1 + greatest((cx1 - cx0) * 0.1, 100) AND ty BETWEEN cy0 - greatest((cy1 - cy0) * 0.1, 100) AND cy1 + greatest((cy1 - cy0) * 0.1, 100) AS INT)) AS fraction_inside, min(tx) AS a0, max(tx) AS a1, min(ty) AS b0, max(ty) AS b1, any_value(cx0) AS cx0, any_value(cx1) AS cx1, any_value(cy0) AS cy0, any_value(cy1) AS cy1 FROM mv, box GROUP BY 1),
cand AS (SELECT candidate, fraction_inside, fraction_inside - 0.15 * (abs(ln(greatest((a1 - a0) / greatest(cx1 - cx0, 1), 1e-9))) + abs(ln(greatest((b1 - b0) / greatest(cy1 - cy0, 1), 1e-9)))) - 0.10 * sqrt(pow(((a0 + a1) - (cx0 + cx1)) / (2 * greatest(cx1 - cx0, 1)), 2) + pow(((b0 + b1) - (cy0 + cy1)) / (2 * greatest(cy1 - cy0, 1)), 2)) AS score FROM st)"""


@register("alignment_candidates", CAND + " SELECT candidate, round(fraction_inside, 6) AS fraction_inside, round(score, 6) AS score FROM cand")
def candidates(spark, folder):
    found = ge.alignment_candidates(annotations(spark, folder), points(spark, folder), MATRIX)
    return rounded(found, "fraction_inside", "score").drop("transform", "scale")


@register("alignment_accept", CAND + """ SELECT candidate, round(score, 6) AS score, round(fraction_inside, 6) AS fraction_inside, ok AS accepted, CASE WHEN ok THEN 'ALIGNED' ELSE 'NOT_COMPUTED' END AS status FROM (SELECT *, fraction_inside >= 0.7 AND score - (SELECT max(score) FROM cand WHERE score < (SELECT max(score) FROM cand)) >= 0.05 AS ok FROM cand ORDER BY score DESC LIMIT 1)""")
def accept(spark, folder):
    found = ge.alignment_candidates(annotations(spark, folder), points(spark, folder), MATRIX)
    return rounded(ge.alignment_accept(found), "score", "fraction_inside").drop("transform", "scale")


CELLS = """g0 AS (SELECT event_id AS cell_id, CAST(user_id AS DOUBLE) AS x, value AS y, event_type AS fov, ln(1 + value) / 8 AS target_signal, CAST(user_id % 10 AS DOUBLE) / 8 AS vessel_signal, CAST(user_id % 7 AS DOUBLE) / 8 AS ecm_score, CAST(user_id % 3 AS DOUBLE) / 2 AS caf_score, value > 200 AS is_tumour FROM events),
g1 AS (SELECT fov, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1) / 63 AS step FROM g0 GROUP BY 1),
g2 AS (SELECT g0.*, step, CAST(least(greatest(round_even((y - y0) / step, 0), 0), 63) AS INT) AS "row", CAST(least(greatest(round_even((x - x0) / step, 0), 0), 63) AS INT) AS col FROM g0 JOIN g1 USING (fov)),
grid AS (SELECT fov, "row", col, step, count(*) AS n, greatest(avg(target_signal), 0) AS target, avg(vessel_signal) AS vessel, least(greatest(avg(ecm_score), 0), 1) AS ecm, least(greatest(avg(caf_score), 0), 1) AS caf, bool_or(is_tumour) AS is_tumour, avg(vessel_signal) >= 0.5 AS vessel_mask FROM g2 GROUP BY ALL)"""


def raster_cells(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id AS cell_id", "CAST(user_id AS DOUBLE) AS x", "value AS y", "event_type AS fov", "ln(1 + value) / 8 AS target_signal", "CAST(user_id % 10 AS DOUBLE) / 8 AS vessel_signal",
        "CAST(user_id % 7 AS DOUBLE) / 8 AS ecm_score", "CAST(user_id % 3 AS DOUBLE) / 2 AS caf_score", "value > 200 AS is_tumour",
    )


@register("rasterise_cells", f"WITH {CELLS} SELECT fov, \"row\", col, n, round(target, 6) AS target, round(vessel, 6) AS vessel, round(ecm, 6) AS ecm, round(caf, 6) AS caf, is_tumour, vessel_mask FROM grid")
def rasterise(spark, folder):
    return rounded(ge.rasterise_cells(raster_cells(spark, folder), 64, ["fov"]), "target", "vessel", "ecm", "caf").drop("step")


@register("grid_distance", f"WITH {CELLS}, m AS (SELECT fov, \"row\" AS mr, col AS mc FROM grid WHERE vessel_mask) SELECT fov, \"row\", col, round(2.5 * min(sqrt((\"row\" - mr) * (\"row\" - mr) + (col - mc) * (col - mc))), 6) AS distance FROM grid LEFT JOIN m USING (fov) GROUP BY ALL")
def grid_distance(spark, folder):
    grid = ge.rasterise_cells(raster_cells(spark, folder), 64, ["fov"])
    return rounded(ge.grid_distance(grid, "vessel_mask", 2.5, ["fov"]), "distance").select("fov", "row", "col", "distance")


@register("lookup_grid", f"WITH {CELLS} SELECT cell_id, round(grid.target, 6) AS target, n FROM g2 JOIN grid USING (fov, \"row\", col)")
def lookup(spark, folder):
    cells = ge.grid_positions(raster_cells(spark, folder), 64, ["fov"])
    grid = ge.rasterise_cells(raster_cells(spark, folder), 64, ["fov"])
    return rounded(ge.lookup_grid(cells, grid, ["target", "n"], ["fov"]), "target").select("cell_id", "target", "n")


@register("hexbin_mean", """WITH l AS (SELECT min(user_id) AS x0, max(user_id) AS x1, min(value) AS y0, max(value) AS y1 FROM events), s AS (SELECT CAST(value > 50 AS INT) AS v, CAST(user_id - x0 AS DOUBLE) / (x1 - x0) * 40 AS sx, (value - y0) / (y1 - y0) * 23 AS sy FROM events, l),
f AS (SELECT *, pow(sx - round_even(sx, 0), 2) + 3 * pow(sy - round_even(sy, 0), 2) < pow(sx - floor(sx) - 0.5, 2) + 3 * pow(sy - floor(sy) - 0.5, 2) AS a FROM s)
SELECT CASE WHEN a THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN a THEN round_even(sx, 0) ELSE floor(sx) END AS BIGINT) AS hx, CAST(CASE WHEN a THEN round_even(sy, 0) ELSE floor(sy) END AS BIGINT) AS hy, round(avg(v), 6) AS mean, count(*) AS cells FROM f GROUP BY ALL HAVING count(*) >= 3""")
def hexbin(spark, folder):
    cells = points(spark, folder).withColumn("hit", (F.col("y") > 50).cast("double"))
    return rounded(ge.hexbin_mean(cells, "hit", 40), "mean")


AREAS = f"""{ANN}, ra AS (SELECT doc, name, polygon_ix, ring_ix, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM ae GROUP BY ALL), ar AS (SELECT doc, name, sum(CASE WHEN ring_ix = 0 THEN a ELSE -a END) AS area_px2 FROM ra GROUP BY ALL)"""


@register("annotation_areas", f"WITH {AREAS}, b AS (SELECT doc, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ann GROUP BY 1) SELECT doc, name, area_px2, round(area_px2 * 0.25 / 1e6, 9) AS area_mm2, min_x, min_y, max_x, max_y FROM ar JOIN b USING (doc)")
def areas(spark, folder):
    found = ge.annotation_areas(annotations(spark, folder), ["doc"], 0.5, 0.5)
    return found.withColumn("area_mm2", F.round("area_mm2", 9))


@register("annotation_areas_by_name", f"WITH {AREAS} SELECT name, count(*) AS features, sum(area_px2) AS area_px2, round(sum(area_px2) * 0.25 / 1e6, 9) AS area_mm2 FROM ar GROUP BY 1")
def areas_by_name(spark, folder):
    found = ge.areas_by_name(ge.annotation_areas(annotations(spark, folder), ["doc"], 0.5, 0.5))
    return found.withColumn("area_mm2", F.round("area_mm2", 9))


@register("label_grid", f"""WITH {ANN}, gp AS (SELECT DISTINCT CAST(user_id AS INT) AS col, CAST(floor(value) AS INT) AS "row" FROM events),
m AS (SELECT "row", col, doc, name, polygon_ix, ring_ix, {MET.replace('px', 'CAST(col AS DOUBLE)').replace('py', 'CAST("row" AS DOUBLE)')} FROM gp, ae),
h AS (SELECT "row", col, doc, name, polygon_ix, ring_ix FROM m WHERE c OR e GROUP BY ALL HAVING bool_or(e) OR count(*) FILTER (WHERE c) % 2 = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY doc DESC, polygon_ix DESC, ring_ix DESC) AS rn FROM h)
SELECT gp."row", gp.col, coalesce(CASE WHEN ring_ix = 0 THEN name ELSE '' END, '') AS label FROM gp LEFT JOIN (SELECT * FROM l WHERE rn = 1) l USING ("row", col)""")
def label_grid(spark, folder):
    grid = table(spark, folder, "events").selectExpr("CAST(floor(value) AS INT) AS row", "CAST(user_id AS INT) AS col").distinct()
    return ge.label_grid(grid, annotations(spark, folder), "doc")


def _shift(axis):
    return f"least(greatest(\"{axis}\" + CAST(floor({uniform('17' + axis, 'draw', 'cell_id')} * 3) AS INT) - 1, 0), 63)"


@register("jitter_resample", f"""WITH {CELLS}, d AS (SELECT fov, draw, {_shift('row')} AS "row", {_shift('col')} AS col FROM g2, generate_series(1, 25) AS t(draw)),
s AS (SELECT fov, draw, avg(CAST(coalesce(grid.target >= 0.45, false) AS INT)) AS share FROM d LEFT JOIN grid USING (fov, "row", col) GROUP BY ALL)
SELECT fov, count(*) AS draws, round(avg(share), 6) AS mean_share, round(quantile_cont(share, 0.5), 6) AS median, round(quantile_cont(share, 0.05), 6) AS q05, round(quantile_cont(share, 0.95), 6) AS q95 FROM s GROUP BY 1""")
def jitter(spark, folder):
    cells = ge.grid_positions(raster_cells(spark, folder), 64, ["fov"])
    grid = ge.rasterise_cells(raster_cells(spark, folder), 64, ["fov"])
    return rounded(ge.jitter_resample(cells, grid, "target", 0.45, 64, "cell_id", ["fov"]), "mean_share", "median", "q05", "q95")
