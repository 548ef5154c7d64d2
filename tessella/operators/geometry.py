"""Polygons, transforms, rasters and lattices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.columns import uniform
from tessella.operators.distance import grid_nearest
from tessella.operators.order import summarise
from tessella.session import attach, cut_lineage, deal, materialised

RUN = 4096
#: Cells that a polygon's edges take, for each edge.
PLACED = 8


def ring_edges(vertices: DataFrame, ring: Sequence[str], x: str = "x", y: str = "y", ix: str = "vertex_ix") -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings.

    A ring is cut into runs of vertices, each carrying the first vertex of the next run, so a ring
    with very many vertices is spread over tasks; the closing edge comes from an aggregate.
    """
    ring = list(ring)
    own = F.floor(F.col(ix) / RUN)
    starts_run = (F.col(ix) % RUN == 0) & (F.col(ix) > 0)
    placed = vertices.select(
        *ring, F.col(ix).alias("__ix"), F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"),
        F.explode(F.when(starts_run, F.array(own, own - 1)).otherwise(F.array(own))).alias("__run"),
    )
    order = Window.partitionBy(*ring, "__run").orderBy("__ix")
    inner = placed.select(*ring, "x1", "y1", F.lead("x1").over(order).alias("x2"), F.lead("y1").over(order).alias("y2"))
    spot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    closing = vertices.groupBy(*ring).agg(F.max_by(spot, F.col(ix)).alias("a"), F.min_by(spot, F.col(ix)).alias("b"))
    return inner.where("x2 IS NOT NULL").unionByName(
        closing.select(*ring, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    )


def polygon_metrics(vertices: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", ix: str = "vertex_ix") -> DataFrame:
    """Vertices, area, perimeter, compactness and centroid per polygon; NULL below three vertices.

    Moments are mergeable. Each run of vertices is summed relative to its own first vertex (in absolute
    coordinates sums cancel for small polygons far from the origin); a run's sums are moved to the first
    vertex of the ring by its offset d and its last vertex l alone, since sums of differences telescope.
    Vertices are shuffled once, by run; what follows is one row for each run.
    """
    keys = list(keys)
    run = Window.partitionBy(*keys, "__run").orderBy("__ix")
    placed = vertices.select(*keys, F.col(ix).alias("__ix"), F.floor(F.col(ix) / RUN).alias("__run"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = placed.select(*keys, "__run", "x", "y", *[F.first(c).over(run).alias("f" + c) for c in "xy"], *[F.lead(c).over(run).alias("n" + c) for c in "xy"])
    local = placed.select(*keys, "__run", "fx", "fy", (F.col("nx").isNull()).alias("last"), *[(F.col(c) - F.col("f" + c[-1])).alias(c[0] + "1" if len(c) == 1 else c[1] + "2") for c in ("x", "y", "nx", "ny")])
    runs = local.groupBy(*keys, "__run").agg(
        F.count(F.lit(1)).alias("n"), F.first("fx").alias("fx"), F.first("fy").alias("fy"),
        F.max(F.when(F.col("last"), F.col("x1"))).alias("lx"), F.max(F.when(F.col("last"), F.col("y1"))).alias("ly"),
        F.sum("x1").alias("sx"), F.sum("y1").alias("sy"),
        *[F.coalesce(F.expr(f"sum({e})"), F.lit(0.0)).alias(c) for c, e in (
            ("a", "x1 * y2 - x2 * y1"), ("p", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"),
            ("cx", "(x1 + x2) * (x1 * y2 - x2 * y1)"), ("cy", "(y1 + y2) * (x1 * y2 - x2 * y1)"))],
    )
    order = Window.partitionBy(*keys).orderBy("__run")
    runs = runs.select("*", *[F.first("f" + c).over(order).alias("o" + c) for c in "xy"], *[F.lead("f" + c).over(order).alias("g" + c) for c in "xy"])
    # d: from the ring's first vertex to the run's; the edge to the next run (or back to the first vertex) goes from x1 to x2.
    runs = runs.selectExpr("*", "fx - ox AS dx", "fy - oy AS dy", "fx - ox + lx AS x1", "fy - oy + ly AS y1", "coalesce(gx - ox, 0D) AS x2", "coalesce(gy - oy, 0D) AS y2")
    cross, link = "(dx * ly - dy * lx)", "(x1 * y2 - x2 * y1)"
    sums = runs.groupBy(*keys).agg(
        F.sum("n").alias("vertices"), F.first("ox").alias("ox"), F.first("oy").alias("oy"), *[F.expr(f"sum({e})").alias(c) for c, e in (
            ("a", f"a + {cross} + {link}"), ("p", "p + sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"),
            ("cx", f"cx + 2 * dx * a + dx * (a + lx * ly) - dy * lx * lx + 2 * dx * {cross} + (x1 + x2) * {link}"),
            ("cy", f"cy + 2 * dy * a + dx * ly * ly - dy * (lx * ly - a) + 2 * dy * {cross} + (y1 + y2) * {link}"),
            ("sx", "sx + n * dx"), ("sy", "sy + n * dy"))],
    )
    enough, area = F.col("vertices") >= 3, F.abs(F.col("a")) / 2
    flat = area <= 1e-12
    return sums.select(
        *keys, "vertices", F.when(enough, area).alias("area"), F.when(enough, F.col("p")).alias("perimeter"),
        F.when(enough & (F.col("p") > 0), 4 * math.pi * area / (F.col("p") * F.col("p"))).alias("compactness"),
        *[(F.col("o" + c) + F.when(flat, F.col("s" + c) / F.col("vertices")).otherwise(F.col("c" + c) / (3 * F.col("a")))).alias("centroid_" + c) for c in "xy"],
    )


def polygon_cover(vertices: DataFrame, group: Sequence[str], ring: Sequence[str]) -> DataFrame:
    """Cells that tell for each point which groups of rings hold it: group, ``level``, ``bx``, ``by`` and an edge or none.

    Each group has its own cell size, a power of two, so that its edges take ``PLACED`` cells an edge at most,
    and so do the cells of its box. A cell holds the edges whose box meets it, and, if it is odd, one row
    without an edge. Edges to the right of the cell's column need no row: their ends cancel in pairs, but for
    the right ends of edges that cross the column's right side. Ends above the cell are the cell's parity; an end
    at the cell's own height is ``turn`` of its edge. So a cell inside a polygon is one row, whatever lies
    beside it.
    """
    group, ring = list(group), list(ring)
    edges = cut_lineage(ring_edges(vertices, ring).select(*group, "x1", "y1", "x2", "y2"))
    wide, high = "abs(x2 - x1)", "abs(y2 - y1)"
    sums = edges.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({wide} + {high})").alias("b"), F.expr(f"sum({wide} * {high})").alias("a"),
        *[F.expr(f"{f}({g}({c}1, {c}2))").alias(f + c) for c in "xy" for f, g in (("min", "least"), ("max", "greatest"))],
    )
    # The least size with a / size^2 + b / size <= k, for the edges (k = PLACED - 1 an edge) and for the box.
    def least(a: str, b: str, k: str) -> str:
        return f"(({b}) + sqrt(({b}) * ({b}) + 4 * ({k}) * ({a}))) / (2 * ({k}))"

    box = least("(maxx - minx) * (maxy - miny)", "maxx - minx + maxy - miny", f"{PLACED} * n - 1")
    far = "greatest(abs(minx), abs(maxx), abs(miny), abs(maxy)) / pow(2D, 50)"
    size = f"greatest({least('a', 'b', f'{PLACED - 1} * n')}, {box}, {far})"
    sizes = sums.select(*group, F.expr(f"CASE WHEN {size} > 0 THEN CAST(ceil(log2({size})) AS INT) ELSE 0 END").alias("level"))
    cells = attach(edges, sizes, group).selectExpr("*", *[f"CAST(floor({c} / pow(2D, level)) AS BIGINT) AS c{c}" for c in ("x1", "x2", "y1", "y2")])
    right = "CASE WHEN cx1 > bx THEN {0}1 ELSE {0}2 END"
    columns = cells.selectExpr("*", "explode(sequence(least(cx1, cx2), greatest(cx1, cx2))) AS bx").selectExpr(
        "*", "bx < greatest(cx1, cx2) AS over", f"{right.format('y')} AS turn", f"{right.format('cy')} AS strip")
    own = columns.selectExpr("*", "explode(sequence(least(cy1, cy2), greatest(cy1, cy2))) AS by").selectExpr(
        *group, "level", "bx", "by", "x1", "y1", "x2", "y2", "CASE WHEN over AND strip = by THEN turn END AS turn")
    ends = columns.where("over").groupBy(*group, "level", "bx", "strip").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    down = Window.partitionBy(*group, "level", "bx").orderBy(F.col("strip").desc())
    odd = ends.select(*group, "level", "bx", "strip", F.row_number().over(down).alias("k"), F.lead("strip").over(down).alias("below")).where("k % 2 = 1")
    inside = odd.selectExpr(*group, "level", "bx", "explode(sequence(below, strip - 1)) AS by").selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("x1", "y1", "x2", "y2", "turn")])
    return own.unionByName(inside)


def polygon_hits(
    points: DataFrame, vertices: DataFrame, point_id: Sequence[str], group: Sequence[str], ring: Sequence[str],
    px: str = "x", py: str = "y",
) -> DataFrame:
    """(point id, group) for every group of rings that holds the point; boundaries count as inside.

    A point meets one cell of each size in use.
    """
    group, point_id = list(group), list(point_id)
    cover = cut_lineage(polygon_cover(vertices, group, ring))
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())  # powers of two in use
    at = points.selectExpr(*point_id, f"CAST({px} AS DOUBLE) AS __px", f"CAST({py} AS DOUBLE) AS __py")
    at = at.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).selectExpr(
        "*", "CAST(floor(__px / pow(2D, level)) AS BIGINT) AS bx", "CAST(floor(__py / pow(2D, level)) AS BIGINT) AS by")
    crosses = "((y1 > __py) <> (y2 > __py) AND __px < (x2 - x1) * (__py - y1) / (y2 - y1) + x1)"
    on_edge = (
        "((x2 - x1) * (__py - y1) = (y2 - y1) * (__px - x1) AND __px BETWEEN least(x1, x2) AND greatest(x1, x2)"
        " AND __py BETWEEN least(y1, y2) AND greatest(y1, y2))"
    )
    odd = f"CASE WHEN x1 IS NULL THEN TRUE ELSE {crosses} <> coalesce(turn > __py, FALSE) END"
    met = at.join(cover, ["level", "bx", "by"]).selectExpr(*point_id, *group, f"{odd} AS c", f"coalesce({on_edge}, FALSE) AS e").where("c OR e")
    return met.groupBy(*point_id, *group).agg(F.count_if("c").alias("n"), F.bool_or("e").alias("e")).where("e OR n % 2 = 1").drop("n", "e")


def point_in_polygon(
    points: DataFrame, vertices: DataFrame, point_id: str, feature: Sequence[str] = ("feature_ix",), out: str = "pathology_region",
    px: str = "x", py: str = "y",
) -> DataFrame:
    """Sorted distinct names of all polygons holding each point; ``UNANNOTATED`` without any."""
    polygon = [*feature, "polygon_ix"]
    hits = polygon_hits(points, vertices, [point_id], [*polygon, "name"], [*polygon, "ring_ix", "name"], px, py)
    labels = hits.groupBy(point_id).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias(out))
    return points.join(labels, point_id, "left").fillna("UNANNOTATED", [out])


def affine_transform(df: DataFrame, matrix: Sequence[Sequence[float]], scale: tuple[float, float] = (1.0, 1.0), x: str = "x", y: str = "y") -> DataFrame:
    """Apply a 3 x 3 affine matrix with last row 0, 0, 1, then a scale per axis."""
    if [float(v) for v in matrix[2]] != [0.0, 0.0, 1.0]:
        raise ValueError("last matrix row must be 0, 0, 1")
    (a, b, c), (d, e, f) = ([float(v) for v in row] for row in matrix[:2])
    return df.withColumns({
        x: (a * F.col(x) + b * F.col(y) + c) * scale[0],
        y: (d * F.col(x) + e * F.col(y) + f) * scale[1],
    })


def _inverse(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f) = (list(map(float, row)) for row in matrix[:2])
    det = a * e - b * d
    if det == 0:
        raise ValueError("matrix has no inverse")
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return [[ia, ib, -(ia * c + ib * f)], [id_, ie, -(id_ * c + ie * f)], [0.0, 0.0, 1.0]]


# Candidate pixel sizes in micrometres.
PIXEL_SIZES = (1.0, 0.2125, 0.425, 0.5)


def alignment_transforms(matrix: Sequence[Sequence[float]]) -> dict[str, Sequence[Sequence[float]]]:
    """Transforms worth trying, in order of preference."""
    return {"identity": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "affine": matrix, "inverse_affine": _inverse(matrix)}


def _trials(spark: SparkSession, matrix: Sequence[Sequence[float]], scales: Sequence[float]) -> DataFrame:
    """One row for each transform at each pixel size; of trials with equal matrices the first stays."""
    transforms = [(k, name, *(float(v) for row in m[:2] for v in row)) for k, (name, m) in enumerate(alignment_transforms(matrix).items())]
    entries = [f"m{i}" for i in range(6)]
    shapes = spark.createDataFrame(transforms, "shape int, transform string, " + ", ".join(f"{m} double" for m in entries))
    sizes = spark.createDataFrame([(k, float(v), format(v, "g")) for k, v in enumerate(scales)], "size int, scale double, label string")
    trials = shapes.crossJoin(F.broadcast(sizes)).withColumn("scaled", F.array(*[F.round(F.col(m) * F.col("scale"), 10) for m in entries], F.round("scale", 10)))
    first = trials.groupBy("scaled").agg(F.min(F.struct("shape", "size", "transform", "scale", "label", *entries)).alias("t")).select("t.*")
    return first.select(F.concat_ws("_scale_", "transform", "label").alias("candidate"), "transform", "scale", *entries)


def alignment_candidates(vertices: DataFrame, cells: DataFrame, matrix: Sequence[Sequence[float]], scales: Sequence[float] = PIXEL_SIZES) -> DataFrame:
    """Score identity, matrix and inverse at several pixel sizes by how they cover the cell box.

    The trials are three rows for each pixel size, so one pass over the vertices scores them all.
    """
    trials = F.broadcast(_trials(vertices.sparkSession, matrix, scales))
    box = cells.agg(F.min("x").alias("cx0"), F.max("x").alias("cx1"), F.min("y").alias("cy0"), F.max("y").alias("cy1"))
    moved = vertices.select("x", "y").crossJoin(trials).selectExpr(
        "candidate", "transform", "scale", "(m0 * x + m1 * y + m2) * scale AS tx", "(m3 * x + m4 * y + m5) * scale AS ty"
    )
    inside = (
        "tx BETWEEN cx0 - greatest((cx1 - cx0) * 0.1D, 100D) AND cx1 + greatest((cx1 - cx0) * 0.1D, 100D)"
        " AND ty BETWEEN cy0 - greatest((cy1 - cy0) * 0.1D, 100D) AND cy1 + greatest((cy1 - cy0) * 0.1D, 100D)"
    )
    per = attach(moved, box).groupBy("candidate", "transform", "scale", "cx0", "cx1", "cy0", "cy1").agg(
        F.expr(f"avg(CAST({inside} AS DOUBLE))").alias("fraction_inside"),
        F.min("tx").alias("a0"), F.max("tx").alias("a1"), F.min("ty").alias("b0"), F.max("ty").alias("b1"),
    )
    width, height = "greatest(cx1 - cx0, 1D)", "greatest(cy1 - cy0, 1D)"
    shape = f"(abs(ln(greatest((a1 - a0) / {width}, 1e-9D))) + abs(ln(greatest((b1 - b0) / {height}, 1e-9D))))"
    centre = f"hypot(((a0 + a1) - (cx0 + cx1)) / (2D * {width}), ((b0 + b1) - (cy0 + cy1)) / (2D * {height}))"
    return per.selectExpr("candidate", "transform", "scale", "fraction_inside", f"fraction_inside - 0.15D * {shape} - 0.10D * {centre} AS score")


def alignment_accept(candidates: DataFrame, inside: float = 0.70, lead: float = 0.05) -> DataFrame:
    """Best candidate if it covers enough cells and leads clearly, otherwise an abstention."""
    order = Window.orderBy(F.desc("score"), "candidate")
    ranked = candidates.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("rn = 1")
    lead_by = F.col("score") - F.coalesce(F.col("next"), F.lit(float("-inf")))
    accepted = (F.col("fraction_inside") >= inside) & (lead_by >= lead)
    return ranked.select("candidate", "transform", "scale", "score", "fraction_inside", accepted.alias("accepted"), F.when(accepted, "ALIGNED").otherwise("NOT_COMPUTED").alias("status"))


def grid_positions(cells: DataFrame, size: int, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Row and column of every cell on a square grid over the extent of its group; adds ``step``."""
    if size < 8:
        raise ValueError("grid size must be at least 8")
    limits = cells.groupBy(*by).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    step = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1.0)) / (size - 1)

    def at(value: str, low: str) -> Column:
        return F.least(F.greatest(F.rint((F.col(value) - F.col(low)) / step), F.lit(0.0)), F.lit(size - 1.0)).cast("int")

    placed = attach(cells, limits, by)
    return placed.withColumns({"row": at(y, "__y0"), "col": at(x, "__x0"), "step": step}).drop("__x0", "__x1", "__y0", "__y1")


def rasterise_cells(cells: DataFrame, size: int, by: Sequence[str] = (), signals: Sequence[str] = ("target_signal", "vessel_signal", "ecm_score", "caf_score"), tumour: str = "is_tumour") -> DataFrame:
    """Occupied grid positions with cell count, mean signals, tumour flag and source mask."""
    placed = grid_positions(cells, size, by)
    target, vessel, ecm, caf = signals
    grid = placed.groupBy(*by, "row", "col", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("target"), F.avg(vessel).alias("vessel"),
        F.avg(ecm).alias("ecm"), F.avg(caf).alias("caf"), F.bool_or(tumour).alias("is_tumour"),
    )
    return grid.withColumns({
        "vessel_mask": F.col("vessel") >= 0.5, "target": F.greatest("target", F.lit(0.0)),
        "ecm": F.least(F.greatest("ecm", F.lit(0.0)), F.lit(1.0)), "caf": F.least(F.greatest("caf", F.lit(0.0)), F.lit(1.0)),
    })


def grid_distance(grid: DataFrame, mask: str, pixel_size: float = 1.0, by: Sequence[str] = (), out: str = "distance") -> DataFrame:
    """Distance of every grid position to the nearest masked one, in physical units."""
    return grid_nearest(grid, grid.where(F.col(mask)), by, out=out, unit=pixel_size)


def lookup_grid(cells: DataFrame, grid: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Grid values at each cell's row and column."""
    return cells.join(grid.select(*by, "row", "col", *values), [*by, "row", "col"], "left")


def hexbin_mean(cells: DataFrame, value: str, gridsize: int, by: Sequence[str] = (), minimum: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """Mean per hexagon from two offset lattices; hexagons with fewer than ``minimum`` rows drop."""
    limits = cells.groupBy(*by).agg(F.min(x).alias("hx0"), F.max(x).alias("hx1"), F.min(y).alias("hy0"), F.max(y).alias("hy1"))
    ny = max(int(gridsize / math.sqrt(3)), 1)
    placed = attach(cells, limits, by).selectExpr(
        *by, f"{value} AS v", f"({x} - hx0) / (hx1 - hx0) * {gridsize}D AS sx", f"({y} - hy0) / (hy1 - hy0) * {ny}D AS sy"
    )
    first = "(pow(sx - rint(sx), 2) + 3 * pow(sy - rint(sy), 2) < pow(sx - floor(sx) - 0.5D, 2) + 3 * pow(sy - floor(sy) - 0.5D, 2))"
    keyed = placed.selectExpr(
        *by, "v", f"CASE WHEN {first} THEN 0 ELSE 1 END AS lattice",
        f"CAST(CASE WHEN {first} THEN rint(sx) ELSE floor(sx) END AS BIGINT) AS hx", f"CAST(CASE WHEN {first} THEN rint(sy) ELSE floor(sy) END AS BIGINT) AS hy",
    )
    return keyed.groupBy(*by, "lattice", "hx", "hy").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= minimum)


def annotation_areas(vertices: DataFrame, feature: Sequence[str], pixel_x: float, pixel_y: float) -> DataFrame:
    """Area of every annotated feature: outer rings minus holes, in px and mm2, with bounds."""
    ring = [*feature, "name", "polygon_ix", "ring_ix"]
    areas = polygon_metrics(vertices, ring).select(*ring, F.coalesce("area", F.lit(0.0)).alias("a"))
    signed = F.when(F.col("ring_ix") == 0, F.col("a")).otherwise(-F.col("a"))
    total = areas.groupBy(*feature, "name").agg(F.sum(signed).alias("area_px2"))
    bounds = vertices.groupBy(*feature, "name").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    return total.join(bounds, [*feature, "name"]).withColumn("area_mm2", F.col("area_px2") * (pixel_x * pixel_y / 1e6))


def areas_by_name(areas: DataFrame) -> DataFrame:
    return areas.groupBy("name").agg(F.count(F.lit(1)).alias("features"), F.sum("area_px2").alias("area_px2"), F.sum("area_mm2").alias("area_mm2"))


def label_grid(grid: DataFrame, vertices: DataFrame, feature: str, by_id: Sequence[str] = ("row", "col")) -> DataFrame:
    """Label of every grid position: a later feature wins, a hole clears to empty."""
    ring = [feature, "name", "polygon_ix", "ring_ix"]
    hits = polygon_hits(grid.withColumn("__x", F.col("col")).withColumn("__y", F.col("row")), vertices, by_id, ring, ring, "__x", "__y")
    drawn = F.when(F.col("ring_ix") == 0, F.col("name")).otherwise(F.lit(""))
    last = hits.groupBy(*by_id).agg(F.max_by(drawn, F.struct(feature, "polygon_ix", "ring_ix")).alias("label"))
    return grid.join(last, list(by_id), "left").fillna("", ["label"])


def jitter_resample(cells: DataFrame, grid: DataFrame, value: str, threshold: float, size: int, cell_id: str, by: Sequence[str] = (), draws: int = 25, seed: int = 17) -> DataFrame:
    """Spread of the share at or above ``threshold`` when every cell moves by -1, 0 or 1 per axis."""
    cells = deal(materialised(cells.select(*by, "row", "col", cell_id)), draws)
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def moved(axis: str) -> Column:
        shift = F.floor(uniform(f"{seed}{axis}", F.col("draw"), F.col(cell_id)) * 3).cast("int") - 1
        return F.least(F.greatest(F.col(axis) + shift, F.lit(0)), F.lit(size - 1))

    at = drawn.select(*by, "draw", moved("row").alias("row"), moved("col").alias("col"))
    counted = at.groupBy(*by, "draw", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(grid.select(*by, "row", "col", value), [*by, "row", "col"], "left")
    hit = F.coalesce(F.col(value) >= threshold, F.lit(False)).cast("long")
    shares = found.groupBy(*by, "draw").agg((F.sum(F.col("n") * hit) / F.sum("n")).alias("share"))
    return summarise(shares, by, [F.count(F.lit(1)).alias("draws"), F.avg("share").alias("mean_share")], {
        "median": (F.col("share"), 0.5), "q05": (F.col("share"), 0.05), "q95": (F.col("share"), 0.95),
    })
