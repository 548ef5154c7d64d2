"""Nearest, k-nearest and within-radius joins as grid equi-joins.

1. Coordinates are reduced to distinct points, so a coordinate shared by very many rows is one point.
2. Counts on a coarse grid give every area its own cell size; a single equi-join on (cell size, cell)
   then settles every query whose neighbours lie within one cell.  Cells that still hold too many
   sources are left out of this join.
3. What is left descends a pyramid of counted bounding boxes.  A box is dropped only when it
   cannot hold one of the k nearest, so the answer stays exact in dense and in empty areas.

The single nearest source is found in tiles instead (``_nearest_in_tiles``): strips in x, cut in y, with about
``TILE`` sources each.  Every query is sent once, to its own tile; only where the circle to the nearest source
found there leaves the tile, it is sent to the few others that the circle meets, or down the pyramid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import attach, broadcast_if, cut_lineage, materialised

FAN = 4
LEAF = 16
COARSE_LEVEL = 6
HOT_FACTOR = 64
DEEPEST = 40
#: Sources of a tile, sources drawn from each to place the cuts, queries of one unit, and tiles a circle may meet.
TILE = 8192
DRAWN = 16
UNIT = 65_536
MEETS = 16
#: Numbers of one array of a search within a tile: few, so that arrays stay in the cache and memory is used again.
HELD = 60_000
Finish = Callable[[DataFrame], DataFrame]
DISTANCE = "sqrt((qx - sx) * (qx - sx) + (qy - sy) * (qy - sy)) AS d"


class _Extent:
    """Origin and span of the sources; cell sizes are span / 2^level."""

    def __init__(self, sources: DataFrame, by: list[str]) -> None:
        groups = F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)
        row = sources.agg(
            F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"),
            F.count(F.lit(1)).alias("n"), groups.alias("groups"),
        ).first()
        self.n = row["n"]
        self.per_group = self.n / max(row["groups"] or 1, 1)
        if self.n:
            self.x0, self.y0 = row["x0"], row["y0"]
            self.span = max(row["x1"] - row["x0"], row["y1"] - row["y0"]) or 1.0

    def cell(self, column: str, axis: str, level: str) -> str:
        """Cell index of a coordinate at a level given as an SQL expression."""
        start = self.x0 if axis == "x" else self.y0
        return f"CAST(floor(({column} - {start!r}D) * pow(2D, {level}) / {self.span!r}D) AS BIGINT)"


def _wanted(k: int) -> float:
    """Sources a 3 x 3 block of cells should hold so that one cell's reach finds k of them."""
    return 5.0 * k + 10.0


def _level_map(sources: DataFrame, by: list[str], extent: _Extent, coarse: int, k: int, lowest: int) -> DataFrame:
    """Level of every coarse cell whose own sources ask for cells no larger than itself.

    The occupancy is the one a source sees (sum of n squared over n), so a dense spot inside a
    coarse cell makes its cells small.
    """
    fine = coarse + 2 + max(0, math.floor(math.log2(math.sqrt(max(extent.per_group / 4**coarse / 32, 1.0)))))
    bins = sources.groupBy(
        *by, F.expr(extent.cell("sx", "x", str(fine))).alias("fx"), F.expr(extent.cell("sy", "y", str(fine))).alias("fy")
    ).agg(F.count(F.lit(1)).alias("n"))
    ratio = 2 ** (fine - coarse)
    cells = bins.groupBy(*by, F.expr(f"fx div {ratio}").alias("gx"), F.expr(f"fy div {ratio}").alias("gy")).agg(
        F.expr(f"greatest(sum(n * (n - 1)) / sum(n), sum(n) / {float(ratio * ratio)}D)").alias("seen")
    )
    level = f"CAST(least({DEEPEST}, {fine} + rint(log(4D, 9D * seen / {_wanted(k)}D))) AS INT)"
    own = cells.selectExpr(*by, "gx", "gy", f"{level} AS level").where(F.col("level") >= coarse)
    return own.withColumn("level", F.greatest("level", F.lit(lowest)))


def _grid_pairs(
    queries: DataFrame, sources: DataFrame, groups: DataFrame, by: list[str], extent: _Extent, k: int, radius: float | None
) -> DataFrame:
    """Pairs closer than one cell of the query's own cell size (and ``radius``)."""
    coarse = max(0, min(COARSE_LEVEL, math.floor(math.log2(math.sqrt(max(extent.per_group / 32, 1.0))))))
    lowest = -1 if radius is None else max(-1, min(DEEPEST, math.floor(math.log2(extent.span / radius))))
    levels = cut_lineage(_level_map(sources, by, extent, coarse, k, lowest))
    rows = levels.count()
    # Areas with few sources share one level per group, down to a cell that holds the whole extent.
    start = f"CAST(greatest({lowest}, least({coarse}, floor(log(4D, 9D * n / {_wanted(k)}D)))) AS INT) AS start"
    starts = groups.selectExpr(*by, start)
    if by:
        starts = broadcast_if(starts, groups.count())
    at = [f"{extent.cell('qx', 'x', str(coarse))} AS gx", f"{extent.cell('qy', 'y', str(coarse))} AS gy"]
    shifts = "explode(array(-1L, 0L, 1L))"
    placed = queries.selectExpr("*", *at).join(broadcast_if(levels, rows), [*by, "gx", "gy"], "left")
    placed = (placed.join(starts, by) if by else attach(placed, starts)).selectExpr(*queries.columns, "coalesce(level, start) AS level")
    around = placed.selectExpr("*", f"{shifts} AS i").selectExpr("*", f"{shifts} AS j").selectExpr(
        *queries.columns, "level", f"{extent.cell('qx', 'x', 'level')} + i AS bx", f"{extent.cell('qy', 'y', 'level')} + j AS by_"
    )
    # A source takes part in every cell size used in its own or a neighbouring coarse cell.
    nearby = levels.selectExpr("*", f"{shifts} AS i").selectExpr("*", f"{shifts} AS j").selectExpr(*by, "gx + i AS gx", "gy + j AS gy", "level")
    nearby = nearby.groupBy(*by, "gx", "gy").agg(F.collect_set("level").alias("levels"))
    at = [f"{extent.cell('sx', 'x', str(coarse))} AS gx", f"{extent.cell('sy', 'y', str(coarse))} AS gy"]
    spread = sources.selectExpr("*", *at).join(broadcast_if(nearby, 9 * rows), [*by, "gx", "gy"], "left")
    spread = (spread.join(starts, by) if by else attach(spread, starts)).selectExpr(
        *sources.columns, "explode(IF(levels IS NULL, array(start), array_union(levels, array(start)))) AS level"
    )
    spread = spread.selectExpr("*", f"{extent.cell('sx', 'x', 'level')} AS bx", f"{extent.cell('sy', 'y', 'level')} AS by_")
    keys = [*by, "level", "bx", "by_"]
    crowded = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_FACTOR * (k + 3)).drop("__n")
    crowded = cut_lineage(crowded)
    if not crowded.isEmpty():
        blocked = around.join(crowded, keys, "left_semi").select(*queries.columns).distinct()
        around = around.join(blocked, queries.columns, "left_anti")
        spread = spread.join(crowded, keys, "left_anti")
    reach = f"{extent.span!r}D / pow(2D, level)"
    limit = reach if radius is None else f"least({reach}, {radius!r}D)"
    complete = "false" if radius is None else f"{reach} >= {radius!r}D"
    pairs = around.join(spread, keys).selectExpr("*", DISTANCE, f"{complete} AS complete")
    return pairs.where(f"d <= {limit}").drop("level", "bx", "by_")


def _pyramid_pairs(
    queries: DataFrame, sources: DataFrame, by: list[str], extent: _Extent, k: int, radius: float | None
) -> DataFrame:
    """Candidate pairs that include every source among the k nearest (and within ``radius``)."""
    depth = max(1, math.ceil(math.log(math.sqrt(max(extent.per_group / LEAF, 1.0)), FAN)))

    def leaves(depth: int) -> tuple[DataFrame, DataFrame]:
        level = str(depth * int(math.log2(FAN)))
        points = sources.selectExpr("*", f"{extent.cell('sx', 'x', level)} AS px", f"{extent.cell('sy', 'y', level)} AS py")
        boxes = points.groupBy(*by, "px", "py").agg(
            F.sum("w").alias("n"), F.count(F.lit(1)).alias("points"),
            F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"),
        )
        return points, cut_lineage(boxes)

    points, leaf = leaves(depth)
    # Dense spots ask for a deeper pyramid; distinct coordinates make this end.
    while 2 * depth < DEEPEST:
        seen = leaf.agg(F.expr("sum(CAST(points AS DOUBLE) * points) / sum(points)").alias("s")).first()["s"]
        if seen <= 8 * (LEAF + k):
            break
        depth += max(1, math.ceil(math.log(math.sqrt(seen / (LEAF + k)), FAN)))
        points, leaf = leaves(depth)
    pyramid = leaf.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)))).groupBy(
        *by, "level", F.expr(f"CAST(floor(px / pow({FAN}D, {depth} - level)) AS BIGINT)").alias("bx"),
        F.expr(f"CAST(floor(py / pow({FAN}D, {depth} - level)) AS BIGINT)").alias("by_"),
    ).agg(
        F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")
    )
    pyramid = cut_lineage(pyramid.withColumns({
        "px": F.when(F.col("level") > 1, F.expr(f"bx div {FAN}")).otherwise(F.lit(0)).cast("long"),
        "py": F.when(F.col("level") > 1, F.expr(f"by_ div {FAN}")).otherwise(F.lit(0)).cast("long"),
    }))
    boxes = pyramid.count()
    q = [*by, "qx", "qy"]
    over = "PARTITION BY " + ", ".join(q)
    cap = "" if radius is None else f" AND lo <= {radius * (1 + 1e-9)!r}D"
    candidates = queries.selectExpr(*q, "0L AS px", "0L AS py")
    for level in range(1, depth + 1):
        table = broadcast_if(pyramid.where(F.col("level") == level).drop("level"), boxes)
        found = candidates.join(table, [*by, "px", "py"]).selectExpr(
            *q, "bx", "by_", "n",
            "sqrt(pow(greatest(x0 - qx, 0D, qx - x1), 2) + pow(greatest(y0 - qy, 0D, qy - y1), 2)) AS lo",
            "sqrt(pow(greatest(abs(qx - x0), abs(qx - x1)), 2) + pow(greatest(abs(qy - y0), abs(qy - y1)), 2)) AS hi",
        )
        if k > 1:
            found = found.selectExpr("*", f"sum(n) OVER ({over} ORDER BY hi, bx, by_ ROWS UNBOUNDED PRECEDING) AS have")
            bound = f"min(IF(have >= {k}, hi, NULL)) OVER ({over})"
        else:
            bound = f"min(hi) OVER ({over})"
        found = found.selectExpr("*", f"{bound} AS bound").where(f"(bound IS NULL OR lo <= bound * (1D + 1e-9D)){cap}")
        candidates = found.selectExpr(*q, "bx AS px", "by_ AS py")
    pairs = candidates.join(points, [*by, "px", "py"]).selectExpr("*", DISTANCE, "true AS complete").drop("px", "py")
    return pairs if radius is None else pairs.where(f"d <= {radius!r}D")


def neighbours(
    queries: DataFrame, sources: DataFrame, by: Sequence[str], k: int, radius: float | None, finish: Finish
) -> DataFrame:
    """Apply ``finish`` to pairs that hold, for each query, all sources within the k nearest.

    ``queries`` has columns by + (qx, qy), distinct; ``sources`` has by + (sx, sy, w, ...), where
    ``w`` counts the rows a source point stands for.  ``finish`` groups pairs by query and must
    return ``have``, the summed weight, and ``complete``.  Queries without any source in reach are
    absent.
    """
    by = list(by)
    # Distinct points are read by several stages, so they are de-duplicated once.
    queries, sources = cut_lineage(queries), cut_lineage(sources)
    extent = _Extent(sources, by)
    if extent.n == 0:
        none = queries.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in sources.dtypes if c not in by})
        return finish(none.withColumns({"d": F.lit(0.0), "complete": F.lit(True)}))
    groups = cut_lineage(sources.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    if by:
        queries = queries.join(broadcast_if(groups.select(*by), groups.count()), by, "left_semi")
    first = finish(_grid_pairs(queries, sources, groups, by, extent, k, radius))
    first = cut_lineage(first.where(F.col("complete") | (F.col("have") >= k)))
    rest = cut_lineage(queries.join(first, [*by, "qx", "qy"], "left_anti"))
    if rest.isEmpty():
        return first
    return first.unionByName(finish(_pyramid_pairs(rest, sources, by, extent, k, radius)))


def _packed(sx: np.ndarray, sy: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sources that puts ``leaf`` close ones in a row, and where each leaf starts."""
    leaves = -(-len(sx) // leaf)
    width, height = np.ptp(sx), np.ptp(sy)
    strips = int(min(max(np.sqrt(leaves * width / height) if height > 0 else leaves, 1), leaves))
    by_x = np.argsort(sx, kind="stable")
    # Strips of whole leaves: a leaf that held the end of one strip and the start of the next would be as high as both.
    order = by_x[np.lexsort((sy[by_x], np.arange(len(sx)) // (-(-leaves // strips) * leaf)))]
    return order, np.arange(leaves) * leaf


def nearest_squares(sx: np.ndarray, sy: np.ndarray, qx: np.ndarray, qy: np.ndarray, leaf: int = 32) -> np.ndarray:
    """Squared distance of every query to its nearest source: boxes of ``leaf`` sources, the closest one first."""
    order, starts = _packed(sx, sy, leaf)
    leaves = len(starts)
    order = np.append(order, np.repeat(order[-1:], leaves * leaf - len(order)))
    px, py = sx[order].reshape(leaves, leaf), sy[order].reshape(leaves, leaf)
    x0, x1, y0, y1 = px.min(1), px.max(1), py.min(1), py.max(1)
    out, step = np.empty(len(qx)), max(1, HELD // leaves)
    for at in range(0, len(qx), step):
        x, y = qx[at : at + step, None], qy[at : at + step, None]
        dx, dy = np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
        low = dx * dx + dy * dy
        first = low.argmin(1)
        best = ((x - px[first]) ** 2 + (y - py[first]) ** 2).min(1)
        row, box = np.nonzero(low < best[:, None])
        if len(row):
            near = ((x[row] - px[box]) ** 2 + (y[row] - py[box]) ** 2).min(1)
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            best[row[starts]] = np.minimum(best[row[starts]], np.minimum.reduceat(near, starts))
        out[at : at + step] = best
    return out


def _unit_distances(by: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Queries of one unit with their distance to the nearest source of its tile; NULL if it has none."""
    def run(rows: pa.Table) -> pa.Table:
        source = rows.column("source").to_numpy()
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        asked = rows.filter(pa.array(~source)).select([*by, "x", "y", "edge"])
        squares = np.full(asked.num_rows, np.nan)
        if source.any() and len(squares):
            squares = nearest_squares(x[source], y[source], x[~source], y[~source])
        return asked.append_column("d", pa.array(np.sqrt(squares), from_pandas=True))
    return run


def nearest_k(
    sx: np.ndarray, sy: np.ndarray, rank: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, radius: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, source and distance of the k nearest sources within ``radius``, by query, distance and rank of the source."""
    leaf = max(32, k)
    order, starts = _packed(sx, sy, leaf)
    leaves, (ox, oy) = len(starts), (sx[order], sy[order])
    px, py = (np.append(o, np.full(leaves * leaf - len(o), np.inf)).reshape(leaves, leaf) for o in (ox, oy))
    x0, x1, y0, y1 = (f.reduceat(o, starts) for o in (ox, oy) for f in (np.minimum, np.maximum))
    found, step = [], max(1, HELD // leaves)
    for at in range(0, len(qx), step):
        x, y = qx[at : at + step, None], qy[at : at + step, None]
        dx, dy = np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
        low = dx * dx + dy * dy
        first = low.argmin(1)
        bound = np.partition((x - px[first]) ** 2 + (y - py[first]) ** 2, k - 1, axis=1)[:, k - 1]
        bound = np.minimum(bound, radius * radius) * (1 + 1e-12)
        row, box = np.nonzero(low <= bound[:, None])
        squares = (x[row] - px[box]) ** 2 + (y[row] - py[box]) ** 2
        i, c = np.nonzero((squares <= bound[row][:, None]) & (squares < np.inf))
        row, source, d = row[i], order[box[i] * leaf + c], np.sqrt(squares[i, c])
        row, source, d = row[d <= radius], source[d <= radius], d[d <= radius]
        sort = np.lexsort((rank[source], d, row))
        row, source, d = row[sort], source[sort], d[sort]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[kept] + at, source[kept], d[kept]))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _unit_nearest_k(by: list[str], values: list[str], k: int, radius: float, pairs: bool) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one unit, or the means of the values for each query, NULL if a nearer source may lie outside of its tile."""
    def run(rows: pa.Table) -> pa.Table:
        source = rows.column("source").to_numpy()
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        held, asked = rows.filter(pa.array(source)), rows.filter(pa.array(~source)).select([*by, "x", "y", "edge"])
        rank = np.empty(held.num_rows, np.int64)
        rank[np.asarray(pc.array_sort_indices(held.column("sid").combine_chunks(), null_placement="at_start"))] = np.arange(held.num_rows)
        if held.num_rows:
            query, which, d = nearest_k(x[source], y[source], rank, x[~source], y[~source], k, radius)
        else:
            query, which, d = np.empty(0, int), np.empty(0, int), np.empty(0)
        if pairs:
            out = asked.take(pa.array(query)).append_column("d", pa.array(d))
            for name in ["sid", *values]:
                out = out.append_column(name, held.column(name).take(pa.array(which)))
            return out
        number = np.bincount(query, minlength=asked.num_rows)
        last = np.zeros(asked.num_rows)
        np.maximum.at(last, query, d)
        reach = np.where(number < k, radius, last)
        # A source on the border may win a tie by its id.
        whole = reach < asked.column("edge").to_numpy()
        out = asked.append_column("reach", pa.array(reach)).append_column("whole", pa.array(whole))
        for name in values:
            column = held.column(name).combine_chunks()
            known = ~np.asarray(column.is_null())
            amount = np.where(known, column.to_numpy(zero_copy_only=False), 0.0)
            n = np.bincount(query, known[which].astype(float), asked.num_rows)
            total = np.bincount(query, amount[which], asked.num_rows)
            out = out.append_column(name, pa.array(total / np.where(n > 0, n, 1.0), mask=n == 0))
        return out.append_column("have", pa.array(number))
    return run


def _unit_weights(by: list[str], k: int, radius: float) -> Callable[[pa.Table], pa.Table]:
    """Queries of one unit with the weight of the sources of its tile within ``radius``; from ``k`` on it may be too small, never below ``k``."""
    def run(rows: pa.Table) -> pa.Table:
        source = rows.column("source").to_numpy()
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        held, asked = rows.filter(pa.array(source)), rows.filter(pa.array(~source)).select([*by, "x", "y", "edge"])
        have = np.zeros(asked.num_rows)
        if held.num_rows and len(have):
            query, which, _ = nearest_k(x[source], y[source], np.arange(held.num_rows), x[~source], y[~source], k, radius)
            have = np.bincount(query, held.column("w").to_numpy()[which], len(have))
        return asked.append_column("have", pa.array(have.astype(np.int64)))
    return run


def _at_most(cuts: str, value: str) -> str:
    """Number of entries of a sorted array that are no larger than a value."""
    steps = f"transform(sequence(length(bin(size({cuts}))) - 1, 0, -1), i -> shiftleft(1, i))"
    return f"aggregate({steps}, 0, (at, s) -> IF({value} >= get({cuts}, at + s - 1), at + s, at))"


def _known(by: list[str], x: str, y: str) -> str:
    return " AND ".join([f"{c} IS NOT NULL" for c in [*by, x, y]] + [f"NOT isnan({c})" for c in (x, y)])


class _Tiles:
    """Strips in x cut in y, with the sources (by, sx, sy, ...) of every tile.

    Cuts come from sources drawn by hash; they balance the work and never change a result.
    """

    def __init__(self, sources: DataFrame, by: list[str]) -> None:
        self.by, self.q, self.tile = by, [*by, "qx", "qy"], [*by, "strip", "tile"]
        self.sources = sources = cut_lineage(sources.where(_known(by, "sx", "sy")))
        self.extra = [f for f in sources.schema.fields if f.name not in (*by, "sx", "sy")]
        self.fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields if f.name in by)
        spans = sources.groupBy(*by).agg((F.max("sx") - F.min("sx")).alias("w"), (F.max("sy") - F.min("sy")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 0")
        drawn = sources.where(F.pmod(F.xxhash64("sx", "sy"), F.lit(TILE // DRAWN)) == 0).select(*by, "sx", "sy")
        found = drawn.groupBy(*by).agg(F.array_sort(F.collect_list("sx")).alias("xs"))
        strips = spans.join(found, by, "left") if by else spans.crossJoin(found)
        tiles = f"coalesce(size(xs), 0) / {DRAWN}"
        strips = strips.selectExpr("*", f"CAST(ceil(size(xs) / greatest(1, least({tiles}, IF(h > 0, sqrt({tiles} * w / h), {tiles})))) AS INT) AS step")
        self.strips = cut_lineage(strips.selectExpr(*by, "coalesce(array_distinct(filter(xs, (x, i) -> i > 0 AND i % step = 0)), array()) AS xs"))
        self.number = self.strips.count()
        placed = self.with_strips(drawn).selectExpr(*by, "sy", f"{_at_most('xs', 'sx')} AS strip")
        rows = placed.groupBy(*by, "strip").agg(F.array_sort(F.collect_list("sy")).alias("ys"))
        self.rows = cut_lineage(rows.selectExpr(*by, "strip", f"filter(ys, (y, i) -> i > 0 AND i % {DRAWN} = 0) AS ys"))
        self.row_number = self.rows.count()
        kept = [f.name for f in self.extra]
        held = self.with_strips(sources).selectExpr(*by, "sx", "sy", *kept, f"{_at_most('xs', 'sx')} AS strip")
        self.held = cut_lineage(self.with_rows(held).selectExpr(*by, "sx", "sy", *kept, "strip", f"{_at_most('ys', 'sy')} AS tile"))

    def with_strips(self, df: DataFrame) -> DataFrame:
        return df.join(broadcast_if(self.strips, self.number), self.by) if self.by else df.crossJoin(F.broadcast(self.strips))

    def with_rows(self, df: DataFrame) -> DataFrame:
        joined = df.join(broadcast_if(self.rows, self.row_number), [*self.by, "strip"], "left")
        return joined.withColumn("ys", F.expr("coalesce(ys, array())"))

    def own(self, queries: DataFrame) -> DataFrame:
        """Tile of every query and ``edge``, its distance to the border of the tile."""
        def gap(cuts: str, at: str, value: str) -> str:
            # get() is NULL beyond the first and last cut, where a tile has no border.
            return f"least(coalesce({value} - get({cuts}, {at} - 1), double('infinity')), coalesce(get({cuts}, {at}) - {value}, double('infinity')))"

        mine = self.with_strips(queries.where(_known(self.by, "qx", "qy"))).selectExpr(*self.q, "xs", f"{_at_most('xs', 'qx')} AS strip")
        mine = self.with_rows(mine.selectExpr(*self.q, "strip", f"{gap('xs', 'strip', 'qx')} AS edge"))
        mine = mine.selectExpr(*self.q, "strip", "edge", "ys", f"{_at_most('ys', 'qy')} AS tile")
        return cut_lineage(mine.selectExpr(*self.q, "strip", "tile", f"least(edge, {gap('ys', 'tile', 'qy')}) AS edge"))

    def met(self, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Tiles met by the circle of radius ``reach`` around each query, and the queries that meet too many or know no radius."""
        q, reach = self.q, "reach * (1D + 1e-9D)"
        wide = self.with_strips(rest).selectExpr(*q, "reach", f"{_at_most('xs', f'qx - {reach}')} AS s0", f"{_at_most('xs', f'qx + {reach}')} AS s1")
        wide = cut_lineage(wide)
        near = wide.where(f"reach IS NOT NULL AND s1 - s0 < {MEETS}").selectExpr(*q, "reach", "explode(sequence(s0, s1)) AS strip")
        near = cut_lineage(self.with_rows(near).selectExpr(
            *q, "reach", "strip", f"{_at_most('ys', f'qy - {reach}')} AS t0", f"{_at_most('ys', f'qy + {reach}')} AS t1"
        ))
        few = cut_lineage(near.groupBy(*q).agg(F.sum(F.expr("t1 - t0 + 1")).alias("__t")).where(f"__t <= {MEETS * MEETS}").drop("__t"))
        again = near.join(few, q, "left_semi").selectExpr(*q, "strip", "explode(sequence(t0, t1)) AS tile", "reach AS edge")
        return cut_lineage(again), cut_lineage(wide.select(*q).join(few, q, "left_anti"))

    def measured(self, asked: DataFrame, function: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
        """Units of a tile share its sources, so a tile with very many queries is spread over tasks."""
        tile = self.tile
        units = asked.groupBy(*tile).agg(F.expr(f"CAST((count(1) + {UNIT - 1}) DIV {UNIT} AS INT)").alias("units"))
        units = cut_lineage(units)
        table = broadcast_if(units, units.count())
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.extra]
        split = asked.join(table, tile).select(*tile, F.expr("CAST(pmod(xxhash64(qx, qy), units) AS INT)").alias("unit"), F.col("qx").alias("x"), F.col("qy").alias("y"), "edge", F.lit(False).alias("source"), *none)
        copies = self.held.join(table, tile).selectExpr(
            *tile, "explode(sequence(0, units - 1)) AS unit", "sx AS x", "sy AS y", "CAST(NULL AS DOUBLE) AS edge", "true AS source", *[f.name for f in self.extra]
        )
        schema = ", ".join([*([self.fields] if self.fields else []), "x double", "y double", "edge double", columns])
        got = split.unionByName(copies).groupBy(*tile, "unit").applyInArrow(function, schema)
        return got.withColumnsRenamed({"x": "qx", "y": "qy"})


def _nearest_in_tiles(queries: DataFrame, sources: DataFrame | _Tiles, by: list[str]) -> DataFrame:
    """Distance ``__d`` of every query (by, qx, qy) to the nearest source (by, sx, sy, ...); queries without one are absent."""
    queries, tiles = materialised(queries), sources if isinstance(sources, _Tiles) else _Tiles(sources.select(*by, "sx", "sy"), by)
    q = tiles.q
    first = cut_lineage(tiles.measured(tiles.own(queries), _unit_distances(by), "d double"))
    done = first.where("d <= edge").select(*q, F.col("d").alias("__d"))
    again, left = tiles.met(first.where("d IS NULL OR d > edge").select(*q, F.col("d").alias("reach")))
    second = tiles.measured(again, _unit_distances(by), "d double").groupBy(*q).agg(F.min("d").alias("__d"))
    result = done.unionByName(second)
    if left.isEmpty():
        return result
    extent = _Extent(tiles.sources, by)
    far = _pyramid_pairs(left, tiles.sources.withColumn("w", F.lit(1)), by, extent, 1, None).groupBy(*q).agg(F.min("d").alias("__d"))
    return result.unionByName(far)


def _means_in_tiles(queries: DataFrame, sources: DataFrame, by: list[str], values: list[str], k: int, radius: float, finish: Finish) -> DataFrame:
    """Means of ``values`` over the k nearest sources within ``radius``; ``finish`` does the same for pairs in Spark."""
    queries, tiles = materialised(queries), _Tiles(sources, by)
    q, means = tiles.q, ", ".join(f"{v} double" for v in values)
    first = tiles.measured(tiles.own(queries), _unit_nearest_k(by, values, k, radius, False), f"reach double, whole boolean, {means}, have long")
    first = cut_lineage(first)
    done = first.where("whole AND have > 0").select(*q, *values)
    again, left = tiles.met(first.where("NOT whole").select(*q, "reach"))
    sid = next(f.dataType.simpleString() for f in tiles.extra if f.name == "sid")
    pairs = tiles.measured(again, _unit_nearest_k(by, values, k, radius, True), f"d double, sid {sid}, {means}").drop("edge")
    result = done.unionByName(finish(pairs.withColumn("complete", F.lit(True))).select(*q, *values))
    if left.isEmpty():
        return result
    far = _pyramid_pairs(left, tiles.sources, by, _Extent(tiles.sources, by), k, radius)
    return result.unionByName(finish(far).select(*q, *values))


def _weights_in_tiles(queries: DataFrame, sources: DataFrame | _Tiles, by: list[str], k: int, radius: float) -> DataFrame:
    """Weight ``have`` of the sources (by, sx, sy, w) within ``radius`` of every query, exact below ``k``; some queries without any are absent."""
    queries, tiles = materialised(queries), sources if isinstance(sources, _Tiles) else _Tiles(sources, by)
    q, count = tiles.q, _unit_weights(by, k, radius)
    first = cut_lineage(tiles.measured(tiles.own(queries), count, "have long"))
    settled = f"have >= {k} OR edge > {float(radius)!r}D"
    done = first.where(settled).select(*q, "have")
    again, left = tiles.met(first.where(f"NOT ({settled})").select(*q, F.lit(float(radius)).alias("reach")))
    result = done.unionByName(tiles.measured(again, count, "have long").groupBy(*q).agg(F.sum("have").alias("have")))
    if left.isEmpty():
        return result
    far = _pyramid_pairs(left, tiles.sources, by, _Extent(tiles.sources, by), k, radius)
    return result.unionByName(far.groupBy(*q).agg(F.sum("w").alias("have")))


def _keys(by: Sequence[str]) -> list[str]:
    """Internal names of the group columns, so that callers may use any column names."""
    return [f"__b{i}" for i in range(len(by))]


def _renamed(by: Sequence[str]) -> list[Column]:
    return [F.col(name).alias(key) for name, key in zip(by, _keys(by))]


def _query_points(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.select(
        *_renamed(by), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")
    ).distinct()


def _source_points(df: DataFrame, by: Sequence[str], x: str, y: str, k: int) -> DataFrame:
    return df.groupBy(
        *_renamed(by), F.col(x).cast("double").alias("sx"), F.col(y).cast("double").alias("sy")
    ).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("w"))


def _join_back(df: DataFrame, found: DataFrame, by: Sequence[str], x: str, y: str, columns: Sequence[str]) -> DataFrame:
    right = found.select(*_keys(by), F.col("qx").alias("__qx"), F.col("qy").alias("__qy"), *columns)
    condition = (df[x].cast("double") == right["__qx"]) & (df[y].cast("double") == right["__qy"])
    for name, key in zip(by, _keys(by)):
        condition = condition & (df[name] == right[key])
    return df.join(right, condition, "left").drop("__qx", "__qy", *_keys(by))


def nearest_distance(
    cells: DataFrame, sources: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y", out: str = "distance"
) -> DataFrame:
    """Distance from each row to the nearest source row (of the same ``by`` group); NULL if none."""
    cells, sources = materialised(cells), materialised(sources)
    found = _nearest_in_tiles(_query_points(cells, by, x, y), _source_points(sources, by, x, y, 1), _keys(by))
    return _join_back(cells, found.withColumnRenamed("__d", out), by, x, y, [out])


def within_distance(
    cells: DataFrame, sources: DataFrame, limit: float, by: Sequence[str] = (), x: str = "x", y: str = "y",
    distance: str = "distance", out: str = "within",
) -> DataFrame:
    """Nearest distance and a flag for distances up to ``limit``; FALSE where no source exists."""
    measured = nearest_distance(cells, sources, by, x, y, distance)
    return measured.withColumn(out, F.coalesce(F.col(distance) <= F.lit(limit), F.lit(False)))


def radius_density(
    cells: DataFrame, sources: DataFrame, radius: float, limit: int = 32, by: Sequence[str] = (),
    x: str = "x", y: str = "y", out: str = "density",
) -> DataFrame:
    """Share of the ``k = min(limit, number of sources)`` nearest sources that lie within ``radius``."""
    cells, sources = materialised(cells), materialised(sources)
    totals = sources.groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("__k"))
    found = _weights_in_tiles(_query_points(cells, by, x, y), _source_points(sources, by, x, y, limit), _keys(by), limit, radius)
    found = found.withColumnRenamed("have", "__have")
    return _share_of(_join_back(cells, found, by, x, y, ["__have"]), totals, by, out)


def _share_of(joined: DataFrame, totals: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Share of ``__have`` in ``__k``, of which ``totals`` has one for each group."""
    if by:
        keyed = totals.select(*[F.col(b).alias("__t_" + b) for b in by], "__k")
        condition = F.lit(True)
        for b in by:
            condition = condition & (joined[b] == keyed["__t_" + b])
        joined = joined.join(keyed, condition, "left").drop(*["__t_" + b for b in by])
    else:
        joined = joined.crossJoin(F.broadcast(totals))
    share = F.least(F.coalesce("__have", F.lit(0)), F.col("__k")) / F.col("__k")
    value = F.when(F.coalesce("__k", F.lit(0)) > 0, share).otherwise(F.lit(0.0))
    return joined.withColumn(out, value).drop("__have", "__k")


def _local_means(
    cells: DataFrame, queries: DataFrame, values: Sequence[str], k: int, radius: float, by: Sequence[str], cell_id: str, x: str, y: str, suffix: str
) -> DataFrame:
    """Means of ``knn_local_mean`` at every query; ``cells`` is read several times."""
    q, columns = [*_keys(by), "qx", "qy"], [f"__v{i}" for i in range(len(values))]
    at_point = Window.partitionBy(*_keys(by), "sx", "sy").orderBy("sid")
    # Rows beyond the k lowest ids of one coordinate can never be among the k nearest of any point.
    sources = (
        cells.select(
            *_renamed(by), F.col(x).cast("double").alias("sx"), F.col(y).cast("double").alias("sy"),
            F.col(cell_id).alias("sid"), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)],
        )
        .withColumn("__rn", F.row_number().over(at_point))
        .where(F.col("__rn") <= k)
        .drop("__rn")
        .withColumn("w", F.lit(1))
    )

    def finish(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy(*q).orderBy("d", "sid")
        best = pairs.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k)
        return best.groupBy(*q).agg(
            *[F.avg(v).alias(v) for v in columns],
            F.count(F.lit(1)).alias("have"), F.bool_or("complete").alias("complete"),
        )

    found = _means_in_tiles(queries, sources, _keys(by), columns, k, radius, finish)
    return found.withColumnsRenamed({c: v + suffix for c, v in zip(columns, values)})


def knn_local_mean(
    cells: DataFrame, values: Sequence[str], k: int = 24, radius: float = 100.0, by: Sequence[str] = (),
    cell_id: str = "cell_id", x: str = "x", y: str = "y", suffix: str = "_local",
) -> DataFrame:
    """Mean of ``values`` over the k nearest rows (itself included) within ``radius``; ties by id."""
    cells = materialised(cells)
    found = _local_means(cells, _query_points(cells, by, x, y), values, k, radius, by, cell_id, x, y, suffix)
    return _join_back(cells, found, by, x, y, [v + suffix for v in values])


def surroundings(
    cells: DataFrame, sources: DataFrame, others: DataFrame, values: Sequence[str], k: int, radius: float, limit: int,
    cell_id: str, x: str, y: str, names: tuple[str, str, str], suffix: str,
) -> DataFrame:
    """``knn_local_mean``, ``nearest_distance`` and ``radius_density`` to ``sources``, ``nearest_distance`` to ``others``, in one.

    The four are found for the same places and joined back once, where one after the other they would send every
    whole row four times. ``names`` are the columns for the distance, the density and the other distance.
    """
    cells, sources, others = materialised(cells), materialised(sources), materialised(others)
    near, density, other = names
    means = [v + suffix for v in values]
    queries = cut_lineage(_query_points(cells, (), x, y))
    tiles = _Tiles(_source_points(sources, (), x, y, limit), [])
    found = [
        _local_means(cells, queries, values, k, radius, (), cell_id, x, y, suffix),
        _nearest_in_tiles(queries, tiles, []).withColumnRenamed("__d", near),
        _weights_in_tiles(queries, tiles, [], limit, radius).withColumnRenamed("have", "__have"),
        _nearest_in_tiles(queries, _source_points(others, (), x, y, 1), []).withColumnRenamed("__d", other),
    ]
    columns = [*means, near, "__have", other]
    rows = found[0]
    for table in found[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    at = rows.groupBy("qx", "qy").agg(*[F.max(c).alias(c) for c in columns])
    totals = sources.agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("__k"))
    return _share_of(_join_back(cells, at, (), x, y, columns), totals, (), density)
