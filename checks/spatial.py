"""Neighbour joins over ``events``: id = event_id, x = user_id, y = value, sources = errors."""

from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from tessella.operators import neighbours as nb


def points(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("cell_id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"),
        "event_type", (F.col("user_id") % 10).alias("fov"),
    )


def sources(cells):
    return cells.where(F.col("event_type") == "error")


P = """WITH p AS (SELECT event_id AS cell_id, CAST(user_id AS DOUBLE) AS x, value AS y, event_type, user_id % 10 AS fov FROM events),
q AS (SELECT DISTINCT x, y, fov FROM p), s AS (SELECT DISTINCT x, y, fov FROM p WHERE event_type = 'error')"""


@register("nearest_distance", P + """, d AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM (SELECT DISTINCT x, y FROM q) q, s GROUP BY ALL)
SELECT cell_id, round(d, 6) AS distance FROM p JOIN d USING (x, y)""")
def nearest(spark, folder):
    cells = points(spark, folder)
    return rounded(nb.nearest_distance(cells, sources(cells)), "distance").select("cell_id", "distance")


@register("nearest_distance_within", P + """, d AS (SELECT q.fov, q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM q LEFT JOIN s ON q.fov = s.fov AND s.fov < 9 GROUP BY ALL)
SELECT cell_id, fov, round(d, 6) AS distance FROM p JOIN d USING (fov, x, y)""")
def nearest_within(spark, folder):
    cells = points(spark, folder)
    found = nb.nearest_distance(cells, sources(cells).where("fov < 9"), by=["fov"])
    return rounded(found, "distance").select("cell_id", "fov", "distance")


@register("radius_density", P + """, n AS (SELECT x, y, count(*) AS n FROM p WHERE event_type = 'error' GROUP BY ALL),
k AS (SELECT least(32, sum(n)) AS k FROM n),
d AS (SELECT q.x, q.y, sum(CASE WHEN sqrt((q.x-n.x)*(q.x-n.x)+(q.y-n.y)*(q.y-n.y)) <= 6 THEN n.n ELSE 0 END) AS c FROM (SELECT DISTINCT x, y FROM q) q, n GROUP BY ALL)
SELECT cell_id, round(CAST(least(c, k) AS DOUBLE) / k, 6) AS density FROM p JOIN d USING (x, y), k""")
def density(spark, folder):
    cells = points(spark, folder)
    return rounded(nb.radius_density(cells, sources(cells), 6.0), "density").select("cell_id", "density")


@register("knn_local_mean", P + """, c AS (SELECT a.cell_id, b.cell_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, ln(1 + b.y) AS score FROM p a, p b WHERE abs(a.x-b.x) <= 12 AND abs(a.y-b.y) <= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, other) AS rn FROM c WHERE d <= 12)
SELECT cell_id, round(avg(score), 6) AS score_local FROM r WHERE rn <= 24 GROUP BY cell_id""")
def local_mean(spark, folder):
    cells = points(spark, folder).withColumn("score", F.log1p("y"))
    return rounded(nb.knn_local_mean(cells, ["score"], 24, 12.0), "score_local").select("cell_id", "score_local")


@register("within_distance", P + """, d AS (SELECT q.x, q.y, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM (SELECT DISTINCT x, y FROM q) q, s GROUP BY ALL)
SELECT event_type, CAST(sum(CAST(d <= 2 AS INT)) AS BIGINT) AS near, count(*) AS cells FROM p JOIN d USING (x, y) GROUP BY event_type""")
def within(spark, folder):
    cells = points(spark, folder)
    flagged = nb.within_distance(cells, sources(cells), 2.0)
    return flagged.groupBy("event_type").agg(F.count_if("within").alias("near"), F.count("*").alias("cells"))
