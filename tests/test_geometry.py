import json
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from tessella.operators import geometry as ge
from tessella.sources import tables as st
from tessella.sources.quality import DataQualityError

SQUARE = [("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 1.0), ("a", 3, 0.0, 1.0), ("line", 0, 0.0, 0.0), ("line", 1, 1.0, 1.0)]


def test_unit_square_and_degenerate(spark):
    got = {r["k"]: r for r in ge.polygon_metrics(spark.createDataFrame(SQUARE, "k string, vertex_ix int, x double, y double"), ["k"]).collect()}
    assert got["a"]["area"] == 1.0 and got["a"]["perimeter"] == 4.0 and got["a"]["compactness"] == pytest.approx(math.pi / 4)
    assert (got["a"]["centroid_x"], got["a"]["centroid_y"]) == (0.5, 0.5)
    assert got["line"]["area"] is None and got["line"]["compactness"] is None


def test_long_ring_is_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(ge, "RUN", 7)
    n = 100
    t = 2 * np.pi * np.arange(n) / n
    frame = pd.DataFrame({"k": "c", "vertex_ix": np.arange(n), "x": np.cos(t), "y": np.sin(t)})
    got = ge.polygon_metrics(spark.createDataFrame(frame), ["k"]).first()
    assert got["vertices"] == n and got["area"] == pytest.approx(0.5 * n * math.sin(2 * math.pi / n))
    assert got["perimeter"] == pytest.approx(2 * n * math.sin(math.pi / n))


def test_centroid_of_small_polygons_far_away(spark):
    rows = [(k, i, 1e6 * k + x * 1e-3, 3e7 + y * 1e-3) for k in range(1, 6) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 2), (0, 2)])]
    got = ge.polygon_metrics(spark.createDataFrame(rows, "k int, vertex_ix int, x double, y double"), ["k"]).collect()
    assert all(abs(r.centroid_x - (1e6 * r.k + 2e-3)) < 1e-7 and abs(r.centroid_y - (3e7 + 1e-3)) < 1e-7 and r.area == pytest.approx(8e-6, rel=1e-4) for r in got) and len(got) == 5


def test_metrics_of_the_whole_table(spark):
    """Every polygon of the table, thin ones too, against exact fractions."""
    from checks.geometry import metrics, polygons

    rings = {}
    for r in polygons(spark, "/root/testdata/sf0.001").orderBy("cell_id", "vertex_ix").collect():
        rings.setdefault(r.cell_id, []).append((Fraction(float(r.vertex_x)), Fraction(float(r.vertex_y))))
    got = {r.cell_id: r for r in metrics(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(rings)
    thin = 0
    for key, ring in rings.items():
        edges = list(zip(ring, ring[1:] + ring[:1]))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)
        if len(ring) >= 3:
            assert got[key].area == pytest.approx(float(abs(area) / 2), abs=1e-9)
            thin += abs(area) / 2 <= 1
        if abs(area) / 2 > Fraction(1, 10**9):
            for axis, found in enumerate((got[key].centroid_x, got[key].centroid_y)):
                exact = float(sum((a[axis] + b[axis]) * (a[0] * b[1] - b[0] * a[1]) for a, b in edges) / (3 * area))
                assert found == pytest.approx(exact, rel=1e-9, abs=1e-4)
    assert thin > 0


GEOJSON = """{"features":[
 {"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]},"properties":{"name":"Tumor"}},
 {"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[20,5],[20,20],[5,20],[5,5]]],[[[30,30],[31,30],[31,31],[30,30]]]]},"properties":{"classification":{"name":"Stroma"}}},
 {"geometry":{"type":"Point","coordinates":[1,1]},"properties":{}},
 {"geometry":{"type":"Polygon","coordinates":[[[100,100],[101,100],[101,101],[100,100]]]},"properties":{}}]}"""


def test_geojson_and_point_in_polygon(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(GEOJSON)
    vertices = st.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert {(r["name"], r["polygon_ix"], r["ring_ix"]) for r in vertices.collect()} == {
        ("Tumor", 0, 0), ("Tumor", 0, 1), ("Stroma", 0, 0), ("Stroma", 1, 0), ("UNLABELLED", 0, 0)
    }
    spots = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 4.0, 4.5), (4, 8.0, 8.0), (5, 50.0, 50.0), (6, 10.0, 5.0), (7, 0.0, 0.0)]
    found = ge.point_in_polygon(spark.createDataFrame(spots, "id int, x double, y double"), vertices, "id").collect()
    assert {r["id"]: r["pathology_region"] for r in found} == {
        1: "Tumor", 2: "Stroma", 3: "Tumor", 4: "Stroma|Tumor", 5: "UNANNOTATED", 6: "Stroma|Tumor", 7: "Tumor"
    }
    areas = {r["name"]: r["area_px2"] for r in ge.areas_by_name(ge.annotation_areas(vertices, ["feature_ix"], 1.0, 1.0)).collect()}
    assert areas["Tumor"] == 96.0 and areas["Stroma"] == 225.5
    (tmp_path / "b.geojson").write_text('{"features":[{"geometry":{"type":"Point","coordinates":[1,1]},"properties":{}}]}')
    with pytest.raises(DataQualityError):
        st.read_geojson(spark, str(tmp_path / "b.geojson"))


def test_geojson_with_a_feature_on_each_line(spark, tmp_path):
    """The same vertices as from the whole file, with and without commas; other lines are passed over."""
    features = json.loads(GEOJSON)["features"]
    text = '{"type":"FeatureCollection","features":[\n' + ",\n".join("  " + json.dumps(f) for f in features) + "\n]}\n"
    (tmp_path / "a.geojson").write_text(GEOJSON)
    (tmp_path / "b.geojson").write_text(text)
    (tmp_path / "c.geojson").write_text("\n".join(json.dumps(f) for f in features))
    columns = ["name", "polygon_ix", "ring_ix", "vertex_ix", "x", "y"]
    want = sorted(tuple(r) for r in st.read_geojson(spark, str(tmp_path / "a.geojson")).select(*columns).collect())
    for name in "bc":
        got = st.read_geojson(spark, str(tmp_path / f"{name}.geojson"), lines=True)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and got.select("feature_ix").distinct().count() == 3
    (tmp_path / "d.geojson").write_text("[]")
    with pytest.raises(DataQualityError):
        st.read_geojson(spark, str(tmp_path / "d.geojson"), lines=True)


def holds(rings, x, y):
    """Even-odd rule over all edges of all rings, boundaries inside."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def vertex_rows(shapes):
    return [(f, "A", 0, r, i, float(x), float(y)) for f, rings in shapes.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


VERTEX = "feature_ix int, name string, polygon_ix int, ring_ix int, vertex_ix int, x double, y double"


def test_cover_equals_brute_force(spark):
    """Rings that cross themselves, share vertices with points, hold holes, are flat, tiny, far away or cross other rings."""
    rng = np.random.default_rng(4)
    shapes = {k: [[tuple(v) for v in rng.integers(-12, 13, (int(n), 2)).tolist()]] for k, n in enumerate(rng.integers(1, 14, 40))}
    shapes |= {50 + k: [[tuple(v) for v in (rng.normal(0, s, (n, 2)) + c).tolist()] for n in (9, 5)] for k, (s, c) in enumerate([(8, 0), (1e-4, 3), (1e4, 0), (2, 1e7)])}
    shapes[60] = [[(-10, -10), (10, -10), (10, 10), (-10, 10)], [(-5, -5), (5, -5), (5, 5), (-5, 5)]]
    spots = [(float(x), float(y)) for x, y in rng.integers(-14, 15, (500, 2))] + [tuple(v) for v in rng.normal(0, 6, (500, 2)).tolist()]
    spots += [tuple(v) for v in (rng.normal(0, 1e-4, (60, 2)) + 3).tolist()] + [tuple(v) for v in (rng.normal(0, 2, (60, 2)) + 1e7).tolist()]
    points = spark.createDataFrame([(i, *xy) for i, xy in enumerate(spots)], "id int, x double, y double")
    got = ge.polygon_hits(points, spark.createDataFrame(vertex_rows(shapes), VERTEX), ["id"], ["feature_ix"], ["feature_ix", "ring_ix"])
    want = {(i, f) for f, rings in shapes.items() for i, (x, y) in enumerate(spots) if holds(rings, x, y)}
    assert {(r["id"], r["feature_ix"]) for r in got.collect()} == want and len(want) > 5000


def test_cover_is_bounded_by_edges(spark):
    """A ring with very many edges and a comb among small squares: cells follow edges, not sizes."""
    ring = spark.range(100_000).selectExpr("0 AS feature_ix", "CAST(id AS INT) AS vertex_ix", "1e4 * cos(id * pi() / 5e4) AS x", "1e4 * sin(id * pi() / 5e4) AS y")
    comb = spark.range(2000).selectExpr("1 AS feature_ix", "CAST(id AS INT) AS vertex_ix", "CAST(id DIV 2 AS DOUBLE) AS x", "IF((id + 1) DIV 2 % 2 = 0, 0D, 9000D) AS y")
    squares = spark.range(4000).selectExpr("CAST(2 + id DIV 4 AS INT) AS feature_ix", "CAST(id % 4 AS INT) AS vertex_ix",
                                           "CAST(id DIV 4 AS DOUBLE) * 7 + IF(id % 4 IN (1, 2), 3, 0) AS x", "CAST(id DIV 4 AS DOUBLE) + IF(id % 4 > 1, 3, 0) AS y")
    cover = ge.polygon_cover(ring.unionByName(comb).unionByName(squares), ["feature_ix"], ["feature_ix"])
    counts = {r["feature_ix"]: r["n"] for r in cover.groupBy("feature_ix").count().withColumnRenamed("count", "n").collect()}
    assert counts[0] <= 2 * ge.PLACED * 100_000 and counts[1] <= 2 * ge.PLACED * 2000 and max(counts[k] for k in range(2, 1002)) <= 2 * ge.PLACED * 4
    spots = spark.createDataFrame([(0, 0.0, 0.0), (1, 9000.0, 5000.0), (2, 7001.0, 1001.0), (3, 10.5, 9000.5), (4, 9998.0, 0.5), (5, 1e4, 1e4)], "id int, x double, y double")
    got = {(r["id"], r["feature_ix"]) for r in ge.polygon_hits(spots, ring.unionByName(squares), ["id"], ["feature_ix"], ["feature_ix"]).collect()}
    assert {h for h in got if h[1] == 0} == {(0, 0), (2, 0), (3, 0), (4, 0)} and (2, 1002) not in got and (0, 2) in got


@pytest.mark.parametrize("run", [4096, 3, 1])
def test_moments_of_runs_merge(spark, monkeypatch, run):
    """Rings cut into runs give the moments of whole rings, also far from the origin."""
    monkeypatch.setattr(ge, "RUN", run)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, (n, far) in enumerate([(3, 0), (4, 1e6), (10, 50), (25, -1e7), (1, 5), (2, 5), (7, 0)]):
        xy = rng.integers(0, 40, (n, 2)) / 4 + far
        rows += [(k, i, *map(float, v)) for i, v in enumerate(xy)]
        ring = [(Fraction(x), Fraction(y)) for x, y in xy.tolist()]
        edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
        a = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in edges)
        centre = [sum((p[c] + q[c]) * (p[0] * q[1] - q[0] * p[1]) for p, q in edges) / (3 * a) if a else sum(p[c] for p in ring) / n for c in (0, 1)]
        want[k] = (n, float(abs(a) / 2) if n > 2 else None, *map(float, centre))
    got = ge.polygon_metrics(spark.createDataFrame(rows, "k int, vertex_ix int, x double, y double"), ["k"]).collect()
    assert len(got) == len(want)
    for r in got:
        n, area, x, y = want[r["k"]]
        assert r["vertices"] == n and (r["area"] is None if area is None else abs(r["area"] - area) <= 1e-9 * max(1, area))
        assert abs(r["centroid_x"] - x) < 1e-6 and abs(r["centroid_y"] - y) < 1e-6


def test_alignment_literal(spark):
    ring = spark.createDataFrame([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], "x double, y double")
    cells = spark.createDataFrame([(0.0, 0.0), (100.0, 100.0)], "x double, y double")
    identity = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    got = ge.alignment_accept(ge.alignment_candidates(ring, cells, identity, [1.0, 0.5])).first()
    assert got["accepted"] and got["candidate"] == "identity_scale_1"
    close = ge.alignment_accept(ge.alignment_candidates(ring, cells, identity, [1.0, 1.001])).first()
    assert not close["accepted"] and close["status"] == "NOT_COMPUTED"
    with pytest.raises(ValueError):
        ge.affine_transform(ring, [[1, 0, 0], [0, 1, 0], [0, 1, 1]])


def test_later_feature_wins_and_hole_clears(spark):
    box = lambda f, n, r, a, b: [(f, n, 0, r, i, float(x), float(y)) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    rows = box(0, "A", 0, 0, 9) + box(1, "B", 0, 3, 12) + box(1, "B", 1, 5, 6)
    vertices = spark.createDataFrame(rows, "f int, name string, polygon_ix int, ring_ix int, vertex_ix int, x double, y double")
    grid = spark.createDataFrame([(1, 1), (4, 4), (5, 5), (11, 11), (20, 20)], "row int, col int")
    got = {r["row"]: r["label"] for r in ge.label_grid(grid, vertices, "f").collect()}
    assert got == {1: "A", 4: "B", 5: "", 11: "B", 20: ""}


def test_small_grid_is_rejected(spark):
    with pytest.raises(ValueError):
        ge.rasterise_cells(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), 4)


def test_jitter_draws_are_made_by_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella import session

    cells = spark.range(0, 300, 1, 1).selectExpr("id AS cell_id", "CAST(id % 16 AS INT) AS row", "CAST(id * 7 % 16 AS INT) AS col")
    grid = spark.range(256).selectExpr("CAST(id DIV 16 AS INT) AS row", "CAST(id % 16 AS INT) AS col", "id / 256 AS target")
    one = [tuple(r) for r in ge.jitter_resample(cells, grid, "target", 0.45, 16, "cell_id").collect()]
    dealt = []
    kept = ge.deal
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    monkeypatch.setattr(ge, "deal", lambda df, copies: dealt.append(kept(df, copies)) or dealt[-1])
    assert [tuple(r) for r in ge.jitter_resample(cells, grid, "target", 0.45, 16, "cell_id").collect()] == one
    assert dealt[0].withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8
