import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import neighbours as nb


def cloud(kind, n=600, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        xy = rng.uniform(0, 100, (n, 2))
    elif kind == "dense spot":  # a third of the points in a tiny spot at distinct coordinates
        xy = np.vstack([rng.uniform(0, 1000, (n - n // 3, 2)), 700 + rng.uniform(0, 1e-3, (n // 3, 2))])
    elif kind == "one coordinate":  # a third of the points share one coordinate
        xy = np.vstack([rng.uniform(0, 50, (n - n // 3, 2)), np.full((n // 3, 2), 20.0)])
    else:  # far outlier
        xy = np.vstack([rng.uniform(0, 1, (n - 1, 2)), [[1e6, -1e6]]])
    return pd.DataFrame({"cell_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "s": rng.uniform(size=n), "src": rng.uniform(size=n) < 0.2, "fov": np.arange(n) % 3})


KINDS = ["uniform", "dense spot", "one coordinate", "outlier"]


def distances(a, b):
    return np.sqrt(((a[["x", "y"]].values[:, None, :] - b[["x", "y"]].values[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("kind,hot", [*[(k, 64) for k in KINDS], ("dense spot", 0), ("uniform", 0)])
def test_nearest_equals_brute_force(spark, kind, hot, monkeypatch):
    monkeypatch.setattr(nb, "HOT_FACTOR", hot)  # 0 sends every query through the pyramid
    frame = cloud(kind)
    cells = spark.createDataFrame(frame)
    got = nb.nearest_distance(cells, cells.where("src")).toPandas().set_index("cell_id")["distance"].sort_index()
    want = distances(frame, frame[frame.src]).min(axis=1)
    np.testing.assert_allclose(got.values, want, rtol=1e-12, atol=1e-9)


def test_nearest_within_groups_and_without_sources(spark):
    frame = cloud("uniform", 300)
    cells = spark.createDataFrame(frame)
    got = nb.nearest_distance(cells, cells.where("src AND fov < 2"), by=["fov"]).toPandas().set_index("cell_id")["distance"]
    for fov in (0, 1):
        part = frame[frame.fov == fov]
        want = distances(part, part[part.src]).min(axis=1)
        np.testing.assert_allclose(got[part.cell_id].values, want)
    assert got[frame.cell_id[frame.fov == 2]].isna().all()
    none = nb.nearest_distance(cells, cells.where("s > 5")).toPandas()
    assert none.distance.isna().all() and len(none) == 300


@pytest.mark.parametrize("kind,hot", [("dense spot", 64), ("one coordinate", 64), ("outlier", 0), ("dense spot", 0)])
def test_knn_mean_equals_brute_force(spark, kind, hot, monkeypatch):
    monkeypatch.setattr(nb, "HOT_FACTOR", hot)
    frame = cloud(kind, 300)
    got = nb.knn_local_mean(spark.createDataFrame(frame), ["s"], 10, 8.0).toPandas().set_index("cell_id")["s_local"].sort_index()
    d = distances(frame, frame)
    want = []
    for i in range(len(frame)):
        best = sorted(range(len(frame)), key=lambda j: (d[i, j], j))[:10]
        want.append(np.mean([frame.s[j] for j in best if d[i, j] <= 8.0]))
    np.testing.assert_allclose(got.values, want, atol=1e-9)


@pytest.mark.parametrize("kind", ["dense spot", "one coordinate"])
def test_density_equals_brute_force(spark, kind):
    frame = cloud(kind, 400)
    cells = spark.createDataFrame(frame)
    got = nb.radius_density(cells, cells.where("src"), 5.0).toPandas().set_index("cell_id")["density"].sort_index()
    k = min(32, int(frame.src.sum()))
    within = (distances(frame, frame[frame.src]) <= 5.0).sum(axis=1)
    np.testing.assert_allclose(got.values, np.minimum(within, k) / k)
    assert nb.radius_density(cells, cells.where("s > 5"), 5.0).agg(F.max("density")).first()[0] == 0.0


def test_result_does_not_depend_on_partitioning(spark):
    frame = cloud("uniform", 200)
    one = spark.createDataFrame(frame).repartition(1)
    many = spark.createDataFrame(frame.sample(frac=1, random_state=5)).repartition(17)
    a, b = (nb.within_distance(c, c.where("src"), 10.0).select("cell_id", "distance", "within").toPandas().sort_values("cell_id").reset_index(drop=True) for c in (one, many))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("kind,meets", [*[(k, 16) for k in KINDS], ("uniform", 0), ("outlier", 0)])
def test_nearest_over_small_tiles_equals_brute_force(spark, kind, meets, monkeypatch):
    """Many tiles, units and circles that leave their tile; ``meets`` 0 sends those down the pyramid."""
    for name, value in {"TILE": 32, "UNIT": 8, "MEETS": meets}.items():
        monkeypatch.setattr(nb, name, value)
    frame = cloud(kind, 1500)
    cells = spark.createDataFrame(frame)
    got = nb.nearest_distance(cells, cells.where("src AND fov < 2"), by=["fov"]).toPandas().set_index("cell_id")["distance"].sort_index()
    for fov in (0, 1):
        part = frame[frame.fov == fov]
        np.testing.assert_allclose(got[part.cell_id].values, distances(part, part[part.src]).min(axis=1), rtol=1e-12, atol=1e-9)
    assert got[frame.cell_id[frame.fov == 2]].isna().all()


def test_nearest_asks_each_query_once(spark, monkeypatch):
    """The pairs joined before any distance is known were nine cells a query; now one row a query reaches a tile."""
    asked = []
    kept = nb._unit_distances
    monkeypatch.setattr(nb, "_unit_distances", lambda by: asked.append(by) or kept(by))
    frame = cloud("uniform", 300)
    cells = spark.createDataFrame(frame)
    nb.nearest_distance(cells, cells.where("src")).count()
    assert len(asked) == 2
    squares = nb.nearest_squares(frame.x.values, frame.y.values, frame.x.values + 0.3, frame.y.values, 4)
    moved = frame.assign(x=frame.x + 0.3)
    np.testing.assert_allclose(np.sqrt(squares), distances(moved, frame).min(axis=1))


@pytest.mark.parametrize("kind,meets", [*[(k, 16) for k in KINDS], ("uniform", 0), ("one coordinate", 0)])
def test_knn_mean_over_small_tiles_equals_brute_force(spark, kind, meets, monkeypatch):
    for name, value in {"TILE": 32, "UNIT": 8, "MEETS": meets}.items():
        monkeypatch.setattr(nb, name, value)
    frame = cloud(kind, 400).round({"x": 0, "y": 0}) if kind == "uniform" else cloud(kind, 400)
    frame["name"] = "c" + frame.cell_id.astype(str)
    got = nb.knn_local_mean(spark.createDataFrame(frame), ["s", "fov"], 10, 8.0, cell_id="name").toPandas().set_index("cell_id")[["s_local", "fov_local"]].sort_index()
    d = distances(frame, frame)
    want = []
    for i in range(len(frame)):
        best = [j for j in sorted(range(len(frame)), key=lambda j: (d[i, j], frame["name"][j])) if d[i, j] <= 8.0][:10]
        want.append([np.mean(frame.s[best]), np.mean(frame.fov[best])])
    np.testing.assert_allclose(got.values, want, atol=1e-9)


@pytest.mark.parametrize("kind,meets", [*[(k, 16) for k in KINDS], ("uniform", 0), ("outlier", 0)])
def test_density_over_small_tiles_equals_brute_force(spark, kind, meets, monkeypatch):
    """Counts come from tiles; the pairs of nine cells a query, joined before anything is counted, are gone."""
    asked = []
    kept = nb._unit_weights
    monkeypatch.setattr(nb, "_unit_weights", lambda *args: asked.append(args) or kept(*args))
    for name, value in {"TILE": 32, "UNIT": 8, "MEETS": meets}.items():
        monkeypatch.setattr(nb, name, value)
    frame = cloud(kind, 800)
    cells = spark.createDataFrame(frame)
    got = nb.radius_density(cells, cells.where("src AND fov < 2"), 5.0, 12, by=["fov"]).toPandas().set_index("cell_id")["density"].sort_index()
    for fov in (0, 1):
        part = frame[frame.fov == fov]
        number = min(12, int(part.src.sum()))
        within = (distances(part, part[part.src]) <= 5.0).sum(axis=1)
        np.testing.assert_allclose(got[part.cell_id].values, np.minimum(within, number) / number)
    assert (got[frame.cell_id[frame.fov == 2]] == 0.0).all()
    assert asked
