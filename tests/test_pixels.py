import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import components as co
from tessella.operators import pixels as px
from tessella.sources.quality import DataQualityError


def image(spark, array, name="v", **extra):
    h, w = array.shape[:2]
    rows, cols = np.mgrid[0:h, 0:w]
    frame = pd.DataFrame({"row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32")})
    if array.ndim == 2:
        frame[name] = array.ravel()
    else:
        for i, n in enumerate("rgb"):
            frame[n] = array[..., i].ravel().astype(float)
    for k, v in extra.items():
        frame[k] = v
    return spark.createDataFrame(frame)


def label(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        out[start] = n
        while stack:
            r, c = stack.pop()
            for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    stack.append((a, b))
    return out


@pytest.mark.parametrize("density", [0.3, 0.6])
def test_components_equal_flood_fill(spark, density):
    mask = np.random.default_rng(8).uniform(size=(40, 30)) < density
    got = co.pixel_components(image(spark, mask.astype(int)).where("v = 1")).toPandas()
    want = label(mask)
    pairs = {(c, want[r, k]) for r, k, c in zip(got.row, got.col, got.component)}
    assert len(got) == mask.sum() and len(pairs) == want.max() == got.component.nunique()


def test_spiral_is_one_component(spark):
    n = 25
    mask = np.zeros((n, n), bool)
    mask[::2, :] = True
    for i in range(1, n, 2):
        mask[i, -1 if (i // 2) % 2 == 0 else 0] = True
    assert co.pixel_components(image(spark, mask.astype(int)).where("v = 1")).select("component").distinct().count() == 1


def test_star_and_chain_graphs(spark):
    nodes = spark.range(0, 400).withColumnRenamed("id", "node")
    star = spark.range(1, 200).selectExpr("CAST(199 - id AS BIGINT) AS a", "199L AS b")
    chain = spark.range(200, 399).selectExpr("id AS a", "id + 1 AS b")
    got = co.connected_components(nodes, star.union(chain)).toPandas()
    assert set(got[got.node < 200].component) == {0} and set(got[got.node >= 200].component) == {200}


def test_mask_literal_and_distance(spark):
    array = np.zeros((9, 9))
    array[4, 3:6] = 5
    pixels = image(spark, array)
    mask, diagnostics = px.structural_mask(pixels, F.col("v") > 1, 2.0, 8.0, 0.0)
    row = diagnostics.first()
    assert (row["raw_components"], row["retained_components"]) == (1, 1)
    d = px.mask_distance(pixels, mask, 2.0).toPandas().set_index(["row", "col"])["distance"]
    assert d[(4, 4)] == 0 and d[(0, 4)] == 8
    bands = px.distance_band_summary(px.mask_distance(pixels, mask, 2.0), "distance", ["v"])
    assert bands.agg(F.sum("pixels")).first()[0] == 81 and bands.count() == 5
    nothing = px.mask_distance(pixels, mask.where("row > 99"), 2.0)
    assert nothing.where("distance IS NOT NULL").isEmpty()


def closing(mask, element):
    def hits(m, r, c):
        return 0 <= r < m.shape[0] and 0 <= c < m.shape[1] and m[r, c]

    grown = np.array([[any(hits(mask, r - a, c - b) for a, b in element) for c in range(mask.shape[1])] for r in range(mask.shape[0])])
    return np.array([[all(hits(grown, r + a, c + b) for a, b in element) for c in range(mask.shape[1])] for r in range(mask.shape[0])])


def test_closing_equals_numpy(spark):
    mask = np.random.default_rng(6).uniform(size=(18, 14)) < 0.25
    sized = image(spark, mask.astype(int)).where("v = 1").selectExpr("row", "col", "18 AS height", "14 AS width")
    closed = {(r["row"], r["col"]) for r in px.mask_close(sized, 2).collect()}
    assert closed == set(zip(*[axis.tolist() for axis in np.nonzero(closing(mask, px.disc(2)))]))


def test_window_mean_and_edges(spark):
    pixels = image(spark, np.arange(25.0).reshape(5, 5))
    cells = spark.createDataFrame([(1, 2, 2), (2, 0, 0)], "cell_id int, row int, col int")
    got = {r["cell_id"]: r["local_mean"] for r in px.window_mean_at_points(cells, pixels, "v").collect()}
    assert got[1] == 12.0 and got[2] == pytest.approx((4 * 0 + 2 * 1 + 2 * 5 + 6) / 9)
    with pytest.raises(DataQualityError):
        px.assert_inside(spark.createDataFrame([(7, 1)], "row int, col int"), pixels)


def test_gaussian_keeps_constant_and_reflects(spark):
    flat = px.gaussian_signal(image(spark, np.full((12, 15), 3.0)), "v", 1.5).toPandas()
    assert len(flat) == 180 and np.allclose(flat.v, 3.0)


def test_tissue_mask_equals_numpy(spark):
    array = np.full((60, 60, 3), 240, dtype=int) + np.random.default_rng(2).integers(0, 4, (60, 60, 3))
    array[20:40, 15:45] = (120, 60, 130)
    array[50, 50] = (0, 0, 0)  # a speck that opening removes
    got = px.tissue_mask_colour(image(spark, array)).toPandas()
    corners = {(20, 15), (20, 44), (39, 15), (39, 44)}  # rounded off by the cross-shaped opening
    assert set(zip(got.row, got.col)) == {(r, c) for r in range(20, 40) for c in range(15, 45)} - corners


def brute_tissue(array, there):
    """Mask of one image; ``there`` marks the pixels that exist."""
    h, w = there.shape
    edge = max(4, min(h, w) // 50)
    strips = [there & (np.minimum(np.arange(h), h - 1 - np.arange(h)) < edge)[:, None], there & (np.minimum(np.arange(w), w - 1 - np.arange(w)) < edge)[None, :]]
    median = np.median(np.concatenate([array[s] for s in strips]), axis=0)
    far = np.sqrt(((array - median) ** 2).sum(-1))
    mask = there & (far > max(12.0, np.quantile(np.concatenate([far[s] for s in strips]), 0.95) + 4))
    for grow in (True, True, False, False, False, True):
        padded = np.pad(mask, 1)  # outside counts as no tissue
        moved = np.stack([padded[1 + r : 1 + r + h, 1 + c : 1 + c + w] for r, c in px.CROSS])
        mask = moved.any(0) if grow else moved.all(0)
    found, left = set(), set(zip(*(x.tolist() for x in np.nonzero(mask))))
    while left:
        part, edge_of = set(), [left.pop()]
        while edge_of:
            r, c = edge_of.pop()
            part.add((r, c))
            for near in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if near in left:
                    left.remove(near)
                    edge_of.append(near)
        if len(part) >= max(64, int(0.00005 * h * w)):
            found |= part
    return found


def test_tissue_mask_query_is_whole(spark, tmp_path):
    """All columns of two images, by brute force on unaltered colours."""
    from checks.pixels import tissue_mask

    rng = np.random.default_rng(6)
    e = rng.uniform(-0.1, 0.1, (240, 64))
    e[40:90, 12:64] += 0.5
    e[150:190, 0:40] -= 0.4
    pd.DataFrame({"vec_id": np.arange(240), "label": np.arange(240) // 120, "embedding": list(e)}).to_parquet(tmp_path / "embeddings.parquet")
    got = {(r.image, r.row, r.col) for r in tissue_mask(spark, str(tmp_path)).collect()}
    values = np.clip(np.floor((e + 0.6) / 1.2 * 255), 0, 255)
    array = np.concatenate([values, values[:, 63:], values[:, 63:]], 1).reshape(240, 22, 3)
    expected = set()
    for k in (0, 1):
        part = slice(0, 120) if k == 0 else slice(0, 240)
        there = np.broadcast_to((np.arange(240) // 120 == k)[part, None], (120 * (k + 1), 22))
        expected |= {(k, r, c) for r, c in brute_tissue(array[part], there)}
    assert got == expected and {k for k, *_ in got} == {0, 1}
    assert any(c > 15 for *_, c in got) and any(c < 5 for *_, c in got)


def test_region_morphology_has_no_made_up_candidates(spark):
    from tessella.plans.jobs import region_morphology

    array = np.full((60, 60, 3), 240)
    array[20:40, 15:45] = (120, 60, 130)
    ring = [("Tumor", 0, 0, k, x, y) for k, (x, y) in enumerate([(10.0, 10.0), (50.0, 10.0), (50.0, 50.0), (10.0, 50.0)])]
    vertices = spark.createDataFrame([(1, *r) for r in ring], "feature int, name string, polygon_ix int, ring_ix int, vertex_ix int, x double, y double")
    rows = region_morphology(image(spark, array), vertices, "feature", 1.0)["regions"].collect()
    assert sum(r.tissue_pixels for r in rows) == 596
    assert all(r.candidate_pixels is None and r.candidate_fraction is None and r.candidate_status == "NOT_COMPUTED" for r in rows)


def test_perfusion_literal(spark):
    array = np.zeros((80, 80, 3))
    array[:, 10:12, 1] = 255
    array[..., 2] = np.clip(220 - 8 * np.abs(np.arange(80) - 10), 0, None)[None, :]
    from tessella.plans.jobs import perfusion

    out = perfusion(image(spark, array, image="a"), 1.0, 80, [0.0, 0.2])
    rows = out["settings"].collect()
    assert all(r["distance_spearman"] < 0 and r["near_to_far"] is None or r["near_to_far"] > 1 for r in rows) and len(rows) == 2
    assert out["profiles"].count() == 10 and out["robustness"].first()["all_negative"]


def test_brown_literal(spark):
    array = np.full((10, 10, 3), 255)
    array[:, :5] = (140, 90, 45)
    got = px.stain_features(image(spark, array), F.lit(True)).first()
    assert got["brown_q90"] > 0 and got["mask_fraction"] == 1.0


def test_panel_distance_of_a_tall_image(spark):
    """Squares of sizes beyond 46,340 do not fit an integer."""
    rows = spark.createDataFrame([(0, 0, 200, 0, 0), (69_999, 0, 0, 200, 0)], "row int, col int, r int, g int, b int").withColumn("image", F.lit("a"))
    got = px.panel_distance_features(rows, ["image"]).first()
    assert got["distance_mean"] == pytest.approx(69_999 / (70_000**2 + 1) ** 0.5)
    far = rows.select("image", (F.col("row") * 30_000).alias("row"), "col", F.lit(1.0).alias("d"), F.lit(1.0).alias("s"))
    assert px.near_far_ratio(far, "d", "s", 64, ["image"], 5).first()["near_mean"] == 1.0
