import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import scaling as sc


def otsu(values):
    lo, hi = values.min(), values.max()
    if hi <= lo:
        return hi
    hist, edges = np.histogram(values, bins=256, range=(lo, hi))
    p, c = hist / hist.sum(), (edges[:-1] + edges[1:]) / 2
    w, m = np.cumsum(p), np.cumsum(p * c)
    between = np.zeros(256)
    ok = np.cumsum(hist) < hist.sum()
    between[ok] = (m[-1] * w[ok] - m[ok]) ** 2 / (w[ok] * (1 - w[ok]))
    return c[np.argmax(between)]


def test_otsu_per_group(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 300, "v": np.concatenate([rng.normal(1, 0.2, 250), rng.normal(5, 0.4, 250), rng.gamma(2, 1, 300)])})
    got = sc.otsu_threshold(spark.createDataFrame(frame), "v", ["g"]).toPandas().set_index("g")["threshold"]
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(otsu(part.v.values), abs=1e-9)
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sc.otsu_threshold(constant, "v").first()["threshold"] == 3.0
    assert sc.otsu_threshold(constant.where("v > 9"), "v").first()["threshold"] == 0.5


def test_minmax_and_flat_range(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (4.0, 3.0)], "a double, b double")
    up = sc.minmax_scale(rows, "a", "u")
    down = sc.minmax_scale(up, "a", "d", higher_is_better=False)
    got = sc.minmax_scale(down, "b", "f").orderBy("a").collect()
    assert [(r["u"], r["d"], r["f"]) for r in got] == [(0.0, 1.0, 0.5), (1.0, 0.0, 0.5)]


def test_calibration_literal(spark):
    rows = spark.createDataFrame(list(zip([0.0, 0.1, 0.2, 1.0, 1.2, 2.0], [False] * 3 + [True] * 3)), "s double, p boolean")
    got = sc.calibrate_threshold(rows, "s", "p", 0.9).first()
    assert 0.1 < got["image_threshold"] <= 0.2 and got["true_positive_rate"] == 1.0 and got["false_positive_rate"] <= 1 / 3 + 1e-12
    one_class = sc.calibrate_threshold(rows.where("p"), "s", "p", 0.9).first()
    assert one_class["status"] == "NOT_COMPUTED" and one_class["image_threshold"] is None
    without = sc.calibrate_threshold(rows.where("NOT p"), "s", "p", 0.9).first()
    assert without["status"] == "NOT_COMPUTED" and without["image_threshold"] is None and without["false_positive_rate"] is None
    with pytest.raises(ValueError):
        sc.calibrate_threshold(rows, "s", "p", 0.4)


def test_threshold_maps_to_half_and_flat_scale_is_zero(spark):
    rows = spark.createDataFrame([(0.3,), (0.65,), (1.5,)], "v double")
    got = [r[0] for r in rows.select(sc.threshold_aligned(F.col("v"), F.lit(0.3))).collect()]
    assert got[0] == 0.5 and got[1] == pytest.approx(0.75) and got[2] == 1.0
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r["s"] for r in sc.robust_scale(flat, {"v": "s"}).collect()} == {0.0}


def test_vessel_call_falls_back_when_nearly_empty(spark):
    values = [(0.0, 0.0)] * 3000 + [(0.9, 0.0)] * 2
    rows = spark.createDataFrame(values, "e double, p double")
    got = sc.vessel_call(rows, "e", "p").agg(F.count_if("vessel_positive").alias("n"), F.max("vessel_threshold").alias("t")).first()
    assert got["t"] == 0.0 and got["n"] == 2


def test_few_markers_are_rejected(spark):
    with pytest.raises(ValueError):
        sc.marker_count_call(spark.range(1), ["a", "b", "c"], {"x": 1})


def test_target_call_keeps_a_target_spread_over_tasks(spark):
    """The threshold of a target was joined by a shuffle that sent all its cells to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 4000, 1, 8).selectExpr("id AS cell_id", "IF(id % 10 = 0, 'b', 'a') AS target", "id / 4000 AS raw")
        called = sc.target_call(rows).withColumn("task", F.spark_partition_id())
        assert called.where("target = 'a'").select("task").distinct().count() >= 4
        assert called.where("raw_threshold IS NULL").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
