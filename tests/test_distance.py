"""Distance transform on grids against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import distance as di


def brute(rows, mask):
    out = []
    for k, r, c in rows:
        near = [(r - a) ** 2 + (c - b) ** 2 for g, a, b in mask if (g == k or (g is None and k is None)) and a is not None]
        out.append(None if r is None or c is None or not near else float(np.sqrt(min(near))))
    return out


@pytest.mark.parametrize("block", [64, 4])
def test_grid_nearest_equals_brute_force(spark, monkeypatch, block):
    """Dense and sparse images, masks off the positions, repeated rows, null groups, images without a mask."""
    monkeypatch.setattr(di, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(k, r, c) for k in ("a", "b") for r in range(25) for c in range(40)] + [(None, int(r), int(c)) for r, c in rng.integers(-500, 500, (150, 2))]
    rows += [("c", 3, 4), ("d", 0, 0), ("d", 0, 0)]
    mask = [("a", int(r), int(c)) for r, c in rng.integers(0, 25, (12, 2))] + [("b", 24, 39)] + [(None, int(r), int(c)) for r, c in rng.integers(-800, 800, (40, 2))]
    mask += [("d", -3, 4), ("d", -3, 4), ("e", 0, 0)]
    frame = spark.createDataFrame(pd.DataFrame([(i, *r, "x") for i, r in enumerate(rows)], columns=["id", "k", "row", "col", "text"]))
    marks = spark.createDataFrame(pd.DataFrame(mask, columns=["k", "row", "col"]))
    got = {r["id"]: r["d"] for r in di.grid_nearest(frame.repartition(3), marks, ["k"], out="d", unit=2.0).collect()}
    want = brute(rows, mask)
    assert len(got) == len(rows) and all(got[i] == (None if w is None else w * 2) for i, w in enumerate(want))


def test_grid_nearest_without_groups(spark):
    frame = spark.range(300).selectExpr("CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "IF(id = 7, NULL, id) AS id")
    got = di.grid_nearest(frame, frame.where("id % 97 = 0"))
    want = brute([(None, i // 20, i % 20) for i in range(300)], [(None, i // 20, i % 20) for i in range(0, 300, 97)])
    assert [r["distance"] for r in got.orderBy("row", "col").collect()] == want
    assert di.grid_nearest(frame, frame.where("false")).where(F.col("distance").isNotNull()).count() == 0
    assert di.grid_nearest(frame.where("false"), frame).count() == 0


@pytest.mark.parametrize("strip", [1, 7, 100])
def test_strips_do_not_change_distances(spark, monkeypatch, strip):
    """Masks only above, only below, far beside and with wide gaps; positions in strips without a mask, null groups, blocks of few columns."""
    monkeypatch.setattr(di, "STRIP", strip)
    monkeypatch.setattr(di, "BLOCK", 16)
    rng = np.random.default_rng(strip)
    rows = [(k, int(r), int(c)) for k in ("up", "down", "side", None) for r, c in zip(rng.integers(-900, 900, 120), rng.integers(-30, 60, 120))]
    mask = [("up", int(r), int(c)) for r, c in zip(rng.integers(-1000, -700, 60), rng.integers(-30, 60, 60))]
    mask += [("down", int(r), int(c)) for r, c in zip(rng.integers(700, 1000, 3), rng.integers(-300, 60, 3))]
    mask += [("side", int(r), 5000 + int(c)) for r, c in zip(rng.integers(-900, 900, 40), rng.integers(0, 900, 40))] + [("side", 10, -20)]
    mask += [(None, int(r), int(c)) for r, c in zip(rng.integers(-3, 3, 30), rng.integers(-30, 60, 30))] + [(None, 800, 2)]
    frame = spark.createDataFrame(pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["id", "k", "row", "col"]))
    marks = spark.createDataFrame(pd.DataFrame(mask, columns=["k", "row", "col"]))
    got = {r["id"]: r["distance"] for r in di.grid_nearest(frame, marks, ["k"]).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, mask)


def test_a_tall_image_is_not_one_unit(spark):
    """The rows of one image of few columns go to several tasks, and strips far from the mask get few mask positions."""
    frame = spark.range(8 * 40_000).selectExpr("CAST(id DIV 8 AS INT) AS row", "CAST(id % 8 AS INT) AS col")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = di.grid_nearest(frame, frame.where("row < 9000")).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert found.groupby("task").size().max() < len(found) * 0.75
    assert (found["distance"] == np.maximum(found["row"] - 8999, 0)).all() and len(found) == 320_000
    # What the strips get from outside: a few rows of the mask each.
    strips = [(0, s, 0, 7) for s in range(10)]
    spots = spark.createDataFrame(strips, "__block long, __strip long, __first long, __last long")
    sent = frame.where("row < 9000").selectExpr("CAST(row AS BIGINT) AS __row", "CAST(col AS BIGINT) AS __col", "0L AS __block", f"CAST(row DIV {di.STRIP} AS BIGINT) AS __strip")
    sizes = {r["__strip"]: r["count"] for r in di._from_outside(sent, spots, []).groupBy("__strip").count().collect()}
    assert set(sizes) == set(range(10)) and all(sizes[s] <= 8 * 64 * 2 for s in range(3)) and all(sizes[s] <= 8 * 3 for s in range(4, 10))


def test_lower_envelope_is_linear_in_rows():
    """A tall column with one mask row far away, and one with a mask in every row."""
    rows = np.arange(20_000)
    got = di.nearest_squares(np.array([0]), np.array([5]), rows, np.zeros(20_000, np.int64))
    assert (got == rows.astype(float) ** 2 + 25).all()
    rng = np.random.default_rng(1)
    col = rng.integers(0, 300, 20_000)
    got = di.nearest_squares(rows, col, rows[:2000], np.full(2000, 100))
    want = [((rows[max(0, r - 300) : r + 300] - r) ** 2 + (col[max(0, r - 300) : r + 300] - 100) ** 2).min() for r in range(2000)]
    assert got.tolist() == want
