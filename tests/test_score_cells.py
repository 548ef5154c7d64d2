"""Places are searched in boxes of whole leaves and joined back once; few groups are not ordered whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import checks.sources as queries
from tessella.operators import neighbours as nb
from tessella.operators import order

SMALL = "/root/testdata/sf0.001"


def test_no_leaf_spans_two_strips():
    rng = np.random.default_rng(5)
    x, y = rng.random(4000), rng.random(4000)
    packed, starts = nb._packed(x, y, 32)
    assert sorted(packed) == list(range(4000)) and len(starts) == 125
    heights = np.maximum.reduceat(y[packed], starts) - np.minimum.reduceat(y[packed], starts)
    assert heights.max() < 0.5  # a leaf over the end of a strip and the start of the next is about 1 high


def test_surroundings_equal_the_single_searches(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1.0, 2.5, rng.random() * 30]), rng.random() * 30, rng.random() if i % 5 else None, i % 3 == 0, i % 40 == 0) for i in range(600)]
    rows.append((600, None, 1.0, 0.5, False, False))
    cells = spark.createDataFrame(rows, "cell_id long, x double, y double, v double, a boolean, b boolean")
    got = nb.surroundings(cells, cells.where("a"), cells.where("b"), ["v"], 6, 3.0, 4, "cell_id", "x", "y", ("near", "density", "far"), "_local")
    want = nb.knn_local_mean(cells, ["v"], 6, 3.0)
    want = nb.nearest_distance(want, cells.where("a"), out="near")
    want = nb.radius_density(want, cells.where("a"), 3.0, 4, out="density")
    want = nb.nearest_distance(want, cells.where("b"), out="far")
    names = ["cell_id", "v_local", "near", "density", "far"]
    got, want = ({r["cell_id"]: [-1.0 if r[n] is None else r[n] for n in names[1:]] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) == 601
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-12), key


def test_surroundings_without_sources(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(5)], "cell_id long, x double, y double, v double")
    none = cells.where("cell_id < 0")
    got = nb.surroundings(cells, none, none, ["v"], 2, 1.5, 4, "cell_id", "x", "y", ("near", "density", "far"), "_local").collect()
    assert sorted((r["cell_id"], r["v_local"], r["near"], r["density"], r["far"]) for r in got) == [(i, 1.0, None, 0.0, None) for i in range(5)]


def test_cells_are_joined_to_what_surrounds_them_once(spark, monkeypatch):
    joins, kept = [], nb._join_back
    monkeypatch.setattr(nb, "_join_back", lambda *args: joins.append(args) or kept(*args))
    assert queries.score(spark, SMALL).count() == 1500
    assert len(joins) == 1


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_bracketed_quantiles_equal_ordered_ones(spark, keys):
    rng, rows = random.Random(3), []
    for group, n in (("a", 1), ("b", 2), ("c", 7), ("d", 3000), ("e", 9000), (None, 40), ("z", 3)):
        for i in range(n):
            value = rng.choice([1.0, 2.0]) if group == "e" and rng.random() < 0.5 else rng.gauss(0, 1)
            rows.append((group, None if group == "z" or n > 2 and rng.random() < 0.05 else value, float(i % 7)))
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    wanted = {f"q{p}": (F.col("v"), p) for p in (0, 0.05, 0.5, 0.95, 0.99, 1)} | {"w": (F.col("w") * 2, 0.9), "u": (F.col("w"), 0.5)}
    got, want = order._bracketed_quantiles(df, keys, wanted), order._distributed_quantiles(df, keys, wanted)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_whole_table_quantiles_order_few_values(spark, monkeypatch):
    seen, kept = [], order.value_positions
    monkeypatch.setattr(order, "value_positions", lambda df, *args: seen.append(df.count()) or kept(df, *args))
    df = spark.range(40_000).select((F.xxhash64("id") / 1e18).alias("v"))
    rows = sorted(r[0] for r in df.collect())
    got = order.summarise(df, [], [], {"m": (F.col("v"), 0.5), "top": (F.col("v"), 0.99)}).first()
    assert got["m"] == rows[19_999] + (rows[20_000] - rows[19_999]) * 0.5
    assert got["top"] == pytest.approx(rows[39_599] + (rows[39_600] - rows[39_599]) * 0.01, rel=1e-9)
    assert sum(seen) < 2_000


def test_missed_bracket_orders_all_values(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (2.0,)], "v double")
    got = order.summarise(df, [], [], {"m": (F.col("v"), 0.5), "low": (F.col("v"), 0.0)}).first()
    assert (got["m"], got["low"]) == (float("inf"), 1.0)
