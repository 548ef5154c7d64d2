import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import order


def sample(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "hot"], n, p=[0.1, 0.2, 0.7]), "x": np.round(rng.gamma(2, 10, n), 1), "y": rng.normal(size=n).round(2)})
    frame.loc[frame.index % 7 == 0, "x"] = 5.0
    return frame


@pytest.mark.parametrize("split_every", [1, 10, 100_000])
def test_quantiles_equal_numpy(spark, split_every, monkeypatch):
    monkeypatch.setattr(order, "SPLIT_EVERY", split_every)
    frame = sample()
    probabilities = {"q05": 0.05, "q50": 0.5, "q99": 0.99}
    got = order.summarise(
        spark.createDataFrame(frame), ["g"], [F.count(F.lit(1)).alias("n")],
        {**{n: (F.col("x"), p) for n, p in probabilities.items()}, "pos": (F.when(F.col("y") > 0, F.col("x")), 0.9)},
    ).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        for n, p in probabilities.items():
            assert got.loc[g, n] == pytest.approx(np.quantile(part.x, p), abs=1e-12)
        assert got.loc[g, "pos"] == pytest.approx(np.quantile(part.x[part.y > 0], 0.9), abs=1e-12)


def test_global_and_empty_quantiles(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double")
    assert order.summarise(frame, [], [], {"m": (F.col("v"), 0.5)}).first()["m"] == 2.0
    none = order.summarise(frame.where("v > 100"), [], [F.count("v").alias("n")], {"m": (F.col("v"), 0.5)}).first()
    assert none["n"] == 0 and none["m"] is None


@pytest.mark.parametrize("split_every", [1, 10, 100_000])
def test_average_rank_and_spearman_equal_pandas(spark, split_every, monkeypatch):
    monkeypatch.setattr(order, "SPLIT_EVERY", split_every)
    frame = sample(800)
    ranks = order.average_rank(spark.createDataFrame(frame), ["g"], "x").toPandas()
    want = frame.assign(rank=frame.groupby("g").x.rank()).drop_duplicates(["g", "x"]).set_index(["g", "x"])["rank"]
    got = ranks.set_index(["g", "value"])["rank"]
    assert (got.sort_index().values == want.sort_index().values).all()
    rho = order.spearman(spark.createDataFrame(frame), ["g"], "x", "y").toPandas().set_index("g")["rho"]
    for g, part in frame.groupby("g"):
        assert rho[g] == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-12)


def test_constant_side_gives_null(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert order.spearman(rows, [], "x", "y").first()["rho"] is None


def test_row_numbers_equal_pandas(spark):
    frame = sample(500).assign(i=range(500))
    rows = spark.createDataFrame(frame).repartition(9)
    got = order.row_numbers(rows, ["g"], ["x", "i"], "at").toPandas().sort_values("i").reset_index(drop=True)
    want = frame.sort_values(["x", "i"]).groupby("g").cumcount().sort_index()
    assert (got["at"].values == want.values).all()
