"""Tables that several scans of a step need are written once, not made again by each scan."""

from pyspark.sql import functions as F

import checks.scaling as scaling_queries
import checks.summaries as queries
from tessella.operators import scaling as sc
from tessella.operators import summaries as su

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_robust_scale_does_not_make_its_rows_again(spark):
    sums = spark.range(200).selectExpr("id % 50 AS cell", "id AS v").groupBy("cell").agg(F.sum("v").alias("v"))
    scaled = sc.robust_scale(sums, {"v": "s"})
    assert "Aggregate" not in plan(scaled) and scaled.count() == 50


def test_signals_of_the_masks_are_made_once(spark, monkeypatch):
    seen, kept = [], scaling_queries.signals
    monkeypatch.setattr(scaling_queries, "signals", lambda *args: seen.append(args) or kept(*args))
    assert scaling_queries.masks(spark, SMALL).count() == 6
    assert len(seen) == 1


def test_errors_of_samples_are_written_before_they_are_summarised(spark, monkeypatch):
    seen, kept = [], su.summarise
    monkeypatch.setattr(su, "summarise", lambda df, *args, **more: seen.append((plan(df), more)) or kept(df, *args, **more))
    assert queries.segmentation_by_sample(spark, SMALL).count() > 0
    (text, more), = seen
    assert "Join" not in text and "Aggregate" not in text and more == {"few": True}
