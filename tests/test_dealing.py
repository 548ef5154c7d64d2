"""Rows are dealt to tasks before a definition or a draw multiplies them."""

from pyspark.sql import functions as F

import checks.summaries as queries
from tessella import session
from tessella.operators import neighbours as nb
from tessella.operators import summaries as su

SMALL = "/root/testdata/sf0.001"


def spied(monkeypatch):
    dealt, kept = [], session.deal
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    monkeypatch.setattr(su, "deal", lambda df, copies: dealt.append(kept(df, copies)) or dealt[-1])
    return dealt


def tasks(df):
    return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()


def test_definition_table_needs_no_distances(spark, monkeypatch):
    want = su.relative_geometry(queries.field_cells(spark, SMALL), queries.MARKERS, queries.REQUIRED, ["ta"])[1].collect()

    def never(*args):
        raise AssertionError("distances were searched")

    monkeypatch.setattr(nb, "_nearest_in_tiles", never)
    got = queries.geometry_definitions(spark, SMALL).collect()
    assert len(got) == 15 and {(r[0], r[1], r[2], r[3], r[5]) for r in got} == {(r[0], r[1], r[2], r[3], r[5]) for r in want}


def test_field_cells_are_dealt_before_the_definitions(spark, monkeypatch):
    dealt = spied(monkeypatch)
    su.relative_geometry(queries.field_cells(spark, SMALL), queries.MARKERS, queries.REQUIRED, ["ta"])
    assert tasks(dealt[0]) >= 8


def test_image_cells_are_dealt_before_the_definitions(spark, monkeypatch):
    dealt = spied(monkeypatch)
    assert queries.image_sensitivity(spark, SMALL).count() == 6
    assert tasks(dealt[0]) >= 8


def test_pixels_are_dealt_before_the_definitions(spark, monkeypatch):
    dealt = spied(monkeypatch)
    assert queries.image_sensitivity(spark, SMALL).count() == 6
    assert len(dealt) == 2 and "__ok" in dealt[1].columns and tasks(dealt[1]) >= 8
