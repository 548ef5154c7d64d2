"""A cross-section of the registered queries against their SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "section_summary", "nearest_distance_within", "csr_to_coo", "resolve_features", "feature_summary_stream", "otsu_threshold", "vessel_call",
    "polygon_metrics", "point_in_polygon", "rasterise_cells", "kernel_signal_at_points", "perfusion_robustness", "pair_concordance",
    "definition_sensitivity", "segmentation_robustness", "exact_max_stat_permutation", "rank_summary", "sobol_indices", "measurement_priority", "file_audit", "parts_verify",
]


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
