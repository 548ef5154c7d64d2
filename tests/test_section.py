"""A section end to end, with annotations that can or cannot be aligned."""

import pytest

from tessella.operators.catalogue import resolve_features
from tessella.plans.section import prepare_section


@pytest.mark.parametrize(("side", "aligned"), [(100.0, True), (0.0, False)])
def test_section_abstains_on_ambiguous_alignment(spark, side, aligned):
    places = [(f"c{k}", float(10 * (k % 10)), float(10 * (k // 10))) for k in range(100)]
    cells = spark.createDataFrame(places, "cell_id string, x_um double, y_um double")
    values = spark.createDataFrame([(c, k % 2, float(1 + k % 7)) for k, (c, _, _) in enumerate(places)], "cell_id string, feature_index int, value double")
    catalogue = spark.createDataFrame([(0, "PECAM1", "Gene Expression"), (1, "EPCAM", "Gene Expression")], "feature_index int, feature_name string, feature_type string")
    aliases = spark.createDataFrame([("vessel", 0, "pecam1"), ("vessel", 1, "CD31x"), ("malignant", 0, "EPCAM")], "group string, alias_ix int, alias string")
    # A ring over all cells fits only unscaled; a point fits no scale better than another.
    corners = [(0.0, 0.0), (0.0, side), (side, side), (side, 0.0)] if aligned else [(45.0, 45.0)] * 4
    ring = spark.createDataFrame([(0, 0, 0, "Tumor", k, x, y) for k, (x, y) in enumerate(corners)], "feature_ix int, polygon_ix int, ring_ix int, name string, vertex_ix int, x double, y double")
    identity = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    columns = sorted(r["column"] for r in resolve_features(catalogue, aliases).select("column").collect())
    out = prepare_section(cells, values, catalogue, aliases, columns, {"endothelial": columns[:1], "malignant": columns[1:]}, ring, identity)
    regions = {r["pathology_region"] for r in out["scored_cells"].select("pathology_region").distinct().collect()}
    assert regions == ({"Tumor"} if aligned else {"UNAVAILABLE"})
    assert ("region_summary" in out) == aligned
    assert out["alignment_candidates"].count() == 4  # matrix and inverse equal the identity
    assert out["scored_cells"].count() == 100 and out["feature_summary"].count() == 2
