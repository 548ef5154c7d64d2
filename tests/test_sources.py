import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import columns as fc
from tessella.operators import catalogue as ct
from tessella.plans import jobs
from tessella.sources import integrity as si
from tessella.sources import quality as sq
from tessella.sources import tables as st
from tessella.streaming import feature_stream as fs

CATALOGUE = [(0, "PECAM1", "Gene Expression"), (1, "CD31", "Protein Expression"), (2, "PD-L1", "Antibody Capture"), (3, "PanCK", "Protein Expression"), (4, "COL1A1", "Gene Expression")]
VALUES = {0: [8, 0, 1, 0], 1: [12, 0, 1, 0], 4: [0, 5, 8, 1], 2: [0, 1, 9, 0], 3: [0, 8, 7, 1]}


@pytest.fixture()
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "feature_index int, feature_name string, feature_type string")


@pytest.fixture()
def measurements(spark):
    rows = [(f"cell-{i + 1}", f, float(v)) for f, vs in VALUES.items() for i, v in enumerate(vs) if v]
    return spark.createDataFrame(rows, "cell_id string, feature_index int, value float")


@pytest.fixture()
def cells(spark):
    return spark.createDataFrame([(f"cell-{i}",) for i in range(1, 5)], "cell_id string")


def test_catalogue_literals(spark, catalogue, measurements, cells):
    aliases = ct.alias_table(spark.createDataFrame([("endothelial", ["CD31", "pecam-1", "VWF"]), ("PD-L1", ["CD274", "PDL1"])], "group string, aliases array<string>"))
    resolved = ct.resolve_features(catalogue, aliases)
    assert {(r["group"], r["column"]) for r in resolved.collect()} == {("endothelial", "protein__CD31"), ("endothelial", "rna__PECAM1"), ("PD-L1", "protein__PD_L1")}
    assert {r["group"]: r["unresolved"] for r in ct.unresolved_aliases(catalogue, aliases).collect()} == {"endothelial": "VWF", "PD-L1": "CD274"}
    assert ct.selected_features(catalogue, resolved).count() == 4
    assert ct.find_single_feature(catalogue, "pd l1") == 2
    with pytest.raises(sq.DataQualityError):
        ct.find_single_feature(catalogue, "absent")
    summary = {r["feature_name"]: r for r in ct.feature_summary(catalogue, measurements, cells).collect()}
    assert summary["PD-L1"]["total"] == 10 and summary["PD-L1"]["positive_cells"] == 2 and summary["PD-L1"]["mean_per_cell"] == 2.5
    wide = {r["cell_id"]: r for r in ct.features_wide(cells, measurements, resolved.select("feature_index", "column").distinct(), ["protein__CD31", "protein__PD_L1"]).collect()}
    assert wide["cell-1"]["protein__CD31"] == 12 and wide["cell-3"]["protein__PD_L1"] == 9 and wide["cell-4"]["protein__PD_L1"] == 0
    with pytest.raises(sq.DataQualityError):
        ct.features_wide(cells, measurements, resolved, ["a", "A"])


def test_stored_zero_counts_as_entry(spark, catalogue, cells):
    rows = spark.createDataFrame([("cell-1", 0, 0.0), ("cell-2", 0, 3.0)], "cell_id string, feature_index int, value float")
    got = ct.feature_summary(catalogue, rows, cells).where("feature_index = 0").first()
    assert (got["positive_cells"], got["positive_value_cells"]) == (2, 1)


def test_column_literals(spark):
    row = spark.range(1).select(
        fc.packed_cell_id(F.lit(0x01234567), F.lit(1)).alias("a"), fc.packed_cell_id(F.lit(0x89ABCDEF), F.lit(7)).alias("b"), fc.packed_cell_id(F.lit(-1), F.lit(7)).alias("c"),
        fc.convert_units(F.lit(1.0)).alias("u"), fc.broad_group(F.lit("0_Tumor_Cells")).alias("g"), fc.canonical_feature_name(F.lit("PD-L1"), F.lit("Antibody Capture")).alias("n"),
        *[fc.parse_censored(F.lit(t)).alias(f"p{i}") for i, t in enumerate(["1,234.5", "<5", "NC", "nan", "x", " 7 "])],
    ).first()
    assert (row["a"], row["b"], row["c"]) == ("abcdefgh-1", "ijklmnop-7", None)
    assert row["u"] == 10.0 and row["g"] == "Tumor_Cells" and row["n"] == "protein__PD_L1"
    assert [row[f"p{i}"] for i in range(6)] == [1234.5, None, None, None, None, 7.0]


def test_read_cells_csv_and_gates(spark, tmp_path):
    text = "cell_id,x_centroid,y_centroid,cell_area,nucleus_area\n" + "".join(f"cell-{i},{20 * i},0,50,20\n" for i in range(4))
    with gzip.open(tmp_path / "cells.csv.gz", "wt") as handle:
        handle.write(text)
    assert st.read_cells(spark, str(tmp_path / "cells.csv.gz")).count() == 4
    (tmp_path / "twice.csv").write_text(text + "cell-1,1,1,1,1\n")
    with pytest.raises(sq.DataQualityError, match="repeats"):
        st.read_cells(spark, str(tmp_path / "twice.csv"))
    (tmp_path / "hole.csv").write_text(text + "cell-9,,1,1,1\n")
    with pytest.raises(sq.DataQualityError, match="finite"):
        st.read_cells(spark, str(tmp_path / "hole.csv"))
    (tmp_path / "short.csv").write_text("cell_id,x_centroid\n1,2\n")
    with pytest.raises(sq.DataQualityError, match="cell_area"):
        st.read_cells(spark, str(tmp_path / "short.csv"))


def test_key_mismatch_names_both_sides(spark, cells):
    other = spark.createDataFrame([("cell-1",), ("cell-2",), ("cell-3",), ("wrong-cell",)], "cell_id string")
    with pytest.raises(sq.DataQualityError, match="cell-4.*wrong-cell"):
        sq.assert_same_keys(cells, other, "cell_id")
    sq.assert_same_keys(cells, cells, "cell_id")
    with pytest.raises(sq.DataQualityError):
        sq.validated_join(cells, cells.union(cells), ["cell_id"], "many_to_one")


def test_sample_triplets_and_groups(spark, tmp_path):
    for sample in ("GSM1_a", "GSM2_b"):
        (tmp_path / f"{sample}_metadata_file.csv").write_text("fov,cell_ID,Area,Unnamed: 0\n1,1,4,0\n1,2,5,1\n")
        (tmp_path / f"{sample}_exprMat_file.csv").write_text("fov,cell_ID,ERBB2,ACTB\n1,1,3,9\n1,2,0,9\n")
    (tmp_path / "GSM1_a_polygons.csv").write_text("fov,cellID,x,y\n1,1,0,0\n")
    got = st.read_sample_triplets(spark, str(tmp_path), ["ERBB2"])
    assert "Unnamed: 0" not in got.columns and "ACTB" not in got.columns
    assert {(r["sample"], r["cell_ID"], r["ERBB2"]) for r in got.collect()} == {("GSM1", "1", 3.0), ("GSM1", "2", 0.0)}
    groups = tmp_path / "groups"
    groups.mkdir()
    (groups / "mid_cell_groups.csv").write_text("cell_id,group\na,0_Tumor_Cells\nb,1_T_Cells\nc,2_Tumor_Cells\n")
    (groups / "bottom_cell_groups.csv").write_text("cell_id,group\na,0_Stromal_Cells\nb,1_Tumor_Cells\n")
    out = jobs.cell_group_audit(st.read_cell_groups(spark, str(groups / "*.csv")))
    got = {(r["sample"], r["broad_group"]): r["cells"] for r in out["composition"].collect()}
    assert got[("mid", "Tumor_Cells")] == 2 and sum(got.values()) == 5


def test_csr_with_long_and_empty_rows(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK", 8)
    rows = [(0, i, 1.0 + i) for i in range(50)] + [(2, 5, 2.0), (2, 9, 3.0)]
    coo = spark.createDataFrame(rows, "major long, minor long, value double")
    majors = spark.createDataFrame([(0,), (1,), (2,)], "major long")
    pointers, entries = st.coo_to_csr(coo, majors)
    assert {tuple(r) for r in pointers.collect()} == {(0, 0, 50), (1, 50, 50), (2, 50, 52)}
    assert sorted(tuple(r) for r in st.csr_to_coo(pointers, entries).collect()) == rows


def test_csr_lists_no_positions_and_joins_no_entries(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK", 8)
    monkeypatch.setattr(st, "ROWS_A_TASK", 16, raising=False)
    rows = [(m, i % 7, float(i % 3)) for m, n in ((1, 3), (2, 0), (4, 90), (5, 1), (9, 8)) for i in range(n)]
    coo = spark.createDataFrame(rows + [(7, 1, 1.0), (None, 1, 1.0)], "major long, minor long, value double")
    majors = spark.createDataFrame([(1,), (2,), (4,), (5,), (9,)], "major long")
    pointers, entries = st.coo_to_csr(coo, majors)
    assert sorted(r["position"] for r in entries.collect()) == list(range(len(rows)))
    found = st.csr_to_coo(pointers, entries)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted(rows)
    gaps = spark.createDataFrame([(1, 2, 4), (3, 20, 29)], "major long, start long, stop long")
    at = spark.createDataFrame([(i, i, 0.0) for i in range(40)], "position long, minor long, value double")
    assert sorted(tuple(r)[:2] for r in st.csr_to_coo(gaps, at).collect()) == [(1, 2), (1, 3)] + [(3, i) for i in range(20, 29)]


def test_file_kinds_audit_and_manifest(spark, tmp_path):
    contents = {
        "a.pdf": b"<!DOCTYPE html><p>", "b.pdf": b"%PDF-1.7 x", "c.zip": b"PK\x03\x04\x00\xff", "d.gz": b"\x1f\x8b\x08\x00", "e.tif": b"II*\x00\xfe\xff", "f.json": b' {"a": [1]}',
        "g.json": b'{"a": ', "h.xml": b"\n<?xml ?>", "i.bin": b"\xff\xfe\x00"
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    expected = spark.createDataFrame([(n, {"pdf": "pdf", "zip": "zip", "gz": "gzip", "tif": "tiff", "json": "json", "xml": "xml"}.get(n[2:], "unknown")) for n in contents], "name string, expected_kind string")
    audit = {r["name"]: r for r in jobs.audit_files(spark, str(tmp_path), expected)["audit"].collect()}
    assert [audit[n]["actual_kind"] for n in sorted(contents)] == ["html", "pdf", "zip", "gzip", "tiff", "json", "unknown", "xml", "unknown"]
    assert audit["c.zip"]["sha256"] == hashlib.sha256(contents["c.zip"]).hexdigest() and audit["c.zip"]["size_bytes"] == 6
    files = si.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1))
    manifest = si.manifest_build(files, "f.json")
    assert manifest.count() == len(contents) - 1
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04\x00\xfe")
    again = si.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1))
    now = si.manifest_build(again, "f.json").withColumnRenamed("relative_path", "name")
    saved = spark.createDataFrame([(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if n != "f.json"], "name string, size_bytes long, sha256 string")
    checked = {r["name"]: r["digest_status"] for r in si.manifest_verify(saved, now, "sha256", 64).collect()}
    assert checked["c.zip"] == "MISMATCH" and checked["b.pdf"] == "MATCH"


def test_inventory_literal(spark):
    members = ["cells.csv.gz", "cell_feature_matrix.h5", "gene_panel.json", "out/analysis/clustering/clusters.csv", "transcripts.parquet"]
    inventory = spark.createDataFrame([(1, m, 10, False) for m in members], "bundle int, member string, size_bytes long, is_dir boolean")
    preferences = spark.createDataFrame(
        [("cells", "cells.parquet", 1), ("cells", "cells.csv.gz", 2), ("matrix", "cell_feature_matrix.h5", 1), ("panel", "gene_panel.json", 1)], "requirement string, name string, preference int"
    )
    assert {r["member"] for r in si.first_available(inventory, preferences).collect()} == set(members[:4])


def test_case_documents(spark, tmp_path):
    doc = {
        "case_id": "7", "diagnostic_assessment": {"HER2/neu": {"her2_score": 2, "result": "equivocal", "positive_cell_percentage": 30}},
        "images": [{"marker_name": "H&E", "mask_type": "x"}, {"marker_name": "her2/NEU", "mask_type": "tumor_cells", "magnification": "20x", "image_file": "a.png"}],
    }
    (tmp_path / "ID7.json").write_text(json.dumps(doc, indent=1))
    row = st.read_case_documents(spark, str(tmp_path)).first()
    assert (row["case_id"], row["score"], row["mask_type"], row["mask_is_denominator_valid"]) == ("7", 2, "tumor_cells", True)


def test_empty_table_still_has_a_part(spark, tmp_path):
    st.write_parts(spark.range(0).toDF("a"), str(tmp_path / "p"))
    assert st.read_parts(spark, str(tmp_path / "p")).count() == 0


def test_stream_result_is_never_missing(spark, tmp_path):
    """Batches go to folders of their own; a restart goes on from the state, and an unfinished folder is not read."""
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = T.StructType([T.StructField("feature_index", T.IntegerType()), T.StructField("value", T.FloatType())])
    names = {c: F.col(c) for c in ("feature_index", "value")}

    def run():
        rows = fs.stream_measurements(spark, source, schema, names)
        return {r["feature_index"]: (r["total"], r["positive_cells"]) for r in fs.run_available(fs.feature_totals(rows), target, state).collect()}

    assert fs.read_totals(spark, target, schema).count() == 0
    spark.createDataFrame([(1, 2.0), (2, 0.0)], schema).write.parquet(source)
    assert run() == {1: (2.0, 1), 2: (0.0, 1)}
    spark.createDataFrame([(1, 5.0)], schema).write.mode("append").parquet(source)
    (tmp_path / "out" / "batch=99").mkdir(parents=True)
    assert run() == {1: (7.0, 2), 2: (0.0, 1)} and run() == {1: (7.0, 2), 2: (0.0, 1)}
    spark.createDataFrame([(3, 1.0)], schema).write.mode("append").parquet(source)
    assert run()[3] == (1.0, 1) and len([p for p in (tmp_path / "out").glob("batch=*/_SUCCESS")]) == 2


def test_packed_ids_of_wide_prefixes_equal_sql(spark, tmp_path):
    """A prefix beyond 32 bits has no id, in the query as in its SQL."""
    import duckdb

    import __spark_entry__ as entry

    folder = str(tmp_path)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1::BIGINT, 3::INT), (542362, 3), (542363, 3), (900000, 4)) t(c_custkey, c_nationkey)) TO '{folder}/customer.parquet'")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["packed_cell_id"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["packed_cell_id"](spark, folder).collect())
    assert got == want and [r[1] is None for r in got] == [False, False, True, True]


def test_resolve_features_chooses_aliases_before_the_join(spark, monkeypatch):
    """Several aliases with one token and feature indices that the catalogue repeats; no sort of the joined rows."""
    catalogue = spark.createDataFrame([(1, "CD-8", "Gene Expression"), (2, "cd8", "Protein"), (2, "CD 4", "Protein"), (None, "cd4", "Gene Expression"), (None, "CD8", "Gene Expression")], "feature_index int, feature_name string, feature_type string")
    aliases = spark.createDataFrame([("g", 0, "x"), ("g", 1, "cd-4"), ("g", 2, "CD8"), ("g", 3, "CD_8"), (None, 0, "cd8")], "group string, alias_ix int, alias string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ct.resolve_features(catalogue, aliases)
        got = sorted(((r["group"] or "", r["alias_ix"], r["alias"], r["feature_index"] or 0, r["feature_name"]) for r in found.collect()))
        assert "BroadcastHashJoin [token" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("", 0, "cd8", 0, "CD8"), ("", 0, "cd8", 1, "CD-8"), ("", 0, "cd8", 2, "cd8"), ("g", 1, "cd-4", 0, "cd4"), ("g", 1, "cd-4", 2, "CD 4"), ("g", 2, "CD8", 1, "CD-8")]


def test_sample_names_of_long_paths(spark):
    """The pattern was tried at every character of a name, so its work grew with the square of the path."""
    import time

    from tessella.sources.tables import _sample_of

    names = ["file:/d/S1_run_metadata_file.csv", "/a/S2_x_exprMat_file.csv/part-0.csv", "S3_polygons.csv.gz", "/d/S4.csv", "/S5_a_metadata_file/b_polygons.csv", "/d/_polygons.csv"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    assert [r[0] for r in rows.orderBy("i").select(_sample_of(F.col("path"))).collect()] == ["S1", "S2", "S3", "", "b", ""]
    long_names = spark.range(2000, numPartitions=8).select(F.concat(F.lit("/d/"), F.repeat(F.lit("ab_"), 2000), F.col("id").cast("string")).alias("path"))
    start = time.time()
    assert long_names.where(_sample_of(F.col("path")) != "").count() == 0
    assert time.time() - start < 15
