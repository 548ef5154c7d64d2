import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import evidence as ev
from tessella.operators import stats as ss
from tessella.operators import summaries as su
from tessella.operators import uncertainty as un
from tessella.plans import jobs
from tessella.sources.quality import DataQualityError
from tessella.sources.tables import OUTCOME_COLUMNS


def test_exact_permutation_literal(spark):
    rows = [("d", i, s, a, b) for i, (s, a, b) in enumerate(zip([0, 0, 1, 2], [0.0, 0.1, 0.8, 1.0], [0.1, 0.0, 0.7, 0.9]))]
    rows += [("big", i, i % 2, float(i), float(-i)) for i in range(40)] + [("flat", i, 1, float(i), 0.0) for i in range(5)]
    cases = spark.createDataFrame(rows, "g string, c int, s int, a double, b double")
    got = {r["g"]: r for r in ss.exact_max_stat_permutation(cases, "c", "s", ["a", "b"], ["g"]).collect()}
    assert got["d"]["arrangements"] == got["d"]["evaluated"] == 12
    frame = pd.DataFrame(rows[:4], columns=["g", "c", "s", "a", "b"])

    def stat(score):
        return max(abs(pd.Series(score).rank().corr(frame[f].rank())) for f in ("a", "b"))

    seen = stat(frame.s.tolist())
    every = [stat(p) for p in set(itertools.permutations(frame.s.tolist()))]
    assert got["d"]["p_value"] == pytest.approx(np.mean([e >= seen - 1e-12 for e in every])) and 0 < got["d"]["p_value"] <= 1
    assert got["big"]["p_value"] is None and got["flat"]["p_value"] is None
    assert [got[g]["status"] for g in ("d", "big", "flat")] == ["COMPUTED", "TOO_MANY_ARRANGEMENTS", "NOT_COMPUTED"]


def test_exact_permutation_is_limited_by_arrangements_only(spark):
    rng = np.random.default_rng(3)
    one = [("one", i, int(i == 0), float(v), float(w)) for i, (v, w) in enumerate(zip(rng.normal(size=21), rng.integers(0, 4, 21)))]
    two = [("two", i, {0: 5, 1: 7, 2: 7}.get(i, 6), float(v), None if i == 4 else float(w)) for i, (v, w) in enumerate(zip(rng.normal(size=12), rng.integers(0, 4, 12)))]
    frame = spark.createDataFrame(one + two, "g string, c int, s int, a double, b double")
    got = {r["g"]: r for r in ss.exact_max_stat_permutation(frame, "c", "s", ["a", "b"], ["g"]).collect()}
    for name, rows in (("one", one), ("two", two)):
        part = pd.DataFrame(rows, columns=["g", "c", "s", "a", "b"])
        labels = part.s.rank().to_numpy()
        odd = [v for v in labels if v != pd.Series(labels).mode()[0]]
        every = set()
        for places in itertools.permutations(range(len(labels)), len(odd)):
            made = np.full(len(labels), pd.Series(labels).mode()[0])
            made[list(places)] = odd
            every.add(tuple(made))
        def stat(made, part=part):
            return np.nanmax([abs(pd.Series(made)[part[f].notna()].corr(part[f].rank()[part[f].notna()])) for f in ("a", "b")])
        stats = np.array([stat(np.array(made)) for made in every])
        assert got[name]["arrangements"] == got[name]["evaluated"] == len(every) == {"one": 21, "two": 660}[name]
        assert got[name]["observed"] == pytest.approx(stat(labels))
        assert got[name]["p_value"] == pytest.approx(np.mean(stats >= stat(labels) - 1e-9))


def test_group_permutation(spark):
    values = [3.0, 1.0, 2.0, 9.0, 4.0, 5.0]
    rows = [("d", i, int(i >= 3), v) for i, v in enumerate(values)] + [("short", 0, 0, 1.0)]
    got = {r["k"]: r for r in ss.exact_group_permutation(spark.createDataFrame(rows, "k string, u int, g int, v double"), "v", "g", "u", ["k"]).collect()}
    seen = np.mean(values[3:]) - np.mean(values[:3])
    hits = [abs(np.mean([values[i] for i in c]) - np.mean([values[i] for i in range(6) if i not in c])) >= abs(seen) - 1e-12 for c in itertools.combinations(range(6), 3)]
    assert got["d"]["p_value"] == pytest.approx(np.mean(hits)) and got["d"]["splits"] == 20 and got["short"]["p_value"] is None


def outcome_file(tmp_path, prefix="P"):
    frame = pd.DataFrame({c: ["x"] * 8 for c in OUTCOME_COLUMNS})
    frame["programme_id"] = [f"{prefix}{i}" for i in range(8)]
    frame["outcome"] = ["success" if i % 2 == 0 else "failure" for i in range(8)]
    frame["gap"] = [0.1 + 0.05 * i for i in range(8)]
    frame["format"] = ["IgG"] * 4 + ["ADC"] * 4
    path = tmp_path / f"{prefix}.csv"
    frame.to_csv(path, index=False)
    return str(path)


def test_retrospective(spark, tmp_path):
    out = jobs.retrospective(spark, outcome_file(tmp_path), 50)
    row = out["test"].first()
    assert row["n"] == 8 and row["status"] == "EXPLORATORY_ONLY" and row["median_difference"] == pytest.approx(-0.05) and 0 < row["permutation_p"] <= 1
    assert out["stratified"].first()["stratified_difference"] == pytest.approx(-0.05)
    made_up = jobs.retrospective(spark, outcome_file(tmp_path, "SYNTHETIC_"), 50)["test"].first()
    assert made_up["status"] == "NOT_COMPUTED" and made_up["n"] == 0 and made_up["median_difference"] is None


def test_loglog_literal(spark):
    raw = [5.0, 10.0, 20.0]
    rows = [(r, 10000 * r**0.8, r * 1.1, 10000 * r**0.8 * 1.05, 1) for r in raw]
    wide = spark.createDataFrame(rows, "m1 double, r1 double, m2 double, r2 double, score int")
    out = jobs.receptor_calibration(wide, ["score"], [("m1", "r1", 1), ("m2", "r2", 2)], "score")
    model = out["model"].first()
    assert out["pairs"].count() == 6 and model["r2_original_scale"] > 0.95 and model["slope"] == pytest.approx(0.8, abs=0.05)
    probe = spark.createDataFrame([(8.0,), (500.0,)], "raw double")
    assert [r["predicted"] is None for r in ss.calibrated_predict(probe, out["model"], "raw").orderBy("raw").collect()] == [False, True]
    assert ss.loglog_fit(wide, "m1", "r1").first()["status"] == "NOT_COMPUTED"


def test_pair_concordance_literal(spark):
    rows = spark.createDataFrame(list(zip([1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 1.0, 0.0])), "p double, r double")
    assert su.pair_concordance(rows, "p", "r").first()["nonzero_jaccard"] == pytest.approx(1 / 3)


TARGETS = ["LAG-3", "PD-1", "PD-L1", "VISTA"]


def components(spark):
    rng = np.random.default_rng(5)
    rows = [(f"def{d}", t, 0.1 + 0.2 * i, 90.0 - 20 * i + float(rng.uniform(0, 3)), 0.1 + 0.15 * i) for d in range(6) for i, t in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "definition string, target string, positive_fraction double, target_median double, within_50 double")


def test_ranking_is_reproducible_and_ordered(spark):
    matrix = un.component_matrix(components(spark))
    a = un.rank_draws(matrix, 300, 17).toPandas().sort_values(["draw", "target"]).reset_index(drop=True)
    b = un.rank_draws(matrix.repartition(13), 300, 17).toPandas().sort_values(["draw", "target"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    draws = un.rank_draws(matrix, 300, 17)
    summary = un.rank_summary(draws)
    top = {r["target"]: r["top_rank_probability"] for r in summary.collect()}
    assert top["VISTA"] == 1.0 and sum(top.values()) == pytest.approx(1.0)
    assert un.stable_winner(summary).first()["stable_target"] == "VISTA"
    pairs = {(r["left_target"], r["right_target"]): r["win_probability"] for r in un.pairwise_win(draws).collect()}
    assert pairs[("VISTA", "VISTA")] == 0.5 and pairs[("VISTA", "PD-1")] + pairs[("PD-1", "VISTA")] == pytest.approx(1.0)
    assert un.leave_one_out(matrix, 200, 17).count() == 12
    with pytest.raises(ValueError):
        un.rank_draws(matrix, 50, 17)


def test_incomplete_definitions_are_rejected(spark):
    with pytest.raises(DataQualityError):
        un.component_matrix(components(spark).where("NOT (definition = 'def1' AND target = 'VISTA')"))


def test_ranges_and_sobol(spark):
    bad = spark.createDataFrame([("a", 2.0, 1.0, "uniform")], "name string, low double, high double, distribution string")
    with pytest.raises(DataQualityError):
        un.parameter_draws(bad, 10, 1)
    ranges = spark.createDataFrame([("a", 0.0, 1.0, "uniform"), ("b", 0.0, 2.0, "uniform"), ("c", 1.0, 10.0, "loguniform")], "name string, low double, high double, distribution string")
    out = jobs.sobol(spark.range(3000).withColumnRenamed("id", "sample"), ranges, F.sum(F.when(F.col("name") != "c", F.col("value")).otherwise(0.0)))
    got = {r["parameter"]: r for r in out["indices"].collect()}
    assert got["a"]["total_order"] == pytest.approx(0.2, abs=0.03) and got["b"]["total_order"] == pytest.approx(0.8, abs=0.05) and got["c"]["total_order"] == 0.0
    flat = out["runs"].withColumn("y", F.lit(1.0))
    assert {r["status"] for r in un.sobol_indices(flat).collect()} == {"DEGENERATE"}


STATES = {
    "tissue_geometry": "SATISFIED", "structural_vasculature": "SATISFIED", "spatial_target_localisation": "SATISFIED", "functional_perfusion": "EXTERNAL_ONLY",
    "surface_antigen_calibration": "EXTERNAL_ONLY", "matrix_transport": "EXTERNAL_ONLY", "administered_antibody_field": "MISSING", "same_tissue_pharmacological_endpoint": "MISSING",
}


# Weights of the published requirements.
WEIGHTS = {
    "tissue_geometry": 0.08, "structural_vasculature": 0.08, "spatial_target_localisation": 0.12, "functional_perfusion": 0.18,
    "surface_antigen_calibration": 0.18, "matrix_transport": 0.14, "administered_antibody_field": 0.15, "same_tissue_pharmacological_endpoint": 0.07,
}


def requirements(spark):
    rows = [("rcc", r, w, STATES[r], None if STATES[r] == "SATISFIED" else f"measure {r}") for r, w in WEIGHTS.items()]
    return spark.createDataFrame(rows, "dataset_id string, requirement string, weight double, evidence_state string, next_measurement string")


def test_readiness_literals(spark):
    score = ev.readiness_score(requirements(spark)).first()
    assert (score["readiness_score"], score["requirements_satisfied"], score["requirements_total"]) == (pytest.approx(40.5), 3, 8)
    ranked = ev.measurement_priority(requirements(spark)).orderBy("rank").collect()
    assert ranked[0]["requirement"] == "administered_antibody_field" and ranked[0]["dominant"]
    shares = [r["uncertainty_share"] for r in ranked]
    assert shares == pytest.approx([0.15 / 0.595, 0.135 / 0.595, 0.135 / 0.595, 0.105 / 0.595, 0.07 / 0.595], abs=1e-12) and sum(shares) == pytest.approx(1.0)
    broken = requirements(spark).withColumn("weight", F.col("weight") * 1.1)
    assert ev.readiness_score(broken).first()["status"] == "NOT_COMPUTED"


def test_ledger_and_claims(spark):
    nodes = spark.createDataFrame([("d", "n1", "MISSING_REQUIREMENT", "ABSENT"), ("d", "n2", "RUMOUR", "X")], "dataset_id string, node_id string, evidence_class string, status string")
    edges = spark.createDataFrame([("d", "n1", "gap", "REQUIRED_FOR", False), ("d", "n9", "gap", "BLOCKED_TRANSFER", True)], "dataset_id string, source string, target string, relation string, transferable boolean")
    need = requirements(spark).withColumn("dataset_id", F.lit("d"))
    rules = {r["rule"] for r in ev.ledger_violations(nodes, edges, need).collect()}
    assert rules == {"EVIDENCE_CLASS", "TRANSFERABLE_BLOCK", "UNKNOWN_SOURCE"}
    assert ev.evidence_tables(nodes, edges, need)["nodes"].count() == 1
    row = ev.blocked_outputs(nodes, edges).first()
    assert (row["output"], row["missing_nodes"], row["status"]) == ("gap", 1, "NOT_COMPUTED")
    many = [(f"m{k}", "gap") for k in range(15)]
    missing = spark.createDataFrame([("d", n, "MISSING_REQUIREMENT", "ABSENT") for n, _ in many], nodes.schema)
    needs = spark.createDataFrame([("d", n, t, "REQUIRED_FOR", False) for n, t in many], edges.schema)
    assert {(r["missing_node"], r["missing_nodes"]) for r in ev.blocked_outputs(missing, needs).collect()} == {(n, 15) for n, _ in many}
    runs = spark.createDataFrame([("a", "OK", ""), ("b", "INSUFFICIENT_EVIDENCE", "R")], "dataset_id string, status string, reasons string")
    table = spark.createDataFrame([("permitted", "p", None), ("permitted", "abstained", "INSUFFICIENT_EVIDENCE")], "kind string, claim string, when_status string")
    got = {(r["dataset_id"], r["claim"], r["abstention"]) for r in ev.claims(runs, table).collect()}
    assert got == {("a", "p", ""), ("b", "p", "R"), ("b", "abstained", "R")}


def test_multi_sample_job(spark):
    cells, vertices = [], []
    for s, shift in (("s1", 0.0), ("s2", 3.0)):
        for i in range(12):
            x = 10.0 * i + shift
            cells.append((s, 1, i, x + 1, 1.0, 4.0, *[float(i % 6 == 0)] * 4, float(i % 2), float(i % 3 == 1), float(i > 4)))
            vertices += [(s, 1, i, k, x + a, b) for k, (a, b) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    cell_table = spark.createDataFrame(cells, "sample string, fov int, cell_id int, x double, y double, area_stated double, m1 double, m2 double, m3 double, m4 double, ta double, tb double, tc double")
    vertex_table = spark.createDataFrame(vertices, "sample string, fov int, cell_id int, vertex_ix int, x double, y double")
    out = jobs.multi_sample_geometry(cell_table, vertex_table, ["m1", "m2", "m3", "m4"], {"inclusive": 2, "balanced": 4}, ["ta", "tb", "tc"], "balanced")
    seg = {r["sample"]: r for r in out["segmentation"].collect()}
    assert seg["s1"]["matched_fraction"] == 1.0 and seg["s1"]["median_area_error"] == 0.0 and seg["s1"]["centroid_within_2px"] == 1.0
    assert out["rank_stability"].first()["targets_compared"] == 3 and out["target_geometry"].count() == 12
    assert out["match_rate"].first()["matched_fraction"] == 1.0 and out["verdict"].count() == 1


def test_reach_job(spark):
    rows = [("d", draw, f"c{i}", True, i < 6, 10.0 * i, 0.9 if i < 4 else 0.1) for draw in range(4) for i in range(10)]
    cells = spark.createDataFrame(rows, "dataset_id string, draw int, cell_id string, is_tumour boolean, target_positive boolean, distance double, bound_fraction double")
    penalties = spark.createDataFrame([("d", 6.0, 1.0, 1.0), ("d", 5.0, 1.0, 2.0)], "dataset_id string, vascular_distance double, matrix_fibroblast double, binding_site double")
    table = spark.createDataFrame([("permitted", "p", None)], "kind string, claim string, when_status string")
    out = jobs.reach_index(cells, F.lit(0.5), penalties, table)
    row = out["index"].first()
    assert row["reachable_median"] == pytest.approx(4 / 6) and row["gap_median"] == pytest.approx(0.6 / 3) and row["penetration_median"] == 30.0 and row["status"] == "OK"
    assert out["barriers"].first()["dominant_barrier"] == "vascular_distance"


def test_barrier_penalties_by_hand(spark):
    cells = spark.createDataFrame([("t", 10.0, 30.0, 0.0, 0.0), ("t", 20.0, 50.0, 0.0, 0.0), ("t", 30.0, 40.0, 1.0, 1.0)], "g string, antigen double, vessel_distance double, ecm double, caf double")
    names = "draw int, diffusion double, beta_ecm double, beta_caf double, clearance double, internalisation double, kd double, vessel_concentration double, calibration double"
    draws = spark.createDataFrame([(1, 16.0, 0.5, 0.5, 0.0, 0.01, 1.0, 4.0, 2.0), (2, 16.0, 1.0, 0.0, 1.0, 0.0, 1.0, 4.0, 1.0)], names)
    got = {r["draw"]: r for r in un.barrier_penalties(cells, draws, ["g"], 5.0).collect()}
    # Medians: antigen 20, distance 40, effective diffusion 16; held = 0.01 * 40 / 5 = 0.08; reach = sqrt(16 / 0.08).
    assert got[1]["vascular_distance"] == pytest.approx(1600 / 200) and got[1]["matrix_fibroblast"] == 0 and got[1]["binding_site"] == pytest.approx(0.08 * 1600 / 16)
    assert got[2]["vascular_distance"] == pytest.approx(64.0) and got[2]["binding_site"] == 0
    assert un.barrier_attribution(un.barrier_penalties(cells, draws, ["g"], 5.0), ["g"]).count() == 1


def test_design_is_made_by_several_tasks(spark, monkeypatch):
    """One split of samples was one task for all rows of the design, and one hash table for its sums."""
    from tessella import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 1000, raising=False)
    ranges = spark.createDataFrame([(n, 0.0, 1.0, "uniform") for n in "abc"], "name string, low double, high double, distribution string")
    samples = spark.range(0, 400, 1, 1).withColumnRenamed("id", "sample")
    design = un.sobol_design(samples, ranges, 17)
    assert design.count() == 400 * 5 * 3
    assert design.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 6
    monkeypatch.setattr(session, "ROWS_A_TASK", 10**9)
    whole = un.sobol_design(samples, ranges, 17)
    assert design.exceptAll(whole).isEmpty() and whole.exceptAll(design).isEmpty()
