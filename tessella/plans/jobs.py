"""Job functions: one per command of the analysis, each returning its result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import catalogue as ct
from tessella.operators import evidence as ev
from tessella.operators import geometry as ge
from tessella.operators import pixels as px
from tessella.operators import stats as ss
from tessella.operators import summaries as su
from tessella.operators import uncertainty as un
from tessella.operators.scaling import reference_positive
from tessella.session import cut_lineage
from tessella.sources import integrity as si
from tessella.sources.tables import read_outcomes

Tables = dict[str, DataFrame]


def write_outputs(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write every result table below ``folder``; existing tables are an error."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")


def multi_sample_geometry(cells: DataFrame, vertices: DataFrame, markers: Sequence[str], definitions: Mapping[str, int], targets: Sequence[str], reference: str) -> Tables:
    """Segmentation check, per-field geometry, definition ratios and rank stability of all samples."""
    metrics = ge.polygon_metrics(vertices, ["sample", "fov", "cell_id"])
    geometry, table = su.relative_geometry(cells, markers, definitions, targets)
    geometry = cut_lineage(geometry)
    ratios = su.definition_ratio(geometry)
    ranks = su.sample_rank_stability(geometry, reference)
    return {
        "segmentation": su.segmentation_by_sample(cells, metrics, ["sample", "fov", "cell_id"], "area_stated", "x", "y"),
        "match_rate": su.match_rate(cells, vertices, ["sample", "fov", "cell_id"], ["sample"]),
        "target_geometry": geometry, "definitions": table, "definition_sensitivity": ratios, "rank_stability": ranks,
        "verdict": su.stability_verdict(ratios, ranks),
    }


def image_geometry(
    cells: DataFrame, pixels: DataFrame, value: str, reference: str, source_channel: str, quantiles: Mapping[str, float],
    targets: Mapping[str, Column], tumour: Column, pixel_um: float,
) -> Tables:
    """Channel concordance and distances to structures of one channel under several thresholds.

    ``pixels``: channel, row, col, value, qc; ``cells``: channel, row, col and the reference value.
    """
    sampled = px.window_mean_at_points(cells, pixels, value, 1, ["channel"])
    sampled = cut_lineage(reference_positive(cut_lineage(sampled), reference, ["channel"]))
    one = F.col("channel") == source_channel
    sensitivity, distances = su.image_definition_sensitivity(
        sampled.where(one), pixels.where(one), value, "local_mean", ~F.col("reference_positive"), quantiles, targets, tumour, pixel_um, 25.0,
        valid=~F.col("qc"),
    )
    plain = sampled.drop("reference_positive", "reference_threshold")
    return {
        "channel_concordance": su.channel_concordance(plain, pixels, reference, "local_mean", value),
        "definition_sensitivity": sensitivity,
        "band_profile": px.distance_band_summary(distances, "distance", [value], ["definition"]),
    }


def region_morphology(pixels: DataFrame, vertices: DataFrame, feature: str, pixel_um: float) -> Tables:
    """Labels, tissue and stain statistics per annotated region of one colour image.

    No candidate pixels are measured here, so their count and share are NULL, with a status.
    """
    labelled = ge.label_grid(pixels, vertices, feature)
    tissue = px.tissue_mask_colour(pixels).withColumn("tissue", F.lit(True))
    joined = labelled.join(tissue, ["row", "col"], "left").withColumns({
        "tissue": F.coalesce("tissue", F.lit(False)), "region": F.when(F.col("label") != "", F.col("label")),
        "haematoxylin": px.stain_density(0), "eosin": px.stain_density(1), "candidate": F.lit(False),
    })
    areas = ge.annotation_areas(vertices, [feature], pixel_um, pixel_um)
    regions = px.region_morphology(joined, "region", "tissue", ["haematoxylin", "eosin"], "candidate", pixel_um**2).withColumns({
        "candidate_pixels": F.lit(None).cast("long"), "candidate_fraction": F.lit(None).cast("double"), "candidate_status": F.lit("NOT_COMPUTED"),
    })
    return {
        "regions": regions,
        "annotation_areas": areas, "areas_by_name": ge.areas_by_name(areas),
    }


def rasterise(cells: DataFrame, size: int, by: Sequence[str] = ()) -> Tables:
    """Grid table with source distances, and each cell's grid position."""
    grid = cut_lineage(ge.rasterise_cells(cells, size, by))
    distance = ge.grid_distance(grid, "vessel_mask", 1.0, by)
    return {"grid": distance.withColumn("distance_um", F.col("distance") * F.col("step")).drop("distance"), "positions": ge.grid_positions(cells, size, by)}


def reach_index(cells: DataFrame, threshold: Column, penalties: DataFrame, claim_table: DataFrame, decision: float = 0.5) -> Tables:
    """Per data set: reach intervals, decision, barrier and claims from per-draw bound fractions."""
    draws = un.reach_metrics(cells, threshold, [ev.KEY])
    index = cut_lineage(un.reach_index(draws, [ev.KEY], decision))
    return {
        "draws": draws, "index": index, "barriers": un.barrier_attribution(penalties, [ev.KEY]),
        "claims": ev.claims(index.select(ev.KEY, "status", "reasons"), claim_table),
    }


def sobol(samples: DataFrame, ranges: DataFrame, output: Column, seed: int = 17) -> Tables:
    """Design, outputs and indices; ``output`` is an aggregate over (name, value) of one run."""
    design = un.sobol_design(samples, ranges, seed)
    runs = cut_lineage(design.groupBy("sample", "matrix").agg(output.alias("y")))
    return {"runs": runs, "indices": un.sobol_indices(runs)}


def cell_group_audit(groups: DataFrame) -> Tables:
    return {"composition": su.group_composition(groups), "samples": su.sample_summary(groups)}


def feature_group_audit(catalogue: DataFrame, measurements: DataFrame, groups: DataFrame, name: str) -> Tables:
    """One feature over all cells and by cell group."""
    index = ct.find_single_feature(catalogue, name)
    one = measurements.where(F.col("feature_index") == index)
    per_cell = one.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("feature_value"))
    joined = groups.join(per_cell, "cell_id", "left").fillna(0.0, ["feature_value"])
    return {
        "feature": ct.feature_vector_stats(groups.select("cell_id").distinct(), one),
        "by_group": su.feature_by_group(joined, "feature_value", ["sample", "group"]),
    }


def perfusion(pixels: DataFrame, pixel_um: float, width: int, alphas: Sequence[float], minimum_pixels: int = 20, stride: int = 1) -> Tables:
    """Profiles by distance to bright structures, near-to-far ratios and their robustness per image."""
    by = ["image"]
    mask, levels = px.segment_bright(pixels, "g", by, minimum_pixels=minimum_pixels)
    measured = cut_lineage(px.mask_distance(pixels, cut_lineage(mask), pixel_um, by, "distance"))
    signal = cut_lineage(px.perfusion_signal(measured, alphas, by))
    settings = cut_lineage(px.near_far_ratio(signal.where("tissue"), "distance", "perfusion", width, [*by, "alpha"], stride))
    return {
        "levels": levels, "profiles": px.distance_band_summary(signal, "distance", ["perfusion"], [*by, "alpha"], F.col("tissue"), means=True),
        "settings": settings, "robustness": px.perfusion_robustness(settings, by),
    }


def stain_benchmark(cases: DataFrame, pixels: DataFrame, mask: Column) -> Tables:
    """Stain features per case, concordance with the ordinal score and its exact p-value.

    ``cases``: dataset_id, case_id, score, mask_type, mask_is_denominator_valid.
    """
    names = ["dab_median", "dab_q90", "dab_q95", "brown_median", "brown_q90"]
    table = cut_lineage(cases.join(px.stain_features(pixels, mask, ["case_id"]), "case_id"))
    return {
        "cases": table, "concordance": ss.feature_concordance(table, "score", names, [ev.KEY]),
        "summary": ss.score_benchmark_summary(table, "score", names, "mask_is_denominator_valid", "mask_type", [ev.KEY]),
        "permutation": ss.exact_max_stat_permutation(table, "case_id", "score", names, [ev.KEY]),
    }


def receptor_calibration(wide: DataFrame, ids: Sequence[str], pairs: Sequence[tuple[str, str, int]], score: str) -> Tables:
    rows = cut_lineage(ct.unpivot_replicates(wide, ids, pairs))
    model = cut_lineage(ss.loglog_fit(rows, "raw", "calibrated"))
    return {"pairs": rows, "model": model, "predictions": ss.calibrated_predict(rows, model, "raw"), "groups": su.label_group_summary(rows, score, ["calibrated"], True)}


def texture_benchmark(pixels: DataFrame, labels: DataFrame) -> Tables:
    """Intensity features per image, summarised by tissue class."""
    features = cut_lineage(px.intensity_features(pixels, "v", ["image"]).join(labels, "image"))
    return {"features": features, "groups": su.label_group_summary(features, "tissue_class", ["intensity_mean", "positive_fraction"])}


def panel_benchmark(pixels: DataFrame, panels: DataFrame) -> Tables:
    """Distance features per panel, exact group permutation and direction.

    ``panels``: image, dataset_id, group (0 or 1), section.
    """
    features = cut_lineage(px.panel_distance_features(pixels, ["image"]).join(panels, "image"))
    return {
        "features": features, "permutation": ss.exact_group_permutation(features, "distance_mean", "group", "section", [ev.KEY]),
        "direction": ss.group_direction(features, "distance_mean", "group", [ev.KEY]),
    }


def transport_prior(observations: DataFrame) -> Tables:
    return {"bounds": su.prior_bounds(observations, "central", "lower", "upper", ["source"])}


def audit_files(spark: SparkSession, folder: str, expected: DataFrame) -> Tables:
    """Content kinds and digests of files; ``expected`` has (name, expected_kind)."""
    files = si.read_files(spark, folder).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1))
    audit = si.file_audit(files.join(expected, "name"))
    return {"audit": audit, "status": si.audit_status(audit)}


def evidence_package(nodes: DataFrame, edges: DataFrame, requirements: DataFrame, components: DataFrame, draws: int = 20_000, seed: int = 17) -> Tables:
    """Ledger checks, readiness, priorities, blocked outputs and the ranking under uncertainty."""
    ranks = cut_lineage(un.rank_draws(components, draws, seed))
    summary = cut_lineage(un.rank_summary(ranks))
    return {
        "violations": ev.ledger_violations(nodes, edges, requirements), "readiness": ev.readiness_score(requirements),
        "priorities": ev.measurement_priority(requirements), "blocked_outputs": ev.blocked_outputs(nodes, edges),
        "blocked_transfers": ev.blocked_transfers(edges), "rank_summary": summary, "pairwise": un.pairwise_win(ranks),
        "leave_one_out": un.leave_one_out(components, draws, seed), "winner": un.stable_winner(summary),
    }


def retrospective(spark: SparkSession, path: str, permutations: int = 1000, allow_synthetic: bool = False, value: str = "gap") -> Tables:
    table = read_outcomes(spark, path, value)
    return {
        "test": ss.permutation_test_median(table, "programme_id", "outcome", value, (), permutations, 17, allow_synthetic),
        "stratified": ss.stratified_difference(table, "outcome", value, ["format", "indication"]),
    }
