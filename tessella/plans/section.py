"""Section preparation: from cells and features to scored cells, calls and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import scaling as sc
from tessella.operators import summaries as su
from tessella.operators.catalogue import feature_summary, features_wide, resolve_features, selected_features, unresolved_aliases
from tessella.operators.geometry import affine_transform, alignment_accept, alignment_candidates, alignment_transforms, point_in_polygon, polygon_metrics
from tessella.operators.neighbours import surroundings
from tessella.session import cut_lineage
from tessella.sources.quality import assert_same_keys
from tessella.sources.tables import build_target_tables, stable_sample

SCORE_GROUPS = ("endothelial", "pericyte", "caf", "ecm", "malignant", "immune")


def score_cells(
    cells: DataFrame, wide: DataFrame, groups: Mapping[str, Sequence[str]], k: int = 24, radius: float = 100.0,
    neighbourhood: float = 150.0, x: str = "x_um", y: str = "y_um", cell_id: str = "cell_id",
) -> DataFrame:
    """Group scores, source call, nearest-source geometry, local scores and malignant neighbourhood.

    The scored table is written out between the stages that read it more than once; what surrounds a cell is joined to it once.
    """
    features = [c for c in wide.columns if c != cell_id]
    merged = cut_lineage(cells.join(wide, cell_id, "left").fillna(0.0, features))
    named = {f"{g}_score": list(groups.get(g, ())) for g in SCORE_GROUPS}
    scored = cut_lineage(sc.group_score(merged, named))
    called = sc.vessel_call(scored, "endothelial_score", "pericyte_score").drop("vessel_raw")
    scored = cut_lineage(sc.malignant_proxy(called, "malignant_score", seen=scored))
    found = surroundings(
        scored, scored.where("vessel_positive"), scored.where("cell_is_malignant_proxy"), ["caf_score", "ecm_score"], k, radius, 32, cell_id, x, y,
        ("distance_to_vessel_um", "local_vessel_density", "distance_to_malignant_proxy_um"), "_local",
    ).withColumnsRenamed({"caf_score_local": "local_caf_score", "ecm_score_local": "local_ecm_score"})
    inside = F.col("distance_to_malignant_proxy_um") <= F.lit(neighbourhood)
    return found.withColumn("in_molecular_tumour_neighbourhood", F.coalesce(inside, F.lit(False)))


def call_targets(scored: DataFrame, resolved: DataFrame, columns: Sequence[str], keep: Sequence[str], cell_id: str = "cell_id") -> DataFrame:
    """Signal and call per (cell, target); ``resolved`` has (target, column), protein preferred."""
    active = sc.prefer_protein(resolved.where(F.col("column").isin(*columns)))
    scaled = sc.robust_scale(scored, {c: f"__s_{c}" for c in columns})
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__s_{c}").alias("scaled")) for c in columns])
    long = scaled.select(cell_id, F.inline(items))
    raw = long.join(active, "column").groupBy(cell_id, "target", "measurement").agg(F.avg("scaled").alias("raw"))
    return sc.target_call(raw).join(scored.select(cell_id, *keep), cell_id)


def prepare_section(
    cells: DataFrame, measurements: DataFrame, catalogue: DataFrame, aliases: DataFrame, names: Sequence[str],
    groups: Mapping[str, Sequence[str]], annotations: DataFrame | None = None, matrix: Sequence[Sequence[float]] | None = None,
    boundaries: DataFrame | None = None, targets: DataFrame | None = None, sample: int = 20_000, seed: int = 17,
    region_values: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All tables of one section; ``names`` are the wide feature columns that may be built.

    ``region_values`` are summarised by region (default: scores, positive calls and distances). If the
    annotations cannot be aligned with a clear lead, the regions are ``UNAVAILABLE``, the summary by
    region is left out, and the candidates are returned for review; all other tables are made.
    """
    assert_same_keys(cells.select("cell_id"), measurements.select("cell_id"), "cell_id")
    resolved = resolve_features(catalogue, aliases)
    columns = resolved.select("feature_index", "column").distinct()
    wide = features_wide(cells.select("cell_id"), measurements, columns, names)
    scored = cut_lineage(score_cells(cells, wide, groups))
    tried = None
    aligned = annotations is not None
    moved = annotations
    if annotations is not None and matrix is not None:
        tried = cut_lineage(alignment_candidates(annotations, cells.select(F.col("x_um").alias("x"), F.col("y_um").alias("y")), matrix))
        found = alignment_accept(tried).first()
        aligned = found["accepted"]
        moved = affine_transform(annotations, alignment_transforms(matrix)[found["transform"]], (found["scale"], found["scale"])) if aligned else None
    if aligned:
        scored = cut_lineage(point_in_polygon(scored, moved, "cell_id", px="x_um", py="y_um"))
    else:
        scored = scored.withColumn("pathology_region", F.lit("UNAVAILABLE"))
    if region_values is None:
        region_values = [c for c in scored.columns if c.endswith(("_score", "_positive")) or c.startswith("distance_")]
    out = {
        "scored_cells": scored,
        "feature_summary": feature_summary(catalogue, measurements, cells),
        "selected_features": selected_features(catalogue, resolved),
        "unresolved_aliases": unresolved_aliases(catalogue, aliases),
        "cell_sample": stable_sample(scored, seed, "cell_id", sample),
    }
    if tried is not None:
        out["alignment_candidates"] = tried
    if aligned or annotations is None:
        out["region_summary"] = su.region_summary(scored, "pathology_region", region_values)
    if targets is not None:
        keep = ["distance_to_vessel_um", "local_caf_score", "local_ecm_score", "pathology_region", "in_molecular_tumour_neighbourhood", "cell_is_malignant_proxy", "immune_score"]
        calls = call_targets(scored, targets, names, keep)
        flagged = su.with_tumour(cut_lineage(calls), "pathology_region", "in_molecular_tumour_neighbourhood")
        rows = flagged.withColumnsRenamed({"local_caf_score": "local_caf", "local_ecm_score": "local_ecm"})
        subsets: dict[str, Column] = {
            "all_cells": F.lit(True), "tumour_region": F.col("in_tumour"), "malignant_proxy": F.col("cell_is_malignant_proxy"), "immune_high": F.col("immune_score") >= 0.5,
        }
        out["target_calls"] = calls
        out["target_spatial_summary"] = su.target_spatial_summary(rows, subsets, "distance_to_vessel_um")
    if boundaries is not None:
        metrics = polygon_metrics(boundaries, ["cell_id"], "vertex_x", "vertex_y")
        out["segmentation_robustness"] = su.segmentation_robustness(cells, metrics, "cell_id", "cell_area")
    return out


def target_tables(scored: DataFrame, targets: Mapping[str, tuple[str, str]], path: str) -> None:
    """Write the downstream rows of every target, one folder per target."""
    build_target_tables(scored, targets).write.mode("errorifexists").partitionBy("target").parquet(path)
