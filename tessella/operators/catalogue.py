"""Feature catalogue: alias resolution, totals, wide tables and per-feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import canonical_feature_name, is_protein_type, normalise_token
from tessella.operators.order import summarise
from tessella.session import attach, broadcast_if
from tessella.sources.quality import DataQualityError


def alias_table(groups: DataFrame) -> DataFrame:
    """(group, aliases ARRAY) to one row per alias with its position."""
    return groups.select("group", F.posexplode("aliases").alias("alias_ix", "alias"))


def resolve_features(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """Catalogue rows of every alias group; a feature is kept once per group, by its first alias.

    A feature has one token, so the first alias of a group with that token is chosen among the aliases,
    before they meet the catalogue. Only feature indices that the catalogue repeats are compared afterwards.
    """
    named = catalogue.withColumn("token", normalise_token(F.col("feature_name")))
    repeats = named.groupBy("feature_index").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    named = attach(named, repeats, ["feature_index"])
    asked = aliases.withColumn("token", normalise_token(F.col("alias"))).groupBy("group", "token").agg(
        F.min(F.struct("alias_ix", "alias")).alias("__first")
    ).select("group", "token", "__first.*")
    found = named.join(broadcast_if(asked, asked.count()), "token")
    first = Window.partitionBy("group", "feature_index").orderBy("alias_ix")
    again = found.where("__n IS NOT NULL").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return found.where("__n IS NULL").unionByName(again).select(
        "group", "alias_ix", "alias", "feature_index", "feature_name", "feature_type",
        canonical_feature_name(F.col("feature_name"), F.col("feature_type")).alias("column"),
    )


def selected_features(catalogue: DataFrame, resolved: DataFrame, include_proteins: bool = True) -> DataFrame:
    """Distinct feature indices needed: resolved ones plus all protein features."""
    chosen = resolved.select("feature_index")
    if include_proteins:
        chosen = chosen.union(catalogue.where(is_protein_type(F.col("feature_type"))).select("feature_index"))
    return chosen.distinct()


def unresolved_aliases(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases without any feature, per group, in alias order."""
    tokens = catalogue.select(normalise_token(F.col("feature_name")).alias("token")).distinct()
    missing = aliases.withColumn("token", normalise_token(F.col("alias"))).join(tokens, "token", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("alias_ix", "alias")))
    return missing.groupBy("group").agg(F.array_join(F.transform(ordered, lambda s: s["alias"]), "|").alias("unresolved"))


def matching_features(catalogue: DataFrame, name: str) -> DataFrame:
    token = F.lit(name)
    return catalogue.where(
        normalise_token(F.col("feature_name"), ascii_only=True) == normalise_token(token, ascii_only=True)
    )


def find_single_feature(catalogue: DataFrame, name: str) -> int:
    """Index of the one feature called ``name``; none or several is an error that lists them."""
    found = matching_features(catalogue, name).orderBy("feature_index").limit(20).collect()
    if len(found) != 1:
        raise DataQualityError(f"{name}: expected one feature, found {[r['feature_name'] for r in found]}")
    return found[0]["feature_index"]


def feature_summary(catalogue: DataFrame, measurements: DataFrame, cells: DataFrame) -> DataFrame:
    """Total, mean over all cells, stored entries and positive values of every catalogued feature."""
    per_feature = measurements.groupBy("feature_index").agg(
        F.sum(F.col("value").cast("double")).alias("total"), F.count(F.lit(1)).alias("positive_cells"),
        F.count_if(F.col("value") > 0).alias("positive_value_cells"),
    )
    number = cells.agg(F.count(F.lit(1)).alias("cells"))
    joined = attach(catalogue.join(per_feature, "feature_index", "left"), number)
    joined = joined.fillna(0, ["total", "positive_cells", "positive_value_cells"])
    per_cell = F.greatest("cells", F.lit(1))
    return joined.withColumn("mean_per_cell", F.col("total") / per_cell).withColumn(
        "positive_fraction", F.col("positive_cells") / per_cell
    )


def features_wide(cells: DataFrame, measurements: DataFrame, columns: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per selected feature for every cell; duplicates are summed, absent values are 0.

    ``columns``: (feature_index, column); ``names`` is the known list of output columns.
    """
    if len(set(n.lower() for n in names)) != len(names):
        raise DataQualityError("output columns repeat")
    wide = (
        measurements.join(columns, "feature_index")
        .groupBy("cell_id").pivot("column", list(names)).agg(F.sum(F.col("value").cast("double")))
    )
    return cells.join(wide, "cell_id", "left").fillna(0.0, list(names))


def feature_vector_stats(cells: DataFrame, measurements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, positive share and total of one feature over all cells, absent values as 0."""
    per_cell = measurements.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("v"))
    full = cells.join(per_cell, "cell_id", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    positive: Column = (F.col("v") > 0).cast("double")
    return summarise(
        full, keys,
        [F.count(F.lit(1)).alias("cells"), F.avg("v").alias("mean"), F.avg(positive).alias("positive_fraction"), F.sum("v").alias("total")],
        {"median": (F.col("v"), 0.5), "q90": (F.col("v"), 0.9)},
    )


def unpivot_replicates(table: DataFrame, ids: Sequence[str], pairs: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Wide (raw, calibrated, replicate) column pairs to rows where both numbers are positive."""
    items = F.array(*[
        F.struct(F.lit(r).alias("replicate"), F.col(a).cast("double").alias("raw"), F.col(b).cast("double").alias("calibrated"))
        for a, b, r in pairs
    ])
    return table.select(*ids, F.inline(items)).where("raw > 0 AND calibrated > 0")
