"""Group summaries of scored cells, definitions, samples, segmentation and channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import broad_group, convert_units
from tessella.operators.neighbours import nearest_distance
from tessella.operators.order import spearman, summarise
from tessella.operators.pixels import image_mode, mask_distance, structural_mask
from tessella.operators.scaling import calibrate_threshold, marker_count_call, reference_positive
from tessella.session import attach, cut_lineage, deal, materialised


def share(condition: Column) -> Column:
    """Share of rows where the condition holds among rows where it is known."""
    return F.avg(condition.cast("double"))


def subset_rows(df: DataFrame, subsets: Mapping[str, Column]) -> DataFrame:
    """Repeat each row once per subset it belongs to, named in ``subset``."""
    members = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items()]), lambda s: s.isNotNull()
    )
    return df.withColumn("subset", F.explode(members))


def with_tumour(scored: DataFrame, region: str, neighbourhood: str, out: str = "in_tumour") -> DataFrame:
    """Tumour rows by region label; if no row is labelled tumour, by the neighbourhood flag."""
    labelled = F.lower(F.coalesce(F.col(region), F.lit(""))).contains("tumor")
    any_label = scored.agg(F.coalesce(F.bool_or(labelled), F.lit(False)).alias("__any"))
    return attach(scored, any_label).withColumn(out, F.when(F.col("__any"), labelled).otherwise(F.col(neighbourhood))).drop("__any")


def target_spatial_summary(calls: DataFrame, subsets: Mapping[str, Column], distance: str = "distance", by: Sequence[str] = ()) -> DataFrame:
    """Target by subset: cells, positives, median signal, and distances of the positives.

    ``calls`` has one row per (cell, target) with ``target``, ``measurement``, ``signal``,
    ``positive``, the distance and ``local_caf`` / ``local_ecm``.
    """
    rows = subset_rows(calls, subsets)
    hit = F.col("positive")
    d = F.when(hit, F.col(distance))
    return summarise(rows, [*by, "target", "measurement", "subset"], [
        F.count(F.lit(1)).alias("cells"), F.count_if(hit).alias("positive_cells"), share(hit).alias("positive_fraction"),
        share(d <= 25).alias("positive_within_25um"), share(d <= 50).alias("positive_within_50um"), share(d <= 100).alias("positive_within_100um"),
    ], {
        "median_signal": (F.col("signal"), 0.5), "median_distance_positive": (d, 0.5),
        "median_local_caf_positive": (F.when(hit, F.col("local_caf")), 0.5), "median_local_ecm_positive": (F.when(hit, F.col("local_ecm")), 0.5),
    })


def pair_concordance(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman, non-zero shares, Jaccard and one-sided shares of two measurements."""
    a, b = F.col(x) > 0, F.col(y) > 0
    counts = df.groupBy(*by).agg(
        share(a).alias("x_nonzero_fraction"), share(b).alias("y_nonzero_fraction"),
        (F.count_if(a & b) / F.greatest(F.count_if(a | b), F.lit(1))).alias("nonzero_jaccard"),
        share(a & ~b).alias("x_only_fraction"), share(b & ~a).alias("y_only_fraction"),
    )
    return attach(counts, spearman(df, by, x, y, "spearman").drop("pairs"), by)


def region_summary(df: DataFrame, region: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cells, median and 90th percentile of each column per region; NULL is a region."""
    quantiles = {}
    for c in columns:
        quantiles[f"{c}_median"] = (F.col(c).cast("double"), 0.5)
        quantiles[f"{c}_q90"] = (F.col(c).cast("double"), 0.9)
    return summarise(df, [*by, region], [F.count(F.lit(1)).alias("cells")], quantiles)


def definition_sensitivity(rows: DataFrame, targets: Mapping[str, Column], tumour: Column, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Definition by target: source share, distances of all, tumour and target-positive cells.

    ``rows`` has one row per (cell, definition) with ``source``; distances of all definitions come
    from one neighbour join keyed by the definition.
    """
    keys = [*by, "definition"]
    rows = materialised(rows.withColumn("__tumour", F.coalesce(tumour, F.lit(False))))
    measured = cut_lineage(nearest_distance(rows, rows.where("source"), keys, x, y, "__d"))
    d, in_tumour = F.col("__d"), F.when(F.col("__tumour"), F.col("__d"))
    base = summarise(measured, keys, [F.count_if("source").alias("source_cells"), share(F.col("source")).alias("source_fraction")], {
        "all_median": (d, 0.5), "all_q90": (d, 0.9), "tumour_median": (in_tumour, 0.5), "tumour_q90": (in_tumour, 0.9),
    })
    flags = F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(c, F.lit(False)).alias("hit")) for t, c in targets.items()])
    positive = measured.select(*keys, "__d", "__tumour", F.inline(flags))
    hit = F.col("hit") & F.col("__tumour")
    p = F.when(hit, d)
    per_target = summarise(positive, [*keys, "target"], [
        F.count_if(hit).alias("target_positive_tumour_cells"), share(p <= 25).alias("within_25"), share(p <= 50).alias("within_50"), share(p <= 100).alias("within_100"),
    ], {"target_median": (p, 0.5), "target_q90": (p, 0.9)})
    return attach(per_target, base, keys)


def robustness_ranges(df: DataFrame, metrics: Sequence[str], definition: str = "definition", by: Sequence[str] = ("target",)) -> DataFrame:
    """Number of definitions and range of each metric per group."""
    return df.groupBy(*by).agg(
        F.count_distinct(definition).alias("definitions"),
        *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("minimum", F.min), ("maximum", F.max))],
    )


def segmentation_robustness(cells: DataFrame, metrics: DataFrame, key: str, stated_area: str, by: Sequence[str] = ()) -> DataFrame:
    """Stated against boundary area over all cells; a missing polygon counts as not within."""
    joined = cells.join(metrics.select(key, "vertices", "area", "compactness"), key, "left")
    error = F.abs(F.col("area") - F.col(stated_area)) / F.greatest(F.col(stated_area), F.lit(1e-9))

    def within(limit: float) -> Column:
        return F.avg(F.coalesce(error <= limit, F.lit(False)).cast("double"))

    return summarise(joined, by, [
        F.count(F.lit(1)).alias("cells"), F.avg(F.col("area").isNotNull().cast("double")).alias("coverage"),
        within(0.01).alias("within_1pct"), within(0.05).alias("within_5pct"), within(0.10).alias("within_10pct"),
    ], {
        "median_error": (error, 0.5), "q95_error": (error, 0.95), "median_vertices": (F.col("vertices").cast("double"), 0.5),
        "median_compactness": (F.col("compactness"), 0.5),
    })


def segmentation_by_sample(cells: DataFrame, metrics: DataFrame, on: Sequence[str], stated_area: str, cx: str, cy: str, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Per sample: matched share, area and centroid errors of matched cells."""
    joined = cells.join(metrics.select(*on, "area", "centroid_x", "centroid_y"), list(on), "left")
    area_error = F.abs(F.col("area") - F.col(stated_area)) / F.greatest(F.col(stated_area), F.lit(1.0))
    dx, dy = F.col("centroid_x") - F.col(cx), F.col("centroid_y") - F.col(cy)
    centroid_error = F.when(F.col("area").isNotNull(), F.sqrt(dx * dx + dy * dy))
    matched = F.col("area").isNotNull().alias("__matched")
    # The errors are written once: the polygons and the join are not made again for every scan of them.
    errors = materialised(joined.select(*by, matched, area_error.alias("__area"), centroid_error.alias("__centroid")))
    area_error, centroid_error = F.col("__area"), F.col("__centroid")
    return summarise(errors, by, [
        F.count(F.lit(1)).alias("cells"), share(F.col("__matched")).alias("matched_fraction"),
        share(area_error <= 0.10).alias("area_within_10pct"), share(centroid_error <= 2).alias("centroid_within_2px"),
    ], {
        "median_area_error": (area_error, 0.5), "q95_area_error": (area_error, 0.95),
        "median_centroid_error": (centroid_error, 0.5), "q95_centroid_error": (centroid_error, 0.95),
    }, few=True)


def relative_geometry(
    cells: DataFrame, markers: Sequence[str], definitions: Mapping[str, int], targets: Sequence[str],
    sample: str = "sample", fov: str = "fov", x: str = "x", y: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """Target geometry and definition tables per sample, distances within each field of view."""
    called = materialised(marker_count_call(deal(materialised(cells), len(definitions)), markers, definitions))
    keys = [sample, "definition"]
    measured = cut_lineage(nearest_distance(called, called.where("proxy"), [sample, "definition", fov], x, y, "__d"))
    signals = F.array(*[F.struct(F.lit(t).alias("target"), (F.col(t) > 0).alias("hit")) for t in targets])
    rows = measured.select(*keys, "__d", F.inline(signals))
    d = F.when(F.col("hit"), F.col("__d"))
    geometry = summarise(rows, [*keys, "target"], [
        F.count(F.lit(1)).alias("cells"), F.count_if("hit").alias("positive_cells"), share(F.col("hit")).alias("positive_fraction"),
        F.count(d).alias("positive_with_distance"), share(d <= 25).alias("within_25px"), share(d <= 100).alias("within_100px"),
    ], {"median_distance_px": (d, 0.5), "q90_distance_px": (d, 0.9)})
    return geometry, definition_table(called, sample, fov)


def definition_table(called: DataFrame, sample: str = "sample", fov: str = "fov") -> DataFrame:
    """Proxy cells of every definition per sample, from the rows of ``marker_count_call``; needs no distances."""
    return called.groupBy(sample, "definition", "required").agg(
        F.count_if("proxy").alias("proxy_cells"), share(F.col("proxy")).alias("proxy_fraction"),
        F.count_distinct(F.when(F.col("proxy"), F.col(fov))).alias("fovs_with_proxy"),
    )


def definition_ratio(geometry: DataFrame, by: Sequence[str] = ("sample", "target"), median: str = "median_distance_px", near: str = "within_100px") -> DataFrame:
    """Range over definitions and the ratio of largest to smallest median distance."""
    ranges = geometry.groupBy(*by).agg(
        F.min(median).alias("minimum_median"), F.max(median).alias("maximum_median"), F.min(near).alias("minimum_near"), F.max(near).alias("maximum_near")
    )
    low = F.when(F.col("minimum_median") != 0, F.col("minimum_median"))
    return ranges.withColumn("definition_distance_ratio", F.col("maximum_median") / low)


def sample_rank_stability(geometry: DataFrame, definition: str, sample: str = "sample", median: str = "median_distance_px") -> DataFrame:
    """Every pair of samples: shared targets and rank correlation of their medians (three or more).

    Input has one row per (sample, target), so pairs grow with samples, never with cells.
    """
    one = geometry.where((F.col("definition") == definition) & F.col(median).isNotNull())
    left = one.select(F.col(sample).alias("sample_left"), "target", F.col(median).alias("l"))
    right = one.select(F.col(sample).alias("sample_right"), "target", F.col(median).alias("r"))
    pairs = left.join(right, "target").where(F.col("sample_left") < F.col("sample_right"))
    rho = spearman(pairs, ["sample_left", "sample_right"], "l", "r")
    return rho.select(
        "sample_left", "sample_right", F.col("pairs").alias("targets_compared"), F.when(F.col("pairs") >= 3, F.col("rho")).alias("spearman_target_rank")
    )


def stability_verdict(ratios: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: typical and largest ratio, median rank correlation and the verdict in words."""
    a = summarise(ratios, [], [F.max("definition_distance_ratio").alias("maximum_ratio"), F.count("definition_distance_ratio").alias("__n")], {"median_ratio": (F.col("definition_distance_ratio"), 0.5)})
    b = summarise(ranks, [], [
        F.count("spearman_target_rank").alias("__r"), F.coalesce(F.bool_and(F.col("spearman_target_rank") >= 0.7), F.lit(True)).alias("__all"),
    ], {"median_rank_spearman": (F.col("spearman_target_rank"), 0.5)})
    both = attach(a, b)
    unstable = (F.col("__n") > 0) & ((F.col("median_ratio") > 2) | ~F.col("__all"))
    return both.select(
        "median_ratio", "maximum_ratio", "median_rank_spearman", ((F.col("__r") > 0) & F.col("__all")).alias("generalises"),
        F.when(unstable, "DEFINITION_SENSITIVE_AND_TARGET_RANKING_NOT_STABLE").otherwise("RELATIVELY_STABLE_WITHIN_TESTED_DEFINITIONS").alias("interpretation"),
    )


def group_composition(groups: DataFrame, sample: str = "sample", group: str = "group") -> DataFrame:
    """Cells and share of every broad group within its sample."""
    counts = groups.groupBy(sample, broad_group(F.col(group)).alias("broad_group")).agg(F.count(F.lit(1)).alias("cells"))
    totals = counts.groupBy(sample).agg(F.sum("cells").alias("__n"))
    return attach(counts, totals, [sample]).withColumn("fraction", F.col("cells") / F.col("__n")).drop("__n")


def sample_summary(groups: DataFrame, sample: str = "sample", group: str = "group") -> DataFrame:
    return groups.groupBy(sample).agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct(group).alias("provider_groups"), F.count_distinct(broad_group(F.col(group))).alias("broad_groups")
    )


def feature_by_group(cells: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, median, 90th percentile, total and positive share of a feature per group."""
    v = F.col(value)
    return summarise(cells, by, [F.count(F.lit(1)).alias("cells"), F.avg(v).alias("mean"), F.sum(v).alias("total"), share(v > 0).alias("positive_fraction")], {
        "median": (v, 0.5), "q90": (v, 0.9),
    })


def group_fold(summary: DataFrame, group: str, status: str, numerator: str, denominator: str, value: str = "mean") -> DataFrame:
    """Ratio of a group's value between two statuses."""
    picked = summary.groupBy(group).agg(
        F.max(F.when(F.col(status) == numerator, F.col(value))).alias("__a"), F.max(F.when(F.col(status) == denominator, F.col(value))).alias("__b")
    )
    return picked.select(group, (F.col("__a") / F.when(F.col("__b") != 0, F.col("__b"))).alias("fold"))


def assignment_agreement(calls: DataFrame, subsets: Mapping[str, Column], reference: str, image: str, medians: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Target by subset: shares called by both, by one side only, and medians over both-positive rows."""
    rows = subset_rows(calls, subsets)
    a, b = F.col(reference), F.col(image)
    return summarise(rows, [*by, "target", "subset"], [
        F.count(F.lit(1)).alias("cells"), share(a).alias("reference_positive_fraction"), share(b).alias("image_positive_fraction"),
        share(a & b).alias("both_positive_fraction"), share(a & ~b).alias("reference_only_fraction"), share(~a & b).alias("image_only_fraction"),
    ], {out: (F.when(a & b, F.col(c)), 0.5) for out, c in medians.items()})


def image_definition_sensitivity(
    cells: DataFrame, pixels: DataFrame, value: str, sample: str, negative: Column, quantiles: Mapping[str, float],
    targets: Mapping[str, Column], tumour: Column, pixel_um: float, minimum_area_um2: float, near: float = 3.4, valid: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Threshold quantile to mask to distances, all definitions in one job keyed by definition.

    ``cells`` carries row, col and the sampled value; returns the target table and the pixel
    distances per definition.
    """
    named = F.array(*[F.struct(F.lit(n).alias("definition"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])
    cells = materialised(cells.withColumn("__neg", negative).withColumn("__tumour", F.coalesce(tumour, F.lit(False))))
    cells = cut_lineage(deal(cells, len(quantiles)))
    level = summarise(cells, [], [], {n: (F.when(F.col("__neg"), F.col(sample)), q) for n, q in quantiles.items()})
    levels = level.select(F.inline(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(n).alias("threshold")) for n in quantiles])))
    dealt = deal(pixels.select("row", "col", value, (F.lit(True) if valid is None else valid).alias("__ok")), len(quantiles))
    every = cut_lineage(attach(dealt.select("*", F.inline(named)).drop("q"), levels, ["definition"]))
    by = ["definition"]
    mask, diagnostics = structural_mask(every, (F.col(value) > F.col("threshold")) & F.col("__ok"), pixel_um, minimum_area_um2, pixel_um, by)
    distances = cut_lineage(mask_distance(every.select("definition", "row", "col", value), mask, pixel_um, by))
    placed = cells.withColumn("__def", F.explode(F.array(*[F.lit(n) for n in quantiles])))
    at = distances.select(F.col("definition").alias("__def"), "row", "col", F.col("distance").alias("__d"))
    measured = materialised(placed.join(at, ["__def", "row", "col"], "left").withColumnRenamed("__def", "definition"))
    d = F.col("__d")
    base = summarise(measured, by, [
        share(F.when(~F.col("__neg"), d <= near)).alias("positive_within_near"), share(F.when(F.col("__neg"), d <= near)).alias("negative_within_near"),
    ], {"all_cell_median": (d, 0.5), "tumour_cell_median": (F.when(F.col("__tumour"), d), 0.5)})
    flags = F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(c, F.lit(False)).alias("hit")) for t, c in targets.items()])
    rows = measured.select("definition", "__d", "__tumour", F.inline(flags))
    p = F.when(F.col("hit") & F.col("__tumour"), d)
    per_target = summarise(rows, ["definition", "target"], [
        F.count_if(F.col("hit") & F.col("__tumour")).alias("target_positive_tumour_cells"),
        share(p <= 25).alias("target_within_25"), share(p <= 50).alias("target_within_50"), share(p <= 100).alias("target_within_100"),
    ], {"target_median": (p, 0.5), "target_q90": (p, 0.9)})
    return attach(attach(attach(per_target, base, by), diagnostics, by), levels, by), distances


def channel_concordance(cells: DataFrame, pixels: DataFrame, reference: str, sample: str, value: str, quantile: float = 0.995, channel: str = "channel") -> DataFrame:
    """Per channel: baseline mode, reference threshold and share, calibration rates, Spearman."""
    by = [channel]
    called = materialised(reference_positive(cells, reference, by))
    shares = called.groupBy(*by).agg(F.first("reference_threshold").alias("reference_threshold"))
    rates = calibrate_threshold(called, sample, "reference_positive", quantile, by).drop("status")
    quality = pixels.groupBy(*by).agg(share(F.col("qc")).alias("qc_mask_fraction"))
    mode = image_mode(pixels, value, by, (F.col(value) > 0) & ~F.col("qc"))
    rho = spearman(called, by, sample, reference, "cell_image_spearman").drop("pairs")
    result = attach(attach(mode.withColumnRenamed("mode", "baseline_mode"), quality, by), shares, by)
    return attach(attach(result, rates, by), rho, by)


def label_group_summary(df: DataFrame, label: str, values: Sequence[str], extremes: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rows and medians (and optionally extremes) of each value per label."""
    aggregates = [F.count(F.lit(1)).alias("observations")]
    if extremes:
        aggregates += [f(v).alias(f"{n}_{v}") for v in values for n, f in (("minimum", F.min), ("maximum", F.max))]
    return summarise(df.where(F.col(label).isNotNull()), [*by, label], aggregates, {f"median_{v}": (F.col(v), 0.5) for v in values})


def match_rate(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of left rows whose key exists on the right."""
    keys = right.select(*on).distinct().withColumn("__m", F.lit(True))
    joined = left.join(keys, list(on), "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("__m").alias("matched"), F.avg(F.col("__m").isNotNull().cast("double")).alias("matched_fraction")
    )


def prior_bounds(observations: DataFrame, central: str, lower: str, upper: str, by: Sequence[str]) -> DataFrame:
    """Lowest and highest of central, lower and upper values after unit conversion."""
    values = F.explode(F.filter(F.array(*[convert_units(F.col(c)) for c in (central, lower, upper)]), lambda v: v.isNotNull()))
    return observations.select(*by, values.alias("v")).groupBy(*by).agg(F.count(F.lit(1)).alias("values"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def variable_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column: non-null rows, mean, median, q05 and q95."""
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.inline(items))
    return summarise(
        long, [*by, "variable"], [F.count("v").alias("n"), F.avg("v").alias("mean")],
        {"median": (F.col("v"), 0.5), "q05": (F.col("v"), 0.05), "q95": (F.col("v"), 0.95)},
    )


def region_counts(df: DataFrame, region: str) -> DataFrame:
    """Rows per label; a missing label is a group of its own."""
    return df.groupBy(region).agg(F.count(F.lit(1)).alias("rows"))
