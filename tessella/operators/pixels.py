"""Image measurements over pixel tables: one row per pixel with ``row``, ``col`` and values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import clip
from tessella.operators.components import component_sizes, keep_large, pixel_components
from tessella.operators.distance import grid_nearest
from tessella.operators.order import spearman, summarise
from tessella.operators.scaling import otsu_threshold
from tessella.session import attach, cut_lineage, materialised
from tessella.sources.quality import DataQualityError

# Default distance bands; the last one is open.
BANDS = ((0.0, 10.0), (10.0, 25.0), (25.0, 50.0), (50.0, 100.0), (100.0, None))


def image_mode(pixels: DataFrame, value: str, by: Sequence[str] = (), valid: Column | None = None) -> DataFrame:
    """Most common non-negative integer value; the smallest wins a tie."""
    chosen = pixels if valid is None else pixels.where(valid)
    counts = chosen.where(F.col(value) >= 0).groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).cast("double").alias("mode"))


def pixel_positions(cells: DataFrame, pixel_x: float, pixel_y: float, x: str = "x", y: str = "y") -> DataFrame:
    """Nearest pixel of each cell, halves rounded to even."""
    return cells.withColumns({
        "col": F.rint(F.col(x) / pixel_x).cast("int"), "row": F.rint(F.col(y) / pixel_y).cast("int"),
    })


def _image_size(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*by).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def assert_inside(cells: DataFrame, pixels: DataFrame, by: Sequence[str] = ()) -> None:
    placed = attach(cells, _image_size(pixels, by), by)
    outside = placed.where("row < 0 OR col < 0 OR row >= height OR col >= width OR height IS NULL").limit(1)
    if not outside.isEmpty():
        raise DataQualityError("at least one coordinate lies outside the image")


def pixel_at_points(cells: DataFrame, pixels: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pixel values at each cell's row and column."""
    return cells.join(pixels.select(*by, "row", "col", *values), [*by, "row", "col"], "left")


def window_mean_at_points(cells: DataFrame, pixels: DataFrame, value: str, radius: int = 1, by: Sequence[str] = (), out: str = "local_mean") -> DataFrame:
    """Mean of the square window around each cell's pixel; edge pixels repeat outside the image.

    Windows are computed once per distinct position, however many cells share it.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    by = list(by)
    spots = attach(cells.select(*by, "row", "col").distinct(), _image_size(pixels, by), by)
    shifts = f"explode(sequence(-{radius}, {radius}))"
    around = spots.selectExpr("*", f"{shifts} AS dr").selectExpr("*", f"{shifts} AS dc").selectExpr(
        *by, "row AS r0", "col AS c0",
        "CAST(least(greatest(row + dr, 0), height - 1) AS INT) AS row", "CAST(least(greatest(col + dc, 0), width - 1) AS INT) AS col",
    )
    found = around.join(pixels.select(*by, "row", "col", value), [*by, "row", "col"])
    means = found.groupBy(*by, "r0", "c0").agg(F.avg(value).alias(out))
    means = means.withColumnRenamed("r0", "row").withColumnRenamed("c0", "col")
    return cells.join(means, [*by, "row", "col"], "left")


def excess_signal(value: Column, baseline: Column) -> Column:
    return F.greatest(value - baseline, F.lit(0.0))


def _smooth_axis(pixels: DataFrame, value: str, axis: str, size: str, weights: list[float], by: list[str]) -> DataFrame:
    """Spread each pixel along one axis; mirrored copies stand for the reflected border."""
    radius = (len(weights) - 1) // 2
    other = "row" if axis == "col" else "col"
    table = "array(" + ", ".join(repr(float(w)) + "D" for w in weights) + ")"
    spread = (
        pixels.selectExpr(*by, other, axis, size, value, f"explode(array({axis}, -1 - {axis}, 2 * {size} - 1 - {axis})) AS p")
        .where(f"p >= -{radius} AND p < {size} + {radius}")
        .selectExpr(*by, other, size, value, "p", f"posexplode({table}) AS (i, w)")
        .selectExpr(*by, other, size, f"w * {value} AS c", f"CAST(p + i - {radius} AS INT) AS {axis}")
        .where(f"{axis} >= 0 AND {axis} < {size}")
    )
    return spread.groupBy(*by, other, axis, size).agg(F.sum("c").alias(value))


def gaussian_signal(pixels: DataFrame, value: str, sigma_pixels: float, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian-weighted signal at every pixel, truncated at four sigma, reflected at the border."""
    by = list(by)
    radius = int(4.0 * sigma_pixels + 0.5)
    raw = [math.exp(-0.5 * (d / sigma_pixels) ** 2) for d in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]
    sized = attach(pixels.select(*by, "row", "col", F.col(value).cast("double").alias(value)), _image_size(pixels, by), by)
    rows = _smooth_axis(sized.drop("height"), value, "col", "width", weights, by).drop("width")
    again = attach(rows, _image_size(pixels, by).drop("width"), by)
    return _smooth_axis(again, value, "row", "height", weights, by).drop("height")


def kernel_signal_at_points(cells: DataFrame, pixels: DataFrame, value: str, sigma_um: float, pixel_um: float, baseline: DataFrame, by: Sequence[str] = (), out: str = "kernel_signal") -> DataFrame:
    """Smoothed signal above the baseline at each cell's pixel; ``baseline`` has by + mode."""
    if sigma_um <= 0:
        raise ValueError("sigma must be positive")
    lifted = attach(pixels, baseline, by).withColumn(out, excess_signal(F.col(value), F.col("mode")))
    smooth = gaussian_signal(lifted.select(*by, "row", "col", out), out, sigma_um / pixel_um, by)
    return cells.join(smooth.select(*by, "row", "col", out), [*by, "row", "col"], "left")


def disc(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


# The cross-shaped element of one step.
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _shifted(mask: DataFrame, element: Sequence[tuple[int, int]], by: list[str]) -> DataFrame:
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in element]))
    return mask.select(*by, "row", "col", "height", "width", offsets.alias("o"))


def dilate(mask: DataFrame, element: Sequence[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Grow a mask (by, row, col, height, width) within its image."""
    by = list(by)
    grown = _shifted(mask, element, by).selectExpr(*by, "CAST(row + o.r AS INT) AS row", "CAST(col + o.c AS INT) AS col", "height", "width")
    return grown.where("row >= 0 AND col >= 0 AND row < height AND col < width").distinct()


def erode(mask: DataFrame, element: Sequence[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Keep pixels whose whole neighbourhood is set; outside the image counts as unset."""
    by = list(by)
    votes = _shifted(mask, element, by).selectExpr(*by, "CAST(row - o.r AS INT) AS row", "CAST(col - o.c AS INT) AS col", "height", "width")
    votes = votes.where("row >= 0 AND col >= 0 AND row < height AND col < width")
    counted = votes.groupBy(*by, "row", "col", "height", "width").agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") == len(element)).drop("__n")


def mask_close(mask: DataFrame, radius_pixels: int, by: Sequence[str] = ()) -> DataFrame:
    """Closing with a disc: dilate, then erode."""
    if radius_pixels <= 0:
        return mask
    element = disc(radius_pixels)
    return erode(dilate(mask, element, by), element, by)


def structural_mask(pixels: DataFrame, candidate: Column, pixel_um: float, minimum_area_um2: float, closing_um: float = 1.7, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Components of candidate pixels that are large enough, closed with a disc.

    Returns the mask (by, row, col) and diagnostics per image.
    """
    by = list(by)
    if pixel_um <= 0 or minimum_area_um2 <= 0:
        raise ValueError("physical sizes must be positive")
    size = _image_size(pixels, by)
    minimum = max(1, math.ceil(minimum_area_um2 / pixel_um**2))
    raw = cut_lineage(pixel_components(pixels.where(candidate).select(*by, "row", "col"), by))
    kept = attach(keep_large(raw, minimum, by).select(*by, "row", "col"), size, by)
    closed = cut_lineage(mask_close(kept, max(0, round(closing_um / pixel_um)), by).select(*by, "row", "col"))
    retained = component_sizes(pixel_components(closed, by), by)
    counts = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("pixels"))
    raw_count = raw.groupBy(*by).agg(F.count_distinct("component").alias("raw_components"))
    kept_stats = summarise(
        retained, by, [F.count(F.lit(1)).alias("retained_components"), F.sum("pixels").alias("mask_pixels")],
        {"median_pixels": (F.col("pixels"), 0.5)},
    )
    joined = attach(attach(counts, raw_count, by), kept_stats, by).fillna(0, ["raw_components", "retained_components", "mask_pixels", "median_pixels"])
    diagnostics = joined.select(
        *by, F.lit(minimum).alias("minimum_component_pixels"), "raw_components", "retained_components",
        (F.col("mask_pixels") / F.col("pixels")).alias("pixel_fraction"),
        (F.col("median_pixels") * pixel_um**2).alias("median_component_area_um2"),
    )
    return closed, diagnostics


def mask_distance(pixels: DataFrame, mask: DataFrame, pixel_um: float = 1.0, by: Sequence[str] = (), out: str = "distance") -> DataFrame:
    """Distance of every pixel to the nearest mask pixel; NULL where the image has none."""
    return grid_nearest(pixels, mask, by, out=out, unit=pixel_um)


def band_of(distance: Column, bands: Sequence[tuple[float, float | None]] = BANDS) -> Column:
    result = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bands):
        inside = distance >= low if high is None else (distance >= low) & (distance < high)
        result = F.when(inside, F.lit(i)).otherwise(result)
    return result


def band_label(low: float, high: float | None) -> str:
    return f">={low:g}" if high is None else f"{low:g}-{high:g}"


def distance_band_summary(
    pixels: DataFrame, distance: str, signals: Sequence[str], by: Sequence[str] = (), valid: Column | None = None,
    bands: Sequence[tuple[float, float | None]] = BANDS, means: bool = False,
) -> DataFrame:
    """Pixels, median and 90th percentile (and mean) of each signal per band; empty bands are kept."""
    by = list(by)
    chosen = pixels if valid is None else pixels.where(valid)
    banded = chosen.withColumn("band", band_of(F.col(distance), bands)).where("band IS NOT NULL")
    quantiles = {}
    for s in signals:
        quantiles[f"{s}_median"] = (F.col(s), 0.5)
        quantiles[f"{s}_q90"] = (F.col(s), 0.9)
    aggregates = [F.count(F.lit(1)).alias("pixels")] + ([F.avg(s).alias(f"{s}_mean") for s in signals] if means else [])
    found = summarise(banded, [*by, "band"], aggregates, quantiles)
    labels = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(band_label(*b)).alias("distance_band_um")) for i, b in enumerate(bands)])
    groups = pixels.select(*by).distinct() if by else pixels.agg(F.count(F.lit(1)).alias("__all"))
    every = groups.select(*by, F.inline(labels))
    return every.join(found, [*by, "band"], "left").fillna(0, ["pixels"])


def segment_bright(pixels: DataFrame, value: str, by: Sequence[str] = (), quantile: float = 0.995, minimum_pixels: int = 20, floor: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Bright structures: scale by a quantile of positive values, Otsu of positives, drop small ones.

    Returns the mask (by, row, col) and the scale and threshold per image.
    """
    by = list(by)
    scale = summarise(pixels.where(F.col(value) > 0), by, [], {"scale": (F.col(value), quantile)})
    scaled = materialised(attach(pixels.select(*by, "row", "col", value), scale, by).withColumn("__s", clip(F.col(value) / F.col("scale"), 0.0, 1.0)))
    found = otsu_threshold(scaled.where("__s > 0"), "__s", by, empty=1.0, out="__t")
    level = found.select(*by, F.greatest(F.col("__t"), F.lit(floor)).alias("otsu_threshold"))
    bright = attach(scaled, level, by).where("__s >= otsu_threshold").select(*by, "row", "col")
    mask = bright if minimum_pixels <= 1 else keep_large(pixel_components(bright, by), minimum_pixels, by).select(*by, "row", "col")
    return mask, attach(level, scale, by)


def perfusion_signal(pixels: DataFrame, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Blue minus alpha times red over tissue, scaled by its 99th percentile, for every alpha.

    Adds ``alpha``, ``tissue``, ``perfusion_scale`` and ``perfusion``; all settings share one pass.
    """
    every = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    marked = materialised(pixels).withColumn("tissue", F.greatest("r", "g", "b") > 0).withColumn("alpha", every)
    marked = marked.withColumn("__c", F.greatest(F.col("b") - F.col("alpha") * F.col("r"), F.lit(0.0)))
    keys = [*by, "alpha"]
    scale = summarise(marked.where("tissue"), keys, [], {"perfusion_scale": (F.col("__c"), 0.99)})
    # Read several times by what follows: written once.
    return cut_lineage(attach(marked, scale, keys).withColumn("perfusion", clip(F.col("__c") / F.col("perfusion_scale"), 0.0, 1.0)).drop("__c"))


def near_far_ratio(pixels: DataFrame, distance: str, signal: str, width: int, by: Sequence[str] = (), stride: int = 1) -> DataFrame:
    """Mean below 10 over mean in [50, 100), and Spearman of distance and signal on every stride-th pixel."""
    by = list(by)
    pixels = materialised(pixels)
    d = F.col(distance)
    means = pixels.groupBy(*by).agg(
        F.avg(F.when(d < 10, F.col(signal))).alias("near_mean"), F.avg(F.when((d >= 50) & (d < 100), F.col(signal))).alias("far_mean")
    ).withColumn("near_to_far", F.when(F.col("far_mean") > 0, F.col("near_mean") / F.col("far_mean")))
    strided = pixels if stride <= 1 else pixels.where((F.col("row").cast("long") * width + F.col("col")) % stride == 0)
    return attach(means, spearman(strided, by, distance, signal, "distance_spearman"), by)


def perfusion_medians(images: DataFrame, by: Sequence[str] = ("alpha",), rho: str = "distance_spearman", ratio: str = "near_to_far") -> DataFrame:
    """Over the images of each setting: their number, agreement in sign and enrichment, and medians."""
    return summarise(images, by, [
        F.count(F.lit(1)).alias("images"),
        F.bool_and(F.coalesce(F.col(rho) < 0, F.lit(False))).alias("all_negative"),
        F.bool_and(F.coalesce(F.col(ratio) > 1, F.lit(False))).alias("all_near_enriched"),
    ], {f"median_{rho}": (F.col(rho), 0.5), f"median_{ratio}": (F.col(ratio), 0.5)})


def perfusion_robustness(settings: DataFrame, by: Sequence[str], rho: str = "distance_spearman", ratio: str = "near_to_far") -> DataFrame:
    """Per image over correction settings: all correlations negative, all ratios above 1, ranges."""
    return settings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("settings"),
        F.bool_and(F.coalesce(F.col(rho) < 0, F.lit(False))).alias("all_negative"),
        F.bool_and(F.coalesce(F.col(ratio) > 1, F.lit(False))).alias("all_near_enriched"),
        F.min(rho).alias("min_rho"), F.max(rho).alias("max_rho"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
    )


# Published haematoxylin, eosin and DAB absorbance rows of the stain matrix.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def stain_density(index: int, r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Non-negative optical density of one stain (0 haematoxylin, 1 eosin, 2 DAB) of 8-bit colour."""
    unmix = np.linalg.inv(np.array(STAINS))[:, index]
    low = math.log(1e-6)
    total = F.lit(0.0)
    for name, weight in zip((r, g, b), unmix):
        total = total + F.log(F.greatest(F.col(name) / 255.0, F.lit(1e-6))) / low * float(weight)
    return F.greatest(total, F.lit(0.0))


def brown_index(r: str = "r", g: str = "g", b: str = "b") -> Column:
    red, green, blue = (F.col(c) / 255.0 for c in (r, g, b))
    return F.greatest((red - blue) + 0.5 * (green - blue), F.lit(0.0))


def stain_features(pixels: DataFrame, mask: Column, by: Sequence[str] = ()) -> DataFrame:
    """DAB and brown quantiles inside the mask and the share of masked pixels."""
    measured = pixels.select(*by, mask.alias("__m"), stain_density(2).alias("__d"), brown_index().alias("__b"))
    dab, brown = F.when(F.col("__m"), F.col("__d")), F.when(F.col("__m"), F.col("__b"))
    return summarise(measured, by, [F.avg(F.col("__m").cast("double")).alias("mask_fraction")], {
        "dab_median": (dab, 0.5), "dab_q90": (dab, 0.9), "dab_q95": (dab, 0.95), "brown_median": (brown, 0.5), "brown_q90": (brown, 0.9),
    })


def region_morphology(pixels: DataFrame, region: str, tissue: str, stains: Sequence[str], candidate: str, pixel_area_um2: float, by: Sequence[str] = ()) -> DataFrame:
    """Pixels, tissue share and area, stain statistics and candidate share per region."""
    named = pixels.withColumn("region", F.coalesce(F.col(region), F.lit("UNANNOTATED")))
    quantiles: dict[str, tuple[Column, float]] = {}
    means = []
    for s in stains:
        inside = F.when(F.col(tissue), F.col(s))
        means.append(F.avg(inside).alias(f"{s}_mean"))
        for label, q in (("median", 0.5), ("q10", 0.1), ("q90", 0.9)):
            quantiles[f"{s}_{label}"] = (inside, q)
    found = summarise(named, [*by, "region"], [
        F.count(F.lit(1)).alias("region_pixels"), F.count_if(F.col(tissue)).alias("tissue_pixels"),
        F.count_if(F.col(candidate)).alias("candidate_pixels"), *means,
    ], quantiles)
    tissue_pixels = F.when(F.col("tissue_pixels") > 0, F.col("tissue_pixels"))
    return found.withColumns({
        "tissue_fraction": F.col("tissue_pixels") / F.col("region_pixels"),
        "tissue_area_mm2": F.col("tissue_pixels") * (pixel_area_um2 / 1e6),
        "candidate_fraction": F.col("candidate_pixels") / tissue_pixels,
    })


def background_correlation(signal: DataFrame, background: DataFrame, value: str, width: int, by: Sequence[str] = (), stride: int = 50) -> DataFrame:
    """Spearman of the residual signal against background, on all and on low-signal pixels.

    Images without a background get status ``NOT_COMPUTED``.
    """
    by = list(by)
    mode = image_mode(signal, value, by, F.col(value) > 0)
    residual = attach(signal, mode, by).withColumn("residual", excess_signal(F.col(value), F.col("mode")))
    joined = residual.join(background.select(*by, "row", "col", "background"), [*by, "row", "col"])
    strided = materialised(joined.where((F.col("row").cast("long") * width + F.col("col")) % stride == 0).select(*by, "residual", "background"))
    low = attach(strided, summarise(strided, by, [], {"__q": (F.col("residual"), 0.9)}), by).where("residual <= __q")
    every = spearman(strided, by, "residual", "background", "spearman_all").drop("pairs")
    few = spearman(low, by, "residual", "background", "spearman_low_signal").drop("pairs")
    groups = signal.select(*by).distinct() if by else signal.agg(F.count(F.lit(1)).alias("__n"))
    seen = background.select(*by).distinct().withColumn("__has", F.lit(True)) if by else background.agg((F.count(F.lit(1)) > 0).alias("__has"))
    result = attach(attach(attach(groups, seen, by), every, by), few, by)
    has = F.coalesce(F.col("__has"), F.lit(False))
    return result.select(
        *by, F.when(has, "COMPUTED_RELATIVE_QC").otherwise("NOT_COMPUTED").alias("status"),
        F.when(~has, "MATCHED_BACKGROUND_QC_IMAGE_NOT_PROVIDED").alias("reason"), "spearman_all", "spearman_low_signal",
    )


def tissue_mask_colour(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixels whose colour is far from the median border colour, cleaned of small specks."""
    by = list(by)
    sized = materialised(attach(pixels, _image_size(pixels, by), by))
    edge = F.greatest(F.lit(4), F.floor(F.least("height", "width") / 50))
    rows = (F.col("row") < edge) | (F.col("row") >= F.col("height") - edge)
    cols = (F.col("col") < edge) | (F.col("col") >= F.col("width") - edge)
    # Corner pixels belong to both border strips and count twice.
    border = sized.where(rows).unionByName(sized.where(cols))
    medians = summarise(border, by, [], {"mr": (F.col("r"), 0.5), "mg": (F.col("g"), 0.5), "mb": (F.col("b"), 0.5)})
    far = F.expr("sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2))")
    away = attach(border, medians, by).withColumn("__d", far)
    level = summarise(away, by, [], {"__q": (F.col("__d"), 0.95)})
    raw = attach(attach(sized, medians, by), level, by).withColumn("__d", far).where(F.col("__d") > F.greatest(F.lit(12.0), F.col("__q") + 4.0))
    mask = raw.select(*by, "row", "col", "height", "width")
    for step in (dilate, dilate, erode, erode, erode, dilate):
        mask = step(mask, CROSS, by)
    components = pixel_components(cut_lineage(mask), by)
    sizes = attach(component_sizes(components, by), _image_size(pixels, by), by)
    large = sizes.where(F.col("pixels") >= F.greatest(F.lit(64), F.floor(F.lit(0.00005) * F.col("height") * F.col("width"))))
    return components.join(large, [*by, "component"], "left_semi").select(*by, "row", "col")


def intensity_features(pixels: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, 90th percentile, Otsu threshold and share above it after scaling by max(q99, 1)."""
    scale = summarise(pixels, by, [], {"__q99": (F.col(value), 0.99)})
    scaled = materialised(attach(pixels.select(*by, value), scale, by).withColumn("__s", clip(F.col(value) / F.greatest("__q99", F.lit(1.0)), 0.0, 1.0)))
    varied = scaled.groupBy(*by).agg((F.min("__s") < F.max("__s")).alias("__varied"))
    level = attach(otsu_threshold(scaled, "__s", by, out="__t"), varied, by).withColumn("threshold", F.when(F.col("__varied"), F.col("__t")).otherwise(F.lit(0.0)))
    marked = attach(scaled, level.select(*by, "threshold"), by)
    return summarise(marked, by, [
        F.avg("__s").alias("intensity_mean"), F.max("threshold").alias("otsu_threshold"),
        F.avg((F.col("__s") > F.col("threshold")).cast("double")).alias("positive_fraction"),
    ], {"intensity_q90": (F.col("__s"), 0.9)})


def panel_distance_features(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance of green-positive pixels to red structures as a share of the image diagonal."""
    by = list(by)
    limits = summarise(pixels, by, [], {
        "__rq": (F.when(F.col("r") > 0, F.col("r")), 0.6), "__gq": (F.when(F.col("g") > 0, F.col("g")), 0.99),
    })
    red = (F.col("r") >= F.greatest(F.lit(5.0), F.col("__rq"))) & (F.col("r") > 1.1 * F.col("g")) & (F.col("r") > 1.1 * F.col("b"))
    marked = materialised(attach(pixels, limits, by).select(*by, "row", "col", red.alias("vessel"), (clip(F.col("g") / F.col("__gq"), 0.0, 1.0) > 0.2).alias("positive")))
    measured = grid_nearest(marked, marked.where("vessel"), by, out="__d")
    # As doubles: squares of sizes beyond 46,340 do not fit the integers of the coordinates.
    height, width = F.col("height").cast("double"), F.col("width").cast("double")
    share = F.when(F.col("positive"), F.col("__d") / F.sqrt(height * height + width * width))
    placed = attach(measured, _image_size(pixels, by), by).withColumn("__share", share)
    return summarise(placed, by, [
        F.avg(F.col("vessel").cast("double")).alias("vascular_fraction"), F.avg(F.col("positive").cast("double")).alias("positive_fraction"),
        F.avg("__share").alias("distance_mean"),
    ], {"distance_median": (F.col("__share"), 0.5), "distance_q90": (F.col("__share"), 0.9)})
