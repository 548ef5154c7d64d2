"""Robust scales, Otsu thresholds, group scores and positive calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip
from tessella.operators.order import summarise
from tessella.session import attach, attach_few, materialised


def robust_scale(df: DataFrame, values: Mapping[str, str], by: Sequence[str] = (), lower: float = 0.05, upper: float = 0.99) -> DataFrame:
    """log1p, then the [lower, upper] quantile range to [0, 1]; a flat range gives 0.

    ``values`` maps input columns to output columns; all share one pass for the quantiles.
    """
    df = materialised(df)
    logs = {c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in values}
    wanted = {}
    for c in values:
        wanted[f"__lo_{c}"] = (logs[c], lower)
        wanted[f"__hi_{c}"] = (logs[c], upper)
    stats = summarise(df, by, [], wanted)
    scaled = attach(df, stats, by)
    outputs = {}
    for c, out in values.items():
        low, high = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        outputs[out] = F.when(high > low, clip((logs[c] - low) / (high - low), 0.0, 1.0)).otherwise(
            F.when(logs[c].isNotNull(), F.lit(0.0))
        )
    return scaled.withColumns(outputs).drop(*wanted)


def otsu_threshold(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 256, empty: float = 0.5, out: str = "threshold") -> DataFrame:
    """Otsu threshold per group from an equal-width histogram; the first best bin wins.

    Rows are reduced to ``bins`` counts per group before anything is ordered.  Without keys the
    result always has one row, ``empty`` when there is no finite value.
    """
    by = list(by)
    finite = df.select(*by, F.col(value).cast("double").alias("__v")).where(
        "__v IS NOT NULL AND NOT isnan(__v) AND abs(__v) < double('Infinity')"
    )
    limits = finite.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    placed = attach(finite, limits, by).where("__hi > __lo")
    step = f"((__hi - __lo) / {bins}D)"
    guess = f"least(CAST(floor((__v - __lo) / (__hi - __lo) * {bins}D) AS INT), {bins - 1})"
    placed = placed.selectExpr(*by, "__v", "__lo", "__hi", f"{guess} AS __g")
    exact = (
        f"CASE WHEN __v < __lo + __g * {step} THEN __g - 1"
        f" WHEN __g < {bins - 1} AND __v >= __lo + (__g + 1) * {step} THEN __g + 1 ELSE __g END"
    )
    counts = placed.groupBy(*by, "__lo", "__hi", F.expr(exact).alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    upper = f"(CASE WHEN __bin = {bins - 1} THEN __hi ELSE __lo + (__bin + 1) * {step} END)"
    counts = counts.withColumn("__c", F.expr(f"((__lo + __bin * {step}) + {upper}) / 2D"))
    upto = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    weighted = F.col("__n") * F.col("__c")
    cumulative = counts.select(
        *by, "__bin", "__c", F.sum("__n").over(upto).alias("__cn"), F.sum("__n").over(whole).alias("__tn"),
        F.sum(weighted).over(upto).alias("__cm"), F.sum(weighted).over(whole).alias("__tm"),
    )
    w = F.col("__cn") / F.col("__tn")
    between = F.pow(F.col("__tm") / F.col("__tn") * w - F.col("__cm") / F.col("__tn"), 2) / (w * (1 - w))
    # Only the last bin reaches the full count; it separates nothing and must not win.
    score = F.when(F.col("__cn") < F.col("__tn"), between).otherwise(F.lit(0.0))
    best = cumulative.groupBy(*by).agg(F.max_by("__c", F.struct(score, -F.col("__bin"))).alias("__best"))
    found = attach(limits, best, by) if by else limits.join(best, F.lit(True), "left")
    value_expr = F.when(F.col("__lo").isNull(), F.lit(empty)).when(F.col("__hi") <= F.col("__lo"), F.col("__hi")).otherwise(F.col("__best"))
    return found.select(*by, value_expr.alias(out))


def threshold_aligned(value: Column, threshold: Column) -> Column:
    """Piecewise-linear scale of [0, 1] that puts the threshold at exactly 0.5."""
    v, t = clip(value, 0.0, 1.0), clip(threshold, 1e-6, 1.0 - 1e-6)
    return F.when(v <= t, 0.5 * v / t).otherwise(0.5 + 0.5 * (v - t) / (1.0 - t))


def group_score(df: DataFrame, groups: Mapping[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Mean robust scale of the marker columns of each group; a group without columns scores 0."""
    columns = sorted({c for members in groups.values() for c in members})
    scaled = robust_scale(df, {c: f"__s_{c}" for c in columns}, by) if columns else df
    outputs = {}
    for name, members in groups.items():
        total = F.lit(0.0)
        for c in members:
            total = total + F.col(f"__s_{c}")
        outputs[name] = total / max(len(members), 1)
    return scaled.withColumns(outputs).drop(*[f"__s_{c}" for c in columns])


def with_threshold(df: DataFrame, value: str, low: float, high: float, out: str, by: Sequence[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """Add the Otsu threshold of ``value``, clipped to [low, high], as a column.

    ``seen``, if given, holds the same values in a table that is cheaper to read; then ``df`` is not written out.
    """
    df = materialised(df) if seen is None else df
    found = otsu_threshold(df if seen is None else seen, value, by, out="__t")
    return attach_few(df, found.select(*by, clip(F.col("__t"), low, high).alias(out)), by)


def vessel_call(
    df: DataFrame, endothelial: str, pericyte: str, by: Sequence[str] = (), minimum_share: float = 0.001
) -> DataFrame:
    """Source signal and call; a nearly empty call falls back to the 99th percentile.

    Adds ``vessel_raw``, ``vessel_threshold``, ``vessel_signal`` and ``vessel_positive``.
    """
    raw = materialised(df).withColumn("vessel_raw", F.greatest(F.col(endothelial), F.lit(0.5) * F.col(pericyte)))
    called = with_threshold(raw, "vessel_raw", 0.25, 0.85, "__otsu", by)
    share = summarise(
        called, by,
        [F.avg((threshold_aligned(F.col("vessel_raw"), F.col("__otsu")) >= 0.5).cast("double")).alias("__share")],
        {"__q99": (F.col("vessel_raw"), 0.99)},
    )
    both = attach(called, share, by)
    fallback = F.col("__share") < minimum_share
    used = F.when(fallback, F.greatest(F.col("__q99"), F.lit(1e-6))).otherwise(F.col("__otsu"))
    signal = threshold_aligned(F.col("vessel_raw"), used)
    return both.withColumns({
        "vessel_threshold": F.when(fallback, F.col("__q99")).otherwise(F.col("__otsu")),
        "vessel_signal": signal, "vessel_positive": signal >= 0.5,
    }).drop("__otsu", "__share", "__q99")


def malignant_proxy(df: DataFrame, score: str, by: Sequence[str] = (), out: str = "cell_is_malignant_proxy", seen: DataFrame | None = None) -> DataFrame:
    """Positive where the score reaches its Otsu threshold clipped to [0.20, 0.85]; ``seen`` as in ``with_threshold``."""
    called = with_threshold(df, score, 0.20, 0.85, "malignant_threshold", by, seen)
    return called.withColumn(out, F.col(score) >= F.col("malignant_threshold"))


def prefer_protein(resolved: DataFrame, target: str = "target", column: str = "column") -> DataFrame:
    """Per target: protein columns if there are any, otherwise the RNA columns."""
    protein = F.col(column).startswith("protein__")
    has = F.max(protein).over(Window.partitionBy(target))
    return resolved.withColumn("__has", has).where(protein | ~F.col("__has")).withColumn(
        "measurement", F.when(F.col("__has"), "protein_intensity").otherwise("rna_proxy")
    ).drop("__has")


def target_call(long: DataFrame, target: str = "target", value: str = "raw", by: Sequence[str] = ()) -> DataFrame:
    """Signal and call per (cell, target): group score against its Otsu clipped to [0.10, 0.90]."""
    keys = [*by, target]
    called = with_threshold(long, value, 0.10, 0.90, "raw_threshold", keys)
    signal = threshold_aligned(F.col(value), F.col("raw_threshold"))
    return called.withColumns({"signal": signal, "positive": signal >= 0.5})


def marker_count_call(df: DataFrame, markers: Sequence[str], definitions: Mapping[str, int], minimum: int = 4) -> DataFrame:
    """One row per (row, definition): source when enough markers are above zero."""
    if len(markers) < minimum:
        raise ValueError(f"at least {minimum} markers are required")
    count = F.lit(0)
    for m in markers:
        count = count + F.coalesce((F.col(m) > 0).cast("int"), F.lit(0))
    table = F.array(*[
        F.struct(F.lit(name).alias("definition"), F.lit(min(need, len(markers))).alias("required"))
        for name, need in definitions.items()
    ])
    counted = df.withColumn("marker_count", count)
    return counted.select("*", F.inline(table)).withColumn("proxy", F.col("marker_count") >= F.col("required"))


def definition_rows(df: DataFrame, definitions: Mapping[str, Column]) -> DataFrame:
    """One row per (row, definition) with the boolean ``source``."""
    items = F.array(*[
        F.struct(F.lit(name).alias("definition"), F.coalesce(mask, F.lit(False)).alias("source"))
        for name, mask in definitions.items()
    ])
    return df.select("*", F.inline(items))


def definition_masks(df: DataFrame, cd31: str, endothelial: str, inclusive: str, rna: Sequence[str]) -> DataFrame:
    """Six source definitions from a protein scale, a score and RNA marker counts."""
    df = materialised(df)
    data = robust_scale(df, {cd31: "__cd31"})
    limits = [
        otsu_threshold(data, "__cd31", out="__t").select(clip(F.col("__t"), 0.10, 0.90).alias("__t_cd31")),
        otsu_threshold(data, endothelial, out="__t").select(clip(F.col("__t"), 0.10, 0.90).alias("__t_endo")),
    ]
    data = attach(attach(data, limits[0]), limits[1])
    count = F.lit(0)
    for marker in rna:
        count = count + (F.col(marker) > 0).cast("int")
    high = F.col("__cd31") >= F.col("__t_cd31")
    rows = definition_rows(data, {
        "inclusive_endothelial_or_pericyte": F.col(inclusive),
        "endothelial_score_otsu": F.col(endothelial) >= F.col("__t_endo"),
        "cd31_otsu": high,
        "cd31_high_robust_0_5": F.col("__cd31") >= 0.5,
        "cd31_plus_any_endothelial_rna": high & (count >= 1),
        "cd31_plus_two_endothelial_rna": high & (count >= 2),
    })
    return rows.drop("__cd31", "__t_cd31", "__t_endo")


def reference_positive(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "reference_positive") -> DataFrame:
    """Robust scale, unclipped Otsu, positive at or above it."""
    scaled = materialised(robust_scale(df, {value: "__scaled"}, by))
    found = otsu_threshold(scaled, "__scaled", by, out="reference_threshold")
    called = attach_few(scaled, found, by)
    return called.withColumn(out, F.col("__scaled") >= F.col("reference_threshold")).drop("__scaled")


def calibrate_threshold(df: DataFrame, sample: str, positive: str, quantile: float = 0.995, by: Sequence[str] = ()) -> DataFrame:
    """Threshold at a quantile of reference-negative samples, with error rates.

    Groups without both classes get NULLs and status ``NOT_COMPUTED``.
    """
    if not 0.5 < quantile < 1.0:
        raise ValueError("quantile must lie between 0.5 and 1")
    level = summarise(df, by, [], {"image_threshold": (F.when(~F.col(positive), F.col(sample)), quantile)})
    called = attach(df, level, by).withColumn("__hit", (F.col(sample) > F.col("image_threshold")).cast("double"))
    rates = called.groupBy(*by).agg(
        F.first("image_threshold").alias("image_threshold"),
        F.avg(F.col(positive).cast("double")).alias("reference_positive_fraction"),
        F.avg("__hit").alias("image_positive_fraction"),
        F.avg(F.when(~F.col(positive), F.col("__hit"))).alias("false_positive_rate"),
        F.avg(F.when(F.col(positive), F.col("__hit"))).alias("true_positive_rate"),
        F.count_if(F.col(positive)).alias("__positives"), F.count_if(~F.col(positive)).alias("__negatives"),
    )
    both = (F.col("__positives") > 0) & (F.col("__negatives") > 0)
    numbers = [c for c in rates.columns if c not in (*by, "__positives", "__negatives")]
    return rates.select(*by, *[F.when(both, F.col(c)).alias(c) for c in numbers], F.when(both, "COMPUTED").otherwise("NOT_COMPUTED").alias("status"))


def minmax_scale(df: DataFrame, value: str, out: str, by: Sequence[str] = (), higher_is_better: bool = True) -> DataFrame:
    """Min-max to [0, 1] per group; a range up to 1e-15 gives 0.5."""
    limits = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = attach(df, limits, by)
    span = F.col("__hi") - F.col("__lo")
    scaled = (F.col(value) - F.col("__lo")) / span
    scaled = scaled if higher_is_better else 1.0 - scaled
    return joined.withColumn(out, F.when(span <= 1e-15, F.lit(0.5)).otherwise(scaled)).drop("__lo", "__hi")


def scoring_diagnostics(scored: DataFrame, positive: str, threshold: str, by: Sequence[str]) -> DataFrame:
    """Threshold, positive count and share per group, with a warning for empty calls."""
    result = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.max(threshold).alias("threshold"),
        F.count_if(F.col(positive)).alias("positive_cells"), F.avg(F.col(positive).cast("double")).alias("positive_fraction"),
    )
    return result.withColumn("warning", F.when(F.col("positive_cells") == 0, "NO_POSITIVE_CELLS").otherwise(""))
