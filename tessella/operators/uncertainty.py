"""Hash-driven Monte Carlo: ranking, parameter draws, sensitivity indices and decisions.

Every random number is a hash of the seed, the draw and a slot, so results do not depend on
partitioning and an SQL engine can reproduce them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import effective_diffusion, failed_conditions, joined, row_status, uniform
from tessella.operators.order import summarise, value_positions
from tessella.operators.scaling import minmax_scale
from tessella.session import BROADCAST_ROWS_DEFAULT, attach, deal, materialised
from tessella.sources.quality import DataQualityError

COMPONENTS = ("coverage", "proximity", "near_source")


def component_matrix(rows: DataFrame, by: Sequence[str] = (), coverage: str = "positive_fraction", distance: str = "target_median", near: str = "within_50") -> DataFrame:
    """Min-max components per definition; every definition must cover the same targets, no NULLs."""
    keys = [*by, "definition"]
    rows = materialised(rows.select(*keys, "target", coverage, distance, near))
    shape = rows.groupBy(*keys).agg(
        F.count_distinct("target").alias("targets"), F.count_if(F.col(coverage).isNull() | F.col(distance).isNull() | F.col(near).isNull()).alias("gaps")
    )
    whole = rows.groupBy(*by).agg(F.count_distinct("target").alias("expected"))
    bad = attach(shape, whole, by).where("targets <> expected OR gaps > 0").limit(1)
    if not bad.isEmpty():
        raise DataQualityError(f"definitions do not cover the same targets completely: {bad.first()}")
    scaled = minmax_scale(rows, coverage, "coverage", keys)
    scaled = minmax_scale(scaled, distance, "proximity", keys, higher_is_better=False)
    return minmax_scale(scaled, near, "near_source", keys).select(*keys, "target", *COMPONENTS)


def rank_draws(components: DataFrame, draws: int, seed: int, by: Sequence[str] = (), omit: bool = False) -> DataFrame:
    """Scores and ranks of all targets in every draw: by, (omitted,) draw, target, score, rank.

    A draw picks a definition uniformly and Dirichlet(1, 1, 1) weights; ties rank by target name.
    With ``omit`` every component is left out in turn under its own seed.
    """
    if draws < 100:
        raise ValueError("at least 100 draws are required")
    by = list(by)
    definitions = components.select(*by, "definition").distinct().groupBy(*by).agg(F.array_sort(F.collect_list("definition")).alias("__defs"))
    spread = definitions.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    if omit:
        names = F.array(*[F.struct(F.lit(c).alias("omitted"), F.lit(seed + i + 1).alias("__seed")) for i, c in enumerate(COMPONENTS)])
        spread = spread.select("*", F.inline(names))
    else:
        spread = spread.withColumn("__seed", F.lit(seed))
    slot = [F.col(b) for b in by]

    def u(name: str) -> Column:
        return uniform("rank", F.col("__seed"), F.col("draw"), *slot, F.lit(name))

    chosen = F.element_at("__defs", (F.floor(u("definition") * F.size("__defs")) + 1).cast("int"))
    weights = {c: -F.log(1.0 - u(c)) for c in COMPONENTS}
    if omit:
        weights = {c: F.when(F.col("omitted") == c, F.lit(0.0)).otherwise(w) for c, w in weights.items()}
    spread = spread.select("*", chosen.alias("definition"), *[w.alias("__w_" + c) for c, w in weights.items()]).drop("__defs", "__seed")
    drawn = spread.join(components, [*by, "definition"])
    total = F.col("__w_coverage") + F.col("__w_proximity") + F.col("__w_near_source")
    score = F.lit(0.0)
    for c in COMPONENTS:
        score = score + F.col("__w_" + c) * F.col(c)
    keys = [*by, *(["omitted"] if omit else []), "draw"]
    scored = drawn.select(*keys, "target", (score / total).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "target")
    return scored.withColumn("rank", F.row_number().over(order))


def rank_summary(draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probability of rank 1 and median, q05, q95 of rank and score per target."""
    rank, score = F.col("rank").cast("double"), F.col("score")
    return summarise(draws, [*by, "target"], [F.avg((F.col("rank") == 1).cast("double")).alias("top_rank_probability")], {
        "median_rank": (rank, 0.5), "rank_q05": (rank, 0.05), "rank_q95": (rank, 0.95),
        "score_median": (score, 0.5), "score_q05": (score, 0.05), "score_q95": (score, 0.95),
    })


def pairwise_win(draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probability that the left target scores strictly higher; 0.5 on the diagonal.

    The output itself is the target-by-target matrix, so pairs are formed within a draw only.
    """
    keys = [*by, "draw"]
    draws = materialised(draws)
    left = draws.select(*keys, F.col("target").alias("left_target"), F.col("score").alias("l"))
    right = draws.select(*keys, F.col("target").alias("right_target"), F.col("score").alias("r"))
    won = F.when(F.col("left_target") == F.col("right_target"), F.lit(0.5)).otherwise((F.col("l") > F.col("r")).cast("double"))
    return left.join(right, keys).groupBy(*by, "left_target", "right_target").agg(F.avg(won).alias("win_probability"))


def leave_one_out(components: DataFrame, draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Probability of rank 1 when each component is left out, on max(2000, draws / 5) draws."""
    ranks = rank_draws(components, max(2000, draws // 5), seed, by, omit=True)
    return ranks.groupBy(*by, "omitted", "target").agg(F.avg((F.col("rank") == 1).cast("double")).alias("top_rank_probability"))


def stable_winner(summary: DataFrame, threshold: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Most probable winner, named only when its probability reaches the threshold."""
    if not 0.5 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0.5, 1]")
    best = summary.groupBy(*by).agg(
        F.min_by("target", F.struct(-F.col("top_rank_probability"), F.col("target"))).alias("leader"), F.max("top_rank_probability").alias("probability")
    )
    stable = F.col("probability") >= threshold
    return best.select(*by, "leader", "probability", F.when(stable, F.col("leader")).alias("stable_target"), F.when(stable, "STABLE").otherwise("NO_STABLE_TARGET").alias("status"))


def check_ranges(ranges: DataFrame) -> DataFrame:
    bad = ranges.where("low > high OR (distribution = 'loguniform' AND low <= 0) OR distribution NOT IN ('uniform', 'loguniform')").limit(1)
    if not bad.isEmpty():
        raise DataQualityError(f"invalid parameter range: {bad.first()}")
    return ranges


def scale_to_range(u: Column) -> Column:
    """Unit-interval number to a declared range (columns low, high, distribution)."""
    log = F.exp(F.log("low") + u * (F.log("high") - F.log("low")))
    return F.when(F.col("distribution") == "loguniform", log).otherwise(F.col("low") + u * (F.col("high") - F.col("low")))


def parameter_draws(ranges: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, name, value) for every declared range."""
    checked = check_ranges(ranges).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return checked.select("draw", "name", scale_to_range(uniform(seed, F.col("draw"), F.col("name"))).alias("value"))


def interval(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median with the 5th and 95th percentiles."""
    v = F.col(value)
    return summarise(df, by, [], {"median": (v, 0.5), "lower": (v, 0.05), "upper": (v, 0.95)})


def sobol_design(samples: DataFrame, ranges: DataFrame, seed: int, sample: str = "sample") -> DataFrame:
    """Matrices A, B and A-with-one-column-of-B as long rows (sample, matrix, name, value).

    Matrix ``AB:p`` takes parameter p from B and everything else from A.
    """
    ranges = materialised(ranges)
    names = check_ranges(ranges).groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "low", "high", "distribution"))).alias("__p"))
    number = ranges.count()
    spread = attach(deal(materialised(samples.select(sample)), number * (number + 2)), names)
    matrices = F.concat(F.array(F.lit("A"), F.lit("B")), F.transform("__p", lambda p: F.concat(F.lit("AB:"), p["name"])))
    rows = spread.select(sample, F.explode(matrices).alias("matrix"), "__p").select(sample, "matrix", F.inline("__p"))
    from_b = (F.col("matrix") == "B") | (F.col("matrix") == F.concat(F.lit("AB:"), F.col("name")))
    source = F.when(from_b, "B").otherwise("A")
    return rows.select(sample, "matrix", "name", scale_to_range(uniform(seed, source, F.col(sample), F.col("name"))).alias("value"))


def sobol_indices(outputs: DataFrame, by: Sequence[str] = (), sample: str = "sample", value: str = "y") -> DataFrame:
    """First-order and total indices per parameter; a flat output is DEGENERATE."""
    by = list(by)
    outputs = materialised(outputs)
    ab = outputs.where(F.col("matrix").isin("A", "B"))
    spread = ab.groupBy(*by).agg(F.var_samp(value).alias("__var"))
    base = ab.groupBy(*by, sample).agg(F.max(F.when(F.col("matrix") == "A", F.col(value))).alias("ya"), F.max(F.when(F.col("matrix") == "B", F.col(value))).alias("yb"))
    mixed = outputs.where(F.col("matrix").startswith("AB:")).select(*by, sample, F.expr("substring(matrix, 4)").alias("parameter"), F.col(value).alias("yab"))
    sums = mixed.join(base, [*by, sample]).groupBy(*by, "parameter").agg(
        F.avg(F.col("yb") * (F.col("yab") - F.col("ya"))).alias("__f"), F.avg(F.pow(F.col("ya") - F.col("yab"), 2)).alias("__t")
    )
    flat = F.coalesce(F.col("__var"), F.lit(0.0)) <= 1e-15
    return attach(sums, spread, by).select(
        *by, "parameter", F.when(~flat, F.least(F.greatest(F.col("__f") / F.col("__var"), F.lit(-1.0)), F.lit(1.0))).alias("first_order"),
        F.when(~flat, F.least(F.greatest(0.5 * F.col("__t") / F.col("__var"), F.lit(0.0)), F.lit(1.5))).alias("total_order"),
        F.when(flat, "DEGENERATE").otherwise("COMPUTED").alias("status"),
    )


def reach_metrics(cells: DataFrame, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per draw: target share, reachable share, population reach, gap and penetration depth.

    ``cells``: by, draw, is_tumour, target_positive, distance, bound_fraction.
    """
    target = F.col("is_tumour") & F.col("target_positive")
    reached = target & (F.col("bound_fraction") >= threshold)
    counts = cells.groupBy(*by, "draw").agg(
        F.count_if("is_tumour").alias("tumour_cells"), F.count_if(target).alias("target_cells"), F.count_if(reached).alias("reached_cells"),
        F.coalesce(F.max(F.when(reached, F.col("distance"))), F.lit(0.0)).alias("penetration"),
    )
    tumour = F.when(F.col("tumour_cells") > 0, F.col("tumour_cells"))
    share = F.coalesce(F.col("target_cells") / tumour, F.lit(0.0))
    reach = F.col("reached_cells") / F.when(F.col("target_cells") > 0, F.col("target_cells"))
    return counts.withColumns({
        "target_fraction": share, "reachable": reach, "population_reachable": share * reach, "gap": share * (1.0 - reach),
    })


def reach_index(draws: DataFrame, by: Sequence[str] = (), decision: float = 0.5, extra: dict[str, Column] | None = None) -> DataFrame:
    """Intervals of the reach metrics and the decision status of every group.

    The status is OK only if targets exist, no extra condition holds and the interval of the
    reachable share lies on one side of the decision threshold.
    """
    quantiles = {}
    for m in ("reachable", "population_reachable", "gap", "penetration"):
        for label, q in (("median", 0.5), ("lower", 0.05), ("upper", 0.95)):
            quantiles[f"{m}_{label}"] = (F.col(m).cast("double"), q)
    found = summarise(draws, by, [F.count(F.lit(1)).alias("draws"), F.max("target_cells").alias("target_cells")], quantiles)
    return decision_status(found, "reachable_lower", "reachable_upper", decision, {"NO_TARGET_POSITIVE_CELLS": F.col("target_cells") == 0, **(extra or {})})


def decision_status(df: DataFrame, lower: str, upper: str, threshold: float, extra: dict[str, Column] | None = None) -> DataFrame:
    """Reasons and status: stable only when the interval does not straddle the threshold."""
    straddles = (F.col(lower) < threshold) & (F.col(upper) >= threshold)
    reasons = failed_conditions({**(extra or {}), "DECISION_UNSTABLE": F.coalesce(straddles, F.lit(False))})
    return df.withColumn("__r", reasons).withColumn("status", row_status(F.col("__r"))).withColumn("reasons", joined(F.col("__r"))).drop("__r")


# Barrier names in tie-breaking order.
BARRIERS = ("vascular_distance", "matrix_fibroblast", "binding_site")


def barrier_penalties(cells: DataFrame, draws: DataFrame, by: Sequence[str] = (), spacing: float = 1.0) -> DataFrame:
    """Penalties of the three barriers for every group of target cells and every draw of the parameters.

    ``cells``: by, ``antigen``, ``vessel_distance``, ``ecm``, ``caf``. ``draws``: ``draw``, ``diffusion``, ``beta_ecm``,
    ``beta_caf``, ``clearance``, ``internalisation``, ``kd``, ``vessel_concentration``, ``calibration``; a declared table
    of parameters. Penalties rest on medians over the cells. Only the effective diffusion depends on the draw, and only
    through (ecm, caf), so cells are counted by that pair before they meet the draws. ``spacing`` is the least
    penetration length. NULL where a group has no measured cell.
    """
    by = list(by)
    if draws.count() > BROADCAST_ROWS_DEFAULT:
        raise ValueError("too many draws for one table of parameters")
    middle = summarise(cells, by, [], {"__antigen": (F.col("antigen"), 0.5), "__far": (F.col("vessel_distance"), 0.5)})
    pairs = cells.groupBy(*by, "ecm", "caf").agg(F.count(F.lit(1)).alias("__w")).crossJoin(F.broadcast(draws))
    spread = effective_diffusion(F.col("diffusion"), F.col("ecm"), F.col("caf"), F.col("beta_ecm"), F.col("beta_caf"))
    ranked = value_positions(pairs.withColumn("__e", spread), [*by, "draw"], "__e", "__w")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("count")), F.col("value")))

    half = (F.col("total") - 1) / 2
    found = ranked.groupBy(*by, "draw").agg(((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("__e")).join(F.broadcast(draws), "draw")
    found = attach(found, middle, by)
    through, antigen = F.greatest(F.col("__e"), F.lit(1e-12)), F.col("__antigen") * F.col("calibration")
    held = F.col("internalisation") * antigen / (F.col("kd") + F.col("vessel_concentration"))
    reach = F.greatest(F.sqrt(F.col("__e") / F.greatest(F.col("clearance") + held, F.lit(1e-12))), F.lit(float(spacing)))
    a, b, c = BARRIERS
    return found.select(
        *by, "draw", F.pow(F.col("__far") / reach, 2).alias(a), F.log(F.greatest(F.col("diffusion") / through, F.lit(1.0))).alias(b),
        (held * F.col("__far") * F.col("__far") / through).alias(c),
    )


def barrier_attribution(draws: DataFrame, by: Sequence[str] = (), win: float = 0.60, lead: float = 0.15) -> DataFrame:
    """Mean normalised penalty per barrier; one is named only if it wins often and leads clearly."""
    a, b, c = BARRIERS
    total = F.col(a) + F.col(b) + F.col(c)
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    parts = draws.select(*by, *[(F.col(n) / total).alias(n) for n in BARRIERS])
    top = F.greatest(*BARRIERS)
    winner = F.when(F.col(a) == top, a).when(F.col(b) == top, b).otherwise(c)
    means = parts.withColumn("__w", winner).groupBy(*by).agg(
        *[F.avg(n).alias(n) for n in BARRIERS], *[F.avg((F.col("__w") == n).cast("double")).alias("__win_" + n) for n in BARRIERS]
    )
    first = F.greatest(*BARRIERS)
    second = F.col(a) + F.col(b) + F.col(c) - first - F.least(*BARRIERS)
    name = F.when(F.col(a) == first, a).when(F.col(b) == first, b).otherwise(c)
    share = F.when(F.col(a) == first, F.col("__win_" + a)).when(F.col(b) == first, F.col("__win_" + b)).otherwise(F.col("__win_" + c))
    named = (share >= win) & (first - second >= lead)
    return means.select(*by, *BARRIERS, share.alias("winner_share"), F.when(named, name).otherwise("BARRIER_INDISTINGUISHABLE").alias("dominant_barrier"))


