"""Calibration fits, concordance, permutation tests, model comparison and trend checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import uniform
from tessella.operators.order import average_rank, spearman, summarise, value_positions
from tessella.session import attach, cut_lineage, materialised

# Published quantification limits of the calibrated range.
LOWER_LIMIT, UPPER_LIMIT = 10375.0, 178649.0
ARRANGEMENT_LIMIT = 100_000
TOLERANCE = 1e-12


def loglog_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """log10-log10 least squares per group; R2 on the original scale; NULL below four pairs."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0))
    lx, ly = F.log10(F.col(x)), F.log10(F.col(y))
    fit = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.regr_slope(ly, lx).alias("__s"), F.regr_intercept(ly, lx).alias("__i"),
        F.avg(y).alias("__m"), F.min(x).alias("raw_min"), F.max(x).alias("raw_max"),
    )
    fitted = F.pow(F.lit(10.0), F.col("__s") * lx + F.col("__i"))
    both = attach(rows, fit, by)
    sums = both.groupBy(*by).agg(
        F.sum(F.pow(F.col(y) - fitted, 2)).alias("__res"), F.sum(F.pow(F.col(y) - F.col("__m"), 2)).alias("__tot")
    )
    enough = F.col("pairs") >= 4
    return attach(fit, sums, by).select(
        *by, "pairs", "raw_min", "raw_max", F.when(enough, F.col("__s")).alias("slope"), F.when(enough, F.col("__i")).alias("intercept"),
        F.when(enough & (F.col("__tot") > 0), 1.0 - F.col("__res") / F.col("__tot")).alias("r2_original_scale"),
        F.when(enough, "FITTED").otherwise("NOT_COMPUTED").alias("status"),
    )


def calibrated_predict(df: DataFrame, model: DataFrame, x: str, by: Sequence[str] = (), low: float = LOWER_LIMIT, high: float = UPPER_LIMIT, out: str = "predicted") -> DataFrame:
    """Prediction inside the fitted input range and the quantifiable output range, otherwise NULL."""
    joined = attach(df, model.select(*by, "slope", "intercept", "raw_min", "raw_max"), by)
    value = F.pow(F.lit(10.0), F.col("slope") * F.log10(F.col(x)) + F.col("intercept"))
    known = F.col(x).between(F.col("raw_min"), F.col("raw_max")) & value.between(low, high)
    return joined.withColumn(out, F.when(known, value)).drop("slope", "intercept", "raw_min", "raw_max")


def long_features(cases: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return cases.select(*keep, F.inline(items))


def feature_concordance(cases: DataFrame, score: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Spearman of every feature against an ordinal score; constant features give NULL."""
    long = long_features(cases, [*by, score], features)
    return spearman(long, [*by, "feature"], score, "value", "spearman_vs_score").drop("pairs")


def score_benchmark_summary(cases: DataFrame, score: str, features: Sequence[str], valid: str, mask_type: str, by: Sequence[str] = ()) -> DataFrame:
    """Best feature, scores present, its correlation on valid cases (three or more) and mask counts."""
    by = list(by)
    cases = materialised(cases)
    rho = feature_concordance(cases, score, features, by)
    best = rho.where("spearman_vs_score IS NOT NULL").groupBy(*by).agg(
        F.max_by("feature", F.struct("spearman_vs_score", "feature")).alias("best_feature"), F.max("spearman_vs_score").alias("best_spearman")
    )
    counts = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct(score).alias("scores_present"), F.count_if(F.col(valid)).alias("valid_cases"),
        F.count_distinct(mask_type).alias("mask_types"),
    )
    of_valid = attach(long_features(cases.where(F.col(valid)), [*by, score], features), best, by).where("feature = best_feature")
    few = spearman(of_valid, by, score, "value", "__r").select(*by, F.when(F.col("pairs") >= 3, F.col("__r")).alias("best_spearman_valid"))
    return attach(attach(counts, best, by), few, by)


def ln_factorial(n: Column) -> Column:
    """Natural logarithm of n!: the logarithm itself up to 20, then Stirling's series (error below 1e-12)."""
    n = n.cast("double")
    series = n * F.log(n) - n + F.log(2 * pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def exact_max_stat_permutation(
    cases: DataFrame, case: str, score: str, features: Sequence[str], by: Sequence[str], arrangement_limit: int = ARRANGEMENT_LIMIT
) -> DataFrame:
    """Exact p-value of the largest absolute Spearman over features, per group of cases.

    All distinct arrangements of the score labels are enumerated: the commonest label fills what
    the others leave, so only their cases are placed, one after the other. ``status`` is COMPUTED,
    NOT_COMPUTED (under four scored cases or two labels) or TOO_MANY_ARRANGEMENTS (decided before
    anything is enumerated). Cases without a score take no part. ``arrangements`` is NULL beyond 1e12.
    """
    by = list(by)
    cases = materialised(cases.select(*by, case, score, *features))
    scored = cases.where(F.col(score).isNotNull())
    labels = average_rank(scored, by, score).select(*by, "value", "rank")
    counts = scored.groupBy(*by, F.col(score).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    common = F.max_by("value", F.struct("n", "value"))
    sizes = counts.groupBy(*by).agg(
        F.sum("n").alias("cases"), F.count(F.lit(1)).alias("labels"), common.alias("__common"), F.max("n").alias("__most"), F.sum(ln_factorial(F.col("n"))).alias("__part")
    )
    sizes = attach(cases.select(*by).distinct(), sizes, by).fillna(0, ["cases", "labels"])
    ways = ln_factorial(F.col("cases")) - F.col("__part")
    fit = (F.col("cases") >= 4) & (F.col("labels") >= 2)
    few = ways <= log(arrangement_limit + 0.5)
    status = F.when(~fit, "NOT_COMPUTED").when(few, "COMPUTED").otherwise("TOO_MANY_ARRANGEMENTS")
    arrangements = F.when(fit & (ways < log(1e12)), F.round(F.exp(ways)).cast("long"))
    sizes = cut_lineage(sizes.withColumn("arrangements", arrangements).withColumn("status", status))
    ready = sizes.where("status = 'COMPUTED'")

    # Labels other than the commonest, as shifts of the rank against it: few, for the arrangements are few.
    ranked = attach(labels, ready.select(*by, "__common"), by).where("__common IS NOT NULL")
    base = ranked.where(F.col("value") == F.col("__common")).select(*by, F.col("rank").alias("__base"))
    shifts = attach(ranked.where(F.col("value") != F.col("__common")).drop("__common"), base, by)
    shifts = counts.join(shifts.withColumn("d", F.col("rank") - F.col("__base")), [*by, "value"]).withColumn("d", F.explode(F.array_repeat("d", F.col("n").cast("int"))))
    placing = shifts.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("d"))
    state = ready.join(placing, by).select(*by, "cases", "d", F.array().cast("array<int>").alias("chosen"))
    steps = ready.agg(F.max(F.col("cases") - F.col("__most")).alias("n")).first()["n"] or 0
    for k in range(int(steps)):
        # Cases of one label are placed in ascending order, so each arrangement is made once.
        follows = f"size(d) > {k} AND {k} > 0 AND get(d, {k}) = get(d, {k - 1})"
        free = f"filter(sequence(1, CAST(cases AS INT)), p -> NOT array_contains(chosen, p) AND (NOT ({follows}) OR p > coalesce(get(chosen, {k - 1}), 0)))"
        state = state.withColumn("p", F.explode(F.expr(f"IF(size(d) > {k}, {free}, array(0))")))
        state = state.select(*by, "cases", "d", F.expr("IF(p = 0, chosen, concat(chosen, array(p)))").alias("chosen"))

    order = Window.partitionBy(*by).orderBy(case)
    member = scored.join(ready.select(*by), by, "left_semi").withColumn("position", F.row_number().over(order))
    long = long_features(member, [*by, "position", score], features)
    ranks = average_rank(long, [*by, "feature"], "value").select(*by, "feature", F.col("value").alias("__v"), F.col("rank").alias("fr"))
    placed = long.join(ranks, [*by, "feature"]).where(F.col("value") == F.col("__v"))
    spread = placed.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("m"), F.avg("fr").alias("mid"), (F.var_pop("fr") * F.count(F.lit(1))).alias("ss"))
    centred = attach(placed, spread, [*by, "feature"]).select(*by, "position", "feature", (F.col("fr") - F.col("mid")).alias("f"), "m", "ss")
    arranged = state.select(*by, F.concat_ws(",", "chosen").alias("key"), F.explode(F.arrays_zip(F.col("chosen").alias("p"), F.col("d").alias("d"))).alias("c"))
    arranged = arranged.select(*by, "key", F.col("c.p").alias("position"), F.col("c.d").alias("d")).join(centred, [*by, "position"])
    # Correlation from the shifted cases alone: all others have shift 0.
    sums = arranged.groupBy(*by, "key", "feature").agg(
        F.sum(F.col("d") * F.col("f")).alias("xy"), (F.sum(F.col("d") * F.col("d")) - F.sum("d") * F.sum("d") / F.first("m")).alias("xx"), F.first("ss").alias("yy")
    )
    stat = sums.groupBy(*by, "key").agg(F.max(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.abs("xy") / F.sqrt(F.col("xx") * F.col("yy")))).alias("stat"))
    seen = placed.join(labels.select(*by, F.col("value").alias("__label"), F.col("rank").alias("lr")), by).where(F.col(score) == F.col("__label"))
    seen = seen.groupBy(*by, "feature").agg(F.when((F.stddev_pop("lr") > 0) & (F.stddev_pop("fr") > 0), F.abs(F.corr("lr", "fr"))).alias("r"))
    observed = seen.groupBy(*by).agg(F.max("r").alias("observed"))
    tested = stat.join(observed, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated"), F.first("observed").alias("observed"),
        F.avg((F.col("stat") >= F.col("observed") - TOLERANCE).cast("double")).alias("p_value"),
    )
    return attach(sizes.select(*by, "cases", "arrangements", "status"), tested, by)


def exact_group_permutation(units: DataFrame, value: str, group: str, unit: str, by: Sequence[str]) -> DataFrame:
    """All 20 splits of six units into two groups of three: share at least as far apart as observed.

    ``group`` is 0 or 1.  Groups that do not hold exactly three units of each kind get NULL.
    """
    by = list(by)
    units = materialised(units.select(*by, group, unit, value))
    shape = units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.sum(F.col(group).cast("int")).alias("__g"))
    fit = shape.where("units = 6 AND __g = 3").select(*by)
    six = units.join(fit, by, "left_semi").groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(group).cast("int").alias("g"), unit, F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("v")
    )
    masks = six.withColumn("mask", F.explode(F.expr("filter(sequence(0, 63), m -> bit_count(m) = 3)")))
    gap = F.expr("aggregate(sequence(0, 5), 0D, (a, i) -> a + IF((shiftright(mask, i) & 1) = 1, v[i], -v[i])) / 3D")
    seen = F.expr("((v[3] + v[4] + v[5]) - (v[0] + v[1] + v[2])) / 3D")
    tested = masks.select(*by, gap.alias("gap"), seen.alias("observed_difference")).groupBy(*by).agg(
        F.first("observed_difference").alias("observed_difference"), F.count(F.lit(1)).alias("splits"),
        F.avg((F.abs("gap") >= F.abs("observed_difference") - TOLERANCE * F.greatest(F.lit(1.0), F.abs("observed_difference"))).cast("double")).alias("p_value"),
    )
    return attach(shape.select(*by, "units"), tested, by)


def group_direction(units: DataFrame, value: str, group: str, by: Sequence[str] = (), expected_higher: int = 1) -> DataFrame:
    """Mean per group and whether the expected group is the higher one."""
    means = units.groupBy(*by).agg(
        F.avg(F.when(F.col(group) == 0, F.col(value))).alias("mean_0"), F.avg(F.when(F.col(group) == 1, F.col(value))).alias("mean_1")
    )
    higher = F.col("mean_1") > F.col("mean_0") if expected_higher == 1 else F.col("mean_0") > F.col("mean_1")
    return means.withColumn("direction_matches", higher)


def _shuffled_medians(rows: DataFrame, row_id: str, by: Sequence[str], permutations: int, seed: int) -> DataFrame:
    """Medians ``__a`` and ``__b`` of ``__v`` among the ``__k`` rows with the smallest hashes and among the others, for each shuffle.

    Rows meet their shuffles in passing and only counts leave a task: hashes and values are counted in
    sqrt(n) buckets, and only the bucket that holds the wanted order statistic is looked at row by row in a
    second pass. What the passes hand on is one array of ``permutations`` entries a group, so no table
    of rows times shuffles is written or shuffled.
    """
    by, perm = list(by), [*by, "__p"]
    places = value_positions(rows, by, "__v").select(*by, F.col("value").alias("__v"), F.col("before").alias("__before"))
    buckets = F.ceil(F.sqrt("n")).cast("long")
    ready = attach(rows, places, [*by, "__v"]).withColumn("__buckets", buckets)
    ready = cut_lineage(ready.withColumn("__vb", F.floor(F.col("__before") * F.col("__buckets") / F.col("n"))).drop("__before"))

    def shuffles(settings: DataFrame | None) -> DataFrame:
        """Rows with each shuffle, its settings and the row's hash ``__u``."""
        if settings is None:
            every = ready.withColumn("__p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        else:
            fields = [c for c in settings.columns if c not in by]
            packed = settings.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("__settings"))  # one entry for each shuffle
            every = attach(ready, packed, by).select(*ready.columns, F.inline("__settings"))
        return every.withColumn("__u", uniform(seed, F.col("__p"), F.col(row_id)))

    def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        """Values with their ``count`` and the rows ``before`` them within the keys."""
        counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("before", F.sum("count").over(upto) - F.col("count"))

    bucket = F.floor(F.col("__u") * F.col("__buckets"))
    coarse = counted(shuffles(None).withColumn("__ub", bucket), [*perm, "__k"], "__ub").where("before < __k AND __k <= before + count")
    coarse = coarse.select(*perm, F.col("value").alias("__cb"), (F.col("__k") - F.col("before")).alias("__need"))
    fine = counted(shuffles(coarse).where(bucket == F.col("__cb")), [*perm, "__need"], "__u").where("before < __need AND __need <= before + count")
    cuts = cut_lineage(fine.select(*perm, F.col("value").alias("__cut")))

    # Places of the one or two middle values on each side, first as buckets of ranks.
    sided = shuffles(cuts).where("__v IS NOT NULL").withColumn("__in", F.col("__u") <= F.col("__cut"))
    side = [*perm, "__cut", "__in"]
    held = counted(sided, side, "__vb").withColumn("__m", F.sum("count").over(Window.partitionBy(*side)))
    low, high = F.floor((F.col("__m") - 1) / 2), F.ceil((F.col("__m") - 1) / 2)

    def middle(place: Column, name: str) -> list[Column]:
        inside = (F.col("before") <= place) & (place < F.col("before") + F.col("count"))
        return [F.max(F.when(inside, F.col("value"))).alias(f"__{name}b"), F.max(F.when(inside, place - F.col("before"))).alias(f"__{name}o")]

    middles = held.groupBy(*side).agg(*middle(low, "l"), *middle(high, "h"))
    ends = F.array(F.struct(F.lit("l").alias("e"), F.col("__lb").alias("b"), F.col("__lo").alias("o")), F.struct(F.lit("h").alias("e"), F.col("__hb").alias("b"), F.col("__ho").alias("o")))
    middles = cut_lineage(middles.groupBy(*perm, "__cut").agg(*[F.max(F.when(F.col("__in") == which, ends)).alias(name) for which, name in ((True, "__t"), (False, "__f"))]))
    near = shuffles(middles).withColumn("__in", F.col("__u") <= F.col("__cut"))
    near = near.select(*perm, "__in", "__v", "__vb", F.explode(F.when(F.col("__in"), F.col("__t")).otherwise(F.col("__f"))).alias("__e")).where("__e.b = __vb")
    found = counted(near.select(*perm, "__in", "__v", F.col("__e.e").alias("__e"), F.col("__e.o").alias("__o")), [*perm, "__in", "__e", "__o"], "__v")
    found = found.where("before <= __o AND __o < before + count")

    def at(side: bool, end: str) -> Column:
        return F.max(F.when((F.col("__in") == side) & (F.col("__e") == end), F.col("value")))

    return found.groupBy(*perm).agg(*[(at(side, "l") + (at(side, "h") - at(side, "l")) * 0.5).alias(name) for side, name in ((True, "__a"), (False, "__b"))])


def permutation_test_median(
    table: DataFrame, row_id: str, outcome: str, value: str, by: Sequence[str] = (), permutations: int = 1000, seed: int = 17, allow_synthetic: bool = False
) -> DataFrame:
    """Median gap success minus failure with a permutation p-value per group.

    A shuffle labels the rows with the smallest hash values. The cut and the medians are exact order statistics,
    found by counts, so no group is ever sorted in one task and no shuffled copy of the rows is kept.
    """
    by = list(by)
    synthetic = F.coalesce(F.bool_or(F.col(row_id).cast("string").startswith("SYNTHETIC_")), F.lit(False))
    flags = table.groupBy(*by).agg(synthetic.alias("__syn"))
    rows = materialised(table.where(F.col(outcome).isin("success", "failure")).select(*by, row_id, (F.col(outcome) == "success").alias("__s"), F.col(value).cast("double").alias("__v")))
    success, failure = F.when(F.col("__s"), F.col("__v")), F.when(~F.col("__s"), F.col("__v"))
    seen = summarise(rows, by, [F.count(F.lit(1)).alias("n"), F.count_if("__s").alias("__k")], {"__a": (success, 0.5), "__b": (failure, 0.5)})
    blocked = F.lit(False) if allow_synthetic else F.col("__syn")
    base = attach(flags, seen, by).fillna(0, ["n", "__k"])
    ok = ~blocked & (F.col("n") >= 6) & (F.col("__k") > 0) & (F.col("__k") < F.col("n"))
    base = cut_lineage(base.withColumn("ok", ok).withColumn("gap", F.when(ok, F.col("__a") - F.col("__b"))))
    ready = attach(rows, base.select(*by, "ok", "n", "__k"), by).where("ok").select(*by, row_id, "__v", "n", "__k")
    null = _shuffled_medians(ready, row_id, by, permutations, seed)
    gaps = attach(null, base.select(*by, "gap"), by)
    p = gaps.groupBy(*by).agg(
        ((F.count_if(F.abs(F.col("__a") - F.col("__b")) >= F.abs("gap")) + 1) / F.lit(permutations + 1)).alias("permutation_p")
    )
    return attach(base, p, by).select(
        *by, F.when(blocked, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n"), F.col("gap").alias("median_difference"), "permutation_p",
        F.when(F.col("ok"), "EXPLORATORY_ONLY").otherwise("NOT_COMPUTED").alias("status"),
    )


def stratified_difference(table: DataFrame, outcome: str, value: str, strata: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median over strata (four or more rows, both classes) of the median gap."""
    rows = table.where(F.col(outcome).isin("success", "failure"))
    success, failure = F.col(outcome) == "success", F.col(outcome) == "failure"
    per = summarise(rows, [*by, *strata], [F.count(F.lit(1)).alias("n"), F.count_if(success).alias("k")], {
        "__a": (F.when(success, F.col(value)), 0.5), "__b": (F.when(failure, F.col(value)), 0.5),
    })
    used = materialised(per.where("n >= 4 AND k > 0 AND k < n").withColumn("__gap", F.col("__a") - F.col("__b")))
    return summarise(used, by, [F.count(F.lit(1)).alias("strata")], {"stratified_difference": (F.col("__gap"), 0.5)})


def model_compare(rows: DataFrame, observed: str, predicted: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """RMSE and threshold agreement of every model, and which model is best by each."""
    per = rows.groupBy(*by, "model").agg(
        F.sqrt(F.avg(F.pow(F.col(observed) - F.col(predicted), 2))).alias("rmse"),
        F.avg(((F.col(observed) >= threshold) == (F.col(predicted) >= threshold)).cast("double")).alias("accuracy"),
    )
    best = per.groupBy(*by).agg(
        F.min_by("model", F.struct("rmse", "model")).alias("best_by_rmse"),
        F.min_by("model", F.struct(-F.col("accuracy"), F.col("model"))).alias("best_by_accuracy"),
    )
    return attach(per, best, by)


def trend_checks(series: DataFrame, checks: Mapping[str, tuple[str, str]], order: str, by: Sequence[str] = ()) -> DataFrame:
    """Monotonic checks along ordered scenarios.

    ``checks`` maps a name to (column, direction); directions: increasing, decreasing,
    non_increasing, non_decreasing.
    """
    along = Window.partitionBy(*by).orderBy(order)
    rules: dict[str, Column] = {}
    for name, (column, direction) in checks.items():
        before, now = F.lag(column).over(along), F.col(column)
        rules[name] = {
            "increasing": now > before, "decreasing": now < before, "non_increasing": now <= before, "non_decreasing": now >= before,
        }[direction]
    flagged = series.select(*by, *[r.alias(n) for n, r in rules.items()])
    rolled = flagged.groupBy(*by).agg(*[F.coalesce(F.bool_and(n), F.lit(True)).alias(n) for n in checks])
    everything = F.lit(True)
    for n in checks:
        everything = everything & F.col(n)
    return rolled.withColumn("status", F.when(everything, "PASS").otherwise("FAIL"))
