"""Fits, permutation tests, ranking under uncertainty, sensitivity and decisions."""

from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from checks.sqlkit import avg_rank, uniform
from tessella.operators import stats as ss
from tessella.operators import uncertainty as un
from tessella.operators.order import summarise

FIT = """fit AS (SELECT p_brand, count(*) AS pairs, regr_slope(log10(p_retailprice), log10(p_size)) AS s, regr_intercept(log10(p_retailprice), log10(p_size)) AS i, avg(p_retailprice) AS m, min(p_size) AS raw_min, max(p_size) AS raw_max FROM part WHERE p_size > 0 GROUP BY 1)"""


def fitted(spark, folder):
    return ss.loglog_fit(table(spark, folder, "part"), "p_size", "p_retailprice", ["p_brand"])


@register("loglog_fit", f"WITH {FIT}, r AS (SELECT p_brand, 1 - sum(pow(p_retailprice - pow(10, s * log10(p_size) + i), 2)) / sum(pow(p_retailprice - m, 2)) AS r2 FROM part JOIN fit USING (p_brand) GROUP BY 1) SELECT p_brand, pairs, raw_min, raw_max, round(s, 6) AS slope, round(i, 6) AS intercept, round(r2, 6) AS r2_original_scale, 'FITTED' AS status FROM fit JOIN r USING (p_brand)")
def loglog(spark, folder):
    return rounded(fitted(spark, folder), "slope", "intercept", "r2_original_scale")


@register("calibrated_predict", f"WITH {FIT}, v AS (SELECT p_partkey, p_size + p_partkey % 7 - 3 AS raw, s, i, raw_min, raw_max FROM part JOIN fit USING (p_brand)) SELECT p_partkey, CASE WHEN raw BETWEEN raw_min AND raw_max AND pow(10, s * log10(greatest(raw, 0.5)) + i) BETWEEN 960 AND 1010 THEN round(pow(10, s * log10(greatest(raw, 0.5)) + i), 4) END AS predicted FROM v")
def predict(spark, folder):
    rows = table(spark, folder, "part").withColumn("raw", F.col("p_size") + F.col("p_partkey") % 7 - 3)
    found = ss.calibrated_predict(rows, fitted(spark, folder), "raw", ["p_brand"], 960.0, 1010.0)
    return found.select("p_partkey", F.round("predicted", 4).alias("predicted"))


# Cases: nations of a region; features are customer aggregates, the score an ordinal of the nation.
CASES = """cases AS (SELECT n_regionkey AS region, n_nationkey AS case_id, n_nationkey % 3 AS score, n_nationkey % 2 = 0 AS valid, CASE WHEN n_nationkey % 2 = 0 THEN 'tumor_cells' ELSE 'tissue' END AS mask_type, count(*) AS f1, round(avg(c_acctbal), 4) AS f2, max(c_acctbal) AS f3 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
LONG = f"{CASES}, long AS (SELECT region, case_id, score, valid, feature, value FROM (SELECT region, case_id, score, valid, CAST(f1 AS DOUBLE) AS f1, f2, f3 FROM cases) UNPIVOT (value FOR feature IN (f1, f2, f3)))"
RHO = f"""{LONG}, rk AS (SELECT region, feature, {avg_rank('score', 'region, feature')} AS a, {avg_rank('value', 'region, feature')} AS b FROM long), rho AS (SELECT region, feature, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS r FROM rk GROUP BY region, feature)"""


def cases(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("case_id")).agg(
        F.count("*").alias("f1"), F.round(F.avg("c_acctbal"), 4).alias("f2"), F.max("c_acctbal").alias("f3")
    ).selectExpr("*", "case_id % 3 AS score", "case_id % 2 = 0 AS valid", "IF(case_id % 2 = 0, 'tumor_cells', 'tissue') AS mask_type")


@register("feature_concordance", f"WITH {RHO} SELECT region, feature, round(r, 6) AS spearman_vs_score FROM rho")
def concordance(spark, folder):
    return rounded(ss.feature_concordance(cases(spark, folder), "score", ["f1", "f2", "f3"], ["region"]), "spearman_vs_score")


@register("score_benchmark_summary", f"""WITH {RHO}, b AS (SELECT region, feature, r FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY r DESC, feature DESC) AS rn FROM rho WHERE r IS NOT NULL) WHERE rn = 1),
vr AS (SELECT long.region, {avg_rank('score', 'long.region')} AS x, {avg_rank('value', 'long.region')} AS y FROM long JOIN b ON b.region = long.region AND b.feature = long.feature WHERE valid), vv AS (SELECT region, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r FROM vr GROUP BY region)
SELECT c.region, c.cases, scores_present, valid_cases, mask_types, b.feature AS best_feature, round(b.r, 6) AS best_spearman, CASE WHEN vv.n >= 3 THEN round(vv.r, 6) END AS best_spearman_valid FROM (SELECT region, count(*) AS cases, count(DISTINCT score) AS scores_present, count(*) FILTER (WHERE valid) AS valid_cases, count(DISTINCT mask_type) AS mask_types FROM cases GROUP BY 1) c LEFT JOIN b USING (region) LEFT JOIN vv USING (region)""")
def benchmark_summary(spark, folder):
    found = ss.score_benchmark_summary(cases(spark, folder), "score", ["f1", "f2", "f3"], "valid", "mask_type", ["region"])
    return rounded(found, "best_spearman", "best_spearman_valid")


@register("exact_max_stat_permutation", f"""WITH {RHO}, lab AS (SELECT region, score, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY score) - 1 AS li FROM cases GROUP BY region, score),
lr AS (SELECT DISTINCT region, score, {avg_rank('score', 'region')} AS lrank FROM cases), pos AS (SELECT region, case_id, row_number() OVER (PARTITION BY region ORDER BY case_id) - 1 AS p FROM cases), sz AS (SELECT region, count(*) AS cases FROM cases GROUP BY 1),
cod AS (SELECT sz.region, code, p, lab.score FROM sz, generate_series(0, 242) AS g(code), generate_series(0, 4) AS h(p), lab WHERE lab.region = sz.region AND lab.li = (code // CAST(pow(3, p) AS BIGINT)) % 3),
okc AS (SELECT region, code FROM (SELECT cod.region, code, cod.score, count(*) AS k FROM cod GROUP BY ALL) c JOIN lab USING (region, score) GROUP BY region, code HAVING sum(k) = 5 AND bool_and(k = n) AND count(*) = (SELECT count(*) FROM lab l WHERE l.region = c.region)),
fr AS (SELECT region, case_id, feature, {avg_rank('value', 'region, feature')} AS frank FROM long), pr AS (SELECT cod.region, code, feature, abs(corr(lrank, frank)) AS r FROM cod JOIN okc USING (region, code) JOIN lr USING (region, score) JOIN pos USING (region, p) JOIN fr USING (region, case_id) GROUP BY ALL),
st AS (SELECT region, code, max(r) AS stat FROM pr GROUP BY ALL), ob AS (SELECT region, max(abs(r)) AS observed FROM rho GROUP BY 1)
SELECT sz.region, sz.cases, count(*) AS arrangements, 'COMPUTED' AS status, count(*) AS evaluated, round(any_value(observed), 6) AS observed, round(avg(CAST(stat >= observed - 1e-12 AS INT)), 6) AS p_value FROM sz JOIN st USING (region) JOIN ob USING (region) GROUP BY ALL""")
def exact_permutation(spark, folder):
    found = ss.exact_max_stat_permutation(cases(spark, folder), "case_id", "score", ["f1", "f2", "f3"], ["region"])
    return rounded(found, "observed", "p_value")


UNITS = "units AS (SELECT o_orderpriority AS dataset, CAST(o_custkey % 2 AS INT) AS g, o_orderstatus AS unit, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


def units(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 2).cast("int").alias("g"), F.col("o_orderstatus").alias("unit")).agg(F.avg("o_totalprice").alias("v"))


@register("exact_group_permutation", f"""WITH {UNITS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY g, unit) - 1 AS i FROM units), m AS (SELECT dataset, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN v ELSE -v END) / 3 AS gap FROM n, generate_series(0, 63) AS t(mask) WHERE bit_count(mask) = 3 GROUP BY ALL),
ob AS (SELECT dataset, avg(v) FILTER (WHERE g = 1) - avg(v) FILTER (WHERE g = 0) AS observed FROM units GROUP BY 1)
SELECT dataset, CAST(6 AS BIGINT) AS units, round(any_value(observed), 3) AS observed_difference, count(*) AS splits, round(avg(CAST(abs(gap) >= abs(observed) - 1e-9 * greatest(1, abs(observed)) AS INT)), 6) AS p_value FROM m JOIN ob USING (dataset) GROUP BY 1""")
def group_permutation(spark, folder):
    found = ss.exact_group_permutation(units(spark, folder), "v", "g", "unit", ["dataset"])
    return rounded(found, "p_value").withColumn("observed_difference", F.round("observed_difference", 3))


@register("group_direction", f"WITH {UNITS} SELECT dataset, round(avg(v) FILTER (WHERE g = 0), 3) AS mean_0, round(avg(v) FILTER (WHERE g = 1), 3) AS mean_1, avg(v) FILTER (WHERE g = 1) > avg(v) FILTER (WHERE g = 0) AS direction_matches FROM units GROUP BY 1")
def direction(spark, folder):
    found = ss.group_direction(units(spark, folder), "v", "g", ["dataset"])
    return found.withColumns({"mean_0": F.round("mean_0", 3), "mean_1": F.round("mean_1", 3)})


OUT = """outc AS (SELECT c_nationkey AS dataset, CASE WHEN c_custkey % 977 = 5 THEN 'SYNTHETIC_' ELSE 'P' END || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'success' WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'failure' ELSE 'ongoing' END AS outcome, c_acctbal AS v, c_custkey % 4 AS format FROM customer)"""


def outcomes(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "c_nationkey AS dataset", "concat(IF(c_custkey % 977 = 5, 'SYNTHETIC_', 'P'), c_custkey) AS id", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'success' WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'failure' ELSE 'ongoing' END AS outcome",
        "c_acctbal AS v", "c_custkey % 4 AS format",
    )


@register("permutation_test_median", f"""WITH {OUT}, syn AS (SELECT dataset, bool_or(starts_with(id, 'SYNTHETIC_')) AS syn FROM outc GROUP BY 1), f AS (SELECT * FROM outc WHERE outcome <> 'ongoing'),
sn AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS k, quantile_cont(v, 0.5) FILTER (WHERE outcome = 'success') - quantile_cont(v, 0.5) FILTER (WHERE outcome = 'failure') AS gap FROM f GROUP BY 1),
b AS (SELECT dataset, syn, coalesce(n, 0) AS n, k, gap, NOT syn AND coalesce(n, 0) >= 6 AND k > 0 AND k < n AS ok FROM syn LEFT JOIN sn USING (dataset)),
p AS (SELECT dataset, perm, v, k, row_number() OVER (PARTITION BY dataset, perm ORDER BY {uniform(17, 'perm', 'id')}) AS rn FROM f JOIN b USING (dataset), generate_series(1, 100) AS t(perm) WHERE ok),
g AS (SELECT dataset, perm, quantile_cont(v, 0.5) FILTER (WHERE rn <= k) - quantile_cont(v, 0.5) FILTER (WHERE rn > k) AS d FROM p GROUP BY ALL), pv AS (SELECT dataset, (1 + count(*) FILTER (WHERE abs(d) >= abs(gap))) / 101.0::DOUBLE AS pv FROM g JOIN b USING (dataset) GROUP BY 1)
SELECT dataset, CASE WHEN syn THEN 0 ELSE n END AS n, CASE WHEN ok THEN round(gap, 4) END AS median_difference, round(pv, 6) AS permutation_p, CASE WHEN ok THEN 'EXPLORATORY_ONLY' ELSE 'NOT_COMPUTED' END AS status FROM b LEFT JOIN pv USING (dataset)""")
def permutation(spark, folder):
    found = ss.permutation_test_median(outcomes(spark, folder), "id", "outcome", "v", ["dataset"], 100)
    return rounded(found, "permutation_p").withColumn("median_difference", F.round("median_difference", 4))


@register("stratified_difference", f"""WITH {OUT}, s AS (SELECT dataset, format, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS k, quantile_cont(v, 0.5) FILTER (WHERE outcome = 'success') - quantile_cont(v, 0.5) FILTER (WHERE outcome = 'failure') AS gap FROM outc WHERE outcome <> 'ongoing' GROUP BY ALL)
SELECT dataset, count(*) AS strata, round(quantile_cont(gap, 0.5), 4) AS stratified_difference FROM s WHERE n >= 4 AND k > 0 AND k < n GROUP BY 1""")
def stratified(spark, folder):
    found = ss.stratified_difference(outcomes(spark, folder), "outcome", "v", ["format"], ["dataset"])
    return found.withColumn("stratified_difference", F.round("stratified_difference", 4))


COMP = """cmp AS (SELECT l_returnflag AS dataset, l_linestatus AS definition, p_type AS target, avg(CAST(l_quantity > 25 AS INT)) AS positive_fraction, quantile_cont(l_extendedprice, 0.5) AS target_median, avg(CAST(l_discount <= 0.05 AS INT)) AS within_50 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
mat AS (SELECT dataset, definition, target, (positive_fraction - min(positive_fraction) OVER w) / (max(positive_fraction) OVER w - min(positive_fraction) OVER w) AS coverage, 1 - (target_median - min(target_median) OVER w) / (max(target_median) OVER w - min(target_median) OVER w) AS proximity, (within_50 - min(within_50) OVER w) / (max(within_50) OVER w - min(within_50) OVER w) AS near_source FROM cmp WINDOW w AS (PARTITION BY dataset, definition))"""


def components(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = summarise(joined, ["l_returnflag", "l_linestatus", "p_type"], [
        F.avg((F.col("l_quantity") > 25).cast("double")).alias("positive_fraction"), F.avg((F.col("l_discount") <= 0.05).cast("double")).alias("within_50"),
    ], {"target_median": (F.col("l_extendedprice"), 0.5)})
    named = rows.withColumnsRenamed({"l_returnflag": "dataset", "l_linestatus": "definition", "p_type": "target"})
    return un.component_matrix(named, ["dataset"])


def _u(seed: str, name: str, key: str = "dataset") -> str:
    return f"(CAST(CAST('0x' || substr(md5('rank|' || {seed} || '|' || draw || '|' || {key} || '|{name}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


DRAW = f"""{COMP}, dfs AS (SELECT dataset, list_sort(list(DISTINCT definition)) AS defs FROM mat GROUP BY 1),
dr AS (SELECT dataset, draw, defs[CAST(floor({_u("'17'", 'definition')} * len(defs)) AS INT) + 1] AS definition, -ln(1 - {_u("'17'", 'coverage')}) AS wc, -ln(1 - {_u("'17'", 'proximity')}) AS wp, -ln(1 - {_u("'17'", 'near_source')}) AS wn FROM dfs, generate_series(1, 200) AS t(draw)),
sco AS (SELECT dataset, draw, target, (wc * coverage + wp * proximity + wn * near_source) / (wc + wp + wn) AS score FROM dr JOIN mat USING (dataset, definition)), rks AS (SELECT *, row_number() OVER (PARTITION BY dataset, draw ORDER BY score DESC, target) AS rank FROM sco),
rsum AS (SELECT dataset, target, avg(CAST(rank = 1 AS INT)) AS top, quantile_cont(CAST(rank AS DOUBLE), 0.5) AS median_rank, quantile_cont(CAST(rank AS DOUBLE), 0.05) AS rank_q05, quantile_cont(CAST(rank AS DOUBLE), 0.95) AS rank_q95, quantile_cont(score, 0.5) AS sm, quantile_cont(score, 0.05) AS s05, quantile_cont(score, 0.95) AS s95 FROM rks GROUP BY ALL)"""


@register("component_matrix", f"WITH {COMP} SELECT dataset, definition, target, round(coverage, 6) AS coverage, round(proximity, 6) AS proximity, round(near_source, 6) AS near_source FROM mat")
def component_matrix(spark, folder):
    return rounded(components(spark, folder), "coverage", "proximity", "near_source")


def draws(spark, folder):
    return un.rank_draws(components(spark, folder), 200, 17, ["dataset"])


@register("rank_draws", f"WITH {DRAW} SELECT dataset, CAST(draw AS INT) AS draw, target, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM rks")
def rank_draws(spark, folder):
    return rounded(draws(spark, folder), "score")


@register("rank_summary", f"WITH {DRAW} SELECT dataset, target, round(top, 6) AS top_rank_probability, median_rank, round(rank_q05, 6) AS rank_q05, round(rank_q95, 6) AS rank_q95, round(sm, 6) AS score_median, round(s05, 6) AS score_q05, round(s95, 6) AS score_q95 FROM rsum")
def rank_summary(spark, folder):
    return rounded(un.rank_summary(draws(spark, folder), ["dataset"]), "top_rank_probability", "rank_q05", "rank_q95", "score_median", "score_q05", "score_q95")


@register("pairwise_win", f"WITH {DRAW} SELECT a.dataset, a.target AS left_target, b.target AS right_target, round(avg(CASE WHEN a.target = b.target THEN 0.5 WHEN a.score > b.score THEN 1 ELSE 0 END), 6) AS win_probability FROM sco a JOIN sco b ON a.dataset = b.dataset AND a.draw = b.draw GROUP BY ALL")
def pairwise(spark, folder):
    return rounded(un.pairwise_win(draws(spark, folder), ["dataset"]), "win_probability")


@register("leave_one_out", f"""WITH {COMP}, dfs AS (SELECT dataset, list_sort(list(DISTINCT definition)) AS defs FROM mat GROUP BY 1), om AS (SELECT * FROM (VALUES ('coverage', 18), ('proximity', 19), ('near_source', 20)) AS t(omitted, seed)),
dr AS (SELECT dataset, omitted, draw, defs[CAST(floor({_u('seed', 'definition')} * len(defs)) AS INT) + 1] AS definition, CASE WHEN omitted = 'coverage' THEN 0 ELSE -ln(1 - {_u('seed', 'coverage')}) END AS wc, CASE WHEN omitted = 'proximity' THEN 0 ELSE -ln(1 - {_u('seed', 'proximity')}) END AS wp, CASE WHEN omitted = 'near_source' THEN 0 ELSE -ln(1 - {_u('seed', 'near_source')}) END AS wn FROM dfs, om, generate_series(1, 2000) AS t(draw)),
rk AS (SELECT dataset, omitted, draw, target, row_number() OVER (PARTITION BY dataset, omitted, draw ORDER BY (wc * coverage + wp * proximity + wn * near_source) / (wc + wp + wn) DESC, target) AS rank FROM dr JOIN mat USING (dataset, definition)) SELECT dataset, omitted, target, round(avg(CAST(rank = 1 AS INT)), 6) AS top_rank_probability FROM rk GROUP BY ALL""")
def leave_one_out(spark, folder):
    return rounded(un.leave_one_out(components(spark, folder), 200, 17, ["dataset"]), "top_rank_probability")


@register("stable_winner", f"WITH {DRAW}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY top DESC, target) AS rn FROM rsum) SELECT dataset, target AS leader, round(top, 6) AS probability, CASE WHEN top >= 0.5 THEN target END AS stable_target, CASE WHEN top >= 0.5 THEN 'STABLE' ELSE 'NO_STABLE_TARGET' END AS status FROM b WHERE rn = 1")
def winner(spark, folder):
    return rounded(un.stable_winner(un.rank_summary(draws(spark, folder), ["dataset"]), 0.5, ["dataset"]), "probability")


RANGES = "rng AS (SELECT p_brand AS name, min(p_retailprice) AS low, max(p_retailprice) AS high, CASE WHEN length(p_brand) = 7 THEN 'loguniform' ELSE 'uniform' END AS distribution FROM part GROUP BY 1)"


def ranges(spark, folder):
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.max(F.when(F.length("p_brand") == 7, "loguniform").otherwise("uniform")).alias("distribution")
    )


def _scaled(u: str) -> str:
    return f"CASE WHEN distribution = 'loguniform' THEN exp(ln(low) + {u} * (ln(high) - ln(low))) ELSE low + {u} * (high - low) END"


@register("parameter_draws", f"WITH {RANGES} SELECT CAST(draw AS INT) AS draw, name, round({_scaled(uniform(17, 'draw', 'name'))}, 6) AS value FROM rng, generate_series(1, 100) AS t(draw)")
def parameter_draws(spark, folder):
    return rounded(un.parameter_draws(ranges(spark, folder), 100, 17), "value")


@register("interval", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.05), 4) AS lower, round(quantile_cont(o_totalprice, 0.95), 4) AS upper FROM orders GROUP BY 1")
def interval(spark, folder):
    found = un.interval(table(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"])
    return found.withColumns({c: F.round(c, 4) for c in ("median", "lower", "upper")})


TYPES = "ty AS (SELECT p_type AS name, CAST(min(p_size) AS DOUBLE) AS low, max(p_size) * length(p_type) / 5.0::DOUBLE AS high, 'uniform' AS distribution FROM part GROUP BY 1)"
SOB = f"""{TYPES}, mt AS (SELECT 'A' AS matrix UNION ALL SELECT 'B' UNION ALL SELECT 'AB:' || name FROM ty),
des AS (SELECT c_custkey AS sample, matrix, name, {_scaled("u")} AS value FROM (SELECT c_custkey, matrix, ty.*, CASE WHEN matrix = 'B' OR matrix = 'AB:' || name THEN {uniform(17, "'B'", 'c_custkey', 'name')} ELSE {uniform(17, "'A'", 'c_custkey', 'name')} END AS u FROM customer, mt, ty))"""


def design(spark, folder):
    rng = table(spark, folder, "part").groupBy(F.col("p_type").alias("name")).agg(
        F.min("p_size").cast("double").alias("low"), F.max(F.col("p_size") * F.length("p_type") / 5.0).alias("high")
    ).withColumn("distribution", F.lit("uniform"))
    return un.sobol_design(table(spark, folder, "customer").withColumnRenamed("c_custkey", "sample"), rng, 17)


@register("sobol_design", f"WITH {SOB} SELECT sample, matrix, name, round(value, 6) AS value FROM des")
def sobol_design(spark, folder):
    return rounded(design(spark, folder), "value")


@register("sobol_indices", f"""WITH {SOB}, y AS (SELECT sample, matrix, sum(value * length(name)) AS y FROM des GROUP BY ALL), va AS (SELECT var_samp(y) AS v FROM y WHERE matrix IN ('A', 'B')),
j AS (SELECT substr(m.matrix, 4) AS parameter, a.y AS ya, b.y AS yb, m.y AS yab FROM y m JOIN y a ON a.sample = m.sample AND a.matrix = 'A' JOIN y b ON b.sample = m.sample AND b.matrix = 'B' WHERE m.matrix LIKE 'AB:%')
SELECT parameter, round(least(greatest(avg(yb * (yab - ya)) / any_value(v), -1), 1), 6) AS first_order, round(least(greatest(0.5 * avg(pow(ya - yab, 2)) / any_value(v), 0), 1.5), 6) AS total_order, 'COMPUTED' AS status FROM j, va GROUP BY 1""")
def sobol_indices(spark, folder):
    outputs = design(spark, folder).groupBy("sample", "matrix").agg(F.sum(F.col("value") * F.length("name")).alias("y"))
    return rounded(un.sobol_indices(outputs), "first_order", "total_order")


REACH = f"""cd AS (SELECT user_id % 10 AS fov, draw, value > 20 AS tum, event_type IN ('click', 'view') AS pos, value AS distance, {uniform(17, 'draw', 'event_id')} AS bound FROM events, generate_series(1, 20) AS t(draw)),
rm AS (SELECT fov, draw, count(*) FILTER (WHERE tum) AS tumour_cells, count(*) FILTER (WHERE tum AND pos) AS target_cells, count(*) FILTER (WHERE tum AND pos AND bound >= 0.5) AS reached_cells, coalesce(max(distance) FILTER (WHERE tum AND pos AND bound >= 0.5), 0) AS penetration FROM cd GROUP BY ALL),
rx AS (SELECT *, target_cells / CAST(tumour_cells AS DOUBLE) AS target_fraction, reached_cells / CAST(target_cells AS DOUBLE) AS reachable FROM rm)"""


def reach(spark, folder):
    from tessella.functions.columns import uniform as u

    drawn = table(spark, folder, "events").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20))))
    cells = drawn.selectExpr("user_id % 10 AS fov", "draw", "event_id", "value > 20 AS is_tumour", "event_type IN ('click', 'view') AS target_positive", "value AS distance")
    return un.reach_metrics(cells.withColumn("bound_fraction", u(17, F.col("draw"), F.col("event_id"))), F.lit(0.5), ["fov"])


@register("reach_metrics", f"WITH {REACH} SELECT fov, CAST(draw AS INT) AS draw, tumour_cells, target_cells, reached_cells, penetration, round(target_fraction, 6) AS target_fraction, round(reachable, 6) AS reachable, round(target_fraction * reachable, 6) AS population_reachable, round(target_fraction * (1 - reachable), 6) AS gap FROM rx")
def reach_metrics(spark, folder):
    return rounded(reach(spark, folder), "target_fraction", "reachable", "population_reachable", "gap")


@register("decision_status", f"""WITH {REACH}, q AS (SELECT fov, count(*) AS draws, max(target_cells) AS target_cells, quantile_cont(reachable, 0.5) AS m, quantile_cont(reachable, 0.05) AS lo, quantile_cont(reachable, 0.95) AS hi FROM rx GROUP BY 1)
SELECT fov, draws, target_cells, round(m, 6) AS reachable_median, round(lo, 6) AS reachable_lower, round(hi, 6) AS reachable_upper, CASE WHEN lo < 0.5 AND hi >= 0.5 THEN 'DECISION_UNSTABLE' ELSE '' END AS reasons, CASE WHEN lo < 0.5 AND hi >= 0.5 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OK' END AS status FROM q""")
def decision(spark, folder):
    found = un.reach_index(reach(spark, folder), ["fov"], 0.5)
    return rounded(found, "reachable_median", "reachable_lower", "reachable_upper").select("fov", "draws", "target_cells", "reachable_median", "reachable_lower", "reachable_upper", "reasons", "status")


@register("barrier_attribution", """WITH d AS (SELECT event_type, user_id % 32 AS draw, avg(value) AS a, avg(user_id % 7) * 12 AS b, avg(user_id % 11) * 3 AS c FROM events GROUP BY ALL), n AS (SELECT event_type, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM d),
w AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'vascular_distance' WHEN b >= c THEN 'matrix_fibroblast' ELSE 'binding_site' END AS w FROM n), m AS (SELECT event_type, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(CAST(w = 'vascular_distance' AS INT)) AS wa, avg(CAST(w = 'matrix_fibroblast' AS INT)) AS wb, avg(CAST(w = 'binding_site' AS INT)) AS wc FROM w GROUP BY 1),
t AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'vascular_distance' WHEN b >= c THEN 'matrix_fibroblast' ELSE 'binding_site' END AS top, CASE WHEN a >= b AND a >= c THEN wa WHEN b >= c THEN wb ELSE wc END AS ws, greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)) AS lead FROM m)
SELECT event_type, round(a, 6) AS vascular_distance, round(b, 6) AS matrix_fibroblast, round(c, 6) AS binding_site, round(ws, 6) AS winner_share, CASE WHEN ws >= 0.6 AND lead >= 0.15 THEN top ELSE 'BARRIER_INDISTINGUISHABLE' END AS dominant_barrier FROM t""")
def barriers(spark, folder):
    drawn = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 32).alias("draw")).agg(
        F.avg("value").alias("vascular_distance"), (F.avg(F.col("user_id") % 7) * 12).alias("matrix_fibroblast"), (F.avg(F.col("user_id") % 11) * 3).alias("binding_site")
    )
    return rounded(un.barrier_attribution(drawn, ["event_type"]), "vascular_distance", "matrix_fibroblast", "binding_site", "winner_share")


BARRIER = """bc AS (SELECT event_type, value AS antigen, user_id % 50 + value / 10 AS far, (user_id % 7) / 7.0::DOUBLE AS ecm, (user_id % 3) / 3.0::DOUBLE AS caf FROM events),
bd AS (SELECT CAST(n_nationkey AS INT) AS draw, 10.0::DOUBLE + n_nationkey AS d, 0.5::DOUBLE + n_nationkey / 50.0::DOUBLE AS be, 1 - n_nationkey / 100.0::DOUBLE AS bf, 0.001::DOUBLE * (1 + n_nationkey) AS cl, 0.0001::DOUBLE * (26 - n_nationkey) AS it, 1.0::DOUBLE + n_nationkey % 5 AS kd, 10.0::DOUBLE + n_nationkey AS vc, 1 + (n_nationkey % 3) / 10.0::DOUBLE AS f FROM nation),
bm AS (SELECT event_type, quantile_cont(antigen, 0.5) AS g, quantile_cont(far, 0.5) AS far FROM bc GROUP BY 1), be AS (SELECT event_type, draw, quantile_cont(d * exp(-be * ecm - bf * caf), 0.5) AS e FROM bc, bd GROUP BY ALL),
bh AS (SELECT *, it * g * f / (kd + vc) AS held, greatest(e, 1e-12) AS through FROM be JOIN bd USING (draw) JOIN bm USING (event_type)),
bp AS (SELECT event_type, draw, pow(far / greatest(sqrt(e / greatest(cl + held, 1e-12)), 2.0), 2) AS vascular_distance, ln(greatest(d / through, 1)) AS matrix_fibroblast, held * far * far / through AS binding_site FROM bh)"""


def penalties(spark, folder):
    cells = table(spark, folder, "events").selectExpr(
        "event_type", "value AS antigen", "user_id % 50 + value / 10 AS vessel_distance", "(user_id % 7) / 7D AS ecm", "(user_id % 3) / 3D AS caf")
    draws = table(spark, folder, "nation").selectExpr(
        "CAST(n_nationkey AS INT) AS draw", "10D + n_nationkey AS diffusion", "0.5D + n_nationkey / 50D AS beta_ecm", "1 - n_nationkey / 100D AS beta_caf", "0.001D * (1 + n_nationkey) AS clearance",
        "0.0001D * (26 - n_nationkey) AS internalisation", "1D + n_nationkey % 5 AS kd", "10D + n_nationkey AS vessel_concentration", "1 + (n_nationkey % 3) / 10D AS calibration")
    return un.barrier_penalties(cells, draws, ["event_type"], 2.0)


@register("barrier_penalties", f"WITH {BARRIER} SELECT event_type, draw, round(vascular_distance, 5) AS vascular_distance, round(matrix_fibroblast, 5) AS matrix_fibroblast, round(binding_site, 5) AS binding_site FROM bp")
def barrier_penalties(spark, folder):
    found = penalties(spark, folder)
    return found.select("event_type", "draw", *[F.round(c, 5).alias(c) for c in un.BARRIERS])


@register("model_compare", """WITH l AS (SELECT l_returnflag, model, l_discount * 10 AS o, p FROM (SELECT l_returnflag, l_discount, l_tax * 12 AS tax, l_quantity / 50 AS qty, l_extendedprice / 105000 AS price FROM lineitem) UNPIVOT (p FOR model IN (tax, qty, price))), m AS (SELECT l_returnflag, model, sqrt(avg(pow(o - p, 2))) AS rmse, avg(CAST((o >= 0.5) = (p >= 0.5) AS INT)) AS accuracy FROM l GROUP BY ALL)
SELECT l_returnflag, model, round(rmse, 6) AS rmse, round(accuracy, 6) AS accuracy, first_value(model) OVER (PARTITION BY l_returnflag ORDER BY rmse, model) AS best_by_rmse, first_value(model) OVER (PARTITION BY l_returnflag ORDER BY accuracy DESC, model) AS best_by_accuracy FROM m""")
def model_compare(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_discount * 10 AS o", "inline(array(struct('tax' AS model, l_tax * 12 AS p), struct('qty' AS model, l_quantity / 50 AS p), struct('price' AS model, l_extendedprice / 105000 AS p)))"
    )
    return rounded(ss.model_compare(rows, "o", "p", 0.5, ["l_returnflag"]), "rmse", "accuracy")


@register("trend_checks", """WITH s AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY ALL), l AS (SELECT o_orderstatus, n > lag(n) OVER w AS a, mx <= lag(mx) OVER w AS b FROM s WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)),
r AS (SELECT o_orderstatus, bool_and(a) AS count_increasing, bool_and(b) AS maximum_falls FROM l GROUP BY 1) SELECT *, CASE WHEN count_increasing AND maximum_falls THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def trends(spark, folder):
    series = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("mx"))
    return ss.trend_checks(series, {"count_increasing": ("n", "increasing"), "maximum_falls": ("mx", "non_increasing")}, "o_orderpriority", ["o_orderstatus"])
