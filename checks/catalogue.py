"""Feature catalogue queries: lineitem as measurements (order = cell, part = feature)."""

from pyspark.sql import functions as F

from checks.registry import r6, register, rounded, table
from tessella.functions import columns as fc
from tessella.operators import catalogue as ct
from tessella.sources import tables as st


def catalogue(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("feature_index"), F.col("p_name").alias("feature_name"),
        F.when(F.col("p_type") == "PROMO", "Protein Expression").otherwise("Gene Expression").alias("feature_type"),
    )


def measurements(spark, folder):
    return st.read_measurements(spark, f"{folder}/lineitem.parquet", {
        "cell_id": F.col("l_orderkey"), "feature_index": F.col("l_partkey"), "value": F.col("l_quantity"),
    })


def cells(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("cell_id"), "o_orderpriority")


def aliases(spark, folder):
    """Alias groups: upper-case names with dashes, plus names that no part has."""
    names = table(spark, folder, "part").select("p_name", "p_brand").distinct()
    return names.groupBy(F.col("p_brand").alias("group")).agg(
        F.array_sort(F.collect_set(F.concat(F.upper(F.regexp_replace("p_name", " ", "-")), F.when(F.length("p_name") % 5 == 0, "_X").otherwise("")))).alias("aliases")
    )


CAT = "cat AS (SELECT p_partkey AS feature_index, p_name AS feature_name, CASE WHEN p_type = 'PROMO' THEN 'Protein Expression' ELSE 'Gene Expression' END AS feature_type FROM part)"
ALI = """names AS (SELECT DISTINCT p_brand AS "group", upper(replace(p_name, ' ', '-')) || CASE WHEN length(p_name) % 5 = 0 THEN '_X' ELSE '' END AS alias FROM part),
ali AS (SELECT "group", alias, CAST(row_number() OVER (PARTITION BY "group" ORDER BY alias) - 1 AS INT) AS alias_ix, regexp_replace(upper(alias), '[^\\p{L}\\p{N}]', '', 'g') AS token FROM names)"""


@register("read_measurements", "SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, l_partkey AS feature_index, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY ALL")
def read_measurements(spark, folder):
    promo = catalogue(spark, folder).where("feature_type LIKE 'Protein%'")
    rows = st.read_measurements(spark, f"{folder}/lineitem.parquet", {
        "cell_id": F.col("l_orderkey"), "feature_index": F.col("l_partkey"), "value": F.col("l_quantity"),
    }, promo)
    return rows.groupBy("cell_id", "feature_index").agg(F.sum(F.col("value").cast("double")).alias("value"))


@register("csr_to_coo", "SELECT l_orderkey AS major, l_partkey AS minor, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def csr_to_coo(spark, folder):
    coo = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("major"), F.col("l_partkey").alias("minor"), F.col("l_quantity").alias("value"))
    majors = table(spark, folder, "orders").select(F.col("o_orderkey").alias("major"))
    pointers, entries = st.coo_to_csr(coo, majors)
    return st.csr_to_coo(pointers, entries).groupBy("major", "minor", "value").agg(F.count(F.lit(1)).alias("n"))


@register("normalise_token", "SELECT p_name, regexp_replace(upper(p_name || '-' || p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS token, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS ascii_token, count(*) AS n FROM part GROUP BY ALL")
def normalise_token(spark, folder):
    return table(spark, folder, "part").select(
        "p_name", fc.normalise_token(F.concat_ws("-", "p_name", "p_brand")).alias("token"), fc.normalise_token(F.col("p_brand"), True).alias("ascii_token"),
    ).groupBy("p_name", "token", "ascii_token").agg(F.count("*").alias("n"))


@register("canonical_feature_name", f"WITH {CAT} SELECT feature_index, CASE WHEN contains(upper(feature_type), 'PROTEIN') THEN 'protein__' ELSE 'rna__' END || trim(regexp_replace(trim(feature_name || ' #'), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS name FROM cat")
def canonical(spark, folder):
    return catalogue(spark, folder).select("feature_index", fc.canonical_feature_name(F.concat("feature_name", F.lit(" #")), F.col("feature_type")).alias("name"))


RES = f"""WITH {CAT}, {ALI}, tok AS (SELECT *, regexp_replace(upper(feature_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS token FROM cat),
res AS (SELECT "group", alias, alias_ix, feature_index, feature_name, feature_type, row_number() OVER (PARTITION BY "group", feature_index ORDER BY alias_ix) AS rn FROM ali JOIN tok USING (token))"""


@register("resolve_features", RES + """ SELECT "group", alias, alias_ix, feature_index, CASE WHEN contains(upper(feature_type), 'PROTEIN') THEN 'protein__' ELSE 'rna__' END || replace(feature_name, ' ', '_') AS "column" FROM res WHERE rn = 1""")
def resolve(spark, folder):
    found = ct.resolve_features(catalogue(spark, folder), ct.alias_table(aliases(spark, folder)))
    return found.select("group", "alias", "alias_ix", "feature_index", "column")


@register("unresolved_aliases", f"""WITH {CAT}, {ALI} SELECT "group", string_agg(alias, '|' ORDER BY alias_ix) AS unresolved FROM ali WHERE token NOT IN (SELECT regexp_replace(upper(feature_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') FROM cat) GROUP BY ALL""")
def unresolved(spark, folder):
    return ct.unresolved_aliases(catalogue(spark, folder), ct.alias_table(aliases(spark, folder)))


@register("find_single_feature", "SELECT n_name AS feature_name, count(*) AS matches FROM nation WHERE regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') = 'NATION7' GROUP BY ALL")
def single(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("feature_index"), F.col("n_name").alias("feature_name"))
    return ct.matching_features(nations, "nation-7").groupBy("feature_name").agg(F.count("*").alias("matches"))


SUMMARY = """SELECT p_partkey AS feature_index, coalesce(total, 0) AS total, coalesce(n, 0) AS positive_cells, coalesce(pos, 0) AS positive_value_cells,
round(coalesce(total, 0) / cells, 6) AS mean_per_cell, round(coalesce(n, 0) / CAST(cells AS DOUBLE), 6) AS positive_fraction
FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS total, count(*) AS n, count(*) FILTER (WHERE l_quantity > 0) AS pos FROM lineitem GROUP BY 1) ON l_partkey = p_partkey, (SELECT count(*) AS cells FROM orders)"""


@register("feature_summary", SUMMARY)
def feature_summary(spark, folder):
    found = ct.feature_summary(catalogue(spark, folder), measurements(spark, folder), cells(spark, folder))
    return rounded(found, "mean_per_cell", "positive_fraction").select("feature_index", "total", "positive_cells", "positive_value_cells", "mean_per_cell", "positive_fraction")


NAMES = ["rna__ECONOMY", "rna__STANDARD", "protein__PROMO", "rna__LARGE"]


@register("features_wide", """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, """ + ", ".join(
    f"""coalesce(sum(l_quantity) FILTER (WHERE p_type = '{n.split('__')[1]}'), 0) AS "{n}\"""" for n in NAMES
) + " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def features_wide(spark, folder):
    columns = table(spark, folder, "part").select(
        F.col("p_partkey").alias("feature_index"),
        fc.canonical_feature_name(F.col("p_type"), F.when(F.col("p_type") == "PROMO", "Antibody Capture").otherwise("Gene Expression")).alias("column"),
    ).where(F.col("column").isin(NAMES))
    return ct.features_wide(cells(spark, folder).select("cell_id"), measurements(spark, folder), columns, NAMES)


@register("feature_vector_stats", """WITH f AS (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem WHERE l_partkey = (SELECT min(p_partkey) FROM part WHERE p_type = 'PROMO') GROUP BY 1),
j AS (SELECT o_orderpriority, coalesce(v, 0) AS v FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT o_orderpriority, count(*) AS cells, round(avg(v), 6) AS mean, round(avg(CAST(v > 0 AS INT)), 6) AS positive_fraction, sum(v) AS total, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS q90 FROM j GROUP BY 1""")
def vector_stats(spark, folder):
    first = table(spark, folder, "part").where("p_type = 'PROMO'").agg(F.min("p_partkey").alias("feature_index"))
    one = measurements(spark, folder).join(first, "feature_index", "left_semi")
    return rounded(ct.feature_vector_stats(cells(spark, folder), one, ["o_orderpriority"]), "mean", "positive_fraction")


@register("packed_cell_id", """SELECT c_custkey, CASE WHEN c_custkey * 7919 BETWEEN 0 AND 4294967295 AND c_nationkey >= 0 THEN translate(lpad(lower(hex(c_custkey * 7919)), 8, '0'), '0123456789abcdef', 'abcdefghijklmnop') || '-' || CAST(c_nationkey AS VARCHAR) END AS packed FROM customer""")
def packed(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", fc.packed_cell_id(F.col("c_custkey") * 7919, F.col("c_nationkey")).alias("packed"))


@register("broad_group", """SELECT CASE WHEN strpos(n_name, '_') > 0 THEN substr(n_name, strpos(n_name, '_') + 1) ELSE n_name END AS broad, c_mktsegment AS whole, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def broad(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select(fc.broad_group(F.col("n_name")).alias("broad"), fc.broad_group(F.col("c_mktsegment")).alias("whole")).groupBy("broad", "whole").agg(F.count("*").alias("n"))


PLANTED = "CASE WHEN event_id % 7 = 0 THEN '<' || CAST(value AS VARCHAR) WHEN event_id % 7 = 1 THEN 'NC' WHEN event_id % 7 = 2 THEN ' 1,2' || CAST(event_id AS VARCHAR) || '.5 ' WHEN event_id % 7 = 3 THEN event_type ELSE CAST(value AS VARCHAR) END"


@register("parse_censored", f"""SELECT event_id, CASE WHEN t LIKE '<%' OR t LIKE '>%' OR lower(t) IN ('', 'nc', 'nan', 'none') THEN NULL ELSE try_cast(t AS DOUBLE) END AS number FROM (SELECT event_id, replace(trim({PLANTED}), ',', '') AS t FROM events)""")
def censored(spark, folder):
    text = F.expr(PLANTED.replace("VARCHAR", "STRING"))
    return table(spark, folder, "events").select("event_id", fc.parse_censored(text).alias("number"))


@register("unpivot_replicates", """SELECT l_orderkey, replicate, count(*) AS rows, round(sum(raw), 4) AS raw, round(sum(calibrated), 4) AS calibrated FROM (
SELECT l_orderkey, 1 AS replicate, l_tax AS raw, l_extendedprice AS calibrated FROM lineitem UNION ALL SELECT l_orderkey, 2, l_discount, l_extendedprice * 1.05 FROM lineitem) WHERE raw > 0 AND calibrated > 0 GROUP BY ALL""")
def replicates(spark, folder):
    wide = table(spark, folder, "lineitem").withColumn("second", F.col("l_extendedprice") * 1.05)
    rows = ct.unpivot_replicates(wide, ["l_orderkey"], [("l_tax", "l_extendedprice", 1), ("l_discount", "second", 2)])
    return rows.groupBy("l_orderkey", "replicate").agg(F.count("*").alias("rows"), F.round(F.sum("raw"), 4).alias("raw"), F.round(F.sum("calibrated"), 4).alias("calibrated"))


@register("convert_units", "SELECT p_partkey, round(p_retailprice * 10, 6) AS um2_per_s FROM part")
def units(spark, folder):
    return table(spark, folder, "part").select("p_partkey", r6(fc.convert_units(F.col("p_retailprice"))).alias("um2_per_s"))


@register("effective_diffusion", "SELECT l_orderkey, round(sum(l_quantity * exp(-(1.5 * l_discount) - 0.8 * l_tax)), 6) AS d FROM lineitem GROUP BY 1")
def diffusion(spark, folder):
    d = fc.effective_diffusion(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.lit(1.5), F.lit(0.8))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(r6(F.sum(d)).alias("d"))


@register("row_status", """SELECT c_custkey, concat_ws('|', CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SEGMENT' END, CASE WHEN c_nationkey > 20 THEN 'NATION' END) AS reasons,
CASE WHEN c_acctbal < 0 OR c_mktsegment = 'MACHINERY' OR c_nationkey > 20 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OK' END AS status FROM customer""")
def status(spark, folder):
    reasons = fc.failed_conditions({"NEGATIVE": F.col("c_acctbal") < 0, "SEGMENT": F.col("c_mktsegment") == "MACHINERY", "NATION": F.col("c_nationkey") > 20})
    return table(spark, folder, "customer").withColumn("r", reasons).select("c_custkey", fc.joined(F.col("r")).alias("reasons"), fc.row_status(F.col("r")).alias("status"))


@register("variable_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.95), 6) AS q95 FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def variable_summary(spark, folder):
    from tessella.operators.summaries import variable_summary as op

    found = op(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(found, "mean", "median", "q05", "q95")


@register("region_counts", "SELECT region, count(*) AS rows FROM (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS region FROM lineitem) GROUP BY ALL")
def region_counts(spark, folder):
    from tessella.operators.summaries import region_counts as op

    return op(table(spark, folder, "lineitem").withColumn("region", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))), "region")


