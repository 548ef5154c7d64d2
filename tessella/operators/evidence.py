"""Evidence ledger, readiness, blocked outputs, claims and rule checks, keyed by data set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import attach

# Closed vocabularies of the ledger.
EVIDENCE_CLASSES = (
    "SAME_TISSUE_MEASUREMENT", "EXTERNAL_METHOD_VALIDATION", "EXTERNAL_ASSAY_CALIBRATION", "LITERATURE_PRIOR",
    "PUBLISHED_REFERENCE", "MISSING_REQUIREMENT", "BLOCKED_OUTPUT",
)
RELATIONS = ("SUPPORTS", "CONSTRAINS", "BLOCKED_TRANSFER", "REQUIRED_FOR")
SATISFACTION = {"SATISFIED": 1.0, "PARTIAL": 0.5, "EXTERNAL_ONLY": 0.25, "MISSING": 0.0}
KEY = "dataset_id"


def satisfaction(state: Column) -> Column:
    value = F.lit(None).cast("double")
    for name, number in SATISFACTION.items():
        value = F.when(state == name, F.lit(number)).otherwise(value)
    return value


def ledger_violations(nodes: DataFrame, edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """Every breach of the ledger's vocabularies, ranges and references."""

    def rows(df: DataFrame, kind: str, item: Column, rules: Mapping[str, Column]) -> DataFrame:
        broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
        return df.select(KEY, F.lit(kind).alias("kind"), item.cast("string").alias("item"), F.explode(broken).alias("rule"))

    bad_nodes = rows(nodes, "node", F.col("node_id"), {
        "EVIDENCE_CLASS": ~F.col("evidence_class").isin(*EVIDENCE_CLASSES), "STATUS_EMPTY": F.col("status") == "",
    })
    bad_edges = rows(edges, "edge", F.concat_ws(">", "source", "target"), {
        "RELATION": ~F.col("relation").isin(*RELATIONS),
        "TRANSFERABLE_BLOCK": (F.col("relation") == "BLOCKED_TRANSFER") & F.col("transferable"),
    })
    known = nodes.select(KEY, F.col("node_id").alias("source")).distinct()
    orphans = edges.join(known, [KEY, "source"], "left_anti").select(
        KEY, F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("item"), F.lit("UNKNOWN_SOURCE").alias("rule")
    )
    bad_requirements = rows(requirements, "requirement", F.col("requirement"), {
        "WEIGHT": ~((F.col("weight") > 0) & (F.col("weight") <= 1)), "STATE": satisfaction(F.col("evidence_state")).isNull(),
    })
    return bad_nodes.unionByName(bad_edges).unionByName(orphans).unionByName(bad_requirements)


def evidence_tables(nodes: DataFrame, edges: DataFrame, requirements: DataFrame) -> dict[str, DataFrame]:
    """Typed ledger tables holding only rows without violations, and the violations themselves."""
    broken = ledger_violations(nodes, edges, requirements)

    def clean(df: DataFrame, kind: str, item: Column) -> DataFrame:
        bad = broken.where(F.col("kind") == kind).select(KEY, F.col("item").alias("__item")).distinct()
        return df.withColumn("__item", item.cast("string")).join(bad, [KEY, "__item"], "left_anti").drop("__item")

    return {
        "nodes": clean(nodes, "node", F.col("node_id")), "edges": clean(edges, "edge", F.concat_ws(">", "source", "target")),
        "requirements": clean(requirements, "requirement", F.col("requirement")), "violations": broken,
    }


def artefact_status(documents: DataFrame, text: str, values: Mapping[str, str]) -> DataFrame:
    """Result documents must carry the expected status fragment; values are lifted by JSON path."""
    status = F.get_json_object(text, "$.status")
    return documents.select(
        *[c for c in documents.columns if c != text], status.alias("status"),
        F.coalesce(status.contains(F.col("expected")), F.lit(False)).alias("status_ok"),
        *[F.get_json_object(text, path).alias(name) for name, path in values.items()],
    )


def uncertainty_share(requirements: DataFrame) -> DataFrame:
    """Contribution weight x (1 - satisfaction) and its share; NULL if nothing is unresolved."""
    rated = requirements.withColumn("satisfaction", satisfaction(F.col("evidence_state")))
    rated = rated.withColumn("contribution", F.col("weight") * (1.0 - F.col("satisfaction")))
    totals = rated.groupBy(KEY).agg(F.sum("contribution").alias("__total"))
    return attach(rated, totals, [KEY]).withColumn(
        "uncertainty_share", F.col("contribution") / F.when(F.col("__total") > 0, F.col("__total"))
    ).drop("__total")


def readiness_score(requirements: DataFrame) -> DataFrame:
    """100 x sum of weight x satisfaction; withheld when the weights do not sum to one."""
    value = satisfaction(F.col("evidence_state"))
    found = requirements.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("requirements_total"), F.count_if(F.col("evidence_state") == "SATISFIED").alias("requirements_satisfied"),
        F.sum(F.col("weight") * value).alias("__s"), F.sum("weight").alias("__w"), F.count_if(value.isNull()).alias("__bad"),
    )
    valid = (F.abs(F.col("__w") - 1.0) <= 1e-12) & (F.col("__bad") == 0)
    return found.select(
        KEY, "requirements_total", "requirements_satisfied", F.when(valid, 100.0 * F.col("__s")).alias("readiness_score"),
        F.when(valid, "COMPUTED").otherwise("NOT_COMPUTED").alias("status"),
    )


def measurement_priority(requirements: DataFrame) -> DataFrame:
    """Requirements with a next measurement by descending share, then name; rank 1 dominates."""
    shares = uncertainty_share(requirements).where(F.col("next_measurement").isNotNull())
    order = Window.partitionBy(KEY).orderBy(F.desc("uncertainty_share"), "requirement")
    ranked = shares.withColumn("rank", F.row_number().over(order))
    return ranked.select(KEY, "rank", "requirement", "uncertainty_share", "evidence_state", "next_measurement", (F.col("rank") == 1).alias("dominant"))


def blocked_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each output and missing node that it needs, with the output's number of them."""
    missing = nodes.where(F.col("evidence_class") == "MISSING_REQUIREMENT").select(KEY, F.col("node_id").alias("source")).distinct()
    needed = edges.where(F.col("relation") == "REQUIRED_FOR").join(missing, [KEY, "source"], "left_semi")
    distinct = needed.select(KEY, "target", "source").distinct()
    counts = distinct.groupBy(KEY, "target").agg(F.count(F.lit(1)).alias("missing_nodes"))
    return distinct.join(counts, [KEY, "target"]).select(
        KEY, F.col("target").alias("output"), "missing_nodes", F.col("source").alias("missing_node"), F.lit("NOT_COMPUTED").alias("status")
    )


def blocked_transfers(edges: DataFrame) -> DataFrame:
    """Per data set: blocked transfers and whether all of them are marked non-transferable."""
    return edges.where(F.col("relation") == "BLOCKED_TRANSFER").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("blocked_transfers"), F.bool_and(~F.col("transferable")).alias("all_non_transferable")
    )


def rule_check(facts: DataFrame, rules: Sequence[tuple[str, Column, str]], by: Sequence[str] = (KEY,)) -> DataFrame:
    """Evaluate (code, condition, message) rules on one row of facts per group.

    Returns code, passed and message of every rule; an unknown condition fails.
    """
    items = F.array(*[
        F.struct(F.lit(code).alias("code"), F.coalesce(condition, F.lit(False)).alias("passed"), F.lit(message).alias("message"))
        for code, condition, message in rules
    ])
    return facts.select(*by, F.inline(items))


def rule_status(checked: DataFrame, by: Sequence[str] = (KEY,)) -> DataFrame:
    """Number of checks and issues, failed codes and PASS or FAIL per group."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("code"))))
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("issues"), F.array_join(failed, "|").alias("failed_codes"),
        F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"),
    )


def claims(runs: DataFrame, claim_table: DataFrame) -> DataFrame:
    """Claims of every run: ``claim_table`` has (kind, claim, when_status); NULL status means always.

    ``runs``: dataset_id, status, reasons (text).
    """
    kinds = claim_table.select("kind", "claim", "when_status")
    always = kinds.where("when_status IS NULL").agg(F.collect_list(F.struct("kind", "claim")).alias("__always"))
    sometimes = kinds.where("when_status IS NOT NULL").withColumnRenamed("when_status", "status")
    fixed = attach(runs, always).select(KEY, "status", "reasons", F.inline("__always"))
    extra = runs.join(sometimes, "status").select(KEY, "status", "reasons", "kind", "claim")
    return fixed.unionByName(extra).withColumn("abstention", F.when(F.col("status") != "OK", F.col("reasons")).otherwise(""))
