"""Evidence ledger per data set (nation): customers are nodes, orders are edges."""

from pyspark.sql import functions as F

from checks.registry import register, rounded, table
from tessella.operators import evidence as ev

CLASS = "CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ev.EVIDENCE_CLASSES)) + " WHEN 7 THEN 'MISSING_REQUIREMENT' ELSE 'HEARSAY' END"
WEIGHT = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.3 WHEN '2' THEN 0.25 WHEN '3' THEN 0.2 WHEN '4' THEN 0.15 ELSE 0.1 END"
STATE = "CASE WHEN s < 0.36 THEN 'MISSING' WHEN s < 0.40 THEN 'EXTERNAL_ONLY' WHEN s < 0.44 THEN 'PARTIAL' ELSE 'SATISFIED' END"
NODES = f"nodes AS (SELECT c_nationkey AS dataset_id, 'N' || c_custkey AS node_id, {CLASS} AS evidence_class, CASE WHEN c_acctbal < -900 THEN '' ELSE 'AVAILABLE' END AS status FROM customer)"
EDGES = "edges AS (SELECT c_nationkey AS dataset_id, 'N' || (o_custkey + CASE WHEN o_orderkey % 500 = 1 THEN 10000000 ELSE 0 END) AS source, o_orderpriority AS target, CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'REQUIRED_FOR' ELSE 'BLOCKED_TRANSFER' END AS relation, o_totalprice > 480000 AS transferable FROM orders JOIN customer ON c_custkey = o_custkey)"
REQ = f"""rs AS (SELECT c_nationkey AS dataset_id, o_orderpriority, CAST({WEIGHT} AS DOUBLE) AS weight, avg(CAST(o_totalprice > 300000 AS INT)) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
req AS (SELECT dataset_id, o_orderpriority AS requirement, weight, {STATE} AS evidence_state, CASE WHEN dataset_id % 5 <> 0 THEN 'measure ' || o_orderpriority END AS next_measurement FROM rs),
shr AS (SELECT *, CASE evidence_state WHEN 'SATISFIED' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'EXTERNAL_ONLY' THEN 0.25 ELSE 0.0 END::DOUBLE AS satisfaction FROM req), sh AS (SELECT *, weight * (1 - satisfaction) AS contribution, weight * (1 - satisfaction) / nullif(sum(weight * (1 - satisfaction)) OVER (PARTITION BY dataset_id), 0) AS share FROM shr)"""


def nodes(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "c_nationkey AS dataset_id", "concat('N', c_custkey) AS node_id", f"{CLASS} AS evidence_class", "IF(c_acctbal < -900, '', 'AVAILABLE') AS status"
    )


def with_customer(spark, folder):
    return table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))


def edges(spark, folder):
    return with_customer(spark, folder).selectExpr(
        "c_nationkey AS dataset_id", "concat('N', o_custkey + IF(o_orderkey % 500 = 1, 10000000, 0)) AS source", "o_orderpriority AS target",
        "CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'REQUIRED_FOR' ELSE 'BLOCKED_TRANSFER' END AS relation", "o_totalprice > 480000 AS transferable",
    )


def requirements(spark, folder):
    per = with_customer(spark, folder).groupBy(F.col("c_nationkey").alias("dataset_id"), "o_orderpriority").agg(F.avg((F.col("o_totalprice") > 300000).cast("double")).alias("s"))
    return per.selectExpr(
        "dataset_id", "o_orderpriority AS requirement", f"CAST({WEIGHT} AS DOUBLE) AS weight", f"{STATE} AS evidence_state",
        "IF(dataset_id % 5 <> 0, concat('measure ', o_orderpriority), NULL) AS next_measurement",
    )


@register("ledger_violations", f"""WITH {NODES}, {EDGES}, v AS (SELECT dataset_id, 'node' AS kind, node_id AS item, 'EVIDENCE_CLASS' AS rule FROM nodes WHERE evidence_class = 'HEARSAY' UNION ALL SELECT dataset_id, 'node', node_id, 'STATUS_EMPTY' FROM nodes WHERE status = ''
UNION ALL SELECT dataset_id, 'edge', source || '>' || target, 'TRANSFERABLE_BLOCK' FROM edges WHERE relation = 'BLOCKED_TRANSFER' AND transferable UNION ALL SELECT dataset_id, 'edge', source || '>' || target, 'UNKNOWN_SOURCE' FROM edges WHERE source NOT IN (SELECT node_id FROM nodes)) SELECT dataset_id, kind, rule, count(*) AS violations, min(item) AS first_item FROM v GROUP BY ALL""")
def violations(spark, folder):
    found = ev.ledger_violations(nodes(spark, folder), edges(spark, folder), requirements(spark, folder))
    return found.groupBy("dataset_id", "kind", "rule").agg(F.count("*").alias("violations"), F.min("item").alias("first_item"))


@register("evidence_tables", f"""WITH {NODES} SELECT dataset_id, evidence_class, count(*) AS nodes FROM nodes WHERE evidence_class <> 'HEARSAY' AND status <> '' GROUP BY ALL""")
def evidence_tables(spark, folder):
    clean = ev.evidence_tables(nodes(spark, folder), edges(spark, folder), requirements(spark, folder))["nodes"]
    return clean.groupBy("dataset_id", "evidence_class").agg(F.count("*").alias("nodes"))


@register("artefact_status", "SELECT event_id, upper(event_type) || '_COMPUTED' AS status, event_type = 'error' AS status_ok, CAST(CAST(props::JSON->>'k' AS BIGINT) AS VARCHAR) AS k FROM events")
def artefacts(spark, folder):
    docs = table(spark, folder, "events").selectExpr("event_id", "concat('{\"status\":\"', upper(event_type), '_COMPUTED\",\"results\":', props, '}') AS text", "'ERROR_COMP' AS expected")
    return ev.artefact_status(docs, "text", {"k": "$.results.k"}).drop("expected")


@register("readiness_score", f"WITH {REQ} SELECT dataset_id, count(*) AS requirements_total, count(*) FILTER (WHERE evidence_state = 'SATISFIED') AS requirements_satisfied, CASE WHEN abs(sum(weight) - 1) <= 1e-12 THEN round(100 * sum(weight * satisfaction), 6) END AS readiness_score, CASE WHEN abs(sum(weight) - 1) <= 1e-12 THEN 'COMPUTED' ELSE 'NOT_COMPUTED' END AS status FROM sh GROUP BY 1")
def readiness(spark, folder):
    return rounded(ev.readiness_score(requirements(spark, folder)), "readiness_score")


@register("uncertainty_share", f"WITH {REQ} SELECT dataset_id, requirement, round(contribution, 6) AS contribution, round(share, 6) AS uncertainty_share FROM sh")
def shares(spark, folder):
    return rounded(ev.uncertainty_share(requirements(spark, folder)), "contribution", "uncertainty_share").select("dataset_id", "requirement", "contribution", "uncertainty_share")


@register("measurement_priority", f"""WITH {REQ}, r AS (SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY share DESC NULLS LAST, requirement) AS INT) AS rank, requirement, round(share, 6) AS uncertainty_share, evidence_state, next_measurement FROM sh WHERE next_measurement IS NOT NULL) SELECT *, rank = 1 AS dominant FROM r""")
def priority(spark, folder):
    return rounded(ev.measurement_priority(requirements(spark, folder)), "uncertainty_share")


@register("blocked_outputs", f"""WITH {NODES}, {EDGES}, n AS (SELECT DISTINCT e.dataset_id, e.target, e.source FROM edges e JOIN nodes m ON m.dataset_id = e.dataset_id AND m.node_id = e.source WHERE relation = 'REQUIRED_FOR' AND evidence_class = 'MISSING_REQUIREMENT')
SELECT dataset_id, target AS output, count(*) OVER (PARTITION BY dataset_id, target) AS missing_nodes, source AS missing_node, 'NOT_COMPUTED' AS status FROM n""")
def blocked(spark, folder):
    return ev.blocked_outputs(nodes(spark, folder), edges(spark, folder))


@register("blocked_transfers", f"WITH {EDGES} SELECT dataset_id, count(*) AS blocked_transfers, bool_and(NOT transferable) AS all_non_transferable FROM edges WHERE relation = 'BLOCKED_TRANSFER' GROUP BY 1")
def transfers(spark, folder):
    return ev.blocked_transfers(edges(spark, folder))


FACTS = "facts AS (SELECT c_nationkey AS dataset_id, count(*) AS orders, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS states, sum(o_totalprice) / count(*) AS ratio, avg(o_totalprice) AS mean, max(o_totalprice) AS mx FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"
RULES = [
    ("ROW_COUNT", "orders >= 600", "enough rows"), ("GRID_COMPLETE", "priorities = 5 AND states = 3", "all combinations present"),
    ("RATIO_RECOMPUTED", "abs(ratio - mean) <= 1e-6", "ratio equals the stored mean"), ("CEILING", "mx < 499900", "maximum below ceiling"),
]
CHECKED = f"{FACTS}, chk AS (" + " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS code, {e} AS passed, '{m}' AS message FROM facts" for c, e, m in RULES) + ")"


def checked(spark, folder):
    facts = with_customer(spark, folder).groupBy(F.col("c_nationkey").alias("dataset_id")).agg(
        F.count("*").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderstatus").alias("states"),
        (F.sum("o_totalprice") / F.count("*")).alias("ratio"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("mx"),
    )
    return ev.rule_check(facts, [(c, F.expr(e), m) for c, e, m in RULES])


@register("rule_check", f"WITH {CHECKED} SELECT * FROM chk")
def rules(spark, folder):
    return checked(spark, folder)


@register("rule_status", f"WITH {CHECKED} SELECT dataset_id, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS issues, coalesce(string_agg(code, '|' ORDER BY code) FILTER (WHERE NOT passed), '') AS failed_codes, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM chk GROUP BY 1")
def status(spark, folder):
    return ev.rule_status(checked(spark, folder))


CLAIMS = [("permitted", "relative geometry", None), ("unsupported", "clinical efficacy", None), ("permitted", "run abstained", "INSUFFICIENT_EVIDENCE"), ("conditional", "stable under ranges", "OK")]
CV = ", ".join("('{}', '{}', {})".format(k, c, "NULL" if s is None else f"'{s}'") for k, c, s in CLAIMS)


@register("claims", f"""WITH runs AS (SELECT c_custkey AS dataset_id, CASE WHEN c_acctbal < 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OK' END AS status, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' ELSE '' END AS reasons FROM customer), ct AS (SELECT * FROM (VALUES {CV}) AS t(kind, claim, when_status))
SELECT dataset_id, status, reasons, kind, claim, CASE WHEN status <> 'OK' THEN reasons ELSE '' END AS abstention FROM runs JOIN ct ON when_status IS NULL OR when_status = status""")
def claims(spark, folder):
    runs = table(spark, folder, "customer").selectExpr("c_custkey AS dataset_id", "IF(c_acctbal < 0, 'INSUFFICIENT_EVIDENCE', 'OK') AS status", "IF(c_acctbal < 0, 'NEGATIVE', '') AS reasons")
    return ev.claims(runs, spark.createDataFrame(CLAIMS, "kind string, claim string, when_status string"))
