"""Audits: rows that break a rule, never an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from folioworks.schemas import AUTHORITIES, BATCH_STATES, STATUSES

#: D-04: (name, what must hold); a null result passes, as with a CHECK constraint.
OBJECT_RULES = {
    "authority_status_valid": "authority_status in ({})".format(", ".join(map(repr, AUTHORITIES))),
    "verification_status_valid": "verification_status in ({})".format(", ".join(map(repr, STATUSES))),
    "synthesized_not_authoritative": "object_type <> 'synthesized_rule' or authority_status = 'non_authoritative'",
    "synthesized_not_citable": "object_type <> 'synthesized_rule' or not usable_as_citation",
}
MENTION_RULES = {
    "unresolved_without_target": "resolution_status <> 'unresolved' or (target_object_id is null and not usable_as_authority)",
    "resolved_with_target": "resolution_status <> 'resolved' or target_object_id is not null",
}
BATCH_RULES = {"batch_status_valid": "status in ({})".format(", ".join(map(repr, BATCH_STATES)))}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def constraint_violations(table: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """D-04: (key, rule) for each rule that is false for a row; all rules in one scan."""
    checks = F.array(*(F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()))
    return table.select(key, F.explode(F.array_compact(checks)).alias("rule"))


def duplicate_keys(table: DataFrame, keys: list[str], where: str = "true", not_null: bool = True) -> DataFrame:
    """D-05: keys that occur more than once; a partial index has a condition, and rows with a
    null in the key don't count unless ``not_null`` is off."""
    rows = table.where(where)
    if not_null:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(child: DataFrame, link: str, parent: DataFrame, key: str) -> DataFrame:
    """D-06: children whose link is not null and has no parent."""
    return child.where(F.col(link).isNotNull()).join(parent.select(F.col(key).alias("_p")).distinct(), F.col(link) == F.col("_p"), "left_anti")


# Fixed values of the graph's records.
NODE_FIELDS, LEAST_ID = ("id", "node_type", "title", "status"), 3


def graph_violations(nodes: DataFrame, node_types: DataFrame, statuses: DataFrame) -> DataFrame:
    """D-07: (id, problem): missing fields, too short ids, types and statuses unknown to the
    enumerations (tables of one column, value)."""
    missing = F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in NODE_FIELDS), F.when(F.length("id") < LEAST_ID, F.lit("short id")))
    fields = nodes.select("id", F.explode(F.array_compact(missing)).alias("problem"))
    kinds = nodes.where("node_type is not null").join(node_types, nodes["node_type"] == node_types["value"], "left_anti").select("id", F.lit("unknown node_type").alias("problem"))
    states = nodes.where("status is not null").join(statuses, nodes["status"] == statuses["value"], "left_anti").select("id", F.lit("unknown status").alias("problem"))
    return _union([fields, kinds, states])


def assignment_integrity(assigned: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """J-11: (problem, key): duplicate, foreign and missing ids of an assignment. Duplicates
    and foreign ids abort a batch, missing ones only warn (column ``aborts``)."""
    dup = assigned.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"), F.lit(True).alias("aborts"))
    foreign = assigned.select(key).distinct().join(expected.select(key), key, "left_anti").select(key, F.lit("foreign").alias("problem"), F.lit(True).alias("aborts"))
    missing = expected.select(key).distinct().join(assigned.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"), F.lit(False).alias("aborts"))
    return _union([dup, foreign, missing])


def expected_counts(registry: DataFrame, found: DataFrame, key: str, expected: str = "expected") -> DataFrame:
    """J-19: registry rows with the number of rows found and whether both differ."""
    counts = found.groupBy(key).agg(F.count("*").alias("detected"))
    return registry.join(counts, key, "full_outer").withColumns({"detected": F.coalesce("detected", F.lit(0))}).withColumn("alert", ~F.col(expected).eqNullSafe(F.col("detected")))


def phantom_claims(reports: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """J-20: reports that claim artifacts of which there are none, unless retracted."""
    actual = artifacts.groupBy(key).agg(F.count("*").alias("actual"))
    met = reports.join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return met.where((F.col("claimed") > 0) & (F.col("actual") == 0) & ~F.coalesce("retracted", F.lit(False)))


def duplicate_ids_in_lines(lines: DataFrame, pattern: str, value: str = "value") -> DataFrame:
    """A-15: ids that index lines name more than once."""
    ids = lines.select(F.regexp_extract(value, pattern, 1).alias("id")).where("id <> ''")
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def batch_verdicts(findings: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """P-06: (key, severity 1 warning / 2 error) to pass, pass_with_warnings or fail a batch."""
    worst = findings.groupBy(key).agg(F.max("severity").alias("_s"))
    verdict = F.when(F.coalesce("_s", F.lit(0)) == 0, "pass").when(F.col("_s") == 1, "pass_with_warnings").otherwise("fail")
    return batches.select(key).distinct().join(worst, key, "left").select(key, verdict.alias("verdict"))


def rule_support(rules: DataFrame, least: int = 2) -> DataFrame:
    """P-07: rules with fewer than ``least`` different sources are provisional."""
    n = F.size(F.array_distinct(F.coalesce("supported_by", F.array().cast("array<string>"))))
    return rules.withColumn("n_sources", n).withColumn("provisional", n < least)
