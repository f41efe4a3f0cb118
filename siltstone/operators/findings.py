"""Operators over findings: (id, rule, severity, category, title, path). Severities rank critical, high, medium, low, info."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import glob_regex, wildcard_regex

SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def unique(findings: DataFrame) -> DataFrame:
    """One finding an id: the most severe, of equals the smallest (rule, title, path, category)."""
    order = Window.partitionBy("id").orderBy(F.desc(severity_rank(F.col("severity"))), "rule", "title", "path", "category")
    return findings.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def display_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), "category", "rule", "path", "id")


def highlights(findings: DataFrame, limit: int) -> DataFrame:
    """The first of each rule, then the rest, in order of display, so many in all."""
    place = [F.desc(severity_rank(F.col("severity"))), "rule", "path", "id"]
    again = F.row_number().over(Window.partitionBy("rule").orderBy(*place)) > 1
    return findings.withColumn("again", again).orderBy("again", *place).limit(limit).drop("again")


def capped(findings: DataFrame, cap: int, measure: str) -> DataFrame:
    """At most so many findings a rule, the largest first, and how many were left out."""
    order = Window.partitionBy("rule").orderBy(F.desc(measure), "path", "id")
    n = F.count("*").over(Window.partitionBy("rule"))
    return findings.withColumn("n", F.row_number().over(order)).withColumn("omitted", F.greatest(n - cap, F.lit(0))).filter(F.col("n") <= cap).drop("n")


def suppressed(findings: DataFrame, rules: list[dict[str, str]]) -> DataFrame:
    """findings with the place of the first rule that suppresses each (null: none); none is dropped.

    A rule may name a wildcard over rule ids, an id, and a glob over paths; all that it names must fit.
    Rules are configuration, few and compiled into one conditional expression.
    """
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        test = F.lit(True)
        if r.get("rule"):
            test &= F.col("rule").rlike(wildcard_regex(r["rule"]))
        if r.get("id"):
            test &= F.col("id") == r["id"]
        if r.get("path"):
            test &= F.col("path").rlike(glob_regex(r["path"]))
        out = F.when(test, F.lit(k)).otherwise(out)
    return findings.withColumn("suppressed_by", out)


def counts(findings: DataFrame) -> DataFrame:
    """One row: how many of each severity are not suppressed, and how many are."""
    active = F.col("suppressed_by").isNull()
    return findings.agg(*(F.count_if(active & (F.col("severity") == s)).alias(s) for s in SEVERITIES), F.count_if(~active).alias("suppressed"))


def matching(findings: DataFrame, least: str = "info", prefix: str = "", search: str = "", with_suppressed: bool = False) -> DataFrame:
    """Filter by severity, start of the rule, suppression and words that all occur in the text, in any case."""
    text = F.lower(F.concat_ws(" ", "title", "rule", "category", "path"))
    out = findings.filter((severity_rank(F.col("severity")) >= SEVERITIES.index(least) + 1) & F.col("rule").startswith(prefix))
    for word in search.lower().split():
        out = out.filter(text.contains(word))
    return out if with_suppressed else out.filter("suppressed_by is null")


def changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change, severity): introduced and resolved findings that are not suppressed, worst first."""
    a, b = (df.filter("suppressed_by is null").select("id", "severity").dropDuplicates(["id"]) for df in (baseline, current))
    new = b.join(a, "id", "left_anti").select("id", F.lit("introduced").alias("change"), "severity")
    return new.union(a.join(b, "id", "left_anti").select("id", F.lit("resolved").alias("change"), "severity")).orderBy(F.desc(severity_rank(F.col("severity"))), "id")


def policy_failed(found: DataFrame, fail_on: str) -> DataFrame:
    """One row (failed, introduced): whether a finding of such a severity or worse is new."""
    new = F.col("change") == "introduced"
    return found.agg(F.coalesce(F.bool_or(new & (severity_rank(F.col("severity")) >= SEVERITIES.index(fail_on) + 1)), F.lit(False)).alias("failed"), F.count_if(new).alias("introduced"))


def sarif_result() -> Column:
    """A finding as a SARIF result."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    return F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("id").alias("stableId")).alias("partialFingerprints"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(json) of a SARIF result for each finding."""
    return findings.select(F.to_json(sarif_result()).alias("json"))
