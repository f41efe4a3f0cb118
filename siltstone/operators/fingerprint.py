"""The fingerprint of a repository: metrics by section, dimensions from 0 to 1, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import round4

# What each metric is called, and the aggregate over a table that gives it. Each table is read once for all its metrics.
METRICS: dict[str, dict[str, str]] = {
    "files": {
        "structure.files": "count(*)", "structure.bytes": "sum(bytes)", "structure.lines.total": "sum(lines)", "structure.lines.code": "sum(code)", "structure.lines.comment": "sum(comment)",
        "structure.directories": "count(DISTINCT folder)", "structure.files.generated": "count_if(generated)", "structure.files.vendored": "count_if(vendored)", "structure.files.binary": "count_if(is_binary)", "structure.symbols": "sum(symbols)",
        "languages.count": "count(DISTINCT language)", "quality.files.large": "count_if(code >= 1000)", "tests.files": "count_if(test)", "tests.inline-files": "count_if(inline_tests AND NOT test)",
        "tests.lines": "sum(CASE WHEN test THEN code END)", "tests.ratio": "sum(CASE WHEN test THEN code ELSE 0 END) / nullif(sum(code), 0)", "docs.files": "count_if(document)", "docs.lines": "sum(CASE WHEN document THEN lines END)",
    },
    "languages": {"languages.primary.share": "max(share)"},
    "entrypoints": {"structure.entrypoints": "count(*)"},
    "modules": {"architecture.modules": "count(*)", "architecture.layers": "count(DISTINCT layer)"},
    "module_edges": {"architecture.module-edges": "count(*)"},
    "file_edges": {"architecture.file-edges": "count(*)"},
    "cycles": {"architecture.cycles": "count(*)"},
    "imports": {"architecture.imports.resolved": "count_if(resolved)", "architecture.imports.unresolved": "count_if(NOT resolved)", "architecture.imports.resolution-rate": "count_if(resolved) / nullif(count(*), 0)"},
    "commits": {"git.commits": "count(*)", "git.commits.last-90-days": "count_if(recent)", "git.age.days": "max(age)"},
    "people": {"git.ownership.top-share": "max(commits) / nullif(sum(commits), 0)"},
    "branches": {"git.branches": "count(*)"},
    "tags": {"git.tags": "count(*)", "git.releases": "count_if(release)"},
    "functions": {"quality.functions": "count(*)", "quality.cyclomatic.average": "avg(cyclomatic)", "quality.cyclomatic.median": "median(cyclomatic)", "quality.functions.large": "count_if(lines >= 80)"},
    "markers": {"quality.markers": "count(*)"},
    "unused": {"quality.dead-code-candidates": "count(*)"},
    "duplication": {"quality.duplication.ratio": "sum(duplicated) / nullif(sum(analyzed), 0)", "quality.duplication.clusters": "sum(clusters)"},
    "dependencies": {"dependencies.direct": "count_if(direct)", "dependencies.locked": "count_if(locked)", "dependencies.ecosystems": "count(DISTINCT ecosystem)"},
    "manifests": {"dependencies.manifests": "count(*)"},
    "duplicates": {"dependencies.duplicates": "count(*)"},
    "packages": {"dependencies.concentration.share": "max(share)"},
    "frameworks": {"tests.frameworks": "count(*)"},
    "systems": {"builds.systems": "count(*)"},
    "ci": {"builds.ci": "count(*)"},
    "commands": {"builds.commands": "count(*)"},
    "scanned": {"security.files-scanned": "count(*)"},
    "secrets": {"security.secret-candidates": "count(*)"},
    "hits": {"security.pattern-candidates": "count(*)"},
    "epochs": {"evolution.epochs": "count(*)"},
    "events": {"evolution.events": "count(*)"},
    "snapshots": {"evolution.snapshots": "count(*)"},
    "findings": {
        "findings.critical": "count_if(severity = 'critical' AND NOT suppressed)", "findings.warning": "count_if(severity = 'warning' AND NOT suppressed)", "findings.attention": "count_if(severity = 'attention' AND NOT suppressed)",
        "findings.info": "count_if(severity = 'info' AND NOT suppressed)", "findings.suppressed": "count_if(suppressed)",
    },
}


def raw_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, value) of all metrics whose table is given, in four decimals; what has nothing to divide by is left out.

    A table that is not given is a section that was not analysed, and its metrics are missing, not 0.
    """
    unknown = set(tables) - set(METRICS)
    if unknown or not tables:
        raise ValueError(f"no metrics for {sorted(unknown)}")
    out = None
    for name, df in tables.items():
        one = df.agg(*(F.coalesce(F.expr(sql), F.lit(0)).cast("double").alias(k) if " / " not in sql and not sql.startswith(("avg", "median", "max")) else F.expr(sql).cast("double").alias(k) for k, sql in METRICS[name].items()))
        pairs = F.array(*(F.struct(F.lit(k).alias("id"), round4(F.col(f"`{k}`")).alias("value")) for k in METRICS[name]))
        rows = one.select(F.explode(pairs).alias("m")).select("m.id", "m.value").filter("value is not null")
        out = rows if out is None else out.union(rows)
    return out


# How each dimension follows from its measures, before it is kept between 0 and 1.
DIMENSIONS = {
    "language-diversity": "1 - 1 / nullif(effective_languages, 0)",
    "modularity": "log2(greatest(modules, 1)) / 6",
    "dependency-centrality": "CASE WHEN modules >= 2 THEN max_fan_in / (modules - 1) ELSE 0 END",
    "change-concentration": "concentration",
    "contributor-spread": "1 - 1 / nullif(effective_contributors, 0)",
    "age": "ln(1 + greatest(age_days, 0) / 365.25) / ln(21)",
    "testing": "CASE WHEN test_files + source_files > 0 THEN least(test_files + inline_test_files, test_files + source_files) / (test_files + source_files) ELSE 0 END",
    "documentation": "(checks_present + 0.5 * checks_partial) / nullif(checks, 0)",
}
SIGNALS = {
    "recent-activity": "ln(1 + commits_90) / ln(101)",
    "duplication": "duplication_ratio",
    "import-resolution": "resolved / nullif(resolved + unresolved, 0)",
}


def dimensions(measures: DataFrame, signals: bool = False) -> DataFrame:
    """(id, value) of each dimension, and with signals of those too, from one row of measures; null ones are left out."""
    definitions = DIMENSIONS | (SIGNALS if signals else {})
    pairs = F.array(*(F.struct(F.lit(k).alias("id"), round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr(f"cast({sql} as double)")))).alias("value"), F.expr(f"({sql}) is null").alias("none")) for k, sql in definitions.items()))
    return measures.select(F.explode(pairs).alias("d")).filter("not d.none").select("d.id", "d.value")
