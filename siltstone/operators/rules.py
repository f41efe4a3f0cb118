"""Rules that make findings from measured tables, as data: what a rule looks at, when it fires, what it says and how often at most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import stable_id


@dataclass(frozen=True)
class FindingRule:
    """A rule over one table. `when`, `subject`, `title`, `path` and `value` are SQL over its columns; `order` sorts what is kept under the cap."""

    id: str
    category: str
    severity: str
    confidence: str
    table: str
    when: str
    subject: str
    title: str
    order: tuple[str, ...]
    value: str = "CAST(NULL AS DOUBLE)"
    threshold: float | None = None
    path: str = "CAST(NULL AS STRING)"
    cap: int = 20


def share(x: str) -> str:
    """A share in whole percent, halves up."""
    return f"CAST(CAST(floor(({x}) * 100 + 0.5) AS BIGINT) AS STRING)"


# Thresholds, caps and grades of the rules are part of the results.
QUALITY = (
    FindingRule("quality.complex-function", "complexity", "attention", "medium", "functions", "cyclomatic >= 15", "concat(path, '#', name)", "concat(name, ' has complexity ', CAST(cyclomatic AS STRING))", ("cyclomatic DESC", "path", "name"), "cyclomatic", 15, "path"),
    FindingRule("quality.long-function", "complexity", "attention", "medium", "functions", "lines >= 80", "concat(path, '#', name)", "concat(name, ' is ', CAST(lines AS STRING), ' lines long')", ("lines DESC", "path", "name"), "lines", 80, "path"),
    FindingRule("quality.deep-nesting", "complexity", "attention", "medium", "functions", "nesting >= 5", "concat(path, '#', name)", "concat(name, ' nests ', CAST(nesting AS STRING), ' levels deep')", ("nesting DESC", "path", "name"), "nesting", 5, "path"),
    FindingRule("quality.large-file", "complexity", "attention", "high", "files", "code >= 1000", "path", "concat(path, ' has ', CAST(code AS STRING), ' code lines')", ("code DESC", "path"), "code", 1000, "path"),
    FindingRule("quality.duplicate-block", "duplication", "attention", "high", "clusters", "places > 1", "cluster", "concat(CAST(lines AS STRING), ' lines duplicated in ', CAST(places AS STRING), ' places')", ("lines DESC", "cluster"), "lines", None, "path"),
    FindingRule("quality.duplication-ratio", "duplication", "attention", "high", "totals", "analyzed > 0 AND duplicated >= 50 AND duplicated >= 0.05 * analyzed", "'repository'", f"concat({share('duplicated / analyzed')}, '% of analyzed code is duplicated')", (), "duplicated / analyzed", 0.05),
    FindingRule("quality.similar-files", "duplication", "info", "medium", "pairs", "similarity >= 0.8", "concat(a, '|', b)", f"concat(a, ' and ', b, ' are ', {share('similarity')}, '% similar')", ("similarity DESC", "a", "b"), "similarity", 0.8, "a", 10),
    FindingRule("quality.markers", "maintainability", "info", "high", "totals", "markers > 0", "'repository'", "concat(CAST(markers AS STRING), ' TODO-style markers in comments')", (), "markers"),
    FindingRule("quality.dead-code", "maintainability", "info", "low", "unused", "path IS NOT NULL", "path", "concat('Unused file: ', path)", ("path",), path="path"),
)
ARCHITECTURE = (
    FindingRule("architecture.module-cycle", "architecture", "warning", "medium", "cycles", "size > 1", "cycle", "concat(CAST(size AS STRING), ' modules depend on each other')", ("size DESC", "cycle"), "size", cap=1_000),
    FindingRule("architecture.file-cycle", "architecture", "attention", "medium", "file_cycles", "size > 1", "array_join(members, ',')", "CASE WHEN size = 2 THEN concat('Import cycle between ', regexp_extract(members[0], '[^/]*$', 0), ' and ', regexp_extract(members[1], '[^/]*$', 0)) ELSE concat('Import cycle between ', CAST(size AS STRING), ' files') END", ("size DESC", "array_join(members, ',')"), "size", path="members[0]"),
    FindingRule("architecture.concentration", "architecture", "attention", "high", "modules", "modules >= 4 AND place = 1 AND code >= 0.5 * total_code", "module", f"concat(module, ' holds ', {share('code / total_code')}, '% of the code')", ("code DESC", "module"), "code / total_code", 0.5, "module", 1),
    FindingRule("architecture.centrality", "architecture", "info", "medium", "modules", "modules >= 4 AND centrality >= 0.3", "module", "concat(module, ' connects many parts of the system')", ("module",), "centrality", 0.3, "module", 1_000),
    FindingRule("architecture.isolated-module", "architecture", "info", "low", "modules", "modules >= 3 AND fan_in = 0 AND fan_out = 0 AND NOT consumer", "module", "concat(module, ' has no detected links to other modules')", ("module",), path="module", cap=10),
    FindingRule("architecture.unresolved", "architecture", "info", "high", "imports", "resolved + unresolved >= 20 AND unresolved >= 0.3 * (resolved + unresolved)", "'imports'", f"concat({share('unresolved / (resolved + unresolved)')}, '% of repository imports could not be resolved')", (), "unresolved / (resolved + unresolved)", 0.3),
)
DEPENDENCIES = (
    FindingRule("dependencies.lock-mismatch", "dependencies", "warning", "medium", "locks", "missing > 0", "lockfile", "concat(lockfile, ' does not lock every declared dependency')", ("lockfile",), "missing", None, "lockfile", 1_000),
    FindingRule("dependencies.no-lockfile", "dependencies", "info", "medium", "ecosystems", "NOT locked AND declares AND ecosystem IN ('npm', 'composer', 'rubygems', 'go', 'pub')", "ecosystem", "concat('No ', ecosystem, ' lockfile is committed')", ("ecosystem",)),
    FindingRule("dependencies.duplicate-versions", "dependencies", "info", "high", "totals", "several > 0", "'repository'", "concat(CAST(several AS STRING), CASE WHEN several = 1 THEN ' package is' ELSE ' packages are' END, ' locked at more than one version')", (), "several"),
    FindingRule("dependencies.stale-manifest", "dependencies", "info", "medium", "manifests", "days >= 365", "manifest", "concat(manifest, ' has not changed in ', CAST(days AS STRING), ' days')", ("days DESC", "manifest"), "days", 365, "manifest", 5),
    FindingRule("dependencies.concentration", "dependencies", "info", "medium", "packages", "place = 1 AND share >= 0.5 AND importers >= 10", "package", "concat(package, ' is imported by ', CAST(importers AS STRING), ' files')", ("share DESC", "package"), "share", 0.5, cap=1),
)
PROJECT = (
    FindingRule("tests.none", "tests", "attention", "medium", "project", "NOT has_tests AND source_files >= 10", "'repository'", "'No automated tests were detected'", (), "source_files"),
    FindingRule("tests.low-ratio", "tests", "info", "medium", "project", "test_files > 0 AND NOT inline_tests AND test_ratio < 0.05 AND source_lines >= 2000", "'repository'", "'Little test code relative to source code'", (), "test_ratio", 0.05),
    FindingRule("tests.not-in-ci", "tests", "info", "medium", "project", "ci_files > 0 AND has_tests AND ci_test_commands = 0", "'repository'", "'CI configuration does not appear to run the tests'", (), "ci_files"),
    FindingRule("build.no-ci", "build", "info", "medium", "project", "ci_files = 0 AND source_files >= 20", "'repository'", "'No CI configuration was detected'", (), "source_files"),
    FindingRule("tests.coverage-committed", "tests", "info", "high", "project", "coverage_files > 0", "'repository'", "'Coverage reports are committed'", (), "coverage_files"),
    FindingRule("docs.readme-missing", "documentation", "attention", "high", "project", "readme_words IS NULL", "'repository'", "'No README was found'", ()),
    FindingRule("docs.readme-short", "documentation", "info", "high", "project", "readme_words < 30 OR NOT readme_at_root", "'repository'", "'The README is very short or not at the root'", (), "readme_words"),
    FindingRule("docs.setup-instructions", "documentation", "info", "medium", "project", "readme_words >= 30 AND readme_at_root AND NOT (installation AND usage)", "'repository'", "concat('The README has no ', CASE WHEN installation THEN 'usage' WHEN usage THEN 'installation' ELSE 'installation or usage' END, ' section')", ()),
    FindingRule("docs.license-missing", "documentation", "attention", "high", "project", "NOT license_file AND NOT license_declared", "'repository'", "'No license was found'", ()),
    FindingRule("docs.license-file-missing", "documentation", "info", "high", "project", "NOT license_file AND license_declared", "'repository'", "'A license is declared but no license file exists'", ()),
    FindingRule("docs.optional-missing", "documentation", "info", "high", "project", "optional_missing > 0", "'repository'", "'Some optional project documents were not detected'", (), "optional_missing"),
)
HISTORY = (
    FindingRule("activity.high-churn-area", "activity", "info", "high", "areas", "recent_changes >= 10 AND active_areas >= 2 AND share >= 0.3 AND NOT is_parent", "area", f"concat({share('share')}, '% of recent changes are in ', CASE WHEN area = '(root)' THEN 'files at the repository root' ELSE concat(area, '/') END)", ("share DESC", "area"), "share", 0.3, "CASE WHEN area = '(root)' THEN NULL ELSE area END", 3),
    FindingRule("contributors.concentration", "contributors", "info", "high", "ownership", "commits >= 20 AND top_share >= 0.75", "'repository'", f"CASE WHEN contributors <= 1 THEN 'All commits come from one contributor identity' ELSE concat({share('top_share')}, '% of commits come from one contributor identity') END", (), "top_share", 0.75),
    FindingRule("activity.hotspot", "activity", "attention", "medium", "hotspots", "candidates >= 10 AND score >= 0.6", "path", "concat(path, ' is a change hotspot (rank ', CAST(rank AS STRING), ')')", ("rank",), "score", 0.6, "path", 5),
    FindingRule("evolution.new-module", "evolution", "info", "high", "ages", "class = 'new'", "module", "concat(module, ' is a new module')", ("module",), path="module", cap=5),
    FindingRule("evolution.dormant-period", "activity", "info", "high", "pauses", "days >= 180", "CAST(start AS STRING)", "concat('No commits for ', CAST(days AS STRING), ' days')", ("days DESC", "start"), "days", 180, cap=5),
    FindingRule("evolution.abandoned-area", "maintainability", "info", "medium", "abandoned", "days >= 365", "area", "concat(area, ' has not changed in ', CAST(days AS STRING), ' days')", ("days DESC", "area"), "days", 365, "area", 5),
)
_BYTES = "CASE WHEN bytes < 1024 THEN concat(CAST(bytes AS STRING), ' bytes') WHEN bytes < 1048576 THEN concat(format_number(bytes / 1024, '0.0'), ' KiB') WHEN bytes < 1073741824 THEN concat(format_number(bytes / 1048576, '0.0'), ' MiB') ELSE concat(format_number(bytes / 1073741824, '0.0'), ' GiB') END"
STRUCTURE = (
    FindingRule("structure.large-binary", "structure", "info", "high", "files", "is_binary AND bytes >= 5242880", "path", f"concat(path, ' is a ', {_BYTES}, ' binary file')", ("bytes DESC", "path"), "bytes", 5242880, "path", 20),
)
SECURITY = (
    FindingRule("security.secret-candidate", "security", "high", "medium", "secrets", "NOT sample", "concat(path, ':', CAST(line AS STRING))", "concat('Possible secret in ', path)", ("path", "line"), path="path", cap=50),
    FindingRule("security.permission", "security", "attention", "high", "permissions", "path IS NOT NULL", "path", "concat(path, ' has mode ', mode)", ("path",), path="path", cap=50),
    FindingRule("security.pattern", "security", "warning", "medium", "hits", "confidence = 'high'", "concat(rule, '|', path, ':', CAST(line AS STRING))", "concat(rule, ' in ', path)", ("rule", "path", "line"), path="path", cap=50),
    FindingRule("security.pattern-review", "security", "attention", "low", "hits", "confidence <> 'high'", "concat(rule, '|', path, ':', CAST(line AS STRING))", "concat(rule, ' in ', path)", ("rule", "path", "line"), path="path", cap=50),
)


def emit(rows: DataFrame, rule: FindingRule) -> DataFrame:
    """(id, rule, category, severity, confidence, subject, title, path, value, threshold, omitted) of the rows for which a rule fires.

    At most `cap` rows, the first in the rule's order, which a top-k finds in each partition first;
    omitted says how many fired beyond them. A condition that is null does not fire.
    """
    shown = rows.filter(rule.when)
    columns = [F.expr(rule.subject).cast("string").alias("subject"), F.expr(rule.title).alias("title"), F.expr(rule.path).cast("string").alias("path"), F.expr(rule.value).cast("double").alias("value")]
    order = [F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x) for x in rule.order]
    total = shown.agg(F.greatest(F.count("*") - rule.cap, F.lit(0)).alias("omitted"))
    top = (shown.orderBy(*order) if order else shown).limit(rule.cap).select(*columns).crossJoin(F.broadcast(total))
    fixed = [F.lit(x).alias(k) for k, x in (("rule", rule.id), ("category", rule.category), ("severity", rule.severity), ("confidence", rule.confidence))]
    threshold = F.lit(rule.threshold).cast("double").alias("threshold")
    return top.select(stable_id(F.lit(rule.id), F.col("subject")).alias("id"), *fixed, "subject", "title", "path", "value", threshold, "omitted")


def apply(tables: dict[str, DataFrame], rules: tuple[FindingRule, ...]) -> DataFrame:
    """The findings of all rules whose table is given, one union; rules without their table are left out."""
    found = [emit(tables[r.table], r) for r in rules if r.table in tables]
    if not found:
        raise ValueError("no rule has its table")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
