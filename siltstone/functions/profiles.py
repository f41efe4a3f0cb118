"""What an analysis does: stages by profile, and which findings its settings keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages of each profile.
_STANDARD = ("discovery", "parsing", "git", "dependencies", "architecture", "quality", "project", "security", "evolution", "plugins", "insights")
STAGES = {
    "quick": ("discovery", "parsing", "project", "insights"),
    "standard": _STANDARD,
    "deep": (*_STANDARD, "duplication", "similarity", "historical-architecture"),
    "history-only": ("discovery", "git", "evolution"),
    "architecture-only": ("discovery", "parsing", "dependencies", "architecture"),
    "dependencies-only": ("discovery", "dependencies"),
    "security-only": ("discovery", "security"),
}


def stages(profile: str, without: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The stages of a profile, less those that settings switch off."""
    return tuple(s for s in STAGES[profile] if s not in without)


def project_kept(findings: DataFrame, tests: bool = True, build: bool = True, documentation: bool = True) -> DataFrame:
    """findings without the categories that settings leave out."""
    hidden = [c for c, kept in (("tests", tests), ("build", build), ("documentation", documentation)) if not kept]
    return findings.filter(~F.col("category").isin(*hidden)) if hidden else findings
