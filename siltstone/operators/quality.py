"""Operators of code quality: percentile ranks, hotspots, summaries, interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ratio, round4
from siltstone.functions.tables import dealt, stored

#: What a hotspot's score is made of.
WEIGHTS = {"commits": 0.30, "churn": 0.20, "recent_commits": 0.15, "complexity": 0.15, "lines": 0.10, "authors": 0.05, "dependents": 0.05}
REASON = 0.75


def mid_ranks(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, p_<column>): share of values below, equal ones counting half; values of 0 and below, and nulls, rank 0.

    Ranks come from the counts by value, so that the ordered step sees one row a different value. Zeros,
    often a third of all, have a known rank and take no part in the join.
    """
    total = df.agg(F.count("*").alias("total"))
    pairs = F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))
    long = df.select(key, F.explode(F.filter(pairs, lambda x: x["v"] > 0)).alias("x")).select(key, "x.*")
    n = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    positive = F.sum("n").over(Window.partitionBy("c"))
    p = n.withColumns({"upto": upto, "positive": positive}).crossJoin(F.broadcast(total))
    p = p.select("c", "v", ((F.col("total") - F.col("positive") + F.col("upto") - 0.5 * F.col("n")) / F.col("total")).cast("double").alias("p"))
    found = long.join(p, ["c", "v"]).groupBy(key).agg(*(F.max(F.when(F.col("c") == k, F.col("p"))).alias(f"p_{c}") for k, c in enumerate(columns)))
    return df.select(key).join(found, key, "left").na.fill(0.0, [f"p_{c}" for c in columns])


def hotspots(files: DataFrame, least_commits: int = 2, limit: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """(path, rank, score, reasons, ...) of files(path, commits, churn, recent_commits, complexity, lines, authors, dependents)."""
    weights = weights or WEIGHTS
    candidates = stored(files.filter((F.col("commits") >= least_commits) & (F.col("lines") > 0)), "candidates")
    ranked = candidates.join(mid_ranks(candidates, list(weights), "path"), "path")
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + w * F.col(f"p_{c}")
    reasons = F.array_compact(F.array(*(F.when(F.col(f"p_{c}") >= REASON, c) for c in weights)))
    top = ranked.withColumn("score", round4(score)).withColumn("reasons", F.array_join(reasons, ";")).orderBy(F.desc("score"), F.desc("commits"), "path").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("commits"), "path"))).select("path", "rank", "score", *weights, "reasons")


#: Buckets of a complexity histogram (label, least, most).
BUCKETS = (("1–5", 1, 5), ("6–10", 6, 10), ("11–20", 11, 20), ("21–50", 21, 50), ("51+", 51, None))


def complexity_summary(functions: DataFrame) -> DataFrame:
    """One row: count, mean, exact median, largest and a histogram of functions(cyclomatic)."""
    v = F.col("cyclomatic")
    inside = lambda a, b: F.count_if((v >= a) & (F.lit(True) if b is None else v <= b))
    return functions.agg(
        F.count("*").alias("functions"), round4(F.avg(v)).alias("average"), F.median(v).alias("median"), F.max(v).alias("largest"),
        *(inside(a, b).alias(f"bucket_{a}") for _, a, b in BUCKETS),
    )


def complexity_by(functions: DataFrame, by: str) -> DataFrame:
    return functions.groupBy(by).agg(F.count("*").alias("functions"), round4(F.avg("cyclomatic")).alias("average"), F.max("cyclomatic").alias("largest"))


def top_over(df: DataFrame, measure: str, least: float, tie: list[str], limit: int = 50) -> DataFrame:
    """Rows with a measure of at least so much, the largest first."""
    return df.filter(F.col(measure) >= least).orderBy(F.desc(measure), *tie).limit(limit)


def covered_lines(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Lines that inclusive ranges (start, end) cover in each group; overlapping and touching ones are merged. A task puts some groups of bounded size in order."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt(ranges, *by).withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*by, "island").agg((F.max("end") - F.min("start") + 1).alias("lines"))
    return merged.groupBy(*by).agg(F.sum("lines").alias("covered"), F.count("*").alias("blocks"))


def signals(one: DataFrame, definitions: dict[str, Column]) -> DataFrame:
    """(id, value) from one row of totals; what has nothing to divide by is left out, not 0."""
    pairs = F.array(*(F.struct(F.lit(k).alias("id"), round4(c).alias("value")) for k, c in definitions.items()))
    return one.select(F.explode(pairs).alias("s")).select("s.id", "s.value").filter("value is not null")


def maintainability(files: DataFrame, functions: DataFrame, large: int = 1000, complex_: int = 15) -> DataFrame:
    """Signals of files(test, code, comment, markers, duplicated) and functions(lines, cyclomatic)."""
    own = ~F.col("test")
    a = files.agg(
        F.sum(F.when(own, F.col("code"))).alias("code"), F.sum(F.when(own, F.col("comment"))).alias("comment"), F.sum(F.when(F.col("test"), F.col("code"))).alias("tests"),
        F.count_if(own & (F.col("code") > 0)).alias("measured"), F.count_if(own & (F.col("code") >= large)).alias("large"), F.sum("markers").alias("markers"), F.sum(F.when(own, F.col("duplicated"))).alias("duplicated"),
    )
    b = functions.agg(F.count("*").alias("functions"), F.sum("lines").alias("function_lines"), F.count_if(F.col("cyclomatic") >= complex_).alias("complex"))
    c = {k: F.coalesce(k, F.lit(0)) for k in ("code", "comment", "tests", "markers", "duplicated")}
    return signals(
        a.crossJoin(b),
        {
            "comment-ratio": ratio(c["comment"], c["code"] + c["comment"]),
            "average-function-length": ratio(F.col("function_lines"), F.col("functions")),
            "complex-function-share": ratio(F.col("complex"), F.col("functions")),
            "large-file-share": ratio(F.col("large"), F.col("measured")),
            "duplication-ratio": ratio(c["duplicated"], c["code"]),
            "marker-density": ratio(c["markers"] * 1000, c["code"] + c["tests"]),
            "test-code-ratio": ratio(c["tests"], c["code"]),
        },
    )


def unused(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no edge(src, dst) leads to and whose name is no convention for an entry point."""
    usual = F.col("path").rlike(r"(^|/)(main|index|mod|lib|__init__|__main__|setup|conftest|build|app|server|cli|manage|wsgi|asgi)\.[^/]+$")
    return files.filter(~usual).join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")


def function_signals(files: DataFrame) -> DataFrame:
    """One row for each function of files(path, language, test, functions) outside tests, with 1 and 0 for what was not measured."""
    own = files.filter(~F.col("test") & F.col("language").isNotNull()).select("path", "language", F.explode("functions").alias("f"))
    return own.select(
        "path", "f.name", "f.line", "f.end_line", (F.col("f.end_line") - F.col("f.line") + 1).alias("lines"),
        F.coalesce("f.complexity", F.lit(1)).alias("cyclomatic"), F.coalesce("f.nesting", F.lit(0)).alias("nesting"), "language",
    )


# What makes a file important, and how much of it.
IMPORTANCE = {"entrypoint": 0.35, "readme": 0.3, "manifest": 0.15, "dependents": 0.3, "hotspot": 0.25}


def important_files(entrypoints: DataFrame, readmes: DataFrame, manifests: DataFrame, edges: DataFrame, hotspots: DataFrame, lockfiles: DataFrame, most: int = 12) -> DataFrame:
    """(path, score, reasons): files by the sum of what speaks for them, at most 1; lock files are left out.

    entrypoints, readmes, manifests (at the root), lockfiles: (path); edges(src, dst); hotspots(path, rank).
    """
    fixed = lambda df, why: df.select("path", F.lit(IMPORTANCE[why]).alias("score"), F.lit(why).alias("reason"))
    n = edges.select("src", F.col("dst").alias("path")).distinct().groupBy("path").agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    used = n.filter("n >= 2").crossJoin(F.broadcast(top)).select("path", (IMPORTANCE["dependents"] * F.col("n") / F.col("top")).alias("score"), F.lit("dependents").alias("reason"))
    hot = hotspots.filter("rank <= 20").select("path", (IMPORTANCE["hotspot"] * (1 - (F.col("rank") - 1) / 20)).alias("score"), F.lit("hotspot").alias("reason"))
    found = fixed(entrypoints, "entrypoint").union(fixed(readmes, "readme")).union(fixed(manifests, "manifest")).union(used).union(hot)
    scored = found.groupBy("path").agg(round4(F.least(F.lit(1.0), F.sum("score"))).alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))
    return scored.join(lockfiles.select("path"), "path", "left_anti").orderBy(F.desc("score"), "path").limit(most)
