"""Operators that compare and store: diffs of snapshots, prefix joins, series, lookups, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ancestors, depth, parent
from siltstone.functions.tables import in_order


def declarations(before: DataFrame, after: DataFrame, keys: list[str], value: str, limit: int | None = None) -> DataFrame:
    """(keys, before, after, change): full outer comparison; equal values, null ones too, are no change."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_a")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = a.join(b, keys, "full").withColumn("change", kind).filter("change is not null").select(*keys, "before", "after", "change")
    return out.orderBy(*keys).limit(limit) if limit else out


def unambiguous(files: DataFrame) -> DataFrame:
    """(path, hash): null where a path has several hashes or any is missing."""
    n = F.count_distinct("hash")
    return files.groupBy("path").agg(F.when((n == 1) & (F.count("hash") == F.count("*")), F.max("hash")).alias("hash"))


def file_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of added, removed and modified files; without both hashes nothing is modified."""
    a, b = unambiguous(baseline).select("path", F.col("hash").alias("x"), F.lit(1).alias("i")), unambiguous(current).select("path", F.col("hash").alias("y"), F.lit(1).alias("j"))
    kind = F.when(F.col("i").isNull(), "added").when(F.col("j").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return a.join(b, "path", "full").select("path", kind.alias("change")).filter("change is not null")


def longest_prefix(paths: DataFrame, folders: DataFrame, root: str | None = None) -> DataFrame:
    """(path, folder): the deepest of folders(folder) that holds each path at a folder's boundary; an equi-join on all ancestors."""
    each = paths.select("path", F.explode_outer(F.concat(ancestors(F.col("path")), F.array("path"))).alias("folder"))
    hit = each.join(folders.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", depth(F.col("folder"))).alias("folder"))
    out = paths.select("path").join(hit, "path", "left")
    return out if root is None else out.withColumn("folder", F.coalesce("folder", F.when(parent(F.col("path")) == "", root)))


def suffix_match(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(suffix, path, unique): the shortest path that ends with each suffix at a folder's boundary; an equi-join on the name."""
    name = lambda c: F.substring_index(c, "/", -1)
    hits = wanted.select("suffix", name("suffix").alias("n")).join(files.select("path", name("path").alias("n")), "n")
    hits = hits.filter((F.col("path") == F.col("suffix")) | F.endswith("path", F.concat(F.lit("/"), "suffix")))
    return hits.groupBy("suffix").agg(F.min(F.struct(F.length("path").alias("l"), "path")).alias("m"), (F.count("*") == 1).alias("unique")).select("suffix", "m.path", "unique")


def within(files: DataFrame, folder: str) -> DataFrame:
    """Files below a folder, as a range of paths that reaches the scan."""
    return files.filter((F.col("path") >= folder + "/") & (F.col("path") < folder + "0")) if folder else files


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, rank): for imports(id, candidates) the first candidate that is a file."""
    each = imports.select("id", F.posexplode("candidates").alias("rank", "path"))
    return each.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min(F.struct("rank", "path")).alias("m")).select("id", "m.path", "m.rank")


def locked(declared: DataFrame, locks: DataFrame, keys: list[str]) -> DataFrame:
    """declared with the version of the nearest lock file: one in the same folder or the closest above."""
    at = declared.withColumn("up", F.concat(F.array(F.lit("")), ancestors(F.col("manifest")))).select("*", F.explode("up").alias("folder")).drop("up")
    hit = at.join(locks.select(*keys, "folder", "version"), [*keys, "folder"])
    best = hit.groupBy(*keys, "manifest").agg(F.max(F.struct(depth(F.col("folder")).alias("d"), "version")).alias("m")).select(*keys, "manifest", "m.version")
    return declared.join(best, [*keys, "manifest"], "left")


def missing(declared: DataFrame, locks: DataFrame, keys: list[str]) -> DataFrame:
    return declared.join(locks, keys, "left_anti")


def duplicate_versions(locks: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keys that are locked at several versions."""
    return locks.groupBy(*keys).agg(F.count_distinct(version).alias("versions")).filter("versions > 1")


def strongest_scope(declared: DataFrame, keys: list[str], scope: str, order: tuple[str, ...]) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(scope))
    return declared.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, order)), F.min(rank).cast("int")).alias(scope))


def metric_series(metrics: DataFrame, scans: DataFrame, repository: str, metric: str) -> DataFrame:
    return metrics.filter(F.col("metric") == metric).join(scans.filter(F.col("repository") == repository), "scan").select("ts", "value").orderBy("ts")


def latest_scans(scans: DataFrame, limit: int) -> DataFrame:
    """The newest scans of each repository."""
    n = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("ts"), "scan"))
    return scans.withColumn("n", n).filter(F.col("n") <= limit)


def repositories(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """repos with how many scans each has."""
    return repos.join(scans.groupBy("repository").agg(F.count("*").alias("scans")), "repository", "left").withColumn("scans", F.coalesce("scans", F.lit(0)))


def by_prefix(scans: DataFrame, prefix: str) -> DataFrame:
    """The scan whose id starts so; none for under four characters or several."""
    if len(prefix) < 4:
        return scans.limit(0)
    hit = scans.filter(F.col("scan").startswith(prefix))
    return hit.withColumn("hits", F.count("*").over(Window.partitionBy())).filter("hits = 1").drop("hits")


def find_repository(repos: DataFrame, query: str) -> DataFrame:
    """By id, else by location, else by name in any case; the newest."""
    rank = F.when(F.col("repository") == query, 0).when(F.col("location") == query, 1).when(F.lower("name") == query.lower(), 2)
    return repos.withColumn("rank", rank).filter("rank is not null").orderBy("rank", F.desc("ts"), "repository").limit(1).drop("rank")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows in the place of those with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def evicted(cache: DataFrame, limit: int) -> DataFrame:
    """Keys to drop, the least recently used first, until at most `limit` bytes are left.

    Sums run within days, on top of the sums of the days before, so that no task holds the cache.
    """
    day = cache.withColumn("day", F.to_date("used"))
    days = day.groupBy("day").agg(F.sum("bytes").alias("of_day"))
    days = days.withColumn("before", F.sum("of_day").over(Window.orderBy("day")) - F.col("of_day")).crossJoin(cache.agg(F.sum("bytes").alias("total")))
    run = F.coalesce(F.sum("bytes").over(Window.partitionBy("day").orderBy("used", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return day.withColumn("run", run).join(days, "day").filter(F.col("before") + F.col("run") < F.col("total") - limit).select("key", "bytes")


def integrity(index: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is indexed but not there, and what is there but not indexed."""
    a = index.select(key).distinct().join(listing.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    return a.union(listing.select(key).distinct().join(index.select(key), key, "left_anti").withColumn("problem", F.lit("unindexed")))


def compared(rows: DataFrame, key: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """Values of several repositories side by side, with the smallest, the largest and their ratio."""
    wide = rows.groupBy(key).pivot(label, labels).agg(F.max(value))
    low, high = (f(*(F.col(f"`{c}`") for c in labels)) for f in (F.least, F.greatest))
    return wide.withColumns({"low": low, "high": high, "ratio": high / F.nullif(low, F.lit(0.0))})


def first_wins(sources: list[DataFrame], key: str, limit: int) -> DataFrame:
    """The union of sources, of each key that of the earliest source, at most so many."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source", F.lit(k))
        out = s if out is None else out.unionByName(s)
    n = F.row_number().over(Window.partitionBy(key).orderBy("source"))
    return out.withColumn("n", n).filter("n = 1").orderBy("source", key).limit(limit).drop("n")


def budgeted(blobs: DataFrame, most: int, total: int) -> DataFrame:
    """Blobs of at most so many bytes each, in order of path while their sum stays within a total; sums run by folder first."""
    kept = blobs.filter(F.col("bytes") <= most).withColumn("part", parent(F.col("path")))
    parts = kept.groupBy("part").agg(F.sum("bytes").alias("b"))
    parts = parts.withColumn("before", F.sum("b").over(Window.orderBy("part")) - F.col("b")).drop("b")
    run = F.sum("bytes").over(Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("run", run).join(parts, "part").filter(F.col("before") + F.col("run") <= total).select("path", "bytes")


def masked(df: DataFrame, preset: str, hidden: dict[str, tuple[str, ...]], people: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """A table for a privacy preset: hidden columns are empty, people are numbered by rank."""
    out = df.withColumns({c: F.lit("").cast(df.schema[c].dataType) for c in hidden.get(preset, ()) if c in df.columns})
    if preset == "public" and people:
        ranked = in_order(out, order or [F.col(people)], "__place")
        out = ranked.withColumn(people, F.concat(F.lit("Contributor "), F.col("__place").cast("string"))).drop("__place")
    return out


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row (entries, bytes); zeros for an empty cache."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page, from 0, of rows in an order; a number beyond the last page gives that page."""
    last = F.greatest(F.ceil(F.count("*") / size) - 1, F.lit(0))
    first = min(number, int(rows.agg(last.alias("last")).first()["last"])) * size
    return rows.orderBy(*order).offset(first).limit(size)
