"""Modules of a code base from its packages and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import ancestors, depth, parent
from siltstone.functions.tables import stored

ROOT = "(root)"
# Folders that group modules, folders that hold sources, and bounds of the descent.
GROUPING = ("apps", "cmd", "crates", "internal", "libs", "modules", "packages", "pkg", "plugins", "services")
SOURCES = ("app", "lib", "source", "sources", "Sources", "src")
DEEPEST = 3
DOMINANT = 10
PASSES = 2


def below(base: Column, *parts: Column) -> Column:
    """A folder under another one, which may be the root."""
    return F.concat_ws("/", F.nullif(base, F.lit("")), *parts)


def common(a: Column, b: Column) -> Column:
    """The folders that two lists of folders begin with."""
    size = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.transform(F.sequence(F.lit(0), size), lambda k: (k == size) | (F.get(a, k) != F.get(b, k))), F.lit(True)) - 1
    return F.slice(a, F.lit(1), apart.cast("int"))


def partition(files: DataFrame) -> DataFrame:
    """(path, whole, module) of files(path, whole): the folder of each file within the folder `whole`, which holds it.

    A group's base is the deepest folder that has all its files: the common beginning of its first and its
    last folder in order, so that one aggregate finds it. Files in the base are a module; folders for
    sources are groups of their own, to DEEPEST levels; what a grouping folder holds is a module each; any
    other folder is one. All groups of a level are dealt with at once.
    """
    folders = F.when(parent(F.col("path")) == "", F.array().cast("array<string>")).otherwise(F.split(parent(F.col("path")), "/"))
    left = files.select("path", "whole", F.col("whole").alias("group"), folders.alias("folders"))
    done = None
    for level in range(DEEPEST + 1):
        base = left.groupBy("whole", "group").agg(F.min("folders").alias("a"), F.max("folders").alias("b")).select("whole", "group", common(F.col("a"), F.col("b")).alias("base"))
        at = left.join(base, ["whole", "group"])
        n, name = F.size("base"), F.array_join("base", "/")
        child, next_ = F.get("folders", n), F.get("folders", n + 1)
        under = below(name, child)
        sources = child.isin(*SOURCES) | ((F.element_at(F.concat(F.array(F.lit("")), "base"), -1) == "src") & child.isin("main", "test"))
        module = F.when(F.size("folders") == n, name).when(sources & F.lit(level < DEEPEST), F.lit(None)).when(child.isin(*GROUPING) & next_.isNotNull(), below(under, next_)).otherwise(under)
        step = stored(at.select("path", "whole", "folders", under.alias("group"), module.alias("module")), "modules")
        found = step.filter("module is not null").select("path", "whole", "module")
        done = found if done is None else done.union(found)
        left = step.filter("module is null").drop("module")
    return done


def infer(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, module, kind) of files(path): the deepest of packages(folder) that holds a file, or else its folder's module.

    A package at the root holds everything and is no boundary. A module of DOMINANT files or more that has
    half of all is split into its folders, if there are several, PASSES times at most; files right in
    a package's folder stay that package's. kind: package, directory or root.
    """
    each = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    hit = each.join(packages.filter("folder != ''").select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", depth(F.col("folder"))).alias("package"))
    owned = stored(files.select("path").distinct().join(hit, "path", "left"), "owned")
    loose = partition(owned.filter("package is null").select("path", F.lit("").alias("whole"))).select("path", "module", F.lit(False).alias("package"))
    now = stored(owned.filter("package is not null").select("path", F.col("package").alias("module"), F.lit(True).alias("package")).union(loose), "modules")
    for _ in range(PASSES):
        sizes = now.groupBy("module").agg(F.count("*").alias("n"))
        large = sizes.crossJoin(F.broadcast(now.agg(F.count("*").alias("total")))).filter((F.col("n") >= DOMINANT) & (2 * F.col("n") >= F.col("total"))).select("module")
        inside = now.join(large, "module", "left_semi")
        if inside.isEmpty():
            break
        parts = stored(partition(inside.select("path", F.col("module").alias("whole"))), "parts")
        several = parts.groupBy("whole").agg(F.count_distinct("module").alias("n")).filter("n >= 2").select("whole")
        parts = parts.join(several, "whole").select("path", "whole", F.col("module").alias("part"))
        split = now.join(parts, "path", "left")
        kept = F.col("package") & (F.col("part").isNull() | (F.col("part") == F.col("whole")))
        now = stored(split.select("path", F.coalesce("part", "module").alias("module"), kept.alias("package")), "modules")
    kind = F.when(F.col("module") == "", "root").otherwise("directory")
    packaged = now.groupBy("module").agg(F.bool_or("package").alias("of"))
    return now.join(packaged, "module").select("path", F.when(F.col("module") == "", ROOT).otherwise(F.col("module")).alias("module"), F.when(F.col("of"), "package").otherwise(kind).alias("kind"))
