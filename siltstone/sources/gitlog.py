"""A source for dumps of `git log --raw --numstat -z`, of refs, and for listings of trees."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalars import parent
from siltstone.functions.tables import in_order, part_count

#: What `git log` is asked to print before each commit: fields end with a unit separator, the head with a record separator.
FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%ad%x1f%s%x1e"
COMMIT = (
    "hash string, parents array<string>, author string, email string, ts timestamp, offset string, subject string, "
    "changes array<struct<path:string, old_path:string, status:string, added:long, deleted:long, binary:boolean>>"
)
_CHANGE = pa.struct([("path", pa.string()), ("old_path", pa.string()), ("status", pa.string()), ("added", pa.int64()), ("deleted", pa.int64()), ("binary", pa.bool_())])
_TYPES = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.list_(_CHANGE))
_NAMES = ["hash", "parents", "author", "email", "ts", "offset", "subject", "changes"]
_RAW = re.compile(r"^:\d{6} \d{6} [0-9a-f.]+ [0-9a-f.]+ ([A-Z])\d*$")
_NUM = re.compile(r"^(\d+|-)\t(\d+|-)\t(.*)$", re.S)
_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type-changed"}


def parse(head: str, body: str) -> tuple:
    """A commit of a dump with its changes: status from raw entries, lines from numstat entries."""
    f = (head.split("\x1f") + [""] * 7)[:7]
    tokens = [t.strip("\n") for t in body.split("\0")]
    found: dict[str, dict] = {}
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if m := _RAW.match(t):
            moved = m[1] in "RC"
            path = tokens[k + 2] if moved else tokens[k + 1]
            found[path] = {"path": path, "old_path": tokens[k + 1] if moved else None, "status": _STATUS.get(m[1], "modified"), "added": 0, "deleted": 0, "binary": False}
            k += 3 if moved else 2
        elif m := _NUM.match(t):
            path, step = (m[3], 1) if m[3] else (tokens[k + 2], 3)
            row = found.setdefault(path, {"path": path, "old_path": None, "status": "modified", "added": 0, "deleted": 0, "binary": False})
            row |= {"added": int(m[1]) if m[1] != "-" else 0, "deleted": int(m[2]) if m[2] != "-" else 0, "binary": m[1] == "-"}
            k += step
        else:
            k += 1
    return f[0], f[1].split(), f[2], f[3], datetime.datetime.fromtimestamp(int(f[4] or 0), datetime.UTC), f[5], f[6], list(found.values())


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(seq, hash, parents, ..., changes) of the dumps at a path, seq from 0 in their order.

    Spark's own reader cuts dumps at record separators, wherever they lie and however long they are, so
    that a large dump is read in parts; the order of the rows follows from the file, the part and the row,
    and what a commit changes is the row after its head.
    """
    rows = spark.read.option("lineSep", "\x1e").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"), "value")
    n = part_count(rows, 250_000)
    placed = in_order(rows, [F.col("file"), F.col("part"), F.col("row")], ranges=n).select("place", "value")
    is_head = F.col("value").contains("\x1f")
    bodies = placed.filter(~is_head).select((F.col("place") - 1).alias("of"), F.col("value").alias("body"))
    heads = in_order(placed.filter(is_head), [F.col("place")], "seq", ranges=n)
    both = heads.repartition(n, "place").join(bodies.repartition(n, "of"), F.col("place") == F.col("of"), "left").select((F.col("seq") - 1).alias("seq"), "value", F.coalesce("body", F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(parse(h.as_py(), b.as_py()) for h, b in zip(batch.column(1), batch.column(2), strict=True)), strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["seq", *_NAMES])

    return both.mapInArrow(run, "seq long, " + COMMIT)


def history(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of dumps; with a limit the newest commits, `truncated` tells whether there were more."""
    all_ = read_commits(spark, path)
    if most is not None:
        more = all_.agg((F.count("*") > most).alias("truncated"))
        all_ = all_.filter(F.col("seq") < most).crossJoin(F.broadcast(more))
    changes = all_.select("seq", F.col("hash").alias("commit"), F.col("email").alias("author"), "ts", F.explode("changes").alias("c")).select("seq", "commit", "author", "ts", "c.*")
    return all_, changes


#: What `git for-each-ref` is asked to print: a line for each ref.
REFS = "%(refname)%1f%(objecttype)%1f%(objectname)%1f%(*objectname)%1f%(creatordate:unix)%1f%(symref)"


def refs(lines: DataFrame) -> DataFrame:
    """(kind, name, remote, commit, annotated, ts) of branches and tags from lines(line); heads that only name another ref are left out.

    A tag with a message stands for the commit that it points to.
    """
    f = F.split("line", "\x1f")
    name = f[0]
    kind = F.when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/remotes/"), "remote-branch").when(name.startswith("refs/tags/"), "tag")
    rest = F.regexp_replace(name, "^refs/(heads|tags|remotes/[^/]+)/", "")
    remote = F.nullif(F.regexp_extract(name, "^refs/remotes/([^/]+)/", 1), F.lit(""))
    commit = F.when((f[1] == "tag") & (f[3] != ""), f[3]).otherwise(f[2])
    ts = F.timestamp_seconds(F.coalesce(F.trim(f[4]).try_cast("long"), F.lit(0)))
    fine = (F.size(f) >= 5) & kind.isNotNull() & (F.coalesce(F.get(f, F.lit(5)), F.lit("")) == "")
    return lines.filter(fine).select(kind.alias("kind"), rest.alias("name"), remote.alias("remote"), commit.alias("commit"), (f[1] == "tag").alias("annotated"), ts.alias("ts"))


def state(branches: DataFrame, head: str | None, current: str | None, origin_head: str | None, shallow: bool, dirty: bool) -> DataFrame:
    """One row (head, current, default_branch, branches, shallow, dirty) of a repository, from refs() and what git says of its head."""
    names = F.array_sort(F.collect_set(F.when(F.col("kind").isin("branch", "remote-branch"), F.col("name"))))
    usual = [F.when(F.array_contains("names", n), n) for n in USUAL]
    default = F.coalesce(F.lit(origin_head.rpartition("/")[2] if origin_head else None), *usual, F.when(F.size("names") == 1, F.get("names", F.lit(0))), F.lit(current))
    one = branches.agg(names.alias("names"))
    return one.select(F.lit(head).alias("head"), F.lit(current).alias("current"), default.alias("default_branch"), F.size("names").alias("branches"), F.lit(shallow).alias("shallow"), F.lit(dirty).alias("dirty"))


#: Usual names of a default branch, the likeliest first.
USUAL = ("main", "master", "trunk", "develop")


def tree_entries(lines: DataFrame) -> DataFrame:
    """(revision, mode, type, object, bytes, path) from lines(revision, line) of `git ls-tree -r -l`."""
    p = r"^(\d{6}) (\w+) ([0-9a-f]+)\s+(\d+|-)\t(.*)$"
    g = lambda k: F.regexp_extract("line", p, k)
    return lines.filter(F.col("line").rlike(p)).select("revision", g(1).alias("mode"), g(2).alias("type"), g(3).alias("object"), g(4).try_cast("long").alias("bytes"), g(5).alias("path"))


def permission_signals(entries: DataFrame) -> DataFrame:
    """(path, signal) of files(path, mode as a number) that everyone may write or that change their user or group."""
    bit = lambda m: F.col("mode").bitwiseAND(F.lit(m)) != 0
    hits = F.array_compact(F.array(F.when(bit(0o002), "world-writable"), F.when(bit(0o4000), "setuid"), F.when(bit(0o2000), "setgid")))
    return entries.select("path", F.explode(hits).alias("signal"))


def default_branch(origin_head: str | None, current: str | None, branches: list[str]) -> str | None:
    """The remote's head, else main or master, else the only branch, else the current one."""
    if origin_head:
        return origin_head.rpartition("/")[2]
    for name in USUAL:
        if name in branches:
            return name
    return branches[0] if len(branches) == 1 else current


def go_targets(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """(id, specifier, kind, target) of imports(id, specifier) of Go code: files of a package of the repository, an external package, or none.

    modules(module, root) are the repository's own, matched at a boundary of the path, the longest first; a
    package's files are those right in its folder, without tests. Packages without a host are the
    language's own and ignored; others are named by their host and, for the usual hosts, two more parts.
    """
    parts = F.split("specifier", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = imports.select("id", "specifier", F.explode(up).alias("module")).join(modules, "module").groupBy("id", "specifier").agg(F.max_by(F.struct("module", "root"), F.length("module")).alias("m"))
    rest = F.expr("substring(specifier, length(m.module) + 2)")
    folder = F.concat_ws("/", F.nullif(F.col("m.root"), F.lit("")), F.nullif(rest, F.lit("")))
    source = files.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(parent(F.col("path")).alias("folder"), "path")
    own = hit.select("id", "specifier", folder.alias("folder")).join(source, "folder", "left").select("id", "specifier", F.when(F.col("path").isNull(), "unresolved").otherwise("internal").alias("kind"), F.col("path").alias("target"))
    host = parts[0]
    length = F.when(host.isin("github.com", "gitlab.com", "bitbucket.org", "golang.org"), 3).otherwise(2)
    others = imports.join(hit.select("id", "specifier"), ["id", "specifier"], "left_anti")
    outside = others.select("id", "specifier", F.when(host.contains("."), "external").otherwise("ignored").alias("kind"), F.when(host.contains("."), F.array_join(F.slice(parts, F.lit(1), length), "/")).alias("target"))
    return own.unionByName(outside)
