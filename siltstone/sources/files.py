"""Scans of files, archives, artifacts and settings."""

from __future__ import annotations

import io
import json
import tarfile
import tomllib
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import glob_regex

#: Folders of version control, never walked.
VCS_FOLDERS = (".git", ".hg", ".svn", ".jj", ".bzr", "_darcs", ".fossil")


def discover(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(path, bytes, modified, content) of the files below a folder, without version control and ignored ones.

    Ignore patterns work in order: a later one with `!` takes a file back. With a limit, the first files
    by path; else all, in no order.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    files = raw.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^/*" + "/".join(map(_quoted, base.strip("/").split("/"))) + "/", "").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    out = F.lit(False)
    for p in ignore:
        hit = F.col("path").rlike(glob_regex(p.removeprefix("!")))
        out = F.when(hit, F.lit(not p.startswith("!"))).otherwise(out)
    files = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, VCS_FOLDERS))) & ~out)
    return files if most is None else files.orderBy("path").limit(most)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def content(data: Column, most: int) -> Column:
    """(outcome, text, sha256, binary): too large, binary, or decoded text without a byte order mark."""
    plain = F.when(F.substring(F.hex(data), 1, 6) == "EFBBBF", F.substring(data, 4, 1 << 30)).otherwise(data)
    zero = F.hex(F.substring(plain, 1, 8000)).rlike("^(..)*00")
    big = F.octet_length(data) > most
    return F.struct(
        F.when(data.isNull(), "unreadable").when(big, "too-large").when(zero, "binary").otherwise("content").alias("outcome"),
        F.when(~big & ~zero, F.make_valid_utf8(plain.cast("string"))).alias("text"),
        F.sha2(data, 256).alias("sha256"), zero.alias("binary"),
    )


def archives(files: DataFrame, most_files: int = 100_000, most_bytes: int = 1 << 30) -> DataFrame:
    """(archive, path, bytes, content) of each file in zip, tar and tar.gz archives(path, content); paths that lead outside are left out.

    A single top folder is taken off. An archive is looked through for names and sizes first, then read
    member by member, so that a task holds one archive and a few members at a time; members beyond the
    limits of an archive are left out.
    """

    def opened(data: bytes) -> tuple[list[tuple[str, int]], Callable[[int], bytes]]:
        """Names and sizes of an archive's files, and what reads one by its place."""
        if zipfile.is_zipfile(io.BytesIO(data)):
            z = zipfile.ZipFile(io.BytesIO(data))
            found = [m for m in z.infolist() if not m.is_dir()]
            return [(m.filename, m.file_size) for m in found], lambda k: z.read(found[k])
        t = tarfile.open(fileobj=io.BytesIO(data))
        members = [m for m in t.getmembers() if m.isfile()]
        return [(m.name, m.size) for m in members], lambda k: t.extractfile(members[k]).read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                listed, read = opened(data.as_py())
                taken, total = [], 0
                for k, (path, size) in enumerate(listed):
                    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
                    total += size
                    if ".." not in parts and not path.startswith("/") and len(taken) < most_files and total <= most_bytes:
                        taken.append((k, parts))
                skip = int(len({p[0] for _, p in taken}) == 1 and all(len(p) > 1 for _, p in taken))
                rows: list[tuple[str, bytes]] = []
                held = 0
                for k, parts in taken:
                    rows.append(("/".join(parts[skip:]), read(k)))
                    held += len(rows[-1][1])
                    if held >= 16 << 20:
                        yield shown(name, rows)
                        rows, held = [], 0
                if rows:
                    yield shown(name, rows)

    def shown(name: str, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        paths, bodies = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(paths, pa.string()), pa.array(map(len, bodies), pa.int64()), pa.array(bodies, pa.binary())], ["archive", "path", "bytes", "content"])

    return files.select("path", "content").mapInArrow(run, "archive string, path string, bytes long, content binary")


MAJOR = 1


def artifacts(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Stored JSON artifacts of this major version; newer minor ones are read, unknown fields ignored, others left out.

    A file is one document, or with lines one a line, as sinks.write_artifact writes them.
    """
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", str(not lines).lower()).json(path)
    return raw.filter(F.split_part("schema_version", F.lit("."), F.lit(1)).try_cast("int") == MAJOR)


def settings(*layers: dict | str) -> dict:
    """Settings of several layers, later ones win, tables merge; text is TOML."""
    out: dict = {}

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    for layer in layers:
        out = merge(out, tomllib.loads(layer) if isinstance(layer, str) else layer)
    return out


def languages(spark: SparkSession, definitions: list[str]) -> DataFrame:
    """(language, kind, rule, value) from TOML definitions with id, kind, names, prefixes and extensions."""
    rows = []
    for d in map(tomllib.loads, definitions):
        for rule, key in (("name", "names"), ("prefix", "prefixes"), ("extension", "extensions")):
            rows += [(d["id"], d.get("kind", "programming"), rule, v) for v in d.get(key, [])]
    return spark.createDataFrame(rows, "language string, kind string, rule string, value string")


def extensions(directory_texts: dict[str, str]) -> tuple[list[dict], list[str]]:
    """Valid extension manifests (name, version, command) and what is wrong with the others."""
    good, bad = [], []
    for name, text in sorted(directory_texts.items()):
        try:
            m = json.loads(text)
            assert isinstance(m.get("name"), str) and isinstance(m.get("command"), list) and m.get("protocol", 1) == 1
            good.append(m)
        except (ValueError, AssertionError, AttributeError) as e:
            bad.append(f"{name}: {e or 'not a manifest'}")
    return good, bad
