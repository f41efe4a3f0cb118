"""Dependency manifests, lock files and settings as tables of declarations."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources import yaml

Row = tuple[str, str | None, str]  # name, requirement, scope


def _toml(text: str) -> dict:
    return tomllib.loads(text)


def cargo(text: str) -> Iterator[Row]:
    doc = _toml(text)
    for table, scope in (("dependencies", "runtime"), ("dev-dependencies", "development"), ("build-dependencies", "build")):
        for name, spec in doc.get(table, {}).items():
            yield (spec.get("package", name), spec.get("version"), "optional" if spec.get("optional") else scope) if isinstance(spec, dict) else (name, spec, scope)


def cargo_lock(text: str) -> Iterator[Row]:
    for p in _toml(text).get("package", []):
        yield p["name"], p.get("version"), "locked"


def package_json(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for key, scope in (("dependencies", "runtime"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, spec in (doc.get(key) or {}).items():
            yield name, str(spec), scope


def package_lock(text: str) -> Iterator[Row]:
    for path, p in (json.loads(text).get("packages") or {}).items():
        if "node_modules/" in path:
            yield path.rpartition("node_modules/")[2], p.get("version"), "locked"


_PEP508 = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;#@)]*)\)?")


def _pep508(line: str, scope: str) -> Iterator[Row]:
    if (m := _PEP508.match(line)) and not line.lstrip().startswith(("#", "-")):
        yield re.sub(r"[-_.]+", "-", m[1]).lower(), m[2].strip() or None, scope


def pyproject(text: str) -> Iterator[Row]:
    doc = _toml(text)
    project = doc.get("project", {})
    for line in project.get("dependencies", []):
        yield from _pep508(line, "runtime")
    for lines in project.get("optional-dependencies", {}).values():
        for line in lines:
            yield from _pep508(line, "optional")
    poetry = doc.get("tool", {}).get("poetry", {})
    for name, spec in poetry.get("dependencies", {}).items():
        if name != "python":
            yield name.lower(), spec.get("version") if isinstance(spec, dict) else spec, "runtime"
    for group in poetry.get("group", {}).values():
        for name, spec in group.get("dependencies", {}).items():
            yield name.lower(), spec.get("version") if isinstance(spec, dict) else spec, "development"


def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        yield from _pep508(line, "runtime")


def go_mod(text: str) -> Iterator[Row]:
    block = ""
    for line in text.splitlines():
        plain = line.split("//")[0].strip()
        if plain.endswith("("):
            block = plain[:-1].strip()
        elif plain == ")":
            block = ""
        else:
            words = plain.split() if block else plain.split()[1:]
            if (block or plain.split()[:1] == ["require"]) and (block or "require") == "require" and len(words) >= 2:
                yield words[0], words[1], "indirect" if "// indirect" in line else "runtime"


def pom(text: str) -> Iterator[Row]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    values = {e.tag: e.text or "" for e in root.findall("properties/*")}
    for d in root.findall("dependencies/dependency"):
        get = lambda k, d=d: re.sub(r"\$\{([^}]*)\}", lambda m: values.get(m[1], m[0]), d.findtext(k) or "")
        yield f"{get('groupId')}:{get('artifactId')}", get("version") or None, {"test": "development", "provided": "build"}.get(get("scope"), "runtime")


def gradle(text: str) -> Iterator[Row]:
    for scope, spec in re.findall(r"^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|compile))\s*\(?\s*[\"']([^\"']+)[\"']", text, re.M):
        parts = spec.split(":")
        if len(parts) >= 2:
            yield ":".join(parts[:2]), parts[2] if len(parts) > 2 else None, "development" if scope.startswith("test") else "runtime"


def csproj(text: str) -> Iterator[Row]:
    for e in ET.fromstring(text).iter():
        if e.tag.endswith("PackageReference") and e.get("Include"):
            yield e.get("Include"), e.get("Version") or e.findtext("Version"), "runtime"


def gemfile(text: str) -> Iterator[Row]:
    scope = "runtime"
    for line in text.splitlines():
        if re.match(r"\s*group\s.*(development|test)", line):
            scope = "development"
        elif line.strip() == "end":
            scope = "runtime"
        elif m := re.match(r"\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", line):
            yield m[1], m[2], scope


def composer(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for key, scope in (("require", "runtime"), ("require-dev", "development")):
        for name, spec in (doc.get(key) or {}).items():
            if "/" in name:
                yield name, spec, scope


def pubspec(text: str) -> Iterator[Row]:
    doc = yaml.load(text)
    if not isinstance(doc, dict):
        raise ValueError("pubspec.yaml is not a mapping")
    for key, scope in (("dependencies", "runtime"), ("dev_dependencies", "development")):
        for name, spec in (doc.get(key) or {}).items():
            yield name, spec if isinstance(spec, str) else (spec or {}).get("version"), scope


def pubspec_lock(text: str) -> Iterator[Row]:
    for name, entry in ((yaml.load(text) or {}).get("packages") or {}).items():
        if (entry or {}).get("version"):
            yield name, entry["version"], "locked"


def pnpm_lock(text: str) -> Iterator[Row]:
    """Keys such as /name@1.0.0(peer@2), name@1.0.0 and, of old files, /name/1.0.0."""
    for key in (yaml.load(text) or {}).get("packages") or {}:
        key = key.lstrip("/").partition("(")[0]
        name, sign, version = key.rpartition("@")
        if not name:
            name, sign, version = key.rpartition("/")
        if name and version:
            yield name, version, "locked"


def yarn_lock(text: str) -> Iterator[Row]:
    """Entries of either form: a line of specifiers that ends with a colon, then a version."""
    name = None
    for line in text.split("\n"):
        if line.rstrip().endswith(":") and not line.startswith((" ", "#")):
            name = line.rstrip()[:-1].split(", ")[0].strip('"').rpartition("@")[0] or None
        elif name and (m := re.match(r"\s+version:?\s+\"?([^\"\s]+)", line)):
            if name != "__metadata":
                yield re.sub(r"@(npm|workspace|patch)$", "", name), m[1], "locked"
            name = None


def swift(text: str) -> Iterator[Row]:
    for url, version in re.findall(r"\.package\([^)]*url:\s*\"([^\"]+)\"[^)]*?\"([\d.]+)\"", text):
        yield re.sub(r"\.git$", "", url).rpartition("/")[2], version, "runtime"


#: ecosystem, pattern of the file's name, parser, lock file
PROVIDERS: tuple[tuple[str, str, Callable[[str], Iterator[Row]], bool], ...] = (
    ("cargo", r"^Cargo\.toml$", cargo, False), ("cargo", r"^Cargo\.lock$", cargo_lock, True),
    ("npm", r"^package\.json$", package_json, False), ("npm", r"^(package-lock|npm-shrinkwrap)\.json$", package_lock, True),
    ("pypi", r"^pyproject\.toml$", pyproject, False), ("pypi", r"^requirements.*\.txt$", requirements, False),
    ("go", r"^go\.mod$", go_mod, False), ("maven", r"^pom\.xml$", pom, False), ("gradle", r"^build\.gradle(\.kts)?$", gradle, False),
    ("nuget", r"\.(cs|fs|vb)proj$", csproj, False), ("rubygems", r"^Gemfile$", gemfile, False), ("composer", r"^composer\.json$", composer, False),
    ("pub", r"^pubspec\.yaml$", pubspec, False), ("pub", r"^pubspec\.lock$", pubspec_lock, True), ("npm", r"^pnpm-lock\.yaml$", pnpm_lock, True), ("npm", r"^yarn\.lock$", yarn_lock, True), ("swiftpm", r"^Package\.swift$", swift, False),
)


def declarations(files: DataFrame) -> DataFrame:
    """(manifest, ecosystem, name, requirement, scope, problem) of files(path, text): one row a dependency, or the problem of a file that cannot be read."""
    names = [re.compile(p) for _, p, _, _ in PROVIDERS]
    schema = "manifest string, ecosystem string, name string, requirement string, scope string, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(10_000)
        def readers(file: str) -> list[tuple[str, Callable[[str], Iterator[Row]]]]:
            return [(ecosystem, parser) for (ecosystem, _, parser, _), name in zip(PROVIDERS, names, strict=True) if name.search(file)]

        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for ecosystem, parser in readers((path or "").rpartition("/")[2]):
                    try:
                        rows += [(path, ecosystem, n, r, s, None) for n, r, s in parser(text.as_py() or "")]
                    except (ValueError, KeyError, AttributeError, TypeError, ET.ParseError) as e:
                        rows.append((path, ecosystem, None, None, None, str(e)[:200]))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [x.split()[0] for x in schema.split(", ")])

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


WORKFLOW = r"(?i)(^|/)\.github/workflows/[^/]*\.ya?ml$"


def workflow_steps(files: DataFrame) -> DataFrame:
    """(path, workflow, job, runs_on, needs, step, name, uses, run, problem) of workflow files(path, text): a row a step, jobs that call another workflow one of their own.

    step counts from 1 within its job. A file that cannot be read is a row with its problem alone.
    """
    schema = "path string, workflow string, job string, runs_on string, needs array<string>, step int, name string, uses string, run string, problem string"
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.int32()] + [pa.string()] * 4
    several = lambda x: [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]

    def steps(path: str, text: str) -> Iterator[tuple]:
        doc = yaml.load(text)
        if not isinstance(doc, dict):
            raise ValueError("no mapping")
        for name, job in (doc.get("jobs") or {}).items():
            head = (path, doc.get("name"), name, ",".join(several(job.get("runs-on"))) or None, several(job.get("needs")))
            if job.get("uses"):
                yield *head, 1, None, job["uses"], None, None
            for k, step in enumerate(job.get("steps") or [], 1):
                yield *head, k, step.get("name"), step.get("uses"), step.get("run"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += list(steps(path, text or ""))
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((path, *[None] * 8, str(e)[:200]))
            columns = zip(*rows, strict=True) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return files.filter(F.col("path").rlike(WORKFLOW)).select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)
