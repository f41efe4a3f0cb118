"""What a project needs to run and which commands it offers, from files(project, path, text) of any number of projects."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources import yaml

# Images of services, and names of tools in version files.
SERVICES = {
    "postgres": "PostgreSQL", "postgis": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB", "redis": "Redis", "valkey": "Valkey", "mongo": "MongoDB", "rabbitmq": "RabbitMQ",
    "elasticsearch": "Elasticsearch", "opensearch": "OpenSearch", "memcached": "Memcached", "cp-kafka": "Kafka", "kafka": "Kafka", "minio": "MinIO", "nats": "NATS",
    "localstack": "LocalStack", "clickhouse-server": "ClickHouse", "cassandra": "Cassandra",
}
TOOLS = {
    "nodejs": ("runtime", "Node.js"), "node": ("runtime", "Node.js"), "python": ("runtime", "Python"), "ruby": ("runtime", "Ruby"), "java": ("runtime", "Java"), "elixir": ("runtime", "Elixir"),
    "erlang": ("runtime", "Erlang/OTP"), "deno": ("runtime", "Deno"), "bun": ("runtime", "Bun"), "golang": ("toolchain", "Go"), "go": ("toolchain", "Go"), "rust": ("toolchain", "Rust"),
    "pnpm": ("package-manager", "pnpm"), "yarn": ("package-manager", "Yarn"), "npm": ("package-manager", "npm"),
}
VERSION_FILES = {
    ".nvmrc": "node", ".node-version": "node", ".python-version": "python", ".ruby-version": "ruby", ".java-version": "java", ".go-version": "go", "rust-toolchain": "rust",
}

Need = tuple[str, str, str | None]  # kind, name, version


def first_line(text: str) -> str | None:
    return next((x.strip().lstrip("v") for x in text.split("\n") if x.strip() and not x.strip().startswith("#")), None)


def needs(path: str, text: str) -> Iterator[Need]:
    """What one file asks for."""
    name, depth = path.rpartition("/")[2], path.count("/") + 1
    if name in VERSION_FILES:
        yield *TOOLS[VERSION_FILES[name]], first_line(text)
    elif name == ".terraform-version":
        yield "toolchain", "Terraform", first_line(text)
    elif name == "rust-toolchain.toml":
        yield "toolchain", "Rust", tomllib.loads(text).get("toolchain", {}).get("channel")
    elif name == ".tool-versions":
        for line in text.split("\n"):
            words = line.split()
            if words and not words[0].startswith("#"):
                yield *TOOLS.get(words[0], ("toolchain", words[0])), words[1] if len(words) > 1 else None
    elif name == "global.json":
        yield "sdk", ".NET SDK", json.loads(text).get("sdk", {}).get("version")
    elif name == "runtime.txt":
        tool, dash, version = (first_line(text) or "").partition("-")
        if dash and tool in ("python", "ruby", "node", "nodejs"):
            yield *TOOLS[tool], version
    elif name == "package.json" and depth <= 2:
        doc = json.loads(text)
        for tool, version in (doc.get("engines") or {}).items():
            if tool in ("node", "npm", "pnpm", "yarn"):
                yield *TOOLS[tool], version if isinstance(version, str) else None
        manager, at, version = str(doc.get("packageManager") or "").partition("@")
        if at:
            yield "package-manager", manager, version.partition("+")[0]
    low = name.lower()
    if low.startswith(("docker-compose", "compose.")) or re.search(r"(^|/)(\.github/workflows/|\.gitlab-ci\.ya?ml$|\.circleci/)", path):
        for image in re.findall(r"""(?m)^\s*(?:-\s*)?image:\s*["']?([^\s"'#]+)""", text):
            base, colon, tag = image.rpartition(":")
            base, tag = (base, tag) if colon and "/" not in tag else (image, None)
            if found := SERVICES.get(base.rpartition("/")[2]):
                yield "service", found, None if tag == "latest" else tag


CONTAINER = r"(?i)(^|/)(dockerfile[^/]*|[^/]*\.dockerfile|containerfile|(docker-compose[^/]*|compose\.[^/]*)\.ya?ml|compose\.ya?ml)$"


def requirements(files: DataFrame) -> DataFrame:
    """(project, kind, name, version, source, problem) of files(project, path, text): runtimes, toolchains, package managers, SDKs, services, containers.

    A project with container definitions needs Docker, by the first of them. A file that cannot be read is a row
    with its problem alone. Equal rows count once; null texts ask for nothing; other columns are ignored.
    """
    schema = "project string, kind string, name string, version string, source string, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for project, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(project, kind, name, version or None, path, None) for kind, name, version in needs(path, text or "")]
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((project, None, None, None, path, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 6, [x.split()[0] for x in schema.split(", ")])

    files = files.select(F.col("project").cast("string").alias("project"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).filter("path is not null")
    depth = F.size(F.split("path", "/"))
    docker = files.filter(F.col("path").rlike(CONTAINER)).groupBy("project").agg(F.min(F.struct(depth.alias("depth"), "path")).alias("m"))
    none = F.lit(None).cast("string")
    docker = docker.select("project", F.lit("container"), F.lit("Docker"), none, "m.path", none)
    return files.mapInArrow(run, schema).union(docker).distinct()


def numbers(text: str) -> list[int] | None:
    """The numbers of a version, up to a wildcard; None for a name such as a channel."""
    m = re.match(r"[vV=\s]*(\d+(?:\.\d+)*)", text)
    return [int(x) for x in m[1].split(".")][:4] if m else None


def bounds(text: str | None) -> tuple[list[int] | None, list[int] | None]:
    """(least version, first version beyond) of a range, four numbers each; None where it has no bound.

    Of alternatives the hull counts. Names such as lts and stable have no bounds.
    """
    if not text:
        return None, None
    full = lambda v: (v + [0] * 4)[:4] if v is not None else None
    after = lambda v: full([*v[:-1], v[-1] + 1])
    found: list[tuple] = []
    for alternative in text.split("||"):
        low, high = None, None
        alternative = re.sub(r"(\S+)\s+-\s+(\S+)", r">=\1 <=\2", alternative)
        for sign, version in re.findall(r"(>=|<=|>|<|\^|~>|~=|~|==|=)?\s*([vV]?\d[\w.*+-]*)", alternative):
            v = numbers(version)
            if v is None:
                continue
            a, b = full(v), after(v)
            if sign == ">=":
                b = None
            elif sign == ">":
                a, b = after(v), None
            elif sign == "<=":
                a = None
            elif sign == "<":
                a, b = None, full(v)
            elif sign == "^":
                k = next((k for k, x in enumerate(v) if x), len(v) - 1)
                b = after(v[: k + 1])
            elif sign in ("~>", "~="):
                b = after(v[: max(1, len(v) - 1)])
            elif sign == "~":
                b = after(v[:2])
            low = a if low is None else max(low, a) if a is not None else low
            high = b if high is None else min(high, b) if b is not None else high
        found.append((low, high))
    lows, highs = zip(*found, strict=True)
    return None if None in lows else min(lows), None if None in highs else max(highs)


def conflicts(found: DataFrame) -> DataFrame:
    """(project, name, low, high, sources, conflict): what all sources of a runtime or tool together allow, from requirements().

    low and high are the ends of the intersection of their ranges, null without a bound; they conflict if it is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [bounds(v) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([e[k] for e in ends], pa.list_(pa.int32())) for k in (0, 1))], ["project", "name", "source", "low", "high"])

    kinds = found.filter("kind in ('runtime', 'toolchain', 'package-manager', 'sdk')").select("project", "name", "source", "version")
    rows = kinds.mapInArrow(run, "project string, name string, source string, low array<int>, high array<int>")
    every = rows.groupBy("project", "name").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.countDistinct("source").alias("sources"))
    return every.withColumn("conflict", F.coalesce(F.col("low") >= F.col("high"), F.lit(False)))


# --- commands --------------------------------------------------------------

# Purposes of tasks by the first word of their names.
PURPOSES = {
    "test": ("test", "tests", "check", "e2e", "coverage", "spec"), "build": ("build", "compile", "all", "dist", "package", "release"), "run": ("start", "serve", "run", "preview"),
    "dev": ("dev", "watch", "develop"), "lint": ("lint", "clippy", "vet", "typecheck", "tsc"), "format": ("format", "fmt", "prettier"), "bench": ("bench", "benchmark", "benchmarks"),
    "install": ("install", "deps", "setup", "bootstrap"),
}
_PURPOSE = {word: purpose for purpose, words in PURPOSES.items() for word in words}


def purpose_of(name: str) -> str | None:
    """What a task is for. A bare check tests; what checks something else is told by the rest of its name."""
    low = name.lower()
    head, _, rest = re.sub(r"[:\-_.]", "\0", low, count=1).partition("\0")
    if head == "check" and rest:
        return "test" if rest in ("test", "tests", "unit", "e2e", "all") else "format" if rest.startswith(("format", "fmt")) or rest == "prettier" else "lint"
    return _PURPOSE.get(head)


def make_rules(text: str) -> Iterator[tuple[str, list[str]]]:
    """(target, prerequisites) of a Makefile: continued lines are joined; recipes, assignments, definitions, patterns and special targets are left out."""
    seen: set[str] = set()
    inside = False
    for line in re.sub(r"\\\r?\n", " ", text).split("\n"):
        if inside or line.startswith("define "):
            inside = not line.startswith("endef")
            continue
        if line.startswith(("\t", " ", "#", ".")):
            continue
        m = re.match(r"([^:=#]+?)\s*::?(?![:=])\s*([^=;#]*)(?:[;#].*)?$", line)
        if not m or re.match(r"(ifn?eq|ifn?def|else|endif|export|include|override|vpath)\b", line):
            continue
        for target in m[1].split():
            if target not in seen and re.fullmatch(r"[A-Za-z0-9][\w.\-/]*", target):
                seen.add(target)
                yield target, m[2].replace("|", " ").split()


def just_rules(text: str) -> Iterator[tuple[str, list[str]]]:
    """(recipe, those that it depends on) of a justfile."""
    for line in re.sub(r"\\\r?\n", " ", text).split("\n"):
        m = re.match(r"@?([A-Za-z0-9][\w\-]*)((?:\s+[^:=\s]+(?:=(?:\"[^\"]*\"|'[^']*'|\S+))?)*)\s*:(?!=)([^=#]*)", line)
        if m and m[1] not in ("set", "alias", "export", "import", "mod"):
            yield m[1], re.findall(r"[A-Za-z0-9][\w\-]*", re.sub(r"\([^)]*\)", lambda p: p[0][1:].split()[0].rstrip(")"), m[3].replace("&&", " ")))


def keyed(doc: object, key: str) -> Iterator[tuple[str, list[str]]]:
    found = doc.get(key) if isinstance(doc, dict) else None
    for name, task in (found or {}).items() if isinstance(found, dict) else ():
        deps = task.get("deps") if isinstance(task, dict) else None
        yield str(name), [x if isinstance(x, str) else str(x.get("task")) for x in deps or [] if isinstance(x, (str, dict))]


def without_comments(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("//"))


#: file name -> (how a task is run, where it stands, its reader), in the order in which sources count.
RUNNERS = {
    "package.json": ("", "scripts.", lambda t: keyed(json.loads(t), "scripts")),
    **{n: ("make ", "", make_rules) for n in ("Makefile", "GNUmakefile", "makefile")},
    **{n: ("just ", "", just_rules) for n in ("justfile", "Justfile")},
    **{n: ("task ", "", lambda t: keyed(yaml.load(t), "tasks")) for n in ("Taskfile.yml", "Taskfile.yaml")},
    **{n: ("deno task ", "tasks.", lambda t: keyed(json.loads(without_comments(t)), "tasks")) for n in ("deno.json", "deno.jsonc")},
    "composer.json": ("composer run ", "scripts.", lambda t: keyed(json.loads(t), "scripts")),
}
_HAS = "array_contains(has, '{}')"
_PREFIX = f"CASE WHEN contains(text, '[tool.poetry') THEN 'poetry run ' WHEN {_HAS.format('uv.lock')} THEN 'uv run ' ELSE '' END"
_PYTEST = f"(contains(text, 'pytest') OR {_HAS.format('pytest.ini')} OR {_HAS.format('conftest.py')})"
_MVN, _GRADLE = (f"if({_HAS.format(w)}, './{w}', '{c}')" for w, c in (("mvnw", "mvn"), ("gradlew", "gradle")))
_DART = "if(contains(text, 'flutter'), 'flutter', 'dart')"
# Fixed values: (file, command as SQL over text and has, purpose, when); commands that tools have by convention.
CONVENTIONS = (
    ("Cargo.toml", "'cargo build'", "build", ""), ("Cargo.toml", "'cargo test'", "test", ""), ("Cargo.toml", "'cargo clippy --all-targets'", "lint", ""), ("Cargo.toml", "'cargo fmt --check'", "format", ""),
    ("go.mod", "'go build ./...'", "build", ""), ("go.mod", "'go test ./...'", "test", ""), ("go.mod", "'go vet ./...'", "lint", ""),
    ("Package.swift", "'swift build'", "build", ""), ("Package.swift", "'swift test'", "test", ""), ("composer.json", "'composer install'", "install", ""), ("Gemfile", "'bundle install'", "install", ""),
    ("meson.build", "'meson setup build'", "build", ""), ("meson.build", "'meson test -C build'", "test", ""), ("CMakeLists.txt", "'cmake -S . -B build && cmake --build build'", "build", ""),
    ("Dockerfile", "'docker build .'", "build", ""), ("uv.lock", "'uv sync'", "install", ""),
    ("Cargo.toml", "'cargo run'", "run", f"{_HAS.format('main.rs')} OR contains(text, '[[bin]]')"), ("CMakeLists.txt", "'ctest --test-dir build'", "test", "contains(text, 'enable_testing')"),
    ("pom.xml", f"{_MVN} || ' -B package'", "build", ""), ("pom.xml", f"{_MVN} || ' -B test'", "test", ""),
    *((f, f"{_GRADLE} || ' {c}'", c, "" if k == 0 else " AND ".join("NOT " + _HAS.format(x) for x in ("build.gradle.kts", "build.gradle", "settings.gradle.kts")[:k])) for k, f in enumerate(("build.gradle.kts", "build.gradle", "settings.gradle.kts", "settings.gradle")) for c in ("build", "test")),
    ("pubspec.yaml", f"{_DART} || ' pub get'", "install", ""), ("pubspec.yaml", f"{_DART} || ' test'", "test", ""),
    ("Gemfile", f"if({_HAS.format('.rspec')} OR contains(text, 'rspec'), 'bundle exec rspec', 'bundle exec rake test')", "test", ""),
    *((f, "'poetry install'", "install", f"contains(text, '[tool.poetry'){w}") for f, w in (("pyproject.toml", ""), ("setup.py", f" AND NOT {_HAS.format('pyproject.toml')}"))),
    *((f, "'pip install -e .'", "install", f"NOT contains(text, '[tool.poetry') AND NOT {_HAS.format('uv.lock')}{w}") for f, w in (("pyproject.toml", ""), ("setup.py", f" AND NOT {_HAS.format('pyproject.toml')}"))),
    *((f, f"{_PREFIX} || if({_PYTEST}, 'pytest', 'python -m unittest')", "test", w) for f, w in (("pyproject.toml", ""), ("setup.py", f"NOT {_HAS.format('pyproject.toml')}"))),
    *((f, f"{_PREFIX} || 'ruff check .'", "lint", f"(contains(text, '[tool.ruff') OR contains(text, '\"ruff')){w}") for f, w in (("pyproject.toml", ""), ("setup.py", f" AND NOT {_HAS.format('pyproject.toml')}"))),
    ("requirements.txt", "'pip install -r requirements.txt'", "install", f"NOT {_HAS.format('pyproject.toml')} AND NOT {_HAS.format('setup.py')}"),
    ("tox.ini", "'tox'", "test", ""), ("noxfile.py", "'nox'", "test", ""),
    *((f, "'docker compose up'", "run", "") for f in ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")),
)
_KNOWN = tuple(sorted({c[0] for c in CONVENTIONS} | set(RUNNERS) | {"main.rs", "uv.lock", "mvnw", "gradlew", ".rspec", "pytest.ini", "conftest.py", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock"}))


def tasks(files: DataFrame) -> DataFrame:
    """(project, path, file, task, purpose, needs, place, problem) of the tasks that task files and manifests declare, those without a known purpose included."""
    schema = "project string, path string, file string, task string, purpose string, needs array<string>, place int, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for project, path, file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(project, path, file, task, purpose_of(task), more, k, None) for k, (task, more) in enumerate(RUNNERS[file][2](text or ""))]
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((project, path, file, None, None, None, 0, str(e)[:200]))
            kinds = [pa.string()] * 5 + [pa.list_(pa.string()), pa.int32(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return files.select("project", "path", "file", "text").filter(F.col("file").isin(*RUNNERS)).mapInArrow(run, schema)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def commands(files: DataFrame) -> DataFrame:
    """(project, command, purpose, folder, source, needs): commands of files(project, path, text) that a project offers, not verified.

    Scripts of every package.json outside of node_modules are run by the package manager whose lock file is there;
    of other task files and manifests the one with the shortest path counts. A command that several sources give in
    a folder comes from the first in the order of RUNNERS and CONVENTIONS. Files that cannot be read give none.
    """
    file = F.regexp_extract("path", "[^/]*$", 0)
    files = files.select(F.col("project").cast("string").alias("project"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), file.alias("file"))
    files = files.filter(F.col("file").isin(*_KNOWN) & ~F.col("path").rlike("(^|/)node_modules/"))
    depth = F.size(F.split("path", "/"))
    first = files.groupBy("project", "file").agg(F.min(F.struct(depth.alias("depth"), "path", "text")).alias("m")).select("project", "file", "m.path", "m.text")
    # the names that count are few, so that what a project has is a short list
    has = first.groupBy("project").agg(F.collect_set("file").alias("has"))
    runner = F.expr("CASE WHEN array_contains(has, 'pnpm-lock.yaml') THEN 'pnpm' WHEN array_contains(has, 'yarn.lock') THEN 'yarn' WHEN array_contains(has, 'bun.lockb') OR array_contains(has, 'bun.lock') THEN 'bun' ELSE 'npm' END")
    by_rule = [
        F.when((F.col("file") == name) & (F.expr(when) if when else F.lit(True)), F.struct(F.lit(100 + k).alias("rank"), F.expr(command).alias("command"), F.lit(purpose).alias("purpose")))
        for k, (name, command, purpose, when) in enumerate(CONVENTIONS)
    ]
    usual = first.join(has, "project").select("project", "path", F.inline(F.array_compact(F.array(*by_rule))))
    usual = usual.select("project", "command", "purpose", folder(F.col("path")).alias("folder"), F.col("path").alias("source"), F.array().cast("array<string>").alias("needs"), "rank", F.lit(0).alias("place"))
    scripts = files.filter("file = 'package.json'")
    install = F.when((runner == "npm") & F.array_contains("has", "package-lock.json"), "npm ci").otherwise(F.concat(runner, F.lit(" install")))
    installs = scripts.filter(depth <= 4).join(has, "project").select(
        "project", install.alias("command"), F.lit("install").alias("purpose"), folder(F.col("path")).alias("folder"), F.concat("path", F.lit(" (package manager)")).alias("source"),
        F.array().cast("array<string>").alias("needs"), F.lit(0).alias("rank"), F.lit(0).alias("place"),
    )
    named = tasks(scripts.union(first.filter("file != 'package.json'").select(*scripts.columns))).filter("purpose is not null").join(has, "project")
    how = F.when(F.col("file") == "package.json", F.when((runner == "npm") & (F.col("task") == "test"), "npm test").otherwise(F.concat(runner, F.lit(" run "), "task")))
    where, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (name, (run, at, _)) in enumerate(RUNNERS.items()):
        if run:
            how = how.when(F.col("file") == name, F.concat(F.lit(run), "task"))
        where = F.when(F.col("file") == name, F.concat("path", F.lit(" " + at), "task")).otherwise(where)
        rank = F.when(F.col("file") == name, F.lit(1 if name == "package.json" else 500 + k)).otherwise(rank)
    declared = named.select("project", how.alias("command"), "purpose", folder(F.col("path")).alias("folder"), where.alias("source"), "needs", rank.alias("rank"), "place")
    every = installs.unionByName(declared).unionByName(usual)
    best = every.groupBy("project", "command", "folder").agg(F.min(F.struct("rank", "source", "place", "purpose", "needs")).alias("m"))
    return best.select("project", "command", "m.purpose", "folder", "m.source", "m.needs")
