"""Facts of a project from its files: services that build it, tools, tests, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.facts import is_ci_file, is_license, test_kind
from siltstone.functions.scalars import depth, extension, file_name, parent, round4

# Services by their files, tools by theirs, reports of coverage, documents by their names.
PROVIDERS = {
    ".gitlab-ci.yml": "GitLab CI", ".circleci/config.yml": "CircleCI", "azure-pipelines.yml": "Azure Pipelines", "Jenkinsfile": "Jenkins", ".travis.yml": "Travis CI",
    "bitbucket-pipelines.yml": "Bitbucket Pipelines", ".drone.yml": "Drone", "appveyor.yml": "AppVeyor",
}
TOOLS = (
    ("Cargo", "cargo", ("Cargo.toml",)), ("Go modules", "go", ("go.mod",)), ("Maven", "maven", ("pom.xml",)), ("Gradle", "gradle", ("build.gradle.kts", "build.gradle", "settings.gradle.kts", "settings.gradle")),
    ("Composer", "composer", ("composer.json",)), ("Bundler", "rubygems", ("Gemfile",)), ("Rake", "rubygems", ("Rakefile",)), ("Swift Package Manager", "swiftpm", ("Package.swift",)), ("CMake", None, ("CMakeLists.txt",)),
    ("Meson", None, ("meson.build",)), ("Make", None, ("Makefile", "GNUmakefile", "makefile")), ("Bazel", None, ("MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel", "BUILD.bazel")), ("Autotools", None, ("configure.ac",)),
    ("SCons", None, ("SConstruct",)), ("just", None, ("justfile", "Justfile")), ("Task", None, ("Taskfile.yml", "Taskfile.yaml")), ("Deno", "deno", ("deno.json", "deno.jsonc")), ("Nix", None, ("flake.nix", "default.nix", "shell.nix")),
    ("Turborepo", "npm", ("turbo.json",)), ("Nx", "npm", ("nx.json",)), ("Lerna", "npm", ("lerna.json",)), ("Angular CLI", "npm", ("angular.json",)), ("Tauri", None, ("tauri.conf.json",)), ("uv", "pypi", ("uv.lock",)), ("Pipenv", "pypi", ("Pipfile",)),
)
TOOL_STARTS = (
    ("Vite", "npm", "vite.config."), ("webpack", "npm", "webpack.config."), ("Next.js", "npm", "next.config."), ("Rollup", "npm", "rollup.config."), ("SvelteKit", "npm", "svelte.config."), ("Astro", "npm", "astro.config."), ("Nuxt", "npm", "nuxt.config."),
)
COVERAGE_FILES = (".coverage", "clover.xml", "cobertura-coverage.xml", "cobertura.xml", "coverage-final.json", "coverage.xml", "jacoco.xml", "lcov.info")
DOCUMENTS = {
    "contributing": ("CONTRIBUTING",), "code-of-conduct": ("CODE_OF_CONDUCT", "CODE-OF-CONDUCT"), "security-policy": ("SECURITY",), "changelog": ("CHANGELOG", "CHANGES", "HISTORY", "NEWS", "RELEASES"),
    "support": ("SUPPORT",), "codeowners": ("CODEOWNERS",), "citation": ("CITATION",),
}
MENTIONS = {"contributing": "contribut", "code-of-conduct": "code of conduct", "security-policy": "security", "support": "support"}
FOLDERS = {"docs-directory": ("docs", "doc", "documentation", "website", "book", "manual"), "examples": ("examples", "example", "samples", "sample", "demo", "demos")}
OPTIONAL = ("contributing", "security-policy", "changelog", "code-of-conduct")


def ci_configs(files: DataFrame) -> DataFrame:
    """(path, provider) of the files of services that build and test."""
    path = F.col("path")
    by_name = F.element_at(F.create_map(*(F.lit(x) for kv in PROVIDERS.items() for x in kv)), path) if PROVIDERS else F.lit(None)
    provider = F.when(path.startswith(".github/workflows/"), "GitHub Actions").when(path.startswith(".buildkite/"), "Buildkite").otherwise(F.coalesce(by_name, F.lit("Google Cloud Build")))
    return files.filter(is_ci_file(path)).select("path", provider.alias("provider"))


def build_systems(files: DataFrame) -> DataFrame:
    """(tool, ecosystem, path) of tools whose files are there: of several, the least deep, then the first by name."""
    name, ext = file_name(F.col("path")), extension(F.col("path"))
    tests = [(t, e, name.isin(*n)) for t, e, n in TOOLS] + [(t, e, name.startswith(n)) for t, e, n in TOOL_STARTS]
    tests += [("pip", "pypi", name.rlike(r"^requirements.*\.txt$")), (".NET SDK", "nuget", F.coalesce(ext.isin("csproj", "fsproj", "vbproj", "sln"), F.lit(False))), ("setuptools", "pypi", name.isin("setup.py", "setup.cfg")), ("Dart pub", "pub", name == "pubspec.yaml")]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(t).alias("tool"), F.lit(e).cast("string").alias("ecosystem"))) for t, e, test in tests)))
    hits = files.select("path", F.explode(found).alias("t")).select("path", "t.*")
    return hits.groupBy("tool", "ecosystem").agg(F.min(F.struct(depth(F.col("path")).alias("d"), "path")).alias("m")).select("tool", "ecosystem", "m.path")


def test_report(files: DataFrame) -> DataFrame:
    """One row of counts from files(path, category, code, inline_tests): files and lines of tests and sources, their ratio, reports of coverage."""
    test, source = F.col("category") == "test", F.col("category") == "source"
    one = files.agg(
        F.count_if(test).alias("test_files"), F.count_if("inline_tests").alias("inline_test_files"), F.coalesce(F.sum(F.when(test, F.col("code"))), F.lit(0)).alias("test_lines"), F.count_if(source).alias("source_files"),
        F.coalesce(F.sum(F.when(source, F.col("code"))), F.lit(0)).alias("source_lines"), F.count_if(file_name(F.col("path")).isin(*COVERAGE_FILES)).alias("coverage_files"),
    )
    ratio = F.coalesce(F.col("test_lines") / F.nullif(F.col("test_lines") + F.col("source_lines"), F.lit(0)), F.lit(0.0))
    return one.withColumn("test_ratio", round4(ratio))


def test_kinds(files: DataFrame) -> DataFrame:
    """(kind, files) of files(path, language, category, inline_tests); files with tests inside are unit tests, too."""
    own = files.filter("category = 'test'").select(test_kind(F.col("path"), F.col("language")).alias("kind"))
    return own.union(files.filter("inline_tests").select(F.lit("unit"))).groupBy("kind").agg(F.count("*").alias("files"))


def doc_checks(files: DataFrame, readme: DataFrame) -> DataFrame:
    """(id, status) of each expected document: present, partial or missing.

    files(path); readme(path, words, installation, usage, headings), a row or none: what the project's
    README says. Documents stand at the root, in docs or in .github; a README section is a partial one.
    """
    path, name, folder = F.col("path"), F.upper(file_name(F.col("path"))), F.lower(parent(F.col("path")))
    place = folder.isin("", "docs", ".github")
    stem = lambda names: place & name.rlike("^(" + "|".join(names) + r")(\.|$)")
    inside = lambda names: F.arrays_overlap(F.split(F.lower(parent(path)), "/"), F.array(*map(F.lit, names)))
    low = F.lower(path)
    flags = {
        "license": (depth(path) == 1) & is_license(path), **{k: stem(v) for k, v in DOCUMENTS.items()}, **{k: inside(v) for k, v in FOLDERS.items()},
        "issue-templates": low.startswith(".github/issue_template"), "pull-request-template": F.lower(file_name(path)).startswith("pull_request_template") | low.startswith(".github/pull_request_template/"),
    }
    one = files.agg(*(F.coalesce(F.bool_or(x), F.lit(False)).alias(k) for k, x in flags.items()))
    said = readme.agg(*(F.first(c).alias(c) for c in ("path", "words", "installation", "usage", "headings")))
    both = one.crossJoin(said)
    state = lambda present, partial=F.lit(False): F.when(present, "present").when(partial, "partial").otherwise("missing")
    mentions = lambda word: F.coalesce(F.exists("headings", lambda h: F.lower(h).contains(word)), F.lit(False))
    statuses: dict[str, Column] = {
        "readme": state((depth(F.col("path")) == 1) & (F.col("words") >= 30), F.col("path").isNotNull()),
        "installation": state(F.coalesce("installation", F.lit(False))),
        "usage": state(F.coalesce("usage", F.lit(False))),
    }
    statuses |= {k: state(F.col(f"`{k}`"), mentions(MENTIONS[k]) if k in MENTIONS else F.lit(False)) for k in flags}
    return both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("id"), s.alias("status")) for k, s in statuses.items()))).alias("c")).select("c.*")


def facts(files: DataFrame, readme: DataFrame, ci_test_commands: int = 0, license_declared: bool = False) -> DataFrame:
    """One row for rules.PROJECT, from files(path, language, category, code, inline_tests) and the README."""
    checks = doc_checks(files, readme)
    missing = checks.agg(F.count_if(F.col("id").isin(*OPTIONAL) & (F.col("status") == "missing")).alias("optional_missing"), F.bool_or((F.col("id") == "license") & (F.col("status") == "present")).alias("license_file"))
    said = readme.agg(F.first("words").alias("readme_words"), F.coalesce(F.first(depth(F.col("path")) == 1), F.lit(False)).alias("readme_at_root"), F.coalesce(F.first("installation"), F.lit(False)).alias("installation"), F.coalesce(F.first("usage"), F.lit(False)).alias("usage"))
    ci = ci_configs(files).agg(F.count("*").alias("ci_files"))
    one = reduce(DataFrame.crossJoin, (missing, said, ci), test_report(files))
    inline = F.col("inline_test_files") > 0
    return one.withColumns({"inline_tests": inline, "has_tests": inline | (F.col("test_files") > 0), "ci_test_commands": F.lit(ci_test_commands), "license_declared": F.lit(license_declared)})


