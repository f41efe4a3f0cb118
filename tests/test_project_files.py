"""YAML, requirements and version ranges, commands of task files, lock files and workflows."""

import pytest

from siltstone.operators import environment
from siltstone.sources import manifests, yaml

DOCUMENTS = [
    ("a: 1\nb:\n  - x\n  - y: 2\n    z: [1, 'two', {k: v, e: }]\n  -\n    - q\nc: {a: b, d: [e, f]}\n# end\n", {"a": "1", "b": ["x", {"y": "2", "z": ["1", "two", {"k": "v", "e": None}]}, ["q"]], "c": {"a": "b", "d": ["e", "f"]}}),
    ('---\nname: "x: y" # c\nrun: |\n  echo a\n\n  b: c\nfold: >-\n  one\n  two\nnext: \'it\'\'s\'\nurl: http://a.b/c#d\n---\nother: 1\n', {"name": "x: y", "run": "echo a\n\nb: c\n", "fold": "one two", "next": "it's", "url": "http://a.b/c#d"}),
    ("base: &b\n  k: 1\n  l: 2\nd:\n  <<: *b\n  l: 3\ne: *b\n", {"base": {"k": "1", "l": "2"}, "d": {"k": "1", "l": "3"}, "e": {"k": "1", "l": "2"}}),
    ("a: [1,\n  2,\n  3]\nb: ~\nmulti: one\n  two\n", {"a": ["1", "2", "3"], "b": None, "multi": "one two"}),
    ("a:\n- 1\n- 2\nb: x\n", {"a": ["1", "2"], "b": "x"}),
    ('"q\\u0041\\n": "\\x42"\n', {"qA\n": "B"}), ("", None), ("# only\n", None), ("just text\n", "just text"), ("- - a\n  - b\n- c\n", [["a", "b"], "c"]),
]


@pytest.mark.parametrize(("text", "want"), DOCUMENTS)
def test_yaml(text, want):
    assert yaml.load(text) == want


BAD = ["key: [unclosed", "a: 1\n   b: 2\n", "a: b: c\n", "x: 'abc\n", "a: *no\n", "\ta: 1\n", "a: !tag x\n", "a: 1\na: 2\n", "- a\nb\n", "a: &a [x]\n" + "".join(f"k{i}: *a\n" for i in range(300)), "".join(" " * i + f"k{i}:\n" for i in range(100)), "a: " + "[" * 200, "x" * (yaml.MOST_BYTES + 1)]


@pytest.mark.parametrize("text", BAD, ids=range(len(BAD)))
def test_yaml_that_is_refused(text):
    with pytest.raises(yaml.Refused):
        yaml.load(text)


def test_version_ranges():
    for text, low, high in [
        ("18", "18", "19"), ("v18.2.1", "18.2.1", "18.2.2"), (">=16", "16", None), (">=3.8,<3.12", "3.8", "3.12"), ("^1.2.3", "1.2.3", "2"), ("^0.2", "0.2", "0.3"), ("~1.2.3", "1.2.3", "1.3"), ("~>2.7", "2.7", "3"),
        ("~=3.8.1", "3.8.1", "3.9"), ("18.x", "18", "19"), ("14 || >=16", "14", None), ("1.2 - 2.3", "1.2", "2.4"), (">1.2", "1.3", None), ("<=3", None, "4"), ("lts/*", None, None), ("", None, None), (None, None, None), ("stable", None, None),
    ]:
        got = [None if v is None else ".".join(map(str, v)) for v in environment.bounds(text)]
        full = lambda v: None if v is None else ".".join((v.split(".") + ["0"] * 4)[:4])
        assert got == [full(low), full(high)], text


def test_task_files():
    make = "CC = gcc\nX := $(shell y)\n.PHONY: all\nall: a b \\\n\tc\n\techo: not\nbuild:: x\nbuild:: y\na b: | d ; run\n%.o: %.c\nifeq (x, y)\nz: ; q\nendif\ndefine F\nno: x\nendef\nt-e.s/t: # c\nV ?= a:b\n$(X): n\n"
    assert list(environment.make_rules(make)) == [("all", ["a", "b", "c"]), ("build", ["x"]), ("a", ["d"]), ("b", ["d"]), ("z", []), ("t-e.s/t", [])]
    just = "set shell := ['x']\nalias b := build\nv := 'a:b'\n@build target='x' +rest: dep (gen 'a') && after\n  cc: x\ntest:\n[private]\n# c: x\n"
    assert list(environment.just_rules(just)) == [("build", ["dep", "gen", "after"]), ("test", [])]
    names = {"test:unit": "test", "check": "test", "check-format": "format", "check:generated": "lint", "Build_all": "build", "dev": "dev", "odd": None, "": None, "bench.x": "bench", "deps": "install", "start-x": "run", "fmt": "format", "vet": "lint"}
    assert {n: environment.purpose_of(n) for n in names} == names


def test_requirements_and_commands_of_odd_files(spark):
    rows = [
        (None, ".nvmrc", "v18"), ("p", ".nvmrc", None), ("p", "package.json", "[1]"), ("p", "a/package.json", '{"engines": {"node": 5}}'), ("p", None, "x"), ("p", "x/.github/workflows/a.yml", "    image: 'redis:7'\n    image: other\n    image: registry:5000/postgres\n"),
        ("p", "rust-toolchain.toml", "[toolchain]\nchannel = '1.80'\n"), ("p", "global.json", '{"sdk": {"version": "8.0.1"}}'), ("p", "x/Dockerfile", ""), ("p", "Dockerfile.dev", ""), ("q", "Taskfile.yml", "tasks: ["), ("q", "Makefile", None), ("q", "deno.jsonc", '// c\n{"tasks": {"test": "x"}}'),
        ("q", "pom.xml", ""), ("q", "mvnw", ""), ("q", "setup.py", "pytest"), ("q", "pyproject.toml", "[tool.ruff]"), ("q", "uv.lock", ""), ("q", "build.gradle", ""), ("q", "settings.gradle", ""),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "project string, path string, text string, has int")
    got = {(r.project, r.name, r.version, r.source) for r in environment.requirements(files).collect() if r.problem is None}
    assert got == {
        (None, "Node.js", "18", ".nvmrc"), ("p", "Node.js", None, ".nvmrc"), ("p", "Node.js", None, "a/package.json"), ("p", "Redis", "7", "x/.github/workflows/a.yml"), ("p", "PostgreSQL", None, "x/.github/workflows/a.yml"),
        ("p", "Rust", "1.80", "rust-toolchain.toml"), ("p", ".NET SDK", "8.0.1", "global.json"), ("p", "Docker", None, "Dockerfile.dev"),
    }
    assert environment.requirements(files).filter("problem is not null").count() == 1
    found = {(r.command, r.source) for r in environment.commands(files.filter("project = 'q'")).collect()}
    assert found == {
        ("deno task test", "deno.jsonc tasks.test"), ("./mvnw -B package", "pom.xml"), ("./mvnw -B test", "pom.xml"), ("uv sync", "uv.lock"), ("uv run python -m unittest", "pyproject.toml"), ("uv run ruff check .", "pyproject.toml"),
        ("gradle build", "build.gradle"), ("gradle test", "build.gradle"),
    }
    empty = files.limit(0)
    assert environment.requirements(empty).count() == environment.commands(empty).count() == environment.conflicts(environment.requirements(empty)).count() == 0


def test_lock_files(spark):
    rows = [
        ("pnpm-lock.yaml", "packages:\n  /a/1.0.0: {}\n  '@s/b@2.0.0(x@1)(y@2)': {}\n  c@3.1.0:\n    dev: true\n"), ("yarn.lock", '# x\n__metadata:\n  version: 6\n\n"@s/a@npm:^1":\n  version: 1.2.3\nb@^1, b@~1:\n  version "1.4.0"\n'),
        ("pubspec.lock", "packages:\n  http:\n    version: \"1.2.0\"\n  bad:\n"), ("pubspec.yaml", "name: x\ndependencies:\n  http: ^1.2.0\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  lints:\n"), ("sub/pubspec.yaml", "- x\n"), ("pnpm-lock.yaml", None),
    ]
    got = {(r.ecosystem, r.name, r.requirement, r.scope) for r in manifests.declarations(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        ("npm", "a", "1.0.0", "locked"), ("npm", "@s/b", "2.0.0", "locked"), ("npm", "c", "3.1.0", "locked"), ("npm", "@s/a", "1.2.3", "locked"), ("npm", "b", "1.4.0", "locked"), ("pub", "http", "1.2.0", "locked"),
        ("pub", "http", "^1.2.0", "runtime"), ("pub", "flutter", None, "runtime"), ("pub", "lints", None, "development"), ("pub", None, None, None),
    }


def test_yaml_of_quotes_in_quotes():
    """An apostrophe within double quotes is a character like any other."""
    assert yaml.load("a: [\"it's\", \"x'\"]\nb: \"'\"\n") == {"a": ["it's", "x'"], "b": "'"}


def test_yaml_reads_a_line_once(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def match(self, *args):
            self.calls += 1
            return self.pattern.match(*args)

    text = "packages:\n" + "".join(f"  p{k}:\n    kind: x\n    version: \"1.{k}\"\n" for k in range(100))
    monkeypatch.setattr(yaml, "_KEY", counted := Counted(yaml._KEY))
    assert len(yaml.load(text)["packages"]) == 100
    assert counted.calls <= text.count("\n")
