"""Column functions for hashes, files by name, scripts, numbers of a scale and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.scalars import coverage, extension, file_name


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed SHA-256 (RFC 2104) of a text in lowercase hex; null stays null."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def stable_hash(*fields: Column) -> Column:
    """SHA-256 in lowercase hex of fields, each after its length in bytes as 64 little-endian bits, so that no two lists run together."""

    def framed(x: Column) -> Column:
        size = F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0")
        return F.concat(F.unhex(F.concat(*(F.substring(size, 2 * k + 1, 2) for k in reversed(range(8))))), x.cast("binary"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 in sixteen lowercase hex digits; products are taken in halves of 32 bits, which do not overflow."""
    raw = text.cast("binary")
    octets = F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(raw)), lambda i: i > 0), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    low32 = F.lit(0xFFFFFFFF)

    def step(h: Column, octet: Column) -> Column:
        low = h["low"].bitwiseXOR(octet)
        product = low * 0x1B3  # the prime is 2 to the 40, and 0x1B3
        high = h["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(low32).alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    h = F.aggregate(octets, start, step)
    return F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))


def shebang(line: Column) -> Column:
    """The interpreter that a first line names, past `env` and its options; null without one."""
    words = F.split(F.trim(F.regexp_extract(line, r"^#!(.*)$", 1)), r"\s+")
    program = F.substring_index(F.get(words, F.lit(0)), "/", -1)
    named = F.get(F.filter(F.slice(words, 2, 1_000), lambda w: ~w.startswith("-")), F.lit(0))
    return F.when(line.startswith("#!"), F.nullif(F.when(program == "env", named).otherwise(program), F.lit("")))


def interpreters(line: Column) -> Column:
    """What to look an interpreter up by, in order: its name, without what follows a dot, without a version."""
    name = shebang(line)
    return F.array_distinct(F.array(name, F.substring_index(name, ".", 1), F.regexp_replace(name, r"[0-9.]+$", "")))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    """0 for a month that does not exist."""
    return F.when(~month.between(1, 12), 0).when(month == 2, F.when(is_leap_year(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def nice_step(span: Column, count: Column) -> Column:
    """1, 2 or 5 times a power of ten for about so many intervals over a span; 1 where there is nothing to divide."""
    raw = span / F.greatest(count, F.lit(1))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    fraction = raw / power
    nice = F.when(fraction <= 1, 1).when(fraction <= 2, 2).when(fraction <= 5, 5).otherwise(10)
    return F.when((span > 0) & (count >= 1), nice * power).otherwise(F.lit(1.0))


#: Flags of a file.
FLAGS = ("generated", "vendored", "binary", "skipped")


def in_state(state: str) -> Column:
    """Whether a file's flags put it in a state: all, regular (no flag) or one of the flags."""
    if state == "all":
        return F.lit(True)
    if state == "regular":
        return reduce(Column.__and__, (~F.coalesce(f, F.lit(False)) for f in FLAGS))
    return F.coalesce(state, F.lit(False))


def is_first_party_code(category: Column) -> Column:
    return category.isin("source", "test")


def scrubbed(text: Column, locations: tuple[str, ...]) -> Column:
    """Free text without the input's own locations: what lies below one becomes relative, the location itself a dot; longest first."""
    for place in sorted(set(locations), key=lambda x: (-len(x), x)):
        for told, by in ((place + "/", ""), (place + "\\", ""), (place, ".")):
            text = F.replace(text, F.lit(told), F.lit(by))
    return text


# Folders and names by kind of test, in the order in which they are tried.
TEST_KINDS = (
    ("benchmark", ("bench", "benches", "benchmark", "benchmarks"), "bench"),
    ("end-to-end", ("e2e", "end-to-end", "cypress", "playwright", "acceptance"), r"\.e2e\.|_e2e"),
    ("snapshot", ("__snapshots__", "snapshots", "golden"), r"\.snap$"),
    ("integration", ("integration", "integration-tests", "integration_tests", "it"), "integration"),
)


def test_kind(path: Column, language: Column) -> Column:
    """The kind of test that a test file most likely holds, by its folders and name; in Rust, a tests folder holds integration tests."""
    low = F.lower(path)
    parts, name = F.split(low, "/"), file_name(low)
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    out = F.when(F.coalesce(language == "rust", F.lit(False)) & has("tests"), "integration").otherwise("unit")
    for kind, folders, pattern in reversed(TEST_KINDS):
        out = F.when(has(*folders) | name.rlike(pattern), kind).otherwise(out)
    return out


# Files of services that build and test.
CI_PATHS = (".circleci/config.yml", "cloudbuild.yaml", "cloudbuild.yml", ".gitlab-ci.yml", ".travis.yml", ".drone.yml", "appveyor.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml", "Jenkinsfile")


def is_ci_file(path: Column) -> Column:
    return path.isin(*CI_PATHS) | (extension(path).isin("yml", "yaml") & path.rlike(r"^\.(github/workflows|buildkite)/"))


def is_readme(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r"^readme(\.|$)")


def is_license(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r"^(license|licence|copying|unlicense)([.-]|$)")


def is_env_file(path: Column) -> Column:
    """A file of environment values that is no example or template."""
    return F.lower(file_name(path)).rlike(r"^\.env(\.|$)(?!.*\.?(example|sample|template|dist|defaults|schema)$)")


def has_values(text: Column) -> Column:
    """Whether a line outside comments gives a name a value."""
    return text.rlike(r"(?m)^[ \t]*[^#\s=][^=\n]*=[ \t]*\S")


#: Kinds of evidence, in the order of their features.
EVIDENCE = ("fact", "file", "module", "edge", "package", "commit", "metric", "finding", "command", "excerpt")


def evidence_features(query: Column, reference: Column, detail: Column, kind: Column) -> Column:
    """A bias, how much of a query's terms a reference and a detail cover, and one place for each kind."""
    one = F.lit(1.0)
    return F.array(one, coverage(query, reference), coverage(query, detail), *(F.when(kind == k, one).otherwise(0.0) for k in EVIDENCE))


def attributes(folder: Column, text: Column) -> Column:
    """[(glob, what)] of an attributes file in a folder (empty at the root): generated, vendored, documentation, or first-party where one is unset.

    Comments, macros, quoted and negated patterns are left out. A pattern with a slash before its end is
    anchored in its folder, others hold in all folders below.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.rlike(r'^(?!#|\[attr\]|"|!)\S+\s'))

    def of_line(line: Column) -> Column:
        words = F.split(line, r"\s+")
        pattern = F.regexp_replace(words[0], "^/+", "")
        anchored = words[0].rlike(r"^/|/.*[^/]")
        place = F.when(folder == "", F.when(anchored, F.concat(F.lit("/"), pattern)).otherwise(pattern)).otherwise(F.concat(F.lit("/"), folder, F.when(anchored, "/").otherwise("/**/"), pattern))
        said = F.filter(F.slice(words, 2, 1_000), lambda w: w.rlike(r"^-?linguist-(generated|vendored|documentation)(=.*)?$"))
        unset = lambda w: w.startswith("-") | w.rlike("=(false|0)$")
        return F.transform(said, lambda w: F.struct(place.alias("glob"), F.when(unset(w), "first-party").otherwise(F.regexp_extract(w, r"linguist-(\w+)", 1)).alias("what")))

    return F.array_distinct(F.flatten(F.transform(lines, of_line)))


def folder_of_package(path: Column, roots: tuple[str, ...]) -> Column:
    """The deepest of a few package folders that holds a path; the root, empty, if none does."""
    out = F.lit("")
    for root in sorted(set(roots), key=lambda r: (r.count("/"), len(r), r)):
        out = F.when(F.startswith(path, F.lit(root + "/")), root).otherwise(out)
    return out




def cache_key(content: Column, language: Column, version: str) -> Column:
    """What an analysis of a text is kept under: its SHA-256, the fingerprint of its language's definition and the version of the analysis."""
    return stable_hash(F.lit("file-analysis"), F.lit(version), language, F.unhex(content))
