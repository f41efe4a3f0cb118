"""Column functions: paths, hashes, versions, URLs, texts, dates and numbers. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- numbers ---------------------------------------------------------------


def round4(x: Column) -> Column:
    """Four decimals, half away from zero, by way of ten-thousandths."""
    return F.signum(x) * F.floor(F.abs(x) * 10000 + 0.5) / 10000


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def sigmoid(x: Column, limit: float = 32.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: what is missing is not zero."""
    return a / F.nullif(b, F.lit(0))


def size_class(files: Column) -> Column:
    """Size class of a number of files."""
    return F.when(files < 100, "tiny").when(files < 1_000, "small").when(files < 10_000, "medium").when(files < 100_000, "large").otherwise("huge")


def activity_level(last_30: Column, last_90: Column, last_365: Column, total: Column) -> Column:
    return (
        F.when(total == 0, "none").when(last_30 >= 30, "very-active").when(last_30 >= 5, "active")
        .when(last_90 >= 1, "moderate").when(last_365 >= 1, "low").otherwise("dormant")
    )


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def pluralised(n: Column, one: str, many: str) -> Column:
    return F.concat(thousands(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


# --- dates -----------------------------------------------------------------


def days_until(a: Column, b: Column) -> Column:
    """Whole days of 86,400 seconds from a to b, rounded down; not calendar days."""
    return F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 86_400)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_rfc3339(text: Column) -> Column:
    """A timestamp from `2024-01-02[T ]03:04:05[.6][Z|+hh:mm]` or a date alone; fractions are dropped, bad texts are null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d)[Tt ]", "$1 "), r"\.\d+", "")
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d([Zz]|[+-]\d\d:\d\d)?)?$"), F.try_to_timestamp(F.regexp_replace(plain, "z$", "Z")))


def offset_minutes(text: Column) -> Column:
    """Minutes of a `+hhmm` offset; 0 if it is none."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text.rlike(r"^[+-]\d{4}$"), sign * (F.substring(text, 2, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))).otherwise(0)


# --- paths -----------------------------------------------------------------


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty for names that start with their only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def prefix(path: Column, n: int) -> Column:
    return F.substring_index(path, "/", n)


def is_within(path: Column, folder: Column) -> Column:
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def area_of(path: Column) -> Column:
    """The first two folders above a path, `(root)` without any."""
    up = parent(path)
    return F.when(up == "", "(root)").otherwise(F.substring_index(up, "/", 2))


def activity_areas(path: Column) -> Column:
    """The one or two areas that a change counts for."""
    up = parent(path)
    return F.when(up == "", F.array(F.lit("(root)"))).otherwise(F.array_distinct(F.array(F.substring_index(up, "/", 1), F.substring_index(up, "/", 2))))


def normalize_relative(path: Column) -> Column:
    """A relative path without `.`, `..` and backslashes; null if it leads outside."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        F.struct(empty.alias("at"), F.lit(False).alias("out")),
        lambda s, p: F.struct(
            F.when(p != "..", F.array_append(s["at"], p)).when(F.size(s["at"]) > 0, F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(s["at"]).alias("at"),
            (s["out"] | ((p == "..") & (F.size(s["at"]) == 0))).alias("out"),
        ),
    )
    return F.when(~walked["out"], F.array_join(walked["at"], "/"))


def join_path(folder: Column, relative: Column) -> Column:
    return normalize_relative(F.when(folder == "", relative).otherwise(F.concat(folder, F.lit("/"), relative)))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob with `*`, `?`, `[..]`, `**`, a leading slash that anchors and a last one for folders alone.

    A pattern with a slash before its end is anchored too. What lies below a match matches.
    """
    folder, text = pattern.endswith("/"), pattern.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out = []
    for part in text.split("/"):
        if part == "**":
            out.append(None)
            continue
        one, k = "", 0
        while k < len(part):
            c = part[k]
            if c == "*":
                one += "[^/]*"
            elif c == "?":
                one += "[^/]"
            elif c == "[" and (end := part.find("]", k + 2)) > 0:
                body = part[k + 1 : end]
                one += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                k = end
            else:
                one += re.escape(c)
            k += 1
        out.append(one)
    found, last = "", len(out) - 1
    for k, one in enumerate(out):
        if one is None:
            found += "(?:[^/]+/)*" if k < last else "[^/]+(?:/[^/]+)*"
        else:
            found += one + ("/" if k < last else "")
    return ("^" if anchored else "^(?:[^/]+/)*") + found + ("/.+$" if folder else "(?:/.+)?$")


def wildcard_regex(pattern: str) -> str:
    """`*` for any characters and `?` for one, over whole rule names."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


# --- hashes and names ------------------------------------------------------


def stable_id(*parts: Column) -> Column:
    """Twelve hex digits of the SHA-256 of the parts with unit separators between them."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)


def contributor_id(email: Column, name: Column) -> Column:
    mail = F.lower(F.trim(email))
    return F.concat(F.lit("c-"), F.when(mail != "", stable_id(F.lit("email"), mail)).otherwise(stable_id(F.lit("name"), F.lower(F.trim(name)))))


def package_name(name: Column) -> Column:
    """Lower case, with runs of `-`, `_` and `.` as one hyphen."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def snake_path(name: Column) -> Column:
    """`FooBar::BazQux` as `foo_bar/baz_qux`."""
    text = F.replace(name, F.lit("::"), F.lit("/"))
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2"))


def parse_version(tag: Column) -> Column:
    """The version of a release tag: up to four numbers with an optional suffix; null for other tags."""
    return F.when(tag.rlike(r"^[vV]?\d+(\.\d+){0,3}([-+][A-Za-z0-9.+-]+)?$"), F.regexp_replace(tag, "^[vV]", ""))


def change_status(code: Column) -> Column:
    of = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type-changed"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.substring(code, 1, 1)), F.lit("modified"))


# --- URLs ------------------------------------------------------------------


def sanitize_url(url: Column) -> Column:
    """A URL without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@]*@", "$1")


def parse_remote(url: Column) -> Column:
    """(host, owner, name) of an `scheme://` or `user@host:path` remote."""
    plain = F.regexp_replace(F.regexp_replace(sanitize_url(url), r"/+$", ""), r"\.git$", "")
    scp = plain.rlike(r"^[^/]+@[^/:]+:[^/]") & ~plain.contains("://")
    host = F.when(scp, F.regexp_extract(plain, r"@([^:]+):", 1)).otherwise(F.regexp_extract(plain, r"://([^/:]+)", 1))
    path = F.when(scp, F.regexp_extract(plain, r":(.*)$", 1)).otherwise(F.regexp_extract(plain, r"://[^/]+/(.*)$", 1))
    return F.struct(F.lower(host).alias("host"), F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("owner"), F.substring_index(path, "/", -1).alias("name"))


def is_private_host(url: Column) -> Column:
    """Whether a URL's host is this machine or in a private range, or is written as a bare number."""
    host = F.lower(F.regexp_extract(url, r"://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return host.rlike(
        r"^(localhost|.*\.localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|0\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|\[(::1?|f[cd].*|fe[89ab].*)\]|\d+|0x[0-9a-f]+)$"
    )


def clone_url_problem(url: Column, allow_private: bool = False) -> Column:
    """Why a URL may not be fetched, or null: an allowed scheme, a plain host, no option-like text."""
    bad = F.when(url.rlike(r"[\x00-\x20\x7f]"), "control-character").when(url.startswith("-"), "option")
    bad = bad.when(~url.rlike(r"^(https?|ssh|git)://") & ~url.rlike(r"^[\w.\-]+@[\w.\-]+:[^/]"), "scheme")
    bad = bad.when(url.rlike(r"://[^/]*%"), "encoded-host")
    return bad if allow_private else bad.when(is_private_host(url), "private-host")


# --- texts -----------------------------------------------------------------


def sanitize(text: Column, most: int = 200) -> Column:
    """One line without control characters, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f\s]+", " ")), 1, most)


def truncate_chars(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def join_list(items: Column) -> Column:
    """`a, b and c`."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(items, F.lit(-1))))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_field(text: Column) -> Column:
    """Quoted where needed; what a spreadsheet would run as a formula starts with an apostrophe."""
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def terms(text: Column) -> Column:
    """Different lower-case runs of letters and digits of two characters and more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= 2))


def coverage(query: Column, text: Column) -> Column:
    """Share of a query's terms that a text has."""
    q = terms(query)
    return F.coalesce(ratio(F.size(F.array_intersect(q, terms(text))), F.size(q)), F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def count_decisions(code: Column) -> Column:
    """Branches, loops, cases, boolean operators and conditional expressions of masked code."""
    return F.regexp_count(code, F.lit(r"\b(?:if|elif|for|while|case|catch|except|when|and|or)\b|&&|\|\||\?(?![.?:])"))


REDACTED = "[redacted]"

# What counts as a secret is part of the results.
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|[\s\S]*)"
KNOWN_TOKEN = (
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_\-]{35}"
    r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{50,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})"
)
URL_CREDENTIALS = r"(?i)\b([a-z][a-z0-9+.\-]*://)[^\s/@:]+(?::[^\s/@]*)?@"
ASSIGNMENT = (
    r"(?i)\b([a-z0-9_.\-]*(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|credential)s?[a-z0-9_.\-]*)"
    r"(\s*[:=]\s*)([\"']?)(?!\[)([^\s\"',;]{4,})"
)
OPAQUE = r"(?<![A-Za-z0-9+/_\-])(?=[a-z0-9+/_\-]*[A-Z])(?=[A-Z0-9+/_\-]*[a-z])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{32,}={0,2}"


# Literals of which a text must hold one for the pattern to be tried at all.
TOKEN_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_live_", "rk_live_", "AKIA", "ASIA", "AIza", "npm_", "pypi-", "SG.", "eyJ")
ASSIGNED_WORDS = ("password", "passwd", "pwd", "secret", "token", "api", "access", "private", "auth", "credential")


def _holds(*words: str) -> Callable[[Column], Column]:
    return lambda t: reduce(Column.__or__, (t.contains(w) for w in words))


#: (test, pattern, replacement): patterns are tried only where a cheap test leaves them open.
_REDACTIONS: tuple[tuple[Callable[[Column], Column], str, str], ...] = (
    (_holds("PRIVATE KEY"), PRIVATE_KEY, REDACTED),
    (_holds(*TOKEN_STARTS), KNOWN_TOKEN, REDACTED),
    (lambda t: t.contains("://") & t.contains("@"), URL_CREDENTIALS, "$1" + REDACTED + "@"),
    (lambda t: (t.contains("=") | t.contains(":")) & _holds(*ASSIGNED_WORDS)(F.lower(t)), ASSIGNMENT, "$1$2$3" + REDACTED),
    (lambda t: t.rlike(r"[A-Za-z0-9+/_\-]{32}"), OPAQUE, REDACTED),
)


def redact_secrets(text: Column) -> Column:
    """Private keys, known tokens, credentials in URLs, assigned secrets and long opaque strings, replaced in this order.

    Each step binds the text before it, so that it is computed once.
    """

    def step(text: Column, test: Callable[[Column], Column], pattern: str, by: str) -> Column:
        return F.transform(F.array(text), lambda t: F.when(test(t), F.regexp_replace(t, pattern, by)).otherwise(t))[0]

    return reduce(lambda text, r: step(text, *r), _REDACTIONS, text)


def contains_secret(text: Column) -> Column:
    return redact_secrets(text) != text


# Phrases that mark generated files.
GENERATED_MARKERS = (
    "@generated",
    "do not edit",
    "code generated",
    "auto-generated",
    "autogenerated",
    "automatically generated",
    "this file is generated",
    "this file was generated",
    "generated by the protocol buffer compiler",
)


def looks_generated(text: Column, language: Column) -> Column:
    """A marker in the first five lines, or a line of over 3,000 bytes in the first fifty of scripts and styles."""
    lines = F.split(text, "\r?\n")
    head = F.lower(F.array_join(F.slice(lines, 1, 5), "\n"))
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked |= head.contains(m)
    long = F.exists(F.slice(lines, 1, 50), lambda x: F.octet_length(x) > 3000)
    return marked | (language.isin("javascript", "css", "scss", "less") & long)


def detect_license(text: Column) -> Column:
    """(spdx, confidence) of a licence text, null if none is known."""
    # Fixed values: (phrases that all occur, identifier, confidence), the first that fits.
    ladder = (
        (("gnu affero general public license",), "AGPL-3.0", "high"),
        (("gnu lesser general public license", "version 2.1"), "LGPL-2.1", "high"),
        (("gnu lesser general public license",), "LGPL-3.0", "high"),
        (("gnu general public license", "version 3"), "GPL-3.0", "high"),
        (("gnu general public license",), "GPL-2.0", "medium"),
        (("apache license", "version 2.0"), "Apache-2.0", "high"),
        (("mozilla public license", "2.0"), "MPL-2.0", "high"),
        (("eclipse public license", "2.0"), "EPL-2.0", "high"),
        (("eclipse public license",), "EPL-1.0", "medium"),
        (("boost software license",), "BSL-1.0", "high"),
        (("this is free and unencumbered software released into the public domain",), "Unlicense", "high"),
        (("cc0 1.0 universal",), "CC0-1.0", "high"),
        (("permission is hereby granted, free of charge",), "MIT", "high"),
        (("permission to use, copy, modify, and/or distribute this software for any purpose",), "ISC", "high"),
        (("redistribution and use in source and binary forms", "neither the name"), "BSD-3-Clause", "high"),
        (("redistribution and use in source and binary forms", "may be used to endorse or promote"), "BSD-3-Clause", "high"),
        (("redistribution and use in source and binary forms",), "BSD-2-Clause", "medium"),
        (("altered source versions must be plainly marked",), "Zlib", "high"),
        (("mit license",), "MIT", "medium"),
    )

    def found(t: Column) -> Column:
        out = F.lit(None).cast("struct<spdx:string,confidence:string>")
        for phrases, spdx, confidence in reversed(ladder):
            test = F.lit(True)
            for p in phrases:
                test &= t.contains(p)
            out = F.when(test, F.struct(F.lit(spdx).alias("spdx"), F.lit(confidence).alias("confidence"))).otherwise(out)
        return out

    # the plain form of a text is made once, not once a phrase as in a filter on the result
    return F.get(F.transform(F.array(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))), found), F.lit(0))


# Folders of tests.
TEST_FOLDERS = (
    "test", "tests", "__tests__", "__test__", "spec", "specs", "testing", "e2e", "cypress", "playwright",
    "integration-tests", "integration_tests", "testdata", "test-data", "test_data", "fixtures", "__fixtures__",
    "__mocks__", "mocks", "benches", "benchmarks", "androidTest", "testFixtures", "unittests", "UnitTests", "Tests",
)


def is_test_path(path: Column) -> Column:
    """Whether a folder or the name of a path says that it is a test."""
    name, stem = F.lower(file_name(path)), file_stem(path)
    return (
        has_folder(path, *TEST_FOLDERS)
        | name.rlike(r"^test_|^conftest\.py$|\.test\.|\.spec\.|\.e2e\.|\.cy\.")
        | stem.rlike(r"(_test|_tests|_spec)$")
        | (stem.rlike(r"(Test|Tests|Spec)$") & (F.octet_length(stem) > 4))
    )


# Folders of tests, examples and documents.
SAMPLE_FOLDERS = ("demo", "demos", "doc", "docs", "example", "examples", "fixture", "fixtures", "sample", "samples", "spec", "test", "testdata", "tests")


def is_sample_path(path: Column) -> Column:
    """Whether a path looks like a test, an example or a document, so that findings there weigh less."""
    low = F.lower(path)
    name = file_name(low)
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, SAMPLE_FOLDERS))) | name.rlike(r"^test_|\.test\.|\.spec\.|_test\.|\.example|\.sample|\.md$")


def has_folder(path: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(parent(path), "/"), F.array(*map(F.lit, names)))
