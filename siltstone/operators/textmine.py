"""Text mining: pattern rules by line, markers, README measures, similar texts and repeated fragments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import file_name, is_sample_path, round4
from siltstone.functions.tables import stored
from siltstone.operators.graph import linked
from siltstone.operators.repeats import repeats


# Languages in which a rule applies.
SCRIPTS = ("python", "javascript", "typescript", "go", "rust", "java", "kotlin", "csharp", "php", "ruby", "shell", "powershell", "yaml", "dockerfile", "makefile", "scala", "swift")
SHELLS = ("shell", "dockerfile", "makefile", "yaml", "powershell")
WEB = ("javascript", "typescript", "vue", "svelte", "html")
CONTAINER_FOLDERS = ("k8s", "kubernetes", "helm", "charts", "manifests", "deploy", "deployment")


@dataclass(frozen=True)
class Rule:
    """A line rule: where it applies, words of which one must occur, a pattern, one that must not match, and a word that the text must have."""

    id: str
    confidence: str
    keywords: tuple[str, ...]
    pattern: str
    languages: tuple[str, ...] = ()
    workflows: bool = False
    containers: bool = False
    unless: str = ""
    requires: str = ""


# What each rule finds is part of the results.
RULES = (
    Rule("tls-verification-disabled", "medium", ("verify", "cert_none", "unauthorized", "insecureskipverify", "danger_accept", "certificatecustomvalidation", "verify_none"), r"""verify\s*=\s*False\b|ssl\._create_unverified_context|\bCERT_NONE\b|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED["']?\s*[=:]\s*["']?0|InsecureSkipVerify\s*:\s*true|danger_accept_invalid_(?:certs|hostnames)\s*\(\s*true|ServerCertificateCustomValidationCallback\s*=|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)\b|VERIFY_NONE\b""", SCRIPTS),
    Rule("curl-insecure", "low", ("curl",), r"\bcurl\b[^|;&\n]*\s(?:--insecure\b|-[A-Za-z]*k[A-Za-z]*\b)", SHELLS, workflows=True, containers=True),
    Rule("curl-pipe-shell", "medium", ("curl", "wget"), r"\b(?:curl|wget)\b[^|\n]*\|\s*(?:sudo\s+)?(?:ba|z|da|k)?sh\b", SHELLS, workflows=True, containers=True),
    Rule("chmod-777", "medium", ("777", "rwx"), r"\bchmod\s+(?:-R\s+)?(?:0?777|[augo]*\+rwx)\b|os\.chmod\([^)]*0o?777", SCRIPTS, workflows=True, containers=True),
    Rule("yaml-unsafe-load", "medium", ("yaml.",), r"\byaml\.(?:unsafe_load|load|load_all)\s*\(", ("python",), unless=r"Safe|BaseLoader"),
    Rule("pickle-deserialization", "low", ("pickle", "dill", "joblib"), r"\b(?:c?[Pp]ickle|dill|joblib)\.loads?\s*\(", ("python",)),
    Rule("shell-command-string", "low", ("shell", "os.system", "os.popen"), r"subprocess\.\w+\([^)]*shell\s*=\s*True|\bos\.(?:system|popen)\s*\(", ("python",)),
    Rule("eval-usage", "low", ("eval",), r"(?:^|[^.\w])eval\s*\(", ("javascript", "typescript", "python", "php", "ruby")),
    Rule("dangerous-html", "low", ("innerhtml", "v-html", "document.write"), r"dangerouslySetInnerHTML|\.(?:inner|outer)HTML\s*=[^=]|\bv-html\b|document\.write\s*\(", WEB),
    Rule("debug-enabled", "medium", ("debug",), r"^\s*DEBUG\s*=\s*True\b|\.run\([^)]*debug\s*=\s*True", ("python",)),
    Rule("cors-wildcard", "low", ("origin", "cors"), r"""Access-Control-Allow-Origin["']?\s*[:,]\s*["']\*|\borigin\s*:\s*["']\*["']|CORS_ORIGIN_ALLOW_ALL\s*=\s*True|allow_origins\s*=\s*\[\s*["']\*["']""", SCRIPTS),
    Rule("workflow-pull-request-target", "low", ("pull_request_target",), r"\bpull_request_target\b", workflows=True),
    Rule("workflow-untrusted-checkout", "high", ("pull_request", "refs/pull"), r"github\.event\.pull_request\.head\.(?:sha|ref)|refs/pull/", workflows=True, requires="pull_request_target"),
    Rule("workflow-write-all", "low", ("write-all",), r"^\s*permissions:\s*write-all\b", workflows=True),
    Rule("privileged-container", "medium", ("privileged",), r"^\s*privileged:\s*true\b|--privileged\b", ("shell",), containers=True),
    Rule("docker-socket-mount", "medium", ("docker.sock",), r"/var/run/docker\.sock", workflows=True, containers=True),
)

# Pieces of patterns; a line with two of them defines a pattern and is not scanned, nor is one of more bytes than this.
SYNTAX = (r"\s*", r"\s+", r"\b", "(?:", r"\(", r"\d", r"\w", r"\.")
LONGEST = 4096


def defines_pattern(line: Column) -> Column:
    n = F.lit(0)
    for s in SYNTAX:
        n = n + line.contains(s).cast("int")
    return n >= 2


def is_workflow(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)\.github/workflows/.*\.ya?ml$")


def is_container_file(path: Column, language: Column) -> Column:
    """Files of container builds, and YAML by its name or folder."""
    name = F.lower(file_name(path))
    of_yaml = name.rlike(r"^(docker-compose|compose\.)") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, CONTAINER_FOLDERS)))
    return (language == "dockerfile") | name.rlike(r"^dockerfile|\.dockerfile$") | ((language == "yaml") & of_yaml)


def lower_confidence(c: Column) -> Column:
    return F.when(c == "high", "medium").otherwise("low")


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, cap: int | None = None) -> DataFrame:
    """(path, line, rule, confidence, excerpt) of files(path, text, language): rules by line.

    All rules are one expression a line, so that lines are read once and nothing is joined. Where a
    rule applies is decided once a file. Tests and samples lower the confidence by a step. A cap keeps
    the first so many of a file and rule, and their `omitted` says how many there are beyond it. A null
    text has no lines; a null language is none.
    """
    path, language = F.col("path"), F.coalesce("language", F.lit(""))
    applies = F.array_compact(F.array(*(F.when(_applies(r, path, language), r.id) for r in rules)))
    lines = files.select("path", applies.alias("rules"), F.posexplode(F.split("text", "\n")).alias("n", "line")).filter((F.size("rules") > 0) & (F.octet_length("line") <= LONGEST))
    low = F.lower("line")
    hits = []
    for r in rules:
        word = F.lit(False)
        for k in r.keywords:
            word |= low.contains(k)
        test = word & F.array_contains("rules", r.id) & F.col("line").rlike(r.pattern)
        if r.unless:
            test &= ~F.col("line").rlike(r.unless)
        hits.append(F.when(test, F.struct(F.lit(r.id).alias("rule"), F.lit(r.confidence).alias("confidence"))))
    found = lines.filter(~defines_pattern(F.col("line"))).withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    sure = F.when(is_sample_path(path), lower_confidence(F.col("hit.confidence"))).otherwise(F.col("hit.confidence"))
    found = found.select("path", (F.col("n") + 1).alias("line"), "hit.rule", sure.alias("confidence"), F.substring(F.trim("line"), 1, 120).alias("excerpt"))
    if cap is None:
        return found
    each = Window.partitionBy("path", "rule")
    ranked = found.withColumns({"k": F.row_number().over(each.orderBy("line")), "omitted": F.greatest(F.count("*").over(each) - cap, F.lit(0))})
    return ranked.filter(F.col("k") <= cap).drop("k")


def _applies(rule: Rule, path: Column, language: Column) -> Column:
    where = language.isin(*rule.languages) if rule.languages else F.lit(False)
    if rule.workflows:
        where |= is_workflow(path)
    if rule.containers:
        where |= is_container_file(path, language)
    return where & F.col("text").contains(rule.requires) if rule.requires else where


#: Markers at the start of a comment.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG", "DEPRECATED")


def markers(files: DataFrame, most: int = 120) -> DataFrame:
    """(path, line, kind, text) of markers that start a comment: upper case, or lower case after an at sign."""
    kinds = "|".join(MARKERS)
    pattern = rf"(?:^|\s)(?:#|//|/\*|\*|--|;|%|<!--)\s*(?:({kinds})\b|@((?i:{kinds}))\b)[:\s(]*(.*)$"
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.col("line").rlike(pattern))
    one, two = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    return lines.select("path", (F.col("n") + 1).alias("line"), F.upper(F.when(one != "", one).otherwise(two)).alias("kind"), F.substring(F.trim(F.regexp_extract("line", pattern, 3)), 1, most).alias("text"))


def readme(text: Column) -> Column:
    """(words, headings, code_blocks, links, images, installation, usage) of a Markdown text."""
    prose = F.regexp_replace(text, r"(?s)```.*?(```|\z)", "\n")
    heads = F.transform(F.regexp_extract_all(prose, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*#*$"), F.lit(1)), F.lower)
    has = lambda *w: F.exists(heads, lambda h: h.rlike("|".join(w)))
    return F.struct(
        F.regexp_count(prose, F.lit(r"\S+")).alias("words"), F.size(heads).alias("headings"), F.floor(F.regexp_count(text, F.lit(r"(?m)^\s*```")) / 2).alias("code_blocks"),
        F.regexp_count(prose, F.lit(r"(?<!!)\[[^\]]*\]\([^)]*\)")).alias("links"), F.regexp_count(prose, F.lit(r"!\[[^\]]*\]\([^)]*\)")).alias("images"),
        has("install", "setup", "getting started").alias("installation"), has("usage", "example", "quick ?start").alias("usage"),
    )


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(hash, copies, first) of contents that occur more than once."""
    return files.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first")).filter("copies > 1")


# --- similar texts ---------------------------------------------------------

SLOTS, BAND = 64, 4
#: 64-bit words of an odd sketch.
SKETCH = 16


def token_hashes(text: str) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(w.encode()) for w in text.split()), np.uint64)


def shingles(tokens: np.ndarray, width: int = 5) -> np.ndarray | None:
    """The different hashes of the shingles of a token sequence; none if it is shorter than one."""
    return None if len(tokens) < width else np.unique(rolling(tokens, width))


@lru_cache
def coefficients(n: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n hash functions x -> a x + b modulo 2 to the 64."""
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64, endpoint=False)
    return a | np.uint64(1), b


def minhash(h: np.ndarray) -> np.ndarray:
    """The least value of a shingle set under each of SLOTS multiply-add hashes."""
    a, b = coefficients()
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1 << 12):
            each = np.multiply.outer(a, h[at : at + (1 << 12)])
            each += b[:, None]
            out = np.minimum(out, each.min(1))
    return out


def tokens_of(value: pa.Scalar) -> np.ndarray:
    """Tokens of an int array as unsigned numbers; a null array has none."""
    return value.values.to_numpy().view(np.uint32).astype(np.uint64) if value.is_valid else np.empty(0, np.uint64)


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """For each of 64 SKETCH bits, whether an odd number of a set's hashes falls on it, as 64-bit words.

    Two sketches differ in no more bits than their sets differ in members, so that they rule out pairs
    without ever losing one that is similar.
    """
    with np.errstate(over="ignore"):
        bits = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * SKETCH - 1).bit_length())
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signatures(files: DataFrame, least: int = 50) -> DataFrame:
    """(path, language, tokens, signature, c1, c2, n, o0 to o15) of files(path, language, tokens) with at least so many tokens.

    c1 and c2 are 128 bits of the shingle set's hash, n is its size, the others are its odd sketch.
    """
    odd = [f"o{k}" for k in range(SKETCH)]
    names = ["path", "language", "tokens", "signature", "c1", "c2", "n", *odd]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            found = [(k, shingles(t)) for k, x in enumerate(batch.column(2)) if len(t := tokens_of(x)) >= least]
            at, sets = pa.array([k for k, _ in found], pa.int64()), [h for _, h in found]
            marks = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SLOTS, np.concatenate([minhash(h).view(np.int64) for h in sets]) if sets else np.empty(0, np.int64))
            same = np.frombuffer(b"".join(hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets), np.int64).reshape(-1, 2)
            bits = np.array([odd_sketch(h) for h in sets], np.int64).reshape(-1, SKETCH)
            numbers = [*same.T, np.array([len(h) for h in sets], np.int64), *bits.T]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), marks, *(pa.array(np.ascontiguousarray(c)) for c in numbers)], names)

    longs = ", ".join(f"{c} long" for c in names[4:])
    return files.select(F.col("path").cast("string"), F.col("language").cast("string"), "tokens").mapInArrow(run, f"path string, language string, tokens array<int>, signature array<long>, {longs}")


def plausible(x: str, y: str, least: float) -> Column:
    """Whether sizes and sketches of x and y (prefixes of columns) leave it open that the similarity is least or more."""
    bits = reduce(Column.__add__, (F.bit_count(F.col(f"{x}o{k}").bitwiseXOR(F.col(f"{y}o{k}"))) for k in range(SKETCH)))
    sized = F.least(x + "n", y + "n") >= least * F.greatest(x + "n", y + "n") - 1e-6
    return sized & (bits <= (1 - least) / (1 + least) * (F.col(x + "n") + F.col(y + "n")) + 1e-6)


def unlinked(left: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of left(key, path, root) in one bucket with different roots that sizes and sketches, in marks, do not rule out.

    A bucket is dealt into tiles of about TILE texts, and each pair of tiles is a key of its own, so that
    no task has a whole large bucket; only what the sketches leave is emitted.
    """
    tiles = left.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = left.join(tiles, "key").withColumn("sub", F.pmod(F.xxhash64("path"), F.col("tiles")).cast("int")).join(marks, "path")
    x, y = (dealt.withColumn("other", F.explode(F.expr(e))).select(*(F.col(c).alias(p + c) for c in [*dealt.columns, "other"])) for p, e in (("x_", "sequence(sub, tiles - 1)"), ("y_", "sequence(0, sub)")))
    once = (F.col("x_sub") != F.col("y_sub")) | (F.col("x_path") < F.col("y_path"))
    met = (F.col("x_key") == F.col("y_key")) & (F.col("x_sub") == F.col("y_other")) & (F.col("x_other") == F.col("y_sub"))
    return x.join(y, met & (F.col("x_root") != F.col("y_root")) & once & plausible("x_", "y_", least)).select(F.col("x_path").alias("a"), F.col("y_path").alias("b"))


def exact(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, leader, similarity) of pairs(path, leader): the Jaccard similarity of the shingle sets of their files(path, tokens)."""
    both = pairs.join(files.withColumnRenamed("tokens", "x"), "path").join(files.withColumnsRenamed({"path": "leader", "tokens": "y"}), "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, b = None, None
        for batch in batches:
            out = np.empty(batch.num_rows, np.float64)
            for k, leader in enumerate(batch.column(1).to_pylist()):
                if leader != name:
                    name, b = leader, shingles(tokens_of(batch.column(3)[k]))
                a = shingles(tokens_of(batch.column(2)[k]))
                common = len(np.intersect1d(a, b, assume_unique=True))
                out[k] = common / (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["path", "leader", "similarity"])

    return both.select("path", "leader", "x", "y").mapInArrow(run, "path string, leader string, similarity double")


#: Texts of a bucket that meet as many others in one task.
TILE = 1024


def similar(files: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(path, leader, similarity, first): links of texts, each later path with an earlier one, and the first path of their class.

    16 bands of 4 MinHash slots select candidates of one language; the similarity is the exact one of
    their shingle sets. Texts that links join are a class; the links found span each class, so that a
    group of copies makes about as many as it has members. Texts of equal shingle sets are linked with
    the first of them, which alone goes on. Each text is compared with the first of its buckets; in
    buckets that still hold several classes, texts of different classes meet, tile by tile. Sizes and
    odd sketches rule out most pairs, none of them similar, before texts are joined to them and
    compared, so that no text of a bucket is kept apart from a class that it is similar to. files has
    path, language and text, or tokens as code.analyze names them in place of text.
    """
    if "tokens" not in files.columns:
        files = hashed(files, "language")
    every = stored(signatures(files.select("path", "language", "tokens").filter("path is not null")), "signatures")
    same = [F.xxhash64("language", "c1").alias("c1"), F.xxhash64(F.lit(1), "language", "c2").alias("c2")]
    groups = every.select("path", *same).groupBy("c1", "c2").agg(F.min("path").alias("leader"), F.max("path").alias("last")).filter("leader != last").drop("last")
    copies = stored(every.select("path", *same).join(groups, ["c1", "c2"]).filter("path != leader").distinct(), "copies")
    keys = F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda b: F.xxhash64("language", b, F.slice("signature", b * BAND + 1, BAND)))
    each = stored(every.select("path", "language", "signature", *same).join(copies, ["path", "c1", "c2"], "left_anti").select("path", F.explode(keys).alias("key")), "bands")
    shared = each.groupBy("key").agg(F.min("path").alias("leader"), F.max("path").alias("last")).filter("leader != last").drop("last")
    state = stored(each.join(shared, "key"), "buckets")
    near = stored(every.drop("language", "signature", "c1", "c2").join(state.select("path").distinct(), "path", "left_semi"), "texts")
    marks, texts = near.drop("tokens"), near.select("path", "tokens")

    def links_of(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.greatest("a", "b").alias("path"), F.least("a", "b").alias("leader")).distinct()
        return stored(exact(ordered, texts).filter(F.col("similarity") >= threshold).distinct(), "links")

    def classes(links: DataFrame) -> DataFrame:
        return stored(linked(links.select(F.col("path").alias("a"), F.col("leader").alias("b"))), "classes")

    x, y = (marks.select(*(F.col(c).alias(p + c) for c in marks.columns)) for p in ("x_", "y_"))
    first = state.filter("path != leader").select(F.col("path").alias("x_path"), F.col("leader").alias("y_path")).distinct()
    links = links_of(first.join(x, "x_path").join(y, "y_path").filter(plausible("x_", "y_", threshold)).select(F.col("x_path").alias("a"), F.col("y_path").alias("b")))
    roots = classes(links)
    # the first text of a bucket has met all others
    named = state.filter("path != leader").join(roots.withColumnRenamed("node", "path"), "path", "left").select("key", "path", F.coalesce("root", "path").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    left = stored(named.join(apart, "key"), "apart")
    more = links_of(unlinked(left, marks, threshold))
    if not more.isEmpty():
        links, roots = links.union(more), classes(links.union(more))
    # of copies, only the first has a root
    found = links.join(roots, links.path == roots.node).select("path", "leader", "similarity", F.col("root").alias("first"))
    return found.union(copies.join(roots, copies.leader == roots.node, "left").select("path", "leader", F.lit(1.0), F.coalesce("root", "leader")))


# --- repeated fragments ----------------------------------------------------


def rolling(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k tokens."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    h = np.zeros(len(tokens) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + tokens[j : len(h) + j]
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash in each full window, of equal ones the last; a place counts once."""
    if not len(h):
        return np.empty(0, np.int64)
    window = max(1, min(window, len(h)))
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprints(files: DataFrame, k: int = 25, window: int = 16) -> DataFrame:
    """(path, hash, at) of the winnowed fingerprints of each text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rolling(token_hashes(t.as_py() or ""), k) for t in batch.column(1)]
            at = [winnow(h, window) for h in found]
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
            marks = np.concatenate([h[x] for h, x in zip(found, at, strict=True)]) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(marks.view(np.int64)), pa.array(np.concatenate(at) if at else np.empty(0, np.int64))], ["path", "hash", "at"])

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "path string, hash long, at long")


def duplicated(files: DataFrame, k: int = 25, distinct: int = 12) -> DataFrame:
    """(path, start, end): the places of all maximal repeats of k tokens or more, in any number of places.

    files has path and text, or tokens in place of text. Runs of few different tokens are data and left out.
    """
    return repeats(files if "tokens" in files.columns else hashed(files), k, distinct).select("path", "start", "end").distinct()


def hashed(files: DataFrame, *carry: str) -> DataFrame:
    """(path, carried columns, tokens) of files(path, text): a 32-bit hash of each token, taken once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [token_hashes(t.as_py() or "").astype(np.uint32).view(np.int32) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            tokens = pa.LargeListArray.from_arrays(ends, values).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], tokens], ["path", *carry, "tokens"])

    more = "".join(f"{c} string, " for c in carry)
    return files.select(F.col("path").cast("string"), F.col("text").cast("string"), *(F.col(c).cast("string") for c in carry)).mapInArrow(run, f"path string, {more}tokens array<int>")


#: Items with no more shingles than this are sent to all tasks; more are met by a shuffle.
SENT = 1_000_000


def overlap(a: DataFrame, b: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(id, item, share): texts a(id, text) that hold such a share of the different word shingles of an item of b(item, text).

    Shingles of b are joined on; counts by (id, item) follow from an equi-join on the shingle's hash. Few
    items, by a count of their shingles, meet the texts where they are read, so that only hits are
    shuffled. A text with fewer words than a shingle is one shingle; null and empty texts hold nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(df: DataFrame, key: str) -> DataFrame:
        w = df.select(key, words("text").alias("w")).filter(F.size("w") > 0)
        each = w.select(key, "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("i"))
        return each.select(key, F.xxhash64(F.slice("w", F.col("i"), F.lit(width))).alias("h"))

    item = stored(hashes(b, "item").distinct(), "items")
    size = item.groupBy("item").agg(F.count("*").alias("n"))
    met = hashes(a, "id").join(F.broadcast(item) if item.count() <= SENT else item, "h")
    return met.distinct().groupBy("id", "item").agg(F.count("*").alias("hit")).join(size, "item").select("id", "item", round4(F.col("hit") / F.col("n")).alias("share")).filter(F.col("share") >= least)
