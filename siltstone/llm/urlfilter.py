"""URL filtering against a memory-mapped sorted digest array."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import new_path, put_file

MAGIC = b"SILTURL1"
ALLOW, BLOCK = "allow", "block"


def digest(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """A digest array of (rule, verdict): header, sorted 64-bit xxhash keys, string offsets, verdicts, whole strings.

    A rule is its host and the start of the path, like `org/` or `example.org/en/1`. Of several
    verdicts for one rule, block holds.
    """
    of: dict[bytes, int] = {}
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        key = f"{host.lower()}/{path}".encode()
        of[key] = max(of.get(key, 0), int(verdict == BLOCK))
    keys = sorted(of, key=lambda k: (digest(k), k))
    text = b"".join(keys)
    heads = sorted({len(k) - k.index(b"/") for k in keys})
    stops = np.cumsum([0, *map(len, keys)], dtype=np.int64)
    return b"".join(
        (
            MAGIC, struct.pack("<qq", len(keys), len(heads)), np.array(heads, "<i8").tobytes(),
            np.array([digest(k) for k in keys], "<u8").tobytes(), stops.astype("<i8").tobytes(), bytes(of[k] for k in keys), text,
        )
    )


class DigestArray:
    """Reads what build() made, from bytes or a memory-mapped file."""

    def __init__(self, data):
        assert data[:8] == MAGIC, "not a digest array"
        n, m = struct.unpack("<qq", data[8:24])
        self.heads = np.frombuffer(data, "<i8", m, 24).tolist()
        at = 24 + 8 * m
        self.keys = np.frombuffer(data, "<u8", n, at)
        self.stops = np.frombuffer(data, "<i8", n + 1, at + 8 * n)
        self.verdicts = np.frombuffer(data, "u1", n, at + 8 * n + 8 * (n + 1))
        self.data, self.text = data, at + 17 * n + 8

    @classmethod
    def opened(cls, path: str) -> DigestArray:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, keys: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The place of each key, or -1: binary search for its digest, then comparison with the stored strings."""
        if digests is None:
            digests = np.fromiter(map(digest, keys), np.uint64, len(keys))
        place = np.searchsorted(self.keys, digests)
        out = np.full(len(keys), -1, np.int64)
        for k in np.flatnonzero((place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == digests)) if len(self.keys) else []:
            at = place[k]
            while at < len(self.keys) and self.keys[at] == digests[k]:  # strings with one digest stand side by side
                if self.data[self.text + self.stops[at] : self.text + self.stops[at + 1]] == keys[k]:
                    out[k] = at
                    break
                at += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits each URL (of equal ones that with the longest host), or null, and the verdict: allow without a rule."""
        rows, keys = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if path.startswith("/"):
                raw, tail = host.encode("utf-8", "replace"), path.encode("utf-8", "replace")
                labels = [raw, *(raw[i + 1 :] for i in range(len(raw)) if raw[i : i + 1] == b".")]
                for n in self.heads:
                    if n <= len(tail):
                        for x in labels:
                            rows.append(k)
                            keys.append(x + tail[:n])
        rule: list[str | None] = [None] * len(hosts)
        verdict, length = [ALLOW] * len(hosts), [(-1, -1)] * len(hosts)
        at = self.find(keys)
        for j in np.flatnonzero(at >= 0):
            k, size = rows[j], (len(keys[j]), keys[j].index(b"/"))
            if size > length[k]:
                length[k], rule[k] = size, keys[j].decode()
                verdict[k] = BLOCK if self.verdicts[at[j]] else ALLOW
        return rule, verdict


def shipped(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Writes a digest array to the shared folder and has every executor fetch it; returns its file's name there."""
    path = new_path(spark, "digests") + ".bin"
    put_file(spark, path, build(rules))
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url).

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest wins, and
    without one the verdict is allow. The array is a file that each executor memory-maps once for all
    its workers. A null url, or one without `://`, has an empty host and path and no rule; repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    name = shipped(pages.sparkSession, rules)
    url = F.col("url").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.opened(SparkFiles.get(name))
        for batch in batches:
            rule, verdict = array.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string"
    )


RULES = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)

SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(h, p, v))
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""
