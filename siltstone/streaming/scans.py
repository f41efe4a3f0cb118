"""Scans that go on: a stream of versions of files, of which only what changed is analysed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.session import ship
from siltstone.sources import code, lexing
from siltstone.sources.languages import LANGUAGES

#: A change of the analysis or of a language's definition makes all files new.
VERSION = "1"
FACTS = "code long, comment long, blank long, functions long, complexity long, tokens long"
STATE = f"seq long, key string, deleted boolean, analysed long, {FACTS}"
CHANGES = f"path string, seq long, action string, analysed long, {FACTS}"
NEEDED = frozenset(("functions", "symbols", "outside", "tokens"))
_FACTS = [x.split()[0] for x in FACTS.split(", ")]


#: Files share the state's keys by a hash of their paths, so that texts of a key are read together; another number makes all files new.
BUCKETS = 1024


@lru_cache(None)
def head(language: str | None) -> bytes:
    return f"{VERSION}\n{LANGUAGES.get(language or '')!r}\n".encode()


def content_key(raw: bytes, language: str | None) -> str:
    """What an analysis stands for: the text, the definition of its language and the version of the analysis."""
    return hashlib.sha256(head(language) + raw).hexdigest()


def analysed(texts: list[bytes], language: str | None) -> Iterator[tuple[int, ...]]:
    """The facts of texts of one language, read together up to about so many bytes as code.analyze reads."""
    held, size = [], 0
    for k, text in enumerate(texts, 1):
        held.append(text)
        size += len(text)
        if size >= code.TOGETHER or k == len(texts):
            for raw, found in zip(held, lexing.read(held, LANGUAGES.get(language or "")), strict=True):
                lines, comment, blank, functions, _, _, _, symbols, outside, _, tokens, *_ = code.facts(language or "", raw, found, NEEDED)
                yield lines, comment, blank, len(functions), outside + sum(s["complexity"] or 0 for s in symbols), len(tokens)
            held, size = [], 0


class FileScan(StatefulProcessor):
    """The state of each path of a bucket: its newest version, what its content stands for, and the facts of it.

    A version that is older than the newest is late and changes nothing; one with known content is touched and
    keeps its facts; a deletion stays in mind, so that what is older than it stays late. What becomes of
    versions follows from what contents stand for, so that all that is new is analysed together after that.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        none = lambda x: None if x is None or x is pd.NA or x != x else x
        of: dict[str, list[tuple]] = {}
        for frame in rows:
            for path, *version in zip(*(frame[c].tolist() for c in ("path", "seq", "deleted", "language", "text")), strict=True):
                of.setdefault(path, []).append(version)
        nothing: tuple = (None,) * len(_FACTS)
        out: list[tuple] = []  # (path, seq, action, analysed, facts or the number of new ones)
        new: list[tuple] = []  # facts that are to be found
        asked: dict[str | None, list[tuple[int, bytes]]] = {}
        changed: dict[str, tuple] = {}  # (seq, key, deleted, analysed, facts or the number of new ones)
        for path, versions in of.items():
            was = self.files.getValue((path,))
            known = before = None if was is None else (*was[:4], tuple(was[4:]))
            for seq, deleted, language, text in sorted(versions, key=lambda r: (r[0], bool(r[1]))):
                if known is not None and seq <= known[0]:
                    out.append((path, seq, "late", known[3], nothing))
                elif deleted:
                    known = (int(seq), None, True, known[3] if known else 0, (0,) * len(_FACTS))
                    out.append((path, seq, "deleted", known[3], nothing))
                else:
                    language, raw = none(language), (none(text) or "").encode("utf-8", "surrogatepass")
                    mark = content_key(raw, language)
                    if known is not None and not known[2] and known[1] == mark:
                        known = (int(seq), *known[1:])
                        out.append((path, seq, "touched", *known[3:]))
                    else:
                        action = "added" if known is None or known[2] else "changed"
                        asked.setdefault(language, []).append((len(new), raw))
                        known = (int(seq), mark, False, (known[3] if known else 0) + 1, len(new))
                        new.append(nothing)
                        out.append((path, seq, action, *known[3:]))
            if known is not None and known is not before:
                changed[path] = known
        for language, texts in asked.items():
            for (k, _), found in zip(texts, analysed([raw for _, raw in texts], language), strict=True):
                new[k] = found
        facts = lambda x: new[x] if isinstance(x, int) else x
        for path, (*known, found) in changed.items():
            self.files.updateValue((path,), (*known, *facts(found)))
        columns = zip(*((*row, *facts(found)) for *row, found in out), strict=True)
        names = [x.split() for x in CHANGES.split(", ")]
        yield pd.DataFrame({c: pd.array(v, "Int64") if kind == "long" else list(v) for (c, kind), v in zip(names, columns, strict=True)})

    def close(self) -> None:
        pass


def changes(versions: DataFrame) -> DataFrame:
    """(path, seq, action, analysed, facts): what each of a stream of versions(path, language, text, seq, deleted) does.

    action is added, changed, touched, deleted or late; analysed counts the analyses of a path. Of versions with
    one seq that come together the first counts. Rows without a path or seq are left out.
    """
    spark = versions.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = versions.select("path", "language", F.col("text").cast("string").alias("text"), F.col("seq").cast("long").alias("seq"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    rows = rows.filter("path is not null and seq is not null")
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(FileScan(), outputStructType=CHANGES, outputMode="append", timeMode="none")


def scan(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """Reads what has come to source since the last call and writes its changes to out, a folder for each batch.

    A batch that is repeated after a failure replaces its folder.
    """
    versions = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = changes(versions).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(path, seq, analysed, facts) of the files that are there now."""
    rows = spark.read.schema(f"{CHANGES}, batch int").parquet(out).filter("action != 'late'")
    last = rows.groupBy("path").agg(F.max(F.struct("seq", "batch", "action", "analysed", *_FACTS)).alias("m"))
    return last.filter("m.action != 'deleted'").select("path", "m.seq", "m.analysed", *(f"m.{c}" for c in _FACTS))
