"""Where results go: CSV, SARIF, JSON artifacts, an index of scans, bundles, caches."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import csv_field
from siltstone.operators.diffs import upserted
from siltstone.operators.findings import sarif_result, severity_rank


def csv_safe(df: DataFrame) -> DataFrame:
    """Texts that no spreadsheet runs, arrays joined with semicolons; the writer quotes."""
    guard = lambda c: F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        out[f.name] = F.array_join(F.col(f.name), ";") if kind.startswith("array<string") else F.to_json(F.col(f.name)) if kind.startswith(("array", "struct", "map")) else guard(F.col(f.name)) if kind == "string" else F.col(f.name)
    return df.withColumns(out)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    csv_safe(df).write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").option("escape", '"').csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of a CSV file, without a header."""
    return csv_safe(df).select(F.concat_ws(",", *(F.coalesce(csv_field(F.col(c).cast("string")), F.lit("")) for c in df.columns)).alias("line"))


def write_artifact(df: DataFrame, path: str) -> None:
    """JSON that appears as a whole or not at all: written beside its place, then put there by renaming.

    What stood there before is moved aside first and deleted last, so that a writer that is lost on the way
    leaves the old one or the new one, complete.
    """
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df.write.json(aside + ".new")
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(Path(path)) and not fs.rename(Path(path), Path(aside + ".old")):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(Path(aside + ".new"), Path(path)):
        raise OSError(f"{path} could not be put in its place")
    fs.delete(Path(aside + ".old"), True)


def sarif(findings: DataFrame, tool: str, version: str, most: int = 25_000) -> DataFrame:
    """(json) of one SARIF 2.1.0 document: the rules that fired and the first `most` findings by severity, rule, path and id.

    A document is one value, and readers of the format take no more results than about that; how many
    are left out is among the run's properties.
    """
    shown = findings.filter("suppressed_by is null") if "suppressed_by" in findings.columns else findings
    rank = severity_rank(F.col("severity"))
    top = shown.orderBy(F.desc(rank), "rule", "path", "id").limit(most).select("rule", (-rank).alias("k"), "path", "id", sarif_result().alias("r"))
    results = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rule", "path", "id", "r"))), lambda x: x["r"]).alias("results"), F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id"))).alias("rules"))
    total = shown.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results").alias("results"), F.struct("omitted").alias("properties"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return results.crossJoin(total).select(F.to_json(document).alias("json"))


def json_report(tables: dict[str, DataFrame], most: int = 1_000, order: dict[str, list[Column | str]] | None = None) -> DataFrame:
    """(json) of one document with the first `most` rows of each table and how many there are in all.

    Rows come in the order that is given for their table, then in that of their texts, so that reruns agree.
    """
    out = None
    for name, df in tables.items():
        by = [*(order or {}).get(name, []), F.to_json(F.struct(*df.columns))]
        top = df.orderBy(*by).limit(most).select(F.row_number().over(Window.orderBy(*by)).alias("k"), F.struct(*df.columns).alias("row"))
        rows = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("rows"))
        one = rows.crossJoin(df.agg(F.count("*").alias("total"))).select(F.struct("total", "rows").alias(name))
        out = one if out is None else out.crossJoin(one)
    if out is None:
        raise ValueError("a report needs a table")
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def bundle(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> list[str]:
    """One folder a table; an existing one is an error unless it may be replaced."""
    for name, df in tables.items():
        write_csv(df, f"{path.rstrip('/')}/{name}", overwrite)
    return [f"{path.rstrip('/')}/{name}" for name in tables]


#: The index: tables with their keys, in the order in which they refer to each other.
INDEX = {
    "repositories": ("repository string, location string, name string, ts timestamp", ["repository"]),
    "scans": ("scan string, repository string, ts timestamp, profile string, artifact string", ["scan"]),
    "metrics": ("scan string, metric string, value double", ["scan", "metric"]),
    "findings": ("scan string, id string, rule string, severity string, suppressed boolean", ["scan", "id"]),
}
VERSION = 2


class Store:
    """An index of scans as Parquet tables: each write adds a folder of its own, and the newest row of a key counts.

    A folder's name has the time and a number that no other writer has, so that writers do not meet, and
    a reader takes whole folders alone. rebuild() puts a whole table down, and what is older is not read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, name: str) -> list[str]:
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(str(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(Path(s.getPath(), "_SUCCESS"))) if fs.exists(at) else []
        whole = [k for k, f in enumerate(found) if f.endswith("-all")]
        return [f"{self.root}/{name}/{f}" for f in (found[whole[-1] :] if whole else found)]

    def _write(self, name: str, rows: DataFrame, kind: str) -> None:
        now = time.time_ns()
        rows.select(*(f.split()[0] for f in INDEX[name][0].split(", ")), F.lit(now).alias("written")).write.parquet(f"{self.root}/{name}/{now:020d}-{uuid.uuid4().hex}-{kind}")

    def read(self, name: str) -> DataFrame:
        schema, keys = INDEX[name]
        found = self._folders(name)
        if not found:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", written long").parquet(*found)
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("written")))
        return rows.withColumn("n", newest).filter("n = 1").drop("n", "written")

    def record(self, name: str, rows: DataFrame) -> None:
        """Rows replace those with their keys; a reader sees them all or none."""
        self._write(name, rows, "new")

    def rebuild(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self._write(name, rows, "all")


def artifact_schema(df: DataFrame) -> str:
    """The JSON Schema of a table's rows."""

    def of(kind: dict | str) -> dict:
        if isinstance(kind, str):
            plain = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "long": "integer", "integer": "integer", "short": "integer", "byte": "integer"}
            return {"type": plain[kind]} if kind in plain else {"type": "string", "format": "date-time" if kind.startswith("timestamp") else "date"} if kind in ("date", "timestamp", "timestamp_ntz") else {"type": "number"}
        if kind["type"] == "array":
            return {"type": "array", "items": of(kind["elementType"])}
        if kind["type"] == "map":
            return {"type": "object", "additionalProperties": of(kind["valueType"])}
        return {"type": "object", "properties": {f["name"]: of(f["type"]) for f in kind["fields"]}, "required": [f["name"] for f in kind["fields"] if not f["nullable"]]}

    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", **of(json.loads(df.schema.json()))}, sort_keys=True)


def import_scan(store: Store, scan: DataFrame, tables: dict[str, DataFrame]) -> bool:
    """Records a scan that was made elsewhere, with its tables; False, and nothing written, if its id is known already.

    The scan's own row is written last, so that a scan that the index names is whole.
    """
    if not store.read("scans").join(scan.select("scan"), "scan", "left_semi").isEmpty():
        return False
    for name, rows in tables.items():
        store.record(name, rows)
    store.record("scans", scan)
    return True


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """A table in a newer schema: new columns are null, order and types follow it."""
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema)))


def cache_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(key, ...) with what the cache holds for it; rows without an entry are left out."""
    return wanted.join(cache, "key")


def cache_updated(cache: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The cache with new entries found(key, value, bytes) in the place of those with their keys, used now."""
    return upserted(cache, found.withColumn("used", now).select(*cache.columns), ["key"])


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What is not analysed yet, by content key."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def views(tables: dict[str, DataFrame]) -> Iterable[str]:
    """Registers tables as views for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)
