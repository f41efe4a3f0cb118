"""Queries that write what they make from the tables and read it back: files, archives, artifacts, an index, exports, caches, dumps."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import facts
from siltstone.functions.tables import dealt, part_count, spread, stored
from siltstone.operators import diffs, textmine
from siltstone.plans.catalogue import query
from siltstone.plans.sources import filled
from siltstone.session import new_path, table
from siltstone.sources import code, files, gitlog, manifests, sinks


@query("SELECT 'k=' || s_nationkey || '/v=' || s_suppkey % 2 AS folder, CAST(sum(octet_length(encode(s_name)) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM supplier WHERE s_nationkey <> 3 OR s_suppkey % 2 = 1 GROUP BY 1")
def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that were written below a folder, without those that settings ignore; a later pattern takes some back."""
    at = new_path(spark, "tree")
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("value"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 2).alias("v"))
    rows.write.partitionBy("k", "v").text(at)
    found = files.discover(spark, at, ("k=3/**", "!k=3/v=1/*")).filter("path like 'k=%'")
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    return found.groupBy(F.regexp_extract("path", "(.*)/", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN unhex('EFBBBF') || encode(text) WHEN doc_id % 7 = 0 THEN encode(text) || unhex('00') ELSE encode(text) END AS b, text FROM documents)
SELECT doc_id, CASE WHEN b IS NULL THEN 'unreadable' WHEN octet_length(b) > 3000 THEN 'too-large' WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'binary' ELSE 'content' END AS outcome, sha256(b) AS sha256,
  CASE WHEN octet_length(b) <= 3000 AND NOT (doc_id % 5 <> 0 AND doc_id % 7 = 0) THEN md5(text) END AS text FROM d""")
def file_contents(spark: SparkSession, sf: str) -> DataFrame:
    """What reading a file gives: its text without a byte order mark, or why there is none."""
    k, raw = F.col("doc_id"), F.col("text").cast("binary")
    data = F.when(k % 11 == 0, None).when(k % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k % 7 == 0, F.concat(raw, F.unhex(F.lit("00")))).otherwise(raw)
    found = table(spark, sf, "documents").select("doc_id", files.content(data, 3000).alias("c"))
    return found.select("doc_id", "c.outcome", "c.sha256", F.md5(F.col("c.text").cast("binary")).alias("text"))


@query("""SELECT 'a' || doc_id // 20 AS archive, CASE WHEN doc_id // 20 % 3 = 2 AND doc_id % 2 = 0 THEN 'other' || doc_id % 4 || '/' WHEN doc_id // 20 % 3 = 2 THEN 'top/' ELSE '' END || 'd' || doc_id || '.txt' AS path,
  octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE doc_id % 9 <> 0""")
def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of documents, zip and tar by turns, read member by member: a single top folder goes, paths that lead outside are left out."""

    def packed(rows: pa.Table) -> pa.Table:
        number, out = rows.column("a")[0].as_py(), io.BytesIO()
        named = []
        for k, text in sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True)):
            folder = "../out" if k % 9 == 0 else f"other{k % 4}" if number % 3 == 2 and k % 2 == 0 else "top"
            named.append((f"{folder}/d{k}.txt", text.encode()))
        if number % 2:
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                for name, data in named:
                    m = tarfile.TarInfo(name)
                    m.size = len(data)
                    t.addfile(m, io.BytesIO(data))
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in named:
                    z.writestr(name, data)
        return pa.table([pa.array([f"a{number}"]), pa.array([out.getvalue()])], names=["path", "content"])

    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("a"))
    return files.archives(docs.groupBy("a").applyInArrow(packed, "path string, content binary")).select("archive", "path", "bytes", F.sha2("content", 256).alias("sha256"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_nationkey || ';x' AS tags FROM supplier WHERE s_suppkey % 4 <> 1")
def artifact_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts written and replaced as a whole, then read; those of another major version are left out, unknown fields ignored."""
    at, k = new_path(spark, "artifact"), F.col("id").cast("long")
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.concat_ws(";", F.col("s_nationkey").cast("string"), F.lit("x")).alias("tag"), F.lit(1).alias("unknown")).withColumn("tags", F.split("tag", ";"))
    sinks.write_artifact(rows.withColumn("schema_version", F.lit("1.0")), at)
    sinks.write_artifact(rows.withColumn("schema_version", F.when(k % 4 == 1, "2.0").otherwise(F.concat(F.lit("1."), (k % 4).cast("string")))), at)
    schema = spark.createDataFrame([], "schema_version string, id string, name string, tags array<string>").schema
    return files.artifacts(spark, at, schema, lines=True).select("id", "name", F.array_join("tags", ";").alias("tags"))


@query("SELECT 's' || c_nationkey AS scan, 'm' || c_custkey AS metric, CAST(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey END AS DOUBLE) AS value FROM customer WHERE c_custkey % 5 <> 0")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """An index of scans: the newest row of a key counts, and a rebuilt table replaces what stood there."""
    index, k = sinks.Store(spark, new_path(spark, "index")), F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("scan"), F.concat(F.lit("m"), k.cast("string")).alias("metric"), k.cast("double").alias("value"), k)
    index.record("metrics", rows)
    index.rebuild({"metrics": index.read("metrics").join(rows.filter("c_custkey % 5 != 0").select("metric"), "metric", "left_semi")})
    index.record("metrics", rows.filter("c_custkey % 3 = 0 and c_custkey % 5 != 0").withColumn("value", F.lit(-1.0)))
    return index.read("metrics")


@query("SELECT 's' || n_nationkey AS scan, n_nationkey % 2 = 0 AS imported, CASE WHEN n_nationkey % 2 = 0 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) ELSE 1 END AS findings FROM nation")
def imported_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans that were made elsewhere are recorded with their findings, unless the index knows them."""
    index = sinks.Store(spark, new_path(spark, "index"))
    scan = F.concat(F.lit("s"), F.col("n_nationkey").cast("string"))
    nations = table(spark, sf, "nation")
    scans = nations.select(scan.alias("scan"), F.lit("r").alias("repository"), F.lit(None).cast("timestamp").alias("ts"), F.lit("deep").alias("profile"), F.lit("a").alias("artifact"), F.col("n_nationkey").alias("k"))
    finding = lambda df: df.select("scan", F.col("id").cast("string").alias("id"), F.lit("r").alias("rule"), F.lit("low").alias("severity"), F.lit(False).alias("suppressed"))
    known = scans.filter("k % 2 = 1")
    assert sinks.import_scan(index, known.drop("k"), {"findings": finding(known.withColumn("id", F.lit(0)))})
    new = scans.filter("k % 2 = 0")
    theirs = finding(table(spark, sf, "supplier").join(new, F.col("s_nationkey") == F.col("k")).withColumnRenamed("s_suppkey", "id"))
    assert sinks.import_scan(index, new.drop("k"), {"findings": theirs}) and not sinks.import_scan(index, known.drop("k"), {"findings": finding(known.withColumn("id", F.lit(1)))})
    counts = index.read("findings").groupBy("scan").agg(F.count("*").alias("findings"))
    return index.read("scans").join(scans.select("scan", (F.col("k") % 2 == 0).alias("imported")), "scan").join(counts, "scan", "left").select("scan", "imported", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '=SUM(' || c_custkey || ')' WHEN 1 THEN 'a "' || c_name || '", b' WHEN 2 THEN NULL ELSE c_name END AS n, c_acctbal AS b FROM customer)
SELECT k, k || ',' || CASE k % 4 WHEN 0 THEN '''=SUM(' || k || ')' WHEN 1 THEN '"a ""' || substr(n, 4, length(n) - 7) || '"", b"' WHEN 2 THEN '' ELSE n END || ',x;' || k AS line, CASE k % 4 WHEN 0 THEN '''' || n ELSE n END AS again FROM c""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a CSV export that no spreadsheet runs, and the same rows read back from a written one."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 4 == 0, F.concat(F.lit("=SUM("), k.cast("string"), F.lit(")"))).when(k % 4 == 1, F.concat(F.lit('a "'), name, F.lit('", b'))).when(k % 4 == 3, name)
    rows = table(spark, sf, "customer").select(k.cast("string").alias("k"), text.alias("n"), F.array(F.lit("x"), k.cast("string")).alias("tags"))
    at = new_path(spark, "csv")
    [path] = sinks.bundle({"customers": rows}, at)
    again = spark.read.option("header", "true").option("escape", '"').csv(path)
    lines = sinks.csv_lines(rows).withColumn("k", F.split_part("line", F.lit(","), F.lit(1)))
    return lines.join(again.select("k", F.col("n").alias("again")), "k").select(F.col("k").cast("long").alias("k"), "line", "again")


_FOUND = """f AS (SELECT sha256('f' || doc_id) AS id, 'rule-' || doc_id % 5 AS rule, CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, doc_id % 4 AS r, 'src/' || source AS path FROM documents WHERE doc_id % 7 <> 0)"""


@query(f"""WITH {_FOUND} SELECT k, rule, level, path, omitted FROM (SELECT row_number() OVER (ORDER BY r, rule, path, id) AS k, rule, CASE WHEN r <= 1 THEN 'error' WHEN r = 2 THEN 'warning' ELSE 'note' END AS level, path,
  greatest(count(*) OVER () - 500, 0) AS omitted FROM f) WHERE k <= 500""")
def sarif_results(spark: SparkSession, sf: str) -> DataFrame:
    """A SARIF document of findings, read back: the most severe come first, and what is left out is counted."""
    k = F.col("doc_id")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (k % 4 + 1).cast("int"))
    found = table(spark, sf, "documents").select(
        F.sha2(F.concat(F.lit("f"), k.cast("string")), 256).alias("id"), F.concat(F.lit("rule-"), (k % 5).cast("string")).alias("rule"), severity.alias("severity"), F.concat(F.lit("src/"), "source").alias("path"),
        F.lit("t").alias("title"), F.lit(1).alias("line"), F.lit("quality").alias("category"), F.when(k % 7 == 0, 1).alias("suppressed_by"), F.lit("high").alias("confidence"),
    )
    document = stored(sinks.sarif(found, "siltstone", "1", 500), "sarif")
    schema = "runs array<struct<properties:struct<omitted:long>,results:array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>"
    run = document.select(F.from_json("json", schema).alias("d")).select(F.col("d.runs")[0].alias("run"))
    each = run.select("run.properties.omitted", F.posexplode("run.results").alias("k", "r"))
    return each.select((F.col("k") + 1).alias("k"), F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("path"), "omitted")


@query("SELECT n_nationkey AS k, n_name AS name, total FROM (SELECT *, row_number() OVER (ORDER BY n_name DESC) AS place, count(*) OVER () AS total FROM nation) WHERE place <= 10")
def json_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of a table in an order, and how many there are, from a JSON report."""
    document = stored(sinks.json_report({"nations": table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))}, 10, {"nations": [F.desc("name")]}), "report")
    found = document.select(F.from_json("json", "nations struct<total:long,rows:array<struct<k:long,name:string>>>").alias("d"))
    return found.select("d.nations.total", F.inline("d.nations.rows")).select("k", "name", "total")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents), c AS (SELECT DISTINCT sha, lang FROM d WHERE doc_id % 3 <> 0)
SELECT doc_id, (d.sha, coalesce(d.lang, '')) IN (SELECT (sha, coalesce(lang, '')) FROM c) AS known FROM d""")
def cache_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses kept by content and language: what is missing is analysed and stored, then everything is found."""
    docs = table(spark, sf, "documents")
    wanted = docs.select("doc_id", facts.cache_key(F.sha2("text", 256), F.coalesce("lang", F.lit("")), "1").alias("key"))
    empty = spark.createDataFrame([], "key string, value string, bytes long, used timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    entry = lambda df: df.select("key", F.concat(F.lit("of "), "key").alias("value"), F.length("key").cast("long").alias("bytes")).distinct()
    first = stored(sinks.cache_updated(empty, entry(sinks.cache_misses(wanted.filter("doc_id % 3 != 0"), empty)), now), "cache")
    missing = stored(sinks.cache_misses(wanted, first), "misses")
    second = stored(sinks.cache_updated(first, entry(missing), now), "cache")
    hits = sinks.cache_hits(wanted, second).filter(F.col("value") == F.concat(F.lit("of "), "key"))
    return hits.join(missing.select("doc_id", F.lit(True).alias("missed")), "doc_id", "left").select("doc_id", F.col("missed").isNull().alias("known"))


@query("SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'missing' ELSE 'unindexed' END AS problem FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 1")
def index_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """What an index names and storage lacks, and the other way round."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return diffs.integrity(docs.filter("doc_id % 10 != 1 or doc_id % 6 = 0"), docs.filter("doc_id % 6 != 0"), "path")


# --- history dumps ---------------------------------------------------------


@query("""SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, sha1('c' || o_orderkey) AS hash, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS parents, 'u' || o_custkey || '@x' AS email, 'commit ' || o_orderkey AS subject,
  coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(binaries, 0) AS binaries, coalesce(renamed, 0) AS renamed, coalesce(n, 0) AS changes
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE floor(l_quantity) END) AS BIGINT) AS added, CAST(sum(CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_linenumber END) AS BIGINT) AS deleted,
  count(*) FILTER (l_partkey % 7 = 0) AS binaries, count(*) FILTER (l_suppkey % 6 = 0) AS renamed FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) GROUP BY 1) ON l_orderkey = o_orderkey""")
def log_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits and their changes from a printed history, written in parts and read by Spark's reader."""
    o, at = F.col("o_orderkey"), new_path(spark, "log")
    unique = F.struct("l_linenumber", "l_quantity")
    items = dealt(table(spark, sf, "lineitem"), "l_orderkey", rows=250_000).groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min(unique).alias("m")).select("l_orderkey", "l_partkey", "l_suppkey", "m.*")
    path = filled(F.lit("src/p<p>/s<s>.c"), p=F.col("l_partkey"), s=F.col("l_suppkey"))
    moved, binary = F.col("l_suppkey") % 6 == 0, F.col("l_partkey") % 7 == 0
    raw = F.concat(F.lit(":100644 100644 aaa bbb "), F.when(moved, F.concat(F.lit("R090\0old/"), path)).otherwise("M"), F.lit("\0"), path, F.lit("\0"))
    lines = F.when(binary, "-\t-\t").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("\t"), F.col("l_linenumber").cast("string"), F.lit("\t")))
    numstat = F.concat(lines, F.when(moved, F.concat(F.lit("\0old/"), path, F.lit("\0"), path)).otherwise(path), F.lit("\0"))
    bodies = items.groupBy("l_orderkey").agg(F.collect_list(raw).alias("raw"), F.collect_list(numstat).alias("stat"))
    head = filled(F.lit("<h>\x1f<p>\x1fN <c>\x1fu<c>@x\x1f1700000000\x1f+0100\x1fcommit <o>"), h=F.sha1(F.concat(F.lit("c"), o.cast("string"))), p=F.when(o % 5 == 0, "aa bb").otherwise("aa"), c=F.col("o_custkey"), o=o)
    rows = table(spark, sf, "orders").join(bodies, F.col("l_orderkey") == o, "left").select(o, F.explode(F.array(F.struct(F.lit(0).alias("n"), head.alias("value")), F.struct(F.lit(1).alias("n"), F.concat(F.lit("\n"), F.coalesce(F.array_join("raw", ""), F.lit("")), F.coalesce(F.array_join("stat", ""), F.lit(""))).alias("value")))).alias("r"))
    rows.select(o, "r.*").repartitionByRange(max(4, part_count(table(spark, sf, "orders"), 250_000)), "o_orderkey").sortWithinPartitions("o_orderkey", "n").select("value").write.option("lineSep", "\x1e").text(at)
    commits, changes = gitlog.history(spark, at)
    commits = commits.drop("changes")
    per = changes.groupBy("seq").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_if("binary").alias("binaries"), F.count_if(F.col("status") == "renamed").alias("renamed"), F.count("*").alias("changes"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "deleted", "binaries", "renamed", "changes")]
    return commits.join(per, "seq", "left").select(F.regexp_extract("subject", r"\d+", 0).cast("long").alias("k"), "seq", "hash", F.size("parents").alias("parents"), "email", "subject", *zero)


@query("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'remote-branch' ELSE 'tag' END AS kind, 'x/' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 1 THEN 'origin' END AS remote,
  CASE WHEN o_orderkey % 6 = 5 THEN 'peeled' ELSE 'obj' END || o_orderkey AS "commit", o_orderkey % 6 = 5 AS annotated FROM orders WHERE o_orderkey % 13 <> 0""")
def log_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Branches and tags of a printed list of refs; a tag with a message stands for its commit, names of names are left out."""
    o = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("refs/heads/x/", "refs/remotes/origin/x/", "refs/tags/x/"))), (o % 3 + 1).cast("int"))
    line = filled(F.lit("<n><o>\x1f<t>\x1fobj<o>\x1f<p>\x1f1700000000\x1f<s>"), n=name, t=F.when(o % 6 == 5, "tag").otherwise("commit"), p=F.when(o % 6 == 5, F.concat(F.lit("peeled"), o.cast("string"))).otherwise(""), s=F.when(o % 13 == 0, "refs/heads/main").otherwise(""), o=o)
    return gitlog.refs(table(spark, sf, "orders").select(line.alias("line"))).drop("ts")


@query("""SELECT 'o' || l_orderkey AS revision, count(*) AS entries, count(*) FILTER (l_partkey % 4 = 0) AS trees, CAST(sum(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE floor(l_extendedprice) END) AS BIGINT) AS bytes FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1""")
def tree_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of revisions from printed listings; other lines are left out."""
    line = filled(F.lit("<m> <t> abc<p> <b>\tsrc/p <p>"), m=F.when(F.col("l_suppkey") % 10 == 0, "x").otherwise("100644"), t=F.when(F.col("l_partkey") % 4 == 0, "tree").otherwise("blob"), p=F.col("l_partkey"), b=F.when(F.col("l_partkey") % 4 == 0, "-").otherwise(F.floor("l_extendedprice").cast("string")))
    entries = gitlog.tree_entries(table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("revision"), line.alias("line")))
    return entries.groupBy("revision").agg(F.count("*").alias("entries"), F.count_if(F.col("type") == "tree").alias("trees"), F.sum("bytes").alias("bytes"))


# --- manifests and imports -------------------------------------------------

#: name of the file, its text for a part, ecosystem, and (name, requirement, scope) that it declares.
MANIFESTS = (
    ("Cargo.toml", '[dependencies]\nd<p> = "1.<s>"\n[dev-dependencies]\ne<p> = { version = "2", optional = false }\n', "cargo", (("d<p>", "1.<s>", "runtime"), ("e<p>", "2", "development"))),
    ("package.json", '{"dependencies": {"d<p>": "^<s>"}, "devDependencies": {"e<p>": "~1"}, "peerDependencies": {"f": "*"}}', "npm", (("d<p>", "^<s>", "runtime"), ("e<p>", "~1", "development"), ("f", "*", "peer"))),
    ("requirements.txt", "# c\nD_<p>[x]>=1.<s> ; python_version > '3'\n-r other.txt\n", "pypi", (("d-<p>", ">=1.<s>", "runtime"),)),
    ("go.mod", "module a.b/c\nrequire (\n\ta.b/d<p> v1.<s>.0\n\ta.b/e v0.1.0 // indirect\n)\n", "go", (("a.b/d<p>", "v1.<s>.0", "runtime"), ("a.b/e", "v0.1.0", "indirect"))),
    ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>d<p></artifactId><version><s></version><scope>test</scope></dependency></dependencies></project>", "maven", (("g:d<p>", "<s>", "development"),)),
    ("Gemfile", "source 'x'\ngem 'd<p>', '~> 1.<s>'\n", "rubygems", (("d<p>", "~> 1.<s>", "runtime"),)),
    ("composer.json", '{"require": {"php": ">=8", "v/d<p>": "^<s>"}}', "composer", (("v/d<p>", "^<s>", "runtime"),)),
    ("pubspec.yaml", "name: x\ndependencies:\n  d<p>: ^1.<s>.0\n", "pub", (("d<p>", "^1.<s>.0", "runtime"),)),
    ("Cargo.lock", '[[package]]\nname = "d<p>"\nversion = "1.<s>.0"\n', "cargo", (("d<p>", "1.<s>.0", "locked"),)),
    ("package-lock.json", '{"packages": {"": {}, "node_modules/d<p>": {"version": "1.<s>.0"}}}', "npm", (("d<p>", "1.<s>.0", "locked"),)),
)


def _declared() -> str:
    said = lambda x: "'" + x.replace("<p>", "' || p_partkey || '").replace("<s>", "' || p_size || '") + "'"
    return " UNION ALL ".join(
        f"SELECT 'p' || p_partkey || '/{file}' AS manifest, '{ecosystem}' AS ecosystem, {said(name)} AS name, {said(wanted)} AS requirement, '{scope}' AS scope FROM part WHERE p_partkey % {len(MANIFESTS)} = {k}"
        for k, (file, _, ecosystem, rows) in enumerate(MANIFESTS)
        for name, wanted, scope in rows
    )


@query(_declared())
def manifest_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies that manifests and lock files of ten kinds declare."""
    k = (F.col("p_partkey") % len(MANIFESTS)).cast("int")
    pick = lambda j: F.get(F.array(*(F.lit(m[j]) for m in MANIFESTS)), k)
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), pick(0)).alias("path"), filled(pick(1), p=F.col("p_partkey"), s=F.col("p_size")).alias("text"))
    return manifests.declarations(rows).select("manifest", "ecosystem", "name", "requirement", "scope")


#: language, text, (line, imported module), package.
IMPORTED = (
    ("python", 'import os, a<p> as b\nfrom ..c<p> import d\nx = "import no"\n# import no\n', ((1, "os"), (1, "a<p>"), (2, "..c<p>")), None),
    ("rust", "use a<p>::{b, c::{self, d}};\nmod e<p>;\n// use no;\nextern crate f;\n", ((1, "a<p>::b"), (1, "a<p>::c"), (1, "a<p>::c::d"), (2, "e<p>"), (4, "f")), None),
    ("go", 'package q<p>\nimport (\n\t"fmt"\n\tx "a.b/c<p>"\n)\n', ((3, "fmt"), (4, "a.b/c<p>")), "q<p>"),
    ("java", "package a.q<p>;\nimport static x.y<p>.*;\n/* import no; */\n", ((2, "x.y<p>.*"),), "a.q<p>"),
    ("typescript", "import { a } from './a<p>';\nexport * from \"b\";\nconst c = require('c<p>');\n", ((1, "./a<p>"), (2, "b"), (3, "c<p>")), None),
    ("c", '#include <stdio.h>\n#include "a<p>.h"\n', ((1, "stdio.h"), (2, "a<p>.h")), None),
    ("kotlin", "package k.q<p>\nimport a.b<p>\n", ((2, "a.b<p>"),), "k.q<p>"),
    ("ruby", "require 'set'\nrequire_relative \"a<p>\"\n", ((1, "set"), (2, "a<p>")), None),
    ("csharp", "using System.Text;\nnamespace N.Q<p> {\n}\n", ((1, "System.Text"),), "N.Q<p>"),
)


def _imported() -> str:
    said = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("<p>", "' || p_partkey || '") + "'"
    return " UNION ALL ".join(
        f"SELECT 'p' || p_partkey AS path, {line} AS line, {said(module)} AS module, {said(package)} AS package FROM part WHERE p_partkey % {len(IMPORTED)} = {k}" for k, (_, _, found, package) in enumerate(IMPORTED) for line, module in found
    )


@query(_imported())
def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What texts of nine languages import, by line, and their packages."""
    k = (F.col("p_partkey") % len(IMPORTED)).cast("int")
    pick = lambda j: F.get(F.array(*(F.lit(m[j]) for m in IMPORTED)), k)
    rows = spread(table(spark, sf, "part").select("p_partkey")).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), pick(0).alias("language"), filled(pick(1), p=F.col("p_partkey")).alias("text"))
    return code.analyze(rows, "imports", "package").select("path", "package", F.inline("imports")).select("path", "line", "module", "package")


@query("""SELECT 'p' || p_partkey AS path, 2 AS line, CASE p_partkey % 3 WHEN 0 THEN 'TODO' WHEN 1 THEN 'FIXME' ELSE 'DEPRECATED' END AS kind, 'part ' || p_partkey AS text FROM part
UNION ALL SELECT 'p' || p_partkey, 4, 'HACK', 'end' FROM part WHERE p_partkey % 2 = 0""")
def comment_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers at the start of comments, upper case or after an at sign."""
    p = F.col("p_partkey")
    mark = F.element_at(F.array(*map(F.lit, ("// TODO: part <p>", "# FIXME(part <p>", "/* @deprecated part <p>"))), (p % 3 + 1).cast("int"))
    text = F.concat(F.lit("code(); todo()\nx "), filled(mark, p=p), F.lit("\n// see the todo list\n"), F.when(p % 2 == 0, "-- HACK end").otherwise("hack"))
    return textmine.markers(table(spark, sf, "part").select(F.concat(F.lit("p"), p.cast("string")).alias("path"), text.alias("text")))
