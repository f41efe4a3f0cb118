"""Queries over rules that make findings, facts of files, hashes, states of files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import facts, profiles, tables
from siltstone.functions import scalars as X
from siltstone.operators import diffs, fingerprint, graph, history, modules, project, quality, ranking, rules, structure
from siltstone.plans import expected
from siltstone.plans.catalogue import R4, orders, query
from siltstone.session import table

# --- findings --------------------------------------------------------------


def findings_sql(tables: dict[str, str], prefix: tuple[str, ...]) -> str:
    """The findings that are expected over tables given as SQL: selected, ordered and cut rule by rule."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rule, category, severity, confidence, name, when, subject, title, path, value, threshold, order, cap in expected.FINDINGS:
        if name in tables and rule.startswith(prefix):
            threshold = "NULL" if threshold is None else threshold
            parts.append(
                f"(SELECT {text(rule)} AS rule, {text(category)} AS category, {text(severity)} AS severity, {text(confidence)} AS confidence, CAST({subject} AS VARCHAR) AS subject, {title} AS title, CAST({path} AS VARCHAR) AS path, "
                f"CAST({value} AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold, greatest((SELECT count(*) FROM t_{name} WHERE {when}) - {cap}, 0) AS omitted FROM (SELECT * FROM t_{name} WHERE {when} {'ORDER BY ' + order if order else ''} LIMIT {cap}))"
            )
    ctes = ", ".join(f"t_{k} AS ({v})" for k, v in tables.items())
    return f"WITH {ctes}, f AS ({' UNION ALL '.join(parts)}) SELECT substr(sha256(rule || chr(31) || subject), 1, 12) AS id, * FROM f"


_QUALITY = {
    "functions": "SELECT 'src/o' || l_orderkey AS path, 'f' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name, CAST(floor(l_quantity) AS BIGINT) AS cyclomatic, CAST(floor(l_extendedprice / 500) AS BIGINT) AS lines, l_linenumber AS nesting FROM lineitem",
    "files": "SELECT 'src/p' || p_partkey AS path, p_size * 25 AS code FROM part",
    "clusters": "SELECT CAST(s_nationkey AS VARCHAR) AS cluster, count(*) AS places, max(s_suppkey) AS lines, 's' || min(s_suppkey) AS path FROM supplier GROUP BY s_nationkey",
    "totals": "SELECT sum(p_size) AS analyzed, sum(p_size) FILTER (p_partkey % 9 = 0) AS duplicated, count(*) FILTER (p_partkey % 2 = 1) AS markers FROM part",
    "pairs": "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, (c_custkey % 100) / CAST(100.0 AS DOUBLE) AS similarity FROM customer",
    "unused": "SELECT 'src/p' || p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
}


@query(findings_sql(_QUALITY, ("quality.",)))
def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    li, part, supplier = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    return rules.apply(
        {
            "functions": li.select(text("src/o", F.col("l_orderkey")).alias("path"), text("f", F.col("l_linenumber"), "_", F.col("l_partkey"), "_", F.col("l_suppkey")).alias("name"), F.floor("l_quantity").alias("cyclomatic"), F.floor(F.col("l_extendedprice") / 500).alias("lines"), F.col("l_linenumber").alias("nesting")),
            "files": part.select(text("src/p", F.col("p_partkey")).alias("path"), (F.col("p_size") * 25).alias("code")),
            "clusters": supplier.groupBy(F.col("s_nationkey").cast("string").alias("cluster")).agg(F.count("*").alias("places"), F.max("s_suppkey").alias("lines"), text("s", F.min("s_suppkey")).alias("path")),
            "totals": part.agg(F.sum("p_size").alias("analyzed"), F.sum(F.when(F.col("p_partkey") % 9 == 0, F.col("p_size"))).alias("duplicated"), F.count_if(F.col("p_partkey") % 2 == 1).alias("markers")),
            "pairs": table(spark, sf, "customer").select(text("c", F.col("c_custkey")).alias("a"), text("n", F.col("c_nationkey")).alias("b"), ((F.col("c_custkey") % 100) / 100.0).alias("similarity")),
            "unused": quality.unused(part.select(text("src/p", F.col("p_partkey")).alias("path")), li.select(F.lit("x").alias("src"), text("src/p", F.col("l_partkey")).alias("dst"))),
        },
        rules.QUALITY,
    )


_ARCHITECTURE = {
    "cycles": "SELECT CAST(n_regionkey AS VARCHAR) AS cycle, count(*) AS size FROM nation GROUP BY n_regionkey",
    "modules": """SELECT n_name AS module, count(*) OVER () AS modules, code, sum(code) OVER () AS total_code, row_number() OVER (ORDER BY code DESC, n_name) AS place, CAST(code / sum(code) OVER () * 8 AS DOUBLE) AS centrality, n_nationkey % 3 AS fan_in, n_nationkey % 2 AS fan_out, n_nationkey % 4 = 0 AS consumer
 FROM (SELECT n_name, n_nationkey, count(c_custkey) AS code FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2)""",
    "file_cycles": "SELECT list_sort(list('src/' || s_name)) AS members, count(*) AS size FROM supplier GROUP BY s_nationkey, s_suppkey % 20",
    "imports": "SELECT count(*) FILTER (o_orderstatus <> 'O') AS resolved, count(*) FILTER (o_orderstatus = 'O') AS unresolved FROM orders",
}


@query(findings_sql(_ARCHITECTURE, ("architecture.",)))
def architecture_findings(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nation = table(spark, sf, "nation")
    code = nation.join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name", "n_nationkey").agg(F.count("c_custkey").alias("code"))
    every = Window.partitionBy()
    k = F.col("n_nationkey")
    modules = code.select(
        F.col("n_name").alias("module"), F.count("*").over(every).alias("modules"), "code", F.sum("code").over(every).alias("total_code"), F.row_number().over(Window.orderBy(F.desc("code"), "n_name")).alias("place"),
        (F.col("code") / F.sum("code").over(every) * 8).alias("centrality"), (k % 3).alias("fan_in"), (k % 2).alias("fan_out"), (k % 4 == 0).alias("consumer"),
    )
    found = {
        "cycles": graph.cycles(nation.select(F.col("n_name").alias("node"), F.col("n_regionkey").cast("string").alias("component"))).withColumnRenamed("component", "cycle"),
        "modules": modules,
        "file_cycles": table(spark, sf, "supplier").groupBy("s_nationkey", F.col("s_suppkey") % 20).agg(F.sort_array(F.collect_list(F.concat(F.lit("src/"), "s_name"))).alias("members"), F.count("*").alias("size")),
        "imports": table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") != "O").alias("resolved"), F.count_if(F.col("o_orderstatus") == "O").alias("unresolved")),
    }
    return rules.apply(found, rules.ARCHITECTURE)


_DEPENDENCIES = {
    "locks": "SELECT 'lock-' || s_suppkey AS lockfile, s_suppkey % 5 AS missing FROM supplier",
    "ecosystems": "SELECT * FROM (VALUES ('npm', false, true), ('go', true, true), ('cargo', false, true), ('pub', false, false)) e(ecosystem, locked, declares)",
    "totals": "SELECT count(*) AS several FROM (SELECT p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_size) > 1)",
    "manifests": "SELECT 'm/' || o_custkey AS manifest, CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS days FROM orders GROUP BY o_custkey",
    "packages": f"SELECT l_shipmode AS package, importers, {R4('(importers / sum(importers) OVER ())')} * 4 AS share, row_number() OVER (ORDER BY importers DESC, l_shipmode) AS place FROM (SELECT l_returnflag AS l_shipmode, count(DISTINCT l_orderkey) AS importers FROM lineitem GROUP BY 1)",
}


@query(findings_sql(_DEPENDENCIES, ("dependencies.",)))
def dependency_findings(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o, part = orders(spark, sf), table(spark, sf, "part")
    at = o.agg(F.max("ts").alias("latest"))
    packages = graph.external_concentration(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("package"), F.col("l_orderkey").alias("path")))
    found = {
        "locks": table(spark, sf, "supplier").select(F.concat(F.lit("lock-"), F.col("s_suppkey").cast("string")).alias("lockfile"), (F.col("s_suppkey") % 5).alias("missing")),
        "ecosystems": spark.createDataFrame([("npm", False, True), ("go", True, True), ("cargo", False, True), ("pub", False, False)], "ecosystem string, locked boolean, declares boolean"),
        "totals": diffs.duplicate_versions(part, ["p_type"], "p_size").agg(F.count("*").alias("several")),
        "manifests": o.groupBy("author").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(at)).select(F.concat(F.lit("m/"), F.col("author").cast("string")).alias("manifest"), X.days_until(F.col("last"), F.col("latest")).alias("days")),
        "packages": packages.select("package", "importers", (F.col("share") * 4).alias("share"), F.row_number().over(Window.orderBy(F.desc("importers"), "package")).alias("place")),
    }
    return rules.apply(found, rules.DEPENDENCIES)


_PROJECT = {
    "project": """SELECT false AS has_tests, count(*) AS source_files, 1 AS test_files, false AS inline_tests, CAST(0.01 AS DOUBLE) AS test_ratio, sum(p_size) AS source_lines, 0 AS ci_files, 0 AS ci_test_commands, count(*) FILTER (p_partkey % 11 = 0) AS coverage_files,
 max(p_size) AS readme_words, true AS readme_at_root, false AS installation, true AS usage, false AS license_file, bool_or(p_size > 40) AS license_declared, 2 AS optional_missing FROM part"""
}


@query(findings_sql(_PROJECT, ("tests.", "build.", "docs.")))
def project_findings(spark: SparkSession, sf: str) -> DataFrame:
    lit = F.lit
    one = table(spark, sf, "part").agg(
        lit(False).alias("has_tests"), F.count("*").alias("source_files"), lit(1).alias("test_files"), lit(False).alias("inline_tests"), lit(0.01).alias("test_ratio"), F.sum("p_size").alias("source_lines"), lit(0).alias("ci_files"), lit(0).alias("ci_test_commands"),
        F.count_if(F.col("p_partkey") % 11 == 0).alias("coverage_files"), F.max("p_size").alias("readme_words"), lit(True).alias("readme_at_root"), lit(False).alias("installation"), lit(True).alias("usage"), lit(False).alias("license_file"), F.bool_or(F.col("p_size") > 40).alias("license_declared"), lit(2).alias("optional_missing"),
    )
    return rules.apply({"project": one}, rules.PROJECT)


_HISTORY = {
    "areas": """SELECT 'area' || user_id % 7 AS area, count(*) AS recent_changes, 7 AS active_areas, CAST(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) * 3 AS DOUBLE) AS share, user_id % 7 = 0 AS is_parent FROM events GROUP BY user_id % 7""",
    "abandoned": "SELECT 'a' || o_custkey AS area, CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS days FROM orders GROUP BY o_custkey",
    "hotspots": "SELECT 'p' || p_partkey AS path, count(*) OVER () AS candidates, p_size / CAST(50.0 AS DOUBLE) AS score, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part",
    "ages": "SELECT n_name AS module, CASE n_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' END AS class FROM nation",
    "ownership": "SELECT count(*) AS commits, count(DISTINCT user_id) AS contributors, CAST(0.8 AS DOUBLE) AS top_share FROM events",
    "pauses": """SELECT strftime(start, '%Y-%m-%d') || ' ' || author AS start, days FROM (SELECT o_custkey AS author, o_orderdate AS start, CAST(floor((epoch(lead(o_orderdate) OVER w) - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE days >= 60 ORDER BY days DESC, start, author LIMIT 50""",
}


@query(findings_sql(_HISTORY, ("activity.", "contributors.", "evolution.")))
def history_findings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = e.agg(F.count("*").alias("total"))
    areas = e.groupBy((F.col("user_id") % 7).alias("k")).agg(F.count("*").alias("recent_changes")).crossJoin(F.broadcast(n))
    o = orders(spark, sf)
    pauses = history.dormant_periods(o, by=("author",))
    found = {
        "areas": areas.select(F.concat(F.lit("area"), F.col("k").cast("string")).alias("area"), "recent_changes", F.lit(7).alias("active_areas"), (F.col("recent_changes") / F.col("total") * 3).alias("share"), (F.col("k") == 0).alias("is_parent")),
        "abandoned": o.groupBy("author").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(o.agg(F.max("ts").alias("latest")))).select(F.concat(F.lit("a"), F.col("author").cast("string")).alias("area"), X.days_until(F.col("last"), F.col("latest")).alias("days")),
        "hotspots": tables.in_order(table(spark, sf, "part"), [F.desc("p_size"), F.asc("p_partkey")], "rank").crossJoin(F.broadcast(table(spark, sf, "part").agg(F.count("*").alias("candidates")))).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), "candidates", (F.col("p_size") / 50.0).alias("score"), "rank"),
        "ages": table(spark, sf, "nation").select(F.col("n_name").alias("module"), F.when(F.col("n_nationkey") % 3 == 0, "new").when(F.col("n_nationkey") % 3 == 1, "old").alias("class")),
        "ownership": e.agg(F.count("*").alias("commits"), F.count_distinct("user_id").alias("contributors"), F.lit(0.8).alias("top_share")),
        "pauses": pauses.select(F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit(" "), F.col("author").cast("string")).alias("start"), "days"),
    }
    return rules.apply(found, rules.HISTORY)


_SECURITY = {
    "secrets": "SELECT 'p' || page_id AS path, 1 AS line, page_id % 3 = 0 AS sample FROM pages",
    "permissions": "SELECT 's' || s_suppkey AS path, '0' || (600 + s_suppkey % 78) AS mode FROM supplier WHERE s_suppkey % 2 = 0",
    "hits": "SELECT 'd' || doc_id AS path, 'r' || doc_id % 4 AS rule, doc_id % 7 AS line, CASE WHEN doc_id % 5 = 0 THEN 'high' ELSE 'low' END AS confidence FROM documents",
}


@query(findings_sql(_SECURITY, ("security.",)))
def security_findings(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    p, d = F.col("page_id"), F.col("doc_id")
    found = {
        "secrets": table(spark, sf, "pages").select(text("p", p).alias("path"), F.lit(1).alias("line"), (p % 3 == 0).alias("sample")),
        "permissions": table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(text("s", F.col("s_suppkey")).alias("path"), text("0", F.lit(600) + F.col("s_suppkey") % 78).alias("mode")),
        "hits": table(spark, sf, "documents").select(text("d", d).alias("path"), text("r", d % 4).alias("rule"), (d % 7).alias("line"), F.when(d % 5 == 0, "high").otherwise("low").alias("confidence")),
    }
    return rules.apply(found, rules.SECURITY)


_STRUCTURE = {"files": "SELECT 'bin/p' || p_partkey AS path, p_size * p_size * 3000 * p_partkey AS bytes, p_partkey % 3 <> 0 AS is_binary FROM part"}


@query(findings_sql(_STRUCTURE, ("structure.",)))
def structure_findings(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = table(spark, sf, "part").select(F.concat(F.lit("bin/p"), p.cast("string")).alias("path"), (size * size * 3000 * p).alias("bytes"), (p % 3 != 0).alias("is_binary"))
    return rules.apply({"files": rows}, rules.STRUCTURE)


# --- classes of files ------------------------------------------------------

#: Paths by kind, with what the ladder of rules makes of them, written out.
CLASSIFIED = (
    ("vendor/x{}.go", "programming", "vendor"), ("a/node_modules/b{}.js", "programming", "vendor"), ("dist/a{}.js", "programming", "build-output"), ("x{}.egg-info/PKG", None, "build-output"),
    (".idea/w{}.xml", "data", "ide-metadata"), ("s/a{}.iml", None, "ide-metadata"), ("src/a{}.pb.go", "programming", "generated"), ("src/x{}_gen.go", "programming", "source"), ("src/zz_generated{}.go", "programming", "generated"),
    ("m{}/go.work.sum", None, "lockfile"), ("m{}/lerna.json", "data", "manifest"), ("requirements-{}.txt", "prose", "manifest"), (".gitea/workflows/{}.yml", "data", "ci-cd"), (".woodpecker/{}.yml", "data", "ci-cd"),
    ("Dockerfile.{}", "build", "container"), ("k8s/{}.yaml", "data", "infrastructure"), ("k8s/{}.py", "programming", "source"), ("w{}/astro.config.mjs", "programming", "build"), ("LICENSE-{}", None, "license"), ("license{}.rs", "programming", "source"),
    ("tests/a{}.py", "programming", "test"), ("tests/a{}.png", None, "asset"), ("src/a{}_test.go", "programming", "test"), ("SECURITY_{}.md", "prose", "documentation"), ("security{}.yml", "data", "configuration"), ("a/b/security{}.yml", "data", "data"),
    ("a/config/b{}.yml", "data", "configuration"), ("a/b/c{}.properties", None, "configuration"), ("a/{}.heic", None, "asset"), ("data/{}.bin", None, "data"), ("data/{}.py", "programming", "source"), ("x/{}.whl", None, "binary"), ("x/y/{}.css", "stylesheet", "source"),
    ("x/y/{}.json", "data", "data"), ("x/y/{}.txt", "prose", "documentation"), ("x/y/{}.unknown", None, "other"),
)


@query(f"SELECT category, CAST(count(*) AS BIGINT) AS files FROM part JOIN (VALUES {', '.join(f'({k}, {chr(39)}{c}{chr(39)})' for k, (_, _, c) in enumerate(CLASSIFIED))}) w(k, category) ON p_partkey % {len(CLASSIFIED)} = k GROUP BY 1")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % len(CLASSIFIED)).cast("int")
    pick = lambda n: F.get(F.array(*(F.lit(x[n]) for x in CLASSIFIED)), k)
    paths = table(spark, sf, "part").select(F.replace(pick(0), F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"), pick(1).alias("kind"))
    found = structure.classify(F.col("path"), F.col("kind"), X.extension(F.col("path")))
    return paths.select(found["category"].alias("category")).groupBy("category").agg(F.count("*").alias("files"))


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'source' WHEN p_partkey % 4 = 1 THEN 'documentation' WHEN p_partkey % 4 = 2 THEN 'vendor' ELSE 'test' END AS category, p_partkey % 4 = 2 AS vendored, false AS generated, count(*) AS files FROM part GROUP BY 1, 2""")
def class_overrides(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.concat(F.when(k == 0, "gen-src/own/").when(k == 1, "src/notes/").when(k == 2, "src/ext/").otherwise("src/checks/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    rows = table(spark, sf, "part").select(path.alias("path"))
    plain = structure.classify(F.col("path"), F.lit("programming"), X.extension(F.col("path")))
    found = structure.overridden(plain, F.col("path"), {"source": ["gen-src/own/"], "docs": ["src/notes/"], "vendor": ["src/ext/"], "tests": ["src/checks/"]})
    return rows.select(found.alias("c")).groupBy("c.category", "c.vendored", "c.generated").agg(F.count("*").alias("files"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'benchmark' WHEN 1 THEN 'end-to-end' WHEN 2 THEN 'snapshot' WHEN 3 THEN 'integration' WHEN 4 THEN 'integration' ELSE 'unit' END AS kind, p_partkey % 6 = 1 AS ci, p_partkey % 6 = 5 AS readme, p_partkey % 6 = 2 AS license, p_partkey % 6 = 3 AS env FROM part""")
def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k, path = (F.col("p_partkey") % 6).cast("int"), F.col("path")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), k)
    p = table(spark, sf, "part").select("p_partkey", pick("benches/a.rs", "e2e/login.ts", "golden/x.txt", "integration/a.py", "tests/it.rs", "src/test_a.py").alias("path"), pick("rust", "typescript", None, "python", "rust", "python").alias("language"), pick("x.yml", ".github/workflows/b.yaml", "COPYING.txt", ".env.local", ".env.example", "docs/README.md").alias("other"))
    other = F.col("other")
    return p.select("p_partkey", facts.test_kind(path, F.col("language")).alias("kind"), facts.is_ci_file(other).alias("ci"), facts.is_readme(other).alias("readme"), facts.is_license(other).alias("license"), facts.is_env_file(other).alias("env"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sh' WHEN 1 THEN 'python3.12' WHEN 2 THEN 'deno' ELSE NULL END AS interpreter, CASE p_partkey % 5 WHEN 1 THEN 'python3' END AS short FROM part""")
def shebangs(spark: SparkSession, sf: str) -> DataFrame:
    line = F.get(F.array(*map(F.lit, ("#!/bin/sh -e", "#!/usr/bin/env python3.12", "#! /usr/bin/env -S deno run", "// no script", "#!"))), (F.col("p_partkey") % 5).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", line.alias("line"))
    names = facts.interpreters(F.col("line"))
    return p.select("p_partkey", facts.shebang(F.col("line")).alias("interpreter"), F.when(F.size(names) > 1, names[1]).alias("short"))


# --- hashes and numbers ----------------------------------------------------


@query()
def framed_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed, framed and FNV hashes of every page's URL; tests compare with Python's own."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", facts.hmac_sha256(b"key", u).alias("keyed"), facts.stable_hash(F.lit("page"), u).alias("framed"), facts.fnv1a(u).alias("fnv"))


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice AS span, o_orderkey % 6 AS n, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), r AS (SELECT *, span / greatest(n, 1) AS raw FROM x), p AS (SELECT *, pow(10.0, floor(log10(raw))) AS power FROM r)
SELECT o_orderkey, CAST(CASE WHEN span > 0 AND n >= 1 THEN (CASE WHEN raw / power <= 1 THEN 1 WHEN raw / power <= 2 THEN 2 WHEN raw / power <= 5 THEN 5 ELSE 10 END) * power ELSE 1 END AS DOUBLE) AS step,
  (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap, CAST(day(last_day(make_date(y, m, 1))) AS INTEGER) AS days FROM p""")
def scale_and_calendar(spark: SparkSession, sf: str) -> DataFrame:
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", facts.nice_step(F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 6).alias("step"), facts.is_leap_year(y).alias("leap"), facts.days_in_month(y, m).alias("days"))


@query("""WITH s AS (SELECT p_partkey % 2 = 0 AS generated, p_partkey % 3 = 0 AS vendored, p_partkey % 5 = 0 AS "binary", p_partkey % 7 = 0 AS skipped FROM part)
SELECT 'all' AS state, count(*) AS files FROM s UNION ALL SELECT 'regular', count(*) FROM s WHERE NOT (generated OR vendored OR "binary" OR skipped) UNION ALL SELECT 'generated', count(*) FROM s WHERE generated
UNION ALL SELECT 'vendored', count(*) FROM s WHERE vendored UNION ALL SELECT 'binary', count(*) FROM s WHERE "binary" UNION ALL SELECT 'skipped', count(*) FROM s WHERE skipped""")
def file_states_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, sf, "part").select(*((k % n == 0).alias(f) for n, f in zip((2, 3, 5, 7), facts.FLAGS, strict=True)))
    one = s.agg(*(F.count_if(facts.in_state(f)).alias(f) for f in ("all", "regular", *facts.FLAGS)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("state"), F.col(f).alias("files")) for f in one.columns))).alias("x")).select("x.*")


@query("""SELECT doc_id, replace(replace(replace('/home/u/repo/' || text, '/home/u/repo/', ''), '/home/u/repo\\', ''), '/home/u/repo', '.') AS text FROM documents""")
def scrubbed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", facts.scrubbed(F.concat(F.lit("/home/u/repo/"), "text"), ("/home/u/repo",)).alias("text"))


@query()
def evidence_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Features of evidence for one question; tests compare with plain Python."""
    kind = F.get(F.array(*map(F.lit, facts.EVIDENCE)), (F.col("item_id") % 10).cast("int"))
    v = facts.evidence_features(F.lit("Which passage is about the text"), F.concat(F.lit("passage "), F.col("item_id").cast("string")), F.col("text"), kind)
    return table(spark, sf, "benchmark").select("item_id", v.alias("v")).select("item_id", *(F.col("v")[k].alias(f"f{k:02d}") for k in range(3 + len(facts.EVIDENCE))))


@query("""SELECT * FROM (VALUES ('/docs/gen/*.md', 'generated'), ('/docs/**/x.min.js', 'vendored'), ('/docs/keep/**', 'first-party'), ('/docs/keep/**', 'documentation'), ('*.lock', 'generated'), ('/a/b', 'documentation')) a("glob", what)""")
def attribute_globs(spark: SparkSession, sf: str) -> DataFrame:
    text = "# comment\n[attr]x y\n/gen/*.md linguist-generated text\nx.min.js linguist-vendored=true\nkeep/** -linguist-generated linguist-documentation\n!no linguist-generated\n"
    root = "*.lock linguist-generated=true\n/a/b linguist-documentation\n"
    files = spark.createDataFrame([("docs", text), ("", root)], "folder string, text string")
    return files.select(F.explode(facts.attributes(F.col("folder"), F.col("text"))).alias("a")).select("a.*")


# --- states, snapshots, layers ---------------------------------------------


def renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as changes of parts; a returned one renames its part's file from one version to the next."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("long").alias("added"), (F.col("l_returnflag") == "R").cast("int").alias("r"), "l_linenumber", "l_suppkey")
    order = Window.partitionBy("part").orderBy("commit", "l_linenumber", "l_suppkey", "ts", "added")
    n = tables.dealt(li, "part").withColumns({"n": F.row_number().over(order), "v": F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    name = lambda v: F.concat(F.lit("p"), F.col("part").cast("string"), F.lit("/v"), v.cast("string"))
    seq = F.struct("commit", "part", "n")
    return n.select(seq.alias("seq"), "commit", "ts", name(F.col("v")).alias("path"), F.when(F.col("r") == 1, name(F.col("v") - 1)).alias("old"), F.when(F.col("r") == 1, "renamed").otherwise("modified").alias("status"), "added", F.lit(0).cast("long").alias("deleted"))


@query("""SELECT 'p' || l_partkey || '/v' || count(*) FILTER (l_returnflag = 'R') AS path, count(DISTINCT l_orderkey) AS commits, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS churn, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_changed, false AS deleted FROM lineitem GROUP BY l_partkey""")
def renamed_file_states(spark: SparkSession, sf: str) -> DataFrame:
    return history.file_states(renamed(spark, sf)).drop("names")


_TIMES = ("1994-01-01", "1996-01-01", "1998-01-01", "2000-01-01", "2024-06-01")


@query(f"""WITH c AS (SELECT l_shipmode_ AS language, ts, CASE k WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS step, CAST(q AS BIGINT) AS q FROM (SELECT l_returnflag AS l_shipmode_, l_shipdate AS ts, l_linenumber % 4 AS k, l_quantity AS q FROM lineitem)), t AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x} 00:00:00'" for x in _TIMES)}]) AS target)
SELECT target, language, CAST(sum(step) AS BIGINT) AS files, CAST(sum(q) AS BIGINT) AS lines FROM t JOIN c ON ts <= target GROUP BY 1, 2 HAVING sum(step) <> 0 OR sum(q) <> 0""")
def growth_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("language"), F.col("l_shipdate").alias("ts"), F.when(k == 0, "added").when(k == 1, "deleted").otherwise("modified").alias("status"), F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    return history.snapshots(c, [f"{x} 00:00:00" for x in _TIMES])


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1 ELSE p_partkey // 2 END AS dst FROM part UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 50 = 8), n AS (SELECT DISTINCT p_partkey AS node FROM part), k AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)),
loop AS (SELECT a.src AS node FROM k a JOIN k b ON a.dst = b.src AND b.dst = a.src), bad(node) AS (SELECT node FROM loop UNION SELECT k.src FROM bad JOIN k ON k.dst = bad.node),
good AS (SELECT src, dst FROM k WHERE src NOT IN (SELECT node FROM bad)), l(node, layer) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM bad) AND node NOT IN (SELECT src FROM good) UNION SELECT src, layer + 1 FROM l JOIN good ON good.dst = l.node)
SELECT n.node, CAST(max(layer) AS INTEGER) AS layer FROM n LEFT JOIN l ON n.node = l.node GROUP BY 1""")
def assigned_layers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    e = part.select(k.alias("src"), F.when(k % 50 == 7, k + 1).otherwise(F.floor(k / 2)).cast("long").alias("dst")).union(part.filter(k % 50 == 8).select(k, k - 1))
    return graph.assign_layers(part.select(k.alias("node")), e)


@query(f"SELECT count(*) AS modules, {R4('least(1.0, log2(greatest(count(*), 1)) / 6)')} AS value FROM nation")
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.modularity(table(spark, sf, "nation"))


@query("SELECT count(*) AS entries, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents")
def cache_totals(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.cache_stats(table(spark, sf, "documents").select(F.col("n_chars").alias("bytes")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def table_page(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.page(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 25, 2)


@query("""WITH q AS (SELECT lang AS kind, d.doc_id // 5 AS question, count(*) AS n, count(*) FILTER (quality = 1) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2), k AS (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS kind)
SELECT k.kind, count(question) AS questions, count(*) FILTER (p > 0) AS answerable, count(question) - count(*) FILTER (p > 0) AS unanswerable, CAST(coalesce(sum(n), 0) AS BIGINT) AS labels, CAST(coalesce(sum(p), 0) AS BIGINT) AS positive, CAST(coalesce(sum(n - p), 0) AS BIGINT) AS negative FROM k LEFT JOIN q ON k.kind = q.kind GROUP BY 1""")
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return ranking.task_counts(d.select(F.floor(F.col("doc_id") / 5).alias("question"), F.col("lang").alias("kind"), (F.col("quality") == 1).alias("relevant")), ("de", "en", "es", "fr", "xx"))


@query(f"""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), n AS (SELECT 'p' || dst AS path, count(*) AS n FROM e GROUP BY 1),
f AS (SELECT 'p' || s_suppkey AS path, CAST(0.35 AS DOUBLE) AS score, 'entrypoint' AS reason FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT 'p1', 0.3, 'readme' UNION ALL SELECT 'p' || r_regionkey, 0.15, 'manifest' FROM region
 UNION ALL SELECT path, CAST(0.3 AS DOUBLE) * n / (SELECT max(n) FROM n), 'dependents' FROM n WHERE n >= 2 UNION ALL SELECT 'p' || n_nationkey, CAST(0.25 AS DOUBLE) * (1 - CAST(n_nationkey AS DOUBLE) / 20), 'hotspot' FROM nation WHERE n_nationkey + 1 <= 20),
g AS (SELECT path, {R4('least(1.0, sum(score))')} AS score, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM f GROUP BY 1) SELECT * FROM g WHERE path <> 'p2' ORDER BY score DESC, path LIMIT 12""")
def important_files(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("path")
    one = lambda x: spark.createDataFrame([(x,)], "path string")
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), p("l_partkey").alias("dst"))
    hot = table(spark, sf, "nation").select(p("n_nationkey"), (F.col("n_nationkey") + 1).alias("rank"))
    return quality.important_files(table(spark, sf, "supplier").filter("s_nationkey = 1").select(p("s_suppkey")), one("p1"), table(spark, sf, "region").select(p("r_regionkey")), edges, hot, one("p2"))


@query("""SELECT 'o' || l_orderkey AS path, 'f' || l_linenumber AS name, CAST(l_quantity AS BIGINT) AS cyclomatic, CAST(0 AS INTEGER) AS nesting, l_linenumber + 4 - l_linenumber AS lines FROM lineitem WHERE l_returnflag <> 'R'""")
def measured_functions(spark: SparkSession, sf: str) -> DataFrame:
    f = F.array(F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + 3).alias("end_line"), F.col("l_quantity").cast("long").alias("complexity"), F.lit(None).cast("int").alias("nesting")))
    files = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.lit("python").alias("language"), (F.col("l_returnflag") == "R").alias("test"), f.alias("functions"))
    return quality.function_signals(files).select("path", "name", "cyclomatic", "nesting", F.col("lines"))


_GROWN = """t AS (SELECT unnest([TIMESTAMP '1994-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00', TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '2000-01-01 00:00:00', TIMESTAMP '2024-06-01 00:00:00']) AS target),
g AS (SELECT target, l_returnflag AS language, CAST(sum(CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS BIGINT) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM t JOIN lineitem ON l_shipdate <= target GROUP BY 1, 2)"""


@query(f"""WITH {_GROWN}, q AS (SELECT target, language, lines / sum(lines) OVER (PARTITION BY target) AS share FROM g WHERE files <> 0 OR lines <> 0), e AS (SELECT x.target, y.language, coalesce(q.share, 0) AS share FROM (SELECT DISTINCT target FROM q) x CROSS JOIN (SELECT DISTINCT language FROM q) y LEFT JOIN q ON q.target = x.target AND q.language = y.language),
p AS (SELECT *, lag(share) OVER (PARTITION BY language ORDER BY target) AS before FROM e), f AS (SELECT target, sum(files) AS b FROM g GROUP BY 1), h AS (SELECT target, b, lag(b) OVER (ORDER BY target) AS a FROM f)
SELECT target AS ts, CASE WHEN before < 0.05 AND share >= 0.1 THEN 'language-introduced' ELSE 'language-shift' END AS kind, language AS subject, {R4("before")} AS before, {R4("share")} AS after FROM p WHERE (before < 0.05 AND share >= 0.1) OR (before >= 0.05 AND share > 0 AND abs(share - before) >= 0.2)
UNION ALL SELECT target, CASE WHEN b >= a + 50 AND b * 2 >= a * 3 THEN 'significant-growth' ELSE 'significant-reduction' END, 'repository', CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM h WHERE (b >= a + 50 AND b * 2 >= a * 3) OR (a >= b + 30 AND b * 10 <= a * 7)""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("language"), F.col("l_shipdate").alias("ts"), F.when(k == 0, "added").when(k == 1, "deleted").otherwise("modified").alias("status"), F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    return history.snapshot_events(history.snapshots(c, [f"{x} 00:00:00" for x in _TIMES]))


@query("""WITH c AS (SELECT l_orderkey AS commit, min(l_shipdate) AS ts, count(*) FILTER (l_returnflag = 'R') AS renamed, bool_or(l_partkey % 40 = 3 AND l_returnflag <> 'N') AS tests, bool_or(l_partkey % 60 = 5 AND l_returnflag <> 'N') AS ci FROM lineitem GROUP BY 1), s AS (SELECT min(commit) AS start FROM c)
SELECT ts, 'repository-created' AS kind, CAST(commit AS VARCHAR) AS subject FROM c, s WHERE commit = start
UNION ALL (SELECT ts, 'tests-introduced', CAST(commit AS VARCHAR) FROM c, s WHERE commit = (SELECT min(commit) FROM c WHERE tests) AND commit > start) UNION ALL (SELECT ts, 'ci-adopted', CAST(commit AS VARCHAR) FROM c, s WHERE commit = (SELECT min(commit) FROM c WHERE ci) AND commit > start)
UNION ALL SELECT ts, 'restructuring', CAST(commit AS VARCHAR) FROM c, s WHERE renamed >= 6 AND commit > start""")
def first_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    path = F.when(k % 40 == 3, F.concat(F.lit("tests/a"), k.cast("string"), F.lit(".py"))).when(k % 60 == 5, F.concat(F.lit(".github/workflows/b"), k.cast("string"), F.lit(".yml"))).otherwise(F.concat(F.lit("src/c"), k.cast("string"), F.lit(".py")))
    status = F.when(F.col("l_returnflag") == "R", "renamed").when(F.col("l_returnflag") == "N", "deleted").otherwise("added")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("ts"), path.alias("path"), status.alias("status"))
    kinds = {"tests-introduced": X.is_test_path(F.col("path")), "ci-adopted": facts.is_ci_file(F.col("path"))}
    return history.first_appearances(c, kinds, 6)


# --- modules and fingerprint -----------------------------------------------


#: Folders of parts, and the modules that they are, written out.
FOLDERS = (
    ("", "(root)", "root"), ("core", "core", "directory"), ("core/deep/er", "core", "directory"), ("crates/a/src", "crates/a", "directory"), ("crates/b", "crates/b", "directory"), ("crates", "crates", "directory"),
    ("src/net", "src/net", "directory"), ("src", "src", "directory"), ("src/main/java/x", "src/main/java/x", "directory"), ("src/main/java/y", "src/main/java/y", "directory"), ("pkg1/lib", "pkg1", "package"), ("pkg1/in/ner", "pkg1/in", "package"),
)


@query(f"SELECT module, kind, count(*) AS files FROM part JOIN (VALUES {', '.join(f'({k}, {chr(39)}{m}{chr(39)}, {chr(39)}{x}{chr(39)})' for k, (_, m, x) in enumerate(FOLDERS))}) w(k, module, kind) ON p_partkey % {len(FOLDERS)} = k GROUP BY 1, 2")
def inferred_modules(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % len(FOLDERS)).cast("int")
    folder = F.get(F.array(*(F.lit(f) for f, _, _ in FOLDERS)), k)
    files = table(spark, sf, "part").select(F.concat_ws("/", F.nullif(folder, F.lit("")), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".rs"))).alias("path"))
    packages = spark.createDataFrame([("",), ("pkg1",), ("pkg1/in",)], "folder string")
    return modules.infer(files, packages).groupBy("module", "kind").agg(F.count("*").alias("files"))


def metrics_sql(tables: dict[str, str]) -> str:
    parts = []
    for name, sql in tables.items():
        for k, v in expected.METRICS[name].items():
            zero = f"coalesce({v}, 0)" if " / " not in v and not v.startswith(("avg", "median", "max")) else v
            parts.append(f"SELECT '{k}' AS id, CAST({zero} AS DOUBLE) AS v FROM ({sql})")
    return f"SELECT id, {R4('v')} AS value FROM ({' UNION ALL '.join(parts)}) WHERE v IS NOT NULL"


_METRICS = {
    "files": """SELECT 'src/' || p_brand AS folder, p_size * 100 AS bytes, p_size * 30 AS lines, p_size * 25 AS code, p_size AS comment, p_partkey % 7 = 0 AS generated, p_partkey % 11 = 0 AS vendored, p_partkey % 13 = 0 AS is_binary, p_partkey % 5 AS symbols, p_type AS language, p_partkey % 4 = 0 AS test, p_partkey % 6 = 0 AS inline_tests, p_partkey % 9 = 0 AS document FROM part""",
    "functions": "SELECT CAST(floor(l_quantity) AS BIGINT) AS cyclomatic, l_linenumber * 20 AS lines FROM lineitem",
    "commits": "SELECT o_orderkey AS commit, o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AS recent, o_orderkey % 4000 AS age FROM orders",
    "people": "SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1",
    "imports": "SELECT l_returnflag <> 'R' AS resolved FROM lineitem",
    "findings": "SELECT ['info', 'attention', 'warning', 'critical'][c_custkey % 4 + 1] AS severity, c_custkey % 10 = 0 AS suppressed FROM customer",
    "dependencies": "SELECT s_suppkey % 2 = 0 AS direct, s_suppkey % 3 = 0 AS locked, CAST(s_nationkey AS VARCHAR) AS ecosystem FROM supplier",
    "duplication": "SELECT sum(p_size) AS analyzed, count(*) AS duplicated, count(DISTINCT p_brand) AS clusters FROM part",
    "markers": "SELECT 1 AS x FROM events",
}


@query(metrics_sql(_METRICS))
def raw_metrics(spark: SparkSession, sf: str) -> DataFrame:
    part, p = table(spark, sf, "part"), F.col("p_partkey")
    every = lambda n: p % n == 0
    return fingerprint.raw_metrics(
        {
            "files": part.select(
                F.concat(F.lit("src/"), "p_brand").alias("folder"), (F.col("p_size") * 100).alias("bytes"), (F.col("p_size") * 30).alias("lines"), (F.col("p_size") * 25).alias("code"), F.col("p_size").alias("comment"), every(7).alias("generated"), every(11).alias("vendored"),
                every(13).alias("is_binary"), (p % 5).alias("symbols"), F.col("p_type").alias("language"), every(4).alias("test"), every(6).alias("inline_tests"), every(9).alias("document"),
            ),
            "functions": table(spark, sf, "lineitem").select(F.floor("l_quantity").alias("cyclomatic"), (F.col("l_linenumber") * 20).alias("lines")),
            "commits": table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), (F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("recent"), (F.col("o_orderkey") % 4000).alias("age")),
            "people": orders(spark, sf).groupBy("author").agg(F.count("*").alias("commits")),
            "imports": table(spark, sf, "lineitem").select((F.col("l_returnflag") != "R").alias("resolved")),
            "findings": table(spark, sf, "customer").select(F.get(F.array(*map(F.lit, ("info", "attention", "warning", "critical"))), (F.col("c_custkey") % 4).cast("int")).alias("severity"), (F.col("c_custkey") % 10 == 0).alias("suppressed")),
            "dependencies": table(spark, sf, "supplier").select((F.col("s_suppkey") % 2 == 0).alias("direct"), (F.col("s_suppkey") % 3 == 0).alias("locked"), F.col("s_nationkey").cast("string").alias("ecosystem")),
            "duplication": part.agg(F.sum("p_size").alias("analyzed"), F.count("*").alias("duplicated"), F.count_distinct("p_brand").alias("clusters")),
            "markers": table(spark, sf, "events"),
        }
    )


_MEASURES = """SELECT (SELECT count(*) FROM nation) AS modules, (SELECT count(*) FROM region) AS max_fan_in, CAST(0.25 AS DOUBLE) AS concentration, CAST(4.0 AS DOUBLE) AS effective_languages, CAST(2.5 AS DOUBLE) AS effective_contributors, CAST(count(*) AS BIGINT) AS age_days,
 count(*) FILTER (p_partkey % 4 = 0) AS test_files, count(*) FILTER (p_partkey % 4 <> 0) AS source_files, count(*) FILTER (p_partkey % 8 = 1) AS inline_test_files, 5 AS checks_present, 1 AS checks_partial, 8 AS checks, 40 AS commits_90, CAST(NULL AS DOUBLE) AS duplication_ratio, 30 AS resolved, 10 AS unresolved FROM part"""


@query(f"WITH m AS ({_MEASURES}), d AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS id, CAST({v} AS DOUBLE) AS v FROM m' for k, v in expected.DIMENSIONS.items())}) SELECT id, {R4('greatest(0.0, least(1.0, v))')} AS value FROM d WHERE v IS NOT NULL")
def fingerprint_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    n, r = (table(spark, sf, t).agg(F.count("*").alias(c)) for t, c in (("nation", "modules"), ("region", "max_fan_in")))
    p = F.col("p_partkey")
    fixed = {"concentration": 0.25, "effective_languages": 4.0, "effective_contributors": 2.5, "checks_present": 5, "checks_partial": 1, "checks": 8, "commits_90": 40, "resolved": 30, "unresolved": 10}
    one = table(spark, sf, "part").agg(F.count("*").alias("age_days"), F.count_if(p % 4 == 0).alias("test_files"), F.count_if(p % 4 != 0).alias("source_files"), F.count_if(p % 8 == 1).alias("inline_test_files"))
    one = one.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"duplication_ratio": F.lit(None).cast("double")})
    return fingerprint.dimensions(one.crossJoin(n).crossJoin(r), signals=True)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'web/admin' WHEN 2 THEN '' ELSE 'web' END AS root FROM part""")
def package_roots(spark: SparkSession, sf: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, ("web/src/a.ts", "web/admin/b.ts", "website/c.ts", "web/administration/d.ts"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", facts.folder_of_package(path, ("web", "web/admin")).alias("root"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'tests' WHEN 1 THEN 'source' ELSE 'vendor' END AS c FROM part) SELECT c AS category, c = 'source' AS first_party, count(*) AS n FROM p WHERE c <> 'tests' GROUP BY 1, 2 UNION ALL SELECT 'test', true, count(*) FROM p WHERE c = 'tests'""")
def first_party(spark: SparkSession, sf: str) -> DataFrame:
    c = F.get(F.array(*map(F.lit, ("test", "source", "vendor"))), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf, "part").select(c.alias("category")).groupBy("category", facts.is_first_party_code(F.col("category")).alias("first_party")).agg(F.count("*").alias("n"))


# --- project ---------------------------------------------------------------

#: Files of a project by the remainder of a part's key, with language, category and whether tests stand inside.
PROJECT_FILES = (
    ("src/a{}.rs", "rust", "source", True), ("src/b{}.py", "python", "source", False), ("tests/t{}.py", "python", "test", False), ("e2e/l{}.ts", "typescript", "test", False), (".github/workflows/w{}.yml", "yaml", "ci-cd", False), ("p{}/Cargo.toml", "toml", "manifest", False),
    ("p{}/requirements-dev.txt", None, "manifest", False), ("docs/d{}.md", "markdown", "documentation", False), ("r{}/coverage.xml", "xml", "data", False), ("web{}/vite.config.ts", "typescript", "build", False), ("CHANGES", None, "documentation", False), (".gitlab-ci.yml", "yaml", "ci-cd", False),
)


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % len(PROJECT_FILES)).cast("int")
    pick = lambda n: F.get(F.array(*(F.lit(x[n]) for x in PROJECT_FILES)), k)
    return table(spark, sf, "part").select(F.replace(pick(0), F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"), pick(1).alias("language"), pick(2).alias("category"), F.col("p_size").alias("code"), pick(3).alias("inline_tests"))


def own_readme(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("README.md", 50, True, False, ["Install", "How to contribute"])], "path string, words int, installation boolean, usage boolean, headings array<string>")


@query("SELECT 'GitHub Actions' AS provider, count(*) AS files FROM part WHERE p_partkey % 12 = 4 UNION ALL SELECT 'GitLab CI', count(*) FROM part WHERE p_partkey % 12 = 11")
def ci_providers(spark: SparkSession, sf: str) -> DataFrame:
    return project.ci_configs(project_files(spark, sf)).groupBy("provider").agg(F.count("*").alias("files"))


@query("SELECT 'Cargo' AS tool, 'cargo' AS ecosystem, min('p' || p_partkey || '/Cargo.toml') AS path FROM part WHERE p_partkey % 12 = 5 UNION ALL SELECT 'pip', 'pypi', min('p' || p_partkey || '/requirements-dev.txt') FROM part WHERE p_partkey % 12 = 6 UNION ALL SELECT 'Vite', 'npm', min('web' || p_partkey || '/vite.config.ts') FROM part WHERE p_partkey % 12 = 9")
def build_tools(spark: SparkSession, sf: str) -> DataFrame:
    return project.build_systems(project_files(spark, sf))


@query(f"""WITH p AS (SELECT p_partkey % 12 AS k, p_size FROM part), c AS (SELECT count(*) FILTER (k IN (2, 3)) AS test_files, count(*) FILTER (k = 0) AS inline_test_files, CAST(coalesce(sum(p_size) FILTER (k IN (2, 3)), 0) AS BIGINT) AS test_lines, count(*) FILTER (k IN (0, 1)) AS source_files,
 CAST(coalesce(sum(p_size) FILTER (k IN (0, 1)), 0) AS BIGINT) AS source_lines, count(*) FILTER (k = 8) AS coverage_files FROM p) SELECT *, {R4("coalesce(test_lines / nullif(test_lines + source_lines, 0), 0)")} AS test_ratio FROM c""")
def test_totals(spark: SparkSession, sf: str) -> DataFrame:
    return project.test_report(project_files(spark, sf))


@query("SELECT CASE WHEN k = 3 THEN 'end-to-end' ELSE 'unit' END AS kind, count(*) AS files FROM (SELECT p_partkey % 12 AS k FROM part) WHERE k IN (0, 2, 3) GROUP BY 1")
def kinds_of_tests(spark: SparkSession, sf: str) -> DataFrame:
    return project.test_kinds(project_files(spark, sf))


@query("""SELECT * FROM (VALUES ('readme', 'present'), ('installation', 'present'), ('usage', 'missing'), ('license', 'missing'), ('contributing', 'partial'), ('code-of-conduct', 'missing'), ('security-policy', 'missing'), ('changelog', 'present'), ('support', 'missing'), ('codeowners', 'missing'),
 ('citation', 'missing'), ('docs-directory', 'present'), ('examples', 'missing'), ('issue-templates', 'missing'), ('pull-request-template', 'missing')) c(id, status)""")
def document_checks(spark: SparkSession, sf: str) -> DataFrame:
    return project.doc_checks(project_files(spark, sf), own_readme(spark))


@query("""SELECT * FROM (VALUES ('tests.not-in-ci', 'info'), ('tests.coverage-committed', 'info'), ('docs.setup-instructions', 'info'), ('docs.license-file-missing', 'info'), ('docs.optional-missing', 'info')) f(rule, severity)""")
def project_findings_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """From files to findings, all the way."""
    one = project.facts(project_files(spark, sf), own_readme(spark), license_declared=True)
    return rules.apply({"project": one}, rules.PROJECT).select("rule", "severity")


@query("SELECT l_orderkey AS commit, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1")
def commit_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return history.commit_sizes(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tests' WHEN doc_id % 3 = 1 THEN 'build' ELSE 'security' END AS category FROM documents WHERE doc_id % 3 <> 1")
def kept_categories(spark: SparkSession, sf: str) -> DataFrame:
    category = F.get(F.array(*map(F.lit, ("tests", "build", "security"))), (F.col("doc_id") % 3).cast("int"))
    return profiles.project_kept(table(spark, sf, "documents").select("doc_id", category.alias("category")), build=False)
