"""Queries over source texts that Spark writes from orders and their lines: a file a customer, a function an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.tables import discard, stored
from siltstone.operators import environment, repeats
from siltstone.plans.catalogue import query
from siltstone.session import new_path, table
from siltstone.sources import code, manifests
from siltstone.streaming import scans


def filled(text: Column, **values: Column) -> Column:
    """A text with columns in place of names in angle brackets."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f"<{name}>"), value.cast("string"))
    return text


#: language -> (top, head of a function, a small line, a large one, end of a function, end of the file); large lines hold two decisions.
WRITTEN = {
    "python": (
        "import os\nclass C<c>:\n", "    def f<o>(self):\n        # if <o>\n", "        s = 'while' # if\n", "        if a > <q> and b:\n            s = \"if or <p>\"\n", "        return s\n\n", "if s:\n    pass\n",
    ),
    "rust": (
        "use std::io;\nimpl C<c> {\n", "    fn f<o>(&self) -> u32 {\n        /* if <o> */\n", "        let s = \"while\"; // if\n", "        if a > <q> && b {\n            s = \"if || <p>\";\n        }\n", "        s\n    }\n\n",
        "}\n#[cfg(test)]\nmod tests {\n    fn t() { if x { y(); } }\n}\n",
    ),
    "ruby": ("require 'set'\nclass C<c>\n", "  def f<o>(a)\n    # if <o>\n", "    s = 'while' # if\n", "    if a > <q> && b\n      s = \"if or <p>\"\n    end\n", "    s\n  end\n\n", "end\n"),
}
SUFFIX = {"python": "py", "rust": "rs", "ruby": "rb"}


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, language, text): a file for each customer with orders, in one of three languages, a function for each order."""
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey)
    language = F.get(F.array(*map(F.lit, WRITTEN)), (F.col("o_custkey") % 3).cast("int"))
    part = lambda k: F.create_map(*(F.lit(x) for name, parts in WRITTEN.items() for x in (name, parts[k])))[F.col("language")]
    line = F.when(F.col("l_quantity") > 25, filled(part(3), q=F.col("l_quantity").cast("int"), p=F.col("l_partkey"))).otherwise(part(2))
    rows = rows.withColumn("language", language).select("o_custkey", "o_orderkey", "language", "l_linenumber", line.alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "")
    functions = rows.groupBy("o_custkey", "o_orderkey", "language").agg(lines.alias("body"))
    functions = functions.select("o_custkey", "o_orderkey", "language", F.concat(filled(part(1), o=F.col("o_orderkey")), "body", part(4)).alias("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "text"))), lambda x: x["text"]), "")
    files = functions.groupBy("o_custkey", "language").agg(body.alias("body"))
    suffix = F.create_map(*(F.lit(x) for pair in SUFFIX.items() for x in pair))[F.col("language")]
    path = F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit("."), suffix)
    return files.select(path.alias("path"), "language", F.concat(filled(part(0), c=F.col("o_custkey")), "body", part(5)).alias("text"))


#: What stands where, counted from the templates: lines of a function, places, and totals of a file.
PLACED = """
f AS (
  SELECT o_custkey AS c, o_orderkey AS o, o_custkey % 3 AS k, count(*) FILTER (l_quantity > 25) AS big, count(*) FILTER (l_quantity <= 25) AS small
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
l AS (SELECT *, CASE k WHEN 0 THEN 3 + small + 2 * big ELSE 4 + small + 3 * big END AS n FROM f),
p AS (SELECT *, 3 + coalesce(sum(n + 1) OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM l),
t AS (SELECT c, k, sum(n + 1) AS s, count(*) AS functions, sum(big) AS big, sum(small) AS small, 'src/c' || c || CASE k WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.rb' END AS path FROM p GROUP BY c, k)
"""


@query(f"""WITH {PLACED}
SELECT path, 'method' AS kind, 'f' || o AS name, CAST(line AS INT) AS line, CAST(line + n - 1 AS INT) AS end_line, CAST(1 + 2 * p.big AS INT) AS complexity, CASE WHEN p.big > 0 THEN 1 ELSE 0 END AS nesting FROM p JOIN t USING (c)
UNION ALL SELECT path, CASE k WHEN 1 THEN 'impl' ELSE 'class' END, 'C' || c, 2, CAST(CASE k WHEN 0 THEN s + 1 ELSE s + 3 END AS INT), NULL, NULL FROM t
UNION ALL SELECT path, 'module', 'tests', CAST(s + 5 AS INT), CAST(s + 7 AS INT), NULL, NULL FROM t WHERE k = 1
UNION ALL SELECT path, 'function', 't', CAST(s + 6 AS INT), CAST(s + 6 AS INT), 2, 1 FROM t WHERE k = 1""")
def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, methods and types with extents, complexity and nesting, in bodies of braces, indents and end keywords."""
    return code.analyze(sources(spark, sf), "symbols").select("path", F.inline("symbols")).select("path", "kind", "name", "line", "end_line", "complexity", "nesting")


@query(f"""WITH {PLACED}
SELECT path, CAST(2 + s - 2 * functions + CASE k WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 1 END AS BIGINT) AS code, functions AS comment, functions AS blank, CASE k WHEN 0 THEN 1 ELSE 0 END AS outside, CASE k WHEN 1 THEN 4 ELSE 0 END AS test_code,
  CASE k WHEN 0 THEN 'os' WHEN 1 THEN 'std::io' ELSE 'set' END AS imported,
  CAST(CASE k WHEN 0 THEN 3 + 8 * functions + 4 * small + 11 * big + 4 WHEN 1 THEN 3 + 12 * functions + 6 * small + 14 * big + 26 ELSE 2 + 7 * functions + 4 * small + 12 * big + 1 END AS INT) AS tokens FROM t""")
def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by kind, decisions outside of functions, code in test regions, imports, and tokens beyond imports."""
    found = code.analyze(sources(spark, sf), "code", "comment", "blank", "outside", "test_code", "imports", "tokens")
    return found.select("path", "code", "comment", "blank", "outside", "test_code", F.concat_ws(",", "imports.module").alias("imported"), F.size("tokens").alias("tokens"))


@query()
def code_clones(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of the maximal repeats of code tokens, as lines; literals and layout make no difference, imports are left out."""
    files = stored(code.analyze(sources(spark, sf), "tokens", "token_lines"), "tokens")
    found = repeats.repeats(files, 40, 12).join(files.select("path", "token_lines"), "path")
    line = lambda c: F.get("token_lines", F.col(c).cast("int"))
    return found.select("repeat", "tokens", "path", "start", "end", line("start").alias("line"), line("end").alias("end_line"))


@query(f"""WITH {PLACED}
SELECT path, CASE WHEN c % 5 = 0 OR c % 3 = 1 THEN 3 ELSE 1 END AS seq, CASE WHEN c % 5 = 0 THEN 2 ELSE 1 END AS analysed, CAST(functions + CASE k WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS functions,
  CAST(2 + s - 2 * functions + CASE k WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 1 END + CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS code FROM t WHERE c % 7 <> 0""")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files scanned, changed, touched, deleted and told of late, by a stream that analyses what changed."""
    written = stored(sources(spark, sf), "files")
    files = written.withColumn("c", F.regexp_extract("path", r"c(\d+)\.", 1).cast("long"))
    version = lambda df, seq, text, gone=False: df.select("path", "language", text.alias("text"), F.lit(seq).alias("seq"), F.lit(gone).alias("deleted"))
    text = F.col("text")
    at = new_path(spark, "versions")
    new = version(files.filter("c % 5 = 0 and c % 7 != 0"), 3, F.concat(text, F.lit("x\n")))
    touched, gone = version(files.filter("c % 3 = 1 and c % 5 != 0 and c % 7 != 0"), 3, text), version(files.filter("c % 7 = 0"), 3, text, True)
    late = version(files.filter("c % 11 = 0"), 0, F.lit("late\n"))
    for rows in (version(files, 1, text), new.union(touched).union(gone), late):
        rows.write.mode("append").parquet(f"{at}/in")
        scans.scan(spark, f"{at}/in", "path string, language string, text string, seq int, deleted boolean", f"{at}/out", f"{at}/state")
    discard(written)
    return scans.current(spark, f"{at}/out").select("path", "seq", "analysed", "functions", "code")


def project_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(project, path, text): the settings and task files of a small project for each supplier."""
    s = F.col("s_suppkey")
    put = lambda path, text, when=None: (path, filled(F.lit(text), a=s % 8 + 14, b=s % 6 + 12, c=s % 6 + 18, d=s % 5 + 11, e=s % 4 + 8, f=s % 3 + 9), F.lit(True) if when is None else when)
    files = [
        put(".nvmrc", "# node\nv<a>\n"), put("package.json", '{"engines": {"node": ">=<b> <<c>", "vscode": "1"}, "packageManager": "pnpm@8.<d>.0+sha", "scripts": {"test": "x", "lint:fix": "y", "odd": "z"}}'),
        put("deploy/docker-compose.yml", "services:\n  db:\n    image: postgres:<d>-alpine\n  web:\n    image: own/web:1\n", s % 2 == 0), put(".tool-versions", "# tools\npython 3.<e>\ngolang 1.2<f>\n", s % 3 == 0),
        put("runtime.txt", "python-3.<f>\n"), put("Makefile", "X := 1\n.PHONY: all\nbuild out: deps \\\n  gen | dirs\n\tcc\ntest:\n\t./t\n%.o: %.c\nodd:\n"),
        put("Cargo.toml", "[package]\nname = 'x'\n[[bin]]\n", s % 3 == 1), put("sub/Taskfile.yml", "version: '3'\ntasks:\n  build:\n    deps: [gen]\n  check-format: {}\n  odd:\n", s % 5 == 0),
        put("sub/deeper/pyproject.toml", "[tool.poetry]\n[tool.pytest]\n", s % 4 == 0), put("pnpm-lock.yaml", "packages:\n", s % 2 == 1), put("global.json", "{broken", s % 7 == 0),
        put("node_modules/x/package.json", '{"scripts": {"build": "no"}}'),
    ]
    rows = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(path).alias("path"), text.alias("text"))) for path, text, when in files)))
    return table(spark, sf, "supplier").select(s.cast("string").alias("project"), F.inline(rows))


_NEEDS = """
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS project, s_suppkey AS s, s_suppkey % 8 + 14 AS a, s_suppkey % 6 + 12 AS b, s_suppkey % 6 + 18 AS c, s_suppkey % 5 + 11 AS d, s_suppkey % 4 + 8 AS e, s_suppkey % 3 + 9 AS f FROM supplier)
"""


@query(f"""WITH {_NEEDS}
SELECT project, 'runtime' AS kind, 'Node.js' AS name, CAST(a AS VARCHAR) AS version, '.nvmrc' AS source, CAST(NULL AS VARCHAR) AS problem FROM s
UNION ALL SELECT project, 'runtime', 'Node.js', '>=' || b || ' <' || c, 'package.json', NULL FROM s UNION ALL SELECT project, 'package-manager', 'pnpm', '8.' || d || '.0', 'package.json', NULL FROM s
UNION ALL SELECT project, 'service', 'PostgreSQL', d || '-alpine', 'deploy/docker-compose.yml', NULL FROM s WHERE s % 2 = 0 UNION ALL SELECT project, 'container', 'Docker', NULL, 'deploy/docker-compose.yml', NULL FROM s WHERE s % 2 = 0
UNION ALL SELECT project, 'runtime', 'Python', '3.' || e, '.tool-versions', NULL FROM s WHERE s % 3 = 0 UNION ALL SELECT project, 'toolchain', 'Go', '1.2' || f, '.tool-versions', NULL FROM s WHERE s % 3 = 0
UNION ALL SELECT project, 'runtime', 'Python', '3.' || f, 'runtime.txt', NULL FROM s
UNION ALL SELECT project, NULL, NULL, NULL, 'global.json', 'Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' FROM s WHERE s % 7 = 0""")
def environment_requirements(spark: SparkSession, sf: str) -> DataFrame:
    return environment.requirements(project_texts(spark, sf))


@query(f"""WITH {_NEEDS}
SELECT project, 'Node.js' AS name, greatest(a, b) || '.0' AS low, least(a + 1, c) || '.0' AS high, 2 AS sources, greatest(a, b) >= least(a + 1, c) AS conflict FROM s
UNION ALL SELECT project, 'pnpm', '8.' || d, '8.' || d, 1, false FROM s UNION ALL SELECT project, 'Go', '1.2' || f, '1.' || CASE f WHEN 9 THEN '30' ELSE '2' || (f + 1) END, 1, false FROM s WHERE s % 3 = 0 AND f < 10
UNION ALL SELECT project, 'Go', '1.2' || f, '1.2' || (f + 1), 1, false FROM s WHERE s % 3 = 0 AND f >= 10
UNION ALL SELECT project, 'Python', '3.' || CASE WHEN s % 3 = 0 THEN greatest(e, f) ELSE f END, '3.' || (CASE WHEN s % 3 = 0 THEN least(e, f) ELSE f END + 1), CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END, s % 3 = 0 AND e <> f FROM s""")
def environment_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of all sources of a tool together, by their first two numbers."""
    short = lambda c: F.concat_ws(".", F.slice(c, 1, 2).cast("array<string>"))
    return environment.conflicts(environment.requirements(project_texts(spark, sf))).select("project", "name", short("low").alias("low"), short("high").alias("high"), "sources", "conflict")


@query(f"""WITH {_NEEDS}
SELECT project, CASE WHEN s % 2 = 1 THEN 'pnpm' ELSE 'npm' END || ' install' AS command, 'install' AS purpose, '' AS folder, 'package.json (package manager)' AS source, '' AS needs FROM s
UNION ALL SELECT project, CASE WHEN s % 2 = 1 THEN 'pnpm run test' ELSE 'npm test' END, 'test', '', 'package.json scripts.test', '' FROM s
UNION ALL SELECT project, CASE WHEN s % 2 = 1 THEN 'pnpm' ELSE 'npm' END || ' run lint:fix', 'lint', '', 'package.json scripts.lint:fix', '' FROM s
UNION ALL SELECT project, 'make build', 'build', '', 'Makefile build', 'deps,gen,dirs' FROM s UNION ALL SELECT project, 'make test', 'test', '', 'Makefile test', '' FROM s
UNION ALL SELECT project, unnest(['cargo build', 'cargo test', 'cargo clippy --all-targets', 'cargo fmt --check', 'cargo run']), unnest(['build', 'test', 'lint', 'format', 'run']), '', 'Cargo.toml', '' FROM s WHERE s % 3 = 1
UNION ALL SELECT project, 'task build', 'build', 'sub', 'sub/Taskfile.yml build', 'gen' FROM s WHERE s % 5 = 0 UNION ALL SELECT project, 'task check-format', 'format', 'sub', 'sub/Taskfile.yml check-format', '' FROM s WHERE s % 5 = 0
UNION ALL SELECT project, unnest(['poetry install', 'poetry run pytest']), unnest(['install', 'test']), 'sub/deeper', 'sub/deeper/pyproject.toml', '' FROM s WHERE s % 4 = 0
UNION ALL SELECT project, 'docker compose up', 'run', 'deploy', 'deploy/docker-compose.yml', '' FROM s WHERE s % 2 = 0""")
def project_commands(spark: SparkSession, sf: str) -> DataFrame:
    return environment.commands(project_texts(spark, sf)).withColumn("needs", F.concat_ws(",", "needs"))


def manifest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text): a lock file for each order and a workflow for each customer, in YAML; some cannot be read."""
    k, c = F.col("l_orderkey"), F.col("c_custkey")
    form = k % 4
    entry = F.when(form == 0, filled(F.lit("  /@s<s>/p<p>@<n>.<q>.0(x@1):\n    resolution: {integrity: 'a=='} # c\n"), s=F.col("l_suppkey"), p=F.col("l_partkey"), n=F.col("l_linenumber"), q=F.col("l_quantity").cast("int")))
    entry = entry.when(form == 1, filled(F.lit("  p<p>l<n>s<s>q<q>:\n    dependency: \"direct main\"\n    version: \"<n>.<q>.0\"\n"), s=F.col("l_suppkey"), p=F.col("l_partkey"), n=F.col("l_linenumber"), q=F.col("l_quantity").cast("int")))
    entry = entry.when(form == 2, filled(F.lit("\"p<p>@^1\", \"p<p>@~<n>\":\n  version \"<n>.<q>.0\"\n  dependencies:\n    x \"1\"\n\n"), p=F.col("l_partkey"), n=F.col("l_linenumber"), q=F.col("l_quantity").cast("int")))
    entry = entry.otherwise(filled(F.lit("  p<p>: [<n>\n"), p=F.col("l_partkey"), n=F.col("l_linenumber")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", entry.alias("entry")).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["entry"]), "")
    head = F.when(form == 2, "# yarn lockfile v1\n\n").otherwise("lockfileVersion: '6.0'\n\npackages:\n")
    name = F.element_at(F.array(*map(F.lit, ("pnpm-lock.yaml", "pubspec.lock", "yarn.lock", "pnpm-lock.yaml"))), (form + 1).cast("int"))
    locks = rows.groupBy("l_orderkey").agg(body.alias("body")).select(F.concat(F.lit("o"), k.cast("string"), F.lit("/"), name).alias("path"), F.concat(head, "body").alias("text"))
    flow = "name: ci <c>\non:\n  push:\n    branches: [main]\njobs:\n  build:\n    runs-on: ubuntu-<n>\n    steps:\n      - uses: actions/checkout@v<n>\n      - name: 'Test: <c>'\n        run: |\n          make test\n          echo <c>\n  last:\n    needs: [build]\n    uses: own/flow@v1\n"
    text = F.when(c % 9 == 0, F.lit("jobs:\n\tbad: 1\n")).otherwise(filled(F.lit(flow), c=c, n=F.col("c_nationkey")))
    flows = table(spark, sf, "customer").select(F.concat(F.lit("c"), c.cast("string"), F.lit("/.github/workflows/ci.yml")).alias("path"), text.alias("text"))
    return locks.union(flows)


@query("""SELECT 'o' || l_orderkey || '/' || CASE l_orderkey % 4 WHEN 1 THEN 'pubspec.lock' WHEN 2 THEN 'yarn.lock' ELSE 'pnpm-lock.yaml' END AS manifest, CASE WHEN l_orderkey % 4 = 1 THEN 'pub' ELSE 'npm' END AS ecosystem,
  CASE l_orderkey % 4 WHEN 0 THEN '@s' || l_suppkey || '/p' || l_partkey WHEN 1 THEN 'p' || l_partkey || 'l' || l_linenumber || 's' || l_suppkey || 'q' || CAST(floor(l_quantity) AS BIGINT) ELSE 'p' || l_partkey END AS name,
  l_linenumber || '.' || CAST(floor(l_quantity) AS BIGINT) || '.0' AS requirement, 'locked' AS scope, false AS refused
FROM lineitem WHERE l_orderkey % 4 <> 3
UNION ALL SELECT DISTINCT 'o' || l_orderkey || '/pnpm-lock.yaml', 'npm', NULL, NULL, NULL, true FROM lineitem WHERE l_orderkey % 4 = 3""")
def lock_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of lock files in YAML and its like; a broken file is a row that says so."""
    found = manifests.declarations(manifest_texts(spark, sf).filter("path not like '%.yml'"))
    return found.withColumn("refused", F.col("problem").isNotNull()).drop("problem")


@query("""WITH c AS (SELECT c_custkey AS c, 'c' || c_custkey || '/.github/workflows/ci.yml' AS path, c_nationkey AS n FROM customer)
SELECT path, 'ci ' || c AS workflow, 'build' AS job, 'ubuntu-' || n AS runs_on, '' AS needs, 1 AS step, CAST(NULL AS VARCHAR) AS name, 'actions/checkout@v' || n AS uses, CAST(NULL AS VARCHAR) AS run, CAST(NULL AS VARCHAR) AS problem FROM c WHERE c % 9 <> 0
UNION ALL SELECT path, 'ci ' || c, 'build', 'ubuntu-' || n, '', 2, 'Test: ' || c, NULL, 'make test' || chr(10) || 'echo ' || c || chr(10), NULL FROM c WHERE c % 9 <> 0
UNION ALL SELECT path, 'ci ' || c, 'last', NULL, 'build', 1, NULL, 'own/flow@v1', NULL, NULL FROM c WHERE c % 9 <> 0
UNION ALL SELECT path, NULL, NULL, NULL, '', NULL, NULL, NULL, NULL, 'line 2: a tab indents' FROM c WHERE c % 9 = 0""")
def workflow_steps(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.workflow_steps(manifest_texts(spark, sf)).withColumn("needs", F.concat_ws(",", "needs"))


@query(f"""WITH {PLACED}
SELECT path, 1 AS imports, CAST(functions + CASE k WHEN 1 THEN 3 ELSE 1 END AS INT) AS symbols, CAST(functions + CASE k WHEN 1 THEN 1 ELSE 0 END AS INT) AS functions,
  functions + 2 * big + CASE k WHEN 1 THEN 2 ELSE 0 END AS cyclomatic_total, CAST(greatest((SELECT max(1 + 2 * p.big) FROM p WHERE p.c = t.c), CASE k WHEN 1 THEN 2 ELSE 0 END) AS INT) AS cyclomatic_max,
  CAST((SELECT max(p.n) FROM p WHERE p.c = t.c) AS INT) AS longest_function, CASE WHEN big > 0 OR k = 1 THEN 1 ELSE 0 END AS max_nesting FROM t""")
def code_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return code.summary(code.analyze(sources(spark, sf), "imports", "symbols", "max_nesting"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), s AS (SELECT s_suppkey AS s, n FROM supplier, n)
SELECT 'pkg/m' || s || '.py' AS src, 'pkg/m' || (3 * s + 1) % n || '.py' AS dst, 'import' AS mechanism, 2 AS line FROM s WHERE (3 * s + 1) % n <> s AND (3 * s + 1) % n IN (SELECT s FROM s)
UNION ALL SELECT 'pkg/m' || s || '.py', 'pkg/data/t' || s % 5 || '.sql', 'reference', 3 FROM s WHERE s % 5 IN (SELECT s FROM s WHERE s < 5)
UNION ALL SELECT 'pkg/m' || s || '.py', 'pkg/m' || (s + 1) % n || '.py', 'reference', 4 FROM s WHERE (s + 1) % n IN (SELECT s FROM s) AND (s + 1) % n <> s""")
def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """From texts to edges: imports that are files, and paths that strings name, beside the file or from the root."""
    supplier, s = table(spark, sf, "supplier"), F.col("s_suppkey")
    n = supplier.agg(F.count("*").alias("n"))
    text = "import os\nfrom pkg.m<a> import x\nP = './data/t<k>.sql'\nQ = [\"pkg/m<b>.py\", 'no/such.py', \"a 'pkg/m<b>.py' b\"]\n# 'pkg/m<a>.py'\n"
    rows = supplier.crossJoin(F.broadcast(n)).select(filled(F.lit("pkg/m<s>.py"), s=s).alias("path"), F.lit("python").alias("language"), filled(F.lit(text), a=(3 * s + 1) % F.col("n"), k=s % 5, b=(s + 1) % F.col("n")).alias("text"))
    data = supplier.filter("s_suppkey < 5").select(filled(F.lit("pkg/data/t<s>.sql"), s=s).alias("path"), F.lit("sql").alias("language"), F.lit("select 1\n").alias("text"))
    files = rows.union(data)
    return code.edges(code.analyze(files), files)
