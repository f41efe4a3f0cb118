"""Registered queries over the driver's tables, with their SQL for the oracle.

A part of an order stands for a changed file, an order for a commit, a supplier for an author, and a
part's brand and type for folders; documents and pages stand for files with text, events for commits in time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as X
from siltstone.operators import history, quality, structure
from siltstone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


R4 = "(sign({0}) * floor(abs({0}) * 10000 + 0.5) / 10000)".format


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as changes of files: commit = order, author = supplier, path = brand / type / part."""
    part = table(spark, sf, "part")
    path = F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_type", F.lit(" "), F.lit("/")), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    return (
        table(spark, sf, "lineitem")
        .join(part.select(F.col("p_partkey").alias("l_partkey"), path.alias("path")), "l_partkey")
        .select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("ts"), "path", F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    )


CHANGES = """changes AS (SELECT l_orderkey AS commit, l_suppkey AS author, l_shipdate AS ts,
  replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '/') || '/part-' || p_partkey AS path, CAST(l_quantity AS BIGINT) AS churn
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
HISTORY = f"""{CHANGES}, latest AS (SELECT max(ts) AS latest FROM changes),
history AS (SELECT path, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, CAST(sum(churn) AS BIGINT) AS churn,
  count(DISTINCT CASE WHEN ts >= latest - INTERVAL 90 DAY THEN commit END) AS recent_commits, min(ts) AS first_seen, max(ts) AS last_changed
  FROM changes, latest GROUP BY path)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("commit"), F.col("user_id").alias("author"), "ts", "event_type", "value")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


# --- history ---------------------------------------------------------------


@query(f"WITH {HISTORY} SELECT * FROM history")
def file_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.file_history(changes(spark, sf))


def hotspot_inputs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("path", F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_type", F.lit(" "), F.lit("/")), F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))))
    own = part.select("path", F.col("p_size").cast("long").alias("complexity"), F.floor("p_retailprice").cast("long").alias("lines"), (F.col("p_partkey") % 7).alias("dependents"))
    return history.file_history(changes(spark, sf)).join(own, "path").select("path", "commits", "churn", "recent_commits", "complexity", "lines", "authors", "dependents")


_P = "CASE WHEN {0} <= 0 THEN 0.0 ELSE (rank() OVER (ORDER BY {0}) - 1 + 0.5 * count(*) OVER (PARTITION BY {0})) / count(*) OVER () END".format
_HOT = [("commits", "0.30"), ("churn", "0.20"), ("recent_commits", "0.15"), ("complexity", "0.15"), ("lines", "0.10"), ("authors", "0.05"), ("dependents", "0.05")]
_SCORE = " + ".join(["0.0", *(f"{w} * CAST(p_{c} AS DOUBLE)" for c, w in _HOT)]).replace("0.0 + ", "CAST(0.0 AS DOUBLE) + ", 1)


@query(f"""WITH {HISTORY},
inputs AS (SELECT h.path, commits, churn, recent_commits, CAST(p_size AS BIGINT) AS complexity, CAST(floor(p_retailprice) AS BIGINT) AS lines, authors, p_partkey % 7 AS dependents
  FROM history h JOIN part ON h.path = replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '/') || '/part-' || p_partkey),
ranked AS (SELECT *, {", ".join(f"CAST({_P(c)} AS DOUBLE) AS p_{c}" for c, _ in _HOT)} FROM inputs WHERE commits >= 2 AND lines > 0),
scored AS (SELECT *, {R4("(" + _SCORE + ")")} AS score FROM ranked)
SELECT path, CAST(row_number() OVER (ORDER BY score DESC, commits DESC, path) AS INTEGER) AS rank, score, {", ".join(c for c, _ in _HOT)},
  concat_ws(';', {", ".join(f"CASE WHEN p_{c} >= 0.75 THEN '{c}' END" for c, _ in _HOT)}) AS reasons
FROM scored ORDER BY score DESC, commits DESC, path LIMIT 50""")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return quality.hotspots(hotspot_inputs(spark, sf))


@query("SELECT user_id AS author, count(*) AS commits, min(ts) AS first_commit, max(ts) AS last_commit, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM events GROUP BY 1")
def contributors(spark: SparkSession, sf: str) -> DataFrame:
    return history.contributors(commits(spark, sf))


@query(f"""WITH p AS (SELECT user_id AS author, count(*) AS commits FROM events GROUP BY 1),
r AS (SELECT commits, row_number() OVER w AS n, sum(commits) OVER (ORDER BY commits DESC, author ROWS UNBOUNDED PRECEDING) AS reached, sum(commits) OVER () AS total FROM p WINDOW w AS (ORDER BY commits DESC, author))
SELECT count(*) AS contributors, min(CASE WHEN 2 * reached >= total THEN n END) AS contributors_for_half, {R4("(max(commits) / max(total))")} AS top_share FROM r""")
def ownership(spark: SparkSession, sf: str) -> DataFrame:
    return history.ownership(history.contributors(commits(spark, sf)))


@query("""WITH r AS (SELECT TIMESTAMP '2024-01-25 00:00:00' AS ref), a AS (SELECT
  count(*) FILTER (ts BETWEEN ref - INTERVAL 30 DAY AND ref) AS last_30, count(*) FILTER (ts BETWEEN ref - INTERVAL 90 DAY AND ref) AS last_90,
  count(*) FILTER (ts BETWEEN ref - INTERVAL 365 DAY AND ref) AS last_365, count(*) AS total, count(*) FILTER (ts > ref) AS future_dated,
  min(CASE WHEN ts <= ref THEN CAST(floor((floor(epoch(ref)) - floor(epoch(ts))) / 86400) AS BIGINT) END) AS days_since_last FROM events, r)
SELECT *, CASE WHEN total = 0 THEN 'none' WHEN last_30 >= 30 THEN 'very-active' WHEN last_30 >= 5 THEN 'active' WHEN last_90 >= 1 THEN 'moderate' WHEN last_365 >= 1 THEN 'low' ELSE 'dormant' END AS level FROM a""")
def activity_windows(spark: SparkSession, sf: str) -> DataFrame:
    return history.activity(commits(spark, sf), F.lit("2024-01-25 00:00:00").cast("timestamp"))


@query("""WITH f AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS c, count(DISTINCT o_custkey) AS a FROM orders GROUP BY 1),
e AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM f)
SELECT strftime(e.m, '%Y-%m') AS month, coalesce(c, 0) AS commits, coalesce(a, 0) AS authors FROM e LEFT JOIN f ON e.m = f.m""")
def timeline_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return history.timeline(orders(spark, sf))


@query("""WITH f AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS c FROM orders GROUP BY 1),
e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM f) SELECT CAST(e.d AS VARCHAR) AS day, coalesce(c, 0) AS commits FROM e LEFT JOIN f ON e.d = f.d""")
def daily_activity_dense(spark: SparkSession, sf: str) -> DataFrame:
    return history.daily(orders(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("""WITH f AS (SELECT (isodow(ts) - 1) AS w, hour(ts) AS h, count(*) AS c FROM events GROUP BY 1, 2),
e AS (SELECT w, h FROM range(7) a(w), range(24) b(h)) SELECT CAST(e.w AS INTEGER) AS weekday, CAST(e.h AS INTEGER) AS hour, coalesce(c, 0) AS commits FROM e LEFT JOIN f ON e.w = f.w AND e.h = f.h""")
def weekday_hour(spark: SparkSession, sf: str) -> DataFrame:
    return history.weekday_hour(commits(spark, sf))


@query("""WITH l AS (SELECT o_custkey AS author, o_orderdate AS start, lead(o_orderdate) OVER w AS end_, o_orderkey AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
d AS (SELECT author, start, end_ AS "end", before, after, CAST(floor((epoch(end_) - epoch(start)) / 86400) AS BIGINT) AS days FROM l WHERE epoch(end_) - epoch(start) >= 60 * 86400)
SELECT * FROM d ORDER BY days DESC, start, author LIMIT 50""")
def dormant_periods(spark: SparkSession, sf: str) -> DataFrame:
    return history.dormant_periods(orders(spark, sf), by=("author",))


_EPOCHS = """WITH l AS (SELECT o_custkey AS author, o_orderkey AS k, o_orderdate AS ts, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
m AS (SELECT *, CASE WHEN floor((epoch(ts) - epoch(prev)) / 86400) >= 90 THEN 1 ELSE 0 END AS fresh FROM l),
e AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY author ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM m)"""


@query(f"""{_EPOCHS},
g AS (SELECT author, epoch, min(ts) AS start, max(ts) AS "end", count(*) AS commits, count(DISTINCT author) AS authors FROM e GROUP BY 1, 2),
r AS (SELECT *, commits * CAST(30.0 AS DOUBLE) / greatest(floor((epoch("end") - epoch(start)) / 86400), 1) AS rate FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY rate, epoch) AS r FROM r),
x AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN rate END) OVER (PARTITION BY author) AS median FROM n)
SELECT author, epoch, start, "end", commits, authors, {R4("rate")} AS rate,
  CASE WHEN epoch = n - 1 THEN 'current' WHEN epoch = 0 THEN 'initial' WHEN rate >= 0.8 * median THEN 'active' ELSE 'maintenance' END AS kind FROM x""")
def epochs_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return history.epochs(orders(spark, sf), by=("author",))


@query(f"""WITH {CHANGES}, a AS (SELECT commit, path, churn, unnest(list_distinct([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)])) AS area FROM changes)
SELECT area, count(DISTINCT commit) AS commits, CAST(sum(churn) AS BIGINT) AS churn, count(DISTINCT path) AS files FROM a GROUP BY 1""")
def area_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return history.areas(changes(spark, sf))


@query(f"""WITH {CHANGES}, a AS (SELECT unnest(list_distinct([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)])) AS area, churn FROM changes),
s AS (SELECT area, CAST(sum(churn) AS BIGINT) AS churn FROM a GROUP BY 1), t AS (SELECT sum(churn) AS total FROM s WHERE area NOT LIKE '%/%'),
h AS (SELECT area, churn, {R4("(churn / total)")} AS share FROM s, t WHERE {R4("(churn / total)")} >= 0.02)
SELECT area, churn, share FROM h WHERE area NOT IN (SELECT split_part(area, '/', 1) FROM h WHERE area LIKE '%/%') ORDER BY share DESC, area LIMIT 5""")
def high_churn_areas(spark: SparkSession, sf: str) -> DataFrame:
    return history.high_churn_areas(history.areas(changes(spark, sf)), 0.02)


@query(f"""WITH {HISTORY}, g AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS area, max(last_changed) AS last_changed, count(*) AS files FROM history GROUP BY 1),
d AS (SELECT g.*, CAST(floor((epoch(latest) - epoch(last_changed)) / 86400) AS BIGINT) AS days FROM g, latest) SELECT area, last_changed, files, days FROM d WHERE days >= 3 AND files >= 3 ORDER BY days DESC, area LIMIT 30""")
def abandoned_areas(spark: SparkSession, sf: str) -> DataFrame:
    return history.abandoned_areas(history.file_history(changes(spark, sf)), 3)


@query(f"""WITH {HISTORY}, b AS (SELECT min(first_seen) AS s, max(last_changed) AS l FROM history),
g AS (SELECT split_part(path, '/', 1) AS module, min(first_seen) AS first_commit, max(last_changed) AS last_change, sum(commits) AS c, sum(recent_commits) AS r FROM history GROUP BY 1),
x AS (SELECT g.*, CAST(floor((epoch(l) - epoch(first_commit)) / 86400) AS BIGINT) AS age_days, floor((epoch(first_commit) - epoch(s)) / 86400) AS o, greatest(floor((epoch(l) - epoch(s)) / 86400), 1) AS span, coalesce(r / nullif(c, 0), 0.0) AS share FROM g, b)
SELECT module, first_commit, last_change, age_days, {R4("share")} AS recent_share,
  CASE WHEN age_days <= 30 THEN 'new' WHEN age_days <= 365 THEN 'recent' WHEN share >= 0.3 THEN 'growing' WHEN o * 5 <= span AND age_days > 730 THEN 'ancient' ELSE 'established' END AS class FROM x""")
def module_ages(spark: SparkSession, sf: str) -> DataFrame:
    h = history.file_history(changes(spark, sf))
    return history.module_ages(h.select(F.substring_index("path", "/", 1).alias("module"), "path"), h)


@query(f"""WITH {CHANGES}, l AS (SELECT max(ts) AS latest FROM changes)
SELECT count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, count(DISTINCT path) AS files, CAST(coalesce(sum(churn), 0) AS BIGINT) AS churn FROM changes, l WHERE ts > latest - INTERVAL 90 DAY""")
def recent_changes(spark: SparkSession, sf: str) -> DataFrame:
    return history.recent_changes(changes(spark, sf))


@query("""WITH p AS (SELECT o_orderkey AS commit, o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
t AS (SELECT 'v1.' || (o_orderkey % 97) || '.' || o_orderkey AS tag, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS commit, o_orderdate AS tag_ts FROM orders)
SELECT t.tag, substr(t.tag, 2) AS version, t.commit, position, greatest(position - coalesce(last_value(position IGNORE NULLS) OVER (ORDER BY tag_ts, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS since_previous
FROM t LEFT JOIN p ON t.commit = p.commit""")
def releases_since_previous(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    tags = o.select(F.concat(F.lit("v1."), (F.col("commit") % 97).cast("string"), F.lit("."), F.col("commit").cast("string")).alias("tag"), F.when(F.col("commit") % 3 == 0, F.lit(-1)).otherwise(F.col("commit")).cast("long").alias("commit"), F.col("ts").alias("tag_ts"))
    return history.releases(tags, o).select("tag", "version", "commit", F.col("position").cast("long").alias("position"), F.col("since_previous").cast("long").alias("since_previous"))


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, max(o_orderdate) AS z FROM orders), t AS (SELECT unnest(generate_series(a, z, INTERVAL 3 MONTH)) AS target FROM b)
SELECT target, (SELECT o_orderkey FROM orders WHERE o_orderdate <= target ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS "commit", (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= target) AS ts FROM t""")
def snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    targets = o.agg(F.date_trunc("month", F.min("ts")).alias("a"), F.max("ts").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 3 months)")).alias("target"))
    return history.snapshots_as_of(o, targets)


@query(f"""WITH {CHANGES}, m AS (SELECT DISTINCT date_trunc('quarter', ts) AS q FROM changes), f AS (SELECT path, min(ts) AS s FROM changes GROUP BY 1)
SELECT strftime(q, '%Y-%m') AS quarter, (SELECT count(*) FROM f WHERE date_trunc('quarter', s) <= q) AS files FROM m""")
def growth_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = changes(spark, sf)
    q = c.groupBy("path").agg(F.date_trunc("quarter", F.min("ts")).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    every = c.select(F.date_trunc("quarter", "ts").alias("q")).distinct().join(q, "q", "left")
    from pyspark.sql import Window

    return every.select(F.date_format("q", "yyyy-MM").alias("quarter"), F.coalesce(F.sum("n").over(Window.orderBy("q")), F.lit(0)).alias("files"))


# --- structure -------------------------------------------------------------


@query(f"""WITH {HISTORY}, s AS (SELECT *, string_split(path, '/') AS p FROM history),
f AS (SELECT unnest(list_concat([''], list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/')))) AS folder, churn, commits FROM s)
SELECT folder, count(*) AS files, CAST(sum(churn) AS BIGINT) AS churn, CAST(sum(commits) AS BIGINT) AS commits FROM f GROUP BY 1""")
def ancestor_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return structure.rollup(history.file_history(changes(spark, sf)), {"churn": F.col("churn"), "commits": F.col("commits")})


@query("""WITH n AS (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY 1, 2), r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) AS k FROM n WHERE w > 0) SELECT source, lang FROM r WHERE k = 1""")
def dominant_language(spark: SparkSession, sf: str) -> DataFrame:
    return structure.dominant(table(spark, sf, "documents"), "source", "lang", "n_chars")


@query(f"""WITH n AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1) SELECT lang, n_chars, {R4("(n_chars / sum(n_chars) OVER ())")} AS share, CAST(row_number() OVER (ORDER BY n_chars DESC, lang) AS INTEGER) AS rank FROM n""")
def language_shares(spark: SparkSession, sf: str) -> DataFrame:
    return structure.shares(table(spark, sf, "documents"), "lang", "n_chars")


@query("""WITH n AS (SELECT source, sum(n_chars) AS w, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS k FROM documents GROUP BY 1) SELECT CASE WHEN k <= 5 THEN source ELSE 'Other' END AS source, CAST(sum(w) AS BIGINT) AS n_chars FROM n GROUP BY 1""")
def language_shares_fold_other(spark: SparkSession, sf: str) -> DataFrame:
    return structure.folded(structure.shares(table(spark, sf, "documents"), "source", "n_chars"), "source", "n_chars", 5)


@query(f"""WITH n AS (SELECT lang, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY 1), t AS (SELECT sum(w) AS t, sum(w * w) AS q FROM n WHERE w > 0) SELECT {R4("(t * t / q)")} AS effective, {R4("(1 - q / (t * t))")} AS diversity FROM t""")
def effective_languages(spark: SparkSession, sf: str) -> DataFrame:
    return structure.effective_count(structure.shares(table(spark, sf, "documents"), "lang", "n_chars"), "n_chars")


@query(f"""WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY user_id), t AS (SELECT sum(w) AS t, sum(w * w) AS q FROM n) SELECT {R4("(t * t / q)")} AS effective, {R4("(1 - q / (t * t))")} AS diversity FROM t""")
def contributor_spread(spark: SparkSession, sf: str) -> DataFrame:
    return structure.effective_count(history.contributors(commits(spark, sf)), "commits")


@query(f"""WITH {HISTORY}, r AS (SELECT commits, row_number() OVER (ORDER BY commits DESC, path) AS r, count(*) OVER () AS files, sum(commits) OVER () AS total FROM history WHERE commits > 0),
t AS (SELECT *, greatest(1, least(ceil(files * 0.1), files - 1)) AS top FROM r), g AS (SELECT files, total, top, sum(CASE WHEN r <= top THEN commits END) AS s FROM t GROUP BY 1, 2, 3)
SELECT files, {R4("(s / total)")} AS share, {R4("greatest(0.0, least(1.0, (s / total - top / files) / (1 - top / files)))")} AS concentration FROM g""")
def change_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return structure.change_concentration(history.file_history(changes(spark, sf)))


@query("""SELECT size_class, count(*) AS sources FROM (SELECT CASE WHEN n < 100 THEN 'tiny' WHEN n < 1000 THEN 'small' WHEN n < 10000 THEN 'medium' WHEN n < 100000 THEN 'large' ELSE 'huge' END AS size_class FROM (SELECT count(*) AS n FROM documents GROUP BY source, lang)) GROUP BY 1""")
def size_classes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy(X.size_class(F.col("n")).alias("size_class")).agg(F.count("*").alias("sources"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(len(l) AS INTEGER) AS lines, CAST(len(l) - len(list_filter(l, lambda x: regexp_full_match(x, '\\s*'))) AS INTEGER) AS code, CAST(len(list_filter(l, lambda x: regexp_full_match(x, '\\s*'))) AS INTEGER) AS blank
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return structure.line_counts(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000 ORDER BY n_chars DESC, doc_id LIMIT 50")
def large_files(spark: SparkSession, sf: str) -> DataFrame:
    return quality.top_over(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 1000, ["doc_id"])


@query("""WITH r AS (SELECT sha256(length(CAST(doc_id AS VARCHAR)) || chr(0) || doc_id || chr(0) || sha256(text)) AS h FROM documents),
p AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS files, substr(sha256(string_agg(d, '' ORDER BY p, d)), 1, 32) AS hash FROM p""")
def dataset_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content"))
    return structure.dataset_hash(d, "content")


# --- quality ---------------------------------------------------------------


def functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("cyclomatic"), F.col("l_linenumber").alias("lines"), F.col("l_returnflag").alias("language"))


@query(f"""SELECT count(*) AS functions, {R4("avg(q)")} AS average, median(q) AS median, max(q) AS largest, count(*) FILTER (q BETWEEN 1 AND 5) AS bucket_1, count(*) FILTER (q BETWEEN 6 AND 10) AS bucket_6,
  count(*) FILTER (q BETWEEN 11 AND 20) AS bucket_11, count(*) FILTER (q BETWEEN 21 AND 50) AS bucket_21, count(*) FILTER (q >= 51) AS bucket_51 FROM (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def complexity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.complexity_summary(functions(spark, sf))


@query(f"SELECT l_returnflag AS language, count(*) AS functions, {R4('avg(CAST(l_quantity AS BIGINT))')} AS average, max(CAST(l_quantity AS BIGINT)) AS largest FROM lineitem GROUP BY 1")
def complexity_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return quality.complexity_by(functions(spark, sf), "language")


@query("""WITH r AS (SELECT l_suppkey AS supplier, l_orderkey AS s, l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY supplier ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY supplier ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT supplier, island, max(e) - min(s) + 1 AS n FROM i GROUP BY 1, 2)
SELECT supplier, CAST(sum(n) AS BIGINT) AS covered, count(*) AS blocks FROM g GROUP BY 1""")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))
    return quality.covered_lines(r, ["supplier"])


@query(f"""WITH f AS (SELECT count(*) AS n, sum(l_linenumber) AS l, count(*) FILTER (l_quantity >= 15) AS c FROM lineitem),
t AS (SELECT sum(CASE WHEN p_size % 5 <> 0 THEN p_size END) AS code, sum(CASE WHEN p_size % 5 <> 0 THEN p_partkey % 11 END) AS com, sum(CASE WHEN p_size % 5 = 0 THEN p_size END) AS tests, count(*) FILTER (p_size % 5 <> 0 AND p_size > 0) AS m,
  count(*) FILTER (p_size % 5 <> 0 AND p_size >= 40) AS big, sum(p_partkey % 3) AS mk, sum(CASE WHEN p_size % 5 <> 0 THEN p_partkey % 2 END) AS dup FROM part), x AS (
SELECT 'comment-ratio' AS id, com / nullif(code + com, 0) AS v FROM t UNION ALL SELECT 'average-function-length', l / nullif(n, 0) FROM f UNION ALL SELECT 'complex-function-share', c / nullif(n, 0) FROM f
UNION ALL SELECT 'large-file-share', big / nullif(m, 0) FROM t UNION ALL SELECT 'duplication-ratio', dup / nullif(code, 0) FROM t UNION ALL SELECT 'marker-density', mk * 1000 / nullif(code + tests, 0) FROM t UNION ALL SELECT 'test-code-ratio', tests / nullif(code, 0) FROM t)
SELECT id, {R4("v")} AS value FROM x WHERE v IS NOT NULL""")
def maintainability(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select((F.col("p_size") % 5 == 0).alias("test"), F.col("p_size").alias("code"), (F.col("p_partkey") % 11).alias("comment"), (F.col("p_partkey") % 3).alias("markers"), (F.col("p_partkey") % 2).alias("duplicated"))
    return quality.maintainability(files, functions(spark, sf), large=40)


from siltstone.plans import more, sources, stored, third  # noqa: E402, F401  registers the rest
