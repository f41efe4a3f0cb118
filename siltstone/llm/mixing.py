"""Mixing of sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import WORD, written

#: How many passes over a source a mix may take.
MOST_PASSES = 3


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, source, size, text_hash, key): words of each text, and a random key that is the same in every run."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(F.col("text").cast("string")).cast("string")))).alias("key"),
    )


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Each gets level * weight words, but at
    most MOST_PASSES times what it has; the level is such that all get the sum of all sizes. In order of
    limit / weight, the sources up to some place are at their limit and the others share the rest, so
    the level follows from running sums: of the places whose level leaves their own source below its
    limit it is the highest. One row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    of = (
        totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
        .withColumn("limit", (F.col("source_size") * MOST_PASSES).cast("double"))
        .withColumn("rest", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("try", F.col("rest") / F.col("weights"))
    )
    level = F.max(F.when(F.col("try") * F.col("weight") <= F.col("limit"), F.col("try"))).over(everything)
    return of.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_hash) of every row of docs(doc_id, text, source).

    Documents of a source are in the order of their keys. The mix takes whole passes over a source while
    its target allows, then documents in that order up to its exact target, rounded to words; the
    document at the cut gives its first words alone. taken counts words, repeats included. Prefix sums
    run within ranges of the keys of a source, on top of the sums of the ranges before, so that no
    task holds a source. Null texts have size 0; a null source is a source; rows with one doc_id have one
    key and are taken in order of size and text, rows without one get their key from the text; an empty
    table gives no rows; other columns are ignored.
    """
    base = written(sizes(docs, seed), "sizes")
    # so many ranges that one holds a few thousand documents, whatever the size of the input
    digits = max(2, (max(1, base.count() // 4096).bit_length() + 3) // 4)
    base = base.withColumn("part", F.substring("key", 1, digits))
    ranges = written(base.groupBy("source", "part").agg(F.sum("size").alias("words")), "ranges")
    of = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    ranges = ranges.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).drop("words")
    ranges = ranges.join(of.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    ranges = ranges.select(F.col("source").alias("name"), F.col("part").alias("range"), "before", "source_size", "target")
    order = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.col("within"), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    full = F.expr("least({0}, case when source_size = 0 then 0 else floor(target + 0.5) div source_size end)".format(MOST_PASSES))
    return (
        base.withColumn("within", F.sum("size").over(order))
        .join(ranges, F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("range")))
        .withColumn("passes", full.cast("long"))
        .withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("passes") * F.col("source_size") - at)))
        .withColumn("taken", F.least(F.lit(MOST_PASSES) * F.col("size"), F.col("passes") * F.col("size") + F.col("cut")).cast("long"))
        .select("doc_id", "source", "size", F.col("source_size").cast("long"), "target", "taken", "text_hash")
    )


def first_words(text: Column, n: Column) -> Column:
    """A text up to its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n), "")


SQL = r"""
WITH base AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
    CAST(source_size * 3 AS DOUBLE) AS most FROM totals),
tried AS (
  SELECT *,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER w, 0.0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(most, weight * max(CASE WHEN level * weight <= most THEN level END) OVER ()) AS target FROM tried),
placed AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.target,
    CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(least(3, CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target + 0.5) AS BIGINT) // t.source_size END) AS BIGINT) AS passes,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(least(3 * size, passes * size + greatest(0, least(size, budget - passes * source_size - words_before))) AS BIGINT) AS taken
FROM placed
"""
