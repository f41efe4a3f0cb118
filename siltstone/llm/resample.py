"""Target-distribution importance resampling: packed bucket streams, counts by sorting and run lengths, gains gathered by offsets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.tables import in_order
from siltstone.llm.shared import crc32_sql, discard, written

#: Words of lower-cased text: ASCII digits and letters, and all beyond ASCII, which in UTF-8 has no byte below 80.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
STREAMS = "ids array<long>, hashes array<long>, words array<long>, sizes array<long>, stream binary"


def buckets_of(raw: bytes, most: int, buckets: int, piece: int = 1 << 20) -> tuple[int, list[np.ndarray]]:
    """How many words a text has, and the buckets of its features, in parts of about a piece of text each."""
    raw_end, at, n, found, kept = len(raw), 0, 0, [], []
    while at < raw_end:
        stop = min(raw_end, at + piece)
        if stop < raw_end:
            gap = _GAP.search(raw, stop)
            stop = gap.start() if gap else raw_end
        words = WORDS.findall(raw[at:stop].lower())
        at, n = stop, n + len(words)
        for width in range(1, most + 1):
            # features that end in this part: those of more than one word may start in the part before
            run = words if width == 1 else [b" ".join(x) for x in zip(*((kept[len(kept) - width + 1 :] + words)[k:] for k in range(width)), strict=False)]
            found.append((np.fromiter(map(crc32, run), np.uint32, len(run)) % buckets).astype(np.uint16))
        kept = (kept + words)[-most + 1 :] if most > 1 else []
    return n, found


def streams(docs: DataFrame, id_column: str, most: int = 1, buckets: int = 10000, block: int = 1 << 21) -> DataFrame:
    """Packed uint16 buckets of the features of all texts, with the documents' offsets as their sizes: a row for about a block of them.

    A document stands in one row whole, with its id, the hash of its text and its number of words.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is an unsigned 16-bit integer: buckets must be between 1 and 65536")

    def packed(held: list) -> pa.RecordBatch:
        ids, hashes, words, sizes, parts = zip(*held, strict=True)
        data = b"".join(p.astype("<u2").tobytes() for part in parts for p in part)
        columns = [pa.array([list(x)], pa.list_(pa.int64())) for x in (ids, hashes, words, sizes)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], ["ids", "hashes", "words", "sizes", "stream"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                n, parts = buckets_of(batch.column(2)[k].as_py() or b"", most, buckets)
                total = sum(map(len, parts))
                held.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), n, total, parts))
                size += total
                if size >= block or len(held) >= 1 << 16:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    text = F.col("text").cast("string")
    rows = docs.select(F.col(id_column).cast("long"), F.xxhash64(text), text.cast("binary")).toDF("id", "hash", "text")
    return rows.mapInArrow(run, STREAMS)


def counts(table: DataFrame, buckets: int = 10000) -> np.ndarray:
    """How often each bucket stands in the streams: sorted and run-length encoded block by block, runs added up by bucket.

    A task sends one row a bucket at most, and the driver gets no more than buckets rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                ordered = np.sort(np.frombuffer(data.as_buffer(), "<u2"))
                if len(ordered):
                    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                    total[ordered[start]] += np.diff(start, append=len(ordered))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in table.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share of a bucket over the source's), each with one more of every bucket."""
    n, s_all, t_all = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    ratio = ((float(target[k] + 1) * s_all) / (float(source[k] + 1) * t_all) for k in range(n))
    return np.fromiter((math.floor(1000 * math.log(x)) for x in ratio), np.int64, n)


def weights(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight): the sum of gains over each document's stretch of its stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, hashes, words, sizes = (batch.column(c)[k].values for c in range(4))
                size = sizes.to_numpy()
                found = gains[np.frombuffer(batch.column(4)[k].as_buffer(), "<u2")]
                start, some = np.cumsum(size) - size, size > 0
                weight = np.zeros(len(size), np.int64)
                if some.any():  # reduceat would give an empty stretch the value that follows it
                    weight[some] = np.add.reduceat(found, start[some])
                yield pa.RecordBatch.from_arrays([ids, hashes, words, sizes, pa.array(weight)], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    return table.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, text_hash, n_features, weight, score, rank) of every row of docs(doc_id, text): a draw without replacement towards target(item_id, text).

    The features are all runs of 1 to most words. The weight is the sum of their buckets' gains, the score
    adds Gumbel noise made from seed and doc_id, and the percent of documents of least_words words or more
    with the highest scores have ranks from 1; the rest has a null rank. Ties go to the smaller doc_id, then
    to the smaller hash of the text. Null and empty texts have no words, weight 0 and no rank; a null doc_id
    counts as an empty one for noise and comes after all others in ties; repeated rows count and are scored
    each; an empty table gives no rows, and an empty target gains as one of which each bucket is held alike;
    other columns are ignored.
    """
    table = written(streams(docs, "doc_id", most, buckets), "streams")
    aim = written(streams(target, "item_id", most, buckets), "target")
    gains = gains_of(counts(table, buckets), counts(aim, buckets))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weights(table, gains).withColumn("score", F.col("weight") + noise), "scores")
    discard(table, aim)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = in_order(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    return ranked.withColumn("rank", rank).unionByName(scored.filter(F.col("n_words") < least_words), allowMissingColumns=True).drop("n_words")


SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
said AS (SELECT doc_id, unnest(words) AS word FROM docs),
aimed AS (SELECT unnest(words) AS word FROM aims),
names AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM said UNION SELECT word FROM aimed)),
sources AS (SELECT bucket, count(*) AS s FROM said JOIN names USING (word) GROUP BY bucket),
targets AS (SELECT bucket, count(*) AS t FROM aimed JOIN names USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM said)::DOUBLE + 10000 AS s_all, (SELECT count(*) FROM aimed)::DOUBLE + 10000 AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * s_all) / ((coalesce(s, 0) + 1)::DOUBLE * t_all)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM names) LEFT JOIN sources USING (bucket) LEFT JOIN targets USING (bucket) CROSS JOIN sums),
sized AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM said JOIN names USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
noisy AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN sized USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank
FROM noisy LEFT JOIN placed USING (doc_id)
"""
