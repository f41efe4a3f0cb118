"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import components, word_lists, written

SEED = 42
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each 1 if set in over half of the XXH64 of the word shingles; 0 without a word."""
    import xxhash

    digest, ones, n, kept = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    short = True
    for words in word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
        words = kept + words
        if len(words) >= shingle:
            short = False
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
            stop = (start + size)[shingle - 1 :]
            found = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist(), strict=False)]
            bits = np.unpackbits(np.array(found, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            n += len(found)
            kept = words[len(words) - shingle + 1 :]
        else:
            kept = words
    if short:
        return digest(b" ".join(kept), SEED) if kept else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two tiles: (value, smallest value it is linked with here)."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        if len(i):
            u, v = np.concatenate((u, a[i + at].view(np.int64))), np.concatenate((v, b[j].view(np.int64)))
            if len(u) > 1 << 20:
                u, v = spanning(u, v)
    return spanning(u, v)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links each value with the smallest of its component, instead of any number of links."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(nodes: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct fp of nodes at most radius bits apart, and no others.

    A cell holds the values with the same number of ones in either half; cells whose counts differ by
    more than radius cannot hold a link and are skipped. Large cells are dealt into tiles, and each
    pair of tiles that remains is compared in full. What a pair returns is at most one link a value.
    """
    spark = nodes.sparkSession
    cell = nodes.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(LOW))).alias("lo")
    )
    # at most 33 x 33 rows
    counts = cell.groupBy("hi", "lo").count().collect()
    size = {(r.hi, r.lo): -(-r["count"] // tile) for r in counts}
    cells = spark.createDataFrame([(h, w, n) for (h, w), n in size.items()], "hi int, lo int, subs int")
    mates = spark.createDataFrame(
        [
            (*c, n, *d, size[d], c == d)
            for c, n in size.items()
            for x in range(radius + 1)
            for y in range(x - radius, radius - x + 1)
            if (x or y >= 0) and (d := (c[0] + x, c[1] + y)) in size
        ],
        "hi int, lo int, subs int, hi2 int, lo2 int, subs2 int, same boolean",
    )
    tiles = (
        cell.join(F.broadcast(cells), ["hi", "lo"])
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        .groupBy("hi", "lo", "sub")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = written(tiles, "tiles")
    pairs = (
        mates.withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
        .withColumn("sub2", F.explode(F.expr("sequence(if(same, sub, 0), subs2 - 1)")))
        .withColumn("same", F.expr("same and sub = sub2"))
    )
    other = tiles.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("sub").alias("sub2"), F.col("fps").alias("fps2"))
    work = pairs.join(tiles, ["hi", "lo", "sub"]).join(other, ["hi2", "lo2", "sub2"]).select("same", "fps", "fps2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.ascontiguousarray(batch.column(c)[k].values.to_numpy()).view(np.uint64) for c in (1, 2))
                a, b = close_pairs(x, y, radius, batch.column(0)[k].as_py())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text).

    Fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id that can
    be reached, the row's own included. Equal fingerprints are one node, so that copies cost one
    comparison. Null and empty texts have fingerprint 0 and link like any other; a null doc_id gets a
    row and is never a component_id unless all of its component are null; repeated rows stay; an
    empty table gives none; other columns are ignored. A fingerprint of more than a thousandth of all rows,
    of which there are less than a thousand, is looked up where its rows are read; others meet theirs by a shuffle.
    """
    marks = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(written(links(nodes, radius, tile), "links")).withColumnRenamed("node", "fp")
    linked = roots.join(nodes, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")
    of = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "classes")
    total = of.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(of.filter(F.col("n") * 1000 > total).select("fp", F.struct("component_id").alias("hit")))
    met = marks.join(often, "fp", "left")
    rest = met.filter("hit is null").drop("hit").join(of.filter(F.col("n") * 1000 <= total), "fp").select("doc_id", "fp", "component_id")
    return met.filter("hit is not null").select("doc_id", "fp", "hit.component_id").union(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, text_hash, n) of the one document that stays of each group: that with the smallest id, null ids last; n rows are alike."""
    marks = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marks.select("fp").distinct(), "nodes")
    roots = components(written(links(nodes, radius, tile), "links")).withColumnRenamed("node", "fp")
    rows = marks.groupBy("doc_id", "text_hash", "fp").count().join(roots, "fp", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "count")).alias("first")
    return rows.groupBy(F.coalesce("root", "fp").alias("root")).agg(first).select("first.doc_id", "first.text_hash", F.col("first.count").alias("n"))
