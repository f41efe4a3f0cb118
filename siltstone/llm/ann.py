"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import written

FAR = np.float32(np.inf)
INDEX = ["dim", "shard", "ids", "starts", "vectors", "graph", "entry"]
#: Vectors of a shard differ in length by less than this power of two.
BAND = 3
#: So many shards at most meet a block of queries that was sent once.
TOGETHER = 16


def beam_search(x: np.ndarray, norm: np.ndarray, out: np.ndarray, entry: int, q: np.ndarray, beam: int, hop: int = 4) -> np.ndarray:
    """The beam nearest points (places, -1 where fewer are reached, nearest first) that greedy search from entry finds for each row of q.

    Distances are squared ones less the query's own norm. Each step opens the hop nearest points of the
    beam that are not open yet, for all queries at once, until none is left.
    """
    b = len(q)
    row = np.arange(b)[:, None]
    seen = np.zeros((b, len(x)), bool)
    seen[:, entry] = True
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), FAR, np.float32)
    todo = np.zeros((b, beam), bool)
    ids[:, 0], dist[:, 0], todo[:, 0] = entry, norm[entry] - 2 * (q @ x[entry]), True
    while todo.any():
        at = np.argsort(np.where(todo, dist, FAR), axis=1, kind="stable")[:, :hop]
        open_ = todo[row, at]
        todo[row, at] = False
        near = np.where(open_[:, :, None], out[ids[row, at]], -1).reshape(b, -1)
        new = (near >= 0) & ~seen[row, near]
        order = np.argsort(near, axis=1, kind="stable")  # one point may be near two
        near, new = near[row, order], new[row, order]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[np.broadcast_to(row, near.shape)[new], near[new]] = True
        d = np.where(new, norm[near] - 2 * np.matmul(x[near], q[:, :, None])[:, :, 0], FAR)
        ids, dist = np.concatenate((ids, np.where(new, near, -1)), 1), np.concatenate((dist, d.astype(np.float32)), 1)
        todo = np.concatenate((todo, new), 1)
        keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, todo = ids[row, keep], dist[row, keep], todo[row, keep]
    return ids


def robust_prune(x: np.ndarray, norm: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of `of` at most degree of its candidates (-1: none): the nearest one left each time, without
    those that are alpha times nearer to it than to the point. A copy of a taken one is dropped with it."""
    row = np.arange(len(of))
    v = x[cand]
    d = norm[cand] + norm[of][:, None] - 2 * np.matmul(v, x[of][:, :, None])[:, :, 0]
    order = np.argsort(cand, axis=1, kind="stable")
    again = np.zeros(cand.shape, bool)
    ranked = np.take_along_axis(cand, order, 1)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    d = np.where((cand < 0) | (cand == of[:, None]) | again, FAR, np.maximum(d, 0))
    pair = norm[cand][:, :, None] + norm[cand][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(of), degree), -1, np.int32)
    for r in range(degree):
        k = d.argmin(1)
        live = np.isfinite(d[row, k])
        if not live.any():
            break
        out[live, r] = cand[row, k][live]
        d = np.where(alpha * alpha * np.maximum(pair[row, k], 0) <= d, FAR, d)
        d[row, k] = FAR
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 256) -> tuple[np.ndarray, int]:
    """(out-edges of each point, entry point). Points are different; edges per point are at most degree."""
    n = len(x)
    norm = np.einsum("ij,ij->i", x, x)
    entry = int((norm - 2 * (x @ x.mean(0))).argmin())
    out = np.full((n, degree), -1, np.int32)
    used = np.zeros(n, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + size, min(2 * size, batch)
        cand = beam_search(x, norm, out, entry, x[new], beam)
        own = robust_prune(x, norm, new, cand, degree, alpha)
        out[new], used[new] = own, (own >= 0).sum(1)
        src, k = np.nonzero(own >= 0)  # each edge also the other way round
        to, back = own[src, k].astype(np.int64), new[src]
        o = np.argsort(to, kind="stable")
        to, back = to[o], back[o]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        fits = np.repeat(used[node] + count <= degree, count)
        out[to[fits], (used[to] + place)[fits]] = back[fits]
        full = used[node] + count > degree
        used[node[~full]] += count[~full]
        node, first, count = node[full], first[full], count[full]
        o = np.argsort(count, kind="stable")
        for part in np.array_split(o, max(1, len(o) // 64)) if len(o) else []:
            width = degree + int(count[part].max())
            more = np.full((len(part), width), -1, np.int64)
            more[:, :degree] = out[node[part]]
            for j, p in enumerate(part):
                more[j, degree : degree + count[p]] = back[first[p] : first[p] + count[p]]
            kept = robust_prune(x, norm, node[part], more, degree, alpha)
            out[node[part]], used[node[part]] = kept, (kept >= 0).sum(1)
    return out, entry


def raised(v: np.ndarray) -> np.ndarray:
    """Vectors in units of the longest, with one more component, which makes all as long as it: then the nearest has the largest inner product.

    Components are first divided by the largest, so that squares neither overflow nor vanish; as vectors of a
    shard are of similar length, the added component does not outweigh the others in 32 bits.
    """
    v = v / np.abs(v).max()
    v /= np.sqrt(np.einsum("ij,ij->i", v, v).max())
    norm = np.einsum("ij,ij->i", v, v)
    return np.concatenate((v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]), 1).astype(np.float32)


def usable(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return embeddings.select(F.col("vec_id").cast("long"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine).withColumn("dim", F.size("v"))


def length_band(v: Column) -> Column:
    """A number for vectors of similar length, by the logarithm of the length; those of about length 1 share one.

    Only where squares leave the range of doubles are components divided by the largest first.
    """
    plain = F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    most = F.array_max(F.transform(v, F.abs))
    scaled = F.log2(most) + F.log2(F.aggregate(v, F.lit(0.0), lambda s, e: s + (e / most) * (e / most))) / 2
    length = F.when((plain > 1e-250) & (plain < 1e250), F.log2(plain) / 2).otherwise(scaled)
    return F.floor(length / BAND + 0.5).cast("int")


def build_index(vectors: DataFrame, shard_rows: int, degree: int, beam: int, alpha: float) -> tuple[DataFrame, dict[int, int]]:
    """One row a shard with its different vectors, the ids that have each, and the graph over them; and how many shards vectors of each dimension have.

    Vectors are dealt by length first, then by hash: a dimension has some 700 bands of lengths at most.
    """
    vectors = vectors.withColumn("band", length_band(F.col("v")))
    shards: dict[int, int] = {}
    dealing = []
    for r in sorted(vectors.groupBy("dim", "band").count().collect()):
        n = -(-r["count"] // shard_rows)
        dealing.append((r.dim, r.band, shards.get(r.dim, 0), n))
        shards[r.dim] = shards.get(r.dim, 0) + n
    sizes = vectors.sparkSession.createDataFrame(dealing, "dim int, band int, first int, shards int")

    def run(rows: pa.Table) -> pa.Table:
        dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
        v = rows.column("v").combine_chunks().values.to_numpy().reshape(-1, dim) + 0.0
        ids = rows.column("vec_id").to_numpy()
        o = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[o], ids[o]
        differ = np.concatenate(([True], (v[1:] != v[:-1]).any(1)))
        fresh = differ | np.concatenate(([True], ids[1:] != ids[:-1]))  # a repeated row counts once
        v, ids, differ = v[fresh], ids[fresh], differ[fresh]
        start = np.flatnonzero(differ)
        out, entry = build_graph(raised(v[start]), degree, beam, alpha)
        own = v[start].astype(np.float32)  # kept short if that loses nothing
        own = own if (own == v[start]).all() else v[start]
        blobs = [pa.array([a.tobytes()], pa.binary()) for a in (ids, np.append(start, len(ids)).astype(np.int64), own, out)]
        return pa.table([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *blobs, pa.array([entry], pa.int32())], names=INDEX)

    dealt = vectors.join(F.broadcast(sizes), ["dim", "band"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    # by number, so that small shards are not put together into a few tasks
    dealt = dealt.repartition(min(10_000, max(1, sum(shards.values()))), "dim", "shard")
    index = dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, ids binary, starts binary, vectors binary, graph binary, entry int")
    return written(index, "graphs"), shards


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = 96, shard_rows: int = 4096, degree: int = 32, build_beam: int = 64, alpha: float = 1.2, block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of embeddings(vec_id, embedding) that are found for each of queries.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and a row's own id
    is no candidate. All rows are dealt into shards of about shard_rows by their length, and those of similar
    length by their id's hash, so that a frequent vector is spread and 32 bits tell distances apart; a shard's graph holds each different vector once, with all its ids.
    Queries go in blocks to every shard, and are sent once for up to TOGETHER of them; the best k of all shards follow from exact scores. Rows whose
    vector is null, zero or has a null or non-finite component, or whose vec_id is null, take no part;
    vectors of another length are not compared; repeated rows count once, and of several vectors of one
    query id the smallest is asked; fewer than k candidates give
    fewer rows, an empty table none; other columns are ignored.
    """
    vectors = usable(embeddings)
    index, shards = build_index(vectors, shard_rows, degree, build_beam, alpha)
    # few shards each have a task of their own
    together = max(1, min(TOGETHER, sum(shards.values()) // 64))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = {r.dim: -(-r["count"] // block) for r in asked.groupBy("dim").count().collect()}
    sizes = embeddings.sparkSession.createDataFrame([(d, shards[d], n) for d, n in blocks.items() if d in shards], "dim int, shards int, blocks int")
    asked = (
        asked.join(F.broadcast(sizes), "dim")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
        .groupBy("dim", "block", "shards")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
        .withColumn("some", F.explode(F.expr(f"sequence(0, (shards - 1) div {together})")))
        .select("dim", "some", F.col("q.vec_id").alias("query"), F.flatten("q.v").alias("values"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, entry = batch.column("dim")[r].as_py(), batch.column("entry")[r].as_py()
                ids, starts, raw, out = (batch.column(c)[r].as_buffer() for c in INDEX[2:6])
                ids, starts, out = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(out, np.int32).reshape(-1, degree)
                v = np.frombuffer(raw, np.float32 if raw.size == 4 * dim * len(out) else np.float64).reshape(-1, dim).astype(np.float64)
                q, own = batch.column("values")[r].values.to_numpy().reshape(-1, dim), batch.column("query")[r].values.to_numpy()
                x = raised(v)
                scale = np.abs(q).max(1, keepdims=True)
                found = beam_search(x, np.einsum("ij,ij->i", x, x), out, entry, np.pad(q / scale, ((0, 0), (0, 1))).astype(np.float32), beam)
                j, place = np.nonzero(found >= 0)
                at = found[j, place]
                score = (q[j] * v[at]).sum(1)
                many = np.minimum(starts[at + 1] - starts[at], k + 1)  # the smallest ids of equal vectors
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                j, score, cand = np.repeat(j, many), np.repeat(score, many), ids[np.repeat(starts[at], many) + offset]
                keep = cand != own[j]
                j, score, cand = j[keep], score[keep], cand[keep]
                o = np.lexsort((cand, -score, j))
                j, score, cand = j[o], score[o], cand[o]
                rank = np.arange(len(j)) - np.searchsorted(j, j)
                best = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(own[j[best]]), pa.array(cand[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    n = min(10_000, max(1, sum(shards.values()) // together))
    index = index.withColumn("some", F.expr(f"shard div {together}"))
    met = asked.withColumn("some", F.col("some").cast("long")).repartition(n, "dim", "some").join(index.repartition(n, "dim", "some"), ["dim", "some"])
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
