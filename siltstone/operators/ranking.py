"""Evaluation of rankings and scores, and the training of small linear rankers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from operator import mul, sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ratio
from siltstone.functions.tables import ROWS, discard, in_order, stored


def retrieval(judged: DataFrame, k: int, group: str = "query") -> DataFrame:
    """One row of means over groups with a relevant item: reciprocal rank, precision, recall and nDCG at k. judged: (query, item, score, relevant)."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "item"))
    gain = 1 / F.log2(F.col("n") + 1)
    per = judged.withColumn("n", n).groupBy(group).agg(
        F.count_if("relevant").alias("relevant"),
        F.min(F.when(F.col("relevant"), F.col("n"))).alias("first"),
        F.count_if(F.col("relevant") & (F.col("n") <= k)).alias("found"),
        F.sum(F.when(F.col("relevant") & (F.col("n") <= k), gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    has = F.col("relevant") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(has, c)), F.lit(0.0))
    return per.agg(
        F.count("*").alias("queries"), F.count_if(has).alias("evaluated"), mean(1 / F.col("first")).alias("mrr"), mean(F.col("found") / k).alias("precision"),
        mean(F.col("found") / F.nullif("relevant", F.lit(0))).alias("recall"), mean(F.col("dcg") / ideal).alias("ndcg"),
    )


def score_errors(judged: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score, log loss and expected calibration error of judged(score, relevant)."""
    y = F.col("relevant").cast("double")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
    part = judged.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("score").alias("scores"), F.sum(y).alias("hits"), F.sum((F.col("score") - y) * (F.col("score") - y)).alias("squares"), F.sum(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("losses")
    )
    n = F.sum("n")
    return part.agg(n.alias("samples"), (F.sum("squares") / n).alias("brier"), (F.sum("losses") / n).alias("log_loss"), (F.sum(F.abs(F.col("scores") - F.col("hits"))) / n).alias("calibration_error"))


def pair_agreement(judged: DataFrame, group: str = "query") -> DataFrame:
    """One row (pairs, agreement): how often a relevant item scores above another of its group, ties counting half; from counts by score."""
    n = judged.groupBy(group, "score").agg(F.count_if("relevant").alias("p"), F.count_if(~F.col("relevant")).alias("q"))
    order = Window.partitionBy(group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = n.withColumn("below", F.coalesce(F.sum("q").over(order), F.lit(0)))
    per = below.groupBy(group).agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return per.agg(F.sum(F.col("p") * F.col("q")).alias("pairs"), ratio(F.sum("won"), F.sum(F.col("p") * F.col("q"))).cast("double").alias("agreement"))


def answerability(judged: DataFrame, thresholds: Iterable[float], group: str = "query") -> DataFrame:
    """(threshold, tp, fp, fn, tn): whether a group's best score reaches a threshold against whether it has a relevant item."""
    best = judged.groupBy(group).agg(F.max("score").alias("best"), F.bool_or("relevant").alias("yes"))
    each = best.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    said = F.col("best") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(said & F.col("yes")).alias("tp"), F.count_if(said & ~F.col("yes")).alias("fp"), F.count_if(~said & F.col("yes")).alias("fn"), F.count_if(~said & ~F.col("yes")).alias("tn"))


def accuracy(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    said = F.col("score") >= threshold
    return judged.agg(F.count("*").alias("samples"), F.count_if(said == F.col("relevant")).alias("correct"), F.count_if(said & ~F.col("relevant")).alias("false_positives"), F.count_if(~said & F.col("relevant")).alias("false_negatives"))


def kappa(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (n, agreement, kappa) of two yes-or-no judgments; kappa is null if chance explains all."""
    found = pairs.select(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if("a").alias("x"), F.count_if("b").alias("y"))
    n = F.col("n")
    seen, chance = F.col("same") / n, (F.col("x") * F.col("y") + (n - F.col("x")) * (n - F.col("y"))) / (n * n)
    return found.select("n", seen.alias("agreement"), ((seen - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def balanced(per_query: DataFrame, repository: str, value: str) -> DataFrame:
    """Mean over repositories of the means over their queries."""
    return per_query.groupBy(repository).agg(F.avg(value).alias("m")).agg(F.count("*").alias("repositories"), F.avg("m").alias("balanced"))


def leave_one_out(per: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, rest): the mean of all the others."""
    t = per.agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(t)).select(key, value, ((F.col("s") - F.col(value)) / F.nullif(F.col("n") - 1, F.lit(0))).alias("rest"))


def contradictions(judged: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys with more than one label."""
    return judged.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).filter("labels > 1")


def split_problems(parts: DataFrame) -> DataFrame:
    """Families that occur in more than one split of parts(family, split)."""
    return parts.groupBy("family").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


#: A bound on labelled rows, or on pairs of them, that a caller may set: more raise. None by itself.
MOST_LABELS: int | None = None
#: A link of the chain that descends holds about so many rows.
LINK = 500_000


def bounded(n: int, what: str) -> None:
    if MOST_LABELS is not None and n > MOST_LABELS:
        raise ValueError(f"{what}: more than {MOST_LABELS} labelled rows or pairs")


def descend(w: list[float], v: list[float], slope: Callable[[float], float], rate: float, l2: float) -> list[float]:
    """Weights after a step over v; slope gives the loss's slope at a margin."""
    s = slope(1 / (1 + math.exp(-max(-32.0, min(32.0, sum(map(mul, w, v)))))))
    return [x - rate * (s * y + l2 * x) for x, y in zip(w, v, strict=True)]


def chained(rows: DataFrame, features: list[str], epochs: int, epoch: Callable[[list[float], Iterator[pa.RecordBatch]], list[float]]) -> DataFrame:
    """(feature, weight) after epochs over rows(link, place, ...), a stored table: each link in order, which one task at a time goes through from the weights of the link before.

    Steps depend on each other, so that links follow one another; a task holds a link, and what goes from
    link to link is a row of weights. A single link runs all its epochs in one task.
    """
    spark = rows.sparkSession
    links = [r[0] for r in rows.select("link").distinct().orderBy("link").collect()]
    w = [0.0] * len(features)
    for _ in range(1 if len(links) == 1 else epochs):
        for k in links:
            w = _link(rows, k, w, epochs if len(links) == 1 else 1, epoch)
    discard(rows)
    return spark.createDataFrame(list(zip(features, w, strict=True)), "feature string, weight double").coalesce(1)


def _link(rows: DataFrame, k: int, w: list[float], times: int, epoch: Callable[[list[float], list[pa.RecordBatch]], list[float]]) -> list[float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = list(batches), w
        for _ in range(times):
            now = epoch(now, held)
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.list_(pa.float64()))], ["w"])

    one = rows.filter(F.col("link") == k).drop("link").coalesce(1).sortWithinPartitions("place")
    return list(one.mapInArrow(run, "w array<double>").first()[0])


def fit_logistic(rows: DataFrame, features: list[str], label: str, rate: float = 0.05, l2: float = 0.001, epochs: int = 20) -> DataFrame:
    """(feature, weight) of a logistic model by stochastic gradient descent over sorted rows, the same each time.

    Steps depend on each other: rows are dealt into links of LINK in their order, however many there are.
    """
    rows = rows.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("__y"))
    if MOST_LABELS is not None:
        bounded(rows.limit(MOST_LABELS + 1).count(), "fit_logistic")
    placed = in_order(rows, [*map(F.col, features), F.col("__y")])
    n = len(features)

    def epoch(w: list[float], batches: list[pa.RecordBatch]) -> list[float]:
        for batch in batches:
            for *v, y in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(n + 1)), strict=True):
                w = descend(w, v, lambda p, y=y: p - y, rate, l2)
        return w

    link = F.floor((F.col("place") - 1) / LINK).cast("int")
    return chained(stored(placed.select(*features, "__y", "place", link.alias("link")), "links"), features, epochs, epoch)


#: Blocks of pairs hold about so many; a lane of a block takes about so many steps, and from so many lanes on they are stepped side by side.
PAIRS, LANE, LANES = 1 << 24, 1 << 15, 16
#: Weights are looked at after so many steps of a lane. Lanes and blocks that began with other weights than those before them ended with go again together so often, then one by one.
CHUNK, ROUNDS = 256, 8


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which columns of weights are equal, bit by bit."""
    return (np.ascontiguousarray(a).view(np.int64) == np.ascontiguousarray(b).view(np.int64)).all(0)


class Pairs:
    """The steps of a block: each item ahead with all that are behind in its group, in the order of items.

    Steps follow one another, but what a step does depends on the weights alone: from equal weights, equal steps lead
    to equal weights. So lanes of steps begin side by side with any weights, and those that did not begin with
    what the lane before them ended with go again, until they come to weights that they had at the same
    step; the result is that of one step after another, to the bit.
    """

    def __init__(self, items: np.ndarray, ahead: np.ndarray, group: np.ndarray, rate: float, l2: float):
        behind = group[~ahead]
        self.rate, self.l2 = rate, l2
        self.behind = np.ascontiguousarray(items[~ahead].T)
        off = np.searchsorted(behind, group[ahead], "left")
        size = np.searchsorted(behind, group[ahead], "right") - off
        some = size > 0
        self.ahead, self.off, self.size = np.ascontiguousarray(items[ahead][some].T), off[some], size[some]
        ends = np.cumsum(self.size)
        self.first, self.total = ends - self.size, int(ends[-1]) if len(ends) else 0
        count = max(1, self.total // LANE)
        lane = self.first * count // max(1, self.total)
        self.begin = self.first[np.flatnonzero(np.diff(lane, prepend=-1))]
        self.steps = np.diff(self.begin, append=self.total)
        self.known: tuple | None = None

    def plain(self, w: list[float]) -> list[float]:
        behind = self.behind.T.tolist()
        for p, off, size in zip(self.ahead.T.tolist(), self.off.tolist(), self.size.tolist(), strict=True):
            for q in behind[off : off + size]:
                w = descend(w, list(map(sub, p, q)), lambda x: x - 1, self.rate, self.l2)
        return w

    def run(self, lanes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The weights, a column for each lane, that lanes come to from w."""
        order = lanes[np.argsort(-self.steps[lanes], kind="stable")]
        of = np.argsort(-self.steps[lanes], kind="stable")
        w, out, t, rate, l2 = w[:, of].copy(), w.copy(), 0, self.rate, self.l2
        while len(order):
            steps = self.steps[order]
            n = int(min(CHUNK, steps[0] - t))
            at = np.minimum(self.begin[order] + t + np.arange(n)[:, None], self.total - 1)
            row = self.row[at]
            behind = (self.off - self.first)[row] + at
            v = np.stack([p[row] - q[behind] for p, q in zip(self.ahead, self.behind, strict=True)], 1)
            going = np.searchsorted(-steps, -(t + np.arange(n)), "left")
            now, at_once = w, 0
            for x, m in zip(v, going.tolist(), strict=True):
                if m != at_once:
                    now, at_once = w[:, :m], m
                    z, a, b = np.empty(m), *np.empty((2, len(w), m))
                x = x[:, :m]
                np.multiply(now, x, a)
                np.copyto(z, a[0])
                for y in a[1:]:
                    np.add(z, y, z)
                np.minimum(z, 32.0, z)
                np.maximum(z, -32.0, z)
                np.negative(z, z)
                np.exp(z, z)
                np.add(z, 1.0, z)
                np.divide(1.0, z, z)
                np.subtract(z, 1.0, z)
                np.multiply(x, z, a)
                np.multiply(now, l2, b)
                np.add(a, b, a)
                np.multiply(a, rate, a)
                np.subtract(now, a, now)
            t += n
            done = steps <= t
            out[:, of[done]] = w[:, done]
            mark = t // CHUNK - 1
            if t % CHUNK == 0:
                if mark == len(self.marks):
                    self.marks.append(np.full((len(w), len(self.steps)), np.nan))
                met = ~done & same(self.marks[mark][:, order], w)
                out[:, of[met]] = self.end[:, order[met]]
                self.marks[mark][:, order] = w
                done |= met
            order, of, w = order[~done], of[~done], np.ascontiguousarray(w[:, ~done])
        return out

    def settled(self, w: list[float], known: tuple | None) -> tuple[list[float] | None, list[float]]:
        """The weights after the first lane and after all, from w; known are those from other weights, where there are any."""
        if len(self.steps) < LANES:
            return None, self.plain(w)
        self.row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        count = len(self.steps)
        start = np.array(w)[:, None]
        self.marks, self.end = [], np.full((len(w), count), np.nan)
        if known is not None and known[0] is not None and same(self.run(np.array([0]), start), np.array(known[0])[:, None]).all():
            return known
        begin, self.marks = np.repeat(start, count, 1), []
        self.end = self.run(np.arange(count), begin)
        for _ in range(ROUNDS):
            wanted = np.concatenate((start, self.end[:, :-1]), 1)
            wrong = np.flatnonzero(~same(wanted, begin))
            if not len(wrong):
                break
            begin = wanted
            self.end[:, wrong] = self.run(wrong, wanted[:, wrong])
        for k in range(1, count):
            if not same(self.end[:, k - 1 : k], begin[:, k : k + 1]).all():
                begin[:, k] = self.end[:, k - 1]
                self.end[:, k : k + 1] = self.run(np.array([k]), begin[:, k : k + 1])
        return self.end[:, 0].tolist(), self.end[:, -1].tolist()


def bits(w: list[float]) -> bytes:
    return np.array(w).tobytes()


def _blocks(rows: DataFrame, features: list[str], asked: dict[int, tuple], times: int, rate: float, l2: float) -> dict[int, tuple]:
    """What blocks(block, place, first, ahead, features) come to, a task each: asked says with what weights each begins and what it is known to come to from others."""
    n, given, keys = len(features), [asked[k] for k in sorted(asked)], sorted(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        items = np.stack([whole.column(c).to_numpy() for c in features], 1)
        pairs = Pairs(items, whole.column("ahead").to_numpy(), whole.column("first").to_numpy(), rate, l2)
        k = whole.column("number")[0].as_py()
        w, known = given[k]
        for _ in range(times):
            before, (head, w) = w, pairs.settled(w, known)
            if bits(before) == bits(w):
                break
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([head], pa.list_(pa.float64())), pa.array([w], pa.list_(pa.float64()))], ["number", "head", "w"])

    number = F.array_position(F.lit(keys), F.col("block")).cast("int") - 1
    some = rows.filter(F.col("block").isin(keys)).withColumn("number", number) if len(keys) > 1 else rows.filter(F.col("block") == keys[0]).withColumn("number", F.lit(0))
    dealt = some.repartitionById(len(keys), F.col("number")).sortWithinPartitions("place").select("number", "first", "ahead", *features)
    return {keys[r.number]: (r.head, r.w) for r in dealt.mapInArrow(run, "number int, head array<double>, w array<double>").collect()}


def fit_pairwise(rows: DataFrame, features: list[str], label: str, group: str, rate: float = 0.05, l2: float = 0.001, epochs: int = 20) -> DataFrame:
    """(feature, weight) from pairs of a relevant and another item of one group, by the same descent.

    Pairs are made where they are stepped over, never listed; steps are as many as pairs, which grow with the
    square of a group. Blocks of about PAIRS steps go side by side, a task each that holds some items ahead
    and all behind of their groups, and again where they began with other weights than those before them
    ended with (see Pairs). An epoch that ends as it began is the last that changes anything.
    """
    if MOST_LABELS is not None:
        pairs = rows.groupBy(group).agg(F.count_if(F.col(label) != 0).alias("y"), F.count_if(F.col(label) == 0).alias("n")).agg(F.sum(F.col("y") * F.col("n"))).first()[0]
        bounded(pairs or 0, "fit_pairwise")
    names = [f"f{k}" for k in range(len(features))]
    rows = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("__g"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)), F.col(label).cast("double").alias("__y"))
    placed = stored(in_order(rows, [F.col("__g"), *map(F.col, names), F.col("__y")]).withColumn("ahead", F.coalesce(F.col("__y") != 0, F.lit(True))), "placed")
    groups = placed.groupBy("__g").agg(F.min("place").alias("first"), F.count_if("ahead").alias("p"), F.count_if(~F.col("ahead")).alias("q")).filter("p > 0 and q > 0")
    # an item costs as much as it takes for LINK of them to fill a block
    item = PAIRS / LINK
    groups = groups.withColumn("cost", F.col("q") + item * (1 + F.col("q") / F.col("p"))).withColumn("part", F.floor(F.col("first") / ROWS))
    groups = stored(groups, "groups")
    sums = groups.groupBy("part").agg(F.sum(F.col("cost") * F.col("p")).alias("sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("sum").over(earlier(Window.orderBy("part"))), F.lit(0.0)).alias("before"))
    within = F.coalesce(F.sum(F.col("cost") * F.col("p")).over(earlier(Window.partitionBy("part").orderBy("first"))), F.lit(0.0))
    begins = groups.withColumn("within", within).join(sums, "part").select("__g", "first", "p", "cost", (F.col("before") + F.col("within")).alias("before"))
    block = lambda k: F.floor((F.col("before") + k * F.col("cost")) / PAIRS).cast("long")
    nth = F.row_number().over(Window.partitionBy("__g").orderBy("place")) - 1
    ahead = placed.filter("ahead").withColumn("nth", nth).join(begins, "__g").withColumn("block", block(F.col("nth")))
    behind = placed.filter("not ahead").join(begins, "__g").withColumn("block", F.explode(F.sequence(block(F.lit(0)), block(F.col("p") - 1))))
    linked = stored(ahead.select("block", "place", "first", "ahead", *names).union(behind.select("block", "place", "first", "ahead", *names)), "links")
    discard(placed, groups)
    keys = [r[0] for r in linked.select("block").distinct().orderBy("block").collect()]
    w = [0.0] * len(features)
    begin, known = {k: w for k in keys}, {}
    go = lambda ks, times=1: known.update(_blocks(linked, names, {k: (begin[k], known.get(k)) for k in ks}, times, rate, l2))
    if len(keys) == 1 and epochs:
        go(keys, epochs)
        w = known[keys[0]][1]
    elif epochs:
        go(keys)
        for epoch in range(epochs):
            if epoch and bits(begin[keys[0]]) == bits(w):
                break
            turn, wrong = 0, keys
            while wrong:
                wanted = dict(zip(keys, [w, *(known[k][1] for k in keys[:-1])], strict=True))
                wrong = [k for k in keys if bits(wanted[k]) != bits(begin[k])]
                wrong, turn = wrong if turn < ROUNDS else wrong[:1], turn + 1
                begin.update((k, wanted[k]) for k in wrong)
                if wrong:
                    go(wrong)
            w = known[keys[-1]][1]
    discard(linked)
    return rows.sparkSession.createDataFrame(list(zip(features, w, strict=True)), "feature string, weight double").coalesce(1)


def within_budget(items: DataFrame, by: str, cost: str, order: list[str], budget: int) -> DataFrame:
    """Items of each task that fit a budget, in order: one that does not fit is skipped, later smaller ones may still fit."""
    rows = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(cost).alias("c")))).alias("x"))
    kept = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("used"), F.filter("x", lambda _: F.lit(False)).alias("k")), lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.array_append(s["k"], x).alias("k"))).otherwise(s))
    return rows.select(by, F.posexplode(kept["k"]).alias("place", "i")).select(by, "place", *(f"i.{o}" for o in order), F.col("i.c").alias(cost))


def task_counts(labels: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, questions, answerable, unanswerable, labels, positive, negative) for each kind of question, those without questions too.

    labels(question, kind, relevant); a question is answerable if some evidence of it is relevant.
    """
    per = labels.groupBy("question", "kind").agg(F.count("*").alias("labels"), F.count_if("relevant").alias("positive"))
    n = per.groupBy("kind").agg(F.count("*").alias("questions"), F.count_if(F.col("positive") > 0).alias("answerable"), F.sum("labels").alias("labels"), F.sum("positive").alias("positive"))
    every = labels.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    out = every.join(n, "kind", "left").na.fill(0)
    return out.select("kind", "questions", "answerable", (F.col("questions") - F.col("answerable")).alias("unanswerable"), "labels", "positive", (F.col("labels") - F.col("positive")).alias("negative"))
