"""Operators over directed graphs: edges(src, dst)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import round4
from siltstone.functions.tables import discard, stored


def edges_of(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight, confidence) of pairs(src, dst, confidence): a module's edge counts what it stands for and has the best confidence."""
    return pairs.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"))


def coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability) of nodes(node); instability is null for nodes alone."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    n = nodes.select("node").join(out, "node", "left").join(into, "node", "left").na.fill(0, ["fan_in", "fan_out"])
    return n.withColumn("instability", round4(F.col("fan_out") / F.nullif(F.col("fan_in") + F.col("fan_out"), F.lit(0))))


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    seen = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.select("node").join(seen, "node", "left_anti")


def apart(df: DataFrame) -> DataFrame:
    """df, met by a shuffle in joins: what is joined round after round would add up at the driver if it were broadcast."""
    return df.hint("merge")


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node of its strongly connected component.

    Each round takes a node or more from what is left, until there is none; a bound on rounds is a
    safeguard that raises when it is reached.

    Rounds of colouring: each node takes the largest color that reaches it; within a color, what
    reaches back to the node it is named after is one component and leaves the graph. Nodes without
    edges in or out inside what is left are components by themselves and leave first. All steps are
    joins and sums by node; the state is a written table after each.
    """
    spark = edges.sparkSession
    left = stored(edges.select("src", "dst").distinct(), "edges")
    nodes = stored(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "nodes")
    done = spark.createDataFrame([], nodes.select("node", F.col("node").alias("component")).schema)

    def within(rows: DataFrame, kept: DataFrame) -> DataFrame:
        return stored(rows.join(apart(kept.select(F.col("node").alias("src"))), "src", "left_semi").join(apart(kept.select(F.col("node").alias("dst"))), "dst", "left_semi"), "edges")

    for k in count():
        if rounds is not None and k >= rounds and not nodes.isEmpty():
            raise RuntimeError(f"strong_components: nodes are left after {rounds} rounds")
        if k % 32 == 31:
            done = stored(done, "done")
        own = left.filter("src != dst")
        inner = own.select(F.col("src").alias("node")).distinct().join(apart(own.select(F.col("dst").alias("node"))), "node", "left_semi")
        single = stored(nodes.join(apart(inner), "node", "left_anti").select("node", F.col("node").alias("component")), "done")
        done, before = done.union(single), (nodes, left)
        nodes = stored(nodes.join(apart(inner), "node", "left_semi"), "nodes")
        left = within(own, nodes)
        discard(*before)
        if nodes.isEmpty():
            break
        if not single.isEmpty():
            continue
        color, grown = nodes.select("node", F.col("node").alias("color")), None
        while True:  # forward: the largest color that reaches a node
            near = left.join(apart(color), left.src == color.node).groupBy("dst").agg(F.max("color").alias("new"))
            last, grown = grown, stored(color.join(apart(near), color.node == near.dst, "left").select("node", F.greatest("color", F.coalesce("new", "color")).alias("color"), (F.coalesce("new", "color") > F.col("color")).alias("moved")), "colors")
            if last is not None:
                discard(last)
            color = grown.select("node", "color")
            if grown.filter("moved").isEmpty():
                break
        c = color.withColumnsRenamed({"node": "n", "color": "c"})
        same = stored(left.join(apart(color), left.src == color.node).drop("node").join(apart(c), F.col("dst") == c.n).filter("color = c").select("src", "dst"), "same")
        back = stored(color.filter("node = color"), "back")
        front, waves = back, []
        while True:  # backward within a color from the node it is named after
            more = same.join(apart(front), same.dst == front.node).select(F.col("src").alias("node"), "color").distinct().join(apart(back.select("node")), "node", "left_anti")
            front = stored(more, "more")
            if front.isEmpty():
                break
            waves.append(front)
            back = back.union(front)
        named = back.join(apart(back.groupBy("color").agg(F.min("node").alias("component"))), "color").select("node", "component")
        named = stored(named, "done")
        done, before = done.union(named), (nodes, left)
        nodes = stored(nodes.join(apart(named), "node", "left_anti"), "nodes")
        left = within(left, nodes)
        discard(*before, grown, same, front, *waves)
    return done


def linked(edges: DataFrame, tag: str = "components", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that can be reached.

    Large-star and small-star steps in turn until nothing changes; each step is two shuffles of the
    edges, which a hub does not gather in one task: its rows are counted down by partial aggregation
    and its join side can be split. The state is a written table after each round. Null ends and loops
    are ignored; nodes in loops only are not returned. A bound on rounds raises when it is reached.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, sign = stored(now, tag), None
    for k in count():
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == tuple(found) or not found[0]:
            break
        if rounds is not None and k >= rounds:
            raise RuntimeError(f"linked: edges still change after {rounds} rounds")
        sign = tuple(found)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), tag)
        discard(before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def cycles(components: DataFrame) -> DataFrame:
    """(component, members, size) of components with several nodes."""
    return components.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")


def layers(edges: DataFrame, components: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, layer): the longest way down to a sink, cycles taken as one node; sinks are 0.

    No way has more layers than there are components: beyond that, or at a given bound on rounds, it raises.
    """
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("x")), components.select(F.col("node").alias("dst"), F.col("component").alias("y"))
    dag = stored(edges.select("src", "dst").join(apart(a), "src").join(apart(b), "dst").filter("x != y").select("x", "y").distinct(), "dag")
    level = stored(components.select("component").distinct().withColumn("layer", F.lit(0)), "layers")
    most = level.count() if rounds is None else rounds
    for k in count(1):
        up = dag.join(apart(level.filter(F.col("layer") == k - 1)), dag.y == level.component).select("x").distinct()
        if up.isEmpty():
            break
        if k >= most:
            raise RuntimeError(f"layers: edges still lead up after layer {k - 1}")
        level = stored(level.join(apart(up), level.component == up.x, "left").select("component", F.when(F.col("x").isNotNull(), k).otherwise(F.col("layer")).alias("layer")), "layers")
    return components.join(apart(level), "component").select("node", "layer")


def shortest_cycle(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(path) of a shortest way from a node back to itself, of equals the first by names; no row without one.

    Breadth-first, one row a reached node, until the node itself or nothing new is reached. A bound on
    steps raises when it is reached.
    """
    e = stored(edges.select("src", "dst").distinct(), "edges")
    front = stored(e.filter(F.col("src") == start).select(F.col("dst").alias("node"), F.array("src", "dst").alias("path")), "front")
    seen = front.select("node")
    for k in count(1):
        home = front.filter(F.col("node") == start)
        if not home.isEmpty() or front.isEmpty():
            return home.agg(F.min("path").alias("path")).filter("path is not null")
        if most is not None and k >= most:
            raise RuntimeError(f"shortest_cycle: nothing leads back within {most} steps")
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        front = stored(step, "front")
        seen = stored(seen.union(front.select("node")), "seen")


def betweenness(edges: DataFrame, sources_per_task: int = 64, most_edges: int = 2_000_000) -> DataFrame:
    """(node, betweenness) over shortest ways, divided by (n - 1)(n - 2); 0 under three nodes.

    Each task has the graph, which is one of modules and is sent in full, and a part of the sources:
    their shortest ways are independent of each other. A graph of more than most_edges edges raises.
    """
    rows = edges.select("src", "dst").distinct().limit(most_edges + 1).toPandas()
    if len(rows) > most_edges:
        raise ValueError(f"betweenness: a graph of more than {most_edges} edges cannot be sent to all tasks")
    names = sorted(set(rows["src"]) | set(rows["dst"]))
    place = {n: k for k, n in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        if a != b:
            out[place[a]].append(place[b])
    spark = edges.sparkSession
    graph = spark.sparkContext.broadcast(out)
    scale = (len(names) - 1) * (len(names) - 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = [0.0] * len(graph.value)
            for s in frame["id"]:
                far, ways, order = {s: 0}, {s: 1.0}, [s]
                for v in order:  # grows while it is read
                    for w in graph.value[v]:
                        if w not in far:
                            far[w], ways[w] = far[v] + 1, 0.0
                            order.append(w)
                        if far[w] == far[v] + 1:
                            ways[w] += ways[v]
                share = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for w in graph.value[v]:
                        if far.get(w) == far[v] + 1:
                            share[v] += ways[v] / ways[w] * (1 + share[w])
                    if v != s:
                        total[v] += share[v]
            yield pd.DataFrame({"id": range(len(total)), "part": total})

    ids = spark.range(len(names)).repartition(max(1, len(names) // sources_per_task))
    sums = ids.mapInPandas(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("s"))
    label = spark.createDataFrame(list(enumerate(names)), "id long, node string") if names else spark.createDataFrame([], "id long, node string")
    return label.join(sums, "id", "left").select("node", round4(F.coalesce("s", F.lit(0.0)) / max(1, scale) if scale > 0 else F.lit(0.0)).alias("betweenness"))


def external_concentration(imports: DataFrame) -> DataFrame:
    """(package, importers, share): files that import each package, over the sum of all such counts."""
    n = imports.groupBy("package").agg(F.count_distinct("path").alias("importers"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("importers").alias("t")))).select("package", "importers", round4(F.col("importers") / F.col("t")).alias("share"))


def cross_edges(edges: DataFrame, languages: DataFrame) -> DataFrame:
    """(from_language, to_language, edges) of edges between files(path, language) of different languages."""
    a, b = languages.select(F.col("path").alias("src"), F.col("language").alias("from_language")), languages.select(F.col("path").alias("dst"), F.col("language").alias("to_language"))
    return edges.join(a, "src").join(b, "dst").filter("from_language != to_language").groupBy("from_language", "to_language").agg(F.count("*").alias("edges"))


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): what depends directly on changed(node) and has not changed itself."""
    near = edges.join(changed.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return near.join(changed.select("node"), "node", "left_anti")


def style(modules: DataFrame) -> DataFrame:
    """One row (style): the first signal that holds of modules(node, fan_in, fan_out, layer, cyclic)."""
    n = F.count("*")
    one = modules.agg(
        n.alias("n"), F.max("layer").alias("depth"), (F.count_if("cyclic") / n).alias("cyclic"), (F.max("fan_in") / F.greatest(n - 1, F.lit(1))).alias("hub"), F.avg("fan_out").alias("out")
    )
    return one.select(
        F.when(F.col("n") < 2, "single-module").when(F.col("cyclic") >= 0.5, "tangled").when(F.col("hub") >= 0.6, "hub").when(F.col("depth") >= 3, "layered").when(F.col("out") < 0.5, "independent").otherwise("mixed").alias("style")
    )


def assign_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of nodes(node): 0 without dependencies, else one past the deepest; null in a cycle or above one.

    edges(src, dst): src depends on dst; loops and edges to unknown nodes do not count. Each round settles
    the nodes whose dependencies are all settled, until none is left or only those that never will.
    """
    known = stored(nodes.select("node").distinct(), "nodes")
    e = edges.filter("src != dst").select("src", "dst").distinct()
    e = stored(e.join(apart(known.withColumnRenamed("node", "src")), "src", "left_semi").join(apart(known.withColumnRenamed("node", "dst")), "dst", "left_semi"), "edges")
    free = known.join(apart(e.select(F.col("src").alias("node"))), "node", "left_anti")
    front, done, left = stored(free.withColumn("layer", F.lit(0)), "front"), None, e
    for k in count(1):
        done = front if done is None else done.unionByName(front)
        if front.isEmpty():
            break
        if k % 32 == 0:
            done = stored(done, "layers")
        rest = stored(left.join(apart(front.select(F.col("node").alias("dst"))), "dst", "left_anti"), "edges")
        met = left.join(apart(front.select(F.col("node").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        front = stored(met.join(apart(rest.select(F.col("src").alias("node"))), "node", "left_anti").withColumn("layer", F.lit(k)), "front")
        left = rest
    return known.join(apart(done), "node", "left")


def modularity(modules: DataFrame) -> DataFrame:
    """(modules, value): the base-two logarithm of how many modules there are, over 6, at most 1."""
    n = modules.agg(F.count("*").alias("modules"))
    return n.select("modules", round4(F.least(F.lit(1.0), F.log2(F.greatest("modules", F.lit(1))) / 6)).alias("value"))
