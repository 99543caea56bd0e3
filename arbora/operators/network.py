"""Shortest paths, central intermediaries and recurrent structures of ownership graphs.

Everything goes level by level: a level is one join with the edges and one written table, so neither the depth of a
graph nor lineage is a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.tables import Scratch, materialize


def _levels(edge: DataFrame, sources: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """One table for each distance from the sources: ``source, node, dist, paths``."""
    step = edge.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct()
    step = scratch.table(step, "edges")
    start = sources.select("source").filter("source IS NOT NULL").distinct()
    levels = [scratch.table(start.select("source", F.col("source").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "level")]
    while True:
        met = levels[-1].join(step, F.col("node") == F.col("parent")).groupBy("source", "child").agg(F.sum("paths").alias("paths"))
        seen = reduce(DataFrame.unionByName, (x.select("source", "node") for x in levels))
        new = met.withColumnRenamed("child", "node").join(seen, ["source", "node"], "left_anti")
        new = scratch.table(new.select("source", "node", F.lit(len(levels)).alias("dist"), "paths"), "level")
        if new.isEmpty():
            return levels
        levels.append(new)


def shortest_paths(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node, dist, paths`` for every node that a source reaches over directed ``edge(parent, child)``.

    ``paths`` is the number of shortest paths, exact up to 2^53. Repeated edges count once; cycles are harmless, as a node
    is taken at its first level; a source that has no edges reaches itself; null ends and sources are left out.
    """
    scratch = Scratch(edge.sparkSession)
    made, _ = materialize(reduce(DataFrame.unionByName, _levels(edge, sources, scratch)), "distances")
    scratch.drop()
    return made


def shortest_path(edge: DataFrame, ends: DataFrame) -> DataFrame:
    """One shortest path for each row of ``ends(source, target)``: ``source, target, dist, path``.

    Of equally short paths it is the one whose last step comes from the smallest node, and so on backwards. Targets out
    of reach have no ``dist`` and no path. Paths are walked back from the target, one join for each step.
    """
    scratch = Scratch(edge.sparkSession)
    wanted = scratch.table(ends.select("source", "target").distinct(), "ends")
    levels = _levels(edge, wanted.select("source"), scratch)
    step = edge.select("parent", "child").distinct()
    reached = reduce(DataFrame.unionByName, levels).select("source", F.col("node").alias("target"), "dist")
    walked = wanted.join(reached, ["source", "target"]).withColumns({"at": F.col("target"), "path": F.array("target")})
    done = [walked.filter("dist = 0")]
    walked = scratch.table(walked, "walk")
    for dist in range(len(levels) - 1, 0, -1):
        # Walks whose place lies at this distance go one step back; the others wait for theirs.
        before = levels[dist - 1].select("source", F.col("node").alias("parent"))
        here = walked.filter(F.col("dist") - F.size("path") + 1 == dist)
        back = here.join(step, F.col("at") == F.col("child")).join(before, ["source", "parent"])
        back = back.groupBy("source", "target", "dist", "path").agg(F.min("parent").alias("at"))
        back = back.select("source", "target", "dist", "at", F.concat(F.array("at"), "path").alias("path"))
        wait = walked.filter((F.col("dist") - F.size("path") + 1 < dist) & (F.col("dist") > 0))
        walked = scratch.table(back.unionByName(wait.select(back.columns)), "walk")
    done.append(walked.filter("dist > 0"))
    found = reduce(DataFrame.unionByName, (d.select("source", "target", "dist", "path") for d in done))
    made, _ = materialize(wanted.join(found, ["source", "target"], "left"), "paths")
    scratch.drop()
    return made


def betweenness(edge: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``node, betweenness``: the sum, over ordered pairs of a source and another node, of the share of their shortest
    paths on which the node lies strictly inside.

    Without ``sources`` all nodes are sources, which makes one row for each pair of nodes that reach one another; with a
    table of sources, such as the ultimate parents, rows grow with sources times nodes. Dependencies flow back from the
    farthest level to the nearest: one join with the edges and one with the level before, for all sources at once.
    Nodes that no path passes have 0.
    """
    scratch = Scratch(edge.sparkSession)
    step = edge.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct()
    step = scratch.table(step, "edges")
    nodes = step.select(F.col("parent").alias("node")).union(step.select("child")).distinct()
    levels = _levels(step, nodes.select(F.col("node").alias("source")) if sources is None else sources, scratch)
    parts, below = [], None
    for level in reversed(levels[1:]):
        if below is None:
            here = level.select("source", "node", "paths", F.lit(0.0).alias("passed"))
        else:
            sent = below.join(step, F.col("node") == F.col("child")).select(
                "source", F.col("parent").alias("node"), ((F.col("passed") + 1) / F.col("paths")).alias("sent")
            )
            # Other parents of a node may lie on its own level or beyond; only this level's are on shortest paths.
            sent = level.select("source", "node").join(sent, ["source", "node"]).groupBy("source", "node").agg(F.sum("sent").alias("sent"))
            here = level.join(sent, ["source", "node"], "left").select(
                "source", "node", "paths", (F.coalesce("sent", F.lit(0.0)) * F.col("paths")).alias("passed")
            )
        below = scratch.table(here, "passed")
        parts.append(below.filter("passed > 0").select("node", "passed"))
    total = reduce(DataFrame.unionByName, parts) if parts else nodes.select("node", F.lit(0.0).alias("passed")).limit(0)
    total = total.groupBy("node").agg(F.sum("passed").alias("betweenness"))
    made, _ = materialize(nodes.join(total, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness")), "betweenness")
    scratch.drop()
    return made


def subtree_shapes(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shape, size, height`` for every node of a forest: two nodes have one shape if and only if their subtrees
    are alike, labels included, whatever the order of children.

    ``edge(parent, child)`` and ``nodes(node, label)``; nodes that are no child are roots. A shape is a hash of the label
    and of the children's shapes with their numbers, combined without order, so children are never gathered: equal
    shapes are counted first, and two 64-bit hashes of each are combined bit by bit. Two shapes are confused with a
    probability of 2^-128 a pair. A child of several parents is an error; nodes on cycles are reached from no root and
    left out; null labels are a label of their own.
    """
    scratch = Scratch(edge.sparkSession)
    step = scratch.table(edge.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct(), "edges")
    if not step.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a node has several parents: subtrees are defined in a forest")
    named = scratch.table(nodes.select("node", "label"), "nodes")
    roots = named.join(step.select(F.col("child").alias("node")), "node", "left_anti")
    level = scratch.table(roots.select("node", "label", F.lit(None).cast(step.schema["parent"].dataType).alias("parent")), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        further = level.select(F.col("node").alias("parent")).join(step, "parent").withColumnRenamed("child", "node")
        level = scratch.table(further.join(named, "node", "left").select("node", "label", "parent"), "level")
    below, done = None, []
    for level in reversed(levels):
        if below is None:
            rows = level.withColumns({"one": F.lit(0).cast("bigint"), "two": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint"), "height": F.lit(0)})
        else:
            alike = below.groupBy("parent", "shape").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("s"), F.max("height").alias("h"))
            kids = alike.groupBy(F.col("parent").alias("node")).agg(
                F.bit_xor(F.xxhash64(F.lit(1), "shape", "c")).alias("one"), F.bit_xor(F.xxhash64(F.lit(2), "c", "shape")).alias("two"),
                F.sum("c").alias("n"), F.sum(F.col("c") * F.col("s")).alias("below"), (F.max("h") + 1).alias("height"),
            )
            rows = level.join(kids, "node", "left").na.fill(0, ["one", "two", "n", "below", "height"])
        known = F.col("label").isNull()
        half = lambda seed, c: F.lpad(F.hex(F.xxhash64(F.lit(seed), known, "label", "n", c)), 16, "0")
        shape = F.concat(half(3, "one"), half(4, "two"))
        below = scratch.table(rows.select("node", "parent", shape.alias("shape"), (F.col("below") + 1).alias("size"), "height"), "shapes")
        done.append(below.select("node", "shape", "size", "height"))
    if not done:
        return edge.sparkSession.createDataFrame([], f"node {step.schema['parent'].dataType.simpleString()}, shape string, size bigint, height int")
    made, _ = materialize(reduce(DataFrame.unionByName, done), "shapes")
    scratch.drop()
    return made


def recurrent_structures(shapes: DataFrame, least_size: int = 2, least_copies: int = 2) -> DataFrame:
    """Shapes that occur again: ``example, size, height, copies``; the example is the smallest node."""
    made = shapes.filter(F.col("size") >= least_size).groupBy("shape").agg(
        F.min("node").alias("example"), F.max("size").alias("size"), F.max("height").alias("height"), F.count(F.lit(1)).alias("copies")
    )
    return made.filter(F.col("copies") >= least_copies).drop("shape")
