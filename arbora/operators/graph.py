"""Hierarchies: entity and edge tables, ownership paths, and what is counted along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.keys import beside
from arbora.tables import materialize, remove


def entities(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per legal entity under the stated key, with the number of panel rows behind it."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def edges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct parent-child rows."""
    return df.select(*columns).distinct()


def resolve_parents(df: DataFrame, group: str = "parent", child: str = "entity_name", up: str = "immediate_parent") -> DataFrame:
    """Marks each row's immediate parent as root, resolved, ambiguous or unmatched within its group; drops nothing."""
    known = df.select(F.col(group).alias("_g"), F.col(child).alias("_c"), "target_id").distinct()
    known = known.groupBy("_g", "_c").agg(F.count_distinct("target_id").alias("_n"))
    joined = df.join(known, (F.col(group) == F.col("_g")) & (F.col(up) == F.col("_c")), "left")
    status = (
        F.when(F.col(up).eqNullSafe(F.col(group)) | F.col(up).isNull(), "root")
        .when(F.col("_n").isNull(), "unmatched")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("resolved")
    )
    return joined.withColumn("parent_status", status).drop("_g", "_c", "_n")


def paths(edge: DataFrame, roots: DataFrame, max_depth: int = 30, label: str | None = None) -> DataFrame:
    """All paths from the roots: ``root, node, depth, path`` (and ``labels``), with ``cycle`` where a path closes.

    ``edge`` has ``parent, child`` (and ``label`` of the child); ``roots`` has ``root`` (and the label). Every level is
    one join and one written table, so neither rows nor lineage are bounded by a recursive query's limits. A path that
    meets one of its own nodes is given out once with ``cycle`` set, and not followed further. A path that would go
    deeper than ``max_depth`` is an error.
    """
    labels = [F.array(label).alias("labels")] if label else []
    level, _ = materialize(
        roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), *labels, F.lit(False).alias("cycle")),
        "paths",
    )
    step, done = edge.select("parent", "child", *([F.col(label).alias("_label")] if label else [])), [level]
    while True:
        further = level.filter("NOT cycle").join(step, F.col("node") == F.col("parent"))
        if len(done) > max_depth:
            if further.isEmpty():
                break
            raise ValueError(f"a path goes deeper than max_depth {max_depth}")
        longer = [F.array_append("labels", F.col("_label")).alias("labels")] if label else []
        level, path = materialize(
            further.select(
                "root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"),
                F.array_append("path", F.col("child")).alias("path"), *longer, F.array_contains("path", F.col("child")).alias("cycle"),
            ),
            "paths",
        )
        if level.isEmpty():
            remove(edge.sparkSession, path)
            break
        done.append(level)
    return reduce(DataFrame.unionByName, done)


#: An earlier name.
paths_by_joins = paths


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``(node, comp)`` with the smallest node of each component.

    Labels spread to neighbours and are then short-cut through the label's own label, so rounds grow with the
    logarithm of the diameter. Every round is one written table; a hub's neighbours meet only in a partial ``min``.
    Self-edges and repeats are harmless; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    both, both_path = materialize(
        edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), f"{tag}-edges"
    )
    labels, path = materialize(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), f"{tag}-labels"
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        step = labels.join(heard, "node").select("node", F.least("comp", "near").alias("mid"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("root"))
        new, new_at = materialize(
            step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("root", "mid")).alias("comp"), "was"),
            f"{tag}-labels",
        )
        moved = new.filter("comp <> was").limit(1).count()
        remove(spark, path)
        labels, path = new.select("node", "comp"), new_at
        if not moved:
            remove(spark, both_path)
            return labels


def degrees(edge: DataFrame) -> DataFrame:
    """Degree centrality of directed ``edge(parent, child)``: ``node, n_out, n_in, degree``."""
    ends = edge.select(F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edge.select("child", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count(F.lit(1)).alias("degree"))


def page_rank(edge: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``node, rank`` after so many rounds over ``edge(parent, child)``; ranks of nodes without children are lost.

    Every round is one join on the edge's start, pre-aggregated by its end, and one written table.
    """
    nodes, _ = materialize(edge.select(F.col("parent").alias("node")).union(edge.select("child")).distinct(), "nodes")
    out, _ = materialize(edge.join(branching(edge).withColumnRenamed("n_children", "n"), "parent").select("parent", "child", "n"), "out")
    count = nodes.count()
    base = (1 - damping) / max(1, count)
    ranks, path = nodes.withColumn("rank", F.lit(1.0 / max(1, count))), None
    for _ in range(rounds):
        sent = out.join(ranks, F.col("parent") == F.col("node")).groupBy("child").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        ranks, new = materialize(
            nodes.join(sent, F.col("node") == F.col("child"), "left").select("node", (F.coalesce("got", F.lit(0.0)) * damping + base).alias("rank")),
            "ranks",
        )
        if path:
            remove(edge.sparkSession, path)  # the next round reads the new one
        path = new
    return ranks


def branching(edge: DataFrame, node: str = "parent") -> DataFrame:
    return edge.groupBy(node).agg(F.count(F.lit(1)).alias("n_children"))


def transitions(df: DataFrame, src: str, dst: str, entity: str) -> DataFrame:
    """``src, dst, paths, entities, row_total, row_share``: counts of paths beside counts of entities."""
    counted = df.groupBy(src, dst).agg(F.count(F.lit(1)).alias("paths"), F.count_distinct(entity).alias("entities"))
    total = F.sum("paths").over(Window.partitionBy(src))
    return counted.withColumn("row_total", total).withColumn("row_share", F.col("paths") / F.col("row_total"))


def grams(array: Column, n: int) -> Column:
    """The n-grams of an array, each joined by ``>``."""
    starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(">", F.slice(array, i, n)))


def motifs(path: DataFrame, array: str, n: int, entity: str) -> DataFrame:
    """n-grams along paths with path and entity counts."""
    each = path.select(entity, F.explode(grams(F.col(array).cast("array<string>"), n)).alias("motif"))
    return each.groupBy("motif").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct(entity).alias("entities"))


def intermediaries(path: DataFrame, array: str) -> DataFrame:
    """Members strictly inside paths, with the number of paths that they stand in."""
    inner = F.when(F.size(array) > 2, F.slice(array, 2, F.size(array) - 2))
    return path.select(F.explode(inner).alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("paths"))


def crossings(array: Column) -> Column:
    """Neighbouring pairs of a path that differ."""
    before, after = F.slice(array, 1, F.size(array) - 1), F.slice(array, 2, F.size(array))
    pairs = F.zip_with(before, after, lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.when(F.size(array) > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(0)


def geography_by_depth(path: DataFrame, labels: str) -> DataFrame:
    """Nodes by their depth and the last label of their path."""
    return path.groupBy("depth", F.element_at(labels, -1).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def path_product(labels: str) -> Column:
    """The product of the labels along a path, as with stakes."""
    return F.aggregate(labels, F.lit(1.0), lambda a, x: a * x)


def complexity(path: DataFrame, group: str, country: str) -> DataFrame:
    """Depth, branching and country entropy by group, null groups too, and their sum as an index; the parts are published too."""
    nodes = path.groupBy(group).agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("n_nodes"))
    share = path.groupBy(group, country).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    spread = share.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.ln("p"))).alias("country_entropy"))
    return beside(nodes, spread, [group], few=False).withColumn(
        "complexity", F.col("max_depth") + F.ln("n_nodes") + F.col("country_entropy")
    )


def root_disagreements(path: DataFrame, bucket: str) -> DataFrame:
    """Nodes whose top of the chain differs from the stated parent bucket."""
    return path.filter(~F.col("root").eqNullSafe(F.col(bucket)))


def depth_disagreements(path: DataFrame, level: str) -> DataFrame:
    """Nodes whose depth on a path differs from the stated level; nodes without a level are among them."""
    return path.filter(~F.col("depth").eqNullSafe(F.col(level)))
