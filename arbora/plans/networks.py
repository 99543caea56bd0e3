"""Queries over graphs: shortest paths, central intermediaries, recurrent structures, ultimate parents.

The graph is the arithmetic supplier tree, in which supplier ``k`` hangs below ``k div 3``, with cross-holdings: supplier
``k`` also holds a stake in ``5 k + 1`` and in ``k div 7``, where there are such suppliers, so that the graph has cycles
and several ways between two entities. The ultimate parents are the smallest supplier of each nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import graph, network
from arbora.plans import catalog
from arbora.plans.catalog import EDGE_SQL, TREE_SQL, query, read, tree, tree_edges

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    ends = F.array(
        F.struct(F.expr("s_suppkey div 3").alias("parent"), F.col("s_suppkey").alias("child")),
        F.struct(F.col("s_suppkey").alias("parent"), (F.col("s_suppkey") * 5 + 1).alias("child")),
        F.struct(F.col("s_suppkey").alias("parent"), F.expr("s_suppkey div 7").alias("child")),
    )
    known = s.withColumnRenamed("s_suppkey", "child")
    return s.select(F.inline(ends)).filter("parent <> child AND parent > 0 AND child > 0").join(known, "child", "left_semi").select("parent", "child")


def ultimate_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("source")).filter("source > 0").select("source")


#: Distances by walks of at most 24 steps, far more than the graph needs.
WALK_SQL = """k AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey > 0),
h AS (SELECT DISTINCT parent, child FROM (SELECT k // 3 AS parent, k AS child FROM k UNION ALL SELECT k, 5 * k + 1 FROM k UNION ALL SELECT k, k // 7 FROM k)
  WHERE parent <> child AND parent > 0 AND child IN (SELECT k FROM k)),
u AS (SELECT min(s_suppkey) AS source FROM supplier GROUP BY s_nationkey HAVING min(s_suppkey) > 0),
w AS (SELECT source, source AS node, 0 AS step FROM u UNION SELECT source, child, step + 1 FROM w JOIN h ON parent = node WHERE step < 24),
d AS (SELECT source, node, min(step) AS dist FROM w GROUP BY 1, 2),
g AS (SELECT a.source, parent, child, b.dist FROM d a JOIN h ON parent = a.node JOIN d b ON b.source = a.source AND b.node = child AND b.dist = a.dist + 1),
p AS (SELECT source, source AS node, [source] AS path FROM u UNION ALL SELECT p.source, child, list_append(path, child) FROM p JOIN g ON g.source = p.source AND g.parent = p.node)"""


@query(f"WITH RECURSIVE {WALK_SQL}, c AS (SELECT source, node, count(*)::DOUBLE AS paths FROM p GROUP BY 1, 2) SELECT source, node, dist::INT AS dist, paths FROM d JOIN c USING (source, node)")
def shortest_path_counts(spark, sf_dir):
    """Distances from the ultimate parents, with the number of shortest paths."""
    return network.shortest_paths(holdings(spark, sf_dir), ultimate_parents(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {WALK_SQL}, e AS (SELECT a.source, b.s_suppkey AS target FROM u a, (SELECT min(s_suppkey) AS least, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) b),
    r AS (SELECT source, node AS target, path, row_number() OVER (PARTITION BY source, node ORDER BY list_reverse(path)) AS i FROM p)
    SELECT e.source, e.target, (len(path) - 1)::INT AS dist, array_to_string(path, '>') AS path FROM e LEFT JOIN r ON r.source = e.source AND r.target = e.target AND i = 1"""
)
def paths_between_entities(spark, sf_dir):
    """One shortest path from each ultimate parent to the last supplier of each nation; a few ends by nation."""
    ends = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("target")).select("target")
    wanted = ultimate_parents(spark, sf_dir).crossJoin(F.broadcast(ends))  # a row for each nation on both sides
    found = network.shortest_path(holdings(spark, sf_dir), wanted)
    return found.withColumn("path", F.when(F.col("path").isNotNull(), F.concat_ws(">", F.col("path").cast("array<string>"))))


@query(
    f"""WITH RECURSIVE {WALK_SQL}, c AS (SELECT source, node, count(*) AS n FROM p GROUP BY 1, 2),
    i AS (SELECT source, node AS target, unnest(path[2:len(path) - 1]) AS node FROM p WHERE len(path) > 2),
    t AS (SELECT i.node, sum(1.0::DOUBLE / n) AS betweenness FROM i JOIN c ON c.source = i.source AND c.node = i.target GROUP BY 1),
    n AS (SELECT parent AS node FROM h UNION SELECT child FROM h) SELECT node, coalesce(betweenness, 0) AS betweenness FROM n LEFT JOIN t USING (node)"""
)
def central_intermediaries(spark, sf_dir):
    """Betweenness of all entities on the shortest paths from the ultimate parents."""
    return network.betweenness(holdings(spark, sf_dir), ultimate_parents(spark, sf_dir))


def _forms_sql(depth: int) -> str:
    """Canonical texts of all subtrees, level by level from the deepest."""
    out = f"WITH RECURSIVE {TREE_SQL}, r AS (SELECT s_suppkey AS node, n_regionkey % 2 AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey),\n"
    out += "n AS (SELECT p.node, p.depth, label, CASE WHEN depth > 0 THEN p.path[-2] END AS parent FROM p JOIN r USING (node)),\n"
    out += f"f{depth} AS (SELECT NULL::BIGINT AS node, NULL::BIGINT AS parent, '' AS form, 0::BIGINT AS size, 0 AS height WHERE FALSE)"
    for d in range(depth - 1, -1, -1):
        out += f""",
        f{d} AS (SELECT n.node, n.parent, '(' || n.label || coalesce(string_agg(c.form, '' ORDER BY c.form), '') || ')' AS form, (1 + coalesce(sum(c.size), 0))::BIGINT AS size,
          coalesce(max(c.height) + 1, 0) AS height FROM n LEFT JOIN f{d + 1} c ON c.parent = n.node WHERE n.depth = {d} GROUP BY n.node, n.parent, n.label)"""
    out += ", a AS (" + " UNION ALL ".join(f"SELECT * FROM f{d}" for d in range(depth)) + ")"
    return out + " SELECT min(node) AS example, max(size) AS size, max(height)::INT AS height, count(*) AS copies FROM a WHERE size >= 2 GROUP BY form HAVING count(*) >= 2"


@query(_forms_sql(16))
def recurrent_structures(spark, sf_dir):
    """Subtrees of the ownership tree that occur again, with a label of two kinds by region, whatever the order of children."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_regionkey") % 2).alias("label"))
    nodes = read(spark, sf_dir, "supplier").filter("s_suppkey > 0").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("node"), "label")
    return network.recurrent_structures(network.subtree_shapes(tree_edges(spark, sf_dir), nodes))


@query(
    f"""WITH RECURSIVE {TREE_SQL}, b AS (SELECT n_regionkey, min(s_suppkey) AS bucket FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey > 0 GROUP BY 1)
    SELECT node, root, bucket FROM p JOIN supplier ON s_suppkey = node JOIN nation ON n_nationkey = s_nationkey JOIN b USING (n_regionkey) WHERE root <> bucket"""
)
def ultimate_parent_against_bucket(spark, sf_dir):
    """Entities whose chain ends at another root than the parent bucket that is stated for them, here their region's first supplier."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = read(spark, sf_dir, "supplier").filter("s_suppkey > 0").join(nation, "s_nationkey").select("s_suppkey", "n_regionkey")
    stated = s.join(s.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("bucket")), "n_regionkey").select(F.col("s_suppkey").alias("node"), "bucket")
    return graph.root_disagreements(tree(spark, sf_dir).join(stated, "node"), "bucket").select("node", "root", "bucket")


@query(
    f"""WITH {EDGE_SQL}, n AS (SELECT s_suppkey AS node, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey % 4 END AS grp FROM supplier WHERE s_suppkey > 0),
    t AS (SELECT grp, count(*) AS c FROM e JOIN n ON node = child GROUP BY 1) SELECT grp, c AS n_children FROM t"""
)
def branching_by_unknown_group(spark, sf_dir):
    """Children by a group that some do not have."""
    group = F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey") % 4).alias("grp")
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("child"), group)
    return graph.branching(tree_edges(spark, sf_dir).join(nodes, "child"), "grp")
