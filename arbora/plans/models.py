"""Queries that fit, score and test: fixed effects, joint outliers, partial correlations, permutations, and null groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import graph, ledger, models, select, stats, validate
from arbora.operators.keys import beside
from arbora.plans import catalog
from arbora.plans.catalog import TREE_SQL, query, read, tree
from arbora.schema import EVIDENCE

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL


def _effects_sql(rounds: int) -> str:
    """Both effects taken out in turn, so many times, then two regressors by the closed form, with clustered errors."""
    out = """WITH z0 AS (SELECT l_suppkey AS g, year(l_shipdate) AS t, l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem)"""
    for i in range(rounds):
        for effect, at, to in (("g", f"z{i}", f"m{i}"), ("t", f"m{i}", f"z{i + 1}")):
            out += f", {to} AS (SELECT g, t, " + ", ".join(f"{v} - avg({v}) OVER (PARTITION BY {effect}) AS {v}" for v in "yab") + f" FROM {at})"
    return out + f""",
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, count(*) AS n, count(DISTINCT t) AS nt FROM z{rounds}),
    c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM s),
    k AS (SELECT g, sum(a * (y - ca * a - cb * b)) AS ga, sum(b * (y - ca * a - cb * b)) AS gb FROM z{rounds}, c GROUP BY 1),
    m AS (SELECT count(*) AS q, sum(ga * ga) AS maa, sum(ga * gb) AS mab, sum(gb * gb) AS mbb FROM k),
    f AS (SELECT *, q / (q - 1)::DOUBLE * (n - 1) / (n - 2 - (nt - 1)) AS f FROM c, m)
    SELECT 'l_quantity' AS term, ca AS beta, sqrt(f * (bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb)) / det AS se, n, nt - 1 AS absorbed, q AS clusters FROM f
    UNION ALL SELECT 'l_discount', cb, sqrt(f * (ab * ab * maa - 2 * ab * aa * mab + aa * aa * mbb)) / det, n, nt - 1, q FROM f"""


@query(_effects_sql(8))
def fixed_effects_regression(spark, sf_dir):
    """Two regressors, with effects of parent and year taken out, and errors clustered by parent."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("fiscal_year"), "l_extendedprice", "l_quantity", "l_discount")
    return models.absorbed_regression(li, "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "fiscal_year"], "l_suppkey")


def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure beside money: a customer's balance, number of orders and their sum."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_order"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(o, "c_custkey", "left")


ORDERS_SQL = """d AS (SELECT c_custkey, c_nationkey, c_acctbal AS x, n_orders AS y, mean_order AS w FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_order FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(
    f"""WITH {ORDERS_SQL}, m AS (SELECT c_nationkey, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, count(*) > 2 AS enough FROM d WHERE y IS NOT NULL GROUP BY 1)
    SELECT c_custkey, c_nationkey, CASE WHEN enough AND y IS NOT NULL THEN sqrt(greatest((vy * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - c * c), 0)) END AS distance FROM d JOIN m USING (c_nationkey)"""
)
def joint_outliers(spark, sf_dir):
    """How unusual a customer's balance and number of orders are together, within the nation; none without orders."""
    scored = models.mahalanobis(customers_with_orders(spark, sf_dir), ["c_acctbal", "n_orders"], ["c_nationkey"])
    return scored.select("c_custkey", "c_nationkey", "distance")


@query(
    f"""WITH {ORDERS_SQL}, r AS (SELECT c_nationkey, count(*) AS n, corr(x, y) AS xy, corr(x, w) AS xw, corr(y, w) AS yw FROM d WHERE y IS NOT NULL GROUP BY 1)
    SELECT c_nationkey, 'c_acctbal' AS one, 'n_orders' AS other, n, xy AS correlation, CASE WHEN n > 3 THEN (xy - xw * yw) / sqrt((1 - xw * xw) * (1 - yw * yw)) END AS partial FROM r
    UNION ALL SELECT c_nationkey, 'c_acctbal', 'mean_order', n, xw, CASE WHEN n > 3 THEN (xw - xy * yw) / sqrt((1 - xy * xy) * (1 - yw * yw)) END FROM r
    UNION ALL SELECT c_nationkey, 'n_orders', 'mean_order', n, yw, CASE WHEN n > 3 THEN (yw - xy * xw) / sqrt((1 - xy * xy) * (1 - xw * xw)) END FROM r"""
)
def partial_correlation(spark, sf_dir):
    """Correlations with the other figures held fixed, over complete cases, by nation."""
    return models.partial_correlations(customers_with_orders(spark, sf_dir), ["c_acctbal", "n_orders", "mean_order"], ["c_nationkey"])


TIMES = 99


@query(
    f"""WITH RECURSIVE {TREE_SQL}, n AS (SELECT node, depth, n_regionkey AS region, path[-2] AS parent FROM p JOIN supplier ON s_suppkey = node JOIN nation ON n_nationkey = s_nationkey WHERE depth > 0),
    z AS (SELECT n.node, n.depth, n.region, b.n_regionkey AS above FROM n JOIN supplier ON s_suppkey = parent JOIN nation b ON b.n_nationkey = s_nationkey),
    t AS (SELECT *, row_number() OVER (PARTITION BY depth, k ORDER BY md5('5|take|' || k || '|' || node)) AS i, row_number() OVER (PARTITION BY depth, k ORDER BY md5('5|give|' || k || '|' || node)) AS j
      FROM z, range(1, {TIMES + 1}) r(k)),
    v AS (SELECT a.k, sum(CASE WHEN b.region = a.above THEN 1 ELSE 0 END)::DOUBLE AS value FROM t a JOIN t b ON a.k = b.k AND a.depth = b.depth AND a.i = b.j GROUP BY 1),
    o AS (SELECT sum(CASE WHEN region = above THEN 1 ELSE 0 END)::DOUBLE AS observed FROM z),
    c AS (SELECT max(observed) AS observed, avg(value) AS expected, count(*) FILTER (value >= observed) AS at_least, count(*) FILTER (value <= observed) AS at_most, count(*) AS times FROM v, o)
    SELECT *, (at_least + 1) / (times + 1)::DOUBLE AS p_high, (at_most + 1) / (times + 1)::DOUBLE AS p_low FROM c"""
)
def nesting_permutation_test(spark, sf_dir):
    """Do entities lie in their parent's region more often than nesting alone makes them: regions dealt out anew among entities of one depth."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    s = read(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("s_suppkey", "region")
    t = tree(spark, sf_dir).filter("depth > 0").select("node", "depth", F.element_at("path", -2).alias("parent"))
    e = t.join(s.withColumnRenamed("s_suppkey", "node"), "node").join(s.select(F.col("s_suppkey").alias("parent"), F.col("region").alias("above")), "parent")
    same = lambda c: F.count_if(F.col(c) == F.col("above"))
    return models.permutation_test(e.select("node", "depth", "region", "above"), "region", ["depth"], ["node"], same, TIMES, seed=5)


#: Fixed starts: a thousandth of all customers, and hundreds of the currency.
STARTS = [(36.0, 40.0), (40.0, 45.0), (44.0, 50.0)]


def _lloyd_sql(rounds: int) -> str:
    out = "WITH s AS (SELECT c_nationkey AS k, 1000 * count(*)::DOUBLE / (SELECT count(*) FROM customer) AS n, avg(c_acctbal) / 100 AS mean FROM customer GROUP BY 1),\nc0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(STARTS)) + ") t(cluster, x, y))"
    near = lambda i: f"(SELECT k, n, mean, arg_min(cluster, ((n - x) * (n - x) + (mean - y) * (mean - y), cluster)) AS cluster FROM s, c{i} GROUP BY 1, 2, 3)"
    for i in range(rounds):
        out += f",\nc{i + 1} AS (SELECT c.cluster, coalesce(avg(n), any_value(c.x)) AS x, coalesce(avg(mean), any_value(c.y)) AS y FROM c{i} c LEFT JOIN {near(i)} a ON a.cluster = c.cluster GROUP BY 1)"
    return out + f" SELECT k AS c_nationkey, cluster::INT AS cluster FROM {near(rounds)}"


@query(_lloyd_sql(10))
def taxonomy_from_starts(spark, sf_dir):
    """Nations by their share of customers, in thousandths, and their mean balance, in hundreds, clustered from fixed starts in ten rounds."""
    s = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"), (F.avg("c_acctbal") / 100).alias("mean"))
    s = s.withColumn("n", 1000 * F.col("c").cast("double") / F.sum("c").over(Window.partitionBy()))  # a row for each nation
    return stats.nearest_centres(s, ["n", "mean"], STARTS, 10).select("c_nationkey", "cluster")


# Rows without a group ------------------------------------------------------------------------------------------------


def with_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the nation unknown for the machinery segment."""
    return read(spark, sf_dir, "customer").withColumn("grp", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey")))


UNKNOWN_SQL = "c AS (SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey END AS grp FROM customer)"


@query(f"WITH {UNKNOWN_SQL} SELECT grp, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high, quantile_cont(c_acctbal, 0.5) AS p50 FROM c GROUP BY 1")
def statistics_with_unknown_group(spark, sf_dir):
    """Rows without a group have figures of their own."""
    return stats.descriptives(with_unknown(spark, sf_dir), "c_acctbal", ["grp"], [0.5])


@query(
    f"""WITH {UNKNOWN_SQL}, m AS (SELECT grp, median(c_acctbal) AS med FROM c GROUP BY 1), o AS (SELECT c.*, med, abs(c_acctbal - med) AS off FROM c JOIN m ON c.grp IS NOT DISTINCT FROM m.grp),
    d AS (SELECT grp, median(off) AS mad FROM o GROUP BY 1) SELECT c_custkey, o.grp, med, mad FROM o JOIN d ON o.grp IS NOT DISTINCT FROM d.grp WHERE off > 1.5 * mad"""
)
def outliers_with_unknown_group(spark, sf_dir):
    """outliers within groups, and among rows without one."""
    found = select.outliers(with_unknown(spark, sf_dir), "c_acctbal", 1.5, ["grp"])
    return found.select("c_custkey", "grp", F.col("_median").alias("med"), F.col("_mad").alias("mad"))


@query(
    f"""WITH {UNKNOWN_SQL}, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY grp, c_acctbal) - 1) / 2.0 AS x,
      rank() OVER (PARTITION BY grp ORDER BY c_custkey % 50) + (count(*) OVER (PARTITION BY grp, c_custkey % 50) - 1) / 2.0 AS y FROM c)
    SELECT grp, count(*) AS n, round(corr(x, y), 12) + 0.0 AS spearman FROM r GROUP BY 1"""
)
def rank_correlation_with_unknown_group(spark, sf_dir):
    """The same."""
    found = stats.spearman(with_unknown(spark, sf_dir).withColumn("k", F.col("c_custkey") % 50), "c_acctbal", "k", ["grp"])
    return found.withColumn("spearman", F.round("spearman", 12) + 0.0)  # small groups may have one of almost 0


SEGMENT_SQL = "c AS (SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS grp FROM customer)"


@query(f"WITH {SEGMENT_SQL}, g AS (SELECT DISTINCT grp AS dropped FROM c) SELECT dropped, count(*) AS n, median(c_acctbal) AS med FROM g JOIN c ON c.grp IS DISTINCT FROM g.dropped GROUP BY 1")
def leave_one_out_with_unknown_group(spark, sf_dir):
    """Rows without a group stay when another is left out, and are left out in their turn."""
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("grp"), "c_acctbal")
    n = stats.leave_one_out_any(c, "grp", lambda g: g.agg(F.count(F.lit(1)).alias("n")))
    med = stats.left_out_quantiles(c, "grp", "c_acctbal", [0.5]).select("dropped", F.col("quantile").alias("med"))
    return beside(n, med, ["dropped"])


@query(
    f"""WITH RECURSIVE {TREE_SQL}, q AS (SELECT CASE WHEN root > 1 THEN root END AS grp, depth, labels[-1] AS nation FROM p), s AS (SELECT grp, nation, count(*) AS n FROM q GROUP BY 1, 2),
    h AS (SELECT grp, -sum(p * ln(p)) AS country_entropy FROM (SELECT grp, n::DOUBLE / sum(n) OVER (PARTITION BY grp) AS p FROM s) GROUP BY 1), d AS (SELECT grp, max(depth)::INT AS max_depth, count(*) AS n_nodes FROM q GROUP BY 1)
    SELECT d.grp, max_depth, n_nodes, country_entropy, max_depth + ln(n_nodes) + country_entropy AS complexity FROM d JOIN h ON d.grp IS NOT DISTINCT FROM h.grp"""
)
def complexity_with_unknown_group(spark, sf_dir):
    """The same."""
    t = tree(spark, sf_dir).select(F.when(F.col("root") > 1, F.col("root")).alias("grp"), "depth", F.element_at("labels", -1).alias("nation"))
    return graph.complexity(t, "grp", "nation")


# Findings and evidence -----------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1),
    w AS (SELECT *, CASE WHEN r * 3 > n THEN 'An improper share of rows is under review' WHEN r * 4 > n THEN 'Possibly ILLEGAL or corrupt entries' ELSE 'Few rows are under review' END AS text FROM a)
    SELECT l_suppkey, n, array_to_string(list_filter(['fraudulent', 'illegal', 'corrupt', 'tax-evasive', 'abusive', 'improper'], lambda x: contains(lower(text), x)), ',') AS loaded FROM w
    WHERE len(list_filter(['fraudulent', 'illegal', 'corrupt', 'tax-evasive', 'abusive', 'improper'], lambda x: contains(lower(text), x))) > 0"""
)
def loaded_claims(spark, sf_dir):
    """Claims that a figure was put into, and the loaded words of those that are not neutral."""
    a = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    text = F.when(F.col("r") * 3 > F.col("n"), "An improper share of rows is under review").when(F.col("r") * 4 > F.col("n"), "Possibly ILLEGAL or corrupt entries")
    worded = a.withColumn("words", ledger.loaded_words(text.otherwise("Few rows are under review")))
    return worded.filter(F.size("words") > 0).select("l_suppkey", "n", F.concat_ws(",", "words").alias("loaded"))


FILTERS = {
    "known balance": "balance > 0", "single claimant": "claimants = 1", "large order": "total > 200000",
}


@query(
    """WITH c AS (SELECT o_totalprice AS total, CASE WHEN c_acctbal <> round(c_acctbal) THEN c_acctbal END AS balance, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 3 END AS claimants FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT 1 AS step, 'known balance' AS filter, 'balance > 0' AS condition, count(*) AS n_before, count(*) FILTER (balance > 0) AS n_after, count(*) FILTER (balance IS NULL) AS n_unknown FROM c
    UNION ALL SELECT 2, 'single claimant', 'claimants = 1', count(*) FILTER (balance > 0), count(*) FILTER (balance > 0 AND claimants = 1), count(*) FILTER (balance > 0 AND claimants IS NULL) FROM c
    UNION ALL SELECT 3, 'large order', 'total > 200000', count(*) FILTER (balance > 0 AND claimants = 1), count(*) FILTER (balance > 0 AND claimants = 1 AND total > 200000), 0 FROM c"""
)
def recorded_filters(spark, sf_dir):
    """what each filter of a result leaves out, and on how many rows it is undefined, for the record of the finding."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select(
        F.col("o_totalprice").alias("total"), F.when(F.col("c_acctbal") != F.round("c_acctbal"), F.col("c_acctbal")).alias("balance"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3).alias("claimants"),
    )
    return select.recorded_filters(rows, FILTERS)[1]


@query(
    "WITH " + "v AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS variable, CASE WHEN (l_partkey + {i}) % 7 > 0 THEN round(l_extendedprice * 100)::BIGINT + {i} END AS value, CASE WHEN (l_orderkey + {i}) % 5 > 0 THEN 'line ' || l_linenumber END AS evidence FROM lineitem"
        for i, m in enumerate(EVIDENCE)
    ) + ") SELECT variable, count(*) AS n, count(value) AS known, count(CASE WHEN value IS NOT NULL THEN evidence END) AS backed, CAST(sum(value) AS BIGINT) AS total FROM v GROUP BY 1"
)
def evidence_coverage(spark, sf_dir):
    """All 18 amounts beside the lines that they come from: known values, and those with evidence."""
    li, columns = read(spark, sf_dir, "lineitem"), {}
    for i, (m, e) in enumerate(EVIDENCE.items()):
        columns[m] = F.when((F.col("l_partkey") + i) % 7 > 0, F.round(F.col("l_extendedprice") * 100).cast("bigint") + i)
        columns[e] = F.when((F.col("l_orderkey") + i) % 5 > 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    pairs = validate.evidence_pairs(li.select("l_orderkey", *(c.alias(n) for n, c in columns.items())), ["l_orderkey"], EVIDENCE)
    return pairs.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.count_if(F.col("value").isNotNull() & F.col("evidence").isNotNull()).alias("backed"), F.sum("value").alias("total")
    )
