"""Networks, models, time joins, name joins, streams and sinks against plain versions; nulls, ties, empties, repeats."""

import datetime as dt
import random
from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora import sources
from arbora.operators import graph, keys, ledger, matching, models, network, select, stats
from arbora.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Networks ----------------------------------------------------------------------------------------------------------


def made_graph(seed, n=25, m=50):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


def searched(edges, source):
    """Distances, numbers of shortest paths, and nodes by distance."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    dist, paths, order, todo = {source: 0}, Counter({source: 1}), [], deque([source])
    while todo:
        v = todo.popleft()
        order.append(v)
        for w in out.get(v, []):
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    return dist, paths, order


def plain_betweenness(edges, sources):
    total = Counter({v: 0.0 for e in edges for v in e})
    for s in sources:
        dist, paths, order = searched(edges, s)
        passed = Counter()
        for w in reversed(order):
            for v, x in edges:
                if x == w and v in dist and dist[v] + 1 == dist[w]:
                    passed[v] += paths[v] / paths[w] * (1 + passed[w])
            if w != s:
                total[w] += passed[w]
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_and_betweenness_on_graphs_with_cycles(spark, seed):
    edges = made_graph(seed)
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3), (4, None)], "parent long, child long")
    nodes = sorted({v for e in edges for v in e})
    some = nodes[:4] + [999]
    sources_ = spark.createDataFrame([(s,) for s in [*some, some[0], None]], "source long")
    got = {(r.source, r.node): (r.dist, r.paths) for r in network.shortest_paths(df, sources_).collect()}
    want = {}
    for s in some:
        dist, paths, _ = searched(edges, s)
        want |= {(s, v): (d, float(paths[v])) for v, d in dist.items()}
    assert got == want
    for chosen, given in ((nodes, None), (some, sources_)):
        got = {r.node: r.betweenness for r in network.betweenness(df, given).collect()}
        assert got == pytest.approx(dict(plain_betweenness(edges, chosen)))


def test_one_shortest_path(spark):
    edges = made_graph(7)
    df = spark.createDataFrame(edges, "parent long, child long")
    nodes = sorted({v for e in edges for v in e})
    ends = [(a, b) for a in nodes[:5] for b in nodes] + [(nodes[0], 999), (999, 999)]
    got = network.shortest_path(df, spark.createDataFrame(ends + ends[:3], "source long, target long")).collect()
    assert len(got) == len(ends)
    for r in got:
        dist, _, _ = searched(edges, r.source)
        assert r.dist == dist.get(r.target)
        if r.dist is None:
            assert r.path is None
            continue
        assert len(r.path) == r.dist + 1 and r.path[0] == r.source and r.path[-1] == r.target
        assert all(e in edges for e in zip(r.path, r.path[1:]))
        # Backwards, every step comes from the smallest node that lies on a shortest path.
        for i in range(len(r.path) - 1, 0, -1):
            assert r.path[i - 1] == min(a for a, b in edges if b == r.path[i] and dist.get(a) == i - 1)


def test_graph_without_edges(spark):
    df = spark.createDataFrame([], "parent long, child long")
    assert network.betweenness(df).count() == 0
    one = network.shortest_paths(df, spark.createDataFrame([(1,)], "source long")).collect()
    assert [(r.source, r.node, r.dist, r.paths) for r in one] == [(1, 1, 0, 1.0)]


def test_subtree_shapes(spark):
    r = random.Random(3)
    parent = {i: r.randrange(max(1, i // 2)) for i in range(1, 120)}
    label = {i: r.choice(["a", "b", None]) for i in range(120)}
    children = {}
    for c, p in parent.items():
        children.setdefault(p, []).append(c)

    def form(v):
        return (label[v], tuple(sorted((form(c) for c in children.get(v, [])), key=repr)))

    def height(v):
        return 1 + max(map(height, children[v])) if v in children else 0

    size = lambda f: 1 + sum(map(size, f[1]))
    edge = spark.createDataFrame([(p, c) for c, p in parent.items()], "parent long, child long")
    nodes = spark.createDataFrame(list(label.items()), "node long, label string")
    got = network.subtree_shapes(edge, nodes)
    found = {x.node: (x.shape, x.size, x.height) for x in got.collect()}
    assert set(found) == set(label)
    by_shape, by_form = {}, {}
    for v in label:
        assert found[v][1:] == (size(form(v)), height(v))
        by_shape.setdefault(found[v][0], set()).add(v)
        by_form.setdefault(form(v), set()).add(v)
    assert sorted(map(sorted, by_shape.values())) == sorted(map(sorted, by_form.values()))
    again = {(min(vs), size(f), len(vs)) for f, vs in by_form.items() if size(f) > 1 and len(vs) > 1}
    assert {(x.example, x.size, x.copies) for x in network.recurrent_structures(got).collect()} == again and again


def test_subtrees_need_a_forest(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "node long, label string")
    with pytest.raises(ValueError, match="several parents"):
        network.subtree_shapes(spark.createDataFrame([(1, 3), (2, 3)], "parent long, child long"), nodes)
    assert network.subtree_shapes(spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"), nodes).count() == 1  # 3 alone
    assert network.subtree_shapes(spark.createDataFrame([], "parent long, child long"), nodes.limit(0)).count() == 0


# Models ------------------------------------------------------------------------------------------------------------


def figures(spark, seed=1, n=300):
    r = np.random.default_rng(seed)
    g = r.choice(["a", "b", None], n)
    x = r.normal(size=(n, 3)) @ r.normal(size=(3, 3)) + 1e4
    got = [(None if g[i] is None else str(g[i]), int(r.integers(5)), *(float(v) if r.random() > 0.03 else None for v in x[i]), i) for i in range(n)]
    return got, spark.createDataFrame(got, "g string, t int, x double, y double, z double, id long")


def test_mahalanobis(spark):
    got, df = figures(spark)
    cols = ["x", "y", "z"]
    found = {r.id: r.distance for r in models.mahalanobis(df, cols, ["g"]).collect()}
    assert len(found) == len(got)
    for g in ("a", "b", None):
        part = [r for r in got if r[0] == g]
        whole = np.array([r[2:5] for r in part if None not in r[2:5]])
        inverse = np.linalg.inv(np.cov(whole.T))
        for r in part:
            if None in r[2:5]:
                assert found[r[5]] is None
            else:
                off = np.array(r[2:5]) - whole.mean(axis=0)
                assert found[r[5]] == pytest.approx(np.sqrt(off @ inverse @ off), rel=1e-6)
    alone = {r.distance for r in models.mahalanobis(df.limit(1), cols).collect()} | {r.distance for r in models.mahalanobis(df.withColumn("y", F.col("x") * 2), cols).collect()}
    assert alone == {None} and models.mahalanobis(df.limit(0), cols).count() == 0


def test_partial_correlations(spark):
    got, df = figures(spark, 2)
    cols = ["x", "y", "z"]
    found = {(r.g, r.one, r.other): (r.n, r.correlation, r.partial) for r in models.partial_correlations(df, cols, ["g"]).collect()}
    assert len(found) == 9
    for g in ("a", "b", None):
        whole = np.array([r[2:5] for r in got if r[0] == g and None not in r[2:5]])
        c, p = np.corrcoef(whole.T), np.linalg.inv(np.corrcoef(whole.T))
        for i, j in ((0, 1), (0, 2), (1, 2)):
            want = len(whole), c[i, j], -p[i, j] / np.sqrt(p[i, i] * p[j, j])
            assert found[g, cols[i], cols[j]] == pytest.approx(want, rel=1e-6)
    flat = models.partial_correlations(df.withColumn("y", F.lit(1.0)), cols).collect()
    assert [(r.one, r.correlation is None, r.partial) for r in sorted(flat, key=lambda r: (r.one, r.other))] == [("x", True, None), ("x", False, None), ("y", True, None)]


def plain_effects(got, effects, cluster):
    """Dummies of all effects, least squares, and errors with the documented degrees of freedom."""
    part = [r for r in got if None not in r[2:5]]
    y, x = np.array([r[2] for r in part]), np.array([r[3:5] for r in part])
    dummies = [np.array([[float(r[e] == v) for v in sorted({r[e] for r in part}, key=repr)] for r in part]) for e in effects]
    d = np.hstack([np.ones((len(part), 1)), *dummies])
    clean = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x, y = clean(x), clean(y)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, n = y - x @ beta, len(part)
    counted = [len({r[c] for r in part}) for c in effects if c != cluster]
    absorbed = max(1, sum(counted) - max(0, len(effects) - 1)) if effects else 1
    if cluster is None:
        return beta, np.sqrt(np.diag(inverse) * (e @ e) / (n - 2 - absorbed))
    groups = [[i for i, r in enumerate(part) if r[cluster] == v] for v in {r[cluster] for r in part}]
    scores = np.array([x[i].T @ e[i] for i in groups])
    return beta, np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse) * len(groups) / (len(groups) - 1) * (n - 1) / (n - 2 - absorbed))


@pytest.mark.parametrize("effects,cluster", [(["g", "t"], "g"), (["g", "t"], None), (["g"], "t"), ([], None), (["t"], "t")])
def test_fixed_effects_against_dummies(spark, effects, cluster):
    got, df = figures(spark, 4)
    at = {"g": 0, "t": 1}
    found = {r.term: (r.beta, r.se) for r in models.absorbed_regression(df, "x", ["y", "z"], effects, cluster).collect()}
    beta, se = plain_effects(got, [at[e] for e in effects], at.get(cluster))
    assert found["y"] == pytest.approx((beta[0], se[0]), rel=1e-6) and found["z"] == pytest.approx((beta[1], se[1]), rel=1e-6)


def test_fixed_effects_of_odd_tables(spark):
    _, df = figures(spark, 5)
    assert [(r.beta, r.se, r.n) for r in models.absorbed_regression(df.limit(0), "x", ["y"], ["g"]).collect()] == [(None, None, 0)]
    assert [r.se for r in models.absorbed_regression(df.withColumn("c", F.lit(1)), "x", ["y"], ["g"], "c").collect()] == [None]
    for wrong in (["y", "w"], ["v"]):
        with pytest.raises(ValueError, match="explained"):
            models.absorbed_regression(df.withColumns({"w": F.col("y") * 3 + 1, "v": F.col("t") * 2.5}), "x", wrong, ["g", "t"])


def test_ranks_without_one_task_a_group(spark):
    r = random.Random(2)
    got = [(r.choice(["hot"] * 9 + ["a", None]), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(got, "g string, v int, id long").repartition(7)
    found = {x.id: x.rank for x in windows.ranked(df, ["g"], ["v", "id"], "rank").collect()}
    for g in ("hot", "a", None):
        part = sorted((v, i) for h, v, i in got if h == g)
        assert [found[i] for _, i in part] == list(range(1, len(part) + 1))
    assert windows.ranked(df.limit(0), ["g"], ["v"], "rank").count() == 0


def test_permutations_keep_the_labels_of_a_stratum(spark):
    got = [(i, i % 3 if i % 7 else None, "xyz"[i * i % 3] if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(got, "id long, s long, label string")
    found = models.permuted(df, "label", ["s"], ["id"], 4, 9).collect()
    assert len(found) == 800 and all(r.label == got[r.id][2] and r.s == got[r.id][1] for r in found)
    deals = {}
    for k in range(1, 5):
        for s in (0, 1, 2, None):
            part = [r for r in found if r.permutation == k and r.s == s]
            assert Counter(r.shuffled for r in part) == Counter(r.label for r in part)
        deals[k] = tuple(r.shuffled for r in sorted(found, key=lambda r: r.id) if r.permutation == k)
    assert len(set(deals.values())) == 4
    again = models.permuted(df.repartition(5), "label", ["s"], ["id"], 4, 9)
    assert rows(again) == sorted(map(tuple, found), key=repr)


def test_permutation_test_sees_what_is_there(spark):
    r = random.Random(1)
    mine = [(i, i % 2, i % 5, i % 5) for i in range(300)]  # two labels that agree on every row
    none = [(i, i % 2, r.randrange(5), i % 5) for i in range(300)]
    same = lambda c: F.count_if(F.col(c) == F.col("other"))
    a, b = (models.permutation_test(spark.createDataFrame(x, "id long, s long, label long, other long"), "label", ["s"], ["id"], same, 39).first() for x in (mine, none))
    assert (a.observed, a.at_least, a.times, a.p_high) == (300.0, 0, 39, 1 / 40) and a.p_low == 1 and a.expected < 100
    assert b.p_high > 1 / 40 and b.at_least + b.at_most >= 39
    empty = models.permutation_test(spark.createDataFrame([], "id long, s long, label long, other long"), "label", ["s"], ["id"], lambda c: F.max(c), 3).first()
    assert empty.observed is None and empty.p_high is None and empty.times == 0


def test_clusters_from_fixed_starts(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(c, 1, (40, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id long, a double, b double")
    starts = [(1.0, 1.0), (2.0, 2.0), (1.0, 2.0), (500.0, 500.0)]
    centres = np.array(starts)
    for _ in range(50):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(4)])
        if np.allclose(new, centres, rtol=0, atol=0):
            break
        centres = new
    found = {r.id: r.cluster for r in stats.nearest_centres(df, ["a", "b"], starts, 50).collect()}
    assert [found[i] for i in range(len(x))] == near.tolist() and found[999] is None


# Rows without a group ------------------------------------------------------------------------------------------------


def test_null_groups_have_figures(spark):
    got = [(g, float(v), i) for i, (g, v) in enumerate([(None, 1), (None, 2), (None, 3), (None, 90), ("a", 5), ("a", 6), ("a", 8)])]
    df = spark.createDataFrame(got, "g string, v double, k long")
    assert {r.g: (r.n, r.p50) for r in stats.descriptives(df, "v", ["g"], [0.5]).collect()} == {None: (4, 2.5), "a": (3, 6.0)}
    assert [(r.g, r.v, r._median, r._mad) for r in select.outliers(df, "v", 3.0, ["g"]).collect()] == [(None, 90.0, 2.5, 1.0)]
    assert Counter(r.dropped for r in stats.left_out(df, "g").collect()) == {None: 3, "a": 4}
    assert {r.g: r.n for r in stats.spearman(df, "v", "k", ["g"]).collect()} == {None: 4, "a": 3}
    assert {r.g for r in stats.gini(df, "v", ["g"]).collect()} == {None, "a"}
    path = spark.createDataFrame([(None, 0, "x"), (None, 1, "y"), (1, 0, "x")], "root long, depth int, c string")
    assert {r.root: (r.max_depth, r.n_nodes) for r in graph.complexity(path, "root", "c").collect()} == {None: (1, 2), 1: (0, 1)}


@pytest.mark.parametrize("buckets", [3, 1000])
def test_quantiles_without_a_group(spark, buckets):
    r = random.Random(6)
    got = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.choice([None, round(r.gauss(0, 3), 1)])) for _ in range(900)] + [("only nulls", None)]
    df = spark.createDataFrame(got, "g string, v double").repartition(4)
    found = {(x.dropped, x.p): x.quantile for x in stats.left_out_quantiles(df, "g", "v", [0.0, 0.5, 0.9], buckets).collect()}
    for g in {g for g, _ in got}:
        rest = [v for h, v in got if h != g and v is not None]
        assert [found[g, p] for p in (0.0, 0.5, 0.9)] == pytest.approx(np.quantile(rest, [0, 0.5, 0.9]).tolist())
    one = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert stats.left_out_quantiles(one, "g", "v", [0.5]).count() == stats.left_out_quantiles(one.limit(0), "g", "v", [0.5]).count() == 0


def test_filters_are_recorded(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (5, "b"), (7, "a")], "v int, g string")
    kept, record = select.recorded_filters(df, {"big": "v > 1", "of a": "g = 'a'"})
    assert rows(kept) == [(7, "a")]
    assert rows(record) == [(1, "big", "v > 1", 5, 3, 1), (2, "of a", "g = 'a'", 3, 1, 1)]
    assert rows(select.recorded_filters(df.limit(0), {"big": "v > 1"})[1]) == [(1, "big", "v > 1", 0, 0, 0)]


def test_figures_beside_rows_whatever_the_names(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "g string, _by_g int")
    for few in (True, False, None):
        made = keys.beside(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), ["g"], few=few)
        assert made.columns == ["g", "_by_g", "n"] and sorted(r.n for r in made.collect()) == [1, 1, 1]


def test_regressions_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 1), (2.0, 3.0, 6.0, 1), (4.0, 5.0, 10.0, 1), (4.0, 7.0, 14.0, 1)], "y double, x double, twice double, g int")
    assert [(r.beta, r.se, r.n) for r in stats.regression_table(df.limit(0), "y", ["x"]).collect()] == [(None, None, 0)] * 2
    assert [r.se for r in stats.regression_table(df, "y", ["x"], "g").collect()] == [None, None]
    assert [r.se for r in stats.regression_table(df.limit(2), "y", ["x"]).collect()] == [None, None]
    for wrong in (["x", "twice"], ["g"]):
        with pytest.raises(ValueError, match="made of"):
            stats.regression_table(df, "y", wrong)


# Time --------------------------------------------------------------------------------------------------------------


def test_as_of_join(spark):
    r = random.Random(4)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.randrange(300) if r.random() > 0.03 else None) for i in range(900)]
    right = [(key(), r.randrange(300) if r.random() > 0.03 else None, i) for i in range(120)]
    a = spark.createDataFrame(left, "id long, k string, at int").repartition(5)
    b = spark.createDataFrame(right, "k string, since int, v long").repartition(3)
    got = {x.id: (x.since, x.v) for x in windows.as_of_join(a, b, "k", "at", "since", ["v"], tie="v").collect()}
    want = {}
    for i, k, at in left:
        known = [(s, v) for kk, s, v in right if k is not None and kk == k and s is not None and at is not None and s <= at]
        want[i] = max(known, default=(None, None))
    assert got == want and sum(v[1] is not None for v in want.values()) > 300
    assert windows.as_of_join(a, b.limit(0), "k", "at", "since", ["v"]).filter("v IS NOT NULL").count() == 0
    assert windows.as_of_join(a.limit(0), b, "k", "at", "since", ["v"]).count() == 0


def test_as_of_join_within(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    a = spark.createDataFrame([(1, t(9)), (1, t(20))], "k int, ts timestamp")
    b = spark.createDataFrame([(1, t(5), "x")], "k int, ts timestamp, v string")
    got = windows.as_of_join(a, b, "k", "ts", "ts", ["v"], within=F.expr("INTERVAL 7 DAYS"))
    assert got.columns == ["k", "ts", "right_ts", "v"]
    assert sorted((r.ts.day, r.v) for r in got.collect()) == [(9, "x"), (20, None)]


def test_trailing_years_have_gaps(spark):
    df = spark.createDataFrame([("a", 2001, 1), ("a", 2002, 2), ("a", 2005, 4), ("a", 2006, 8), ("a", 2006, 16), ("b", 2002, 5)], "k string, y int, v int")
    got = {(r.k, r.y): (r.trailing, r.trailing_rows) for r in windows.trailing(df, ["k"], "y", "v", 1).collect()}
    assert got == {("a", 2001): (1, 1), ("a", 2002): (3, 2), ("a", 2005): (4, 1), ("a", 2006): (28, 3), ("b", 2002): (5, 1)}


def test_streams_drop_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    arrive = lambda minutes: spark.createDataFrame([(base + dt.timedelta(minutes=m), "k", 1.0) for m in minutes], "ts timestamp, key string, v double").coalesce(1).write.mode("append").parquet(landing)
    read = lambda: spark.readStream.schema("ts timestamp, key string, v double").parquet(landing)

    def run():
        windows.run_once(windows.tumbling_stream(read(), "ts", "10 minutes", "20 minutes", ["key"], "v"), out, state)
        made = spark.read.schema("start timestamp, key string, n bigint, total double").parquet(out)
        return sorted((int((r.start - base).total_seconds() // 60), r.n) for r in made.collect())

    arrive([1, 2, 12, 45])  # the watermark comes to 25: two windows have ended
    assert run() == [(0, 2), (10, 1)]
    arrive([3, 13, 21, 100])  # 3 and 13 are late, 21 is not: its window was open
    assert run() == [(0, 2), (10, 1), (20, 1), (40, 1)]


def test_stream_sessions_close(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    arrive = lambda minutes: spark.createDataFrame([(base + dt.timedelta(minutes=m), "k") for m in minutes], "ts timestamp, key string").coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = spark.readStream.schema("ts timestamp, key string").parquet(landing)
        windows.run_once(windows.session_stream(stream, "ts", "5 minutes", "10 minutes", "key"), out, state)
        return sorted((int((r.start - base).total_seconds() // 60), r.n) for r in spark.read.schema("key string, start timestamp, n bigint").parquet(out).collect())

    arrive([0, 3, 20, 40])
    assert run() == [(0, 2), (20, 1)]
    arrive([22, 36, 80])  # 22 is late; 36 joins the open session of 40
    assert run() == [(0, 2), (20, 1), (36, 2)]


def kept_sessions(spark, tmp_path, arrivals, schema="k string, ts timestamp"):
    """The sessions that have ended after each arrival: gaps of 5 minutes, a watermark of 10."""
    landing, kept, state, told = *(str(tmp_path / x) for x in ("landing", "kept", "state")), []
    for part in arrivals:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        windows.keep_sessions(spark.readStream.schema(schema).parquet(landing), "ts", "5 minutes", "10 minutes", "k", kept, state)
        told.append(rows(windows.ended_sessions(spark, kept)))
    return told


def test_kept_sessions_join_after_their_end(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first, second, third = kept_sessions(spark, tmp_path, [
        [("a", at(0)), ("a", at(22)), ("b", at(26)), (None, at(1)), ("c", None), ("z", at(40))],
        [("a", at(26)), ("a", at(24)), ("b", at(31)), ("z", at(41))],
        [("a", at(27)), ("z", at(60))],
    ])
    assert first == [("a", at(0), 1), ("a", at(22), 1), (None, at(1), 1)]  # up to 30
    assert second == [("a", at(0), 1), ("a", at(22), 2), ("b", at(26), 1), (None, at(1), 1)]  # up to 31: 24 is late, 26 joins 22
    assert third == [("a", at(0), 1), ("a", at(22), 3), ("b", at(26), 1), ("b", at(31), 1), ("z", at(40), 2), (None, at(1), 1)]


@pytest.mark.parametrize("seed", range(3))
def test_kept_sessions_against_a_plain_loop(spark, tmp_path, seed):
    r, base, minute = random.Random(seed), dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    arrivals = [[(r.choice(["a", "b", None]), base + r.randrange(max(0, 25 * i - 40), 25 * i + 30) * minute) for _ in range(25)] for i in range(4)]
    arrivals.insert(2, [])
    want, held, passed = [], [], None
    for part in arrivals:
        held += [(k, t) for k, t in part if passed is None or t + 5 * minute > passed]
        passed = max([t - 10 * minute for _, t in part] + [passed or base - 10 * minute])
        made = []
        for k in ("a", "b", None):
            for t in sorted(t for x, t in held if x == k):
                if made and made[-1][0] == k and t - made[-1][1][-1] < 5 * minute:
                    made[-1][1].append(t)
                else:
                    made.append((k, [t]))
        want.append(sorted(((k, ts[0], len(ts)) for k, ts in made if ts[-1] + 5 * minute <= passed), key=repr))
    assert kept_sessions(spark, tmp_path, arrivals, "k string, ts timestamp_ntz") == want


def test_kept_sessions_of_no_rows(spark, tmp_path):
    assert kept_sessions(spark, tmp_path, [[], [("a", None)]]) == [[], []]


# Names -------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("most,alphabet", [(1, "ab"), (2, "ab"), (2, "abcdé")])
def test_near_names_against_all_pairs(spark, most, alphabet):
    r = random.Random(most)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6, 7, 9, 14))))
    a, b = [word() for _ in range(70)], [word() for _ in range(70)]
    for _ in range(25):
        w = list(r.choice(a))
        for _ in range(r.randrange(1, most + 2)):
            w[r.randrange(len(w) + 1) : r.randrange(len(w) + 1)] = r.choice(alphabet)
        b.append("".join(w))
    df = lambda names: spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string")
    got = rows(matching.near_names(df(a), df(b), most))
    want = sorted({(x, y, edits(x, y)) for x in a for y in b if edits(x, y) <= most}, key=repr)
    assert got == want


def test_best_name_anywhere(spark):
    left = spark.createDataFrame([(1, "acme ltd"), (2, "acme lt"), (3, None), (4, "zeta"), (5, "acme ltd")], "id long, name string")
    right = spark.createDataFrame([(10, "acme ltd."), (11, "acme ltd"), (9, "acme ltd"), (12, "beta corp"), (13, None)], "id long, name string")
    got = {r.id: (r.match_key, r.match_name, r.distance, r.match_status) for r in matching.best_name_anywhere(left, right, "id", "name").collect()}
    hit, none = (9, "acme ltd", 0, "matched"), (None, None, None, "not_matched")
    assert got == {1: hit, 5: hit, 2: (9, "acme ltd", 1, "matched"), 3: none, 4: none}
    assert matching.best_name_anywhere(left, right.limit(0), "id", "name").filter("match_key IS NOT NULL").count() == 0


# Sources and sinks ---------------------------------------------------------------------------------------------------


def test_digest_and_writing_only_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "k int, v string")
    digest = lambda d: tuple(sources.table_digest(d).first())
    assert digest(df) == digest(df.repartition(3)) and digest(df) != digest(df.distinct())
    swapped = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (2, "a")], "k int, v string")
    assert digest(df) != digest(swapped) != digest(df.limit(0))
    path = str(tmp_path / "out")
    files = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet")
    assert sources.write_if_changed(df, path)
    held = files()
    assert not sources.write_if_changed(df.repartition(2), path) and files() == held
    assert sources.write_if_changed(swapped, path) and files() != held
    with pytest.raises(ValueError, match="overwrite"):
        sources.write_if_changed(df, path, (path,))
    assert rows(spark.read.parquet(path)) == rows(swapped)


def test_stata_files_as_a_table(spark):
    pdf = [(i, None if i % 4 == 0 else f"näme {i}", i / 2 if i % 3 else None, dt.date(2020, 1, 1 + i)) for i in range(20)]
    df = spark.createDataFrame(pdf, "id int, name string, x double, d date").repartition(3)
    files = sources.stata_files(df, 4)
    assert files.count() > 4
    back = sources.stata_rows(files)
    assert sorted((r.id, r.name, r.x, r.d) for r in back.collect()) == pdf
    with pytest.raises(ValueError, match="no file"):
        sources.stata_rows(files.limit(0))


def test_stata_files_that_spark_opens(spark, tmp_path):
    pd.DataFrame({"a": [1, 2], "b": ["x", ""]}).to_stata(tmp_path / "one.dta", write_index=False)
    pd.DataFrame({"a": [3], "b": ["z"]}).to_stata(tmp_path / "two.dta", write_index=False)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.a, r.b) for r in sources.stata_rows(files).collect()) == [(1, "x"), (2, None), (3, "z")]


def test_computed_findings_are_recorded_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    text = "result statistic denominator interest robustness mundane data_quality falsification".split()
    source = ledger.Provenance(*(["x"] * 10))
    made = lambda ids: spark.createDataFrame([(i, *text) for i in ids], ", ".join(f"{c} string" for c in ["finding_id", *text]))
    ledger.record_rows(made(["C-F001", "X-F002"]), path, source)
    ledger.record_rows(made(["C-F001"]).withColumn("version", F.lit(2)), path, source)
    assert [(r.finding_id, r.version, r.provenance.unit) for r in spark.read.parquet(path).orderBy("finding_id", "version").collect()] == [("C-F001", 1, "x"), ("C-F001", 2, "x"), ("X-F002", 1, "x")]
    for wrong, why in ((["F1"], "not a finding id"), (["C-F009", "C-F009"], "recorded before"), (["X-F002"], "recorded before")):
        with pytest.raises(ValueError, match=why):
            ledger.record_rows(made(wrong), path, source)
    assert spark.read.parquet(path).count() == 3
