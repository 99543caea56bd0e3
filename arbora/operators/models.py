"""Regressions with absorbed effects, joint outliers, partial correlations and permutation tests.

Rows are read once and cut to sums by group or cell; what follows works on those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.keys import FEW, beside
from arbora.streaming.windows import ranked
from arbora.tables import Scratch, materialize, remove

# Moments -----------------------------------------------------------------------------------------------------------


def complete(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def moments(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by, n, mean, cov``: arrays over the rows that have all columns; ``cov`` is the upper triangle, row by row."""
    x = [F.col(c).cast("double") for c in columns]
    k = range(len(x))
    return df.filter(complete(columns)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, x)).alias("mean"), F.array(*(F.covar_samp(x[i], x[j]) for i in k for j in k if j >= i)).alias("cov")
    )


def _square(triangle, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = [np.nan if v is None else v for v in triangle]
    return np.triu(out) + np.triu(out, 1).T


def _inverted(m: np.ndarray) -> np.ndarray | None:
    """The inverse of a covariance matrix; none where a column does not vary, or is made of others."""
    scale = np.sqrt(np.diag(m))
    if not np.isfinite(m).all() or not (scale > 0).all():
        return None
    alike = m / np.outer(scale, scale)
    return np.linalg.inv(alike) / np.outer(scale, scale) if np.linalg.cond(alike) < 1e10 else None


def mahalanobis(df: DataFrame, columns: list[str], by: list[str] | None = None, name: str = "distance") -> DataFrame:
    """Adds how far a row lies from its group's centre, all columns taken together: the Mahalanobis distance.

    One pass finds means and covariances; executors invert one small matrix a group, and a second pass scores each row
    in the JVM. Rows without one of the columns have no distance, nor have rows of groups whose columns do not vary or
    depend on one another, or that have no more complete rows than columns. A null group is a group.
    """
    by, k = by or [], len(columns)

    def invert(frames):
        for frame in frames:
            found = [_inverted(_square(c, k)) if n > k else None for c, n in zip(frame["cov"], frame["n"])]
            frame["inverse"] = [None if m is None else m.ravel().tolist() for m in found]
            yield frame.drop(columns=["cov", "n"])

    figures = moments(df, columns, by)
    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + ["mean array<double>", "inverse array<double>"])
    figures, _ = materialize(figures.mapInPandas(invert, kinds).withColumnsRenamed({"mean": "_mean", "inverse": "_inverse"}), "moments")
    off = [F.col(c).cast("double") - F.col("_mean")[i] for i, c in enumerate(columns)]
    square = reduce(lambda a, b: a + b, (off[i] * off[j] * F.col("_inverse")[i * k + j] for i in range(k) for j in range(k)))
    return beside(df, figures, by).withColumn(name, F.when(square.isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))))).drop("_mean", "_inverse")


def partial_correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``by, one, other, n, correlation, partial`` for each pair of columns, over the rows that have all of them.

    ``partial`` holds all other columns fixed; it comes from the inverse of the matrix of correlations. Groups whose
    columns do not vary have neither; where a column is made of others, or there are no more rows than columns, there is no
    ``partial``.
    """
    by, k = by or [], len(columns)

    def solve(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                m = _square(row.cov, k)
                with np.errstate(all="ignore"):
                    scale = np.sqrt(np.diag(m))
                    plain = m / np.outer(scale, scale)
                inverse = _inverted(m) if row.n > k else None
                for i in range(k):
                    for j in range(i + 1, k):
                        held = None if inverse is None else float(-inverse[i, j] / np.sqrt(inverse[i, i] * inverse[j, j]))
                        seen = float(plain[i, j]) if np.isfinite(plain[i, j]) else None
                        rows.append((*(getattr(row, f"g{b}") for b in range(len(by))), columns[i], columns[j], row.n, seen, held))
            yield pd.DataFrame(rows, columns=[f"g{b}" for b in range(len(by))] + ["one", "other", "n", "correlation", "partial"])

    kinds = [f"g{b} {df.schema[c].dataType.simpleString()}" for b, c in enumerate(by)]
    kinds += ["one string", "other string", "n bigint", "correlation double", "partial double"]
    plain = moments(df, columns, by).withColumnsRenamed({c: f"g{b}" for b, c in enumerate(by)})
    return plain.mapInPandas(solve, ", ".join(kinds)).withColumnsRenamed({f"g{b}": c for b, c in enumerate(by)})


# Absorbed effects --------------------------------------------------------------------------------------------------

TERMS = "term string, beta double, se double, n bigint, absorbed bigint, clusters bigint"


def absorbed_regression(
    df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: str | None = None, tolerance: float = 1e-12, rounds: int = 1000
) -> DataFrame:
    """``term, beta, se, n, absorbed, clusters`` of a regression on several columns with fixed effects for each of ``effects``.

    Rows are cut once to cells, the combinations of effects and cluster, with the sums and products of all columns.
    Group means are then taken out effect by effect, round after round, on the cells, until no mean moves by more than
    ``tolerance`` of a column's spread. Coefficients and errors come from the cells' products, of which k by k reach the
    driver. Errors are robust to ``cluster``, else homoscedastic; degrees of freedom count the regressors and the levels
    of the effects, less one for each effect after the first; the cluster's own levels do not count.

    Rows without ``y`` or a regressor are left out; a null effect or cluster is a level. An empty table, a single
    cluster, and too few rows give null errors; an empty table gives null coefficients. A regressor that the effects or
    others explain raises ``ValueError``, as does a search that has not settled after ``rounds``.
    """
    spark, names = df.sparkSession, [y, *xs]
    k, pairs = len(names), [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    keys = list(dict.fromkeys([*effects, *([cluster] if cluster else [])]))
    known = df.filter(complete(names)).select(*(F.col(c).alias(f"e{i}") for i, c in enumerate(keys)), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    # Columns are centred first, so that large levels do not eat the digits of the products.
    whole = known.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{i}").alias(f"m{i}") for i in range(k)), *(F.stddev_pop(f"v{i}").alias(f"d{i}") for i in range(k))).first()
    if not whole["n"]:
        return spark.createDataFrame([(x, None, None, 0, 0, 0) for x in xs], TERMS)
    known = known.withColumns({f"v{i}": F.col(f"v{i}") - whole[f"m{i}"] for i in range(k)})
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    cells = known.groupBy(*(f"e{i}" for i in range(len(keys)))).agg(F.count(F.lit(1)).alias("n"), *sums)
    scratch = Scratch(spark)
    cells = scratch.table(cells.withColumns({f"a{i}": F.lit(0.0) for i in range(k)}), "cells")
    places = [f"e{keys.index(e)}" for e in effects]
    levels = cells.agg(*(F.count_distinct(F.struct(e)).alias(e) for e in places)).first() if places else {}
    spread, path = [max(whole[f"d{i}"], 1e-300) for i in range(k)], None
    for _ in range(rounds if places else 0):
        moved = []
        for e in places:
            mean = lambda i: (F.sum(F.col(f"s{i}") - F.col("n") * F.col(f"a{i}")) / F.sum("n")).alias(f"_m{i}")
            means = cells.groupBy(e).agg(*map(mean, range(k)))
            step, step_path = materialize(
                beside(cells, means, [e], few=levels[e] <= FEW).withColumns({f"a{i}": F.col(f"a{i}") + F.col(f"_m{i}") for i in range(k)}), "cells"
            )
            moved.append(step.agg(*(F.max(F.abs(f"_m{i}")).alias(f"x{i}") for i in range(k))).first())
            cells = step.drop(*(f"_m{i}" for i in range(k)))
            if path:
                remove(spark, path)
            path = step_path
        if len(places) == 1 or all(row[f"x{i}"] <= tolerance * spread[i] for row in moved for i in range(k)):
            break
    else:
        if places:
            raise ValueError(f"the means of the effects still move after {rounds} rounds")
    left = lambda i, j: F.col(f"p{i}_{j}") - F.col(f"a{i}") * F.col(f"s{j}") - F.col(f"a{j}") * F.col(f"s{i}") + F.col("n") * F.col(f"a{i}") * F.col(f"a{j}")
    by_cluster = [f"e{keys.index(cluster)}"] if cluster else []
    parts, _ = materialize(cells.groupBy(*by_cluster).agg(*(F.sum(left(i, j)).alias(f"r{i}_{j}") for i, j in pairs)), "products")
    row = parts.agg(*(F.sum(f"r{i}_{j}").alias(f"r{i}_{j}") for i, j in pairs), F.count(F.lit(1)).alias("g")).first()
    full = _square([row[f"r{i}_{j}"] for i, j in pairs], k)
    n, inner = whole["n"], full[1:, 1:]
    absorbed = sum(levels[e] for e in places if e not in by_cluster) - max(0, len(places) - 1) if places else 1
    absorbed = max(absorbed, 1)
    scale = np.sqrt(np.maximum(np.diag(inner), 0.0))
    raw = np.array([spread[i] for i in range(1, k)]) * np.sqrt(n)
    if (scale <= 1e-8 * raw).any() or np.linalg.cond(inner / np.outer(scale, scale)) > 1e10:
        scratch.drop()
        raise ValueError(f"of {xs}, one is explained by the effects or by the others")
    inverse = np.linalg.inv(inner / np.outer(scale, scale)) / np.outer(scale, scale)
    beta, free, clusters = inverse @ full[1:, 0], n - (k - 1) - absorbed, row["g"] if cluster else 0
    errors: list[float | None] = [None] * (k - 1)
    if cluster and clusters > 1 and free > 0:
        score = [F.col(f"r0_{j}") - reduce(lambda a, b: a + b, (F.lit(float(beta[i - 1])) * F.col(f"r{min(i, j)}_{max(i, j)}") for i in range(1, k))) for j in range(1, k)]
        meat = parts.agg(*(F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k - 1) for j in range(i, k - 1))).first()
        cov = inverse @ _square(list(meat), k - 1) @ inverse * (clusters / (clusters - 1)) * ((n - 1) / free)
        errors = np.sqrt(np.diag(cov)).tolist()
    elif not cluster and free > 0:
        errors = np.sqrt(np.diag(inverse) * max(0.0, full[0, 0] - beta @ full[1:, 0]) / free).tolist()
    scratch.drop()
    return spark.createDataFrame([(x, float(b), e, n, int(absorbed), int(clusters)) for x, b, e in zip(xs, beta, errors)], TERMS)


# Permutations ------------------------------------------------------------------------------------------------------


def permuted(df: DataFrame, label: str, strata: list[str], key: list[str], times: int, seed: int) -> DataFrame:
    """``df`` once for each of ``times`` permutations, ``permutation``, with ``shuffled``: the labels dealt out anew inside strata.

    ``key`` names the rows. A row's place in a permutation is its rank by a seeded hash of its key, and it takes the
    label of the row with the same rank by another; ranks are made by ranges and offsets, so no stratum, however large,
    meets in one task. Keys must be unique; null strata are a stratum.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    each = df.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(times))))
    named = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    hashed = lambda what: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col("permutation").cast("string"), named))
    rows = each.withColumns({"_take": hashed("take"), "_give": hashed("give")})
    by = [*strata, "permutation"]
    takers = scratch.table(ranked(rows.drop("_give"), by, ["_take"], "_rank").drop("_take"), "takers")
    givers = scratch.table(ranked(rows.select(*by, F.col(label).alias("shuffled"), "_give"), by, ["_give"], "_rank").drop("_give"), "givers")
    made, _ = materialize(beside(takers, givers, [*by, "_rank"], "inner", few=False).drop("_rank"), "permuted")
    scratch.drop()
    return made


def permutation_test(
    df: DataFrame, label: str, strata: list[str], key: list[str], statistic: Callable[[str], Column], times: int = 199, seed: int = 1
) -> DataFrame:
    """``observed, expected, at_least, at_most, times, p_high, p_low``: a statistic against its distribution under permutation.

    ``statistic(column)`` aggregates the table with ``column`` as label. The p-values are exact for a test by random
    permutations: ``(1 + those at least, or at most, as large) / (1 + times)``. An empty table gives nulls.
    """
    under = permuted(df, label, strata, key, times, seed).groupBy("permutation").agg(statistic("shuffled").cast("double").alias("value"))
    seen = df.agg(statistic(label).cast("double").alias("observed"))
    made = under.crossJoin(F.broadcast(seen)).groupBy().agg(  # one row
        F.max("observed").alias("observed"), F.avg("value").alias("expected"),
        F.count_if(F.col("value") >= F.col("observed")).alias("at_least"), F.count_if(F.col("value") <= F.col("observed")).alias("at_most"),
        F.count(F.lit(1)).alias("times"),
    )
    p = lambda c: F.when(F.col("observed").isNotNull(), (F.col(c) + 1) / (F.col("times") + 1))
    return made.withColumns({"p_high": p("at_least"), "p_low": p("at_most")})
