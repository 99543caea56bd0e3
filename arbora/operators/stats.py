"""Concentration, shares, weightings, robustness and small regressions, with numerators and denominators beside ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.keys import beside
from arbora.streaming.windows import ranked
from arbora.tables import Scratch, materialize, remove

#: Rank error of the sketch that finds where a quantile lies, as one over this; and groups that may be left out in turn.
ACCURACY, MOST_GROUPS = 10_000, 10_000


def shares(df: DataFrame, group: list[str], category: str, weight: str | None = None) -> DataFrame:
    """``num, den, share`` of every category within its group."""
    num = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*group, category).agg(num.alias("num"))
    return counted.withColumn("den", F.sum("num").over(Window.partitionBy(*group))).withColumn(
        "share", F.try_divide(F.col("num").cast("double"), F.col("den").cast("double"))
    )


def concentration(df: DataFrame, group: list[str], category: str, weight: str | None = None) -> DataFrame:
    """HHI, entropy, effective number, top share and number of categories by group; non-positive shares add nothing."""
    s = F.when(F.col("share") > 0, F.col("share"))
    made = shares(df, group, category, weight).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.max("den").alias("den"),
        F.sum(s * s).alias("hhi"),
        (-F.sum(s * F.ln(s))).alias("entropy"),
        F.max("share").alias("top_share"),
    )
    return made.withColumn("effective_number", F.exp("entropy"))


def count_value_gap(df: DataFrame, category: str, value: str) -> DataFrame:
    """Count share and value share of every category with their difference and ranks."""
    whole = Window.partitionBy()
    made = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    made = made.withColumns(
        {
            "count_share": F.col("n") / F.sum("n").over(whole),
            "value_share": F.try_divide(F.col("total").cast("double"), F.sum("total").over(whole).cast("double")),
        }
    )
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))  # noqa: E731  a few categories
    return made.withColumns(
        {"gap": F.col("value_share") - F.col("count_share"), "rank_gap": rank("total").cast("bigint") - rank("n").cast("bigint")}
    )


def one_currency_sum(df: DataFrame, group: list[str], value: str, currency: str = "currency", units: str = "units", rates: DataFrame | None = None) -> DataFrame:
    """Sums within one currency and unit; with ``rates(currency, units, rate)`` across them. Unrated rows raise."""
    if rates is None:
        if df.select(currency, units).distinct().limit(2).count() > 1:
            raise ValueError("several currencies or units: give a rate table")
        return df.groupBy(*group).agg(F.sum(value).alias("total"))
    same = F.col(f"d.{currency}").eqNullSafe(F.col("r.currency")) & F.col(f"d.{units}").eqNullSafe(F.col("r.units"))
    rated = df.alias("d").join(F.broadcast(rates.alias("r")) if rates.count() < 10_000 else rates.alias("r"), same, "left")
    if rated.filter(F.col("rate").isNull()).limit(1).count():
        raise ValueError("a currency has no rate")
    return rated.groupBy(*(F.col(f"d.{g}").alias(g) for g in group)).agg(F.sum(F.col(f"d.{value}") * F.col("rate")).alias("total"))


def group_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """The mean of the inner groups' means, in which groups weigh alike, beside the mean of all rows."""
    g = df.groupBy(outer, inner).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return g.groupBy(outer).agg(F.avg("m").alias("mean_of_means"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("entity_mean"))


def dominance(df: DataFrame, group: str) -> DataFrame:
    """The largest group's rows, all rows, and their ratio."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.max("n").alias("num"), F.sum("n").alias("den")).withColumn("dominance", F.col("num") / F.col("den"))


def weightings(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """The unweighted mean, the weighted mean, and what they rest on."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.sum(w).alias("weight"),
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias("weighted_mean"),
    )


def leave_one_out(df: DataFrame, group: str, num: Column, den: Column) -> DataFrame:
    """The ratio of two sums without each group in turn, by subtraction from the whole: no group is read twice."""
    made = df.groupBy(group).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    whole = made.agg(F.sum("num").alias("all_num"), F.sum("den").alias("all_den"))
    made = made.crossJoin(F.broadcast(whole))  # one row
    full = F.try_divide(F.col("all_num").cast("double"), F.col("all_den").cast("double"))
    rest = F.try_divide((F.col("all_num") - F.col("num")).cast("double"), (F.col("all_den") - F.col("den")).cast("double"))
    return made.select(
        group, (F.col("all_num") - F.col("num")).alias("num"), (F.col("all_den") - F.col("den")).alias("den"),
        rest.alias("without"), (rest - full).alias("change"),
    )


def leave_one_out_any(df: DataFrame, group: str, statistic) -> DataFrame:
    """For statistics that do not add up: ``statistic(grouped)`` by dropped group.

    Every row is read once for each other group, and pre-aggregated where it is read. So the groups must be few; more
    than MOST_GROUPS are an error.
    """
    return statistic(left_out(df, group).groupBy("dropped"))


def left_out(df: DataFrame, group: str) -> DataFrame:
    """Every row beside each group that it is not in, ``dropped``; rows without a group are a group, and stay beside all others."""
    groups = df.select(F.col(group).alias("dropped")).distinct().limit(MOST_GROUPS + 1)
    if groups.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of {group}")
    return df.join(F.broadcast(groups), ~F.col(group).eqNullSafe(F.col("dropped")))


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by, p, quantile``; a group without values has none.

    A mergeable sketch finds two values between which each quantile must lie, with the values next to them. A second
    pass counts what lies below, and counts every distinct value between; only those few are put in order. So no task
    holds a group's values, whatever their number.
    """
    by, spread = by or [], 2 / ACCURACY
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    low = F.percentile_approx("_v", [max(0.0, p - spread) for p in probabilities], ACCURACY)
    high = F.percentile_approx("_v", [min(1.0, p + spread) for p in probabilities], ACCURACY)
    ends = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), low.alias("low"), high.alias("high"))
    cuts = F.arrays_zip(F.array(*(F.lit(float(p)) for p in probabilities)).alias("p"), "low", "high")
    ends, _ = materialize(ends.select(*by, "_n", F.inline(cuts)), "ends")

    def beside(figures: DataFrame) -> DataFrame:
        if not by:
            return known.crossJoin(F.broadcast(figures))  # one row for each probability
        same = known[by[0]].eqNullSafe(figures[by[0]])
        for b in by[1:]:
            same = same & known[b].eqNullSafe(figures[b])
        return known.join(figures, same).select(*(known[b] for b in by), "_v", *(c for c in figures.columns if c not in by))

    # The sketch may miss by a rank at its edges: the next values on both sides are taken too.
    wide = beside(ends).groupBy(*by, "p").agg(
        F.max("_n").alias("_n"),
        F.coalesce(F.max(F.when(F.col("_v") < F.col("low"), F.col("_v"))), F.min("low")).alias("low"),
        F.coalesce(F.min(F.when(F.col("_v") > F.col("high"), F.col("_v"))), F.max("high")).alias("high"),
    )
    wide, _ = materialize(wide, "wide")
    near = F.when(F.col("_v") >= F.col("low"), F.col("_v"))  # null for all that lies below
    counted = beside(wide).filter(F.col("_v") <= F.col("high")).groupBy(*by, "p", near.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.col("p")
    spots = counted.withColumn("_upto", upto).filter("_v IS NOT NULL")
    made = spots.groupBy(*by, "p").agg(
        F.max("_n").alias("_n"),
        F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v"))).alias("_b"),
    )
    share = place - F.floor(place)
    # Written, as what joins these few rows may count them first.
    return materialize(made.select(*by, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("quantile")), "quantiles")[0]


def left_out_quantiles(df: DataFrame, group: str, value: str, probabilities: list[float], buckets: int = 1000) -> DataFrame:
    """Exact quantiles of the rows that are not in a group, for each group in turn: ``dropped, p, quantile``.

    No row is read once for each group. Values are counted by group, and cut into buckets; what is left of a bucket
    without a group is a difference of two counts, and tells in which bucket a quantile lies. Only that bucket's values
    are ordered for the group. Rows without a group are a group; groups outside of which there are no values have none.
    """
    from pyspark.ml.feature import Bucketizer

    scratch = Scratch(df.sparkSession)
    known = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    cells = scratch.table(known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "cells")
    groups = df.select(F.col(group).alias("dropped")).distinct()
    groups = scratch.table(groups, "groups")
    if groups.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of {group}")
    cuts = cells.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], ACCURACY)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cells = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(cells) if len(splits) > 2 else cells.withColumn("b", F.lit(0.0))
    cells = scratch.table(cells, "cells")
    tally = scratch.table(cells.groupBy("g", "b").agg(F.sum("c").alias("own")), "tally")
    total = tally.groupBy("b").agg(F.sum("own").alias("all"))
    # A row for each group and bucket: what the bucket holds without the group, and all that lies below.
    every = total.crossJoin(F.broadcast(groups))  # as many rows as buckets, of a fixed number
    rest = beside(every, tally.withColumnRenamed("g", "dropped"), ["dropped", "b"], few=False)
    rest = rest.select("dropped", "b", (F.col("all") - F.coalesce("own", F.lit(0))).alias("left"))
    each, upto = Window.partitionBy("dropped"), Window.partitionBy("dropped").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumns({"n": F.sum("left").over(each), "upto": F.sum("left").over(upto)}).filter("n > 0")
    ends = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(end).alias("end")) for p in probabilities for end in (0, 1))))
    wanted = rest.withColumn("one", ends).select("dropped", "b", "left", "n", "upto", "one.p", "one.end")
    place = (F.col("n") - 1) * F.col("p")
    wanted = wanted.withColumn("k", F.when(F.col("end") == 0, F.floor(place)).otherwise(F.ceil(place)))
    wanted = wanted.filter("upto > k AND upto - left <= k").select("dropped", "b", "n", "p", "end", (F.col("k") - F.col("upto") + F.col("left")).alias("k"))
    wanted = scratch.table(wanted, "wanted")  # two rows for each group and probability
    inside = cells.join(F.broadcast(wanted), "b").filter(~F.col("g").eqNullSafe(F.col("dropped")))
    counted = inside.groupBy("dropped", "p", "end", "n", "k", "v").agg(F.sum("c").alias("c"))
    reach = F.sum("c").over(Window.partitionBy("dropped", "p", "end").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("reach", reach).filter("reach > k").groupBy("dropped", "p").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("end") == 0, F.col("v"))).alias("a"), F.min(F.when(F.col("end") == 1, F.col("v"))).alias("z")
    )
    place = (F.col("n") - 1) * F.col("p")
    made, _ = materialize(found.select("dropped", "p", (F.col("a") + (F.col("z") - F.col("a")) * (place - F.floor(place))).alias("quantile")), "left-out")
    scratch.drop()
    return made


def descriptives(df: DataFrame, value: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """Number, mean, deviation, extremes and exact quantiles by group; a quantile's column is ``p`` and its percent."""
    plain = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    found = quantiles(df, value, probabilities, by)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"p{round(p * 100)}") for p in probabilities))
    return beside(plain, wide, by)


def margins(df: DataFrame, dimensions: list[str], *figures: Column) -> DataFrame:
    """Figures over all combinations of dimensions; ``all_<dimension>`` is 1 where the dimension is summed over."""
    return df.cube(*dimensions).agg(*figures, *(F.grouping(d).cast("int").alias(f"all_{d}") for d in dimensions))


def yearly_change(df: DataFrame, key: list[str], year: str, value: str, name: str = "change") -> DataFrame:
    """Adds the change against the year before; null where that year is not there."""
    w = Window.partitionBy(*key).orderBy(year)
    return df.withColumn(name, F.when(F.lag(year).over(w) == F.col(year) - 1, F.col(value) - F.lag(value).over(w)))


def definition_grid(df: DataFrame, definitions: dict[str, Column]) -> DataFrame:
    """Rows that each definition holds for, all counted in one pass: ``definition, n``."""
    counted = df.agg(*(F.count_if(c).alias(name) for name, c in definitions.items()))
    return counted.unpivot([], list(definitions), "definition", "n")


def simple_regression(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope, intercept, fit and correlation of one regressor, by group."""
    a, b = F.col(y), F.col(x)
    return df.groupBy(*by).agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.corr(a, b).alias("corr")
    )


def two_way_ranks(df: DataFrame, one: str, other: str, apart: int) -> DataFrame:
    """Ranks of a few groups by two figures, and neutral words for those whose ranks lie far apart."""
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))  # noqa: E731  a few groups
    ranked = df.withColumns({f"by_{one}": rank(one), f"by_{other}": rank(other)})
    far = F.abs(F.col(f"by_{one}") - F.col(f"by_{other}")) >= apart
    return ranked.withColumn("wording", F.when(far, "unusual").otherwise("usual"))


def missing_sensitivity(df: DataFrame, columns: list[str]) -> DataFrame:
    """By variable: its mean over the rows that have it and over those that have all, and bounds for the whole table.

    The bounds put every missing value at the smallest and at the largest value seen.
    """
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    n = F.count(F.lit(1))

    def figures(c: str):
        missing = n - F.count(c)
        total = F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
        bound = lambda end: (total + missing * end(F.col(c).cast("double"))) / n
        return F.struct(
            F.lit(c).alias("variable"), n.alias("n"), F.count(c).alias("known"), F.avg(c).alias("available_case"),
            F.count_if(whole).alias("complete"), F.avg(F.when(whole, F.col(c))).alias("complete_case"),
            bound(F.min).alias("low"), bound(F.max).alias("high"),
        )

    one = df.agg(*(figures(c).alias(f"_{i}") for i, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(columns))))))


def falsification(df: DataFrame, claim: Column, by: str) -> DataFrame:
    """A claim that must fail to hold somewhere to be refuted: by group its rows, where it holds, and whether it is refuted.

    Rows on which the claim is undefined count neither for nor against it.
    """
    made = df.groupBy(by).agg(F.count(claim).alias("den"), F.count_if(claim).alias("num"))
    return made.withColumn("refuted", F.col("num") < F.col("den"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation by group, null groups too, with average ranks for ties. Ranks come from counted distinct values."""
    known = df.dropna(subset=[x, y])

    def place(c: str) -> DataFrame:
        counted = known.groupBy(*by, F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(f"_{c}").rowsBetween(Window.unboundedPreceding, 0))
        return counted.select(*by, f"_{c}", (upto - (F.col("_c") - 1) / 2).alias(f"_rank_{c}"))

    both = known.withColumns({f"_{x}": F.col(x), f"_{y}": F.col(y)})
    both = beside(beside(both, place(x), [*by, f"_{x}"], "inner", few=False), place(y), [*by, f"_{y}"], "inner", few=False)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(f"_rank_{x}", f"_rank_{y}").alias("spearman"))


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Known and missing values of every variable: one aggregation, then one row per variable."""
    by = by or []
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("known")) for c in columns))
    made = counted.select(*by, "n", F.inline(rows))
    return made.select(*by, "variable", "n", "known", (F.col("n") - F.col("known")).alias("missing"), (F.col("known") / F.col("n")).alias("share"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """``n_rows, n_keys, n_repeated``: rows, distinct keys, and keys with several rows."""
    made = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    return made.agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("n_repeated")
    )


def gini(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Gini coefficient of positive values by group, by ranks that no single task makes."""
    rows = ranked(df.filter(F.col(value) > 0).select(*group, value), group, [value], "_i")
    n, s, t = F.count(F.lit(1)), F.sum(value), F.sum(F.col("_i") * F.col(value))
    return rows.groupBy(*group).agg(n.alias("n"), (2 * t / (n * s) - (n + 1) / n).alias("gini"))


def compare_claims(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Both sides' values by key with ``agree``, ``differ``, ``missing_left`` or ``missing_right``."""
    x = a.select(*keys, F.col(value).alias("left_value"), F.lit(1).alias("_l"))
    y = b.select(*keys, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    status = (
        F.when(F.col("_l").isNull(), "missing_left")
        .when(F.col("_r").isNull(), "missing_right")
        .when(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, "agree")
        .when(F.col("left_value").isNull() & F.col("right_value").isNull(), "agree")
        .otherwise("differ")
    )
    return x.join(y, keys, "full_outer").withColumn("status", status).drop("_l", "_r")


def sufficient_statistics(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums and products that a regression with an intercept needs, by group: one pass, one row per group."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    names = ["1", *xs, y]
    known = F.col(y).isNotNull()
    for x in xs:
        known = known & F.col(x).isNotNull()
    sums = [
        F.sum(cols[i] * cols[j]).alias(f"s_{names[i]}_{names[j]}") for i in range(len(cols)) for j in range(i, len(cols))
    ]
    return df.filter(known).groupBy(*(by or [])).agg(*sums)


def least_squares(df: DataFrame, y: str, xs: list[str], cluster: str | None = None) -> dict:
    """Coefficients and standard errors; with ``cluster`` robust to it. Only k-by-k sums reach the driver.

    Without complete rows there are no coefficients; without more rows than coefficients, or with one cluster, no errors.
    Regressors of which one is made of the others raise ``ValueError``.
    """
    names = ["1", *xs, y]
    row = sufficient_statistics(df, y, xs).first()
    k = len(xs) + 1
    if not row["s_1_1"]:
        return {"names": names[:k], "beta": [None] * k, "se": [None] * k, "n": 0}
    m = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            m[i, j] = m[j, i] = row[f"s_{names[i]}_{names[j]}"]
    scale = np.sqrt(np.diag(m[:k, :k]))
    n, alike = m[0, 0], m[:k, :k] / np.outer(scale, scale) if (scale > 0).all() else np.zeros((k, k))
    if not (scale > 0).all() or np.linalg.cond(alike) > 1e14:
        raise ValueError(f"of {xs}, one is made of the others, or does not vary")
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    none = {"names": names[:k], "beta": beta.tolist(), "se": [None] * k, "n": int(n)}
    if n <= k:
        return none
    rss = m[k, k] - beta @ m[:k, k]
    if cluster is None:
        cov = inverse * rss / (n - k)
    else:
        cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
        fit = sum((float(b) * c for b, c in zip(beta, cols)), F.lit(0.0))
        known = df.dropna(subset=[y, *xs])
        scores = known.groupBy(cluster).agg(*(F.sum(c * (F.col(y) - fit)).alias(f"g{i}") for i, c in enumerate(cols)))
        outer = scores.agg(
            F.count(F.lit(1)).alias("g"),
            *(F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)),
        ).first()
        if outer["g"] < 2:
            return none
        meat = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                meat[i, j] = meat[j, i] = outer[f"m{i}_{j}"]
        g = outer["g"]
        cov = inverse @ meat @ inverse * (g / (g - 1)) * ((n - 1) / (n - k))
    return {"names": names[:k], "beta": beta.tolist(), "se": np.sqrt(np.diag(cov)).tolist(), "n": int(n)}


def regression_table(df: DataFrame, y: str, xs: list[str], cluster: str | None = None) -> DataFrame:
    """:func:`least_squares` as rows ``term, beta, se, n``."""
    fit = least_squares(df, y, xs, cluster)
    rows = [(t, b, e, fit["n"]) for t, b, e in zip(fit["names"], fit["beta"], fit["se"])]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, n bigint")


def nesting_baseline(df: DataFrame, label: str, stratum: str, seed: int) -> DataFrame:
    """``shuffled``: the labels dealt out anew inside each stratum, seeded and independent of the row order's partitioning.

    Both deals are ranked by ranges, so a stratum may hold any share of the rows.
    """
    rows = df.withColumn("_k", F.xxhash64(F.lit(seed), *df.columns))
    pool = df.select(stratum, F.col(label).alias("shuffled"), F.xxhash64(F.lit(seed + 1), *df.columns).alias("_k"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)))
    takers = ranked(rows, [stratum], ["_k", *df.columns], "_i").drop("_k")
    givers = ranked(pool, [stratum], ["_k", *(f"_c{i}" for i in range(len(df.columns)))], "_i").select(stratum, "_i", "shuffled")
    return beside(takers, givers, [stratum, "_i"], "inner", few=False).drop("_i")


def nearest_centres(df: DataFrame, features: list[str], starts: list[tuple[float, ...]], rounds: int = 20) -> DataFrame:
    """Adds ``cluster``, the place of the nearest of k centres after Lloyd's rounds from the given starts.

    Features are used as they are. Ties go to the first centre; a centre without rows stays where it was; rows without a
    feature have no cluster. A round is one aggregation over a written table of the features, of which k rows reach the
    driver; it ends when nothing moves.
    """
    held, path = materialize(df.select(*dict.fromkeys(features)), "features")
    x, centres = [F.col(c).cast("double") for c in features], [tuple(map(float, s)) for s in starts]

    def nearest(at):
        far = [F.struct(sum(((v - c) * (v - c) for v, c in zip(x, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(at)]
        whole = F.lit(True)
        for c in features:
            whole = whole & F.col(c).isNotNull()
        return F.when(whole, F.array_min(F.array(*far))["i"])

    for _ in range(rounds):
        found = held.groupBy(nearest(centres).alias("cluster")).agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(x))).filter("cluster IS NOT NULL").collect()
        moved = list(centres)
        for row in found:
            moved[row["cluster"]] = tuple(row[f"m{i}"] for i in range(len(x)))
        if moved == centres:
            break
        centres = moved
    remove(df.sparkSession, path)
    return df.withColumn("cluster", nearest(centres))


def taxonomy(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means clusters over standardised features, with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    made = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(made).transform(made)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("_raw", "_x")
