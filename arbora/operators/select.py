"""Row selection: the preferred row of each key, and the documented filter sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.keys import beside
from arbora.operators.stats import quantiles
from arbora.schema import EXCLUDED_RULE, SOURCE_AOC, SOURCE_PDF


def select_preferred(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "preferred_for_target_year", check: list[str] | None = None
) -> DataFrame:
    """Adds a 0/1 flag: 1 for the first row of each key in ``order``. One shuffle on the keys.

    With ``check``, columns that must be unique inside a key, the tie-break is proven total first, else this raises.
    """
    if check is not None:
        tied = df.groupBy(*keys, *check).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        if tied.count():
            raise ValueError(f"{check} do not order the rows of a key totally")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, 1).otherwise(0).cast("byte"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def without_shared_claims(df: DataFrame) -> DataFrame:
    """Drops rows whose attribution needs manual review; rows without a rule stay."""
    return df.filter(~F.col("attribution_rule").eqNullSafe(F.lit(EXCLUDED_RULE)))


def valuation_set(df: DataFrame, require_pl: bool = False) -> DataFrame:
    """Ready and preferred rows; with ``require_pl`` also those whose profit and loss reconcile."""
    df = df.filter((F.col("ready_for_valuation") == 1) & (F.col("preferred_for_target_year") == 1))
    return df.filter(F.col("pl_identity_ok") == 1) if require_pl else df


def dedup_set(df: DataFrame) -> DataFrame:
    return df.filter(F.col("preferred_for_target_year") == 1)


def review_set(df: DataFrame) -> DataFrame:
    return df.filter(F.col("needs_manual_review") == 1)


def foreign(df: DataFrame, home: str, column: str = "entity_country") -> DataFrame:
    """Adds ``is_foreign``: null where the country is unknown."""
    return df.withColumn("is_foreign", (F.col(column) != home).cast("byte"))


def outliers(df: DataFrame, value: str, mads: float, by: list[str] | None = None) -> DataFrame:
    """Rows further than ``mads`` median absolute deviations from the median, with both figures.

    Medians are exact, and found without gathering a group's values in one task. Rows without a group are a group.
    """
    by = by or []
    placed = lambda rows, c: beside(rows, quantiles(rows, c, [0.5], by).drop("p").withColumnRenamed("quantile", "_found"), by)
    centred = placed(df, value).withColumnRenamed("_found", "_median").withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    spread = placed(centred, "_off").withColumnRenamed("_found", "_mad")
    return spread.filter(F.col("_off") > mads * F.col("_mad")).drop("_off")


def recorded_filters(df: DataFrame, filters: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all filters, SQL conditions by name, and the record of what each left out.

    The record has ``step, filter, condition, n_before, n_after`` in the order given, all counted in one pass. Rows on
    which a condition is undefined do not pass it, and are counted in ``n_unknown``.
    """
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for i, condition in enumerate(filters.values(), 1):
        counts.append(F.count_if(passed & F.expr(condition).isNull()).alias(f"_u{i}"))
        passed = passed & F.coalesce(F.expr(condition), F.lit(False))
        counts.append(F.count_if(passed).alias(f"_{i}"))
    steps = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"), F.lit(condition).alias("condition"), F.col(f"_{i - 1}").alias("n_before"),
                 F.col(f"_{i}").alias("n_after"), F.col(f"_u{i}").alias("n_unknown"))
        for i, (name, condition) in enumerate(filters.items(), 1)
    ]
    return df.filter(passed), df.agg(*counts).select(F.inline(F.array(*steps)))


def union_sources(pdf: DataFrame, aoc: DataFrame) -> DataFrame:
    """The rows of both source groups, each with its source; columns must be the same."""
    return pdf.withColumn("source_type", F.lit(SOURCE_PDF)).unionByName(aoc.withColumn("source_type", F.lit(SOURCE_AOC)))


def merged_by_key(claims: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Numbers of claims and of targets by a shared key: both sides are cut to one row per key before they meet."""
    left = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"))
    right = targets.groupBy(key).agg(F.count(F.lit(1)).alias("n_targets"))
    return left.join(right, key, "left").select(key, "n_targets", "n_claims")


def unmatched(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose key the other table lacks; rows without a key are among them."""
    return df.join(other.select(F.col(right).alias("_other")), F.col(left) == F.col("_other"), "left_anti")
