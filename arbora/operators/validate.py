"""Derived flags, review reasons, tiers and priorities of panel rows. All are column expressions of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.config import Config
from arbora.functions import domain, match_score, normal_name
from arbora.schema import EXCLUDED_RULE, REASONS, SOURCE_AOC, SOURCE_PDF, TIERS


__all__ = [
    "attribute", "best_match", "classify", "domain", "evidence_pairs", "filled_liabilities", "match_score", "pl_identity", "priority",
    "section_missing", "target_id", "validate", "with_review", "with_sector_labels",
]


def flag(condition: Column) -> Column:
    """1 or 0; an undefined condition is 0."""
    return F.when(condition, 1).otherwise(0).cast("byte")


def filled_liabilities(df: DataFrame) -> DataFrame:
    """``total_liabilities`` as assets less equity where it was not parsed, and ``tl_is_plug`` marking those rows."""
    plug = F.col("total_liabilities").isNull() & F.col("total_assets").isNotNull() & F.col("equity").isNotNull()
    return df.withColumns(
        {
            "tl_is_plug": flag(plug),
            "total_liabilities": F.coalesce("total_liabilities", F.col("total_assets") - F.col("equity")),
        }
    )


def pl_identity(pbt: Column, tax: Column, pat: Column, tolerance: float) -> Column:
    """1 if the three reconcile with tax deducted or added, 0 if not, -1 if one is missing."""
    close = lambda x: F.abs(x - pat) <= tolerance
    known = pbt.isNotNull() & tax.isNotNull() & pat.isNotNull()
    return F.when(~known, -1).when(close(pbt - tax) | close(pbt + tax), 1).otherwise(0).cast("byte")


def validate(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds the parsed, identity, profit-and-loss and review columns; the row count stays."""
    df = filled_liabilities(df)
    core = F.col("total_assets").isNotNull() & F.col("total_liabilities").isNotNull() & F.col("equity").isNotNull()
    df = df.withColumns(
        {
            "variables_parsed": flag(core),
            "accounting_identity_gap": F.col("total_assets") - F.col("total_liabilities") - F.col("equity"),
        }
    )
    df = df.withColumns(
        {
            "accounting_identity_ok": flag(F.abs("accounting_identity_gap") <= cfg.identity_tolerance),
            "pl_identity_ok": pl_identity(
                F.col("profit_before_tax"), F.col("provision_tax"), F.col("profit_after_tax"), cfg.pl_tolerance
            ),
        }
    )
    aoc = F.col("source_type") == SOURCE_AOC
    gates = {
        "source_missing": F.coalesce("source_found", F.lit(0)) != 1,
        REASONS[0]: F.col("variables_parsed") != 1,
        REASONS[1]: F.col("period_end_date").isNull(),
        REASONS[2]: F.col("currency").isNull(),
        REASONS[3]: section_missing(df),
        REASONS[4]: (F.col("variables_parsed") == 1) & (F.col("accounting_identity_ok") != 1),
    }
    if "aoc_match_status" in df.columns:
        gates["aoc_not_matched"] = aoc & ~F.col("aoc_match_status").eqNullSafe("matched")
    return with_review(df, gates)


def section_missing(df: DataFrame) -> Column:
    """Whether a subsidiary's section was not found in a combined PDF.

    No variable of the panel tells it. An upstream ``section_found`` of 0 does, and so does an ingested review reason.
    """
    missing = F.lit(False)
    if "section_found" in df.columns:
        missing = missing | F.coalesce(F.col("section_found") == 0, F.lit(False))
    if "review_reason" in df.columns:
        missing = missing | F.coalesce(F.array_contains(F.split("review_reason", r"\s*;\s*"), REASONS[3]), F.lit(False))
    return missing & (F.col("source_type") == SOURCE_PDF)


def with_review(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``review_reason`` joins the names of failed gates by ``;`` (null if none fails); ``needs_manual_review`` follows."""
    reason = F.concat_ws(";", *(F.when(c, F.lit(name)) for name, c in gates.items()))
    df = df.withColumn("review_reason", F.when(reason != "", reason))
    return df.withColumn("needs_manual_review", flag(F.col("review_reason").isNotNull()))


def classify(df: DataFrame) -> DataFrame:
    """Adds readiness, tier and priority (1 is best).

    "Source or PDF available" is read as both flags: ``pdf_downloaded`` is 1 too where the AOC-1 fallback is available.
    An AOC-1 row without a match is under review. A row of unknown source has no tier, and comes last.
    """
    ready = (
        (F.col("source_found") == 1)
        & (F.col("pdf_downloaded") == 1)
        & (F.col("variables_parsed") == 1)
        & (F.col("accounting_identity_ok") == 1)
        & (F.col("needs_manual_review") == 0)
    )
    df = df.withColumn("ready_for_valuation", flag(ready))
    tier = F.concat(
        F.when(F.col("source_type") == SOURCE_PDF, "full_pdf_").when(F.col("source_type") == SOURCE_AOC, "aoc1_"),
        F.when(F.col("ready_for_valuation") == 1, "ready").otherwise("review"),
    )
    return df.withColumn("data_quality_tier", tier).withColumn("source_priority", priority(F.col("data_quality_tier")))


def priority(tier: Column) -> Column:
    out = F.when(tier == TIERS[0], 1)
    for i, t in enumerate(TIERS[1:], 2):
        out = out.when(tier == t, i)
    return out.otherwise(len(TIERS) + 1)


def target_id(name: Column, uin: Column, level: Column) -> Column:
    """A stable identifier of our own: normalised name, UIN, level and a hash. It does not equal ingested identifiers."""
    base = F.concat_ws("_", normal_name(name), uin, level.cast("string"))
    return F.concat_ws("_", base, F.substring(F.sha2(base, 256), 1, 10))


def evidence_pairs(df: DataFrame, keys: list[str], pairs: dict[str, str]) -> DataFrame:
    """One row per key and variable with its value and the source line behind it."""
    rows = F.array(
        *(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value"), F.col(e).alias("evidence")) for v, e in pairs.items())
    )
    return df.select(*keys, F.inline(rows))


def best_match(left: DataFrame, right: DataFrame, block: str, name: str, key: str, least: float) -> DataFrame:
    """For every row of ``left`` the most similar name of its block in ``right``: its key, the score, and the status.

    ``matched`` from ``least`` on, else ``not_matched``; ties go to the smallest key. Names are compared inside a block
    only, and each task keeps one candidate per row.
    """
    there = right.select(F.col(block).alias("_block"), F.col(name).alias("_name"), F.col(key).alias("_key")).distinct()
    pairs = left.select(block, name, key).join(there, F.col(block) == F.col("_block"))
    scored = pairs.select(key, F.struct(match_score(F.col(name), F.col("_name")).alias("score"), (-F.col("_key")).alias("order"), "_name", "_key").alias("one"))
    best = scored.groupBy(key).agg(F.max("one").alias("one"))
    found = left.select(key, name).distinct().join(best, key, "left")
    status = F.when(F.col("one.score") >= least, "matched").otherwise("not_matched")
    return found.select(key, name, F.col("one._key").alias("match_key"), F.col("one._name").alias("match_name"), F.col("one.score").alias("match_score"), status.alias("match_status"))


def attribute(panel: DataFrame, mapping: DataFrame, key: str, claimant: str) -> DataFrame:
    """Claimants of every row's key: their number, their sorted list, and the rule that excludes shared ones.

    The mapping is cut to one row per key before the join, so shared keys do not multiply rows; a key's claimants are as
    many as there are parents. Rows without a mapping have no claimants and no rule.
    """
    claims = mapping.groupBy(key).agg(F.array_sort(F.collect_set(F.col(claimant).cast("string"))).alias("_list"))
    n = F.coalesce(F.size("_list"), F.lit(0))
    return panel.join(claims, key, "left").select(
        *panel.columns, n.alias("n_top30_claimants"), F.array_join("_list", ";").alias("top30_claimants"),
        F.when(n > 1, 1).otherwise(0).alias("shared_uin"), F.when(n > 1, EXCLUDED_RULE).when(n == 1, "single_claimant").alias("attribution_rule"),
    )


def with_sector_labels(df: DataFrame, lookup: DataFrame, code: str = "sector_code", label: str = "sector_label") -> DataFrame:
    """Adds the label of the sector code; unknown codes have none. A code that the lookup holds twice is an error."""
    if lookup.groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"{code} is not unique in the lookup")
    return df.join(lookup.select(code, F.col(label)), code, "left")
