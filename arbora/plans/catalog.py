"""Queries over the driver tables that exercise every operator, with the SQL that DuckDB runs for the same rows.

The driver's tables hold no ownership data. The panel is a proxy: one lineitem row is a source row, the supplier is the
target, the year of shipping the fiscal year, and amounts are whole cents. Every review gate fails on some of its rows:
quantities, discounts and line numbers stand for missing sources, PDFs, currencies, sections and AOC-1 matches. The tree
is arithmetic: supplier ``k`` hangs below supplier ``k div 3``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora import sources
from arbora.config import Config
from arbora.functions import text_date
from arbora.operators import graph, ledger, select, stats, validate
from arbora.schema import EVIDENCE, EXCLUDED_RULE, PANEL, SOURCE_AOC, SOURCE_PDF, TIERS
from arbora.streaming import windows
from arbora.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CFG = Config()


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The panel proxy ---------------------------------------------------------------------------------------------------


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows as panel rows."""
    li = read(spark, sf_dir, "lineitem")
    assets, debts = cents("l_extendedprice"), cents("l_quantity")
    equity = F.when(F.col("l_tax") != 0, assets - debts + F.when(F.col("l_discount") == 0.05, 5).otherwise(0))
    return li.select(
        F.col("l_suppkey").alias("target_id"),
        F.year("l_shipdate").cast("bigint").alias("fiscal_year"),
        F.when((F.col("l_linenumber") == 4) & (F.col("l_quantity") <= 5), None).when(F.col("l_linestatus") == "F", SOURCE_PDF).otherwise(SOURCE_AOC).alias("source_type"),
        assets.alias("total_assets"),
        debts.alias("total_liabilities"),
        equity.alias("equity"),
        assets.alias("profit_before_tax"),
        F.when(F.col("l_tax") != 0, debts).alias("provision_tax"),
        (assets - debts + F.when(F.col("l_discount") == 0.05, 5).otherwise(0)).alias("profit_after_tax"),
        F.when(F.col("l_quantity") >= 50, 0).otherwise(1).alias("source_found"),
        F.when(F.col("l_quantity") <= 1, 0).otherwise(1).alias("pdf_downloaded"),
        F.when(F.col("l_returnflag") != "R", F.to_date("l_shipdate")).alias("period_end_date"),
        F.when(F.round(F.col("l_discount") * 100) != 10, "USD").alias("currency"),
        F.when(F.col("l_linenumber") == 5, 0).otherwise(1).alias("section_found"),
        F.when((F.col("l_linestatus") != "F") & (F.col("l_linenumber") != 6), F.when(F.col("l_linenumber") == 7, "not_matched").otherwise("matched")).alias("aoc_match_status"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.classify(validate.validate(panel(spark, sf_dir), CFG))


def tie_break() -> list:
    return [F.col(c) for c in ("source_priority", "l_orderkey", "l_linenumber", "l_partkey", "total_assets", "total_liabilities")]


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_preferred(classified(spark, sf_dir), ["target_id", "fiscal_year"], tie_break())


PANEL_SQL = f"""
raw AS (SELECT l_suppkey AS target_id, year(l_shipdate)::BIGINT AS fiscal_year,
  CASE WHEN l_linenumber = 4 AND l_quantity <= 5 THEN NULL WHEN l_linestatus = 'F' THEN '{SOURCE_PDF}' ELSE '{SOURCE_AOC}' END AS source_type,
  l_quantity >= 50 AS no_source, l_quantity <= 1 AS no_pdf, round(l_discount * 100) = 10 AS no_currency, l_linenumber = 5 AS no_section,
  l_linenumber IN (6, 7) AS no_match,
  round(l_extendedprice * 100)::BIGINT AS total_assets, round(l_quantity * 100)::BIGINT AS total_liabilities,
  CASE WHEN l_tax <> 0 THEN round(l_extendedprice * 100)::BIGINT - round(l_quantity * 100)::BIGINT
       + CASE WHEN l_discount = 0.05 THEN 5 ELSE 0 END END AS equity,
  round(l_extendedprice * 100)::BIGINT - round(l_quantity * 100)::BIGINT
       + CASE WHEN l_discount = 0.05 THEN 5 ELSE 0 END AS profit_after_tax,
  CASE WHEN l_tax <> 0 THEN round(l_quantity * 100)::BIGINT END AS provision_tax,
  l_returnflag = 'R' AS no_end, l_orderkey, l_linenumber, l_partkey FROM lineitem),
val AS (SELECT *, CASE WHEN equity IS NOT NULL THEN 1 ELSE 0 END AS variables_parsed,
  total_assets - total_liabilities - equity AS accounting_identity_gap FROM raw),
val2 AS (SELECT *, CASE WHEN abs(accounting_identity_gap) <= 1 THEN 1 ELSE 0 END AS accounting_identity_ok,
  CASE WHEN provision_tax IS NULL THEN -1
       WHEN abs(total_assets - provision_tax - profit_after_tax) <= 1
         OR abs(total_assets + provision_tax - profit_after_tax) <= 1 THEN 1 ELSE 0 END AS pl_identity_ok FROM val),
val3 AS (SELECT *, nullif(concat_ws(';', CASE WHEN no_source THEN 'source_missing' END, CASE WHEN variables_parsed <> 1 THEN 'balance_sheet_variables_missing' END,
  CASE WHEN no_end THEN 'period_end_missing' END, CASE WHEN no_currency THEN 'currency_missing' END,
  CASE WHEN no_section AND source_type = '{SOURCE_PDF}' THEN 'combined_pdf_section_not_found' END,
  CASE WHEN variables_parsed = 1 AND accounting_identity_ok <> 1 THEN 'accounting_identity_failed' END,
  CASE WHEN no_match AND source_type = '{SOURCE_AOC}' THEN 'aoc_not_matched' END), '') AS review_reason FROM val2),
val4 AS (SELECT *, CASE WHEN NOT no_pdf AND variables_parsed = 1 AND accounting_identity_ok = 1 AND review_reason IS NULL THEN 1 ELSE 0 END
  AS ready_for_valuation FROM val3),
tiered AS (SELECT *, CASE source_type WHEN '{SOURCE_PDF}' THEN 'full_pdf_' WHEN '{SOURCE_AOC}' THEN 'aoc1_' END
  || CASE WHEN ready_for_valuation = 1 THEN 'ready' ELSE 'review' END AS data_quality_tier FROM val4),
cls AS (SELECT *, CASE data_quality_tier WHEN '{TIERS[0]}' THEN 1 WHEN '{TIERS[1]}' THEN 2 WHEN '{TIERS[2]}' THEN 3 WHEN '{TIERS[3]}' THEN 4 ELSE 5 END
  AS source_priority FROM tiered),
pref AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY target_id, fiscal_year ORDER BY source_priority, l_orderkey,
  l_linenumber, l_partkey, total_assets, total_liabilities) = 1 THEN 1 ELSE 0 END AS preferred FROM cls)
"""


@query(
    f"""WITH {PANEL_SQL} SELECT n.n_name AS parent, count(*) AS n_target_years,
    CAST(sum(ready_for_valuation) AS BIGINT) AS n_ready,
    CAST(sum(CASE WHEN ready_for_valuation = 1 THEN equity END) AS BIGINT) AS equity_ready,
    sum(ready_for_valuation)::DOUBLE / count(*) AS ready_share
    FROM pref JOIN supplier ON s_suppkey = target_id JOIN nation n ON n_nationkey = s_nationkey WHERE preferred = 1 GROUP BY 1"""
)
def panel_valuation_summary(spark, sf_dir):
    """By parent, target-years, those in the valuation set, and their equity."""
    best = select.dedup_set(preferred(spark, sf_dir))
    owner = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ready = F.col("ready_for_valuation").cast("bigint")
    return (
        best.join(owner, F.col("target_id") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("parent"))
        .agg(
            F.count(F.lit(1)).alias("n_target_years"),
            F.sum(ready).alias("n_ready"),
            F.sum(F.when(ready == 1, F.col("equity"))).alias("equity_ready"),
            (F.sum(ready).cast("double") / F.count(F.lit(1))).alias("ready_share"),
        )
    )


@query(
    f"""WITH {PANEL_SQL} SELECT target_id, fiscal_year, l_orderkey, l_linenumber, l_partkey, data_quality_tier,
    source_priority::INT AS source_priority, total_assets, equity FROM pref WHERE preferred = 1"""
)
def panel_preferred_rows(spark, sf_dir):
    """One row of lowest priority per target and year."""
    return select.top_rows(classified(spark, sf_dir), ["target_id", "fiscal_year"], tie_break()).select(
        "target_id", "fiscal_year", "l_orderkey", "l_linenumber", "l_partkey", "data_quality_tier", "source_priority",
        "total_assets", "equity",
    )


@query(
    f"""WITH {PANEL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, total_assets, accounting_identity_gap,
    accounting_identity_ok::INT AS accounting_identity_ok, pl_identity_ok::INT AS pl_identity_ok, review_reason,
    ready_for_valuation::INT AS ready_for_valuation, variables_parsed::INT AS variables_parsed FROM cls"""
)
def panel_flags(spark, sf_dir):
    """Every derived flag of every source row."""
    ints = ("accounting_identity_ok", "pl_identity_ok", "ready_for_valuation", "variables_parsed")
    # The proxy has no separate liabilities gap, so the filled liabilities equal the parsed ones.
    return (
        validate.classify(validate.validate(panel(spark, sf_dir), CFG))
        .select("l_orderkey", "l_linenumber", "l_partkey", "total_assets", "accounting_identity_gap", "review_reason", *(F.col(c).cast("int").alias(c) for c in ints))
    )


@query(
    f"""WITH {PANEL_SQL} SELECT count(*) AS n, CAST(sum(equity) AS BIGINT) AS equity FROM pref
    WHERE preferred = 1 AND ready_for_valuation = 1 AND pl_identity_ok = 1"""
)
def panel_pl_set(spark, sf_dir):
    """the valuation set whose profit and loss reconcile."""
    return select.valuation_set(preferred(spark, sf_dir), require_pl=True).agg(
        F.count(F.lit(1)).alias("n"), F.sum("equity").alias("equity")
    )


@query(f"WITH {PANEL_SQL} SELECT data_quality_tier, source_priority::INT AS source_priority, count(*) AS n FROM cls GROUP BY 1, 2")
def tier_frequency(spark, sf_dir):
    """A15, O1."""
    return classified(spark, sf_dir).groupBy("data_quality_tier", "source_priority").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PANEL_SQL}, each AS (SELECT unnest(string_split(review_reason, ';')) AS reason FROM cls WHERE review_reason IS NOT NULL)
    SELECT reason, count(*) AS n FROM each GROUP BY 1"""
)
def review_reason_frequency(spark, sf_dir):
    """Failed gates of the rows under review."""
    # Lists are few, rows are many: lists are counted first, then split.
    lists = select.review_set(classified(spark, sf_dir)).groupBy("review_reason").agg(F.count(F.lit(1)).alias("c"))
    return lists.select(F.explode(F.split("review_reason", ";")).alias("reason"), "c").groupBy("reason").agg(F.sum("c").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, e.variable, e.value, e.evidence FROM (SELECT l_orderkey, l_linenumber, l_partkey,
    unnest([{'variable': 'total_assets', 'value': l_extendedprice, 'evidence': l_returnflag},
            {'variable': 'turnover', 'value': l_quantity, 'evidence': l_linestatus},
            {'variable': 'equity', 'value': l_tax, 'evidence': CASE WHEN l_tax <> 0 THEN l_linestatus END}]) AS e FROM lineitem)"""
)
def evidence_lookup(spark, sf_dir):
    """Values beside the lines that they come from, for all rows."""
    li = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_extendedprice": "total_assets", "l_quantity": "turnover", "l_tax": "equity"})
    li = li.withColumns(
        {"total_assets_evidence": F.col("l_returnflag"), "turnover_evidence": F.col("l_linestatus"), "equity_evidence": F.when(F.col("equity") != 0, F.col("l_linestatus"))}
    )
    pairs = {m: EVIDENCE[m] for m in ("total_assets", "turnover", "equity")}
    return validate.evidence_pairs(li, ["l_orderkey", "l_linenumber", "l_partkey"], pairs)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n,
    CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_plug,
    CAST(sum(CASE WHEN l_tax = 0 THEN round(l_extendedprice * 100)::BIGINT - 100 ELSE round(l_quantity * 100)::BIGINT END) AS BIGINT) AS liabilities
    FROM lineitem GROUP BY 1, 2, 3"""
)
def liabilities_fallback(spark, sf_dir):
    """Liabilities computed where they were not parsed, and marked."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", cents("l_extendedprice").alias("total_assets"),
        F.when(F.col("l_tax") != 0, cents("l_quantity")).alias("total_liabilities"), F.lit(100).cast("bigint").alias("equity"),
    )
    return validate.filled_liabilities(li).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("tl_is_plug").cast("bigint")).alias("n_plug"), F.sum("total_liabilities").alias("liabilities")
    )


@query(
    """SELECT l_linestatus AS source_type, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n_foreign
    FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"""
)
def attribution_filter(spark, sf_dir):
    """Excluded attributions leave, rows without a rule stay; foreign rows by source class."""
    rule = F.when(F.col("l_returnflag") == "R", EXCLUDED_RULE).when(F.col("l_returnflag") == "A", "single_claimant")  # N has none
    li = read(spark, sf_dir, "lineitem").withColumn("attribution_rule", rule)
    kept = select.foreign(select.without_shared_claims(li), "A", "l_returnflag")
    return kept.groupBy(F.col("l_linestatus").alias("source_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("is_foreign")).cast("bigint")).alias("n_foreign")
    ).withColumn("n_foreign", F.coalesce("n_foreign", F.lit(0).cast("bigint")))


@query(
    """WITH m AS (SELECT median(c_acctbal) AS med FROM customer), d AS (SELECT median(abs(c_acctbal - med)) AS mad FROM customer, m)
    SELECT c_custkey, c_acctbal FROM customer, m, d WHERE abs(c_acctbal - med) > 1.5 * mad"""
)
def surprising_values(spark, sf_dir):
    """balances far from the median."""
    return select.outliers(read(spark, sf_dir, "customer"), "c_acctbal", 1.5).select("c_custkey", "c_acctbal")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS source_domain FROM pages")
def source_domain(spark, sf_dir):
    """P12."""
    return read(spark, sf_dir, "pages").select("page_id", validate.domain(F.col("url")).alias("source_domain"))


@query(
    """SELECT s_suppkey, trim(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '_') || '_' || s_nationkey || '_' || (s_suppkey % 3) || '_'
    || substr(sha256(trim(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '_') || '_' || s_nationkey || '_' || (s_suppkey % 3)), 1, 10) AS target_id
    FROM supplier"""
)
def target_identifiers(spark, sf_dir):
    """P13."""
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", validate.target_id(F.col("s_name"), F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 3).alias("target_id"))


@query(
    """SELECT o_orderkey, i, CAST(o_orderdate AS DATE) AS day FROM orders, (VALUES (0), (1), (2), (3)) f(i)"""
)
def textual_dates(spark, sf_dir):
    """Dates in four spellings, parsed."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    spelled = F.array(*(F.date_format("o_orderdate", form) for form in ("yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "MMM d, yyyy")))
    return o.select("o_orderkey", F.posexplode(spelled).alias("i", "text")).select("o_orderkey", "i", text_date(F.col("text")).alias("day"))


@query("SELECT 'part_' || p_partkey AS variable, p_name || ' ' || p_type || ' of ' || p_brand AS description FROM part")
def dictionary_scan(spark, sf_dir):
    """A dictionary of all parts as text, entries of two indented lines, read back as variables with descriptions."""
    path = new_path(spark, "dictionary")
    entry = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit("\n  "), "p_name", F.lit(" "), "p_type", F.lit("\n  of "), "p_brand")
    read(spark, sf_dir, "part").select(entry.alias("value")).write.text(path)
    return sources.read_dictionary(spark, path)


# Joins -------------------------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT n_nationkey AS uin, count(*) AS n_targets FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT c_nationkey AS uin, n_targets, count(*) AS n_claims FROM customer LEFT JOIN d ON uin = c_nationkey GROUP BY 1, 2"""
)
def uin_merge(spark, sf_dir):
    """Aggregate a shared key before merging, so that rows do not multiply."""
    targets = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    claims = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("uin"))
    return select.merged_by_key(claims, targets.select(F.col("n_nationkey").alias("uin")), "uin")


@query(
    f"""WITH m AS (SELECT l_partkey, count(DISTINCT l_suppkey % 4) AS n, string_agg(DISTINCT (l_suppkey % 4)::VARCHAR, ';' ORDER BY (l_suppkey % 4)::VARCHAR) AS names FROM lineitem GROUP BY 1)
    SELECT p_partkey, coalesce(n, 0)::INT AS n_top30_claimants, names AS top30_claimants, CASE WHEN n > 1 THEN 1 ELSE 0 END AS shared_uin,
    CASE WHEN n > 1 THEN '{EXCLUDED_RULE}' WHEN n = 1 THEN 'single_claimant' END AS attribution_rule FROM part LEFT JOIN m ON l_partkey = p_partkey"""
)
def mapping_join(spark, sf_dir):
    """Claimants of a shared identifier, joined without multiplying rows."""
    mapping = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 4).alias("claimant"))
    found = validate.attribute(read(spark, sf_dir, "part").select("p_partkey"), mapping, "p_partkey", "claimant")
    return found.withColumn("n_top30_claimants", F.col("n_top30_claimants").cast("int"))


@query("SELECT c_custkey, c_nationkey AS sector_code, n_name AS sector_label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0")
def sector_labels(spark, sf_dir):
    """Codes with labels; those that the lookup lacks have none."""
    lookup = read(spark, sf_dir, "nation").filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("sector_code"), F.col("n_name").alias("sector_label"))
    return validate.with_sector_labels(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sector_code")), lookup)


@query(
    """WITH s AS (SELECT a.n_nationkey AS k, a.n_name AS x, b.n_nationkey AS m, b.n_name AS y,
      1.0::DOUBLE - levenshtein(lower(a.n_name), lower(b.n_name))::DOUBLE / greatest(length(a.n_name), length(b.n_name)) AS score
      FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey % 2 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, m) AS i FROM s)
    SELECT n_nationkey, n_name, m AS match_key, y AS match_name, score AS match_score, CASE WHEN score >= 0.8 THEN 'matched' ELSE 'not_matched' END AS match_status
    FROM nation LEFT JOIN r ON k = n_nationkey AND i = 1"""
)
def best_name_match(spark, sf_dir):
    """The best name of the block, matched or not."""
    n = read(spark, sf_dir, "nation")
    return validate.best_match(n, n.filter("n_nationkey % 2 = 0"), "n_regionkey", "n_name", "n_nationkey", CFG.match_score_min)


@query(
    """WITH n AS (SELECT n_regionkey AS g, n_nationkey AS id, n_name AS c, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'absent'
      ELSE (SELECT min(n_name) FROM nation m WHERE m.n_regionkey = nation.n_regionkey) END AS up FROM nation)
    SELECT id, up, CASE WHEN up IS NULL THEN 'root' WHEN up IN (SELECT c FROM n x WHERE x.g = n.g) THEN 'resolved' ELSE 'unmatched' END AS parent_status FROM n"""
)
def parent_resolution(spark, sf_dir):
    """Names of parents resolved inside their group, or reported."""
    n = read(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    up = F.when(F.col("n_nationkey") % 3 == 1, "absent").when(F.col("n_nationkey") % 3 == 2, F.col("first"))
    rows = n.join(first, "n_regionkey").select(F.col("n_regionkey").cast("string").alias("block"), "n_name", up.alias("up"), F.col("n_nationkey").alias("target_id"))
    return graph.resolve_parents(rows, "block", "n_name", "up").select(F.col("target_id").alias("id"), "up", "parent_status")


@query(
    """SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key, levenshtein(lower(a.n_name), lower(b.n_name))::INT AS distance,
    1.0::DOUBLE - levenshtein(lower(a.n_name), lower(b.n_name))::DOUBLE / greatest(length(a.n_name), length(b.n_name)) AS match_score
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
)
def name_matching(spark, sf_dir):
    """Names compared inside a block."""
    n = read(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(
        F.col("a.n_nationkey").alias("left_key"), F.col("b.n_nationkey").alias("right_key"),
        F.levenshtein(F.lower("a.n_name"), F.lower("b.n_name")).alias("distance"),
        validate.match_score(F.col("a.n_name"), F.col("b.n_name")).alias("match_score"),
    )


@query(
    """WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right'
    WHEN abs(a.v - b.v) <= 200 THEN 'agree' ELSE 'differ' END AS status FROM a FULL JOIN b ON a.k = b.k"""
)
def claim_comparison(spark, sf_dir):
    """Two sides' figures for the same claims."""
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("v"))
    return stats.compare_claims(a, b, ["k"], "v", 200)


@query("SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def unmatched_entities(spark, sf_dir):
    """An anti join."""
    return select.unmatched(read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


# Graph -------------------------------------------------------------------------------------------------------------


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the arithmetic supplier tree with the nations along them."""
    s = read(spark, sf_dir, "supplier")
    edge = s.select((F.expr("s_suppkey div 3")).alias("parent"), F.col("s_suppkey").alias("child"), F.col("s_nationkey").alias("nation")).filter("child <> parent AND child > 0")
    roots = edge.filter("parent = 0").select(F.col("child").alias("root"), "nation")
    return graph.paths(edge.filter("parent > 0"), roots, CFG.max_depth, label="nation")


TREE_SQL = """e AS (SELECT s_suppkey // 3 AS parent, s_suppkey AS child, s_nationkey AS nation FROM supplier WHERE s_suppkey > 0),
p AS (SELECT child AS root, child AS node, 0 AS depth, [child] AS path, [nation] AS labels FROM e WHERE parent = 0
  UNION ALL SELECT p.root, e.child, p.depth + 1, list_append(p.path, e.child), list_append(p.labels, e.nation) FROM p JOIN e ON e.parent = p.node)"""


@query(f"WITH RECURSIVE {TREE_SQL} SELECT root, node, depth::INT AS depth, array_to_string(path, '>') AS path, array_to_string(labels, '>') AS labels FROM p")
def ownership_paths(spark, sf_dir):
    """Root to node, with depth."""
    t = tree(spark, sf_dir)
    text = lambda c: F.concat_ws(">", F.col(c).cast("array<string>")).alias(c)
    return t.select("root", "node", "depth", text("path"), text("labels"))


@query("SELECT s_suppkey // 3 AS parent, count(*) AS n_children FROM supplier WHERE s_suppkey >= 3 GROUP BY 1")
def branching(spark, sf_dir):
    """G2, G5."""
    edge = graph.edges(read(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 3").alias("parent"), "s_suppkey"), ["parent", "s_suppkey"])
    return graph.branching(edge.filter("parent > 0"))


@query(
    """WITH t AS (SELECT c_nationkey AS src, s_nationkey AS dst, s_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey), c AS (SELECT src, dst, count(*) AS paths, count(DISTINCT s_suppkey) AS entities FROM t GROUP BY 1, 2)
    SELECT src, dst, paths, entities, CAST(sum(paths) OVER (PARTITION BY src) AS BIGINT) AS row_total, paths::DOUBLE / sum(paths) OVER (PARTITION BY src) AS row_share FROM c"""
)
def country_transitions(spark, sf_dir):
    """Paths beside distinct entities."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    t = (
        li.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return graph.transitions(t, "src", "dst", "s_suppkey")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT depth::INT AS depth, labels[-1] AS nation, count(*) AS n FROM p GROUP BY 1, 2")
def geography_by_depth(spark, sf_dir):
    """G7."""
    return graph.geography_by_depth(tree(spark, sf_dir), "labels").withColumnRenamed("label", "nation")


@query(
    f"""WITH RECURSIVE {TREE_SQL}, g AS (SELECT node, unnest(list_transform(range(1, len(labels)), lambda i: labels[i] || '>' || labels[i + 1])) AS motif FROM p)
    SELECT motif, count(*) AS paths, count(DISTINCT node) AS entities FROM g GROUP BY 1"""
)
def path_motifs(spark, sf_dir):
    """Pairs of nations along paths."""
    return graph.motifs(tree(spark, sf_dir), "labels", 2, "node")


@query(
    """WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT a || '>' || b || '>' || c AS motif, count(*) AS paths, count(DISTINCT user_id) AS entities FROM s WHERE c IS NOT NULL GROUP BY 1"""
)
def event_motifs(spark, sf_dir):
    """G8 over long sequences: neighbours come from one window, so no user's history is gathered into an array."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", *(F.lead("event_type", i).over(w).alias(f"e{i}") for i in range(3)))
    return (
        e.filter("e2 IS NOT NULL").groupBy(F.concat_ws(">", "e0", "e1", "e2").alias("motif"))
        .agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("user_id").alias("entities"))
    )


@query(f"WITH RECURSIVE {TREE_SQL}, m AS (SELECT unnest(labels[2:len(labels) - 1]) AS member FROM p WHERE len(labels) > 2) SELECT member, count(*) AS paths FROM m GROUP BY 1")
def intermediaries(spark, sf_dir):
    """G9."""
    return graph.intermediaries(tree(spark, sf_dir), "labels")


@query(
    f"""WITH RECURSIVE {TREE_SQL} SELECT node, CAST(list_sum(list_transform(range(1, len(labels)), lambda i: CASE WHEN labels[i] <> labels[i + 1] THEN 1 ELSE 0 END)) AS INT) AS crossings
    FROM p WHERE len(labels) > 1"""
)
def border_crossings(spark, sf_dir):
    """G10."""
    return tree(spark, sf_dir).filter(F.size("labels") > 1).select("node", graph.crossings(F.col("labels")).cast("int").alias("crossings"))


@query(
    f"""WITH RECURSIVE {TREE_SQL}, s AS (SELECT root, labels[-1] AS nation, count(*) AS n FROM p GROUP BY 1, 2),
    q AS (SELECT root, n::DOUBLE / sum(n) OVER (PARTITION BY root) AS p FROM s), h AS (SELECT root, -sum(p * ln(p)) AS country_entropy FROM q GROUP BY 1),
    d AS (SELECT root, max(depth)::INT AS max_depth, count(*) AS n_nodes FROM p GROUP BY 1)
    SELECT root, max_depth, n_nodes, country_entropy, max_depth + ln(n_nodes) + country_entropy AS complexity FROM d JOIN h USING (root)"""
)
def structural_complexity(spark, sf_dir):
    """An index of ours, with its parts."""
    t = tree(spark, sf_dir).withColumn("nation", F.element_at("labels", -1))
    return graph.complexity(t, "root", "nation")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT node, root AS comp FROM p WHERE root IN (SELECT parent FROM e) OR depth > 0")
def ownership_components(spark, sf_dir):
    """Connected components of the tree's edges."""
    edge = read(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 3").alias("u"), F.col("s_suppkey").alias("v")).filter("u > 0")
    return graph.components(edge)


EDGE_SQL = "e AS (SELECT s_suppkey // 3 AS parent, s_suppkey AS child FROM supplier WHERE s_suppkey >= 3)"


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 3").alias("parent"), F.col("s_suppkey").alias("child")).filter("parent > 0")


@query(
    f"""WITH {EDGE_SQL}, n AS (SELECT parent AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT child, 0, 1 FROM e)
    SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS degree FROM n GROUP BY 1"""
)
def degree_centrality(spark, sf_dir):
    """G13."""
    return graph.degrees(tree_edges(spark, sf_dir))


def _rank_sql(rounds: int) -> str:
    out = f"WITH {EDGE_SQL}, o AS (SELECT parent, child, count(*) OVER (PARTITION BY parent) AS n FROM e), n AS (SELECT parent AS node FROM e UNION SELECT child FROM e),\n"
    out += "c AS (SELECT count(*)::DOUBLE AS c FROM n), r0 AS (SELECT node, 1.0 / c AS rank FROM n, c)"
    for i in range(rounds):
        out += f""",
        g{i} AS (SELECT child, sum(rank / n) AS got FROM o JOIN r{i} ON node = parent GROUP BY 1),
        r{i + 1} AS (SELECT node, coalesce(got, 0) * 0.85 + (1 - 0.85) / c AS rank FROM c, n LEFT JOIN g{i} ON child = node)"""
    return out + f" SELECT node, rank FROM r{rounds}"


@query(_rank_sql(4))
def page_rank(spark, sf_dir):
    """Ranks after four rounds."""
    return graph.page_rank(tree_edges(spark, sf_dir), rounds=4)


@query("SELECT s_nationkey, s_suppkey // 10 AS block, count(*) AS n_rows FROM supplier GROUP BY 1, 2")
def entity_table(spark, sf_dir):
    """G1: one row per entity under a stated key."""
    return graph.entities(read(spark, sf_dir, "supplier").withColumn("block", F.expr("s_suppkey div 10")), ["s_nationkey", "block"])


@query(f"WITH RECURSIVE {TREE_SQL} SELECT node, depth::INT AS depth, (node % 5)::INT AS level FROM p WHERE depth <> node % 5")
def depth_against_level(spark, sf_dir):
    """Nodes whose place on the path is not the stated level."""
    t = tree(spark, sf_dir).withColumn("level", (F.col("node") % 5).cast("int"))
    return graph.depth_disagreements(t, "level").select("node", "depth", "level")


@query(
    f"""WITH RECURSIVE {TREE_SQL} SELECT depth::INT AS depth, labels[-1] AS nation, count(*) AS n, CAST(sum(round(s_acctbal * 100)::BIGINT) AS BIGINT) AS total
    FROM p JOIN supplier ON s_suppkey = node GROUP BY 1, 2"""
)
def value_by_geography_and_depth(spark, sf_dir):
    """Counts beside money, by place on the path and country."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", cents("s_acctbal").alias("value"), F.lit("USD").alias("currency"), F.lit(1).alias("units"))
    t = tree(spark, sf_dir).select("node", "depth", F.element_at("labels", -1).alias("nation")).join(s, F.col("node") == F.col("s_suppkey"))
    counted = t.groupBy("depth", "nation").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(stats.one_currency_sum(t, ["depth", "nation"], "value"), ["depth", "nation"])


@query(f"WITH RECURSIVE {TREE_SQL} SELECT node, labels[1] AS top, labels[-1] AS own FROM p WHERE labels[1] <> labels[-1]")
def ultimate_parent_disagreements(spark, sf_dir):
    """Nodes whose top of the chain lies in another country than the bucket that is stated for them."""
    t = tree(spark, sf_dir).select("node", F.element_at("labels", 1).alias("root"), F.element_at("labels", -1).alias("own"))
    return graph.root_disagreements(t, "own").select("node", F.col("root").alias("top"), "own")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT count(*) AS n_paths, count(DISTINCT node) AS n_entities, CAST(sum(CASE WHEN labels[1] <> labels[-1] THEN 1 ELSE 0 END) AS BIGINT) AS n_other_nation FROM p")
def ultimate_parent_definitions(spark, sf_dir):
    """Nodes whose top of the chain lies elsewhere than they do."""
    t = tree(spark, sf_dir).withColumn("top", F.element_at("labels", 1)).withColumn("own", F.element_at("labels", -1))
    return t.agg(
        F.count(F.lit(1)).alias("n_paths"), F.count_distinct("node").alias("n_entities"),
        F.sum(F.when(F.col("top") != F.col("own"), 1).otherwise(0)).alias("n_other_nation"),
    )


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey // 3 AS parent, s_suppkey AS child, (s_suppkey % 4 + 1) / 4.0::DOUBLE AS stake FROM supplier WHERE s_suppkey > 0),
    p AS (SELECT child AS node, stake FROM e WHERE parent = 0 UNION ALL SELECT e.child, p.stake * e.stake FROM p JOIN e ON e.parent = p.node) SELECT node, stake FROM p"""
)
def path_product_ownership(spark, sf_dir):
    """Stakes multiplied along each path."""
    s = read(spark, sf_dir, "supplier").filter("s_suppkey > 0")
    edge = s.select(F.expr("s_suppkey div 3").alias("parent"), F.col("s_suppkey").alias("child"), ((F.col("s_suppkey") % 4 + 1) / F.lit(4.0)).alias("stake"))
    found = graph.paths(edge.filter("parent > 0"), edge.filter("parent = 0").select(F.col("child").alias("root"), "stake"), CFG.max_depth, label="stake")
    return found.select("node", graph.path_product("labels").alias("stake"))


# Aggregates --------------------------------------------------------------------------------------------------------


def customers_by_region(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


REGION_SQL = "c AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(
    f"""WITH {REGION_SQL}, n AS (SELECT r_name, n_name, count(*) AS num FROM c GROUP BY 1, 2), s AS (SELECT *, CAST(sum(num) OVER (PARTITION BY r_name) AS BIGINT) AS den FROM n),
    q AS (SELECT *, num::DOUBLE / den AS s FROM s) SELECT r_name, count(*) AS n_categories, max(den) AS den, sum(s * s) AS hhi, -sum(s * ln(s)) AS entropy, max(s) AS top_share,
    exp(-sum(s * ln(s))) AS effective_number FROM q GROUP BY 1"""
)
def jurisdiction_concentration(spark, sf_dir):
    """A4, A7, A8, A9, A16."""
    return stats.concentration(customers_by_region(spark, sf_dir), ["r_name"], "n_name")


@query(
    """WITH g AS (SELECT c_nationkey, count(*) AS n, CAST(sum(round(c_acctbal * 100)::BIGINT) AS BIGINT) AS total FROM customer GROUP BY 1)
    SELECT c_nationkey, n, total, n::DOUBLE / sum(n) OVER () AS count_share, total::DOUBLE / sum(total) OVER () AS value_share,
    total::DOUBLE / sum(total) OVER () - n::DOUBLE / sum(n) OVER () AS gap, rank() OVER (ORDER BY total DESC) - rank() OVER (ORDER BY n DESC) AS rank_gap FROM g"""
)
def count_value_discrepancy(spark, sf_dir):
    """A10, A11, W3."""
    return stats.count_value_gap(read(spark, sf_dir, "customer").withColumn("v", cents("c_acctbal")), "c_nationkey", "v")


@query(
    """SELECT l_returnflag, count(l_discount) AS n, avg(l_discount) AS mean, sum(l_quantity) AS weight, sum(l_discount * l_quantity) / sum(l_quantity) AS weighted_mean FROM lineitem GROUP BY 1"""
)
def weighting_variants(spark, sf_dir):
    """A12, T5."""
    return stats.weightings(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("WITH g AS (SELECT n_regionkey, c_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT n_regionkey, avg(m) AS mean_of_means, sum(m * n) / sum(n) AS entity_mean FROM g GROUP BY 1")
def parent_versus_entity_weighting(spark, sf_dir):
    """Mean of group means beside the mean of entities."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return stats.group_means(c, "n_regionkey", "c_nationkey", "c_acctbal")


@query(
    """WITH d AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) AS n, count(quality) AS q, count(toxic) AS t FROM d GROUP BY 1)
    SELECT lang, 'quality' AS variable, n, q AS known, n - q AS missing, q::DOUBLE / n AS share FROM c UNION ALL SELECT lang, 'toxic', n, t, n - t, t::DOUBLE / n FROM c"""
)
def missingness(spark, sf_dir):
    """A13, T4."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.coverage(d, ["quality", "toxic"], ["lang"])


@query("WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated FROM g")
def duplicate_rate(spark, sf_dir):
    """A14."""
    return stats.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT max(n) AS num, CAST(sum(n) AS BIGINT) AS den, max(n)::DOUBLE / sum(n) AS dominance FROM g")
def dominance(spark, sf_dir):
    """A6, A16."""
    return stats.dominance(read(spark, sf_dir, "events"), "user_id")


@query(
    """SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high,
    quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1"""
)
def descriptive_statistics(spark, sf_dir):
    """A17."""
    return stats.descriptives(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], [0.25, 0.5, 0.9])


@query("SELECT l_suppkey // 10 AS parent, l_suppkey AS immediate_parent, l_linenumber AS level, l_linestatus AS entity_name, count(*) AS n, CAST(sum(round(l_extendedprice * 100)::BIGINT) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2, 3, 4")
def chain_summary(spark, sf_dir):
    """A3: by parent, immediate parent, level and entity."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.expr("l_suppkey div 10").alias("parent"), F.col("l_suppkey").alias("immediate_parent"), F.col("l_linenumber").alias("level"), F.col("l_linestatus").alias("entity_name")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("l_extendedprice")).alias("total"))


@query(
    """WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i FROM customer WHERE c_acctbal > 0)
    SELECT c_nationkey, count(*) AS n, 2 * sum(i * c_acctbal) / (count(*) * sum(c_acctbal)) - (count(*) + 1) / count(*)::DOUBLE AS gini FROM r GROUP BY 1"""
)
def gini_by_country(spark, sf_dir):
    """W6, T7."""
    return stats.gini(read(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"])


@query("WITH t AS (SELECT ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS stratum, c_acctbal, c_nationkey FROM customer) SELECT stratum::INT AS stratum, count(*) AS n, count(DISTINCT c_nationkey) AS nations, avg(c_acctbal) AS mean FROM t GROUP BY 1")
def size_strata(spark, sf_dir):
    """Quartiles of size, cut at exact quantiles by a global rank that no single task computes."""
    c = read(spark, sf_dir, "customer")
    return windows.global_ntile(c, ["c_acctbal", "c_custkey"], 4, "stratum").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.avg("c_acctbal").alias("mean")
    )


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang) AS INT) AS all_langs, CAST(grouping(source) AS INT) AS all_sources FROM documents GROUP BY CUBE (lang, source)")
def margins(spark, sf_dir):
    """A cube."""
    made = stats.margins(read(spark, sf_dir, "documents"), ["lang", "source"], F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return made.withColumnsRenamed({"all_lang": "all_langs", "all_source": "all_sources"})


# Windows and robustness --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def temporal_change(spark, sf_dir):
    """W4."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lag("value").over(w).alias("before"))


@query(
    """WITH y AS (SELECT l_suppkey AS target_id, year(l_shipdate)::BIGINT AS fiscal_year, CAST(sum(round(l_extendedprice * 100)::BIGINT) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2),
    l AS (SELECT *, lag(total) OVER w AS prev, lag(fiscal_year) OVER w AS prev_year FROM y WINDOW w AS (PARTITION BY target_id ORDER BY fiscal_year))
    SELECT target_id, fiscal_year, total, CASE WHEN prev_year = fiscal_year - 1 THEN total - prev END AS change FROM l"""
)
def yearly_change(spark, sf_dir):
    """Change only between neighbouring years."""
    li = read(spark, sf_dir, "lineitem")
    y = li.groupBy(F.col("l_suppkey").alias("target_id"), F.year("l_shipdate").cast("bigint").alias("fiscal_year")).agg(F.sum(cents("l_extendedprice")).alias("total"))
    return stats.yearly_change(y, ["target_id"], "fiscal_year", "total")


@query(
    f"""WITH {REGION_SQL}, g AS (SELECT r_name, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS num, count(*) AS den FROM c GROUP BY 1),
    w AS (SELECT CAST(sum(num) AS BIGINT) AS an, CAST(sum(den) AS BIGINT) AS ad FROM g) SELECT r_name, an - num AS num, ad - den AS den, (an - num)::DOUBLE / (ad - den) AS without,
    (an - num)::DOUBLE / (ad - den) - an::DOUBLE / ad AS change FROM g, w"""
)
def leave_one_parent_out(spark, sf_dir):
    """By subtraction."""
    hit = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).cast("bigint")
    return stats.leave_one_out(customers_by_region(spark, sf_dir), "r_name", hit, F.lit(1).cast("bigint"))


@query(f"WITH {REGION_SQL} SELECT r.r_name AS dropped, median(c.c_acctbal) AS med, count(*) AS n FROM region r JOIN c ON c.r_name <> r.r_name GROUP BY 1")
def leave_one_parent_out_median(spark, sf_dir):
    """A statistic that does not add up; medians from counts by group, without reading a row for each other group."""
    c = customers_by_region(spark, sf_dir)
    n = stats.leave_one_out_any(c, "r_name", lambda g: g.agg(F.count(F.lit(1)).alias("n")))
    med = stats.left_out_quantiles(c, "r_name", "c_acctbal", [0.5]).select("dropped", F.col("quantile").alias("med"))
    return n.join(med, "dropped")


@query(
    """SELECT l_returnflag, count(*)::DOUBLE AS s_1_1, sum(l_quantity) AS s_1_l_quantity, sum(l_extendedprice) AS s_1_l_extendedprice, sum(l_quantity * l_quantity) AS s_l_quantity_l_quantity,
    sum(l_quantity * l_extendedprice) AS s_l_quantity_l_extendedprice, sum(l_extendedprice * l_extendedprice) AS s_l_extendedprice_l_extendedprice FROM lineitem GROUP BY 1"""
)
def sufficient_statistics(spark, sf_dir):
    """T2."""
    return stats.sufficient_statistics(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])


@query("SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, corr(l_extendedprice, l_quantity) AS corr FROM lineitem GROUP BY 1")
def regression(spark, sf_dir):
    """T1, T13."""
    return stats.simple_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query(
    """WITH d AS (SELECT c_nationkey AS g, c_acctbal AS y, (c_custkey % 100)::DOUBLE AS x FROM customer),
    m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
    s AS (SELECT g, sum(y - a - b * x) AS g0, sum(x * (y - a - b * x)) AS g1 FROM d, m GROUP BY 1),
    t AS (SELECT count(*)::DOUBLE AS k, sum(g0 * g0) AS m00, sum(g0 * g1) AS m01, sum(g1 * g1) AS m11 FROM s),
    v AS (SELECT *, n * sxx - sx * sx AS det, k / (k - 1) * (n - 1) / (n - 2) AS f FROM m, t)
    SELECT '1' AS term, a AS beta, sqrt(f * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11)) / det AS se, n::BIGINT AS n FROM v
    UNION ALL SELECT 'x', b, sqrt(f * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11)) / det, n::BIGINT FROM v"""
)
def clustered_regression(spark, sf_dir):
    """Coefficients with standard errors robust to clusters; only sums reach the driver."""
    d = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 100).cast("double").alias("x"))
    return stats.regression_table(d, "y", ["x"], "g")


@query(
    """WITH d AS (SELECT quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
    a AS (SELECT count(*) AS n, count(quality) AS kq, avg(quality) AS aq, sum(quality)::DOUBLE AS sq, min(quality) AS lq, max(quality) AS hq, count(toxic) AS kt, avg(toxic) AS avt, sum(toxic)::DOUBLE AS st,
      min(toxic) AS lt, max(toxic) AS ht, count(n_chars) AS kc, avg(n_chars) AS ac, sum(n_chars)::DOUBLE AS sc, min(n_chars) AS lc, max(n_chars) AS hc FROM d),
    c AS (SELECT count(*) AS complete, avg(quality) AS cq, avg(toxic) AS ct, avg(n_chars) AS cc FROM d WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL)
    SELECT 'quality' AS variable, n, kq AS known, aq AS available_case, complete, cq AS complete_case, (sq + (n - kq) * lq) / n AS low, (sq + (n - kq) * hq) / n AS high FROM a, c
    UNION ALL SELECT 'toxic', n, kt, avt, complete, ct, (st + (n - kt) * lt) / n, (st + (n - kt) * ht) / n FROM a, c
    UNION ALL SELECT 'n_chars', n, kc, ac, complete, cc, (sc + (n - kc) * lc) / n, (sc + (n - kc) * hc) / n FROM a, c"""
)
def missing_data_sensitivity(spark, sf_dir):
    """T4: means over available and over complete cases, with bounds."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.missing_sensitivity(d, ["quality", "toxic", "n_chars"])


@query("SELECT l_linenumber AS stratum, l_returnflag AS label, count(*) AS n, count(*) AS n_shuffled FROM lineitem GROUP BY 1, 2")
def nesting_baseline(spark, sf_dir):
    """Labels dealt out anew inside each stratum; every stratum keeps its labels."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("stratum"), F.col("l_returnflag").alias("label"), "l_orderkey", "l_partkey", "l_extendedprice")
    dealt = stats.nesting_baseline(li, "label", "stratum", 11)
    before = dealt.groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("n"))
    return before.join(dealt.groupBy("stratum", F.col("shuffled").alias("label")).agg(F.count(F.lit(1)).alias("n_shuffled")), ["stratum", "label"], "full")


@query()
def taxonomy_clusters(spark, sf_dir):
    """Sizes and centres of seeded clusters of countries."""
    s = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("mean"))
    made = stats.taxonomy(s, ["n", "mean"], 3)
    return made.groupBy("cluster").agg(F.count(F.lit(1)).alias("countries"), F.avg("n").alias("n"), F.avg("mean").alias("mean"))


@query(
    f"""WITH {REGION_SQL} SELECT r_name, count(c_acctbal) AS den, CAST(sum(CASE WHEN c_acctbal > -950 THEN 1 ELSE 0 END) AS BIGINT) AS num,
    sum(CASE WHEN c_acctbal > -950 THEN 1 ELSE 0 END) < count(c_acctbal) AS refuted FROM c GROUP BY 1"""
)
def falsification(spark, sf_dir):
    """A claim, and the groups that refute it."""
    return stats.falsification(customers_by_region(spark, sf_dir), F.col("c_acctbal") > -950, "r_name")


@query(
    """WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS x,
      rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 50) - 1) / 2.0 AS y FROM customer)
    SELECT c_nationkey, count(*) AS n, corr(x, y) AS spearman FROM r GROUP BY 1"""
)
def rank_correlation(spark, sf_dir):
    """Spearman's, with ties."""
    return stats.spearman(read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 50), "c_acctbal", "k", ["c_nationkey"])


@query(
    """WITH a AS (SELECT s_nationkey AS k, count(*) AS n, avg(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT k, n, v, (rank() OVER (ORDER BY n DESC))::INT AS by_count, (rank() OVER (ORDER BY v DESC))::INT AS by_value,
    CASE WHEN abs(rank() OVER (ORDER BY n DESC) - rank() OVER (ORDER BY v DESC)) >= 10 THEN 'unusual' ELSE 'usual' END AS wording FROM a"""
)
def unusual_combinations(spark, sf_dir):
    """Structure against value by two-way ranks of a few groups, worded neutrally."""
    a = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("v"))
    worded = stats.two_way_ranks(a, "n", "v", 10).withColumnsRenamed({"by_n": "by_count", "by_v": "by_value"})
    return worded.filter(F.size(ledger.loaded_words(F.col("wording"))) == 0)


@query(
    """SELECT 'tolerance_0' AS definition, count(*) AS n FROM lineitem WHERE l_discount <= 0.02 UNION ALL
    SELECT 'tolerance_1', count(*) FROM lineitem WHERE l_discount <= 0.05 UNION ALL SELECT 'tolerance_2', count(*) FROM lineitem WHERE l_discount <= 0.08"""
)
def alternative_definitions(spark, sf_dir):
    """A parameter grid in one pass, one row for each definition."""
    return stats.definition_grid(read(spark, sf_dir, "lineitem"), {f"tolerance_{i}": F.col("l_discount") <= t for i, t in enumerate((0.02, 0.05, 0.08))})


@query(f"SELECT CASE WHEN l_linestatus = 'F' THEN '{SOURCE_PDF}' ELSE '{SOURCE_AOC}' END AS source_type, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def source_union(spark, sf_dir):
    """Both source groups in one table."""
    li = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag")
    both = select.union_sources(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus <> 'F'"))
    return both.groupBy("source_type", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY score DESC, id LIMIT 20")
def highest_value_claims(spark, sf_dir):
    """A top-k report."""
    claims = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.col("s_acctbal").alias("score"))
    return ledger.most_valuable(claims, 20).withColumnRenamed("finding_id", "id")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, sf_dir):
    """Keys of one table that another lacks."""
    return read(spark, sf_dir, "orders").select("o_orderkey").subtract(read(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500")
def reviewed_since(spark, sf_dir):
    """L4: rows behind a cursor, which is the feature; the filter reaches the scan."""
    new = ledger.since(read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "version"), 500)
    return new.select(F.col("version").alias("o_orderkey"), "o_totalprice")


@query(
    f"""WITH {REGION_SQL}, g AS (SELECT n_regionkey, n_name, count(*) AS num FROM c GROUP BY 1, 2), t AS (SELECT n_regionkey, CAST(sum(num) AS BIGINT) AS den, max(num) AS top FROM g GROUP BY 1),
    s AS (SELECT n_regionkey, sum((num::DOUBLE / den) * (num::DOUBLE / den)) AS hhi FROM g JOIN t USING (n_regionkey) GROUP BY 1),
    w AS (SELECT n_regionkey, sum((num::DOUBLE / (den - top)) * (num::DOUBLE / (den - top))) AS without FROM
      (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY num DESC, n_name) AS r FROM g JOIN t USING (n_regionkey)) WHERE r > 1 GROUP BY 1)
    SELECT 'C-F' || lpad((n_regionkey + 1)::VARCHAR, 3, '0') AS finding_id, (floor(hhi * 1000) / 1000)::VARCHAR AS statistic, den::VARCHAR AS denominator, (floor(hhi * 100))::INT AS score,
    'entities' AS counting, CASE WHEN abs(without - hhi) > 0.05 THEN 'FRAGILE' ELSE 'CONFIRMED' END AS status FROM s JOIN t USING (n_regionkey) JOIN w USING (n_regionkey)"""
)
def finding_ledger(spark, sf_dir):
    """L1, L2, L3: the concentration of each region's customers as a finding, computed, recorded with its provenance, and
    judged by whether it holds without the largest nation."""
    path = new_path(spark, "ledger")
    counted = customers_by_region(spark, sf_dir).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("num"))
    found = stats.concentration(counted, ["n_regionkey"], "n_name", "num").select("n_regionkey", "hhi", "den")
    text = {
        "finding_id": F.concat(F.lit("C-F"), F.lpad((F.col("n_regionkey") + 1).cast("string"), 3, "0")),
        "result": F.concat(F.lit("customers by nation, region "), F.col("n_regionkey").cast("string")),
        "statistic": (F.floor(F.col("hhi") * 1000) / 1000).cast("string"), "denominator": F.col("den").cast("string"),
        "score": F.floor(F.col("hhi") * 100).cast("int"), "interest": F.lit("few nations may hold most customers"),
        "robustness": F.lit("without the largest nation"), "mundane": F.lit("nations differ in size"),
        "data_quality": F.lit("none known"), "falsification": F.lit("a region whose index moves by more than 0.05"),
    }
    source = ledger.Provenance("customer", "customers of a nation", "customers of its region", "none", "none", "kept", "entities", "none", "stats.concentration", "leave the largest out")
    ledger.record_rows(found.select(*(v.alias(k) for k, v in text.items())), path, source)
    largest = select.top_rows(counted, ["n_regionkey"], [F.col("num").desc(), F.col("n_name")]).select("n_regionkey", "n_name")
    rest = stats.concentration(counted.join(largest, ["n_regionkey", "n_name"], "left_anti"), ["n_regionkey"], "n_name", "num")
    robust = found.join(rest.select("n_regionkey", F.col("hhi").alias("without")), "n_regionkey")
    robust = robust.select(text["finding_id"].alias("finding_id"), (F.abs(F.col("without") - F.col("hhi")) <= 0.05).alias("robust"))
    judged = spark.read.parquet(path).select("finding_id", "statistic", "denominator", "score", "provenance.counting").join(robust, "finding_id")
    return judged.withColumn("status", ledger.verdict(F.lit(True), F.col("robust"), F.lit(False), F.lit(False))).drop("robust")


# Sources and sinks -------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey::VARCHAR AS target_id, year(l_shipdate)::INT AS fiscal_year, count(*) AS n, sum(l_extendedprice) AS total_assets FROM lineitem GROUP BY 1, 2")
def panel_csv_scan(spark, sf_dir):
    """The panel written as CSV, read with the fixed schema, and cut to a few of its variables."""
    filled = {"target_id": F.col("l_suppkey"), "fiscal_year": F.year("l_shipdate"), "total_assets": F.col("l_extendedprice")}
    rows = read(spark, sf_dir, "lineitem").select(*(filled.get(c, F.lit(None)).cast("string").alias(c) for c in PANEL.names))
    path = new_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    back = sources.read_panel_csv(spark, path).select("target_id", "fiscal_year", "total_assets")
    return back.groupBy("target_id", "fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.sum("total_assets").alias("total_assets"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders")
def stata_scan(spark, sf_dir):
    """All orders as Stata files, written and read back by the executors."""
    path = new_path(spark, "stata")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    sources.stata_files(rows).write.parquet(path)
    back = sources.stata_rows(spark.read.parquet(path), rows.withColumn("o_orderkey", F.col("o_orderkey").cast("double")).schema)
    return back.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("SELECT n_nationkey::VARCHAR AS uin, n_name AS claimants FROM nation")
def mapping_scan(spark, sf_dir):
    """S3: a mapping file as strings."""
    path = new_path(spark, "mapping")
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uin"), F.col("n_name").alias("claimants"), "n_regionkey").write.option("header", True).csv(path)
    return sources.read_mapping_csv(spark, path, ["uin", "claimants"])


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def result_sink(spark, sf_dir):
    """A result written beside its input, never onto it, and read back."""
    path = new_path(spark, "result")
    counted = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    sources.write_result(counted, path, inputs=(f"{sf_dir}/nation.parquet",))
    return spark.read.parquet(path)


# Streams, run here in batch ----------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def daily_events(spark, sf_dir):
    return windows.tumbling(read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value").withColumnRenamed("start", "day")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "ts", "1 hour", "user_id")


@query(
    """SELECT user_id, CAST(ts AS DATE) AS day, first(event_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, event_id) AS event_id FROM events GROUP BY 1, 2"""
)
def preferred_event(spark, sf_dir):
    """W1 as an aggregate, which also works on streams."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_id", F.struct(rank, "event_id")).alias("event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """First arrivals within a watermark, as a stream that ends with what is there."""
    events = read(spark, sf_dir, "events")
    path, out = new_path(spark, "stream"), new_path(spark, "deduplicated")
    events.select("user_id", "event_type", "ts").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    kept = windows.deduplicated(stream, "ts", "3650 days", ["user_id", "event_type"]).select("user_id", "event_type")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(out)
