"""The fixed panel schema: 77 variables, their enums, and the pairs of values and evidence."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.ByteType()

#: Names of the panel's variables, as its dictionary documents them.
IDENTITY = [
    ("target_id", _S), ("parent", _S), ("level", _I), ("entity_name", _S), ("entity_country", _S), ("immediate_parent", _S),
    ("immediate_parent_country", _S), ("stake", _D), ("sector_code", _S), ("sector_label", _S), ("uin", _S), ("shared_uin", _I),
    ("n_top30_claimants", _I), ("top30_claimants", _S), ("attribution_rule", _S), ("fiscal_year", _I),
    ("period_end_date", T.DateType()), ("source_type", _S), ("source_url", _S), ("source_domain", _S), ("source_title", _S),
    ("local_file", _S), ("currency", _S), ("units", _S),
]
MONEY = (
    "total_assets total_liabilities equity share_capital reserves_surplus turnover profit_before_tax provision_tax "
    "profit_after_tax cash_flow_operating cash_flow_investing cash_flow_financing cash_end dividends_paid interest_paid "
    "issue_share_capital proceeds_borrowings repayment_borrowings"
).split()
QUALITY = [
    ("extraction_method", _S), ("match_score", _D), ("source_found", _B), ("pdf_downloaded", _B), ("variables_parsed", _B),
    ("accounting_identity_gap", _D), ("accounting_identity_ok", _B), ("needs_manual_review", _B), ("ready_for_valuation", _B),
    ("review_reason", _S), ("aoc_match_status", _S), ("aoc_company_name", _S), ("data_quality_tier", _S), ("pl_identity_ok", _B),
    ("source_priority", _I), ("preferred_for_target_year", _B),
]
EVIDENCE = {m: f"{m}_evidence" for m in MONEY}

PANEL = T.StructType(
    [T.StructField(n, t, n not in ("target_id", "fiscal_year")) for n, t in IDENTITY]
    + [T.StructField(m, _D) for m in MONEY]
    + [T.StructField("shareholding_percent", _D)]
    + [T.StructField(e, _S) for e in EVIDENCE.values()]
    + [T.StructField(n, t) for n, t in QUALITY]
)

#: The documented value domains.
SOURCE_PDF, SOURCE_AOC = "standalone_or_combined_subsidiary_pdf", "parent_annual_report_aoc1"
TIERS = ("full_pdf_ready", "aoc1_ready", "full_pdf_review", "aoc1_review")
DOMAINS = {
    "source_type": (SOURCE_PDF, SOURCE_AOC),
    "data_quality_tier": TIERS,
    "aoc_match_status": ("matched", "not_matched"),
    "pl_identity_ok": (1, 0, -1),
}
EXCLUDED_RULE = "multiple_top30_claimants_review"
REASONS = (
    "balance_sheet_variables_missing", "period_end_missing", "currency_missing", "combined_pdf_section_not_found",
    "accounting_identity_failed",
)
VERDICTS = (
    "CONFIRMED", "PARTIALLY CONFIRMED", "FRAGILE", "DATA ARTIFACT", "NOT REPRODUCIBLE",
    "INTERESTING BUT NEEDS EXTERNAL VALIDATION",
)


def check_schema(columns: list[str]) -> None:
    """Raise if a panel's columns are not exactly the documented ones."""
    want, have = set(PANEL.names), set(columns)
    if want != have:
        raise ValueError(f"panel columns differ: missing {sorted(want - have)}, unknown {sorted(have - want)}")
