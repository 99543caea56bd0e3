"""Scalar functions of the panel: column expressions, no user functions."""

from arbora.functions.scalars import blank_to_null, domain, list_items, match_score, normal_name, text_date

__all__ = ["blank_to_null", "domain", "list_items", "match_score", "normal_name", "text_date"]
