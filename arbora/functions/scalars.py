"""Names, domains, lists and dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms in which a date may be written, tried in this order. Day before month, as the filings have it.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyyMMdd")


def blank_to_null(text: Column) -> Column:
    """Null for a string without any character but blanks."""
    return F.when(F.trim(text) != "", text)


def list_items(text: Column, sep: str = ";") -> Column:
    """The trimmed items of a list in a string; empty items are left out."""
    return F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")


def normal_name(name: Column) -> Column:
    """Lower-cased, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def domain(url: Column) -> Column:
    """The host of a URL, lower-cased; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def match_score(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length, on lower-cased trimmed names."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.lit(1.0) - F.try_divide(F.levenshtein(x, y).cast("double"), F.greatest(F.length(x), F.length(y)).cast("double"))


def text_date(text: Column) -> Column:
    """The date that a text states in one of DATE_FORMS, else null; commas and ordinal endings do not matter."""
    plain = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(?<=\d)(st|nd|rd|th)\b", ""), r"[,\s]+", " ")))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(form)).cast("date") for form in DATE_FORMS))
