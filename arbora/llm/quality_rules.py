"""Quality rules: one threshold table, compiled into one Spark projection of counts and ratios. Native throughout.

The projection splits a text into words and lines once, and takes all counts from these; the rules compare the counts.
Defined cases: a null text counts as one without words, so it fails the base rule; repeated rows are judged alike;
an empty table gives an empty result; columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import computed, let

BLANKS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are from or an at "
    "de la le et les des en un une du est que qui dans pour par sur "
    "der die und das den von zu mit ist im nicht ein eine auf für "
    "el los las se por con del al no su para es lo y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` for texts of ``min_words`` words or more."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The verdict's thresholds. Ratios are over words, characters of words, or lines that hold a word.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words", "n_stop", "n_words", 0.03, None, 40),
    Rule("exclamations", "n_exclaimed", "n_words", None, 0.4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullets", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipses", "n_lines", None, 0.4),
)


def repeated_words(grams: Column) -> Column:
    """Words inside a window whose hash occurs twice or more; ``grams`` has one hash per window start."""

    def covered(spots: Column) -> Column:
        steps = F.transform(
            spots,
            lambda p, i: F.when(i + 1 < F.size(spots), F.least(F.lit(WINDOW), F.get(spots, i + 1) - p)).otherwise(WINDOW),
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def twins(ranked: Column) -> Column:
        return F.filter(
            ranked,
            lambda x, i: (F.get(ranked, i - 1)["h"] == x["h"]) | (F.get(ranked, i + 1)["h"] == x["h"]),
        )

    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    spots = let(ranked, lambda r: F.sort_array(F.transform(twins(r), lambda x: x["p"])))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(spots, covered))


def counts_of(text: Column) -> Column:
    """The counts that the rules compare, as one struct; words, lines and window hashes are made once."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    split = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(words: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
        )
        return F.when(F.size(words) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def counted(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(windows(words), repeated_words),
            "n_lines": F.size(lines),
            "n_stop": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_exclaimed": F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!")))),
            "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
            "n_ellipses": F.size(
                F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))
            ),
        }
        return F.struct(*(c.cast("bigint").alias(name) for name, c in counts.items()))

    return let(split, lambda words: let(worded, lambda lines: counted(words, lines)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """The counts that the rules compare, one row per document; with ``row`` also the document's row as a struct.

    With ``row`` the counts stand behind a barrier, as a later filter on the verdict would make them a second time.
    """
    counts = counts_of(F.coalesce(F.col(text_col), F.lit("")))
    if row:
        return computed(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), counts.alias("counts")), ["doc_id", "row"], counts=F.col("counts")).select(
            "doc_id", "row", "counts.*"
        )
    return docs.select(F.col(id_col).alias("doc_id"), counts.alias("counts")).select("doc_id", "counts.*")


def passes(rule: Rule) -> Column:
    """The rule as one boolean expression; an undefined ratio passes."""
    value = F.col(rule.numerator).cast("double")
    if rule.denominator:
        value = F.try_divide(value, F.col(rule.denominator).cast("double"))
    held = F.lit(True)
    if rule.low is not None:
        held = held & (value >= rule.low)
    if rule.high is not None:
        held = held & (value <= rule.high)
    held = F.coalesce(held, F.lit(True))
    return (F.col("n_words") < rule.min_words) | held if rule.min_words else held


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, row: bool = False
) -> DataFrame:
    """Counts, ``base_failed``, one ``ok_<rule>`` per rule, and ``kept`` for every document.

    A document is kept if the base rule (10 words or more, at most a fifth of the words in repeated five-word windows)
    and every rule of the table hold.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measures(docs, id_col, text_col, row).select(
        "*", failed.alias("base_failed"), *(passes(r).alias(f"ok_{r.name}") for r in rules)
    )
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"ok_{r.name}")
    return judged.withColumn("kept", verdict)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that all rules keep, with all their columns."""
    return quality_rules(docs, id_col, text_col, rules, row=True).filter("kept").select("row.*")
