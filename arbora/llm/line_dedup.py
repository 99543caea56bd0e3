"""Line dedup by a deletion-neighbourhood join. Native throughout: DataFrame operations and SQL functions only.

Lines are compared lower-cased, with white space folded. A line goes if an equal line, or one within one edit, stands
earlier (by document id, then line number). Each distinct line is looked at once; copies only count.

All variants of a line with one character deleted, and the line itself, are keys; lines with equal keys are at most two
edits apart. With the deleted place in the key, equal keys mean one substitution; a line that equals a variant of
another means one insertion. So every group needs only its earliest members, whatever its size, and never all pairs.

Variants are limited to lines that can have a partner, which loses none. One edit leaves one half of a line whole, so
a line must share a half (first filter). Cut into blocks of BLOCK characters from both ends, two such lines agree
on all blocks but a stretch of less than two blocks (second filter), and only characters of that stretch are deleted.
This keeps the work in proportion to a line's length.

Defined cases: lines without a word always stay; lines shorter than ``min_near`` are matched exactly only, as one edit
makes another word of a short line; with 0 all lines are matched within the edit. A null text stays null and has no
lines; null ids count as the latest; rows that repeat id and text share one verdict; an empty table gives an empty
result; extra columns pass through ``dedup_documents``, whatever their names, and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import fresh, let, materialize, remove

BLOCK, MIN_NEAR = 8, 20
#: Up to this number of candidate lines (some 100 bytes each) a broadcast filters the second scan; beyond it the scan is
#: joined by shuffle.
BROADCAST_LINES = 500_000
WORD = r"[^\x20\x09-\x0D]"
LAST = (1 << 63) - 1


def normalized(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def block_of(m: Column) -> Column:
    """The block size for lines of at most ``m`` characters: BLOCK, doubled for very long lines."""
    doublings = F.greatest(F.lit(0.0), F.ceil(F.log2(m / 8192.0)).cast("double"))
    return (BLOCK * F.pow(F.lit(2.0), doublings)).cast("int")


def all_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, norm``: every line with a word."""
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(WORD)).select("doc_id", "text_hash", "pos", normalized(F.col("line")).alias("norm"))


def identified(lines: DataFrame) -> DataFrame:
    """With ``h1, h2`` naming a distinct line, its length, and its place ``at`` in the corpus order."""
    return lines.select(
        "*",
        F.xxhash64("norm").alias("h1"),
        F.hash("norm").alias("h2"),
        F.length("norm").alias("n"),
        F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_hash", "pos").alias("at"),
    )


def half_keys(norm: Column, n: Column) -> Column:
    """Hashes of the halves that a partner of equal length, one more or one less must share."""
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    start = lambda q: F.xxhash64(F.substr(norm, F.lit(1), q), q, F.lit(0))
    end = lambda q: F.xxhash64(F.substr(norm, n - q + 1, q), q, F.lit(1))
    return F.array_distinct(F.array(start(low), start(high), end(low), end(high)))


def block_keys(norm: Column, n: Column, m: Column) -> Column:
    """For pairs whose longer line has ``m`` characters: a key and the middle stretch for every cut of the blocks."""
    block = block_of(m)
    total = F.greatest(F.lit(0), F.ceil((m - 2 * block + 1) / block).cast("int"))

    def pieces(b: Column, t: Column) -> Column:
        no_blocks = F.array().cast("array<bigint>")
        left = F.when(t > 0, F.transform(F.sequence(F.lit(0), t - 1), lambda i: F.xxhash64(F.substr(norm, i * b + 1, b)))).otherwise(no_blocks)
        right = F.when(
            t > 0, F.transform(F.sequence(F.lit(0), t - 1), lambda i: F.xxhash64(F.substr(norm, n - (t - i) * b + 1, b)))
        ).otherwise(no_blocks)
        # ``right`` has the last t blocks in reading order, so the cut after j keeps its elements from j on.
        return let(
            left,
            lambda x: let(
                right,
                lambda y: F.transform(
                    F.sequence(F.lit(0), t),
                    lambda j: F.struct(
                        F.xxhash64(m, j, F.slice(x, 1, j), F.slice(y, j + 1, t - j)).alias("key"),
                        F.substr(norm, j * b + 1, n - t * b).alias("middle"),
                    ),
                ),
            ),
        )

    return let(block, lambda b: let(total, lambda t: pieces(b, t)))


def near_pairs(docs: DataFrame, distinct: DataFrame, min_near: int) -> DataFrame:
    """``h1, h2, earlier``: distinct lines with the place of their earliest partner, where that stands earlier."""
    spark = docs.sparkSession
    halves = distinct.filter(F.col("n") >= min_near).select("h1", "h2", F.explode("halves").alias("half"))
    shared, shared_at = materialize(
        halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half"), "halves"
    )
    maybe, maybe_at = materialize(halves.join(shared, "half", "left_semi").select("h1", "h2").distinct(), "maybe")
    chosen = distinct.select("h1", "h2", "at").join(maybe, ["h1", "h2"])
    chosen, chosen_at = materialize(chosen, "chosen")
    wanted = F.broadcast(chosen) if chosen.count() <= BROADCAST_LINES else chosen
    lines = identified(all_lines(docs)).join(wanted, ["h1", "h2", "at"], "left_semi").select("h1", "h2", "at", "n", "norm").distinct()
    lines, lines_at = materialize(lines, "lines")
    remove(spark, shared_at, maybe_at)

    cuts = lines.select(
        "h1", "h2", "at", "n", F.explode(F.array(F.col("n"), F.col("n") + 1)).alias("m"), "norm"
    ).select("h1", "h2", "at", "n", "m", F.inline(block_keys(F.col("norm"), F.col("n"), F.col("m"))))
    cuts, cuts_at = materialize(cuts, "cuts")
    met, met_at = materialize(cuts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "met")

    middle, size = F.col("middle"), F.length("middle")
    without = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.concat(F.substr(middle, F.lit(1), i - 1), F.substr(middle, i + 1, size)).alias("rest"), i.alias("gone")
        ),
    )
    whole = F.array(F.struct(middle.alias("rest"), F.lit(0).alias("gone")))
    variants = cuts.join(met, "key").select(
        "h1", "h2", "at", "key", F.inline(F.when(F.col("n") < F.col("m"), whole).otherwise(without))
    ).select("h1", "h2", "at", F.xxhash64("key", "rest").alias("variant"), "gone")
    variants, variants_at = materialize(variants, "variants")
    earliest = (
        variants.groupBy("variant", "gone").agg(F.min("at").alias("same_place"))
        .groupBy("variant")
        .agg(
            F.min(F.when(F.col("gone") == 0, F.col("same_place"))).alias("line_itself"),
            F.min(F.when(F.col("gone") > 0, F.col("same_place"))).alias("longer"),
            F.map_from_entries(F.collect_list(F.struct("gone", "same_place"))).alias("by_place"),  # at most two blocks
        )
    )
    earliest, earliest_at = materialize(earliest, "earliest")
    partner = F.when(F.col("gone") == 0, F.col("longer")).otherwise(
        F.least("line_itself", F.element_at("by_place", F.col("gone")))
    )
    pairs = (
        variants.join(earliest, "variant")
        .select("h1", "h2", "at", partner.alias("earlier"))
        .filter(F.col("earlier") < F.col("at"))
        .groupBy("h1", "h2")
        .agg(F.min("earlier").alias("earlier"))
    )
    # Both lines are fetched for the exact distance.
    pairs, pairs_at = materialize(pairs, "pairs")
    own = lines.select("h1", "h2", F.col("norm").alias("own"))
    other = lines.select(F.col("at").alias("earlier"), F.col("norm").alias("other"))
    checked = (
        pairs.join(own, ["h1", "h2"])
        .join(other, "earlier")
        .filter(F.levenshtein("own", "other", 1) >= 0)
        .select("h1", "h2", "earlier")
        .distinct()
    )
    checked, _ = materialize(checked, "near")
    remove(spark, cuts_at, met_at, variants_at, earliest_at, pairs_at, lines_at, chosen_at)
    return checked


def removed_lines(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """``doc_id, text_hash, gone``: the sorted numbers of the lines to remove, for documents that have any."""
    spark = docs.sparkSession
    found = identified(all_lines(docs)).select(
        "doc_id", "text_hash", "pos", "h1", "h2", "n", "at", half_keys(F.col("norm"), F.col("n")).alias("halves")
    )
    lines, lines_at = materialize(found, "all-lines")
    distinct, distinct_at = materialize(
        lines.groupBy("h1", "h2").agg(
            F.min("at").alias("at"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("halves").alias("halves")
        ),
        "distinct",
    )
    near = near_pairs(docs, distinct, min_near)
    verdicts = (
        distinct.select("h1", "h2", F.col("at").alias("kept_at"), "c")
        .join(near.select("h1", "h2", F.lit(True).alias("near")), ["h1", "h2"], "left")
        .filter("c > 1 OR near")
        .select("h1", "h2", "kept_at", "near")
    )
    verdicts, verdicts_at = materialize(verdicts, "verdicts")
    gone = (
        lines.join(verdicts, ["h1", "h2"])
        .filter(F.coalesce("near", F.lit(False)) | (F.col("at") != F.col("kept_at")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))  # a document bounds its lines
    )
    gone, _ = materialize(gone, "gone")
    remove(spark, lines_at, distinct_at, verdicts_at)
    return gone


def dedup_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_lines: str = "_n_lines",
    n_removed: str = "_n_removed",
    min_near: int = MIN_NEAR,
) -> DataFrame:
    """All columns of ``docs`` with the text's repeated lines removed, and two counts of lines with a word, so named."""
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    doc, text, cut_col = (fresh(c, docs) for c in ("_doc", "_hash", "_gone"))
    gone = removed_lines(keyed, min_near).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("gone").alias(cut_col))
    joined = docs.join(
        gone, F.col(id_col).cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(text)), "left"
    )
    lines, cut = F.split(text_col, "\n"), F.col(cut_col)
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), cut).alias("low"), F.concat(cut, F.array(F.size(lines))).alias("high")
    )
    rest = let(lines, lambda x: F.flatten(F.transform(bounds, lambda b: F.slice(x, b["low"] + 2, b["high"] - b["low"] - 1))))
    counted = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(WORD))))
    return joined.select(
        *(
            F.when(cut.isNull(), F.col(c)).otherwise(F.array_join(rest, "\n")).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
        ),
        counted.cast("bigint").alias(n_lines),
        F.coalesce(F.size(cut), F.lit(0)).cast("bigint").alias(n_removed),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` for every document; lines count if they hold a word."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return dedup_documents(plain, n_lines="n_lines", n_removed="n_removed", min_near=min_near).select("doc_id", "n_lines", "n_removed", "text")
