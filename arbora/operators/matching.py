"""Names matched without a block, by shared rare grams, with exact edit distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.tables import Scratch, materialize


def positional_grams(name: Column, q: int) -> Column:
    """``(gram, at)`` of every ``q`` characters in a row of a padded name."""
    padded = F.concat(F.lit("\x01" * (q - 1)), name, F.lit("\x02" * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(name) + q - 1), lambda i: F.struct(padded.substr(i, F.lit(q)).alias("gram"), i.alias("at")))


def deletions(name: Column, edits: int) -> Column:
    """The name and everything that up to ``edits`` deletions make of it."""
    out = F.array(name)
    for _ in range(edits):
        shorter = F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(s.substr(F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def _tokens(names: DataFrame, edits: int, q: int, often: DataFrame) -> DataFrame:
    """``name, size, token, at``: the tokens one of which two names within ``edits`` must share.

    An edit touches at most ``q`` grams, so of any ``q * edits + 1`` grams one stays whole: the rarest are taken. Names
    too short for that, and those that may meet one, have their deletions as tokens, of which two names within
    ``edits`` always share one.
    """
    grams = names.select("name", F.length("name").alias("size"), F.inline(positional_grams(F.col("name"), q)))
    # All places of a gram are taken or none, as its match may stand at any of them.
    rare = Window.partitionBy("name").orderBy("often", "gram")
    ranked = grams.join(often, "gram").withColumn("_i", F.rank().over(rare))
    prefix = ranked.filter(F.col("_i") <= q * edits + 1).select("name", "size", F.concat(F.lit("g"), "gram").alias("token"), "at")
    short = names.filter(F.length("name") + q - 1 <= q * edits + edits)
    variants = short.select("name", F.length("name").alias("size"), F.explode(deletions(F.col("name"), edits)).alias("v"))
    return prefix.unionByName(variants.select("name", "size", F.concat(F.lit("d"), "v").alias("token"), F.lit(None).cast("int").alias("at")))


def near_names(left: DataFrame, right: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """``name, other, distance`` for all pairs of a ``left.name`` and a ``right.name`` within ``edits`` character edits.

    Only names that share one of their rarest grams, at places no further apart than the edits, and of lengths as near,
    are compared; the length is part of the join's key, so a gram that many names share is split by length. Equal names
    are compared once. Null names match nothing; empty ones match names of at most ``edits`` characters.
    """
    scratch = Scratch(left.sparkSession)
    distinct = lambda df: df.select("name").filter("name IS NOT NULL").distinct()
    a, b = scratch.table(distinct(left), "names"), scratch.table(distinct(right), "names")
    every = a.union(b).distinct().select(F.explode(positional_grams(F.col("name"), q)["gram"]).alias("gram"))
    often = scratch.table(every.groupBy("gram").agg(F.count(F.lit(1)).alias("often")), "grams")
    there = _tokens(b, edits, q, often).withColumnsRenamed({"name": "other", "at": "there"})
    here = _tokens(a, edits, q, often).withColumn("size", F.explode(F.sequence(F.greatest(F.col("size") - edits, F.lit(0)), F.col("size") + edits)))
    met = here.join(there, ["token", "size"]).filter(F.coalesce(F.abs(F.col("at") - F.col("there")) <= edits, F.lit(True)))
    distance = F.levenshtein("name", "other", edits)
    found = met.select("name", "other").distinct().withColumn("distance", distance).filter("distance >= 0")
    made, _ = materialize(found, "near-names")
    scratch.drop()
    return made


def best_name_anywhere(left: DataFrame, right: DataFrame, key: str, name: str, edits: int = 2) -> DataFrame:
    """For every row of ``left`` the nearest name of all of ``right``: ``key, name, match_key, match_name, distance, match_score, match_status``.

    Ties go to the smallest name, then the smallest key. The score is one less the edits' share of the longer name; rows
    beyond ``edits``, and those without a name, are ``not_matched``.
    """
    keyed = right.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("other")).agg(F.min(key).alias("match_key"))
    pairs = near_names(left.select(F.col(name).alias("name")), keyed.select(F.col("other").alias("name")), edits)
    best = pairs.groupBy("name").agg(F.min(F.struct("distance", "other")).alias("one")).select("name", "one.distance", "one.other")
    best = best.join(keyed, "other").select(F.col("name").alias("_name"), "match_key", F.col("other").alias("match_name"), "distance")
    longer = F.greatest(F.length(name), F.length("match_name"), F.lit(1))
    return left.select(key, name).join(best, F.col(name) == F.col("_name"), "left").select(
        key, name, "match_key", "match_name", "distance", (1 - F.col("distance") / longer).alias("match_score"),
        F.when(F.col("match_name").isNotNull(), "matched").otherwise("not_matched").alias("match_status"),
    )
