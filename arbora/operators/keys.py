"""Joins on group keys, in which a missing key is a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups up to which their figures are broadcast.
FEW = 10_000


def fresh_names(df: DataFrame, by: list[str]) -> dict[str, str]:
    """Names for a second set of key columns that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, {}
    for c in by:
        name = f"_by_{c}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out[c] = name
    return out


def beside(df: DataFrame, figures: DataFrame, by: list[str], how: str = "left", few: bool | None = None) -> DataFrame:
    """``df`` with the figures of its group, null groups too; ``figures`` has one row a group, or one row at all.

    They are broadcast up to FEW groups, which are counted, unless ``few`` tells what the caller knows.
    """
    if not by:
        return df.crossJoin(F.broadcast(figures))  # one row
    names = fresh_names(df, by)
    there = figures.withColumnsRenamed(names)
    if few if few is not None else there.limit(FEW + 1).count() <= FEW:
        there = F.broadcast(there)
    on: Column = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return df.join(there, on, how).drop(*names.values())
