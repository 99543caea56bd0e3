"""Source divergence audit: how far the term frequencies of a language's sources lie apart, in whole numbers.

Every source of a language gives each kept term the share ``p = 1 + floor(10^9 (count + 1) / (N + V))``; the divergence
of two is the sum over terms of ``floor((p - q)^2 / q)``. Terms that many sources use are heavy, all others light:

* heavy terms are dealt to tiles, and a tile is a dense numpy matrix of sources by terms, so that a tile's part of all
  sums is a few array steps. Sources are dealt to blocks, and a tile holds two blocks, so its size has a bound;
* a source without a light term gives it the share of a count of 0, which depends on the source alone. So the sum over
  light terms is ``terms x f(p0, q0)``, plus what changes where one side has the term, which needs no more than a
  histogram of each source's shares, plus a correction for each pair of sources in a term's short list of postings.

All parts are whole numbers, so their sums are exact, whatever the split.

Defined cases: null text, lang and source are read as empty; a group without terms is there with all shares alike; a
language without kept terms has divergences of 0; rows count as documents, repeated ones too; an empty table gives an
empty result; equal values are ranked by name; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import Scratch, materialize

#: Over UTF-8 bytes in lower case: ASCII letters and all that is not ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class Params:
    #: A kept term's least documents of the language; ranks of the term part.
    min_docs: int = 3
    ranks: int = 200
    scale: int = 1_000_000_000
    #: A term is light up to a quarter of the sources, at least and at most so many.
    light_least: int = 8
    light_most: int = 64
    #: Sources of a block and terms of a tile.
    block: int = 128
    tile: int = 128
    #: Rows of the histograms that a base tile holds, about, before they are dealt to the blocks.
    cells: int = 2_048
    #: Entries that a task counts before it gives them on, and groups up to which their figures are broadcast.
    held: int = 300_000
    small: int = 100_000


# Counts ------------------------------------------------------------------------------------------------------------


def term_counts(docs: DataFrame, p: Params) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, pre-aggregated in every task before the shuffle."""

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given():
            for (lang, source), (n, in_docs) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                        pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                        pa.array([in_docs[t] for t in n], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        entries = 0
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw):
                terms = TERM.findall(text.as_py().lower())
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(n)
                n.update(terms)
                in_docs.update(set(terms))
                entries += len(n)
                if entries >= p.held:
                    yield from given()
                    entries = 0
        yield from given()

    counted = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, p: Params) -> Column:
    """``1 + floor(scale (n + 1) / total)`` in whole numbers that cannot overflow."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(p.scale).cast("decimal(10,0)") * wide(n + 1), wide(F.greatest(total, F.lit(1))))


def apart(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most ``scale + 1``, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


# Tiles -------------------------------------------------------------------------------------------------------------

PART = "lang string, source string, item string, value bigint"


def dense_sums(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divergences of every row of ``left`` from every row of ``right``, and the other way round."""
    there, back = np.zeros((len(left), len(right)), np.int64), np.zeros((len(right), len(left)), np.int64)
    for i, row in enumerate(left):
        gap = (row - right) ** 2
        there[i] = (gap // right).sum(axis=1)
        back[:, i] = (gap // row).sum(axis=1)
    return there, back


def dense_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of sources by some heavy terms. A row without a term tells a source of the block, its base share, and the
    number of the tile's terms, of which some may be in neither block."""
    marks, cells = rows[rows.term.isna()], rows[rows.term.notna()]
    place = {s: i for i, s in enumerate(marks.source)}
    term, names = pd.factorize(cells.term)
    shares = np.repeat(marks.p0.to_numpy(np.int64)[:, None], len(names), axis=1)
    shares[cells.source.map(place).to_numpy(np.int64), term] = cells.p.to_numpy(np.int64)
    base, absent = marks.p0.to_numpy(np.int64)[:, None], int(marks.m.iloc[0]) - len(names)

    def sums(a, b):
        there, back = dense_sums(shares[a], shares[b])
        plain_there, plain_back = dense_sums(base[a], base[b])
        return there + absent * plain_there, back + absent * plain_back

    return _paired(rows, marks, sums)


def base_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of sources and light terms, as if no term were in two sources.

    A source's other rows are a histogram, ``m`` terms of share ``p``. ``m`` of its mark is the number of all light terms,
    in one of the base tiles of a language; in the others, which hold more of the histogram, it is 0.
    """
    marks, cells = rows[rows.p.isna()], rows[rows.p.notna()]
    base, terms = marks.p0.to_numpy(np.int64), marks.m.to_numpy(np.int64)
    held = {s: (g.p.to_numpy(np.int64)[:, None], g.m.to_numpy(np.int64)[:, None]) for s, g in cells.groupby("source")}
    none = np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64)
    own = [held.get(s, none) for s in marks.source]

    def one_way(a, b):
        """Divergences of the sources at ``a`` from those at ``b``: ``a`` gives p, ``b`` gives q."""
        p0, q0 = base[a][:, None], base[b][None, :]
        plain = (p0 - q0) ** 2 // q0
        out = plain * terms[a][:, None]
        for i, k in enumerate(a):
            p, m = own[k]
            out[i] += (m * ((p - q0) ** 2 // q0 - plain[i])).sum(axis=0)
        for j, k in enumerate(b):
            q, m = own[k]
            out[:, j] += (m * ((p0.T - q) ** 2 // q - plain[:, j])).sum(axis=0)
        return out

    return _paired(rows, marks, lambda a, b: (one_way(a, b), one_way(b, a)))


def _paired(rows: pd.DataFrame, marks: pd.DataFrame, sums) -> pd.DataFrame:
    """The sums of ``sums`` for all ordered pairs of a source of the low and one of the high block, as rows."""
    names, block = marks.source.to_numpy(object), marks.block.to_numpy()
    low, high = np.nonzero(block == rows.low.iloc[0])[0], np.nonzero(block == rows.high.iloc[0])[0]
    out = []
    if len(low) and len(high):
        there, back = sums(low, high)
        same = rows.low.iloc[0] == rows.high.iloc[0]
        for a, b, value in ((low, high, there),) if same else ((low, high, there), (high, low, back)):
            i, j = np.nonzero(names[a][:, None] != names[b][None, :])
            out.append(pd.DataFrame({"lang": rows.lang.iloc[0], "source": names[a][i], "item": names[b][j], "value": value[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": np.zeros(0, np.int64)})


def tile_sums(rows: pd.DataFrame) -> pd.DataFrame:
    return base_tile(rows) if rows.tile.iloc[0] < 0 else dense_tile(rows)


def posting_sums(batches):
    """Corrections for the pairs of sources in the postings of light terms, summed up in the task."""
    held: dict[str, Counter] = {}
    entries = 0

    def given():
        for lang, sums in held.items():
            a, b = zip(*sums)
            kinds = pa.string(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([lang] * len(sums), a, b, list(sums.values())), kinds)], names=["lang", "source", "item", "value"])
        held.clear()

    for batch in batches:
        lists = batch.column("postings")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        source, p, p0 = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        names, code = source.dictionary.to_pylist(), source.indices.to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        langs = batch.column("lang").dictionary_encode()
        of_lang = langs.indices.to_numpy()
        for at, lang in enumerate(langs.dictionary.to_pylist()):
            keys, values = [], []
            for k in np.unique(sizes[of_lang == at]).tolist():
                cells = starts[(of_lang == at) & (sizes == k)][:, None] + np.arange(k)
                mine, base = p[cells], p0[cells]
                gap = lambda x, y: (x[:, :, None] - y[:, None, :]) ** 2 // y[:, None, :]
                change = gap(mine, mine) - gap(mine, base) - gap(base, mine) + gap(base, base)
                pair = code[cells][:, :, None] * len(names) + code[cells][:, None, :]
                off = np.broadcast_to(~np.eye(k, dtype=bool), pair.shape)
                keys.append(pair[off])
                values.append(change[off])
            found, spot = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, spot, np.concatenate(values))
            sums = held.setdefault(lang, Counter())
            entries -= len(sums)
            for pair, value in zip(found.tolist(), total.tolist()):
                sums[names[pair // len(names)], names[pair % len(names)]] += value
            entries += len(sums)
        if entries >= 200_000:
            yield from given()
            entries = 0
    yield from given()


# The audit ---------------------------------------------------------------------------------------------------------


def source_divergence(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` against the other sources, part ``term`` against the language."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    whole = Window.partitionBy("lang", "term")
    kept = term_counts(texts, p).select(
        "lang", "source", "term", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("lang_n"),
        F.count(F.lit(1)).over(whole).alias("k"), (F.min("source").over(whole) == F.col("source")).alias("first"),
    ).filter(F.col("docs") >= p.min_docs)
    kept = scratch.table(kept.drop("docs"), "kept")

    # Figures of a group and of its language; ``first`` marks one row for each kept term.
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count_if("first").alias("firsts"))
    groups = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["own_n", "firsts"])
    groups = scratch.table(groups, "groups")
    by_lang = groups.groupBy("lang").agg(
        F.sum("own_n").alias("lang_total"), F.sum("firsts").alias("terms"), F.count(F.lit(1)).alias("sources")
    )
    sources = F.col("sources")
    light = F.least(F.greatest(F.floor(sources / 4), F.lit(p.light_least)), F.lit(p.light_most))
    by_lang = by_lang.withColumns({"light": light, "blocks": F.ceil(sources / p.block)})
    near = lambda df, other: df.join(F.broadcast(other) if other.count() <= p.small else other, "lang")
    heavy = near(kept.filter("first").select("lang", "term", "k"), by_lang.select("lang", "light")).filter("k > light").select("lang", "term")
    heavy = scratch.table(heavy, "heavy")
    many = heavy.groupBy("lang").agg(F.count(F.lit(1)).alias("heavy"))
    by_lang = by_lang.join(many, "lang", "left").na.fill(0, ["heavy"]).withColumn("tiles", F.ceil(F.col("heavy") / p.tile))
    by_lang = scratch.table(by_lang, "langs")
    tile_of = F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile")
    held = near(heavy, by_lang.select("lang", "tiles")).groupBy("lang", tile_of).agg(F.count(F.lit(1)).alias("m"))
    groups = groups.drop("firsts").join(by_lang, "lang")
    groups = groups.withColumns(
        {
            "p0": share(F.lit(0), F.col("own_n") + F.col("terms"), p),
            "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"),
        }
    )
    groups = scratch.table(groups, "groups")
    few = F.broadcast(groups) if groups.count() <= p.small else groups
    shared = kept.join(few, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("own_n") + F.col("terms"), p))

    # Terms against the language.
    q = share(F.col("lang_n"), F.col("lang_total") + F.col("terms"), p)
    terms = shared.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= p.ranks)

    # Heavy terms: tiles of terms by blocks of sources. Light ones: base tiles (below 0) by blocks, and postings.
    columns = "lang", "tile", "source", "block", "blocks", "p0", "term", "p", "m"
    none = lambda kind: F.lit(None).cast(kind)
    cells = shared.filter("k > light").select(
        "lang", tile_of, "source", "block", "blocks", "p0", "term", "p", F.lit(1).cast("bigint").alias("m")
    )
    every = F.when(F.col("tiles") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    marks = groups.withColumn("tile", F.explode(every)).join(held, ["lang", "tile"]).withColumns({"term": none("string"), "p": none("bigint")})
    rare = shared.filter("k <= light")
    histogram = scratch.table(rare.groupBy("lang", "source", "block", "blocks", "p0", "p").agg(F.count(F.lit(1)).alias("m")), "histogram")
    parts = histogram.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / p.cells).alias("parts"))
    base = groups.join(parts, "lang", "left").withColumn("tile", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("parts", F.lit(1)))))
    all_light = F.when(F.col("tile") == 1, F.col("terms") - F.col("heavy")).otherwise(0)
    base = base.withColumns({"tile": -F.col("tile"), "term": none("string"), "p": none("bigint"), "m": all_light})
    histogram = near(histogram, parts).withColumns({"tile": -1 - F.pmod(F.xxhash64("source", "p"), F.col("parts")), "term": none("string")})
    rows = cells.select(*columns)
    for part in (marks, base, histogram):
        rows = rows.unionByName(part.select(*columns))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dense = rows.drop("other", "blocks").groupBy("lang", "tile", "low", "high").applyInPandas(tile_sums, PART)

    posting = F.struct("source", "p", "p0")
    lists = rare.filter("k > 1").groupBy("lang", "term").agg(F.collect_list(posting).alias("postings"))
    sparse = lists.select("lang", "postings").mapInArrow(posting_sums, PART)

    pairs = dense.unionByName(sparse).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    out, _ = materialize(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")
    scratch.drop()
    return out
