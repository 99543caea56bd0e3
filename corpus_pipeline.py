"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece.

Every stage takes the documents that its predecessor kept and returns the columns of ``documents``; the last returns
token ids. Stages meet through Parquet tables in the shared folder.

All stages: an empty table gives an empty table; extra columns pass, whatever their names (the last stage does not read
them). How a stage treats null ids, null and empty texts and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import fresh, materialize, remove
from arbora.llm.decontaminate import without_leaks
from arbora.llm.jaccard_join import jaccard_classes
from arbora.llm.line_dedup import dedup_documents
from arbora.llm.quality_rules import kept_documents
from arbora.llm.sentencepiece_codec import encode_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them. Each row is judged alone, whatever its id."""
    return kept_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no line is left; ``n_chars`` follows the text.

    A line stays where it stands first, by id, null ids last; rows that repeat id and text share one verdict; texts
    without lines, null ones too, stay.
    """
    lines, removed = fresh("_n_lines", docs), fresh("_n_removed", docs)
    done = dedup_documents(docs, n_lines=lines, n_removed=removed).filter(f"`{lines}` = 0 OR `{removed}` < `{lines}`")
    return done.select(
        *(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns)
    )


def half_key(seed: int, *columns: str) -> Column:
    """64 bits of a row's key; a null is not taken for an absent value."""
    return F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns, *(F.col(c).isNull() for c in columns))), 16, "0")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id stays, rows without id last.

    Rows are compared by id and text, so rows that share an id but are no near copies all stay; of rows that repeat
    both, one stays. A row's key has 128 bits, so that two different rows have one key by chance once in some 10^16
    corpora of 10^11 rows. Texts without words, null ones too, are linked with nothing and stay.
    """
    key, rank = fresh("_key", docs), fresh("_rank", docs)
    keyed = docs.withColumn(key, F.concat(half_key(1, "doc_id", "text"), half_key(2, "doc_id", "text")))
    found = jaccard_classes(keyed, id_col=key, id_type="string").select(F.col("doc_id").alias(key), "n_shingles", "component_id").distinct()
    found, _ = materialize(found, "found")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("key"))
    heads = (
        found.filter("n_shingles > 0").join(keyed.select(key, "doc_id").distinct(), key)
        .groupBy("component_id").agg(F.min(order).alias("one")).select(F.col("one.key").alias(key))
    )
    # Repeats of a row are cut to one per task before they meet.
    repeats = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    first = keyed.join(heads, key, "left_semi").withColumn(rank, F.row_number().over(repeats)).filter(F.col(rank) == 1)
    blank = keyed.join(found.filter("n_shingles = 0").select(key), key, "left_semi")
    return first.select(*docs.columns).union(blank.select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. Rows that repeat id and text go together."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row; null and empty texts have no ids and decode to an empty text."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: Near copies, edit windows and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, made_at = materialize(stage(spark, docs, sf_dir), name)
        if path is not None:
            remove(spark, path)  # no later stage reads it
        path = made_at
    return STAGES[-1][1](spark, docs, sf_dir)
