"""CSV scans with the fixed schema, silver cleaning, and a sink that refuses to touch its inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions import blank_to_null, list_items
from arbora.schema import PANEL, check_schema
from arbora.sources.stata import read_stata
from arbora.tables import materialize, remove


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """The panel's CSV mirror. The header must name the documented columns; malformed rows fail the job."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    check_schema(header)
    ordered = T.StructType([PANEL[c] for c in header])
    read = spark.read.schema(ordered).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return blanks_to_null(read.csv(path)).select(*PANEL.names)


def read_mapping(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A mapping file, CSV or Stata by its name: the named columns as strings, blanks as null."""
    if not path.rstrip("/").endswith(".dta"):
        return read_mapping_csv(spark, path, columns)
    return blanks_to_null(read_stata(spark, path).select(*(F.col(c).cast("string").alias(c) for c in columns)))


def read_mapping_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A mapping file: the named columns as strings, blanks as null."""
    return blanks_to_null(spark.read.option("header", True).csv(path).select(*columns))


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Empty or blank strings become null: the file format has no null string."""
    kinds = dict(df.dtypes)
    return df.select(*(blank_to_null(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns))


def split_lists(df: DataFrame, *columns: str, sep: str = ";") -> DataFrame:
    """Beside each semicolon list a column ``<name>_list`` with trimmed, non-empty items; the raw column stays."""
    return df.withColumns({f"{c}_list": list_items(F.col(c), sep) for c in columns})


def whole_path(spark: SparkSession, path: str) -> str:
    """The path with its scheme, links of local paths followed."""
    jvm = spark._jvm
    raw = jvm.org.apache.hadoop.fs.Path(path)
    full = raw.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(raw).toString()
    scheme, _, rest = full.partition(":")
    return "file:" + os.path.realpath("/" + rest.lstrip("/")) if scheme == "file" else full


def write_result(df: DataFrame, path: str, inputs: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a result as Parquet, never at, above or below an input path, however either is written."""
    norm = lambda p: whole_path(df.sparkSession, p).rstrip("/") + "/"
    for i in inputs:
        if norm(path).startswith(norm(i)) or norm(i).startswith(norm(path)):
            raise ValueError(f"{path} would overwrite the input {i}")
    df.write.mode(mode).parquet(path)


def table_digest(df: DataFrame) -> DataFrame:
    """One row that tells whether two tables hold the same rows, in whatever order and files: ``columns, n_rows, one, two``.

    Rows are hashed twice and the hashes added up, so repeated rows count, and tasks add their parts. Columns of maps
    cannot be hashed.
    """
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *df.columns, *(F.col(c).isNull() for c in df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.lit(df.schema.simpleString()).alias("columns"), F.count(F.lit(1)).alias("n_rows"), total(1).alias("one"), total(2).alias("two"))


def write_if_changed(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> bool:
    """:func:`write_result`, but only if the rows differ from those last written there; tells whether it wrote.

    The digest lies beside the table, ``<path>.digest``. It goes before the table is replaced and comes after, so a run
    that was cut off leaves none, and the next one writes.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.digest"
    held, at = materialize(df, "result")
    new = table_digest(held)
    target = spark._jvm.org.apache.hadoop.fs.Path(beside)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        if new.exceptAll(spark.read.parquet(beside)).isEmpty():
            remove(spark, at)
            return False
        remove(spark, beside)
    write_result(held, path, inputs, mode="overwrite")
    write_result(new, beside, inputs)
    remove(spark, at)
    return True
