"""A data dictionary in plain text: names at the line's start, descriptions indented below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A name alone on its line, then lines that begin with blanks, up to a line that does not.
ENTRY = r"(?m)^([a-z][a-z_0-9]+)[ \t]*\n((?:[ \t]+\S[^\n]*(?:\n|\z))+)"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``variable, description`` for every entry of the text, descriptions in one line."""
    text = spark.read.text(path, wholetext=True)
    entry = F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(ENTRY), 1).alias("variable"), F.regexp_extract_all("value", F.lit(ENTRY), 2).alias("description")))
    found = text.select(entry.alias("entry"))
    return found.select(F.col("entry.variable").alias("variable"), F.trim(F.regexp_replace("entry.description", r"\s+", " ")).alias("description"))


def commented(schema: T.StructType, dictionary: DataFrame) -> T.StructType:
    """The schema with each column's description as its comment; as many rows are read as the schema has columns."""
    known = {r.variable: r.description for r in dictionary.filter(F.col("variable").isin(schema.names)).collect()}
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **({"comment": known[f.name]} if f.name in known else {})}) for f in schema])
