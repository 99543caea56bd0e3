"""The record of findings: provenance, identifiers, reviews, and what is new since a review."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arbora.schema import VERDICTS
from arbora.tables import materialize, remove

FINDING_ID = r"^[CX]-F[0-9]{3,}$"


@dataclass(frozen=True)
class Provenance:
    """What an important figure must state."""

    unit: str
    numerator: str
    denominator: str
    filters: str
    missing: str
    duplicates: str
    counting: str  # entities or paths
    weighting: str
    code: str
    robustness: str


@dataclass(frozen=True)
class Finding:
    finding_id: str
    result: str
    statistic: str
    denominator: str
    interest: str
    robustness: str
    mundane: str
    data_quality: str
    falsification: str
    score: int
    version: int = 1
    provenance: Provenance | None = field(default=None)

    def __post_init__(self):
        if not re.match(FINDING_ID, self.finding_id):
            raise ValueError(f"not a finding id: {self.finding_id}")


SCHEMA = (
    "finding_id string, result string, statistic string, denominator string, interest string, robustness string, "
    "mundane string, data_quality string, falsification string, score int, version int, provenance struct<unit:string,"
    "numerator:string,denominator:string,filters:string,missing:string,duplicates:string,counting:string,"
    "weighting:string,code:string,robustness:string>"
)


def record(spark: SparkSession, findings: list[Finding], path: str) -> None:
    """Append findings to the ledger table."""
    spark.createDataFrame([asdict(f) for f in findings], SCHEMA).write.mode("append").parquet(path)


def record_rows(findings: DataFrame, path: str, provenance: Provenance) -> None:
    """Append findings that a query computed, one a row, with the provenance that they share.

    Columns are those of the ledger; ``score`` and ``version`` may be left out. An id that is none raises when the
    table is written, as does one that the batch holds twice, or that stands in the ledger with the same version.
    """
    spark, fields = findings.sparkSession, {k: F.lit(v) for k, v in asdict(provenance).items()}
    rows = findings.withColumn("provenance", F.struct(*(v.alias(k) for k, v in fields.items())))
    for name, value in (("score", 0), ("version", 1)):
        if name not in findings.columns:
            rows = rows.withColumn(name, F.lit(value))
    kinds = StructType.fromDDL(SCHEMA)
    held, at = materialize(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds)), "findings")
    wrong = held.filter(F.col("finding_id").isNull() | ~F.col("finding_id").rlike(FINDING_ID)).limit(1).collect()
    if wrong:
        raise ValueError(f"not a finding id: {wrong[0]['finding_id']}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = held.select("finding_id", "version")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = known.unionByName(spark.read.schema(kinds).parquet(path).select("finding_id", "version"))
    again = known.groupBy("finding_id", "version").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"recorded before: {again[0]['finding_id']}")
    held.write.mode("append").parquet(path)
    remove(spark, at)


def verdict(reproduced: Column, robust: Column, artifact: Column, external: Column) -> Column:
    """One of the six statuses, by a rule of ours; the tests are booleans, null meaning partly."""
    confirmed, partly, fragile, data, lost, needs = VERDICTS
    return (
        F.when(~reproduced, lost)
        .when(artifact, data)
        .when(~robust, fragile)
        .when(external, needs)
        .when(reproduced & robust, confirmed)
        .otherwise(partly)
    )


def since(ledger: DataFrame, last_reviewed: int) -> DataFrame:
    return ledger.filter(F.col("version") > last_reviewed)


def most_valuable(ledger: DataFrame, k: int) -> DataFrame:
    """The k findings of highest score, ties by id."""
    return ledger.orderBy(F.col("score").desc(), "finding_id").limit(k)


#: Words that a statistical result alone does not support.
LOADED = ("fraudulent", "illegal", "corrupt", "tax-evasive", "abusive", "improper")


def loaded_words(text: Column) -> Column:
    """Loaded words that a text uses; empty for neutral wording."""
    return F.filter(F.array(*(F.lit(w) for w in LOADED)), lambda w: F.contains(F.lower(text), w))
