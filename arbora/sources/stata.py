"""Stata files: schema from the file's metadata, rows in chunks. Missing numbers and empty strings become null.

A file is read from its start, so one file is one task. :func:`stata_rows` reads any number of files that Spark's own
reader has opened, wherever they lie, or files that a table holds; the data source reads one file of a mounted folder.
"""

from __future__ import annotations

import datetime as dt
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 20_000


def _type(dtype) -> T.DataType:
    kind = np.dtype(dtype)
    if kind == np.int8:
        return T.ByteType()
    if kind == np.int16:
        return T.ShortType()
    if kind == np.int32:
        return T.IntegerType()
    if kind == np.int64:
        return T.LongType()
    if kind == np.float32:
        return T.FloatType()
    if kind.kind == "f":
        return T.DoubleType()
    if kind.kind == "M":
        return T.DateType()
    return T.StringType()


def cell(value, kind: T.DataType):
    """A value of a chunk as Spark has it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value == "":
        return None
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, dt.datetime) else value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.StringType):
        return str(value)
    return int(value)


def _open(path):
    # convert_missing stays off; integers with missing values then arrive as floats, chunk by chunk
    return pd.read_stata(path, chunksize=CHUNK, convert_categoricals=False, convert_dates=True)


class StataDataSource(DataSource):
    """``spark.read.format("stata").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as reader:
            first = next(iter(reader), None)
        return T.StructType([T.StructField(c, _type(first[c].dtype)) for c in first.columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _StataReader(self.options["path"], schema)


class _StataReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.fields = path, [(f.name, f.dataType) for f in schema.fields]

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with _open(self.path) as reader:
            for chunk in reader:
                columns = [chunk[n].tolist() for n, _ in self.fields]
                for row in zip(*columns):
                    yield tuple(cell(v, k) for v, (_, k) in zip(row, self.fields))


def read_stata(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    spark.dataSource.register(StataDataSource)
    reader = spark.read.format("stata")
    return (reader.schema(schema) if schema else reader).load(path)


def stata_rows(files: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all files of a table with their bytes in ``content``, as ``spark.read.format("binaryFile")`` gives it.

    Files are read by the executors, each in chunks; all must have the columns of the schema, which is that of one file
    if it is not given. A table without files needs a schema.
    """
    if schema is None:

        def look(frames):
            for frame in frames:
                for content in frame.content:
                    with _open(io.BytesIO(content)) as reader:
                        first = next(iter(reader))
                    kinds = T.StructType([T.StructField(c, _type(first[c].dtype)) for c in first.columns])
                    yield pd.DataFrame({"kinds": [kinds.json()]})

        found = files.select("content").limit(1).mapInPandas(look, "kinds string").first()
        if found is None:
            raise ValueError("no file to take the schema from")
        schema = T.StructType.fromJson(json.loads(found["kinds"]))
    fields = [(f.name, f.dataType) for f in schema.fields]

    def rows(frames):
        for frame in frames:
            for content in frame.content:
                with _open(io.BytesIO(content)) as reader:
                    for chunk in reader:
                        yield pd.DataFrame({n: pd.Series([cell(v, kind) for v in chunk[n].tolist()], dtype=object) for n, kind in fields})

    return files.select("content").mapInPandas(rows, schema)


def stata_files(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``n_rows, content``: the rows as Stata files of at most so many rows, made by the tasks that hold them.

    Strings, dates and numbers only; nulls become the format's missing values, and integers with nulls doubles.
    """
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def write(frames):
        for frame in frames:
            for at in range(0, len(frame), most):
                part = frame.iloc[at : at + most].copy()
                for c in texts:
                    part[c] = part[c].fillna("")
                for c in dates:
                    part[c] = pd.to_datetime(part[c])
                out = io.BytesIO()
                part.to_stata(out, write_index=False, convert_dates={c: "td" for c in dates}, version=118)
                yield pd.DataFrame({"n_rows": [len(part)], "content": [out.getvalue()]})

    return df.mapInPandas(write, "n_rows bigint, content binary")
