"""Sources and sinks (S1-S11): CSV with multi-line cells, headerless CSV,
JSON records / JSON Lines (gz), tagged multi-file loads, Python-literal list
columns, a named catalog of problem sets, and CSV/JSON sinks."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_qa_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with quoted multi-line cells; ``sep='|'`` for model output."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def read_headerless_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """No header; names and types by position from the schema."""
    return spark.read.option("header", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def read_records_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """S3: a JSON array of (possibly nested) records."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines, plain or gzip (gzip files are read whole, one task each)."""
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_many(spark: SparkSession, paths: Mapping[str, str], reader, name: str = "dataset") -> DataFrame:
    """Read several files into one DataFrame tagged with a dataset column;
    missing files are reported and skipped."""
    parts = []
    for ds, p in paths.items():
        if not exists(spark, p):
            print(f"skipping missing input {p}")
            continue
        parts.append(reader(spark, p).withColumn(name, F.lit(ds)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def parse_list_literal(col, element: str = "boolean") -> Column:
    """Python-literal list text -> array. Booleans and numbers: rewrite
    True/False/None as JSON and parse natively."""
    c = F.col(col) if isinstance(col, str) else col
    js = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bTrue\b", "true"), r"\bFalse\b", "false"),
                          r"\bNone\b", "null")
    return F.from_json(js, T.ArrayType(T.BooleanType() if element == "boolean" else T.DoubleType()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_string_list(s: pd.Series) -> pd.Series:
    """List of strings in Python-literal form, parsed with
    ``ast.literal_eval`` (never ``eval``); unparsable -> NULL."""
    def one(x):
        if x is None:
            return None
        try:
            v = ast.literal_eval(x)
            return [None if e is None else str(e) for e in v] if isinstance(v, (list, tuple)) else None
        except (ValueError, SyntaxError):
            return None
    return s.map(one)


class ProblemCatalog:
    """Named problem sets over Parquet folders; unknown name is an error."""

    def __init__(self, spark: SparkSession, locations: Mapping[str, str]):
        self.spark, self.locations = spark, dict(locations)

    def load(self, name: str, split: str | None = None) -> DataFrame:
        if name not in self.locations:
            raise ValueError(f"unknown problem set {name!r}; known: {sorted(self.locations)}")
        path = self.locations[name] + (f"/{split}" if split else "")
        return self.spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV sink; arrays/structs/maps are written as JSON text."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    """JSON Lines sink, optionally gzip."""
    w = df.write.mode(mode)
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key (compared as text) is not yet in the results."""
    d = done.select(F.col(key).cast("string").alias("_k"))
    return todo.join(d, F.col(key).cast("string") == F.col("_k"), "left_anti")
