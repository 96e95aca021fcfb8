"""Scans, sources and sinks.

All reads are lazy ``spark.read`` scans, so snapshot and column filters written after them reach
the Parquet reader as ``PushedFilters`` / ``PartitionFilters`` / a pruned ``ReadSchema``.
"""
from __future__ import annotations

import contextlib
import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_COL = "date_retrieved"
VERSION_COL = "version_hash"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store its URI names (local, HDFS, object store)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A1: scan a named table ``root/name[.parquet]``; an explicit schema avoids inference."""
    path = f"{root.rstrip('/')}/{name}"
    if fmt == "parquet" and not _exists(spark, path) and _exists(spark, path + ".parquet"):
        path = path + ".parquet"
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def snapshot(df: DataFrame, date, column: str = SNAPSHOT_COL) -> DataFrame:
    """A2: rows of one retrieval date (partition pruning when the table is partitioned by it)."""
    return df.filter(F.col(column) == F.lit(date).cast("date"))


def snapshot_upto(df: DataFrame, date, column: str = SNAPSHOT_COL) -> DataFrame:
    """A3: all retrievals up to and including a date."""
    return df.filter(F.col(column) <= F.lit(date).cast("date"))


def read_version(spark: SparkSession, path: str, date, version_hash: str) -> DataFrame:
    """A4: one analysis version = (date, definition hash) partition."""
    df = spark.read.parquet(path)
    return df.filter((F.col(SNAPSHOT_COL) == F.lit(date).cast("date")) & (F.col(VERSION_COL) == version_hash))


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a fixed DDL (the declared analysis table)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_version(df: DataFrame, path: str, date, version_hash: str,
                   schema: T.StructType | None = None) -> None:
    """A5: append one analysis version, partitioned by (date, hash) so reads prune to it."""
    out = df.withColumn(SNAPSHOT_COL, F.lit(date).cast("date")).withColumn(VERSION_COL, F.lit(version_hash))
    if schema is not None:
        out = enforce_schema(out, schema)
    out.write.mode("append").partitionBy(SNAPSHOT_COL, VERSION_COL).parquet(path)


@contextlib.contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Materialise an intermediate used more than once, drop it afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na: Sequence[str] = ("", "NA", "NULL"), trim: bool = True) -> DataFrame:
    """Tab-separated text with several NA tokens; values trimmed; typed by ``schema`` (try_cast)."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    cols = []
    types = {}
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        types = {f.name: f.dataType for f in st.fields}
    for c in raw.columns:
        v = F.trim(F.col(c)) if trim else F.col(c)
        v = F.when(v.isin(list(na)) | v.isNull(), F.lit(None)).otherwise(v)
        if c in types:
            v = v.try_cast(types[c])
        cols.append(v.alias(c))
    return raw.select(*cols)


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated output with header; NULL written as 'NA' like the reference's writer."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str) -> DataFrame:
    """Inline constant table (external site counts, configuration grids)."""
    return spark.createDataFrame(list(rows), schema)


def write_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    """A10: export several tables, all columns cast to text, one directory per table."""
    for name, df in tables.items():
        as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        write_tsv(as_text, os.path.join(root, name))


def run_sql(spark: SparkSession, text: str, args: Mapping | None = None) -> DataFrame:
    """Parameterised query with named markers (``:date``) and ``IDENTIFIER(:table)``."""
    return spark.sql(text, args=dict(args or {}))


def register_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Register ``root/<name>.parquet`` tables as temp views; returns the frames."""
    out = {}
    for n in names:
        df = read_table(spark, root, n)
        df.createOrReplaceTempView(n)
        out[n] = df
    return out
