"""Reading and writing tables: contracts at the border, everything else is Spark's own readers and writers."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.functions.catalog import require_columns
from assetlens.functions.text import normalize_id

_log = logging.getLogger(__name__)
CATALOG_COLUMNS = ("row_no", "department", "asset_id", "name", "domain", "open_condition", "view_count", "download_count", "api_call_count", "description", "resource_type", "status", "update_frequency", "open_attribute", "first_publish_date", "last_update_date")


def read_text_table(spark: SparkSession, path: str, key: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV with a header, every column a string; a byte order mark before the first name is dropped; the key is normalised.

    Cells may hold line breaks, which makes a file one task. Where none do, multi_line=False lets Spark split large files.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.withColumn(key, normalize_id(key)) if key else df


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """A CSV with a header and a schema; multi_line as in read_text_table()."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=multi_line, escape='"')


def as_catalog(df: DataFrame, key: str = "asset_id", columns=CATALOG_COLUMNS) -> DataFrame:
    """Fails if a column of the contract is missing."""
    return require_columns(df, columns).withColumn(key, normalize_id(key))


def read_catalog(spark: SparkSession, path: str, key: str = "asset_id", columns=CATALOG_COLUMNS) -> DataFrame:
    return as_catalog(read_text_table(spark, path), key, columns)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """The table at path, or an empty one where there is none; ids are normalised."""
    df = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return df.withColumn(key, normalize_id(key))


def find_table(spark: SparkSession, folder: str, required, preferred: str = "*.parquet", fallback: str = "*") -> DataFrame | None:
    """The first table (by name, preferred pattern first) whose columns include the required ones; unreadable files are passed over."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen: list[str] = []
    for pattern in (preferred, fallback):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            path = status.getPath().toString()
            if path in seen:
                continue
            seen.append(path)
            try:
                df = spark.read.parquet(path) if ".csv" not in path else read_text_table(spark, path)
            except Exception as unreadable:  # noqa: BLE001  whatever a reader says about a foreign file, it isn't the table
                _log.info("passed over %s: %s", path, type(unreadable).__name__)
                continue
            if set(required) <= set(df.columns):
                return df
    return None


def save_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path) if fmt == "csv" else w.json(path)
    return path


def append_table(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("append").parquet(path)
    return path


def export_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    return [save_table(df, folder, name, fmt) for name, df in tables.items()]


def save_manifest(spark: SparkSession, folder: str, name: str, values: dict) -> str:
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return save_table(one, folder, name, "json")


def ranked_lists(ranked: DataFrame, rank: str, sizes: tuple[int, ...] = (100, 300)) -> dict[str, DataFrame]:
    return {"all": ranked} | {f"top_{k}": ranked.where(F.col(rank) <= k) for k in sizes}


def split_rejects(df: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def field_dictionary(spark: SparkSession, fields: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(fields.items()), "name string, definition string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def latest_progress(lines: DataFrame, marker: str) -> DataFrame:
    """Of a log (seq, line): the last line with the marker, and whether there is one."""
    hit = F.when(F.contains("line", F.lit(marker)), F.col("seq"))
    return lines.agg(F.max_by("line", hit).alias("line"), F.coalesce(F.max(hit.isNotNull()), F.lit(False)).alias("found"))
