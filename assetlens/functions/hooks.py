"""The library's and users' functions under names that SQL can call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.functions import text


def register(spark: SparkSession, name: str, column_fn: Callable[..., Column], **parameters: str) -> None:
    """Makes column_fn a temporary SQL function; parameters: argument name -> SQL type, in order.

    The function's expression becomes the body of a SQL function, so a call is planned like the expression itself: no Python runs per row.
    A ValueError tells of a function whose expression has no SQL form (lambdas over arrays, Python UDFs).
    """
    if not name.isidentifier() or not all(p.isidentifier() for p in parameters):
        raise ValueError(f"not a name: {name}, {list(parameters)}")
    row = spark.createDataFrame([], T.StructType([T.StructField(p, T._parse_datatype_string(t)) for p, t in parameters.items()]))
    df = row.select(column_fn(*[F.col(p) for p in parameters]).alias("out"))
    body = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
    takes = ", ".join(f"{p} {t}" for p, t in parameters.items())
    try:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {df.schema['out'].dataType.simpleString()} RETURN {body}")
    except Exception as e:
        raise ValueError(f"{name} has no SQL form: {body[:200]}") from e


def register_terms(spark: SparkSession, name: str = "terms") -> None:
    """name(text): a table function with one row (position, term) per term of a text, as text.split_terms() splits it."""
    term = r"regexp_replace(part, r'(?U)^\s+|\s+$', '')"
    parts = f"SELECT posexplode(split(coalesce(text, ''), {_quoted(text.TERM_DELIMITERS)})) AS (position, part)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(position INT, term STRING) RETURN SELECT position, {term} FROM ({parts}) WHERE {term} <> ''")


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return f'r"{pattern}"' if "'" in pattern else f"r'{pattern}'"
