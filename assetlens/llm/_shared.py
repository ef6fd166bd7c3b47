"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the blank and tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most ids that are sent to every executor; beyond it both sides are dealt out by id.
BROADCAST_IDS = 1_000_000


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in ids (one column, distinct, written). Broadcast if there are at most `most` ids, else a shuffle join."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")
