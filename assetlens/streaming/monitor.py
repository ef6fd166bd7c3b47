"""Monitoring of a growing collection: Structured Streaming forms, and the batch forms that they equal."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.functions.text import MOJIBAKE_MONITOR, has_mojibake, is_blank_raw, to_number
from assetlens.operators.rank import batches, latest


def growing_table(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def qa_aggregates(core: list[str], time: str, text_columns: list[str], field_count: str | None = None) -> dict[str, Column]:
    """rows, seconds per row, missing values, mojibake rows, complete rows and their rate."""
    missing = {c: is_blank_raw(c) for c in core}
    complete, broken = F.lit(True), F.lit(False)
    for m in missing.values():
        complete = complete & ~m
    for c in text_columns:
        broken = broken | has_mojibake(c, MOJIBAKE_MONITOR)
    n = F.count(F.lit(1))
    elapsed = F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time))
    out = {"rows": n, "elapsed_seconds": elapsed, "seconds_per_row": F.round(elapsed / F.nullif(n - 1, F.lit(0)), 4)}
    out |= {f"missing_{c}": F.sum(m.cast("int")) for c, m in missing.items()}
    if field_count:
        out["zero_fields"] = F.sum((F.coalesce(to_number(field_count), F.lit(0.0)) == 0).cast("int"))
    out |= {"mojibake_rows": F.sum(broken.cast("int")), "complete_rows": F.sum(complete.cast("int")), "complete_rate": F.round(F.coalesce(F.avg(complete.cast("double")), F.lit(0.0)), 4)}
    return out


def qa_by_count(df: DataFrame, order: str, size: int, aggregates: dict[str, Column]) -> DataFrame:
    """A report for every `size` rows in the order of a column with distinct values; the last one may be short."""
    return batches(df, order, size).groupBy("batch").agg(*[a.alias(k) for k, a in aggregates.items()])


def _watermarked(df: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which Spark wants on a timestamp with time zone; a batch as it is."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if df.isStreaming else df


def qa_by_time(df: DataFrame, time: str, width: str, aggregates: dict[str, Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows; on a stream rows later than the watermark are dropped, in a batch there are none."""
    d = _watermarked(df, time, late)
    g = d.groupBy(F.window(time, width, slide) if slide else F.window(time, width)).agg(*[a.alias(k) for k, a in aggregates.items()])
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *aggregates)


def qa_by_session(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    d = _watermarked(df, time, late)
    g = d.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(*[a.alias(k) for k, a in aggregates.items()])
    return g.select(*keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *aggregates)


def recent_alert(df: DataFrame, time: str, tie: str, core: list[str], text_columns: list[str], last: int = 50, most_missing: int = 3) -> DataFrame:
    """One row: what is wrong with the last rows, if anything (issues is empty then)."""
    d = latest(df, time, last, tie)
    agg = [F.sum(is_blank_raw(c).cast("int")).alias(f"m_{c}") for c in core]
    broken = F.lit(False)
    for c in text_columns:
        broken = broken | has_mojibake(c, MOJIBAKE_MONITOR)
    one = d.agg(F.count(F.lit(1)).alias("rows"), F.max(time).alias("last_time"), F.coalesce(F.sum(broken.cast("int")), F.lit(0)).alias("mojibake"), *agg)
    issues = F.array_compact(F.array(*[F.when(F.col(f"m_{c}") >= most_missing, f"missing_{c}") for c in core], F.when(F.col("mojibake") > 0, "mojibake")))
    return one.select("rows", "last_time", F.array_join(issues, ";").alias("issues"))


def count_windows(stream: DataFrame, key: str, size: int, good: str) -> DataFrame:
    """A report (key, window, rows, good_rows) whenever a key has `size` more rows. State: a counter and a sum per key."""
    import pandas as pd

    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, n, ok = state.get if state.exists else (0, 0, 0)
        out = []
        for f in frames:
            total = ok + f[good].fillna(0).astype("int64").cumsum().to_numpy()  # good rows since the open window began, by row
            ends = range(size - n - 1, len(total), size)  # rows that fill a window
            before = 0
            for e in ends:
                out.append((k[0], window, size, int(total[e]) - before))
                window, before = window + 1, int(total[e])
            n = (n + len(total)) % size
            ok = int(total[-1]) - before if len(total) else ok
        state.update((window, n, ok))
        yield pd.DataFrame(out, columns=[key, "window", "rows", "good_rows"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, window bigint, rows bigint, good_rows bigint", "window bigint, n bigint, ok bigint", "append", "NoTimeout")


def sample_missing(df: DataFrame, core: list[str], order: str, n: int = 20) -> DataFrame:
    cond = F.lit(False)
    for c in core:
        cond = cond | is_blank_raw(c)
    return df.where(cond).orderBy(order).limit(n)
