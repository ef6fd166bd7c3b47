"""Alerts on the latest rows of each key of a stream, told once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import MOJIBAKE_MONITOR, has_mojibake, is_blank_raw


def issue_flags(core: list[str], text_columns: list[str], markers: dict[str, str], log: str | None) -> dict[str, Column]:
    """issue -> whether a row adds to it. markers: name -> pattern in the column `log`."""
    flags = {f"missing_{c}": is_blank_raw(c) for c in core}
    if text_columns:
        flags["mojibake"] = reduce(lambda a, b: a | b, (has_mojibake(c, MOJIBAKE_MONITOR) for c in text_columns))
    return flags | {name: F.coalesce(F.rlike(F.col(log), F.lit(pattern)), F.lit(False)) for name, pattern in markers.items()}


def alert_stream(stream: DataFrame, key: str, time: str, tie: str, good: Column, core: list[str], text_columns: list[str], markers: dict[str, str] | None = None, log: str | None = None, last: int = 50, most_missing: int = 3) -> DataFrame:
    """key, last_time, issues: what is wrong with a key's last good rows, whenever that changes.

    After each micro-batch that brings rows of a key its last `last` good rows (by time, then tie) are looked at: a core column that is
    missing `most_missing` times or more, one row of broken characters or one marker in the log are issues. An alert with the same
    last time and issues as the key's alert before is not repeated. State per key: time, tie and flags of those rows, and the last alert;
    late rows take their place among them. Rows without time are left out.
    """
    import numpy as np
    import pandas as pd

    flags = issue_flags(core, text_columns, markers or {}, log)
    names, least = list(flags), [most_missing] * len(core) + [1] * (len(flags) - len(core))
    bits = reduce(lambda a, b: a + b, (F.when(f, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(flags.values())), F.lit(0).cast("long"))
    rows = stream.where(F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(tie).cast("long").alias("_tie"), bits.alias("_bits"), F.coalesce(good, F.lit(False)).alias("_good"))
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [np.array(x, np.int64) for x in (state.get[:3] if state.exists else ([], [], []))]
        told = state.get[3] if state.exists else ""
        for f in frames:
            f = f[f["_good"]]
            held = [np.concatenate([h, f[c].to_numpy(np.int64)]) for h, c in zip(held, ("_t", "_tie", "_bits"))]
            order = np.lexsort((held[1], held[0]))[-last:]
            held = [h[order] for h in held]
        t, _, b = held
        issues = ";".join(n for i, (n, m) in enumerate(zip(names, least)) if int((b >> i & 1).sum()) >= m)
        out = []
        if issues and (now := f"{t[-1]}|{issues}") != told:
            out, told = [(k[0], int(t[-1]), issues)], now
        state.update((*(h.tolist() for h in held), told))
        yield pd.DataFrame(out, columns=[key, "last", "issues"])

    out = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last bigint, issues string", "t array<bigint>, tie array<bigint>, bits array<bigint>, told string", "append", "NoTimeout")
    return out.select(key, F.timestamp_micros("last").alias("last_time"), "issues")
