"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, component (its component's smallest node) for each node of edges (a, b: long). Nulls and loops are left out.

    In each round every node hooks onto the neighbour with the least random priority, if that is less than its own,
    and edges and labels move on to what their nodes hook onto. Random priorities keep the chains short, so the
    edges that are left shrink by a constant factor per round. Rounds are cut off by writing to the shared folder;
    sums and minima are taken before each shuffle, and joins may be split by size, so a hub isn't gathered in one task.
    Of the tables in between, which are the job's if it names its scratch, only the last labels stay, as the result reads them.
    """
    scratch = scratch or Scratch(edges.sparkSession, name)
    edges = scratch.written(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node"))
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        least = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y", F.lit(k)).alias("p"), F.col("y").alias("y"))).alias("m"))
        hooks = least.where(F.struct("m.p", "m.y") < F.struct(F.xxhash64("x", F.lit(k)).alias("p"), F.col("x").alias("y"))).select("x", F.col("m.y").alias("to"))
        hooks = scratch.written(hooks, f"{name}-hooks{k}")
        labels = scratch.written(labels.join(hooks, labels["at"] == hooks["x"], "left").select("node", F.coalesce("to", "at").alias("at")), f"{name}-labels{k + 1}")
        ha, hb = hooks.select(F.col("x").alias("xa"), F.col("to").alias("ta")), hooks.select(F.col("x").alias("xb"), F.col("to").alias("tb"))
        moved = edges.join(ha, F.col("a") == F.col("xa"), "left").join(hb, F.col("b") == F.col("xb"), "left")
        moved = moved.select(F.coalesce("ta", "a").alias("u"), F.coalesce("tb", "b").alias("v")).where("u <> v")
        edges = scratch.written(moved.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), f"{name}-edges{k + 1}")
        scratch.drop(f"{name}-hooks{k}", f"{name}-edges{k}", f"{name}-labels{k}")
    else:
        raise RuntimeError("the graph didn't contract")
    if k:
        scratch.drop(f"{name}-edges{k}")
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(least, "at").select("node", "component")
