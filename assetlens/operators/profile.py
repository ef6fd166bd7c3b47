"""Profiles: counts, shares, crosstabs, grouped summaries, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.functions.text import normalized_text, split_terms, to_number
from assetlens.operators.rank import quantile_table

MISSING = "缺失"


def value_counts(df: DataFrame, column: str, top: int | None = None, missing: str = MISSING, of_counts: bool = False) -> DataFrame:
    """value, count, share by count descending, then value. Share of all rows, or of the counts shown."""
    v = F.coalesce(F.nullif(normalized_text(column), F.lit("")), F.lit(missing))
    g = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_n"))
    if top:
        g = g.orderBy(F.desc("count"), "value").limit(top)
        total = g.agg(F.sum("count").alias("_n")) if of_counts else total
    return g.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("_n")).alias("share"))


def named_counts(df: DataFrame, predicates: dict[str, Column], share_of: str | None = None) -> DataFrame:
    """name, count and share for any number of predicates in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(F.coalesce(p, F.lit(False)).cast("int")), F.lit(0)).alias(k) for k, p in predicates.items()])
    base = F.col(share_of) if share_of else F.col("_n")
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("count"), (F.col(k) / F.nullif(base, F.lit(0))).alias("share")) for k in predicates])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def flag_prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    return named_counts(df, {c: to_number(c) > 0 for c in flags})


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return d.groupBy(a).pivot(b, values).count().na.fill(0)


def row_percent(table: DataFrame, key: str) -> DataFrame:
    cols = [c for c in table.columns if c != key]
    total = sum((F.col(c) for c in cols), F.lit(0))
    return table.select(key, *[(F.col(c) / F.nullif(total, F.lit(0))).alias(c) for c in cols])


def cooccurrence(df: DataFrame, flags: list[str]) -> DataFrame:
    """a, b, n: rows with both flags, for all pairs, in one aggregation."""
    x = [(F.coalesce(to_number(c), F.lit(0.0)) > 0).cast("int") for c in flags]
    k = [(i, j) for i in range(len(flags)) for j in range(len(flags))]
    one = df.agg(*[F.coalesce(F.sum(x[i] * x[j]), F.lit(0)).alias(f"c{i}_{j}") for i, j in k])
    return one.select(F.explode(F.array(*[F.struct(F.lit(flags[i]).alias("a"), F.lit(flags[j]).alias("b"), F.col(f"c{i}_{j}").alias("n")) for i, j in k])).alias("c")).select("c.*")


def pareto(df: DataFrame, column: str, top: int = 50) -> DataFrame:
    """Largest groups with running counts and shares of all rows."""
    g = value_counts(df, column)
    w = W.orderBy(F.desc("count"), "value").rowsBetween(W.unboundedPreceding, 0)
    g = g.orderBy(F.desc("count"), "value").limit(top)
    return g.withColumns({"cumulative_count": F.sum("count").over(w), "cumulative_share": F.sum("share").over(w)})


def summary(df: DataFrame, metrics: list[str], by: tuple[str, ...] = (), stats: tuple[str, ...] = ("count", "mean", "median")) -> DataFrame:
    """Long form (by, metric, statistics): metrics are unpivoted, so one aggregation serves them all. pNN are exact quantiles, from ranked values."""
    v = F.col("value")
    forms = {
        "count": F.count(v), "zero_count": F.coalesce(F.sum((v == 0).cast("int")), F.lit(0)), "mean": F.avg(v), "min": F.min(v), "max": F.max(v),
        "std_pop": F.stddev_pop(v), "std_samp": F.stddev_samp(v),
    }
    shares = {s: 0.5 if s == "median" else int(s[1:]) / 100 for s in stats if s not in forms}
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), to_number(m).alias("value")) for m in metrics]))
    g = df.select(*by, cells.alias("c")).select(*by, "c.metric", "c.value").groupBy(*by, "metric").agg(*[forms[s].alias(s) for s in stats if s in forms])
    if shares:
        keys = [f"k{i}" for i in range(len(by))]
        q = quantile_table(df, metrics, list(shares.values()), by).withColumnRenamed("metric", "_m").drop("n")
        same = F.col("metric") == F.col("_m")
        for c, k in zip(by, keys):
            same = same & F.col(c).eqNullSafe(F.col(k))
        g = g.join(q, same, "left").withColumns({s: F.get("q", F.lit(i)) for i, s in enumerate(shares)})
    return g.select(*by, "metric", *stats)


def stacked_profile(df: DataFrame, groups: list[str], aggregates: dict[str, Column], keep_null: bool = False) -> DataFrame:
    """group_col, group_value and aggregates for several group columns at once; null groups are dropped or kept as missing."""
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("group_col"), F.col(g).cast("string").alias("group_value")) for g in groups]))
    d = df.withColumn("_g", cells).select("*", "_g.group_col", "_g.group_value").drop("_g")
    d = d.fillna(MISSING, ["group_value"]) if keep_null else d.where("group_value is not null")
    return d.groupBy("group_col", "group_value").agg(*[a.alias(k) for k, a in aggregates.items()])


def with_all_groups(table: DataFrame, key: str, order: list[str], fill: int = 0) -> DataFrame:
    """Groups in a fixed order, absent ones with zeros."""
    names = table.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in order])).alias("position", key))
    counts = [c for c in table.columns if c != key]
    return F.broadcast(names).join(table, key, "left").select("position", key, *[F.coalesce(c, F.lit(fill)).alias(c) if dict(table.dtypes)[c] in ("bigint", "int") else F.col(c) for c in counts])


def quadrant_summary(df: DataFrame, column: str, order: list[str], means: list[str]) -> DataFrame:
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    return with_all_groups(g, column, order)


def binned_counts(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Right-closed bins (e0, e1], ..., the last one open above; empty bins stay; share of all rows."""
    v = to_number(column)
    last = len(edges) - 1
    names = [f"({edges[i]:g},{edges[i + 1]:g}]" if i < last else f"({edges[i]:g},inf)" for i in range(len(edges))]
    preds = {n: (v > edges[i]) & ((v <= edges[i + 1]) if i < last else F.lit(True)) for i, n in enumerate(names)}
    return named_counts(df, preds)


def mapped_counts(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Counts of a column's values under their names; values without a name count as missing."""
    v = normalized_text(column)
    named = F.coalesce(*[F.when(v == k, F.lit(n)) for k, n in names.items()], F.lit(MISSING))
    return value_counts(df.select(named.alias("v")), "v")


def high_low_counts(df: DataFrame, metrics: list[str], cut: float = 0.5) -> DataFrame:
    """metric, high_use_count, low_use_count and high_use_share; nulls count as low."""
    high = {m: F.coalesce(to_number(m) >= cut, F.lit(False)).cast("int") for m in metrics}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"h{i}") for i, h in enumerate(high.values())])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"h{i}").alias("high_use_count")) for i, m in enumerate(metrics)])
    x = one.select("n", F.explode(cells).alias("c")).select("n", "c.*")
    return x.select("metric", "high_use_count", (F.col("n") - F.col("high_use_count")).alias("low_use_count"), (F.col("high_use_count") / F.nullif(F.col("n"), F.lit(0))).alias("high_use_share"))


def candidate_groups(df: DataFrame, groups: list[str], candidate: str, means: list[str], top: int | None = None) -> DataFrame:
    """Per group value: rows, candidates, their rate and means; null groups stay as missing; the top groups by candidates of each column."""
    c = F.coalesce(to_number(candidate), F.lit(0.0)).cast("int")
    g = stacked_profile(df, groups, {"total": F.count(F.lit(1)), "candidates": F.sum(c), "candidate_rate": F.avg(c), **{f"mean_{m}": F.avg(m) for m in means}}, keep_null=True)
    if top is None:
        return g
    order = W.partitionBy("group_col").orderBy(F.desc("candidates"), "group_value")
    return g.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k")


def flat_summary(df: DataFrame, by: list[str], metrics: list[str], stats: dict) -> DataFrame:
    """One row per key with a column <metric>_<statistic> for each pair. stats: name -> aggregate function."""
    return df.groupBy(*by).agg(*[f(m).alias(f"{m}_{name}") for m in metrics for name, f in stats.items()])


#: Statistics of perturbation runs and of folds, which are few per key.
PERTURBATION = {"mean": F.avg, "min": F.min, "median": lambda c: F.percentile(c, 0.5), "max": F.max}
FOLDS = {"mean": F.avg, "std": F.stddev_samp}


def perturbation_summary(runs: DataFrame, amplitude: str = "amplitude", metrics=("spearman", "top_10_overlap", "top_30_overlap")) -> DataFrame:
    return flat_summary(runs, [amplitude], list(metrics), PERTURBATION)


def fold_summary(per_fold: DataFrame, model: str = "model", metrics=("r2", "rmse", "mae", "spearman")) -> DataFrame:
    """Mean and sample standard deviation over folds."""
    return flat_summary(per_fold, [model], list(metrics), FOLDS)


def group_attribution(attributions: DataFrame, groups: DataFrame, key: str, group: str, top: int = 15) -> DataFrame:
    """Per group value the features of the largest mean absolute attribution. attributions: key, feature, attribution; groups: key, group."""
    j = attributions.join(groups.select(key, F.coalesce(F.col(group).cast("string"), F.lit(MISSING)).alias("group_value")), key)
    g = j.groupBy("group_value", "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.countDistinct(key).alias("n"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy("group_value").orderBy(F.desc("mean_abs"), "feature")))
    return g.where(F.col("rank") <= top).select(F.lit(group).alias("group_col"), "group_value", "rank", "feature", "mean_abs", "n")


def term_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each term of a multi-valued column occurs."""
    return df.select(F.explode(split_terms(column)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def missing_report(df: DataFrame, core: list[str], success: Column) -> DataFrame:
    from assetlens.functions.text import is_blank

    one = df.agg(*[x for c in core for x in (F.sum(is_blank(c).cast("int")).alias(f"a_{c}"), F.sum((is_blank(c) & success).cast("int")).alias(f"s_{c}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("missing"), F.col(f"s_{c}").alias("missing_in_success")) for c in core])).alias("c")).select("c.*")


def layer_summary(df: DataFrame, layers: list[str], aggregates: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over the rows of each layer (a 0/1 column); empty layers stay when there is no further key."""
    cells = F.explode(F.filter(F.array(*[F.when(to_number(x) == 1, F.lit(x)) for x in layers]), lambda x: x.isNotNull()))
    g = df.withColumn("layer", cells).groupBy("layer", *by).agg(*[a.alias(k) for k, a in aggregates.items()])
    return g if by else with_all_groups(g, "layer", layers)


def layer_profile(df: DataFrame, layers: list[str], metrics: list[str], stats: tuple[str, ...]) -> DataFrame:
    """Statistics of metrics over the rows of each layer, in long form (see summary)."""
    cells = F.explode(F.filter(F.array(*[F.when(to_number(x) == 1, F.lit(x)) for x in layers]), lambda x: x.isNotNull()))
    return summary(df.withColumn("layer", cells), metrics, ("layer",), stats)


def layer_group_profile(df: DataFrame, layers: list[str], groups: list[str], top: int | None = None) -> DataFrame:
    """Counts and shares within each layer of each group column's values."""
    cells = F.explode(F.filter(F.array(*[F.when(to_number(x) == 1, F.lit(x)) for x in layers]), lambda x: x.isNotNull()))
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("group_col"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("group_value")) for c in groups]))
    d = df.withColumn("layer", cells).select("layer", pair.alias("_p"))
    g = d.groupBy("layer", F.col("_p.group_col").alias("group_col"), F.col("_p.group_value").alias("group_value")).agg(F.count(F.lit(1)).alias("count"))
    g = g.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy("layer", "group_col")))
    if top:
        g = g.withColumn("_k", F.row_number().over(W.partitionBy("layer", "group_col").orderBy(F.desc("count"), "group_value"))).where(F.col("_k") <= top).drop("_k")
    return g


def compare_counts(full: DataFrame, main: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values in two tables, and the difference of the shares."""
    a, b = (value_counts(x, column).select("value", F.col("count").alias(f"{n}_count"), F.col("share").alias(f"{n}_share")) for x, n in ((full, "full"), (main, "main")))
    j = a.join(b, "value", "full_outer").na.fill(0)
    return j.withColumn("share_difference", F.col("main_share") - F.col("full_share"))


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def long_to_wide(df: DataFrame, key: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def symmetric_matrix(long: DataFrame, names: list[str], a: str = "a", b: str = "b", value: str = "r") -> DataFrame:
    """Wide form of a table of pairs, each pair once: one row per name in a, one column per name. names are the columns, so no pass over the data finds them."""
    mirrored = long.select(a, b, value).unionByName(long.where(F.col(a) != F.col(b)).select(F.col(b).alias(a), F.col(a).alias(b), value))
    return long_to_wide(mirrored, a, b, value, names)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least hash of key and seed: the same rows in every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


