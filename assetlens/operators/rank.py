"""Ranks, percentiles and running sums without a global window.

Equal values are counted first, so ties of any number become one row. The distinct values are dealt out by ranges of their
order; inside a range a window adds up, and what lies in lower ranges comes from a table with one row per range and group.
No task sees all values, nulls or ties, nothing but plans reaches the driver, and several columns are ranked by one pass.
The tables of values are written to the shared folder, so nothing before them is computed again; lazy results read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.functions.text import to_number
from assetlens.scratch import Scratch


def _match(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


#: Most distinct values (of all metrics and groups) that are added up as they are, in one window per metric and group; more are dealt out by ranges first.
FEW = 100_000


def ranked_values(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), weight: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct value: metric, k0.. (the values of by), value, lo (rows with a smaller one), ties, n (rows with one).

    A row counts as many as `weight` says; the sums of the columns in `sums` over a value's rows come along.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    keys = [f"k{i}" for i in range(len(by))]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), to_number(c).alias("value")) for c in columns]))
    long = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *([F.col(weight).alias("_w")] if weight else []), *sums, cells.alias("c"))
    long = long.select("c.metric", *keys, "c.value", *(["_w"] if weight else []), *sums).where("value is not null")
    ties = F.sum("_w") if weight else F.count(F.lit(1))
    counts = scratch.written(long.groupBy("metric", *keys, "value").agg(ties.alias("ties"), *[F.sum(c).alias(c) for c in sums]), "counts")
    group = W.partitionBy("metric", *keys)
    if counts.count() <= FEW:
        upto = F.sum("ties").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
        return counts.select("metric", *keys, "value", (upto - F.col("ties")).alias("lo"), "ties", F.sum("ties").over(group).alias("n"), *sums)
    order = ["metric", *keys, "value"]
    dealt = scratch.written(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "values")
    scratch.drop("counts")
    per = dealt.groupBy("metric", *keys, "range").agg(F.sum("ties").alias("s"))
    below = per.select(
        F.col("metric").alias("_m"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("range").alias("_r"),
        F.coalesce(F.sum("s").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"), F.sum("s").over(group).alias("n"),
    )
    inside = W.partitionBy("metric", *keys, "range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    out = dealt.withColumn("upto", F.sum("ties").over(inside))
    out = out.join(below, _match(("metric", *keys, "range"), ("_m", *[f"_{k}" for k in keys], "_r")))
    return out.select("metric", *keys, "value", (F.col("_below") + F.col("upto") - F.col("ties")).alias("lo"), "ties", "n", *sums)


def with_ranks_of(df: DataFrame, prefixes: dict[str, str], by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """prefixes: prefix -> column. Adds <prefix>lo, <prefix>ties and <prefix>n for all of them from one pass; null where the column is."""
    values = ranked_values(df, list(dict.fromkeys(prefixes.values())), by, weight)
    keys = [f"k{i}" for i in range(len(by))]
    for p, c in prefixes.items():
        one = values.where(F.col("metric") == c).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_v"), *[F.col(x).alias(p + x) for x in ("lo", "ties", "n")])
        df = df.join(one, (to_number(c) == F.col("_v")) & _match(by, tuple(f"_{k}" for k in keys)), "left").drop("_v", *[f"_{k}" for k in keys])
    return df


def with_ranks(df: DataFrame, value: str, by: tuple[str, ...] = (), prefix: str = "", weight: str | None = None) -> DataFrame:
    """Adds, for rows with a value: <prefix>lo (rows with a smaller one), <prefix>ties, <prefix>n (rows with one); null for others. Rows count as `weight` says."""
    return with_ranks_of(df, {prefix: value}, by, weight)


def average_rank(prefix: str = "") -> Column:
    return F.col(prefix + "lo") + (F.col(prefix + "ties") + 1) / 2


def min_rank(prefix: str = "", descending: bool = False) -> Column:
    lo, c, n = (F.col(prefix + k) for k in ("lo", "ties", "n"))
    return (n - lo - c + 1) if descending else lo + 1


def percentile_01(prefix: str = "", single: float | None = None) -> Column:
    """(average rank - 1) / (n - 1); `single` where there is one value only."""
    n = F.col(prefix + "n")
    return F.when(n > 1, (average_rank(prefix) - 1) / (n - 1)).when(n.isNotNull() & F.lit(single is not None), F.lit(single))


def percentile_rank(prefix: str = "") -> Column:
    return average_rank(prefix) / F.col(prefix + "n")


#: Forms of a percentile: 01, pct (rank / n), zero (like 01, but 0 for a single value).
FORMS = {"01": percentile_01, "pct": percentile_rank, "zero": lambda p: percentile_01(p, 0.0)}


def add_percentiles(df: DataFrame, made: dict[str, str], by: tuple[str, ...] = (), kind: str = "01") -> DataFrame:
    """made: new column -> ranked column; all from one pass."""
    prefixes = {f"_p{i}_": c for i, c in enumerate(made.values())}
    out = with_ranks_of(df, prefixes, by).withColumns({name: FORMS[kind](p) for name, p in zip(made, prefixes)})
    return out.drop(*[p + x for p in prefixes for x in ("lo", "ties", "n")])


def add_percentile(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), kind: str = "01") -> DataFrame:
    return add_percentiles(df, {out: value}, by, kind)


def quantile_table(df: DataFrame, columns: list[str], shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Per metric and group one row with q: the values at the shares, interpolated between neighbours; exact, from the ranked values.

    Columns: metric, k0.. (the values of by), n, q. A metric without values in a group has no row.
    """
    keys = [f"k{i}" for i in range(len(by))]
    v = ranked_values(df, columns, by)
    at = lambda place: F.max(F.when((F.col("lo") <= place) & (place < F.col("lo") + F.col("ties")), F.col("value")))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    g = v.groupBy("metric", *keys, "n").agg(*[x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"a{i}"), at(F.ceil(p)).alias(f"b{i}"))])
    cut = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return g.select("metric", *keys, "n", F.array(*cut).alias("q"))


def cuts(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: name -> value of a column at a share, null without values. wanted: name -> (column, share)."""
    columns, shares = list(dict.fromkeys(c for c, _ in wanted.values())), sorted({p for _, p in wanted.values()})
    q = quantile_table(df, columns, shares)
    return q.agg(*[F.max(F.when(F.col("metric") == c, F.get("q", F.lit(shares.index(p))))).alias(name) for name, (c, p) in wanted.items()])


def in_order(df: DataFrame, *order, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with _no (1..n in a global order) and, for each column of sums, _sum_<column> (its running sum).

    df is written, so it should hold what the order needs and no more. Up to FEW rows are numbered in one window; more are dealt out by ranges of the order, which should
    end with a distinct column, and what lies before a range is a table of one row per range.
    """
    scratch = Scratch(df.sparkSession, "order")
    d = scratch.written(df, "rows")
    if d.count() <= FEW:
        upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return d.withColumns({"_no": F.row_number().over(W.orderBy(*order)).cast("long")} | {f"_sum_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d = scratch.written(d.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    scratch.drop("rows")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    per = per.select("_range", "_first", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before{x}") for x in ("_c", *[f"_s_{c}" for c in sums])])
    d = d.join(F.broadcast(per), "_range")  # one row per range
    inside = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    made = {"_no": F.col("_before_c") + F.col("_at") - F.col("_first") + 1} | {f"_sum_{c}": F.col(f"_before_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    return d.withColumns(made).drop("_range", "_at", "_first", "_before_c", *[f"_before_s_{c}" for c in sums])


def first_rank(df: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    """1..n by score descending, ties by tie ascending; null without a score. Only score and tie are put in order; rows equal in both share out their places."""
    v = to_number(score)
    places = in_order(df.select(v.alias("_v"), F.col(tie).alias("_t")), F.col("_v").desc_nulls_last(), F.asc("_t"))
    first = places.where("_v is not null").groupBy("_v", "_t").agg(F.min("_no").alias("_no"), F.count(F.lit(1)).alias("_c"))
    d = df.join(first, (v == F.col("_v")) & F.col(tie).eqNullSafe(F.col("_t")), "left")
    again = F.row_number().over(W.partitionBy("_v", "_t").orderBy("_no")) - 1 if not first.where("_c > 1").isEmpty() else F.lit(0)
    return d.withColumn(out, F.col("_no") + F.when(F.col("_no").isNotNull(), again)).drop("_v", "_t", "_no", "_c")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order that ends with a unique column: a take-ordered, never a global sort."""
    return df.orderBy(*order).limit(k)


def top_share_flags(df: DataFrame, score: str, tie: str, shares: tuple[float, ...]) -> DataFrame:
    """top_<percent> flags of the ceil(n p) best rows, at least one."""
    r = first_rank(df, score, tie, "_rank")
    n = r.agg(F.count("_rank").alias("_n"))
    r = r.crossJoin(F.broadcast(n))  # one row
    return r.withColumns({f"top_{round(100 * p)}": F.coalesce(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * p)), F.lit(False)) for p in shares}).drop("_rank", "_n")


def top_overlap(df: DataFrame, a: str, b: str, tie: str, share: float) -> DataFrame:
    """top_n, overlap_count and overlap_rate of the best rows by a and by b."""
    name = f"top_{round(100 * share)}"
    x = top_share_flags(df, a, tie, (share,)).withColumnRenamed(name, "_a")
    x = top_share_flags(x, b, tie, (share,)).withColumnRenamed(name, "_b")
    out = x.agg(F.sum(F.col("_a").cast("int")).alias("top_n"), F.sum((F.col("_a") & F.col("_b")).cast("int")).alias("overlap_count"))
    return out.select(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.lit(share).alias("top_share"), "top_n", "overlap_count", F.expr("try_divide(overlap_count, top_n)").alias("overlap_rate"))


def per_group_top(df: DataFrame, by: tuple[str, ...], k: int, *order: Column, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def by_size(df: DataFrame, value: str, tie: str, out: str = "place") -> DataFrame:
    """1..n by the absolute value descending; null without a value."""
    return first_rank(df.withColumn("_abs", F.abs(to_number(value))), "_abs", tie, out).drop("_abs")


def latest(df: DataFrame, time: str, n: int, tie: str) -> DataFrame:
    return top_k(df, n, F.col(time).desc_nulls_last(), F.col(tie).desc())


def batches(df: DataFrame, order: str, size: int, out: str = "batch") -> DataFrame:
    """Number of each block of `size` rows in the order of a column with distinct values; nulls have none."""
    places = in_order(df.where(F.col(order).isNotNull()).select(F.col(order).alias("_o")), F.asc("_o")).groupBy("_o").agg(F.min("_no").alias("_no"))
    return df.join(places, F.col(order) == F.col("_o"), "left").withColumn(out, F.floor((F.col("_no") - 1) / size)).drop("_o", "_no")


def rolling_mean_alert(df: DataFrame, by: tuple[str, ...], order: str, value: str, width: int, threshold: float) -> DataFrame:
    """rolling_mean over the last `width` rows of each key, and slow where the window is full and its mean above the threshold."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumns({"rolling_mean": F.avg(value).over(w), "slow": (F.count(value).over(w) == width) & (F.avg(value).over(w) > threshold)})


def cumulative_share(counts: DataFrame, value: str, *order: Column) -> DataFrame:
    """Running sum and share over a table of groups, in an order that ends with a distinct column."""
    d = in_order(counts, *order, sums=(value,))
    total = d.agg(F.sum(value).alias("_t"))
    d = d.crossJoin(F.broadcast(total))  # one row
    return d.withColumns({"cumulative_count": F.col(f"_sum_{value}"), "cumulative_share": F.col(f"_sum_{value}") / F.col("_t")}).drop("_no", "_t", f"_sum_{value}")
