"""Distribution and rank statistics. Sums over value histograms replace global sorts; only constant-size results reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.functions.tails import chi2_p, correlation_p, normal_p
from assetlens.functions.text import to_number
from assetlens.operators.rank import average_rank, cuts, quantile_table, ranked_values, with_ranks_of


def gini(df: DataFrame, value: str) -> DataFrame:
    """gini: 2 sum(i x) / (n sum x) - (n + 1) / n over values clipped at 0; 0 for none or a zero sum. Ties share their average rank."""
    x = df.select(F.when(to_number(value).isNotNull(), F.greatest(to_number(value), F.lit(0.0))).alias("x"))
    r = ranked_values(x, ["x"])
    s = r.agg(F.sum(average_rank() * F.col("value") * F.col("ties")).alias("ix"), F.sum(F.col("value") * F.col("ties")).alias("sx"), F.sum("ties").alias("n"))
    return s.select(F.when(F.col("sx") > 0, 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def top_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """Share of the sum that the ceil(n p) largest values hold; tied values at the border count in part."""
    r = ranked_values(df, [value])
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    above = F.col("n") - F.col("lo") - F.col("ties")
    taken = F.least(F.col("ties"), F.greatest(F.lit(0), k - above))
    s = r.agg(F.sum(F.col("value") * taken).alias("t"), F.sum(F.col("value") * F.col("ties")).alias("s"))
    return s.select(F.coalesce(F.expr("try_divide(t, s)"), F.lit(0.0)).alias("top_share"))


def lorenz(df: DataFrame, value: str, points: int = 20) -> DataFrame:
    """population_share and value_share at a bounded number of points, with the origin."""
    r = ranked_values(df, [value])
    slot = F.ceil((F.col("lo") + F.col("ties")) * points / F.col("n"))
    g = r.groupBy(slot.alias("slot")).agg(F.sum(F.col("value") * F.col("ties")).alias("s"), F.sum("ties").alias("c"))
    w = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)  # over `points` rows at most
    g = g.select((F.sum("c").over(w) / F.sum("c").over(W.partitionBy())).alias("population_share"), (F.sum("s").over(w) / F.sum("s").over(W.partitionBy())).alias("value_share"))
    origin = g.sparkSession.range(1).select(F.lit(0.0).alias("population_share"), F.lit(0.0).alias("value_share"))
    return origin.unionByName(g)


def quantiles(df: DataFrame, columns: list[str], shares: list[float], exact: bool = True) -> DataFrame:
    """Long form (metric, share, value) of all columns from one pass; value is null for a column without values."""
    if exact:
        one = cuts(df, {f"{c}/{k}": (c, p) for c in columns for k, p in enumerate(shares)})
        at = lambda c, k: F.col(f"`{c}/{k}`")
    else:
        one = df.agg(*[F.percentile_approx(to_number(c), shares, 10_000).alias(c) for c in columns])
        at = lambda c, k: F.get(c, F.lit(k))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(p).cast("double").alias("share"), at(c, k).cast("double").alias("value")) for c in columns for k, p in enumerate(shares)]))
    return one.select(cells.alias("q")).select("q.*")


def winsorize(df: DataFrame, column: str, share: float = 0.99, out: str | None = None, exact: bool = True) -> DataFrame:
    """Values above the quantile become the quantile; nulls stay."""
    cut = cuts(df, {"_cut": (column, share)}) if exact else df.agg(F.percentile_approx(to_number(column), share, 10_000).alias("_cut"))
    v = to_number(column)
    return df.crossJoin(F.broadcast(cut)).withColumn(out or column + "_winsor", F.when(v > F.col("_cut"), F.col("_cut")).otherwise(v)).drop("_cut")


def normalize_01(df: DataFrame, specs: dict[str, dict], exact: bool = True) -> DataFrame:
    """Several columns at once. specs: output -> {column, low, high, fill, log}. Clip to quantiles, then min-max.

    All null: fill in every row. Equal bounds: 0.5 in every row, nulls included. Else null: fill; results lie in [0, 1].
    """

    def value(s: dict) -> Column:
        v = to_number(s["column"])
        return F.log1p(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))) if s.get("log") else v

    if exact:
        made = df.select(*[value(s).alias(k) for k, s in specs.items()])
        bounds = cuts(made, {f"_lo_{k}": (k, float(s.get("low", 0.0))) for k, s in specs.items()} | {f"_hi_{k}": (k, float(s.get("high", 1.0))) for k, s in specs.items()})
    else:
        bounds = df.agg(*[F.percentile_approx(value(s), float(s.get(w, d)), 10_000).alias(f"{p}{k}") for k, s in specs.items() for p, w, d in (("_lo_", "low", 0.0), ("_hi_", "high", 1.0))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    made = {}
    for k, s in specs.items():
        lo, hi, v, fill = F.col(f"_lo_{k}"), F.col(f"_hi_{k}"), value(s), F.lit(float(s.get("fill", 0.0)))
        scaled = F.when(v.isNull(), fill).otherwise((F.least(F.greatest(v, lo), hi) - lo) / F.nullif(hi - lo, F.lit(0.0)))
        made[k] = F.when(lo.isNull(), fill).when(F.abs(hi - lo) < 1e-12, F.lit(0.5)).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return out.withColumns(made).drop(*[c for k in specs for c in (f"_lo_{k}", f"_hi_{k}")])


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (a, b, r) of all pairs from one aggregation; pairwise complete."""
    cols = [to_number(c) for c in columns]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = df.agg(*[F.corr(F.when(cols[j].isNotNull(), cols[i]), F.when(cols[i].isNotNull(), cols[j])).alias(f"p{i}_{j}") for i, j in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"p{i}_{j}").alias("r")) for i, j in pairs]))
    return one.select(cells.alias("c")).select("c.*")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (a, b, r) of all pairs: Pearson of average ranks over the rows that have both values; all pairs from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), to_number(a).alias("x"), to_number(b).alias("y")) for k, (a, b) in enumerate(pairs)]))
    both = df.select(cells.alias("c")).select("c.*").where("x is not null and y is not null")
    r = with_ranks_of(both, {"x_": "x", "y_": "y"}, ("pair",)).groupBy("pair").agg(F.corr(average_rank("x_"), average_rank("y_")).alias("r"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    every = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"), F.get(names, F.col("id").cast("int")).alias("n"))
    return every.join(r, "pair", "left").select("n.a", "n.b", "r")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho, n and two-sided p over rows with both values."""
    both = df.select(to_number(a).alias("x"), to_number(b).alias("y")).where("x is not null and y is not null")
    r = with_ranks_of(both, {"x_": "x", "y_": "y"})
    one = r.agg(F.corr(average_rank("x_"), average_rank("y_")).alias("rho"), F.count(F.lit(1)).alias("n"))
    return one.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation, from t with n - 2 degrees of freedom (regularised incomplete beta, scalar)."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return _beta_inc(df / 2, 0.5, 1 - r * r)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: m, rank_sum and median; with the total n and sum(t^3 - t) of ties. Null groups are a group.

    Everything comes from counts by (value, group), so no row is joined with its rank.
    """
    d = df.select(F.col(group).alias("g"), to_number(value).alias("v")).where("v is not null")
    values = ranked_values(d, ["v"])
    by_group = d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    r = by_group.join(values.select(F.col("value").alias("v"), "lo", "ties"), "v")
    per = r.groupBy("g").agg(F.sum("c").alias("m"), F.sum(F.col("c") * average_rank()).alias("rank_sum"))
    median = quantile_table(d, ["v"], [0.5], ("g",)).select(F.col("k0").alias("_g"), F.get("q", F.lit(0)).alias("median"))
    ties = values.agg(F.sum(F.col("ties") * (F.col("ties") * F.col("ties") - 1.0)).alias("tie_sum"), F.sum("ties").alias("total"))
    return per.join(median, F.col("g").eqNullSafe(F.col("_g"))).drop("_g").crossJoin(F.broadcast(ties))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """u, z, its two-sided normal p, delta, medians and sizes of the two groups in the order of their keys; null u unless there are exactly two groups."""
    s = rank_sums(df, group, value)
    two = s.agg(F.sort_array(F.collect_list(F.struct("g", "m", "rank_sum", "median", "tie_sum", "total"))).alias("a"))
    a, b = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    two = two.select(F.size("a").alias("k"), a["m"].alias("n1"), b["m"].alias("n2"), a["median"].alias("median1"), b["median"].alias("median2"), a["rank_sum"].alias("r1"), a["tie_sum"].alias("ts"), a["total"].cast("double").alias("n"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (F.col("n") + 1 - F.col("ts") / (F.col("n") * (F.col("n") - 1))))
    ok = F.col("k") == 2
    z = (F.abs(u - mean) - 0.5) / F.nullif(sd, F.lit(0.0))
    return two.select("n1", "n2", "median1", "median2", F.when(ok, u).alias("u"), F.when(ok, z).alias("z"), F.when(ok, normal_p(z)).alias("p"), F.when(ok, 2 * u / (F.col("n1") * F.col("n2")) - 1).alias("delta"))


def mann_whitney_p(z: float | None) -> float | None:
    return None if z is None else min(1.0, math.erfc(z / math.sqrt(2)))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (tie-corrected), its chi-square p with k - 1 degrees of freedom, k, n and epsilon_squared."""
    s = rank_sums(df, group, value)
    t = s.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k"), F.max("total").cast("double").alias("n"), F.max("tie_sum").alias("ts"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("ts") / (F.pow("n", F.lit(3)) - F.col("n")))
    t = t.withColumn("h", F.when(F.col("k") > 1, h))
    return t.select("h", chi2_p(F.col("h"), F.col("k") - 1).alias("p"), "k", F.col("n").cast("long").alias("n"), F.when(F.col("n") > F.col("k"), F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k")))).alias("epsilon_squared"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """cramers_v and n from the counts of non-null pairs: chi2 = n (sum o^2 / (row column) - 1); Yates correction for two by two."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    j = cells.join(rows, "a").join(cols, "b")
    s = j.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("q"), F.sum("o").alias("n"), F.max("ra").alias("r1"), F.max("cb").alias("c1"), F.max(F.struct("ra", "cb", "o")).alias("x"))
    levels = cells.agg(F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    s = s.crossJoin(F.broadcast(levels))  # one row
    n = F.col("n").cast("double")
    # in a two by two table |o - e| is the same in all cells, and chi2 = gap^2 n^3 / (r1 r2 c1 c2)
    e = F.col("x.ra") * F.col("x.cb") / n
    gap = F.abs(F.col("x.o") - e)
    gap = gap - F.least(F.lit(0.5), gap)
    yates = gap * gap * F.pow(n, F.lit(3)) / (F.col("r1") * (n - F.col("r1")) * F.col("c1") * (n - F.col("c1")))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(n * (F.col("q") - 1))
    return s.select(F.sqrt(F.greatest(chi2, F.lit(0.0)) / n / F.greatest(F.lit(1), F.least(F.col("r") - 1, F.col("c") - 1))).alias("cramers_v"), "n")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, r2, mae, rmse, pearson and spearman over rows with both values, per key of `by`."""
    d = df.select(*by, to_number(actual).alias("y"), to_number(predicted).alias("p")).where("y is not null and p is not null")
    r = with_ranks_of(d, {"y_": "y", "p_": "p"}, by)
    err = F.col("y") - F.col("p")
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.corr("y", "p").alias("pearson"), F.corr(average_rank("y_"), average_rank("p_")).alias("spearman"),
    )
    return g.select(*by, "n", (1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"), "mae", "rmse", "pearson", "spearman")


def set_overlap(df: DataFrame, flag_a: str, flag_b: str) -> DataFrame:
    """Sizes, intersection, union and Jaccard of two flags on the same rows; 0 for an empty union."""
    a, b = (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in (flag_a, flag_b))
    s = df.agg(F.sum(a).alias("size_a"), F.sum(b).alias("size_b"), F.sum(a * b).alias("common"), F.sum(F.greatest(a, b)).alias("united"))
    return s.withColumn("jaccard", F.coalesce(F.expr("try_divide(common, united)"), F.lit(0.0)))
