"""Threshold grids, weight perturbation, candidate layers, votes and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.functions.text import clip01, to_number
from assetlens.operators.rank import add_percentile, add_percentiles, cuts, min_rank, ranked_values, with_ranks
from assetlens.operators.scores import is_candidate
from assetlens.scratch import spread, written

Scenario = tuple[str, float, float, float]


def scenarios(sets: dict[str, tuple[list[float], list[float], list[float]]]) -> list[Scenario]:
    """(set, potential, actual, gap) for every combination of each set."""
    return [(name, p, a, g) for name, (ps, as_, gs) in sets.items() for p in ps for a in as_ for g in gs]


def membership(df: DataFrame, grid: list[Scenario], potential: str, actual: str) -> DataFrame:
    """One 0/1 column s<k> per scenario, all in one projection."""
    return df.withColumns({f"s{k}": is_candidate(potential, actual, p, a, g).cast("int") for k, (_, p, a, g) in enumerate(grid)})


def grid_summary(df: DataFrame, grid: list[Scenario], potential: str, actual: str, base: tuple[float, float, float] = (0.70, 0.50, 0.30)) -> DataFrame:
    """Per scenario: candidates, share, overlap with the base rule, its share of the base, Jaccard, whether it is the base rule. One pass."""
    d = membership(df, grid, potential, actual).withColumn("_base", is_candidate(potential, actual, *base).cast("int"))
    one = d.agg(F.count(F.lit(1)).alias("n"), F.sum("_base").alias("b"), *[x for k in range(len(grid)) for x in (F.sum(f"s{k}").alias(f"c{k}"), F.sum(F.col(f"s{k}") * F.col("_base")).alias(f"o{k}"))])
    rows = [F.struct(F.lit(name).alias("set"), F.lit(p).alias("potential"), F.lit(a).alias("actual"), F.lit(g).alias("gap"), F.col(f"c{k}").alias("candidates"), F.col(f"o{k}").alias("overlap"), F.lit((p, a, g) == tuple(base)).alias("is_base")) for k, (name, p, a, g) in enumerate(grid)]
    x = one.select("n", "b", F.explode(F.array(*rows)).alias("s")).select("s.*", "n", "b")
    return x.select("set", "potential", "actual", "gap", "candidates", (F.col("candidates") / F.col("n")).alias("share"), "overlap", F.expr("try_divide(overlap, b)").alias("overlap_of_base"), F.coalesce(F.expr("try_divide(overlap, candidates + b - overlap)"), F.lit(0.0)).alias("jaccard"), "is_base")


def set_summary(summary: DataFrame) -> DataFrame:
    return summary.groupBy("set").agg(F.count(F.lit(1)).alias("scenarios"), F.min("candidates").alias("least"), F.percentile("candidates", 0.5).alias("median"), F.max("candidates").alias("most"), F.percentile("overlap", 0.5).alias("median_overlap"), F.percentile("jaccard", 0.5).alias("median_jaccard"))


def selection_frequency(df: DataFrame, grid: list[Scenario], potential: str, actual: str) -> DataFrame:
    """times_selected, selection_share, and a robustness rank: min-rank of share + (1 - percentile of the gap), descending."""
    total = sum((is_candidate(potential, actual, p, a, g).cast("int") for _, p, a, g in grid), F.lit(0))
    d = df.withColumns({"times_selected": total, "selection_share": total / len(grid), "_gap": F.col(potential) - F.col(actual)})
    d = add_percentile(d, "_gap", "_gp", kind="zero")
    d = d.withColumn("_score", F.round(F.col("selection_share") + (1 - F.col("_gp")), 12))
    return with_ranks(d, "_score", prefix="_s").withColumn("robustness_rank", min_rank("_s", descending=True)).drop("_gap", "_gp", "_score", "_slo", "_sties", "_sn")


def perturbed_weights(base: dict[str, float], amplitudes: list[float], draws: int, seed: int) -> list[tuple[str, dict[str, float]]]:
    import random

    r, out = random.Random(seed), []
    for a in amplitudes:
        for k in range(draws):
            w = {c: v * r.uniform(1 - a, 1 + a) for c, v in base.items()}
            s = sum(w.values())
            out.append((f"{a:g}/{k}", {c: v / s for c, v in w.items()}))
    return out


def weight_scenarios(df: DataFrame, key: str, base: dict[str, float], draws: list[tuple[str, dict[str, float]]], shares: tuple[float, ...] = (0.1, 0.3)) -> DataFrame:
    """Per draw: Spearman with the base score and the overlap of the best rows. Draws are a small literal table.

    Rows with the same values have the same score in every draw, so they are one class that counts as many. What the base
    ranks add up to over a score's rows comes along with the score, so nothing is joined back to rows and draws.
    """
    used = list(dict.fromkeys([*base, *[c for _, w in draws for c in w]]))
    at = {c: k for k, c in enumerate(used)}
    own = df.select(*[clip01(c).alias(f"_c{k}") for c, k in at.items()]).groupBy(*[f"_c{k}" for k in at.values()]).agg(F.count(F.lit(1)).alias("_rows"))
    own = written(own.withColumn("base", sum((F.col(f"_c{at[c]}") * v for c, v in base.items()), F.lit(0.0))), "classes")
    own = with_ranks(own, "base", prefix="b_", weight="_rows")  # the same in every draw
    # ranks are taken from their mean, which is that of 1..n whatever the ties
    centred = lambda p: F.col(f"{p}lo") + (F.col(f"{p}ties") + 1) / 2 - (F.col(f"{p}n") + 1) / 2
    best = lambda p, share: F.col(f"{p}n") - F.col(f"{p}lo") - F.col(f"{p}ties") < F.greatest(F.lit(1), F.ceil(F.col(f"{p}n") * share))
    tops = {f"_top{i}": share for i, share in enumerate(shares)}
    own = own.withColumns({"_b": centred("b_") * F.col("_rows"), "_bb": centred("b_") * centred("b_") * F.col("_rows"), **{c: F.when(best("b_", p), F.col("_rows")).otherwise(0) for c, p in tops.items()}})
    table = df.sparkSession.createDataFrame([(n, *[float(w[c]) if c in w else None for c in used]) for n, w in draws], ", ".join(["draw string", *[f"_w{k} double" for k in at.values()]]))
    parts = [F.when(F.col(f"_w{k}").isNull(), 0.0).otherwise(F.col(f"_c{k}") * F.col(f"_w{k}")) for k in at.values()]
    carried = ("_b", "_bb", *tops)
    d = spread(own).crossJoin(F.broadcast(table)).select("draw", "_rows", *carried, sum(parts, F.lit(0.0)).alias("score"))
    d = ranked_values(d, ["score"], ("draw",), "_rows", carried).withColumnRenamed("k0", "draw")
    r = centred("")
    aggs = [F.try_divide(F.sum(r * F.col("_b")), F.sqrt(F.sum(r * r * F.col("ties")) * F.sum("_bb"))).alias("spearman")]
    for c, p in tops.items():
        k = F.greatest(F.lit(1), F.ceil(F.col("n") * p))
        aggs.append((F.sum(F.when(best("", p), F.col(c)).otherwise(0)) / F.max(k)).alias(f"top_{round(100 * p)}_overlap"))
    return d.groupBy("draw").agg(*aggs)


def leave_one_out(weights: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    out = []
    for gone in weights:
        s = sum(v for c, v in weights.items() if c != gone)
        out.append((f"without {gone}", {c: v / s for c, v in weights.items() if c != gone}))
    return out


def neighbours(base: tuple[float, float, float], step: float) -> list[Scenario]:
    """The base rule, and each threshold changed by one step up and down."""
    out: list[Scenario] = [("neighbour", *base)]
    for i in range(3):
        for d in (-step, step):
            out.append(("neighbour", *[round(v + d, 10) if i == k else v for k, v in enumerate(base)]))
    return out


def residual_columns(df: DataFrame, predictions: dict[str, str], actual: str, high: float = 0.70, low: float = 0.50, gap: float = 0.30) -> DataFrame:
    """Per model: percentile of its prediction, residual score and strict candidate flag."""
    df = add_percentiles(df, {f"expected_{m}_percentile": c for m, c in predictions.items()})
    for m in predictions:
        df = df.withColumns({f"dormant_score_{m}": F.col(f"expected_{m}_percentile") - F.col(actual), f"strict_{m}": is_candidate(f"expected_{m}_percentile", actual, high, low, gap).cast("int")})
    return df


def quantile_layers(df: DataFrame, score: str, low_use: Column, rule: Column, all_shares=(0.95, 0.9, 0.8, 0.7), rule_shares=(0.9, 0.8, 0.7)) -> DataFrame:
    """Low-use rows above quantiles of all scores, rule rows above quantiles of the rule rows; no rule rows: no layer, no error."""
    s = to_number(score)
    both = df.select(s.alias("all"), F.when(rule, s).alias("rule"))
    at = {f"_a{k}": ("all", p) for k, p in enumerate(all_shares)} | {f"_b{k}": ("rule", p) for k, p in enumerate(rule_shares)}
    d = df.crossJoin(F.broadcast(cuts(both, at)))  # one row
    made = {f"low_use_p{round(100 * p)}": F.coalesce(low_use & (s >= F.col(f"_a{k}")), F.lit(False)).cast("int") for k, p in enumerate(all_shares)}
    made |= {f"rule_p{round(100 * p)}": F.coalesce(rule & (s >= F.col(f"_b{k}")), F.lit(False)).cast("int") for k, p in enumerate(rule_shares)}
    return d.withColumns(made).drop(*at)


def votes(df: DataFrame, flags: list[str]) -> DataFrame:
    total = sum((F.coalesce(to_number(c), F.lit(0.0)).cast("int") for c in flags), F.lit(0))
    return df.withColumns({"votes": total, "any_vote": (total >= 1).cast("int"), "two_votes": (total >= 2).cast("int"), "three_votes": (total >= 3).cast("int")})


def layer_overlap(df: DataFrame, layers: list[str], rule: str) -> DataFrame:
    """Per layer: count, share, common with the rule, Jaccard. One pass."""
    r = F.coalesce(to_number(rule), F.lit(0.0)).cast("int")
    x = {c: F.coalesce(to_number(c), F.lit(0.0)).cast("int") for c in layers}
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("r"), *[a for c in layers for a in (F.sum(x[c]).alias(f"c_{c}"), F.sum(x[c] * r).alias(f"o_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("layer"), F.col(f"c_{c}").alias("count"), F.col(f"o_{c}").alias("common")) for c in layers])
    d = one.select("n", "r", F.explode(rows).alias("x")).select("x.*", "n", "r")
    return d.select("layer", "count", (F.col("count") / F.col("n")).alias("share"), "common", F.coalesce(F.expr("try_divide(common, count + r - common)"), F.lit(0.0)).alias("jaccard"))


def vote_counts(df: DataFrame, vote: str = "votes") -> DataFrame:
    """Rows per number of votes."""
    return df.groupBy(vote).agg(F.count(F.lit(1)).alias("count"))


def scheme_comparison(df: DataFrame, schemes: dict[str, str], actual: str, base: str, thresholds: tuple[float, float, float] = (0.70, 0.50, 0.30)) -> DataFrame:
    """Candidates under each scheme's potential percentile (scheme -> column), and their overlap with the base scheme's. One pass."""
    flag = {s: is_candidate(c, actual, *thresholds).cast("int") for s, c in schemes.items()}
    one = df.agg(F.coalesce(F.sum(flag[base]), F.lit(0)).alias("b"), *[x for i, f in enumerate(flag.values()) for x in (F.coalesce(F.sum(f), F.lit(0)).alias(f"c{i}"), F.coalesce(F.sum(f * flag[base]), F.lit(0)).alias(f"o{i}"))])
    cells = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(f"c{i}").alias("candidates"), F.col(f"o{i}").alias("overlap")) for i, s in enumerate(schemes)])
    x = one.select("b", F.explode(cells).alias("x")).select("x.*", "b")
    return x.select("scheme", "candidates", "overlap", F.coalesce(F.expr("try_divide(overlap, candidates + b - overlap)"), F.lit(0.0)).alias("jaccard"))


def high_confidence(rule: str, model: str) -> Column:
    """1 where both the rule and the model name a row."""
    return ((F.coalesce(to_number(rule), F.lit(0.0)) == 1) & (F.coalesce(to_number(model), F.lit(0.0)) == 1)).cast("int")


def high_potential(df: DataFrame, potential: str, tie: str, columns: list[str], least: float = 0.70) -> DataFrame:
    """The columns of rows of high potential, the highest first."""
    return df.where(to_number(potential) >= least).select(*columns).orderBy(F.desc(potential), tie)


def _flag(df: DataFrame, c: str) -> Column:
    return F.coalesce(to_number(c) == 1, F.lit(False)) if c in df.columns else F.lit(False)


def extreme_cases(df: DataFrame, strict: str, any_vote: str, others: list[str], votes: str, score: str, tie: str) -> DataFrame:
    """Rows that the strict rule, any vote or one of the other flags names; most votes first, then the highest score. Absent flags name none."""
    cond = _flag(df, strict) | _flag(df, any_vote)
    for c in others:
        cond = cond | _flag(df, c)
    return df.where(cond).orderBy(F.desc(votes), F.desc(score), tie)


def candidate_pools(df: DataFrame, pools: dict[str, str], columns: list[str], scores: tuple[str, ...], tie: str) -> dict[str, DataFrame]:
    """Pool -> its rows (flag column is 1) with the columns that exist, the highest scores first."""
    have = [c for c in columns if c in df.columns]
    order = [F.desc(c) for c in scores if c in df.columns]
    return {name: df.where(_flag(df, flag)).orderBy(*order, tie).select(*have) for name, flag in pools.items()}


def model_candidates(df: DataFrame, flags: dict[str, str], rule: str, selected: str) -> DataFrame:
    """Per model (model -> flag column): candidates, share, how many the rule names too, and whether it is the selected model. One pass."""
    r = F.coalesce(to_number(rule), F.lit(0.0)).cast("int")
    f = {m: F.coalesce(to_number(c), F.lit(0.0)).cast("int") for m, c in flags.items()}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(f.values()) for x in (F.coalesce(F.sum(c), F.lit(0)).alias(f"c{i}"), F.coalesce(F.sum(c * r), F.lit(0)).alias(f"o{i}"))])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"c{i}").alias("candidates"), F.col(f"o{i}").alias("with_rule"), F.lit(int(m == selected)).alias("is_selected")) for i, m in enumerate(f)])
    x = one.select("n", F.explode(cells).alias("x")).select("x.*", "n")
    return x.select("model", "candidates", (F.col("candidates") / F.col("n")).alias("share"), "with_rule", "is_selected")


def model_selection(metrics: DataFrame) -> DataFrame:
    """Models by the sum of their ranks by Spearman, RMSE and MAE; a table of one row per model."""
    every = W.partitionBy()
    r = metrics.withColumns({"_r1": F.rank().over(every.orderBy(F.desc("spearman"))), "_r2": F.rank().over(every.orderBy("rmse")), "_r3": F.rank().over(every.orderBy("mae"))})
    r = r.withColumn("rank_sum", F.col("_r1") + F.col("_r2") + F.col("_r3"))
    return r.withColumn("place", F.row_number().over(every.orderBy("rank_sum", F.desc("spearman"), "rmse"))).drop("_r1", "_r2", "_r3")
