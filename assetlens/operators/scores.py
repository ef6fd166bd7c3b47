"""Objective weights, component scores, use scores and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import clip01, to_number
from assetlens.operators.rank import add_percentile, add_percentiles, cuts


def pca_two(df: DataFrame, a: str, b: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """First principal component of two standardised columns, oriented with the rows' mean; null below three complete rows.

    r > 0: (z1 + z2) / sqrt 2. r < 0: sign(s1 - s2) (z1 - z2) / sqrt 2, + where they are equal or r is 0.
    """
    x, y = to_number(a), to_number(b)
    both = x.isNotNull() & y.isNotNull()
    g = df.where(both).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_ma"), F.avg(y).alias("_mb"), F.stddev_pop(x).alias("_sa"), F.stddev_pop(y).alias("_sb"), F.corr(x, y).alias("_r")
    )
    keys = [F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}")) for k in by]
    j = df.alias("d").join(g.alias("g"), keys, "left") if by else df.alias("d").crossJoin(F.broadcast(g).alias("g"))
    z1 = (x - F.col("_ma")) / F.nullif(F.col("_sa"), F.lit(0.0))
    z2 = (y - F.col("_mb")) / F.nullif(F.col("_sb"), F.lit(0.0))
    z1, z2 = F.coalesce(z1, F.lit(0.0)), F.coalesce(z2, F.lit(0.0))
    score = F.when(F.coalesce(F.col("_r"), F.lit(0.0)) > 0, z1 + z2).when(F.col("_sa") >= F.col("_sb"), z1 - z2).otherwise(z2 - z1) / F.sqrt(F.lit(2.0))
    return j.select("d.*", F.when(both & (F.col("_n") >= 3), score).alias(out))


def pca_diagnostics(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, the inputs' correlation and the first component's share of variance, (1 + |r|) / 2."""
    x, y = to_number(a), to_number(b)
    g = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return g.withColumn("explained_ratio", (1 + F.abs("r")) / 2)


def critic_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, std, conflict, information and weight: standard deviation (population) times the sum of 1 - r. One aggregation."""
    c = [F.least(F.greatest(to_number(x), F.lit(0.0)), F.lit(1.0)) for x in columns]
    k = range(len(columns))
    one = df.agg(*[F.stddev_pop(c[i]).alias(f"s{i}") for i in k], *[F.corr(c[i], c[j]).alias(f"r{i}_{j}") for i in k for j in k if i < j])
    r = lambda i, j: F.coalesce(F.nanvl(F.col(f"r{min(i, j)}_{max(i, j)}"), F.lit(0.0)), F.lit(0.0))
    conflict = {i: sum((1 - r(i, j) for j in k if j != i), F.lit(0.0)) for i in k}
    cells = F.array(*[F.struct(F.lit(columns[i]).alias("dimension"), F.coalesce(f"s{i}", F.lit(0.0)).alias("std"), conflict[i].alias("conflict")) for i in k])
    total = sum((F.coalesce(f"s{i}", F.lit(0.0)) * conflict[i] for i in k), F.lit(0.0))
    w = one.select(total.alias("t"), F.explode(cells).alias("x")).select("x.*", "t").withColumn("information", F.col("std") * F.col("conflict"))
    return w.select("dimension", "std", "conflict", "information", F.when(F.col("t") > 0, F.col("information") / F.col("t")).otherwise(1.0 / len(columns)).alias("weight"))


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, entropy and weight, (1 - e) over its sum, with e = (ln S - sum(x ln x) / S) / ln n in one pass."""
    c = [F.least(F.greatest(to_number(x), F.lit(0.0)), F.lit(1.0)) + 1e-12 for x in columns]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[x for i in range(len(columns)) for x in (F.sum(c[i]).alias(f"s{i}"), F.sum(c[i] * F.log(c[i])).alias(f"l{i}"))])
    e = [F.coalesce((F.log(f"s{i}") - F.col(f"l{i}") / F.col(f"s{i}")) / F.nullif(F.log("n"), F.lit(0.0)), F.lit(1.0)) for i in range(len(columns))]
    total = sum((1 - x for x in e), F.lit(0.0))
    w = one.select(total.alias("t"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), x.alias("entropy")) for d, x in zip(columns, e)])).alias("x")).select("x.*", "t")
    return w.select("dimension", "entropy", F.when(F.abs("t") > 1e-12, (1 - F.col("entropy")) / F.col("t")).otherwise(1.0 / len(columns)).alias("weight"))


def weighted_score(df: DataFrame, columns: list[str], weights: DataFrame, out: str) -> DataFrame:
    """Sum of clipped columns by a weights table (dimension, weight), which is one broadcast row."""
    row = weights.groupBy().pivot("dimension", columns).agg(F.first("weight"))
    row = row.select(*[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(columns)])
    total = sum((clip01(c) * F.col(f"_w{i}") for i, c in enumerate(columns)), F.lit(0.0))
    return df.crossJoin(F.broadcast(row)).withColumn(out, total).drop(*[f"_w{i}" for i in range(len(columns))])


def actual_use(df: DataFrame, kind: str = "resource_type", product: str = "product", view: str = "view_count", download: str = "download_count", api: str = "api_call_count") -> DataFrame:
    """Percentiles of the log counters, their component within each type, and its percentile within the type and overall."""
    d = df.withColumns({f"_log_{c}": F.log1p(to_number(c)) for c in (view, download, api)})
    d = add_percentiles(d, {out: f"_log_{c}" for c, out in ((view, "view_score"), (download, "download_score"), (api, "api_score"))})
    d = d.withColumn("_second", F.when(F.col(kind) == product, F.col("download_score")).otherwise(F.col("api_score")))
    d = pca_two(d, "view_score", "_second", "actual_raw", (kind,))
    d = d.withColumns({"actual_equal": (F.col("view_score") + F.col("_second")) / 2, "actual_depth": F.when(F.col(kind) == product, 0.4 * F.col("view_score") + 0.6 * F.col("_second")).otherwise(0.3 * F.col("view_score") + 0.7 * F.col("_second"))})
    d = add_percentiles(d, {"actual_type_percentile": "actual_raw", "actual_equal_percentile": "actual_equal", "actual_depth_percentile": "actual_depth"}, (kind,))
    d = add_percentile(d, "actual_raw", "actual_global_percentile")
    return d.drop("_second", *[f"_log_{c}" for c in (view, download, api)])


def potential_use(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """potential_critic, potential_equal and potential_entropy, with the percentile of each."""
    d = weighted_score(df, dimensions, critic_weights(df, dimensions), "potential_critic")
    d = d.withColumn("potential_equal", sum((clip01(c) for c in dimensions), F.lit(0.0)) / len(dimensions))
    d = weighted_score(d, dimensions, entropy_weights(df, dimensions), "potential_entropy")
    return add_percentiles(d, {c + "_percentile": c for c in ("potential_critic", "potential_equal", "potential_entropy")})


def is_candidate(potential, actual, high: float = 0.70, low: float = 0.50, gap: float = 0.30) -> Column:
    p, a = F.col(potential), F.col(actual)
    return F.coalesce((p >= high) & (a <= low) & (p - a >= gap), F.lit(False))


def quadrant(potential: str, actual: str, cut: float = 0.5, labels=("high_high", "high_low", "low_low", "low_high"), missing: str = "unclassified") -> Column:
    """labels: potential and actual use high, only potential, neither, only actual use."""
    p, a = F.col(potential), F.col(actual)
    return F.when(p.isNull() | a.isNull(), missing).when((p >= cut) & (a >= cut), labels[0]).when(p >= cut, labels[1]).when(a < cut, labels[2]).otherwise(labels[3])


def dormancy(df: DataFrame, potential: str = "potential_critic_percentile", actual: str = "actual_type_percentile") -> DataFrame:
    return df.withColumns({"dormant_score": F.col(potential) - F.col(actual), "candidate": is_candidate(potential, actual).cast("int"), "quadrant": quadrant(potential, actual)})


def recomputation_mismatches(df: DataFrame, stored: str, again: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum((~F.col(stored).cast("int").eqNullSafe(again.cast("int"))).cast("int")), F.lit(0)).alias("mismatches"))


#: The weights, caps and factors in the seven dimension scores below must be these.
def seven_dimensions(df: DataFrame, exact: bool = True) -> DataFrame:
    """The seven dimension scores of potential use, each in [0, 1], from the clean catalog's columns (see README)."""
    from assetlens.functions.catalog import DOMAIN_SCORE, FREQUENCY_SCORE, OTHER_SCORE, SPATIAL_SCORE, lookup_score
    from assetlens.functions.text import is_blank, normalized_text
    from assetlens.operators.stats import normalize_01

    d = normalize_01(df, {
        "_scene": {"column": "scene_keyword_count", "high": 0.99}, "_title": {"column": "title_len", "high": 0.95}, "_desc": {"column": "description_len", "high": 0.95},
        "_fields": {"column": "field_count", "high": 0.99, "log": True}, "_described": {"column": "field_description_count", "high": 0.99, "log": True},
        "_records": {"column": "record_count_log", "high": 0.99}, "_size": {"column": "data_size_log", "high": 0.99},
    }, exact)
    cap = cuts(df, {"_cap": ("update_recency_days", 0.95)})
    d = d.crossJoin(F.broadcast(cap))
    days = to_number("update_recency_days")
    recency = F.when(F.col("_cap").isNull() | (F.col("_cap") <= 0) | days.isNull(), 0.5).otherwise(1 - F.least(F.greatest(days, F.lit(0.0)), F.col("_cap")) / F.col("_cap"))
    fmt = F.least(F.greatest(F.coalesce(to_number("format_count"), F.lit(0.0)), F.lit(0.0)), F.lit(5.0)) / 5
    place = (~is_blank("detail_spatial_scope") & ~normalized_text("detail_spatial_scope").isin("-", "--", "—", "无", "暂无")).cast("double")
    rec = F.log1p(F.least(F.greatest(F.coalesce(to_number("recommended_count"), F.lit(0.0)), F.lit(0.0)), F.lit(10.0))) / F.log1p(F.lit(10.0))
    rec = rec * F.when(clip01("recommended_suspicious") == 1, 0.35).otherwise(1.0)
    timely = 0.65 * lookup_score("update_frequency", FREQUENCY_SCORE, OTHER_SCORE["frequency"]) + 0.35 * recency
    parts = {
        "topic_public_value": 0.75 * lookup_score("domain", DOMAIN_SCORE, OTHER_SCORE["domain"]) + 0.25 * F.col("_scene"),
        "semantic_clarity": 0.25 * F.col("_title") + 0.35 * F.col("_desc") + 0.25 * clip01("description_has_field_hint") + 0.15 * F.col("_scene"),
        "data_richness": 0.35 * F.col("_fields") + 0.25 * F.col("_described") + 0.25 * F.col("_records") + 0.15 * F.col("_size"),
        "machine_readability": 0.35 * fmt + 0.25 * clip01("has_csv") + 0.25 * clip01("has_json") + 0.10 * clip01("has_xlsx") + 0.03 * clip01("has_xml") + 0.02 * clip01("has_rdf"),
        "timeliness": clip01(timely) * F.when(clip01("date_order_anomaly") == 1, 0.90).otherwise(1.0),
        "spatiotemporal_capability": 0.30 * clip01("has_meaningful_time_scope") + 0.20 * place + 0.20 * clip01("has_time_field") + 0.20 * clip01("has_geo_field") + 0.10 * lookup_score("spatial_admin_level", SPATIAL_SCORE, OTHER_SCORE["spatial"]),
        "combinability": 0.25 * fmt + 0.20 * clip01("has_standard_field_description") + 0.20 * F.col("_described") + 0.15 * rec + 0.10 * clip01("has_time_field") + 0.10 * clip01("has_geo_field"),
    }
    return d.withColumns({k: clip01(v) for k, v in parts.items()}).drop("_scene", "_title", "_desc", "_fields", "_described", "_records", "_size", "_cap")
