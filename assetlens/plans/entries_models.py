"""Entries of profiles (G), ranks and statistics (H, I), scores and sensitivity (J, K), models (P) and streams (M).

What a model predicts can't be said in SQL; its entries return what must hold of any right result (each id once, sums, closed forms).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlens.operators import ml, profile, rank, scores, sensitivity, stats
from assetlens.plans.entries_text import plain, scored
from assetlens.plans.registry import query, rounded
from assetlens.plans.views import ASSET, DIMENSIONS, DIMS, RAW_SQL, SCORED, WEIGHTS, asset_dimensions, asset_usage, p01, raw_assets, scored_assets, table
from assetlens.scratch import new_folder, written
from assetlens.streaming import monitor

_RAW = f"WITH {RAW_SQL}"
_A = f"WITH {ASSET}"


def long(columns, by: str = "", source: str = "asset") -> str:
    """SQL of the unpivoted columns."""
    key = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {key}'{c}' AS metric, {c}::DOUBLE AS value FROM {source}" for c in columns)


# ---- profiles


@query("g2_sample_overview", f"{_RAW}, s AS (SELECT lower(trim(scrape_status))='success' AS ok, {plain('note')}<>'' AS noted FROM raw) SELECT 'all' AS name, count(*) AS count, 1.0::DOUBLE AS share FROM s UNION ALL SELECT 'success', sum(ok::INT)::BIGINT, round(avg(ok::INT),6) FROM s UNION ALL SELECT 'success_noted', sum((ok AND noted)::INT)::BIGINT, round(avg((ok AND noted)::INT),6) FROM s")
def g2_sample_overview(spark, sf):
    from assetlens.functions import text as T

    ok = F.lower(F.trim("scrape_status")) == "success"
    return rounded(profile.named_counts(raw_assets(spark, sf), {"all": F.lit(True), "success": ok, "success_noted": ok & ~T.is_blank("note")}))


@query("g11_indicator_summary", f"{_A}, l AS ({long(['view_count', 'download_count'])}) SELECT metric, sum((value=0)::INT)::BIGINT AS zero_count, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99, max(value) AS max FROM l GROUP BY 1")
def g11_indicator_summary(spark, sf):
    return rounded(profile.summary(asset_usage(spark, sf), ["view_count", "download_count"], (), ("zero_count", "median", "p95", "p99", "max")))


@query("g13_dimension_summary", f"{_A}, {DIMS}, l AS ({long(DIMENSIONS, source='dims')}) SELECT metric, count(*) AS count, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std_pop, round(min(value),6) AS min, round(quantile_cont(value,0.1),6) AS p10, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.9),6) AS p90, round(max(value),6) AS max FROM l GROUP BY 1")
def g13_dimension_summary(spark, sf):
    return rounded(profile.summary(asset_dimensions(spark, sf), list(DIMENSIONS), (), ("count", "mean", "std_pop", "min", "p10", "median", "p90", "max")))


@query("g15_candidate_groups", f"""{_RAW}, c AS (SELECT *, (p_size>=30)::INT AS cand FROM raw), g AS (SELECT 'update_frequency' AS group_col, coalesce(update_frequency,'缺失') AS group_value, count(*) AS total, sum(cand)::BIGINT AS candidates, round(avg(cand),6) AS candidate_rate, round(avg(p_size),6) AS mean_p_size FROM c GROUP BY 2
 UNION ALL SELECT 'p_brand', p_brand, count(*), sum(cand)::BIGINT, round(avg(cand),6), round(avg(p_size),6) FROM c GROUP BY 2) SELECT group_col, group_value, total, candidates, candidate_rate, mean_p_size FROM (SELECT *, row_number() OVER (PARTITION BY group_col ORDER BY candidates DESC, group_value) AS k FROM g) WHERE k<=5""")
def g15_candidate_groups(spark, sf):
    d = raw_assets(spark, sf).withColumn("cand", (F.col("p_size") >= 30).cast("int"))
    return rounded(profile.candidate_groups(d, ["update_frequency", "p_brand"], "cand", ["p_size"], 5))


@query("g16_department_usage", f"{_A} SELECT department, 'view_count' AS metric, count(*) AS count, round(quantile_cont(view_count,0.5),6) AS median, round(avg(view_count),6) AS mean, sum((view_count<25)::INT)::BIGINT AS dormant, round(avg((view_count<25)::INT),6) AS dormant_share FROM asset GROUP BY 1")
def g16_department_usage(spark, sf):
    d = asset_usage(spark, sf)
    dormant = d.groupBy("department").agg(F.sum((F.col("view_count") < 25).cast("int")).alias("dormant"), F.avg((F.col("view_count") < 25).cast("int")).alias("dormant_share"))
    return rounded(profile.summary(d, ["view_count"], ("department",), ("count", "median", "mean")).join(dormant, "department"))


_LAYERS = "busy AS (SELECT 'busy' AS layer, * FROM asset WHERE view_count>=30 UNION ALL SELECT 'dear', * FROM asset WHERE price>=1500)"


def _layered(spark, sf):
    return asset_usage(spark, sf).withColumns({"busy": (F.col("view_count") >= 30).cast("int"), "dear": (F.col("price") >= 1500).cast("int")})


@query("g20_layer_dimensions", f"{_A}, {_LAYERS}, l AS ({long(['size', 'price'], 'layer', 'busy')}) SELECT layer, metric, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(stddev_samp(value),6) AS std_samp FROM l GROUP BY 1,2")
def g20_layer_dimensions(spark, sf):
    return rounded(profile.layer_profile(_layered(spark, sf), ["busy", "dear"], ["size", "price"], ("mean", "median", "std_samp")))


@query("g21_layer_scores", f"{_A}, {_LAYERS}, l AS ({long(['view_count'], 'layer', 'busy')}) SELECT layer, metric, count(*) AS count, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.25),6) AS p25, round(quantile_cont(value,0.75),6) AS p75, min(value) AS min, max(value) AS max FROM l GROUP BY 1,2")
def g21_layer_scores(spark, sf):
    return rounded(profile.layer_profile(_layered(spark, sf), ["busy", "dear"], ["view_count"], ("count", "mean", "median", "p25", "p75", "min", "max")))


@query("g23_mapped_counts", "SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE '缺失' END AS value, count(*) AS count, round(count(*)/(SELECT count(*) FROM documents),6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g23_mapped_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(profile.mapped_counts(d, "quality", {"1": "good", "0": "bad"}))


@query("g26_status_counts", f"{_RAW} SELECT coalesce(nullif({plain('scrape_status')},''),'缺失') AS value, count(*) AS count, round(count(*)/(SELECT count(*) FROM part),6) AS share FROM raw GROUP BY 1")
def g26_status_counts(spark, sf):
    return rounded(profile.value_counts(raw_assets(spark, sf), "scrape_status"))


_RUNS = "SELECT {k} AS amplitude, value/100 AS spearman, value/200 AS top_10_overlap, value/300 AS top_30_overlap FROM events"


@query("g27_perturbation_summary", "WITH r AS (" + _RUNS.format(k="event_type") + ") SELECT amplitude, " + ", ".join(f"round({f}({m}{a}),6) AS {m}_{n}" for m in ("spearman", "top_10_overlap", "top_30_overlap") for n, f, a in (("mean", "avg", ""), ("min", "min", ""), ("median", "quantile_cont", ",0.5"), ("max", "max", ""))) + " FROM r GROUP BY 1")
def g27_perturbation_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("amplitude"), (F.col("value") / 100).alias("spearman"), (F.col("value") / 200).alias("top_10_overlap"), (F.col("value") / 300).alias("top_30_overlap"))
    return rounded(profile.perturbation_summary(e))


@query("g28_fold_summary", "WITH f AS (SELECT event_type AS model, user_id%5 AS fold, avg(value) AS r2, stddev_pop(value) AS rmse, max(value) AS mae, min(value) AS spearman FROM events GROUP BY 1,2) SELECT model, " + ", ".join(f"round(avg({m}),6) AS {m}_mean, round(stddev_samp({m}),6) AS {m}_std" for m in ("r2", "rmse", "mae", "spearman")) + " FROM f GROUP BY 1")
def g28_fold_summary(spark, sf):
    per = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("r2"), F.stddev_pop("value").alias("rmse"), F.max("value").alias("mae"), F.min("value").alias("spearman"))
    return rounded(profile.fold_summary(per))


_SHARES = f"s AS (SELECT asset_id, {p01('price')} AS potential, {p01('view_count')} AS actual FROM asset)"
_FEW = sensitivity.scenarios({"a": ([0.5, 0.7], [0.3, 0.5], [0.1]), "b": ([0.6], [0.4, 0.6], [0.2, 0.3])})
_FEW_SQL = "g AS (SELECT set, p::DOUBLE AS p, a::DOUBLE AS a, g::DOUBLE AS g FROM (VALUES " + ", ".join(f"('{s}',{p},{a},{g})" for s, p, a, g in _FEW) + ") g(set,p,a,g))"


def _shares(spark, sf):
    return rank.add_percentiles(asset_usage(spark, sf), {"potential": "price", "actual": "view_count"})


@query("g29_sensitivity_summary", f"""{_A}, {_SHARES}, {_FEW_SQL}, x AS (SELECT set, p, a, g, sum((potential>=p AND actual<=a AND potential-actual>=g)::INT) AS c, sum((potential>=p AND actual<=a AND potential-actual>=g AND potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT) AS o, sum((potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT) AS b FROM s, g GROUP BY 1,2,3,4)
 SELECT set, count(*) AS scenarios, min(c)::BIGINT AS least, quantile_cont(c,0.5)::DOUBLE AS median, max(c)::BIGINT AS most, quantile_cont(o,0.5)::DOUBLE AS median_overlap, round(quantile_cont(o/(c+b-o),0.5),6) AS median_jaccard FROM x GROUP BY 1""")
def g29_sensitivity_summary(spark, sf):
    return rounded(sensitivity.set_summary(sensitivity.grid_summary(_shares(spark, sf), _FEW, "potential", "actual")))


@query("g31_group_attribution", f"""{_A}, l AS ({long(['size', 'price', 'view_count'], 'domain, asset_id')}), g AS (SELECT domain, metric AS feature, avg(abs(value-100)) AS m, count(*) AS n FROM l GROUP BY 1,2) SELECT 'domain' AS group_col, domain AS group_value, rank, feature, round(m,6) AS mean_abs, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY m DESC, feature) AS rank FROM g) WHERE rank<=2""")
def g31_group_attribution(spark, sf):
    d = asset_usage(spark, sf)
    phi = profile.melt(d.select("asset_id", "size", "price", "view_count"), ["asset_id"], ["size", "price", "view_count"]).select("asset_id", F.col("variable").alias("feature"), (F.col("value") - 100).alias("attribution"))
    return rounded(profile.group_attribution(phi, d, "asset_id", "domain", 2))


@query("g32_vote_counts", f"{_A} SELECT (view_count>=30)::INT+(price>=1500)::INT+(size>=40)::INT AS votes, count(*) AS count FROM asset GROUP BY 1")
def g32_vote_counts(spark, sf):
    d = _layered(spark, sf).withColumn("big", (F.col("size") >= 40).cast("int"))
    return sensitivity.vote_counts(sensitivity.votes(d, ["busy", "dear", "big"]))


# ---- ranks and statistics


@query("h3_percentile_zero", "WITH o AS (SELECT *, o_orderkey%700 AS g FROM orders) SELECT o_orderkey, round(CASE WHEN count(*) OVER (PARTITION BY g)>1 THEN (rank() OVER (PARTITION BY g ORDER BY o_custkey)+(count(*) OVER (PARTITION BY g,o_custkey)-1)/2.0-1)/(count(*) OVER (PARTITION BY g)-1) ELSE 0 END,6) AS p FROM o")
def h3_percentile_zero(spark, sf):
    o = table(spark, sf, "orders").withColumn("g", F.col("o_orderkey") % 700)
    return rounded(rank.add_percentile(o, "o_custkey", "p", ("g",), "zero").select("o_orderkey", "p"))


@query("h7_top_flags", f"{_A} SELECT asset_id, (row_number() OVER (ORDER BY view_count DESC, asset_id)<=greatest(1,ceil(count(*) OVER ()*0.1))) AS top_10, (row_number() OVER (ORDER BY view_count DESC, asset_id)<=greatest(1,ceil(count(*) OVER ()*0.3))) AS top_30 FROM asset")
def h7_top_flags(spark, sf):
    return rank.top_share_flags(asset_usage(spark, sf), "view_count", "asset_id", (0.1, 0.3)).select("asset_id", "top_10", "top_30")


_METRICS = "m AS (SELECT event_type||'/'||(user_id%3) AS model, avg(value) AS spearman, stddev_pop(value) AS rmse, max(value) AS mae FROM events GROUP BY 1)"


@query("h11_model_selection", f"WITH {_METRICS}, r AS (SELECT *, rank() OVER (ORDER BY spearman DESC)+rank() OVER (ORDER BY rmse)+rank() OVER (ORDER BY mae) AS rank_sum FROM m) SELECT model, rank_sum::INT AS rank_sum, row_number() OVER (ORDER BY rank_sum, spearman DESC, rmse)::INT AS place FROM r")
def h11_model_selection(spark, sf):
    m = table(spark, sf, "events").groupBy(F.concat("event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("model")).agg(F.avg("value").alias("spearman"), F.stddev_pop("value").alias("rmse"), F.max("value").alias("mae"))
    return sensitivity.model_selection(m).select("model", "rank_sum", "place")


@query("h13_batches", "SELECT event_id, floor((row_number() OVER (ORDER BY event_id)-1)/500)::BIGINT AS batch FROM events")
def h13_batches(spark, sf):
    return rank.batches(table(spark, sf, "events").select("event_id"), "event_id", 500)


@query("h15_running_shares", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, sum(n) OVER w::BIGINT AS cumulative_count, round(sum(n) OVER w/sum(n) OVER (),6) AS cumulative_share FROM c WINDOW w AS (ORDER BY n DESC, o_custkey)")
def h15_running_shares(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(rank.cumulative_share(c, "n", F.desc("n"), F.asc("o_custkey")).select("o_custkey", "cumulative_count", "cumulative_share"))


@query("h16_by_size", "SELECT c_custkey, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS place FROM customer")
def h16_by_size(spark, sf):
    return rank.by_size(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "place")


@query("i7_log_normalize", f"{_A}, x AS (SELECT asset_id, ln(1+greatest(view_count-20,0)) AS v FROM asset), b AS (SELECT quantile_cont(v,0.0) AS lo, quantile_cont(v,0.99) AS hi FROM x) SELECT asset_id, round((least(greatest(v,lo),hi)-lo)/(hi-lo),6) AS s FROM x, b")
def i7_log_normalize(spark, sf):
    d = asset_usage(spark, sf).withColumn("v", F.col("view_count") - 20)
    return rounded(stats.normalize_01(d, {"s": {"column": "v", "high": 0.99, "log": True}}).select("asset_id", "s"))


_GAPS = "x AS (SELECT size AS a, CASE WHEN asset_id%7>0 THEN price END AS b, CASE WHEN asset_id%5>0 THEN view_count END AS c FROM asset)"


def _pair(a: str, b: str) -> str:
    r = lambda x: f"rank() OVER (ORDER BY {x})+(count(*) OVER (PARTITION BY {x})-1)/2.0"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x,y),6) AS r FROM (SELECT {r(a)} AS x, {r(b)} AS y FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("i8_spearman_matrix", f"{_A}, {_GAPS} " + " UNION ALL ".join(_pair(a, b) for a, b in ("aa", "ab", "ac", "bb", "bc", "cc")))
def i8_spearman_matrix(spark, sf):
    k = F.col("asset_id")
    d = asset_usage(spark, sf).select(F.col("size").alias("a"), F.when(k % 7 > 0, F.col("price")).alias("b"), F.when(k % 5 > 0, F.col("view_count")).alias("c"))
    return rounded(stats.spearman_matrix(d, ["a", "b", "c"]))


@query("i13_cramers_v_two_by_two", f"""{_A}, c AS (SELECT view_count>=30 AS a, price>=1000 AS b, count(*) AS o FROM asset GROUP BY 1,2), ra AS (SELECT a, sum(o) AS x FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS y FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c), e AS (SELECT coalesce(o,0) AS o, x*y/n AS e, n FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c USING (a,b))
 SELECT round(sqrt(sum((abs(o-e)-least(0.5,abs(o-e)))*(abs(o-e)-least(0.5,abs(o-e)))/e)/max(n)),6) AS cramers_v, max(n)::BIGINT AS n FROM e""")
def i13_cramers_v_two_by_two(spark, sf):
    d = asset_usage(spark, sf).select((F.col("view_count") >= 30).alias("a"), (F.col("price") >= 1000).alias("b"))
    return rounded(stats.cramers_v(d, "a", "b"))


@query("i14_high_low", f"{_A}, {_SHARES} SELECT 'potential' AS metric, sum((potential>=0.5)::INT)::BIGINT AS high_use_count, sum((potential<0.5)::INT)::BIGINT AS low_use_count, round(avg((potential>=0.5)::INT),6) AS high_use_share FROM s UNION ALL SELECT 'actual', sum((actual>=0.5)::INT)::BIGINT, sum((actual<0.5)::INT)::BIGINT, round(avg((actual>=0.5)::INT),6) FROM s")
def i14_high_low(spark, sf):
    return rounded(profile.high_low_counts(_shares(spark, sf), ["potential", "actual"]))


_THIRTEEN = [0.0, 0.01, 0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 0.9, 0.95, 0.99, 1.0]


@query("i16_quantile_table", f"SELECT 'l_extendedprice' AS metric, share, round(value,6) AS value FROM (SELECT unnest({_THIRTEEN})::DOUBLE AS share, unnest(quantile_cont(l_extendedprice,{_THIRTEEN})) AS value FROM lineitem)")
def i16_quantile_table(spark, sf):
    return rounded(stats.quantiles(table(spark, sf, "lineitem"), ["l_extendedprice"], _THIRTEEN))


# ---- scores


@query("j3_actual_use_depth", f"""{_A}, c AS (SELECT *, {p01('ln(1+view_count)')} AS v, {p01('ln(1+download_count)')} AS d, {p01('ln(1+api_call_count)')} AS a FROM asset), e AS (SELECT asset_id, resource_type, v, d, a, CASE WHEN resource_type='product' THEN 0.4*v+0.6*d ELSE 0.3*v+0.7*a END AS depth FROM c)
 SELECT asset_id, round(v,6) AS view_score, round(d,6) AS download_score, round(a,6) AS api_score, round(depth,6) AS actual_depth FROM e""")
def j3_actual_use_depth(spark, sf):
    return rounded(scores.actual_use(asset_usage(spark, sf)).select("asset_id", "view_score", "download_score", "api_score", "actual_depth"))


def _norm(x: str, high: float, log: bool = False) -> str:
    v = f"ln(1+greatest({x},0))" if log else x
    return f"((least({v},(SELECT quantile_cont({v},{high}) FROM f))-(SELECT min({v}) FROM f))/((SELECT quantile_cont({v},{high}) FROM f)-(SELECT min({v}) FROM f)))"


_FEATURES = f"""{_RAW}, f AS (SELECT row_no, domain, update_frequency, spatial_level, note, (row_no%6)::DOUBLE AS kw, (row_no%30)::DOUBLE AS title, p_size::DOUBLE AS dsc, (p_size*2)::DOUBLE AS fc, (row_no%17)::DOUBLE AS fd, (row_no%23)::DOUBLE AS rc, (row_no%19)::DOUBLE AS ds, (row_no%8)::DOUBLE AS fmt, (row_no%2)::DOUBLE AS two, (row_no%3=0)::INT AS three, (row_no%400)::DOUBLE AS days, (row_no%14)::DOUBLE AS rec FROM raw)"""
_DAYS = "(SELECT quantile_cont(days,0.95) FROM f)"


@query("j6_seven_dimensions", f"""{_FEATURES} SELECT row_no, round(least(0.75*{scored('domain', {'民生服务': 0.95, '道路交通': 0.85, '文化休闲': 0.6, '气象服务': 0.65}, 0.6)}+0.25*{_norm('kw', 0.99)},1),6) AS topic_public_value,
 round(0.25*{_norm('title', 0.95)}+0.35*{_norm('dsc', 0.95)}+0.25*two+0.15*{_norm('kw', 0.99)},6) AS semantic_clarity, round(0.35*{_norm('fc', 0.99, True)}+0.25*{_norm('fd', 0.99, True)}+0.25*{_norm('rc', 0.99)}+0.15*{_norm('ds', 0.99)},6) AS data_richness,
 round(0.35*least(fmt,5)/5+0.25*two+0.25*three+0.1*two+0.03*three+0.02*two,6) AS machine_readability, round(least(0.65*{scored('update_frequency', {'每天': 0.95, '每年': 0.45, '静态数据': 0.25, '即时': 1.0, '每季度': 0.65}, 0.4)}+0.35*(1-least(days,{_DAYS})/{_DAYS}),1)*CASE WHEN three=1 THEN 0.9 ELSE 1 END,6) AS timeliness,
 round(0.3*two+0.2*({plain('note')} NOT IN ('','-','--','—','无','暂无'))::INT+0.2*three+0.2*two+0.1*{scored('spatial_level', {'市级': 0.85, '区级': 0.75}, 0.5)},6) AS spatiotemporal_capability,
 round(0.25*least(fmt,5)/5+0.2*three+0.2*{_norm('fd', 0.99, True)}+0.15*ln(1+least(rec,10))/ln(11)*CASE WHEN two=1 THEN 0.35 ELSE 1 END+0.1*three+0.1*two,6) AS combinability FROM f""")
def j6_seven_dimensions(spark, sf):
    k, two, three = F.col("row_no"), (F.col("row_no") % 2).cast("double"), (F.col("row_no") % 3 == 0).cast("int")
    made = {"scene_keyword_count": k % 6, "title_len": k % 30, "description_len": F.col("p_size"), "description_has_field_hint": two, "field_count": F.col("p_size") * 2, "field_description_count": k % 17, "record_count_log": k % 23, "data_size_log": k % 19, "format_count": k % 8}
    made |= {"has_csv": two, "has_json": three, "has_xlsx": two, "has_xml": three, "has_rdf": two, "update_recency_days": k % 400, "date_order_anomaly": three, "has_meaningful_time_scope": two, "has_time_field": three, "has_geo_field": two, "has_standard_field_description": three}
    made |= {"recommended_count": k % 14, "recommended_suspicious": two, "spatial_admin_level": F.col("spatial_level"), "detail_spatial_scope": F.col("note")}
    names = ("topic_public_value", "semantic_clarity", "data_richness", "machine_readability", "timeliness", "spatiotemporal_capability", "combinability")
    return rounded(scores.seven_dimensions(raw_assets(spark, sf).withColumns(made)).select("row_no", *names))


_ENTROPY = """ew AS (SELECT (1-e1)/(3-e1-e2-e3) AS v1, (1-e2)/(3-e1-e2-e3) AS v2, (1-e3)/(3-e1-e2-e3) AS v3 FROM (SELECT (ln(sum(a))-sum(a*ln(a))/sum(a))/ln(count(*)) AS e1, (ln(sum(b))-sum(b*ln(b))/sum(b))/ln(count(*)) AS e2, (ln(sum(c))-sum(c*ln(c))/sum(c))/ln(count(*)) AS e3
 FROM (SELECT size_score+1e-12 AS a, price_score+1e-12 AS b, name_score+1e-12 AS c FROM dims)))"""
_THREE = f"{_A}, {DIMS}, {WEIGHTS}, {_ENTROPY}, pots AS (SELECT asset_id, view_count, round(size_score*w1+price_score*w2+name_score*w3,9) AS pc, round((size_score+price_score+name_score)/3,9) AS pe, round(size_score*v1+price_score*v2+name_score*v3,9) AS pn FROM dims, wt, ew)"


@query("j7_three_composites", f"{_THREE} SELECT asset_id, pc AS potential_critic, pe AS potential_equal, pn AS potential_entropy FROM pots")
def j7_three_composites(spark, sf):
    return rounded(scores.potential_use(asset_dimensions(spark, sf), list(DIMENSIONS)).select("asset_id", "potential_critic", "potential_equal", "potential_entropy"), 9)


@query("j8_dormancy", f"{_A}, {_SHARES} SELECT asset_id, round(potential-actual,6) AS dormant_score, (potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT AS candidate, CASE WHEN potential>=0.5 AND actual>=0.5 THEN 'high_high' WHEN potential>=0.5 THEN 'high_low' WHEN actual<0.5 THEN 'low_low' ELSE 'low_high' END AS quadrant FROM s")
def j8_dormancy(spark, sf):
    return rounded(scores.dormancy(_shares(spark, sf), "potential", "actual").select("asset_id", "dormant_score", "candidate", "quadrant"))


_FLAGS = f"f AS (SELECT asset_id, potential, actual, (potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT AS rule, (asset_id%3=0)::INT AS m1, CASE asset_id%4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS m2 FROM s)"


def _flags(spark, sf):
    k = F.col("asset_id")
    d = _shares(spark, sf)
    return d.select("asset_id", "potential", "actual", scores.is_candidate("potential", "actual").cast("int").alias("rule"), (k % 3 == 0).cast("int").alias("m1"), F.when(k % 4 == 0, 1).when(k % 4 > 1, 0).alias("m2"))


@query("j11_high_confidence", f"{_A}, {_SHARES}, {_FLAGS} SELECT asset_id, (rule=1 AND m1=1)::INT AS high_confidence, (rule=1 AND coalesce(m2,0)=1)::INT AS second FROM f")
def j11_high_confidence(spark, sf):
    return _flags(spark, sf).select("asset_id", sensitivity.high_confidence("rule", "m1").alias("high_confidence"), sensitivity.high_confidence("rule", "m2").alias("second"))


@query("j12_high_potential", f"{_A}, {_SHARES} SELECT asset_id, round(potential,6) AS potential FROM s WHERE potential>=0.7")
def j12_high_potential(spark, sf):
    return rounded(sensitivity.high_potential(_shares(spark, sf), "potential", "asset_id", ["asset_id", "potential"]))


# ---- sensitivity


def scenario_sql(base: dict[str, float], draws: list) -> str:
    """Spearman with the base score and overlaps of the best rows for each draw of weights."""
    total = lambda w: "0.0::DOUBLE+" + "+".join(f"{c}*{v!r}::DOUBLE" for c, v in w.items())
    rows = " UNION ALL ".join(f"SELECT asset_id, '{n}' AS draw, {total(base)} AS b, {total(w)} AS s FROM dims" for n, w in draws)
    avg = lambda x: f"rank() OVER (PARTITION BY draw ORDER BY {x})+(count(*) OVER (PARTITION BY draw,{x})-1)/2.0"
    return f"""{_A}, {DIMS}, x AS ({rows}), r AS (SELECT draw, {avg('b')} AS rb, {avg('s')} AS rs, rank() OVER (PARTITION BY draw ORDER BY b DESC) AS kb, rank() OVER (PARTITION BY draw ORDER BY s DESC) AS ks, count(*) OVER (PARTITION BY draw) AS n FROM x)
 SELECT draw, round(corr(rs,rb),6) AS spearman, round(sum((kb<=ceil(n*0.1) AND ks<=ceil(n*0.1))::INT)/ceil(max(n)*0.1),6) AS top_10_overlap, round(sum((kb<=ceil(n*0.3) AND ks<=ceil(n*0.3))::INT)/ceil(max(n)*0.3),6) AS top_30_overlap FROM r GROUP BY 1"""


_BASE = dict(zip(DIMENSIONS, (0.5, 0.3, 0.2)))
_DRAWS = [(f"draw {k}", dict(zip(DIMENSIONS, w))) for k, w in enumerate([(0.5, 0.3, 0.2), (0.4, 0.4, 0.2), (0.6, 0.2, 0.2), (0.2, 0.3, 0.5)])]


@query("k4_fixed_weights", scenario_sql(_BASE, _DRAWS))
def k4_fixed_weights(spark, sf):
    return rounded(sensitivity.weight_scenarios(written(asset_dimensions(spark, sf), "dimensions"), "asset_id", _BASE, _DRAWS))


@query("k6_leave_one_out", scenario_sql({c: 1 / 3 for c in DIMENSIONS}, sensitivity.leave_one_out({c: 1 / 3 for c in DIMENSIONS})))
def k6_leave_one_out(spark, sf):
    base = {c: 1 / 3 for c in DIMENSIONS}
    return rounded(sensitivity.weight_scenarios(written(asset_dimensions(spark, sf), "dimensions"), "asset_id", base, sensitivity.leave_one_out(base)))


@query("k2_membership", f"{_A}, {_SHARES} SELECT asset_id, " + ", ".join(f"(potential>={p} AND actual<={a} AND potential-actual>={g})::INT AS s{k}" for k, (_, p, a, g) in enumerate(_FEW)) + " FROM s")
def k2_membership(spark, sf):
    return sensitivity.membership(_shares(spark, sf), _FEW, "potential", "actual").select("asset_id", *[f"s{k}" for k in range(len(_FEW))])


@query("k3_robustness_rank", f"""{_A}, {_SHARES}, n AS (SELECT asset_id, potential-actual AS gap, ({'+'.join(f"(potential>={p} AND actual<={a} AND potential-actual>={g})::INT" for _, p, a, g in _FEW)}) AS t FROM s), v AS (SELECT asset_id, t, round(t/{len(_FEW)}+(1-{p01('gap')}),12) AS v FROM n)
 SELECT asset_id, t::INT AS times_selected, rank() OVER (ORDER BY v DESC) AS robustness_rank FROM v""")
def k3_robustness_rank(spark, sf):
    return sensitivity.selection_frequency(_shares(spark, sf), _FEW, "potential", "actual").select("asset_id", "times_selected", "robustness_rank")


@query("k5_scheme_comparison", f"""{_THREE}, q AS (SELECT {p01('view_count')} AS a, {p01('pc')} AS c, {p01('pe')} AS e, {p01('pn')} AS n FROM pots), k AS (SELECT (c>=0.7 AND a<=0.5 AND c-a>=0.3)::INT AS c, (e>=0.7 AND a<=0.5 AND e-a>=0.3)::INT AS e, (n>=0.7 AND a<=0.5 AND n-a>=0.3)::INT AS n FROM q)
 SELECT 'critic' AS scheme, sum(c)::BIGINT AS candidates, sum(c)::BIGINT AS overlap, 1.0::DOUBLE AS jaccard FROM k UNION ALL SELECT 'equal', sum(e)::BIGINT, sum(e*c)::BIGINT, round(sum(e*c)/sum(greatest(e,c)),6) FROM k UNION ALL SELECT 'entropy', sum(n)::BIGINT, sum(n*c)::BIGINT, round(sum(n*c)/sum(greatest(n,c)),6) FROM k""")
def k5_scheme_comparison(spark, sf):
    d = written(asset_dimensions(spark, sf), "dimensions")
    d = scores.weighted_score(d, list(DIMENSIONS), scores.critic_weights(d, list(DIMENSIONS)), "pc")
    d = scores.weighted_score(d, list(DIMENSIONS), scores.entropy_weights(d, list(DIMENSIONS)), "pn")
    d = d.withColumn("pe", sum((F.col(c) for c in DIMENSIONS), F.lit(0.0)) / 3).withColumns({c: F.round(c, 9) for c in ("pc", "pe", "pn")})
    d = rank.add_percentiles(d, {"a": "view_count", "critic": "pc", "equal": "pe", "entropy": "pn"})
    return rounded(sensitivity.scheme_comparison(d, {c: c for c in ("critic", "equal", "entropy")}, "a", "critic"))


_NEAR = sensitivity.neighbours((0.70, 0.50, 0.30), 0.05)


@query("k7_neighbours", f"{_A}, {_SHARES}, g AS (SELECT p::DOUBLE AS p, a::DOUBLE AS a, g::DOUBLE AS g FROM (VALUES " + ", ".join(f"({p},{a},{g})" for _, p, a, g in _NEAR) + """) g(p,a,g)), x AS (SELECT g.*, (potential>=p AND actual<=a AND potential-actual>=g)::INT AS c, (potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT AS b FROM s, g)
 SELECT p AS potential, a AS actual, g AS gap, sum(c)::BIGINT AS candidates, sum(c*b)::BIGINT AS overlap, round(sum(c*b)/sum(greatest(c,b)),6) AS jaccard, p=0.7 AND a=0.5 AND g=0.3 AS is_base FROM x GROUP BY 1,2,3""")
def k7_neighbours(spark, sf):
    return rounded(sensitivity.grid_summary(_shares(spark, sf), _NEAR, "potential", "actual").select("potential", "actual", "gap", "candidates", "overlap", "jaccard", "is_base"))


@query("k8_residual_columns", f"{_A}, r AS (SELECT asset_id, {p01('view_count')} AS actual, {p01('price')} AS x, {p01('size')} AS y FROM asset) SELECT asset_id, round(x,6) AS expected_x_percentile, round(y-actual,6) AS dormant_score_y, (x>=0.7 AND actual<=0.5 AND x-actual>=0.3)::INT AS strict_x, (y>=0.7 AND actual<=0.5 AND y-actual>=0.3)::INT AS strict_y FROM r")
def k8_residual_columns(spark, sf):
    d = rank.add_percentile(asset_usage(spark, sf), "view_count", "actual")
    return rounded(sensitivity.residual_columns(d, {"x": "price", "y": "size"}, "actual").select("asset_id", "expected_x_percentile", "dormant_score_y", "strict_x", "strict_y"))


@query("k12_extreme_cases", f"{_A}, {_SHARES}, {_FLAGS} SELECT asset_id, rule+m1+coalesce(m2,0) AS votes FROM f WHERE (rule=1 AND m1=1) OR rule=1 OR m2=1")
def k12_extreme_cases(spark, sf):
    d = sensitivity.votes(_flags(spark, sf), ["rule", "m1", "m2"]).withColumn("strict", sensitivity.high_confidence("rule", "m1"))
    return sensitivity.extreme_cases(d, "strict", "rule", ["m2", "no_such_flag"], "votes", "potential", "asset_id").select("asset_id", "votes")


@query("k13_pools", f"{_A}, {_SHARES}, {_FLAGS} SELECT 'rule' AS pool, asset_id, round(potential,6) AS potential FROM f WHERE rule=1 UNION ALL SELECT 'second', asset_id, round(potential,6) FROM f WHERE m2=1")
def k13_pools(spark, sf):
    pools = sensitivity.candidate_pools(_flags(spark, sf), {"rule": "rule", "second": "m2", "none": "no_such_flag"}, ["asset_id", "potential", "no_such_column"], ("potential",), "asset_id")
    out = [d.withColumn("pool", F.lit(n)) for n, d in pools.items()]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


@query("k14_model_candidates", f"{_A}, {_SHARES}, {_FLAGS} SELECT 'one' AS model, sum(m1)::BIGINT AS candidates, round(avg(m1),6) AS share, sum(m1*rule)::BIGINT AS with_rule, 1 AS is_selected FROM f UNION ALL SELECT 'two', sum(coalesce(m2,0))::BIGINT, round(avg(coalesce(m2,0)),6), sum(coalesce(m2,0)*rule)::BIGINT, 0 FROM f")
def k14_model_candidates(spark, sf):
    return rounded(sensitivity.model_candidates(_flags(spark, sf), {"one": "m1", "two": "m2"}, "rule", "one"))


# ---- models


def _frame(spark, sf):
    return asset_usage(spark, sf).withColumn("label", F.log1p("view_count"))


@query("p1_folds", "SELECT count(*) AS rows, 5::BIGINT AS folds, count(DISTINCT o_orderkey) AS ids, true AS balanced FROM orders")
def p1_folds(spark, sf):
    d = ml.with_folds(table(spark, sf, "orders"), "o_orderkey")
    n = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("folds"), (F.max("n") < 1.5 * F.min("n")).alias("balanced"))
    return n.crossJoin(F.broadcast(d.agg(F.countDistinct("o_orderkey", "fold").alias("ids"))))


@query("p2_each_id_once", f"{_A} SELECT asset_id, 1::BIGINT AS times FROM asset")
def p2_each_id_once(spark, sf):
    from pyspark.ml import Pipeline

    d = _frame(spark, sf)
    model = ml.ridge_for(d, 5.0, share=0.8)
    p = ml.out_of_fold(d, "asset_id", lambda: Pipeline(stages=[*ml.feature_stages(["size", "price"], ["domain"]), model.copy()]))
    return p.where("prediction is not null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("times"))


@query("p3_rare_bucket", "WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n>=30 THEN p_name ELSE '<rare>' END AS level FROM part JOIN n USING (p_name)")
def p3_rare_bucket(spark, sf):
    return ml.with_rare_bucket(table(spark, sf, "part"), ["p_name"], 30).select("p_partkey", F.col("p_name").alias("level"))


@query("p4_imputed_and_scaled", "WITH f AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey%4>0 THEN p_size END,(SELECT quantile_disc(p_size,0.5) FROM part WHERE p_partkey%4>0))::DOUBLE AS x FROM part) SELECT p_partkey, round((x-(SELECT avg(x) FROM f))/(SELECT stddev_samp(x) FROM f),6) AS x FROM f")
def p4_imputed_and_scaled(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).cast("double").alias("x"))
    out = Pipeline(stages=ml.feature_stages(["x"], [])).fit(d).transform(d)
    return rounded(out.select("p_partkey", vector_to_array("features")[0].alias("x")))


@query("p6_char_grams", "WITH w AS (SELECT ' '||unnest(string_split(lower(p_name),' '))||' ' AS w FROM part), g AS (SELECT w, unnest(range(2,5)) AS n FROM w), c AS (SELECT substr(w,i::INT,n::INT) AS gram FROM (SELECT w, n, unnest(range(1,greatest(length(w)-n+1,1)+1)) AS i FROM g)) SELECT gram, count(*) AS n FROM c GROUP BY 1")
def p6_char_grams(spark, sf):
    return table(spark, sf, "part").select(F.explode(ml.char_grams("p_name")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("p7_ridge", f"{_A}, d AS (SELECT size AS x, price AS y FROM asset) SELECT round(covar_pop(x,y)*count(*)/(var_pop(x)*count(*)+500),4) AS slope, round(avg(y)-avg(x)*covar_pop(x,y)*count(*)/(var_pop(x)*count(*)+500),3) AS intercept FROM d")
def p7_ridge(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["size"], outputCol="features").transform(asset_usage(spark, sf).select("size", F.col("price").alias("label")))
    m = ml.ridge_for(d, 500.0).setTol(1e-12).setMaxIter(500).fit(d)
    return d.agg(F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"), F.round(F.lit(float(m.intercept)), 3).alias("intercept"))


@query("p11_potential_model", "SELECT count(*) AS rows, least(count(*),100) AS top100, least(count(*),300) AS top300, (count(*)*(count(*)+1)/2)::BIGINT AS rank_sum, true AS shares_hold FROM part")
def p11_potential_model(spark, sf):
    d, _ = ml.potential_model(asset_usage(spark, sf), "asset_id", ["name"], ["domain", "department"], ["size", "price"], "view_count")
    inside = F.col("potential_ml_percentile").between(0, 1) & (F.abs(F.col("dormant_score")) <= 1) & (F.col("quadrant") != "unclassified")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.sum("dormant_top100").alias("top100"), F.sum("dormant_top300").alias("top300"), F.sum("dormant_rank").alias("rank_sum"), F.min(inside).alias("shares_hold"))


_PREDICTED = f"{_A}, d AS (SELECT asset_id%5 AS fold, 'near' AS model, view_count AS y, view_count+(asset_id%7) AS p FROM asset UNION ALL SELECT asset_id%5, 'far', view_count, size FROM asset)"


@query("p13_model_comparison", f"""{_PREDICTED}, r AS (SELECT *, rank() OVER (PARTITION BY model,fold ORDER BY y)+(count(*) OVER (PARTITION BY model,fold,y)-1)/2.0 AS ry, rank() OVER (PARTITION BY model,fold ORDER BY p)+(count(*) OVER (PARTITION BY model,fold,p)-1)/2.0 AS rp FROM d)
 SELECT model, fold, count(*) AS n, round(1-sum((y-p)*(y-p))/(var_pop(y)*count(*)),6) AS r2, round(avg(abs(y-p)),6) AS mae, round(sqrt(avg((y-p)*(y-p))),6) AS rmse, round(corr(ry,rp),6) AS spearman, CASE model WHEN 'near' THEN 1 ELSE 2 END AS place FROM r GROUP BY 1,2""")
def p13_model_comparison(spark, sf):
    k = F.col("asset_id")
    a = asset_usage(spark, sf)
    near = a.select((k % 5).alias("fold"), F.lit("near").alias("model"), F.col("view_count").alias("y"), (F.col("view_count") + k % 7).alias("p"))
    far = a.select((k % 5).alias("fold"), F.lit("far").alias("model"), F.col("view_count").alias("y"), F.col("size").alias("p"))
    per_fold, per_model = ml.model_comparison(near.unionByName(far), "y", "p")
    return rounded(per_fold.drop("pearson").join(per_model.select("model", "place"), "model"))


@query("p14_importance_summary", "WITH f AS (SELECT event_type AS feature, user_id%5 AS fold, avg(value) AS i FROM events GROUP BY 1,2) SELECT feature, round(avg(i),6) AS mean, round(stddev_samp(i),6) AS std FROM f GROUP BY 1")
def p14_importance_summary(spark, sf):
    per = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("importance"))
    return rounded(ml.importance_summary(per))


@query("p16_attributions_add_up", "SELECT least(count(*),3000) AS rows, true AS add_up FROM part")
def p16_attributions_add_up(spark, sf):
    d = _frame(spark, sf).select("asset_id", "size", "price", "domain", "label")
    model = ml.fit_pipeline(d, ml.feature_stages(["size", "price"], ["domain"]), ml.ridge_for(d, 1.0))
    features = ["size", "price", "domain"]
    phi = ml.shapley(model, d, features, "asset_id", rows=3000).groupBy("asset_id").agg(F.sum("attribution").alias("total"))
    base = model.transform(profile.seeded_sample(d, "asset_id", 10, 8)).agg(F.avg("prediction").alias("base"))
    j = model.transform(d).select("asset_id", "prediction").join(phi, "asset_id").crossJoin(F.broadcast(base))
    return j.agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("total") - (F.col("prediction") - F.col("base")))) < 1e-6).alias("add_up"))


@query("p18_direction", f"""{_A}, r AS (SELECT rank() OVER (ORDER BY size)+(count(*) OVER (PARTITION BY size)-1)/2.0 AS x, rank() OVER (ORDER BY price-900)+(count(*) OVER (PARTITION BY price-900)-1)/2.0 AS y, price-900 AS a FROM asset), e AS (SELECT corr(x,y) AS e, avg(abs(a)) AS ma, avg(a) AS ms FROM r)
 SELECT round(e,6) AS effect, CASE WHEN e>0.05 THEN 'positive' WHEN e<-0.05 THEN 'negative' ELSE 'flat' END AS direction, round(ma,6) AS mean_abs, round(ms,6) AS mean_signed FROM e""")
def p18_direction(spark, sf):
    d = asset_usage(spark, sf).select("size", (F.col("price") - 900).alias("a"))
    return rounded(ml.direction(d, "size", "a"))


@query("m8_sample_missing", "SELECT event_id FROM events WHERE event_type='error' ORDER BY event_id LIMIT 20")
def m8_sample_missing(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("  ").alias("kind"))
    return monitor.sample_missing(d, ["kind"], "event_id").select("event_id")


@query("m3_window_report", """WITH b AS (SELECT *, floor((row_number() OVER (ORDER BY event_id)-1)/400) AS batch FROM events) SELECT batch::BIGINT AS batch, count(*) AS rows, (epoch(date_trunc('second',max(ts)))-epoch(date_trunc('second',min(ts))))::BIGINT AS elapsed_seconds,
 sum((event_type='error')::INT)::BIGINT AS missing_kind, sum((event_type<>'error')::INT)::BIGINT AS complete_rows, round(avg((event_type<>'error')::INT),4) AS complete_rate, 0::BIGINT AS mojibake_rows FROM b GROUP BY 1""")
def m3_window_report(spark, sf):
    d = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    aggregates = monitor.qa_aggregates(["kind"], "ts", ["props"])
    return monitor.qa_by_count(d, "event_id", 400, aggregates).select("batch", "rows", "elapsed_seconds", "missing_kind", "complete_rows", "complete_rate", "mojibake_rows")


@query("j13_recomputation", f"""{SCORED}, f AS (SELECT asset_id, (potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3) AS flag FROM pot), s AS (SELECT asset_id, flag AS stored, flag<>(asset_id%97=0) AS altered FROM f)
 SELECT sum((f.flag<>s.stored)::INT)::BIGINT AS mismatches, sum((f.flag<>s.altered)::INT)::BIGINT AS altered_mismatches FROM f JOIN s USING (asset_id)""")
def j13_recomputation(spark, sf):
    from assetlens.plans import queries

    d = written(scored_assets(spark, sf), "scored")
    stored = written(queries.flagship_from(d).select("asset_id", F.lit(1).alias("stored")), "flagship")
    d = d.join(stored, "asset_id", "full").withColumn("stored", F.coalesce("stored", F.lit(0)))
    d = d.withColumn("altered", F.when(F.col("asset_id") % 97 == 0, 1 - F.col("stored")).otherwise(F.col("stored")))
    again = scores.is_candidate("potential", "actual")
    out = scores.recomputation_mismatches(d, "stored", again)
    return out.crossJoin(F.broadcast(scores.recomputation_mismatches(d, "altered", again).withColumnRenamed("mismatches", "altered_mismatches")))
