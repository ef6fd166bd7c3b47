"""Registered queries of the core library over the given tables: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Floats are rounded on both sides, so that the order of summing can't matter. A query without SQL is tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlens.functions import catalog as C
from assetlens.functions import hooks
from assetlens.functions import text as T
from assetlens.operators import merge, profile, quality, rank, scores, sensitivity, stats
from assetlens.plans.registry import ORACLES, QUERIES, query, rounded
from assetlens.plans.views import ASSET, DIMENSIONS, DIMS, SCORED, WEIGHTS, asset_dimensions, asset_usage, p01, scored_assets, table
from assetlens.scratch import written
from assetlens.streaming import monitor

# ---- flagship and scores


@query("flagship_candidates", f"""{SCORED} SELECT asset_id, resource_type, round(potential,6) AS potential, round(actual,6) AS actual, round(potential-actual,6) AS dormant_score,
 row_number() OVER (ORDER BY round(potential-actual,9) DESC, asset_id) AS rank FROM pot WHERE potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3""")
def flagship_candidates(spark, sf):
    return flagship_from(scored_assets(spark, sf))


def flagship_from(scored):
    """Ranked candidates of scored assets."""
    d = scored.withColumn("gap", F.round(F.col("potential") - F.col("actual"), 9))
    d = d.where(scores.is_candidate("potential", "actual"))
    d = rank.first_rank(d, "gap", "asset_id")
    return rounded(d.select("asset_id", "resource_type", "potential", "actual", F.col("gap").alias("dormant_score"), "rank"))


@query("j_scored_assets", f"{SCORED} SELECT asset_id, round(actual,6) AS actual, round(potential,6) AS potential, CASE WHEN potential>=0.5 AND actual>=0.5 THEN 'high_high' WHEN potential>=0.5 THEN 'high_low' WHEN actual<0.5 THEN 'low_low' ELSE 'low_high' END AS quadrant FROM pot")
def j_scored_assets(spark, sf):
    return rounded(scored_assets(spark, sf).select("asset_id", "actual", "potential", scores.quadrant("potential", "actual").alias("quadrant")))


_CRITIC = f"""WITH {ASSET}, {DIMS}, m AS (SELECT stddev_pop(size_score) AS s1, stddev_pop(price_score) AS s2, stddev_pop(name_score) AS s3, corr(size_score,price_score) AS a, corr(size_score,name_score) AS b, corr(price_score,name_score) AS c FROM dims),
 x AS (SELECT 'size_score' AS dimension, s1 AS std, 2-a-b AS conflict FROM m UNION ALL SELECT 'price_score', s2, 2-a-c FROM m UNION ALL SELECT 'name_score', s3, 2-b-c FROM m)
 SELECT dimension, round(std,6) AS std, round(conflict,6) AS conflict, round(std*conflict,6) AS information, round(std*conflict/sum(std*conflict) OVER (),6) AS weight FROM x"""


@query("j4_critic_weights", _CRITIC)
def j4_critic_weights(spark, sf):
    return rounded(scores.critic_weights(asset_dimensions(spark, sf), list(DIMENSIONS)))


@query("j5_entropy_weights", f"""WITH {ASSET}, {DIMS}, l AS (SELECT 'size_score' AS dimension, size_score+1e-12 AS x FROM dims UNION ALL SELECT 'price_score', price_score+1e-12 FROM dims UNION ALL SELECT 'name_score', name_score+1e-12 FROM dims),
 e AS (SELECT dimension, (ln(sum(x))-sum(x*ln(x))/sum(x))/ln(count(*)) AS entropy FROM l GROUP BY 1) SELECT dimension, round(entropy,6) AS entropy, round((1-entropy)/sum(1-entropy) OVER (),6) AS weight FROM e""")
def j5_entropy_weights(spark, sf):
    return rounded(scores.entropy_weights(asset_dimensions(spark, sf), list(DIMENSIONS)))


@query("j1_pca_diagnostics", f"WITH {ASSET} SELECT resource_type, count(*) AS n, round(corr(view_count,download_count),6) AS r, round((1+abs(corr(view_count,download_count)))/2,6) AS explained_ratio FROM asset GROUP BY 1")
def j1_pca_diagnostics(spark, sf):
    return rounded(scores.pca_diagnostics(asset_usage(spark, sf), "view_count", "download_count", ("resource_type",)))


@query("j2_actual_use_variants", f"""WITH {ASSET}, c AS (SELECT *, {p01('ln(1+view_count)')} AS view_score, {p01('ln(1+download_count)')} AS ds, {p01('ln(1+api_call_count)')} AS aps FROM asset),
 e AS (SELECT asset_id, resource_type, view_score, round((view_score+CASE WHEN resource_type='product' THEN ds ELSE aps END)/2,9) AS eq FROM c)
 SELECT asset_id, round(view_score,6) AS view_score, round({p01('eq', 'resource_type')},6) AS actual_equal_percentile FROM e""")
def j2_actual_use_variants(spark, sf):
    d = scores.actual_use(asset_usage(spark, sf)).withColumn("eq", F.round("actual_equal", 9)).drop("actual_equal_percentile")
    return rounded(rank.add_percentile(d, "eq", "actual_equal_percentile", ("resource_type",)).select("asset_id", "view_score", "actual_equal_percentile"))


@query("j7_potential_equal", f"WITH {ASSET}, {DIMS} SELECT asset_id, round((size_score+price_score+name_score)/3,6) AS potential_equal FROM dims")
def j7_potential_equal(spark, sf):
    return rounded(scores.potential_use(asset_dimensions(spark, sf), list(DIMENSIONS)).select("asset_id", "potential_equal"))


# ---- ranks


@query("h1_percentile_01", f"WITH {ASSET} SELECT asset_id, round({p01('view_count')},6) AS p FROM asset")
def h1_percentile_01(spark, sf):
    return rounded(rank.add_percentile(asset_usage(spark, sf), "view_count", "p").select("asset_id", "p"))


@query("h1_percentile_lineitem", f"SELECT l_orderkey, l_linenumber, round({p01('l_extendedprice')},6) AS p FROM lineitem")
def h1_percentile_lineitem(spark, sf):
    return rounded(rank.add_percentile(table(spark, sf, "lineitem"), "l_extendedprice", "p").select("l_orderkey", "l_linenumber", "p"))


@query("h2_percentile_rank", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice)+(count(*) OVER (PARTITION BY o_totalprice)-1)/2.0)/count(*) OVER (),6) AS p FROM orders")
def h2_percentile_rank(spark, sf):
    return rounded(rank.add_percentile(table(spark, sf, "orders"), "o_totalprice", "p", kind="pct").select("o_orderkey", "p"))


@query("h4_percentile_within_type", f"WITH {ASSET} SELECT asset_id, round({p01('download_count', 'resource_type')},6) AS p FROM asset")
def h4_percentile_within_type(spark, sf):
    return rounded(rank.add_percentile(asset_usage(spark, sf), "download_count", "p", ("resource_type",)).select("asset_id", "p"))


@query("h5_first_rank", f"WITH {ASSET} SELECT asset_id, row_number() OVER (ORDER BY view_count DESC, asset_id) AS rank FROM asset")
def h5_first_rank(spark, sf):
    return rank.first_rank(asset_usage(spark, sf), "view_count", "asset_id").select("asset_id", "rank")


@query("h6_min_rank", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS rank FROM customer")
def h6_min_rank(spark, sf):
    return rank.with_ranks(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", rank.min_rank(descending=True).alias("rank"))


@query("h7_top_100_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def h7_top_100_orders(spark, sf):
    return rank.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("h9_top_overlap", f"""WITH {ASSET}, r AS (SELECT row_number() OVER (ORDER BY view_count DESC, asset_id) AS a, row_number() OVER (ORDER BY price DESC, asset_id) AS b, greatest(1,ceil(count(*) OVER ()*0.2)) AS k FROM asset)
 SELECT 'view_count' AS metric_a, 'price' AS metric_b, 0.2::DOUBLE AS top_share, sum((a<=k)::INT)::BIGINT AS top_n, sum((a<=k AND b<=k)::INT)::BIGINT AS overlap_count, round(sum((a<=k AND b<=k)::INT)/sum((a<=k)::INT),6) AS overlap_rate FROM r""")
def h9_top_overlap(spark, sf):
    return rounded(rank.top_overlap(asset_usage(spark, sf), "view_count", "price", "asset_id", 0.2))


@query("h14_slow_runs", "SELECT event_id, round(avg(value) OVER w,6) AS rolling_mean, count(value) OVER w = 5 AND avg(value) OVER w > 25 AS slow FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)")
def h14_slow_runs(spark, sf):
    return rounded(rank.rolling_mean_alert(table(spark, sf, "events"), ("user_id",), "event_id", "value", 5, 25.0).select("event_id", "rolling_mean", "slow"))


@query("h17_top_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank<=3")
def h17_top_per_group(spark, sf):
    return rank.per_group_top(table(spark, sf, "orders"), ("o_custkey",), 3, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank"))


# ---- statistics


@query("i1_gini", "SELECT round(2*sum(i*x)/(count(*)*sum(x))-(count(*)+1)/count(*),6) AS gini FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders)")
def i1_gini(spark, sf):
    return rounded(stats.gini(table(spark, sf, "orders"), "o_totalprice"))


@query("i2_top_share", "SELECT round(sum(x) FILTER (i<=k)/sum(x),6) AS top_share FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice DESC) AS i, greatest(1,ceil(count(*) OVER ()*0.01)) AS k FROM lineitem)")
def i2_top_share(spark, sf):
    return rounded(stats.top_share(table(spark, sf, "lineitem"), "l_extendedprice", 0.01))


@query("i3_lorenz", """WITH r AS (SELECT o_totalprice AS x, rank() OVER (ORDER BY o_totalprice)-1+count(*) OVER (PARTITION BY o_totalprice) AS hi, count(*) OVER () AS n FROM orders), s AS (SELECT ceil(hi*20/n) AS slot, sum(x) AS s, count(*) AS c FROM r GROUP BY 1)
 SELECT 0.0::DOUBLE AS population_share, 0.0::DOUBLE AS value_share UNION ALL SELECT round(sum(c) OVER w/sum(c) OVER (),6), round(sum(s) OVER w/sum(s) OVER (),6) FROM s WINDOW w AS (ORDER BY slot)""")
def i3_lorenz(spark, sf):
    return rounded(stats.lorenz(table(spark, sf, "orders"), "o_totalprice"))


@query("i4_quantiles", """SELECT metric, share, round(value,6) AS value FROM (SELECT 'o_totalprice' AS metric, unnest([0.5,0.9,0.99])::DOUBLE AS share, unnest(quantile_cont(o_totalprice,[0.5,0.9,0.99])) AS value FROM orders)""")
def i4_quantiles(spark, sf):
    return rounded(stats.quantiles(table(spark, sf, "orders"), ["o_totalprice"], [0.5, 0.9, 0.99]))


@query("i5_winsorize", "SELECT o_orderkey, round(least(o_totalprice,(SELECT quantile_cont(o_totalprice,0.99) FROM orders)),6) AS w FROM orders")
def i5_winsorize(spark, sf):
    return rounded(stats.winsorize(table(spark, sf, "orders"), "o_totalprice", 0.99, "w").select("o_orderkey", "w"))


@query("i6_normalize", f"WITH {ASSET}, {DIMS} SELECT asset_id, round(size_score,6) AS size_score, round(price_score,6) AS price_score, round(name_score,6) AS name_score FROM dims")
def i6_normalize(spark, sf):
    return rounded(asset_dimensions(spark, sf).select("asset_id", *DIMENSIONS))


@query("i8_pearson_matrix", f"""WITH {ASSET} SELECT 'size' AS a,'size' AS b,round(corr(size,size),6) AS r FROM asset UNION ALL SELECT 'size','price',round(corr(size,price),6) FROM asset UNION ALL SELECT 'size','view_count',round(corr(size,view_count),6) FROM asset
 UNION ALL SELECT 'price','price',round(corr(price,price),6) FROM asset UNION ALL SELECT 'price','view_count',round(corr(price,view_count),6) FROM asset UNION ALL SELECT 'view_count','view_count',round(corr(view_count,view_count),6) FROM asset""")
def i8_pearson_matrix(spark, sf):
    return rounded(stats.pearson_matrix(asset_usage(spark, sf), ["size", "price", "view_count"]))


#: Simpson's rule in SQL: the integral of a function of s from 0 to an end, over 4001 nodes.
NODES = "(SELECT i, CASE WHEN i IN (0,4000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END AS w FROM range(4001) t(i)) nodes"


def simpson(f: str, end: str) -> str:
    return f"(sum(w*({f.replace('s*s', f'pow({end}*i/4000.0,2)')}))*max({end})/12000.0)"


@query("n3_correlation_matrix", f"""WITH {ASSET} SELECT 'size' AS a, 1.0::DOUBLE AS size, round(corr(size,price),6) AS price, round(corr(size,view_count),6) AS view_count FROM asset UNION ALL SELECT 'price', round(corr(size,price),6), 1.0, round(corr(price,view_count),6) FROM asset
 UNION ALL SELECT 'view_count', round(corr(size,view_count),6), round(corr(price,view_count),6), 1.0 FROM asset""")
def n3_correlation_matrix(spark, sf):
    names = ["size", "price", "view_count"]
    return rounded(profile.symmetric_matrix(stats.pearson_matrix(asset_usage(spark, sf), names), names))


@query("s1_sql_functions", """SELECT p_partkey, round(least(greatest(p_size/10.0-1,0),1),6) AS clipped, trim(p_brand)='' AS blank FROM part""")
def s1_sql_functions(spark, sf):
    """Two of the library's column functions, called by name from SQL text."""
    hooks.register(spark, "clip_share", T.clip01, x="double")
    hooks.register(spark, "blank_text", T.is_blank, x="string")
    return rounded(spark.sql("SELECT p_partkey, clip_share(p_size / 10.0D - 1) AS clipped, blank_text(p_brand) AS blank FROM {part}", part=table(spark, sf, "part")))


@query("s2_terms_table", """WITH t AS (SELECT p_partkey, unnest(string_split(p_name||'; '||p_brand||' ;;'||p_type,';')) AS t, unnest(range(3+1)) AS position FROM part) SELECT p_partkey, position::INT AS position, trim(t) AS term FROM t WHERE trim(t)<>''""")
def s2_terms_table(spark, sf):
    hooks.register_terms(spark)
    return spark.sql("SELECT p_partkey, t.position, t.term FROM {part} p, LATERAL terms(concat(p_name, '; ', p_brand, ' ;;', p_type)) t", part=table(spark, sf, "part"))


@query("i9_spearman", f"""WITH {ASSET}, r AS (SELECT rank() OVER (ORDER BY view_count)+(count(*) OVER (PARTITION BY view_count)-1)/2.0 AS x, rank() OVER (ORDER BY download_count)+(count(*) OVER (PARTITION BY download_count)-1)/2.0 AS y FROM asset)
, s AS (SELECT corr(x,y) AS rho, count(*) AS n FROM r)
 SELECT round(rho,9) AS rho, n, round(1-2*{simpson('pow(1-s*s,n/2.0-2)', 'abs(rho)')}/exp(lgamma(0.5)+lgamma(n/2.0-1)-lgamma(n/2.0-0.5)),9) AS p FROM s, {NODES} GROUP BY rho, n""")
def i9_spearman(spark, sf):
    return rounded(stats.spearman(asset_usage(spark, sf), "view_count", "download_count"), 9)


#: Statistics in SQL get their p from the integral of the density.
_RANKED = "r AS (SELECT g, v, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0 AS k, count(*) OVER (PARTITION BY v) AS t, count(*) OVER () AS n FROM s)"


@query("i10_mann_whitney", f"""WITH {ASSET}, s AS (SELECT resource_type AS g, view_count AS v FROM asset), {_RANKED}, p AS (SELECT g, count(*) AS m, sum(k) AS rs, quantile_cont(v,0.5) AS med FROM r GROUP BY 1), t AS (SELECT sum(t*t-1.0) AS ts, max(n)::DOUBLE AS n FROM r),
 u AS (SELECT a.m AS n1, b.m AS n2, a.med AS median1, b.med AS median2, a.rs-a.m*(a.m+1)/2 AS u, ts, n FROM p a, p b, t WHERE a.g<b.g)
, z AS (SELECT *, (abs(u-n1*n2/2)-0.5)/sqrt(n1*n2/12.0*(n+1-ts/(n*(n-1)))) AS z FROM u)
 SELECT n1, n2, median1, median2, u, round(z,9) AS z, CASE WHEN z<=0 THEN 1 ELSE round(1-2*{simpson('exp(-s*s/2)/sqrt(2*pi())', 'z')},9) END AS p, round(2*u/(n1*n2)-1,9) AS delta FROM z, {NODES} GROUP BY n1, n2, median1, median2, u, z""")
def i10_mann_whitney(spark, sf):
    return rounded(stats.mann_whitney(asset_usage(spark, sf), "resource_type", "view_count"), 9)


@query("i12_kruskal", f"""WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), {_RANKED}, q AS (SELECT sum(rs*rs/m) AS q, count(*) AS k FROM (SELECT g, sum(k) AS rs, count(*) AS m FROM r GROUP BY 1)), t AS (SELECT sum(t*t-1.0) AS ts, max(n)::DOUBLE AS n FROM r),
 h AS (SELECT (12/(n*(n+1))*q-3*(n+1))/(1-ts/(n*n*n-n)) AS h, k, n FROM q, t)
 SELECT round(h,9) AS h, round(1-{simpson('2*pow(s*s,(k-2)/2.0)*exp(-s*s/2)', 'sqrt(h)')}/(pow(2,(k-1)/2.0)*gamma((k-1)/2.0)),9) AS p, k, n::BIGINT AS n, round(greatest(0,(h-k+1)/(n-k)),9) AS epsilon_squared FROM h, {NODES} GROUP BY h, k, n""")
def i12_kruskal(spark, sf):
    return rounded(stats.kruskal(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), 9)


@query("i13_cramers_v", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1,2), ra AS (SELECT a, sum(o) AS x FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS y FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c)
 SELECT round(sqrt(sum((coalesce(o,0)-x*y/n)*(coalesce(o,0)-x*y/n)/(x*y/n))/max(n)/least((SELECT count(*) FROM ra)-1,(SELECT count(*) FROM cb)-1)),6) AS cramers_v, max(n)::BIGINT AS n FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c USING (a,b)""")
def i13_cramers_v(spark, sf):
    return rounded(stats.cramers_v(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("i15_regression_metrics", f"""WITH {ASSET}, d AS (SELECT resource_type, view_count AS y, download_count/20 AS p FROM asset), r AS (SELECT *, rank() OVER (PARTITION BY resource_type ORDER BY y)+(count(*) OVER (PARTITION BY resource_type,y)-1)/2.0 AS ry, rank() OVER (PARTITION BY resource_type ORDER BY p)+(count(*) OVER (PARTITION BY resource_type,p)-1)/2.0 AS rp FROM d)
 SELECT resource_type, count(*) AS n, round(1-sum((y-p)*(y-p))/(var_pop(y)*count(*)),6) AS r2, round(avg(abs(y-p)),6) AS mae, round(sqrt(avg((y-p)*(y-p))),6) AS rmse, round(corr(y,p),6) AS pearson, round(corr(ry,rp),6) AS spearman FROM r GROUP BY 1""")
def i15_regression_metrics(spark, sf):
    return rounded(stats.regression_metrics(asset_usage(spark, sf).withColumn("p", F.col("download_count") / 20), "view_count", "p", ("resource_type",)))


@query("i17_set_overlap", f"WITH {ASSET}, f AS (SELECT (view_count>=30)::INT AS a, (price>=1500)::INT AS b FROM asset) SELECT sum(a)::BIGINT AS size_a, sum(b)::BIGINT AS size_b, sum(a*b)::BIGINT AS common, sum(greatest(a,b))::BIGINT AS united, round(sum(a*b)/sum(greatest(a,b)),6) AS jaccard FROM f")
def i17_set_overlap(spark, sf):
    d = asset_usage(spark, sf).select((F.col("view_count") >= 30).alias("a"), (F.col("price") >= 1500).alias("b"))
    return rounded(stats.set_overlap(d, "a", "b"))


# ---- profiles


@query("g1_value_counts", "SELECT p_type AS value, count(*) AS count, round(count(*)/sum(count(*)) OVER (),6) AS share FROM part GROUP BY 1")
def g1_value_counts(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "part"), "p_type"))


@query("g3_flag_prevalence", f"""WITH {ASSET}, f AS (SELECT (download_count>0)::INT AS d, (api_call_count>0)::INT AS a, (view_count>0)::INT AS v FROM asset) SELECT 'view_count' AS name, sum(v)::BIGINT AS count, round(avg(v),6) AS share FROM f
 UNION ALL SELECT 'download_count', sum(d)::BIGINT, round(avg(d),6) FROM f UNION ALL SELECT 'api_call_count', sum(a)::BIGINT, round(avg(a),6) FROM f""")
def g3_flag_prevalence(spark, sf):
    return rounded(profile.flag_prevalence(asset_usage(spark, sf), ["view_count", "download_count", "api_call_count"]))


@query("g4_thresholds", "SELECT 'over_1e5' AS name, sum((o_totalprice>100000)::INT)::BIGINT AS count, round(avg((o_totalprice>100000)::INT),6) AS share FROM orders UNION ALL SELECT 'over_3e5', sum((o_totalprice>300000)::INT)::BIGINT, round(avg((o_totalprice>300000)::INT),6) FROM orders")
def g4_thresholds(spark, sf):
    return rounded(profile.named_counts(table(spark, sf, "orders"), {"over_1e5": F.col("o_totalprice") > 100_000, "over_3e5": F.col("o_totalprice") > 300_000}))


@query("g5_crosstab", "SELECT o_orderpriority, sum((o_orderstatus='F')::INT)::BIGINT AS F, sum((o_orderstatus='O')::INT)::BIGINT AS O, sum((o_orderstatus='P')::INT)::BIGINT AS P FROM orders GROUP BY 1")
def g5_crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("g6_row_percent", "SELECT o_orderpriority, round(avg((o_orderstatus='F')::INT),6) AS F, round(avg((o_orderstatus='O')::INT),6) AS O, round(avg((o_orderstatus='P')::INT),6) AS P FROM orders GROUP BY 1")
def g6_row_percent(spark, sf):
    return rounded(profile.row_percent(profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]), "o_orderpriority"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("g7_cooccurrence", "WITH u AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM u x JOIN u y USING (user_id) GROUP BY 1,2")
def g7_cooccurrence(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").pivot("event_type", _TYPES).count()
    return profile.cooccurrence(per, _TYPES)


@query("g8_pareto", "SELECT value, count, round(share,6) AS share, sum(count) OVER w::BIGINT AS cumulative_count, round(sum(share) OVER w,6) AS cumulative_share FROM (SELECT p_brand AS value, count(*) AS count, count(*)/sum(count(*)) OVER () AS share FROM part GROUP BY 1) WINDOW w AS (ORDER BY count DESC, value) ORDER BY count DESC, value LIMIT 10")
def g8_pareto(spark, sf):
    return rounded(profile.pareto(table(spark, sf, "part"), "p_brand", 10))


@query("g9_long_tail", f"WITH {ASSET}, l AS (SELECT 'view_count' AS metric, view_count AS value FROM asset UNION ALL SELECT 'download_count', download_count FROM asset) SELECT metric, count(value) AS count, sum((value=0)::INT)::BIGINT AS zero_count, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.99),6) AS p99, max(value) AS max FROM l GROUP BY 1")
def g9_long_tail(spark, sf):
    return rounded(profile.summary(asset_usage(spark, sf), ["view_count", "download_count"], (), ("count", "zero_count", "mean", "median", "p90", "p99", "max")))


@query("g10_conversion", f"WITH {ASSET} SELECT resource_type, round(avg(download_count/(view_count+1)),6) AS mean, round(quantile_cont(download_count/(view_count+1),0.5),6) AS median, round(max((download_count+api_call_count)/(view_count+1)),6) AS most FROM asset GROUP BY 1")
def g10_conversion(spark, sf):
    d = asset_usage(spark, sf).withColumns(C.conversion_ratios("view_count", "download_count", "api_call_count"))
    median = profile.summary(d, ["download_conversion"], ("resource_type",), ("mean", "median")).drop("metric")
    return rounded(median.join(d.groupBy("resource_type").agg(F.max("overall_conversion").alias("most")), "resource_type"))


@query("g12_summary_by_type", f"WITH {ASSET}, l AS (SELECT resource_type, 'price' AS metric, price AS value FROM asset UNION ALL SELECT resource_type, 'size', size FROM asset) SELECT resource_type, metric, count(*) AS count, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.1),6) AS p10, round(quantile_cont(value,0.9),6) AS p90, round(stddev_pop(value),6) AS std_pop, round(stddev_samp(value),6) AS std_samp FROM l GROUP BY 1,2")
def g12_summary_by_type(spark, sf):
    return rounded(profile.summary(asset_usage(spark, sf), ["price", "size"], ("resource_type",), ("count", "mean", "median", "p10", "p90", "std_pop", "std_samp")))


@query("g14_stacked_profile", f"WITH {ASSET} SELECT 'domain' AS group_col, domain AS group_value, count(*) AS count, round(avg(price),6) AS mean_price FROM asset GROUP BY 2 UNION ALL SELECT 'department', department, count(*), round(avg(price),6) FROM asset GROUP BY 2")
def g14_stacked_profile(spark, sf):
    return rounded(profile.stacked_profile(asset_usage(spark, sf), ["domain", "department"], {"count": F.count(F.lit(1)), "mean_price": F.avg("price")}))


@query("g17_quadrants", f"{SCORED}, q AS (SELECT CASE WHEN potential>=0.5 AND actual>=0.5 THEN 'high_high' WHEN potential>=0.5 THEN 'high_low' WHEN actual<0.5 THEN 'low_low' ELSE 'low_high' END AS quadrant, potential FROM pot), o AS (SELECT * FROM (VALUES (0,'high_high'),(1,'high_low'),(2,'low_low'),(3,'low_high'),(4,'unclassified')) o(position,quadrant)) SELECT position, o.quadrant, count(q.quadrant) AS count, round(avg(potential),6) AS mean_potential FROM o LEFT JOIN q USING (quadrant) GROUP BY 1,2")
def g17_quadrants(spark, sf):
    d = scored_assets(spark, sf).withColumn("quadrant", scores.quadrant("potential", "actual"))
    return rounded(profile.quadrant_summary(d, "quadrant", ["high_high", "high_low", "low_low", "low_high", "unclassified"], ["potential"]))


@query("g18_layer_summary", f"""WITH {ASSET}, f AS (SELECT *, (view_count>=30)::INT AS busy, (price>=1500)::INT AS dear, 0 AS none FROM asset), l AS (SELECT 0 AS position, 'busy' AS layer, price FROM f WHERE busy=1 UNION ALL SELECT 1, 'dear', price FROM f WHERE dear=1)
 SELECT o.position, o.layer, count(l.price) AS count, round(avg(l.price),6) AS mean_price FROM (VALUES (0,'busy'),(1,'dear'),(2,'none')) o(position,layer) LEFT JOIN l USING (layer) GROUP BY 1,2""")
def g18_layer_summary(spark, sf):
    d = asset_usage(spark, sf).withColumns({"busy": (F.col("view_count") >= 30).cast("int"), "dear": (F.col("price") >= 1500).cast("int"), "none": F.lit(0)})
    return rounded(profile.layer_summary(d, ["busy", "dear", "none"], {"count": F.count(F.lit(1)), "mean_price": F.avg("price")}))


@query("g19_layer_groups", f"WITH {ASSET}, l AS (SELECT 'busy' AS layer, domain FROM asset WHERE view_count>=30 UNION ALL SELECT 'dear', domain FROM asset WHERE price>=1500) SELECT layer, 'domain' AS group_col, domain AS group_value, count(*) AS count, round(count(*)/sum(count(*)) OVER (PARTITION BY layer),6) AS share FROM l GROUP BY 1,3")
def g19_layer_groups(spark, sf):
    d = asset_usage(spark, sf).withColumns({"busy": (F.col("view_count") >= 30).cast("int"), "dear": (F.col("price") >= 1500).cast("int")})
    return rounded(profile.layer_group_profile(d, ["busy", "dear"], ["domain"]))


@query("g22_bins", """SELECT name, coalesce(count,0)::BIGINT AS count, round(coalesce(count,0)/(SELECT count(*) FROM part),6) AS share FROM (VALUES ('(0,2]'),('(2,5]'),('(5,10]'),('(10,20]'),('(20,inf)')) b(name) LEFT JOIN
 (SELECT CASE WHEN p_size<=2 THEN '(0,2]' WHEN p_size<=5 THEN '(2,5]' WHEN p_size<=10 THEN '(5,10]' WHEN p_size<=20 THEN '(10,20]' ELSE '(20,inf)' END AS name, count(*) AS count FROM part WHERE p_size>0 GROUP BY 1) USING (name)""")
def g22_bins(spark, sf):
    return rounded(profile.binned_counts(table(spark, sf, "part"), "p_size", [0, 2, 5, 10, 20]))


@query("g24_term_counts", "SELECT term, count(*) AS count FROM (SELECT unnest(string_split(p_name,' ')) AS term FROM part) GROUP BY 1")
def g24_term_counts(spark, sf):
    return profile.term_counts(table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(";")).alias("x")), "x")


@query("f13_full_vs_covered", """WITH f AS (SELECT lang AS value, count(*) AS full_count, count(*)/sum(count(*)) OVER () AS fs FROM documents GROUP BY 1), m AS (SELECT lang AS value, count(*) AS main_count, count(*)/sum(count(*)) OVER () AS ms FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
 SELECT value, coalesce(full_count,0) AS full_count, round(coalesce(fs,0),6) AS full_share, coalesce(main_count,0) AS main_count, round(coalesce(ms,0),6) AS main_share, round(coalesce(ms,0)-coalesce(fs,0),6) AS share_difference FROM f FULL JOIN m USING (value)""")
def f13_full_vs_covered(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return rounded(profile.compare_counts(docs, docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), "lang"))


@query("n1_melt", f"WITH {ASSET} SELECT asset_id, 'size' AS variable, size AS value FROM asset UNION ALL SELECT asset_id, 'price', price FROM asset")
def n1_melt(spark, sf):
    return profile.melt(asset_usage(spark, sf).select("asset_id", "size", "price"), ["asset_id"], ["size", "price"])


# ---- sensitivity


#: Two sets of 27; 0.50 is in both, so some scenarios count twice in K3.
_GRID = sensitivity.scenarios({"three_points": ([0.2, 0.5, 0.8],) * 3, "quartiles": ([0.25, 0.5, 0.75],) * 3})
_GRID_SQL = "VALUES " + ", ".join(f"('{s}',{p},{a},{g})" for s, p, a, g in _GRID)


@query("k1_threshold_grid", f"""{SCORED}, g AS (SELECT set, potential::DOUBLE AS p, actual::DOUBLE AS a, gap::DOUBLE AS g FROM ({_GRID_SQL}) g(set,potential,actual,gap)), x AS (SELECT g.*, (potential>=p AND actual<=a AND potential-actual>=g)::INT AS c, (potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3)::INT AS b FROM pot, g)
 SELECT set, p AS potential, a AS actual, g AS gap, sum(c)::BIGINT AS candidates, round(avg(c),6) AS share, sum(c*b)::BIGINT AS overlap, round(sum(c*b)/sum(b),6) AS overlap_of_base, round(sum(c*b)/sum(greatest(c,b)),6) AS jaccard, p=0.7 AND a=0.5 AND g=0.3 AS is_base FROM x GROUP BY 1,2,3,4""")
def k1_threshold_grid(spark, sf):
    return rounded(sensitivity.grid_summary(scored_assets(spark, sf), _GRID, "potential", "actual"))


@query("k3_selection_frequency", f"""{SCORED}, g AS (SELECT potential::DOUBLE AS p, actual::DOUBLE AS a, gap::DOUBLE AS g FROM ({_GRID_SQL}) g(set,potential,actual,gap)) SELECT asset_id, sum((potential>=p AND actual<=a AND potential-actual>=g)::INT)::INT AS times_selected FROM pot, g GROUP BY 1""")
def k3_selection_frequency(spark, sf):
    return sensitivity.selection_frequency(scored_assets(spark, sf), _GRID, "potential", "actual").select("asset_id", "times_selected")


def _perturbation_sql() -> str:
    """The draws' factors are seeded and don't depend on the weights, so SQL can apply the same ones to the weights that it finds."""
    draws = sensitivity.perturbed_weights(dict.fromkeys(DIMENSIONS, 1.0), [0.1, 0.2], 200, 42)
    rows = ",".join(f"('{n}',{','.join(f'{w[c]!r}' for c in DIMENSIONS)})" for n, w in draws)
    avg = lambda x: f"rank() OVER (PARTITION BY draw ORDER BY {x})+(count(*) OVER (PARTITION BY draw,{x})-1)/2.0"
    return f"""WITH {ASSET}, {DIMS}, {WEIGHTS}, f AS (SELECT draw, f1::DOUBLE AS f1, f2::DOUBLE AS f2, f3::DOUBLE AS f3 FROM (VALUES {rows}) v(draw,f1,f2,f3)),
 x AS (SELECT draw, size_score*w1+price_score*w2+name_score*w3 AS b, (size_score*w1*f1+price_score*w2*f2+name_score*w3*f3)/(w1*f1+w2*f2+w3*f3) AS s FROM dims, wt, f),
 r AS (SELECT draw, {avg('b')} AS rb, {avg('s')} AS rs, rank() OVER (PARTITION BY draw ORDER BY b DESC) AS kb, rank() OVER (PARTITION BY draw ORDER BY s DESC) AS ks, count(*) OVER (PARTITION BY draw) AS n FROM x)
 SELECT draw, round(corr(rs,rb),6) AS spearman, round(sum((kb<=ceil(n*0.1) AND ks<=ceil(n*0.1))::INT)/ceil(max(n)*0.1),6) AS top_10_overlap, round(sum((kb<=ceil(n*0.3) AND ks<=ceil(n*0.3))::INT)/ceil(max(n)*0.3),6) AS top_30_overlap FROM r GROUP BY 1"""


@query("k4_weight_perturbation", _perturbation_sql())
def k4_weight_perturbation(spark, sf):
    d = written(asset_dimensions(spark, sf), "dimensions")
    base = {r.dimension: r.weight for r in scores.critic_weights(d, list(DIMENSIONS)).collect()}
    base = {c: base[c] for c in DIMENSIONS}
    return rounded(sensitivity.weight_scenarios(d, "asset_id", base, sensitivity.perturbed_weights(base, [0.1, 0.2], 200, 42)))


@query("k9_quantile_layers", f"""{SCORED}, s AS (SELECT *, potential-actual AS d, actual<=0.5 AS lu, potential>=0.7 AND actual<=0.5 AND potential-actual>=0.3 AS ru FROM pot), c AS (SELECT quantile_cont(d,0.9) AS a, quantile_cont(d,0.8) FILTER (ru) AS b FROM s) SELECT asset_id, (lu AND d>=a)::INT AS low_use_p90, (ru AND d>=b)::INT AS rule_p80 FROM s, c""")
def k9_quantile_layers(spark, sf):
    d = scored_assets(spark, sf).withColumn("d", F.col("potential") - F.col("actual"))
    out = sensitivity.quantile_layers(d, "d", F.col("actual") <= 0.5, scores.is_candidate("potential", "actual"), (0.9,), (0.8,))
    return out.select("asset_id", "low_use_p90", "rule_p80")


@query("k11_layer_overlap", f"""WITH {ASSET}, f AS (SELECT (view_count>=30)::INT AS busy, (price>=1500)::INT AS dear, (size>=40)::INT AS rule FROM asset) SELECT 'busy' AS layer, sum(busy)::BIGINT AS count, round(avg(busy),6) AS share, sum(busy*rule)::BIGINT AS common, round(sum(busy*rule)/sum(greatest(busy,rule)),6) AS jaccard FROM f
 UNION ALL SELECT 'dear', sum(dear)::BIGINT, round(avg(dear),6), sum(dear*rule)::BIGINT, round(sum(dear*rule)/sum(greatest(dear,rule)),6) FROM f""")
def k11_layer_overlap(spark, sf):
    d = asset_usage(spark, sf).withColumns({"busy": (F.col("view_count") >= 30).cast("int"), "dear": (F.col("price") >= 1500).cast("int"), "rule": (F.col("size") >= 40).cast("int")})
    return rounded(sensitivity.layer_overlap(d, ["busy", "dear"], "rule"))


@query("k10_votes", f"WITH {ASSET}, f AS (SELECT asset_id, (view_count>=30)::INT+(price>=1500)::INT+(size>=40)::INT AS v FROM asset) SELECT asset_id, v AS votes, (v>=1)::INT AS any_vote, (v>=2)::INT AS two_votes, (v>=3)::INT AS three_votes FROM f")
def k10_votes(spark, sf):
    d = asset_usage(spark, sf).withColumns({"a": (F.col("view_count") >= 30).cast("int"), "b": (F.col("price") >= 1500).cast("int"), "c": (F.col("size") >= 40).cast("int")})
    return sensitivity.votes(d, ["a", "b", "c"]).select("asset_id", "votes", "any_vote", "two_votes", "three_votes")


# ---- merges over the event log: id = user, seq = event, status = event type


def _log(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("").alias("amount"))


@query("f1_keep_last", "SELECT id, seq, status FROM (SELECT user_id AS id, event_id AS seq, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k=1")
def f1_keep_last(spark, sf):
    return merge.keep_last(_log(spark, sf).select("id", "seq", "status"), "id", "seq")


@query("f2_merge_prefer_nonempty", "SELECT c_custkey AS id, coalesce(CASE WHEN m>25 THEN 'big' END, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT user_id, max(value) AS m FROM events GROUP BY 1) ON user_id=c_custkey")
def f2_merge_prefer_nonempty(spark, sf):
    cp = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.when(F.max("value") > 25, "big").otherwise("").alias("segment"))
    return merge.merge_prefer_nonempty(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), cp, "id")


@query("f3_upsert", "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type,event_id) AS status, arg_max(value,event_id) FILTER (event_type<>'error') AS amount FROM events GROUP BY 1")
def f3_upsert(spark, sf):
    log = _log(spark, sf)
    old = merge.upsert(log.where("seq % 2 = 0").limit(0), log.where("seq < 3000"), "id", "seq", ["status"])
    return merge.upsert(old, log.where("seq >= 3000"), "id", "seq", ["status"]).withColumn("amount", T.to_number("amount"))


@query("f4_overlay", "SELECT c_custkey AS id, m AS segment FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type,event_id) AS m FROM events GROUP BY 1) ON user_id=c_custkey")
def f4_overlay(spark, sf):
    cp = merge.keep_last(_log(spark, sf).select("id", "seq", F.col("status").alias("segment")), "id", "seq").select("id", "segment")
    return merge.overlay(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), cp, "id", ["segment"])


@query("f6_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type='purchase' AND value>20)")
def f6_pending(spark, sf):
    done = table(spark, sf, "events").where("event_type = 'purchase' and value > 20").select(F.col("user_id").alias("c_custkey"), F.lit("success").alias("s"))
    return merge.pending(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey", "s", "c_custkey")


@query("f9_best_attempt", "SELECT user_id AS id, event_id AS attempt, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type='view') DESC, CASE WHEN event_type='view' THEN 0 ELSE value END DESC, event_id) AS k FROM events) WHERE k=1")
def f9_best_attempt(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("issues"), "value")
    return merge.best_attempt(d, "id", "attempt", "issues", "value").select("id", "attempt", "value")


@query("l6_retry_queue", "SELECT conv_id, turn, 'missing_role' AS retry_reason FROM conversations WHERE role='user'")
def l6_retry_queue(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") != "user", F.col("role")).alias("role"))
    return merge.retry_queue(d, "conv_id", ["role"]).select("conv_id", "turn", "retry_reason")


# ---- text and quality


@query("b1_normalize_space", "SELECT conv_id, turn, trim(regexp_replace(text,'\\s+',' ','g')) AS t FROM conversations")
def b1_normalize_space(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_space("text").alias("t"))


@query("b7_parse_number", "SELECT event_id, TRY_CAST(regexp_extract(props,'-?\\d+(\\.\\d+)?') AS DOUBLE) AS k FROM events")
def b7_parse_number(spark, sf):
    return table(spark, sf, "events").select("event_id", T.parse_number("props").alias("k"))


@query("b18_split_terms", "SELECT doc_id, len([x for x in regexp_split_to_array(text,'[;；|,\\n\\r\\t]') if trim(x)<>''])::INT AS terms FROM documents")
def b18_split_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.split_terms("text")).alias("terms"))


@query("b24_keyword_count", "SELECT doc_id, (contains(text,'the')::INT+contains(text,'de')::INT+contains(text,'und')::INT+contains(text,'que')::INT)::INT AS n FROM documents")
def b24_keyword_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.distinct_keyword_count("text", ("the", "de", "und", "que")).alias("n"))


@query("b31_date_features", f"WITH {ASSET} SELECT asset_id, date_diff('day',first_date::DATE,DATE '2025-01-01')::INT AS publication_age_days, date_diff('day',last_date::DATE,DATE '2025-01-01')::INT AS update_recency_days, date_diff('day',first_date::DATE,last_date::DATE)::INT AS maintenance_span_days FROM asset")
def b31_date_features(spark, sf):
    d = asset_usage(spark, sf)
    return d.select("asset_id", *[c.alias(n) for n, c in C.date_features("first_date", "last_date", F.lit("2025-01-01")).items()])


@query("d4_sample_gate", "SELECT conv_id, turn, (role='assistant')::INT AS is_scrape_success, (role='assistant' AND length(trim(text))>0)::INT AS is_core_complete FROM conversations")
def d4_sample_gate(spark, sf):
    d = table(spark, sf, "conversations").withColumn("scrape_status", F.when(F.col("role") == "assistant", "success").otherwise("failed"))
    return quality.sample_gate(d, ["text"]).select("conv_id", "turn", "is_scrape_success", "is_core_complete")


@query("g25_missing_report", "SELECT 'text' AS column, sum((trim(text)='')::INT)::BIGINT AS missing, sum((trim(text)='' AND role='user')::INT)::BIGINT AS missing_in_success FROM conversations")
def g25_missing_report(spark, sf):
    return profile.missing_report(table(spark, sf, "conversations"), ["text"], F.col("role") == "user")


# ---- monitoring


@query("m3_qa_by_count", "SELECT floor((row_number() OVER (ORDER BY event_id)-1)/500)::BIGINT AS batch, event_id, ts, event_type FROM events".join(("SELECT batch, count(*) AS rows, round(avg((event_type<>'error')::INT),4) AS ok_rate FROM (", ") GROUP BY 1")))
def m3_qa_by_count(spark, sf):
    return monitor.qa_by_count(table(spark, sf, "events"), "event_id", 500, {"rows": F.count(F.lit(1)), "ok_rate": F.round(F.avg((F.col("event_type") != "error").cast("double")), 4)})


@query("m5_qa_by_time", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts)+INTERVAL 1 DAY AS window_end, count(*) AS rows, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def m5_qa_by_time(spark, sf):
    return monitor.qa_by_time(table(spark, sf, "events"), "ts", "1 day", {"rows": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)})


@query("m4_recent_alert", "SELECT count(*) AS rows, max(ts) AS last_time, CASE WHEN sum((event_type='error')::INT)>=3 THEN 'missing_kind' ELSE '' END AS issues FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def m4_recent_alert(spark, sf):
    d = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return monitor.recent_alert(d, "ts", "event_id", ["kind"], [])


# ---- models: rows only


def _model_frame(spark, sf):
    return asset_usage(spark, sf).withColumn("label", F.log1p("view_count"))


@query("p2_out_of_fold_ridge", None)
def p2_out_of_fold_ridge(spark, sf):
    from pyspark.ml import Pipeline

    from assetlens.operators import ml

    d = _model_frame(spark, sf)
    model = ml.ridge_for(d, 5.0, share=0.8)
    return ml.out_of_fold(d, "asset_id", lambda: Pipeline(stages=[*ml.feature_stages(["size", "price", "name_length"], ["domain", "department"]), model.copy()]))


@query("p17_partial_dependence", None)
def p17_partial_dependence(spark, sf):
    from assetlens.operators import ml

    d = written(_model_frame(spark, sf).select("asset_id", "size", "price", "domain", "label"), "model-frame")
    model = ml.fit_pipeline(d, ml.feature_stages(["size", "price"], ["domain"], bins=32), ml.ClassForest(ml.random_forest()))
    return ml.partial_dependence(model, d, "price", "asset_id", sample=None)


# ---- the other modules of entries register themselves
from assetlens.plans import entries_learning, entries_models, entries_pages, entries_quality, entries_streams, entries_tables, entries_text  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
