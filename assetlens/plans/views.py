"""Views over the given tables that stand for a catalog of assets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: usage counters from its line items; the counters are summed before the join."""
    use = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("view_count"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("download_count"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("api_call_count"), F.min("l_shipdate").alias("first_date"), F.max("l_shipdate").alias("last_date"),
    )
    p = table(spark, sf_dir, "part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return p.select(
        F.col("p_partkey").alias("asset_id"), F.when(F.col("p_type").isin("ECONOMY", "MEDIUM", "SMALL"), "product").otherwise("interface").alias("resource_type"),
        F.col("p_type").alias("domain"), F.col("p_brand").alias("department"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        F.length("p_name").cast("double").alias("name_length"), zero("view_count"), zero("download_count"), zero("api_call_count"), "first_date", "last_date",
    )


ASSET = """asset AS (SELECT p_partkey AS asset_id, CASE WHEN p_type IN ('ECONOMY','MEDIUM','SMALL') THEN 'product' ELSE 'interface' END AS resource_type,
 p_type AS domain, p_brand AS department, p_name AS name, p_size::DOUBLE AS size, p_retailprice AS price, length(p_name)::DOUBLE AS name_length,
 coalesce(v,0)::DOUBLE AS view_count, coalesce(d,0)::DOUBLE AS download_count, coalesce(a,0)::DOUBLE AS api_call_count, first_date, last_date
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS v, sum(l_quantity) FILTER (l_returnflag='R') AS d, sum(l_quantity) FILTER (l_returnflag='A') AS a,
  min(l_shipdate) AS first_date, max(l_shipdate) AS last_date FROM lineitem GROUP BY 1) ON p_partkey=l_partkey)"""
#: Assets as they are collected: ids, numbers, sizes, lists and labels in the many forms that sources write. The SQL is for both engines.
RAW = """SELECT p_partkey AS row_no, p_partkey, p_size, p_name, p_brand, p_type,
 CASE p_partkey % 4 WHEN 0 THEN ' ' || CAST(p_partkey AS STRING) || '.0' WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN CAST(p_partkey AS STRING) || '  ' ELSE 'x' || CAST(p_partkey AS STRING) || '.0' END AS asset_id,
 CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN ' NaN ' WHEN 4 THEN 'null' WHEN 5 THEN '--' WHEN 6 THEN '暂无' WHEN 7 THEN '  ' || p_name || '   x ' WHEN 8 THEN '　' || p_brand || '　 y' WHEN 9 THEN '不详' WHEN 10 THEN '<NA>' WHEN 11 THEN 'None' ELSE '无' END AS note,
 CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '1,' || CAST(100 + p_size AS STRING) || ' 条' WHEN 2 THEN '-' || CAST(p_size AS STRING) || '.5' WHEN 3 THEN '--' WHEN 4 THEN 'abc' WHEN 5 THEN ',' WHEN 6 THEN 'nan' WHEN 7 THEN ' ' || CAST(p_size AS STRING) || ' ' WHEN 8 THEN '12' || CAST(p_size AS STRING) || '/' || CAST(p_partkey AS STRING) ELSE CAST(p_size AS STRING) || '.25' END AS number,
 CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS STRING) || ' KB' WHEN 2 THEN CAST(p_size AS STRING) || '.5mb' WHEN 3 THEN '1,' || CAST(100 + p_size AS STRING) || ' 字节' WHEN 4 THEN CAST(p_size AS STRING) || ' g' WHEN 5 THEN CAST(p_size AS STRING) WHEN 6 THEN '--' WHEN 7 THEN CAST(p_size AS STRING) || 'T' ELSE 'size ' || CAST(p_size AS STRING) || 'B' END AS data_size,
 CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '更新日期；' || p_name || ';地址' WHEN 2 THEN p_name || '|' || p_brand || ', ,code' WHEN 3 THEN '2024-05-01;名称' WHEN 4 THEN '甲乙;丙丁;戊己庚;name_1' WHEN 5 THEN 'DATE_OF;lng;lat;名称' WHEN 6 THEN '关键词;12;unnamed_3;a_b;约10米路' ELSE '' END AS field_names,
 CASE p_partkey % 7 WHEN 0 THEN '上海市浦东新区' || p_name || '街道' WHEN 1 THEN '黄浦区、浦东新区' || p_name WHEN 2 THEN '上海市' || p_name WHEN 3 THEN '国家' || p_name WHEN 4 THEN ' ' WHEN 5 THEN p_name ELSE '市' || p_brand END AS department,
 CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '主要包含' || p_name || '的地址、时间和金额' WHEN 2 THEN '包括医疗、教育、交通' WHEN 3 THEN '字段说明：' || p_brand WHEN 4 THEN '下载格式 DATA SAMPLE' ELSE '城市道路 ' || p_name END AS description,
 CASE p_partkey % 4 WHEN 0 THEN '数据产品' WHEN 1 THEN ' 数据接口 ' WHEN 2 THEN '其他' ELSE '数据接口' END AS resource_type,
 CASE p_partkey % 5 WHEN 0 THEN '民生服务' WHEN 1 THEN ' 道路交通 ' WHEN 2 THEN '文化休闲' WHEN 3 THEN p_type ELSE '气象服务' END AS domain,
 CASE p_partkey % 6 WHEN 0 THEN '每天' WHEN 1 THEN '每年' WHEN 2 THEN NULL WHEN 3 THEN '静态数据' WHEN 4 THEN '即时' ELSE '每季度' END AS update_frequency,
 CASE p_partkey % 3 WHEN 0 THEN '市级' WHEN 1 THEN '区级' ELSE '街镇级' END AS spatial_level,
 CASE p_partkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'unavailable' WHEN 2 THEN ' Success ' ELSE 'success' END AS scrape_status,
 CASE p_partkey % 11 WHEN 0 THEN '鏁版嵁' WHEN 1 THEN 'Ã©tÃ©' WHEN 2 THEN '锟斤拷' WHEN 3 THEN p_name || '�' ELSE p_name END AS text
 FROM {part}"""


def raw_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW, part=table(spark, sf_dir, "part"))


RAW_SQL = "raw AS (" + RAW.replace("{part}", "part") + ")"
DIMENSIONS = ("size_score", "price_score", "name_score")
DIMS = """dims AS (SELECT *, (least(greatest(size,s1),s2)-s1)/(s2-s1) AS size_score, (least(greatest(price,q1),q2)-q1)/(q2-q1) AS price_score,
 (least(greatest(name_length,n1),n2)-n1)/(n2-n1) AS name_score FROM asset, (SELECT quantile_cont(size,0.0) AS s1, quantile_cont(size,0.95) AS s2, quantile_cont(price,0.0) AS q1,
 quantile_cont(price,0.95) AS q2, quantile_cont(name_length,0.0) AS n1, quantile_cont(name_length,0.95) AS n2 FROM asset))"""


def asset_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with three scores in [0, 1]."""
    from assetlens.operators.stats import normalize_01

    spec = {out: {"column": c, "low": 0.0, "high": 0.95} for out, c in zip(DIMENSIONS, ("size", "price", "name_length"))}
    return normalize_01(asset_usage(spark, sf_dir), spec)


def p01(x: str, by: str = "", n: str = "") -> str:
    """SQL of the tie-aware percentile of a column without nulls."""
    part = f"PARTITION BY {by} " if by else ""
    both = f"PARTITION BY {by + ', ' if by else ''}{x}"
    return f"(CASE WHEN count(*) OVER ({part.strip()}) > 1 THEN (rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({both}) - 1) / 2.0 - 1) / (count(*) OVER ({part.strip()}) - 1) END)"


USE = f"""cnt AS (SELECT *, {p01('ln(1+view_count)')} AS vs, {p01('ln(1+download_count)')} AS ds, {p01('ln(1+api_call_count)')} AS aps FROM dims),
 sec AS (SELECT *, CASE WHEN resource_type='product' THEN ds ELSE aps END AS se FROM cnt),
 mom AS (SELECT resource_type AS rt, count(*) AS n, avg(vs) AS ma, avg(se) AS mb, stddev_pop(vs) AS sa, stddev_pop(se) AS sb, corr(vs,se) AS r FROM sec GROUP BY 1),
 raw AS (SELECT s.*, CASE WHEN n>=3 THEN round(CASE WHEN r>0 THEN (vs-ma)/sa+(se-mb)/sb WHEN sa>=sb THEN (vs-ma)/sa-(se-mb)/sb ELSE (se-mb)/sb-(vs-ma)/sa END/sqrt(2.0),9) END AS ar FROM sec s JOIN mom ON resource_type=rt),
 act AS (SELECT *, {p01('ar', 'resource_type')} AS actual FROM raw)"""
WEIGHTS = """wt AS (SELECT s1*c1/(s1*c1+s2*c2+s3*c3) AS w1, s2*c2/(s1*c1+s2*c2+s3*c3) AS w2, s3*c3/(s1*c1+s2*c2+s3*c3) AS w3 FROM
 (SELECT s1,s2,s3,2-r12-r13 AS c1,2-r12-r23 AS c2,2-r13-r23 AS c3 FROM (SELECT stddev_pop(size_score) AS s1, stddev_pop(price_score) AS s2, stddev_pop(name_score) AS s3,
 corr(size_score,price_score) AS r12, corr(size_score,name_score) AS r13, corr(price_score,name_score) AS r23 FROM dims)))"""
POTENTIAL = f"""pot0 AS (SELECT act.*, round(size_score*w1+price_score*w2+name_score*w3,9) AS pc FROM act, wt),
 pot AS (SELECT *, {p01('pc')} AS potential FROM pot0)"""
SCORED = f"WITH {ASSET}, {DIMS}, {USE}, {WEIGHTS}, {POTENTIAL}"


def scored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual use within the type, potential use by CRITIC weights, and their percentiles. Scores are rounded before they are ranked, so ties don't hang on summing order.

    The assets with their dimensions are written once, and once more with the counters' percentiles; what follows reads these.
    """
    from assetlens.operators.rank import add_percentile, add_percentiles
    from assetlens.operators.scores import critic_weights, pca_two, weighted_score

    d = asset_dimensions(spark, sf_dir).withColumns({f"_{c}": F.log1p(c) for c in ("view_count", "download_count", "api_call_count")})
    d = written(weighted_score(d, list(DIMENSIONS), critic_weights(d, list(DIMENSIONS)), "pc").withColumn("pc", F.round("pc", 9)), "assets")
    d = add_percentiles(d, {"vs": "_view_count", "ds": "_download_count", "aps": "_api_call_count", "potential": "pc"})
    d = d.withColumn("se", F.when(F.col("resource_type") == "product", F.col("ds")).otherwise(F.col("aps")))
    d = written(d.drop("_view_count", "_download_count", "_api_call_count"), "counted")
    d = pca_two(d, "vs", "se", "ar", ("resource_type",)).withColumn("ar", F.round("ar", 9))
    return add_percentile(d, "ar", "actual", ("resource_type",))
