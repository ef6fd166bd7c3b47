"""Entries of reading and writing (A): tables are written to the shared folder in the form under test, read back and compared with what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.functions import catalog as C
from assetlens.functions import text as T
from assetlens.operators import rank
from assetlens.plans.registry import query
from assetlens.plans.views import ASSET, RAW_SQL, asset_usage, raw_assets, table
from assetlens.scratch import new_folder
from assetlens.sources import tables as S

_WITH = f"WITH {RAW_SQL}"
_ID = "regexp_replace(trim(asset_id),'^(\\d+)\\.0$','\\1')"


def _catalog(spark, sf) -> DataFrame:
    empty = F.lit("")
    raw = raw_assets(spark, sf)
    return raw.select(
        "row_no", "department", "asset_id", F.col("p_name").alias("name"), "domain", empty.alias("open_condition"), F.col("number").alias("view_count"), F.col("number").alias("download_count"), F.col("number").alias("api_call_count"),
        "description", "resource_type", F.lit("open").alias("status"), "update_frequency", empty.alias("open_attribute"), F.lit("2024-01-01").alias("first_publish_date"), F.lit("2024-02-01").alias("last_update_date"),
    )


@query("a1_read_catalog", f"{_WITH} SELECT {_ID} AS asset_id, p_name AS name, trim(number) AS view_count FROM raw WHERE number IS NOT NULL")
def a1_read_catalog(spark, sf):
    folder = new_folder(spark, "a1")
    path = S.save_table(_catalog(spark, sf), folder, "catalog", "csv")
    return S.read_catalog(spark, path).where("view_count is not null").select("asset_id", "name", F.trim("view_count").alias("view_count"))


@query("a2_read_text_table", f"{_WITH} SELECT {_ID} AS asset_id, row_no::VARCHAR AS row_no, p_name, description FROM raw")
def a2_read_text_table(spark, sf):
    path = S.save_table(raw_assets(spark, sf).select("asset_id", "row_no", "p_name", "description"), new_folder(spark, "a2"), "t", "csv")
    return S.read_text_table(spark, path, "asset_id").select("asset_id", "row_no", "p_name", "description")


@query("a3_read_typed", "SELECT p_partkey::VARCHAR AS asset_id, p_size AS size, p_retailprice AS price FROM part")
def a3_read_typed(spark, sf):
    path = S.save_table(table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), "p_size", "p_retailprice"), new_folder(spark, "a3"), "t", "csv")
    return S.read_typed(spark, path, "asset_id string, size int, price double")


@query("a4_read_checkpoint", f"{_WITH} SELECT {_ID} AS asset_id, p_name AS name, 'found' AS kind FROM raw WHERE row_no%2=0")
def a4_read_checkpoint(spark, sf):
    folder, schema = new_folder(spark, "a4"), "asset_id string, name string"
    path = S.save_table(raw_assets(spark, sf).where("row_no % 2 = 0").select("asset_id", F.col("p_name").alias("name")), folder, "checkpoint")
    absent = S.read_checkpoint(spark, f"{folder}/none", schema, "asset_id").withColumn("kind", F.lit("absent"))
    return S.read_checkpoint(spark, path, schema, "asset_id").withColumn("kind", F.lit("found")).unionByName(absent)


@query("a5_id_column", f"{_WITH} SELECT {_ID} AS id FROM raw")
def a5_id_column(spark, sf):
    d = raw_assets(spark, sf).select("p_name", F.col("asset_id").alias("assetID"), F.col("row_no").alias("otherID"))
    return d.select(T.normalize_id(C.id_column(d)).alias("id"))


@query("a6_find_table", "SELECT p_partkey, p_name FROM part")
def a6_find_table(spark, sf):
    folder = new_folder(spark, "a6")
    S.save_table(table(spark, sf, "supplier"), folder, "first.parquet")
    S.save_table(table(spark, sf, "part"), folder, "second.parquet")
    S.save_table(table(spark, sf, "part").select("p_partkey", F.lit("text").alias("p_name")), folder, "third.csv", "csv")
    return S.find_table(spark, folder, ("p_partkey", "p_name")).select("p_partkey", "p_name")


@query("a7_save_table", "SELECT p_type, count(*) AS rows, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def a7_save_table(spark, sf):
    path = S.save_table(table(spark, sf, "part"), new_folder(spark, "a7"), "part", partition_by=("p_type",))
    return spark.read.parquet(path).groupBy("p_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("size"))


@query("a8_append_table", "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def a8_append_table(spark, sf):
    folder, orders = new_folder(spark, "a8"), table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        path = S.append_table(orders.where(F.col("o_orderstatus") == status), folder, "orders")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query("a9_export_tables", "SELECT 'master' AS name, count(*) AS rows, count(DISTINCT p_partkey) AS ids FROM part UNION ALL SELECT 'small', count(*), count(DISTINCT p_partkey) FROM part WHERE p_size<10")
def a9_export_tables(spark, sf):
    part = table(spark, sf, "part")
    paths = S.export_tables({"master": part, "small": part.where("p_size < 10")}, new_folder(spark, "a9"))
    parts = [spark.read.parquet(p).agg(F.lit(p.rsplit("/", 1)[1]).alias("name"), F.count(F.lit(1)).alias("rows"), F.countDistinct("p_partkey").alias("ids")) for p in paths]
    return parts[0].unionByName(parts[1])


@query("a10_manifest", "SELECT 'part' AS source, count(*) AS rows, round(avg(p_retailprice),4) AS mean_price FROM part")
def a10_manifest(spark, sf):
    row = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("p_retailprice"), 4).alias("mean_price")).first()
    path = S.save_manifest(spark, new_folder(spark, "a10"), "manifest", {"source": "part", "rows": row["rows"], "mean_price": row["mean_price"]})
    return spark.read.schema("source string, rows bigint, mean_price double").json(path)


@query("a11_ranked_lists", f"""WITH {ASSET}, r AS (SELECT asset_id, row_number() OVER (ORDER BY view_count DESC, asset_id) AS rank FROM asset)
 SELECT 'all' AS list, asset_id, rank FROM r UNION ALL SELECT 'top_100', asset_id, rank FROM r WHERE rank<=100 UNION ALL SELECT 'top_300', asset_id, rank FROM r WHERE rank<=300""")
def a11_ranked_lists(spark, sf):
    lists = S.ranked_lists(rank.first_rank(asset_usage(spark, sf), "view_count", "asset_id").select("asset_id", "rank"), "rank")
    out = None
    for name, d in lists.items():
        d = d.select(F.lit(name).alias("list"), "asset_id", "rank")
        out = d if out is None else out.unionByName(d)
    return out


@query("a12_rejects", f"{_WITH} SELECT CASE WHEN coalesce(regexp_matches(number,'^ ?\\d+'),false) THEN 'kept' ELSE 'rejected' END AS sink, count(*) AS rows FROM raw GROUP BY 1")
def a12_rejects(spark, sf):
    kept, rejected = S.split_rejects(raw_assets(spark, sf), F.col("number").rlike("^ ?[0-9]+"))
    folder = new_folder(spark, "a12")
    paths = S.export_tables({"kept": kept, "rejected": rejected}, folder)
    out = [spark.read.parquet(p).agg(F.lit(p.rsplit("/", 1)[1]).alias("sink"), F.count(F.lit(1)).alias("rows")) for p in paths]
    return out[0].unionByName(out[1])


@query("a13_field_dictionary", "SELECT * FROM (VALUES ('p_partkey','the asset',(SELECT count(p_partkey) FROM part)),('p_size','its size',(SELECT count(p_size) FROM part))) d(name,definition,known)")
def a13_field_dictionary(spark, sf):
    words = S.field_dictionary(spark, {"p_partkey": "the asset", "p_size": "its size"})
    known = table(spark, sf, "part").agg(F.count("p_partkey").alias("p_partkey"), F.count("p_size").alias("p_size")).unpivot([], ["p_partkey", "p_size"], "name", "known")
    return words.join(known, "name")


@query("a14_read_lines", "SELECT p_partkey||' '||p_name AS line FROM part WHERE p_partkey%4>1")
def a14_read_lines(spark, sf):
    key = F.col("p_partkey")
    line = F.when(key % 4 == 0, "   ").when(key % 4 == 1, F.concat(F.lit("  # "), "p_name")).otherwise(F.concat(F.lit("  "), key.cast("string"), F.lit(" "), "p_name"))
    path = f"{new_folder(spark, 'a14')}/lines"
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return S.read_lines(spark, path)


@query("a15_latest_progress", "SELECT 'progress '||max(event_id) FILTER (event_type='view') AS line, count(*) FILTER (event_type='view')>0 AS found FROM events")
def a15_latest_progress(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.concat(F.lit("progress "), F.col("event_id").cast("string"))).otherwise("other").alias("line"))
    return S.latest_progress(log, "progress")

