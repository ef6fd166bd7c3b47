"""Entries of quality flags (D), keyed merges (F), set operations (L) and reshaping (N), over the raw assets and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlens.functions import catalog as C
from assetlens.functions import text as T
from assetlens.operators import contract, merge, profile, quality
from assetlens.plans.entries_text import _CELLS, _CLEAN, _CODE, _ID, _LEVEL, _URL, _WEAK, emptyish, number, places, placeholder, plain, scored, spaced, terms
from assetlens.plans.registry import query, rounded
from assetlens.plans.views import RAW_SQL, raw_assets, table

_WITH = f"WITH {RAW_SQL}"
_STATUS = "lower(trim(coalesce(scrape_status,'')))"
_CORE = ["note", "number", "data_size"]
_MISSING = "concat_ws(';',{})".format(",".join(f"CASE WHEN {plain(c)}='' THEN '{c}' END" for c in _CORE))
_COUNT = "({})".format("+".join(f"({plain(c)}='')::INT" for c in _CORE))


def _features(spark, sf):
    raw = raw_assets(spark, sf).withColumns({"name": F.col("p_name"), "first_publish_date": F.when(F.col("row_no") % 3 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("row_no") % 900).cast("int")).cast("string")).otherwise("no date"), "last_update_date": F.lit("2023-05-06")})
    raw = raw.withColumns({"view_count": (F.col("p_size") * 3).cast("string"), "download_count": F.when(F.col("row_no") % 4 > 0, F.col("p_size").cast("string")), "api_call_count": F.lit("0")})
    return contract.catalog_features(raw, F.lit("2024-01-01"))


_PCT = "(rank() OVER (ORDER BY {x})+(count(*) OVER (PARTITION BY {x})-1)/2.0)/count(*) OVER ()"
_PUBLISHED = "(CASE WHEN row_no%3>0 THEN DATE '2020-01-01'+(row_no%900)::INT END)"


@query("d1_catalog_features", f"""{_WITH}, n AS (SELECT *, p_size*3.0 AS v, CASE WHEN row_no%4>0 THEN p_size ELSE 0 END::DOUBLE AS d, 0.0 AS a FROM raw), p AS (SELECT *, {_PCT.format(x='ln(1+v)')} AS pv, {_PCT.format(x='ln(1+d)')} AS pd, {_PCT.format(x='ln(1+a)')} AS pa FROM n),
 u AS (SELECT *, round(0.45*pv+0.35*pd+0.2*pa,12) AS use FROM p) SELECT row_no, {_CODE} AS type_code, {_URL} AS detail_url, {_LEVEL} AS spatial_admin_level, {places(spaced("coalesce(p_name,'')||' '||coalesce(department,'')||' '||coalesce(description,'')"))} AS inferred_spatial_scope,
 date_diff('day',{_PUBLISHED},DATE '2024-01-01')::INT AS publication_age_days, date_diff('day',DATE '2023-05-06',DATE '2024-01-01')::INT AS update_recency_days, date_diff('day',{_PUBLISHED},DATE '2023-05-06')::INT AS maintenance_span_days, length(p_name)::INT AS title_len, length(coalesce(description,''))::INT AS description_len,
 regexp_matches(coalesce(description,''),'{T.FIELD_HINT}')::INT AS description_has_field_hint, ({'+'.join(f"contains(coalesce(description,''),'{k}')::INT" for k in T.SCENE_KEYWORDS)})::INT AS scene_keyword_count, round(use,9) AS actual_use_v0, round({_PCT.format(x='use')},9) AS actual_use_percentile, true AS empty_supplement FROM u""")
def d1_catalog_features(spark, sf):
    d = _features(spark, sf)
    kept = ("row_no", "type_code", "detail_url", "spatial_admin_level", "inferred_spatial_scope", "publication_age_days", "update_recency_days", "maintenance_span_days", "title_len", "description_len", "description_has_field_hint", "scene_keyword_count", "actual_use_v0", "actual_use_percentile")
    return rounded(d.select(*kept, ((F.col("download_formats") == "") & F.col("record_count").isNull() & F.col("has_csv").isNull()).alias("empty_supplement")), 9)


@query("d2_minimum_required", f"""WITH {RAW_SQL}, {_CELLS}, {_CLEAN} SELECT asset_id, p_name AS name, {_URL} AS dataset_url, (coalesce(resource_type,'')='数据接口')::INT AS has_api_doc, {spaced('data_size')} AS data_size, {places(spaced("coalesce(p_name,'')||' '||coalesce(department,'')||' '||coalesce(description,'')"))} AS spatial_scope,
 coalesce(array_to_string(names,';'),'') AS field_names, coalesce(len(names),0)::INT AS field_count, '' AS remark, 22 AS columns FROM raw LEFT JOIN cleaned USING (row_no)""")
def d2_minimum_required(spark, sf):
    d = contract.minimum_required(_features(spark, sf))
    return d.select("asset_id", "name", "dataset_url", "has_api_doc", "data_size", "spatial_scope", "field_names", "field_count", "remark", F.lit(len(d.columns)).alias("columns"))


@query("d3_missing_core", f"{_WITH} SELECT row_no, {_MISSING} AS core_missing_fields, {_COUNT}::INT AS core_missing_count FROM raw")
def d3_missing_core(spark, sf):
    return raw_assets(spark, sf).select("row_no", *[c.alias(n) for n, c in quality.missing_core(_CORE).items()])


@query("d5_exclusion_reasons", f"""{_WITH} SELECT row_no, ({_STATUS}='success')::INT AS is_scrape_success, ({_STATUS}='unavailable')::INT AS is_unavailable, ({_STATUS}='success' AND {_COUNT}=0)::INT AS is_core_complete, ({_STATUS}='success' AND {_COUNT}=0)::INT AS is_main_analysis_sample,
 ({_STATUS}='success' AND {_COUNT}=0)::INT AS is_modeling_candidate, {_COUNT}::INT AS core_missing_count, {_MISSING} AS core_missing_fields, concat_ws(';',CASE WHEN {_STATUS}='unavailable' THEN 'unavailable' END,CASE WHEN {_COUNT}>0 THEN 'core_missing' END) AS analysis_exclusion_reason FROM raw""")
def d5_exclusion_reasons(spark, sf):
    d = quality.sample_gate(raw_assets(spark, sf), _CORE)
    return d.select("row_no", "is_scrape_success", "is_unavailable", "is_core_complete", "is_main_analysis_sample", "is_modeling_candidate", "core_missing_count", "core_missing_fields", "analysis_exclusion_reason")


_ISSUES = ["note", "number", "data_size"]


@query("d6_residual_flags", f"{_WITH} SELECT row_no, {', '.join(f'({plain(c)}=$$$$)::INT AS residual_missing_{c}' for c in _ISSUES)} FROM raw")
def d6_residual_flags(spark, sf):
    raw = raw_assets(spark, sf)
    latest = merge.keep_last(raw.select("row_no", F.lit(1).alias("seq"), F.lit("old").alias("issues")).unionByName(raw.select("row_no", F.lit(2).alias("seq"), F.array_join(quality.names_where({f"missing_{c}": T.is_blank(c) for c in _ISSUES}), ";").alias("issues"))), "row_no", "seq")
    return raw.select("row_no").join(latest, "row_no", "left").select("row_no", *[c.alias(n) for n, c in quality.issue_flags("issues", [f"missing_{c}" for c in _ISSUES]).items()])


@query("d7_date_flags", f"""{_WITH}, d AS (SELECT *, CASE row_no%4 WHEN 0 THEN '-5' WHEN 1 THEN NULL ELSE '30' END AS span, CASE row_no%5 WHEN 0 THEN '2024-03-01' WHEN 1 THEN 'unknown' ELSE '2020-01-01' END AS a, '2023-01-01' AS b FROM raw)
 SELECT row_no, (NOT {placeholder('note')})::INT AS has_meaningful_time_scope, (row_no%4=0 OR row_no%5=0)::INT AS date_order_anomaly, CASE WHEN row_no%4>1 THEN 30.0 END AS span_clean FROM d""")
def d7_date_flags(spark, sf):
    k = F.col("row_no")
    d = raw_assets(spark, sf).withColumns({"span": F.when(k % 4 == 0, "-5").when(k % 4 > 1, "30"), "a": F.when(k % 5 == 0, "2024-03-01").when(k % 5 == 1, "unknown").otherwise("2020-01-01"), "b": F.lit("2023-01-01")})
    return quality.date_flags(d, "note", "a", "b", "span").select("row_no", "has_meaningful_time_scope", "date_order_anomaly", "span_clean")


_PLAIN_NUMBER = "(CASE WHEN regexp_full_match(trim(number),'-?\\d+(\\.\\d+)?') THEN TRY_CAST(trim(number) AS DOUBLE) END)"
_REPAIRED = f"coalesce({_PLAIN_NUMBER}, CASE WHEN {plain('field_names')}<>'' THEN len({terms('field_names')}) END)"


@query("d8_field_count_repair", f"{_WITH} SELECT row_no, {_REPAIRED}::DOUBLE AS field_count_clean, ({_STATUS}='success' AND coalesce({_REPAIRED}<=2,false))::INT AS low_field_count_flag FROM raw")
def d8_field_count_repair(spark, sf):
    success = F.lower(F.trim("scrape_status")) == "success"
    return quality.field_count_repair(raw_assets(spark, sf), "number", "field_names", success).select("row_no", "field_count_clean", "low_field_count_flag")


@query("d9_int_flags", f"{_WITH} SELECT row_no, trunc(coalesce({_PLAIN_NUMBER},0))::INT AS number_clean FROM raw")
def d9_int_flags(spark, sf):
    return raw_assets(spark, sf).select("row_no", *[c.alias(n) for n, c in quality.int_flags("number").items()])


@query("d10_range_flags", f"{_WITH} SELECT row_no, coalesce(NOT {_PLAIN_NUMBER} BETWEEN 0 AND 5,false)::INT AS rating_score_invalid_flag, coalesce({_PLAIN_NUMBER}>20,false)::INT AS comment_count_invalid_flag, NULL::DOUBLE AS number FROM raw")
def d10_range_flags(spark, sf):
    flags = quality.range_flags("number", "number", 20)
    return raw_assets(spark, sf).select("row_no", *[c.alias(n) for n, c in flags.items()], *[c.alias(n) for n, c in quality.disabled({"number": "double"}).items()])


@query("d11_class_indicators", f"{_WITH} SELECT row_no, (trim(resource_type)='数据接口')::INT AS is_data_interface, (trim(resource_type)='数据产品')::INT AS is_data_product FROM raw")
def d11_class_indicators(spark, sf):
    return raw_assets(spark, sf).select("row_no", *[c.alias(n) for n, c in quality.class_indicators("resource_type", {"is_data_interface": "数据接口", "is_data_product": "数据产品"}).items()])


@query("d12_all_zero", "SELECT c_custkey, (coalesce(sum(CASE WHEN o_orderstatus='P' THEN 1 END),0)+coalesce(sum(CASE WHEN o_totalprice>400000 THEN 1 END),0)=0)::INT AS usage_all_zero_flag FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def d12_all_zero(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(F.col("o_orderstatus") == "P", 1)).alias("p"), F.sum(F.when(F.col("o_totalprice") > 400_000, 1)).alias("t"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", quality.all_zero("p", "t").alias("usage_all_zero_flag"))


@query("d13_warnings", f"{_WITH} SELECT row_no, concat_ws(';',CASE WHEN {plain('note')}='' THEN 'no_note' END,CASE WHEN {emptyish('number')} THEN 'no_number' END,CASE WHEN {placeholder('note')} THEN 'no_meaningful_time_scope' END) AS w FROM raw")
def d13_warnings(spark, sf):
    names = quality.names_where({"no_note": T.is_blank("note"), "no_number": T.is_emptyish("number"), "no_meaningful_time_scope": T.is_placeholder("note")})
    return raw_assets(spark, sf).select("row_no", F.array_join(names, ";").alias("w"))


_SUSPICIOUS = f"""sus AS (SELECT row_no, coalesce(bool_or(regexp_matches(v,'^\\d{{4}}[./-]\\d{{1,2}}([./-]\\d{{1,2}})?$')) OR (count(v)>=4 AND sum({_WEAK}::INT)>=greatest(3,ceil(count(v)/2))),false) AS s FROM raw LEFT JOIN cell USING (row_no) GROUP BY 1)"""
_FEW = f"coalesce({_PLAIN_NUMBER}<3,true)"


@query("d15_quality_issues", f"""WITH {RAW_SQL}, {_CELLS}, {_SUSPICIOUS} SELECT row_no, CASE WHEN {_STATUS}='success' THEN concat_ws(';',CASE WHEN {plain('note')}='' THEN 'missing_note' END,CASE WHEN {plain('data_size')}='' THEN 'missing_data_size' END,
 CASE WHEN regexp_matches({spaced('text')},'{T.MOJIBAKE_MONITOR}') THEN 'mojibake' END,CASE WHEN s THEN 'suspicious_field_names' END,CASE WHEN {_FEW} THEN 'field_terms_too_few' END) ELSE trim(scrape_status) END AS issues FROM raw JOIN sus USING (row_no)""")
def d15_quality_issues(spark, sf):
    issues = quality.quality_issues(["note", "data_size"], "scrape_status", ["text"], "field_names", "number")
    return raw_assets(spark, sf).select("row_no", F.array_join(issues, ";").alias("issues"))


@query("d16_quality_score", f"""WITH {RAW_SQL}, {_CELLS}, {_SUSPICIOUS} SELECT row_no, (CASE {_STATUS} WHEN 'success' THEN 10000 WHEN 'unavailable' THEN -1000 ELSE -2000 END-600*(({plain('note')}='')::INT+({plain('data_size')}='')::INT)-800*regexp_matches({spaced('text')},'{T.MOJIBAKE_MONITOR}')::INT-300*s::INT-250*({_FEW})::INT
 +least(200,8*len({terms('field_names')}))+least(50,5*(row_no%13)))::BIGINT AS score FROM raw JOIN sus USING (row_no)""")
def d16_quality_score(spark, sf):
    missing = sum((T.is_blank(c).cast("int") for c in ("note", "data_size")), F.lit(0))
    few = F.coalesce(T.to_number("number") < 3, F.lit(True))
    score = quality.quality_score("scrape_status", missing, T.has_mojibake("text", T.MOJIBAKE_MONITOR), T.suspicious_field_names("field_names"), few, F.size(T.split_terms("field_names")), F.col("row_no") % 13)
    return raw_assets(spark, sf).select("row_no", score.alias("score"))


@query("d17_bool_mask", f"{_WITH} SELECT row_no, coalesce({_PLAIN_NUMBER}=1,false) AS there, false AS absent FROM raw")
def d17_bool_mask(spark, sf):
    d = raw_assets(spark, sf)
    return d.select("row_no", quality.bool_mask(d, "number").alias("there"), quality.bool_mask(d, "no_such_column").alias("absent"))


@query("d18_leakage", "SELECT p_name AS feature, bool_or(regexp_matches(lower(p_name),'red|ring'))::INT AS target, bool_or(contains(lower(p_name),'widget'))::INT AS thing FROM part GROUP BY 1")
def d18_leakage(spark, sf):
    features = table(spark, sf, "part").select(F.col("p_name").alias("feature")).distinct()
    return quality.leakage(features, {"target": ("RED", "ring"), "thing": ("Widget",)})


@query("d19_prepared", f"{_WITH} SELECT row_no, coalesce(nullif(trim(update_frequency),''),'缺失') AS update_frequency, {_PLAIN_NUMBER} AS number, 0.0::DOUBLE AS none, coalesce(description,'')||' '||p_name AS combined_text FROM raw")
def d19_prepared(spark, sf):
    d = raw_assets(spark, sf).withColumn("none", F.lit("x"))
    return quality.prepared(d, ["update_frequency"], ["number", "none"], ["description", "p_name"]).select("row_no", "update_frequency", "number", "none", "combined_text")


@query("d20_model_frame", f"{_WITH}, n AS (SELECT row_no, p_size*2.0 AS v, CASE WHEN row_no%3>0 THEN p_size END AS d FROM raw), p AS (SELECT row_no, 0.45*{_PCT.format(x='ln(1+v)')}+0.35*{_PCT.format(x='ln(1+coalesce(d,0))')}+0.2*{_PCT.format(x='0')} AS u FROM n) SELECT row_no, round(u,9) AS actual_use_v0 FROM p")
def d20_model_frame(spark, sf):
    k = F.col("row_no")
    d = raw_assets(spark, sf).select("row_no", (F.col("p_size") * 2).alias("view_count"), F.when(k % 3 > 0, F.col("p_size")).alias("download_count"), F.lit(None).cast("string").alias("api_call_count"))
    return rounded(contract.actual_use_v0(d).select("row_no", "actual_use_v0"), 9)


@query("d21_existing_first", "SELECT p_name, p_partkey, p_brand FROM part")
def d21_existing_first(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    return C.existing_first(d, ("p_name", "no_such_column", "p_partkey"))


@query("d22_quality_gate", f"{_WITH} SELECT count(*) AS rows_checked, 0::BIGINT AS null_rows, sum(({plain('note')}='')::INT)::BIGINT AS blank_notes FROM raw")
def d22_quality_gate(spark, sf):
    return quality.quality_gate(raw_assets(spark, sf), {"null_rows": F.col("row_no").isNull(), "blank_notes": T.is_blank("note")}, ["null_rows"])


@query("d23_terminal", f"{_WITH} SELECT row_no, {_STATUS} IN ('success','unavailable') AS done FROM raw")
def d23_terminal(spark, sf):
    return raw_assets(spark, sf).select("row_no", quality.terminal("scrape_status").alias("done"))


@query("j6_lookup_parts", f"{_WITH} SELECT row_no, round(0.65*{scored('update_frequency', C.FREQUENCY_SCORE, 0.4)}+0.35*0.5,6) AS timely FROM raw")
def j6_lookup_parts(spark, sf):
    return rounded(raw_assets(spark, sf).select("row_no", (0.65 * C.lookup_score("update_frequency", C.FREQUENCY_SCORE, C.OTHER_SCORE["frequency"]) + 0.35 * F.lit(0.5)).alias("timely")))


# ---- merges


@query("f5_sync_master", f"""WITH {RAW_SQL}, {_CELLS}, {_CLEAN} SELECT row_no, CASE WHEN row_no%2=0 AND coalesce(field_names,'')<>'' THEN array_to_string(names,';') ELSE 'a;b' END AS field_names, CASE WHEN row_no%2=0 AND coalesce(field_names,'')<>'' THEN coalesce(len(names),0) ELSE 2 END::INT AS field_count FROM raw LEFT JOIN cleaned USING (row_no)""")
def f5_sync_master(spark, sf):
    raw = raw_assets(spark, sf)
    master, minimum = contract.sync_master(raw.select("row_no", "asset_id", F.lit("b;a").alias("field_names")), raw.where("row_no % 2 = 0").select("row_no", "field_names"), "row_no")
    same = minimum.select("asset_id", F.col("field_names").alias("m")).distinct()
    return master.join(same, "asset_id").where("m = field_names").select("row_no", "field_names", "field_count")


_BETTER_F = "(row_no%3>0 AND row_no%3>row_no%4)"
_BETTER_N = "(row_no%5>0 AND row_no%5>row_no%2)"


@query("f7_selective_update", f"""SELECT p_partkey AS row_no, concat_ws(';',CASE WHEN {_BETTER_F} THEN 'formats' END,CASE WHEN {_BETTER_N} THEN 'fields' END,CASE WHEN row_no%7=0 AND row_no%6>0 THEN 'size' END) AS changed, CASE WHEN {_BETTER_F} THEN row_no%3 ELSE row_no%4 END::INT AS n_formats, CASE WHEN {_BETTER_N} THEN row_no%5 ELSE row_no%2 END::INT AS n_fields,
 CASE WHEN row_no%7=0 THEN CASE WHEN row_no%6>0 THEN 'new' ELSE '' END ELSE 'old' END AS size FROM (SELECT p_partkey, p_partkey AS row_no FROM part)""")
def f7_selective_update(spark, sf):
    k = F.col("p_partkey")
    some = lambda n: F.slice(F.array(*[F.lit(f"f{i}") for i in range(6)]), 1, (k % n).cast("int"))
    p = table(spark, sf, "part")
    old = p.select(k.alias("row_no"), some(4).alias("formats"), some(2).alias("fields"), F.when(k % 7 == 0, "").otherwise("old").alias("size"))
    new = p.select(k.alias("row_no"), some(3).alias("formats"), some(5).alias("fields"), F.when(k % 6 == 0, "").otherwise("new").alias("size"))
    d = merge.selective_update(old, new, "row_no", "formats", "fields", ["size"], lambda c: F.exists(c, lambda t: t == "odd"))
    return d.select("row_no", F.array_join("changed", ";").alias("changed"), F.size("formats").alias("n_formats"), F.size("fields").alias("n_fields"), "size")


@query("f7_full_update", "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part")
def f7_full_update(spark, sf):
    return merge.full_update(table(spark, sf, "part").select(F.lit("").alias("id"), F.col("p_name").alias("name"), "p_partkey"), "id", F.col("p_partkey").cast("string")).select("id", "name")


_OLD, _NEW = "CASE row_no%3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'unavailable' END", _STATUS


@query("f8_recollect_action", f"""{_WITH}, s AS (SELECT row_no, {_OLD} AS o, {_NEW} AS n, row_no%2=0 AS changed, row_no%5=0 AS err FROM raw) SELECT row_no, CASE WHEN err AND n NOT IN ('success','unavailable') THEN 'failed' WHEN o='success' AND n<>'success' THEN 'skip_success_regression'
 WHEN o<>'success' AND n='success' THEN 'upsert_recovered_success' WHEN n='success' AND changed THEN 'upsert_improved_success' WHEN n='success' THEN 'checked_no_improvement' ELSE 'upsert_'||n END AS action FROM s""")
def f8_recollect_action(spark, sf):
    k = F.col("row_no")
    d = raw_assets(spark, sf).withColumns({"old": F.when(k % 3 == 0, "success").when(k % 3 == 1, "failed").otherwise("unavailable"), "error": F.when(k % 5 == 0, "timeout")})
    return d.select("row_no", merge.recollect_action("old", "scrape_status", k % 2 == 0, "error").alias("action"))


@query("f10_residual", f"{_WITH} SELECT row_no, {_MISSING} AS issues FROM raw WHERE {_COUNT}>0")
def f10_residual(spark, sf):
    raw = raw_assets(spark, sf)
    d = merge.residual(raw.select("row_no", "p_name"), raw.select("row_no", *_CORE), "row_no", lambda j: quality.names_where({c: T.is_blank(c) for c in _CORE}))
    return d.select("row_no", F.array_join("residual_issues", ";").alias("issues"))


@query("f11_attach_unique", "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
def f11_attach_unique(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return merge.attach_unique(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "segment")


@query("f12_profile_join", "SELECT p_type, count(*) AS rows, round(avg(p_retailprice)-min(m),6) AS gap FROM part JOIN (SELECT p_type AS t, min(p_retailprice) AS m FROM part GROUP BY 1) ON p_type=t GROUP BY 1")
def f12_profile_join(spark, sf):
    p = table(spark, sf, "part")
    low = p.groupBy("p_type").agg(F.min("p_retailprice").alias("low"))
    return rounded(merge.attach_unique(p, low, "p_type").groupBy("p_type").agg(F.count(F.lit(1)).alias("rows"), (F.avg("p_retailprice") - F.min("low")).alias("gap")))


@query("f14_name_in_text", "WITH b AS (SELECT DISTINCT c_name AS block FROM customer), n AS (SELECT DISTINCT '#0000000'||lpad((s_suppkey%90)::VARCHAR,2,'0') AS name FROM supplier), h AS (SELECT block, name FROM b JOIN n ON contains(block,name)) SELECT block, min(name) AS name FROM h GROUP BY 1 HAVING count(*)=1")
def f14_name_in_text(spark, sf):
    blocks = table(spark, sf, "customer").select(F.col("c_name").alias("block"))
    names = table(spark, sf, "supplier").select(F.concat(F.lit("#0000000"), F.lpad((F.col("s_suppkey") % 90).cast("string"), 2, "0")).alias("name"))
    return merge.name_in_text(blocks, names, "block", "name")


@query("f15_row_numbers", "SELECT o_orderkey, r.row_no FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS row_no FROM customer WHERE c_custkey%2=0) r ON o_custkey=c_custkey")
def f15_row_numbers(spark, sf):
    master = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return merge.with_row_no(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), master, "o_custkey", "c_name").select("o_orderkey", "row_no")


# ---- set operations and reshaping


@query("l1_union_widened", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def l1_union_widened(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return merge.union_widened(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("l2_id_sets", "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus='P'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice>300000) SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM a JOIN b USING (id)) AS common, (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS united")
def l2_id_sets(spark, sf):
    from assetlens.operators.stats import set_overlap

    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "P").alias("a"), F.max(F.col("o_totalprice") > 300_000).alias("b"))
    return set_overlap(g, "a", "b").drop("jaccard")


@query("l3_done_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1)")
def l3_done_difference(spark, sf):
    return merge.done_difference(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("l4_strict_subset", "SELECT p_partkey, (p_partkey%4<p_partkey%5) AS s FROM part")
def l4_strict_subset(spark, sf):
    k = F.col("p_partkey")
    some = lambda n: F.slice(F.array(*[F.lit(f"i{i}") for i in range(6)]), 1, (k % n).cast("int"))
    return table(spark, sf, "part").withColumns({"new": some(4), "old": some(5)}).select("p_partkey", merge.strict_subset("new", "old").alias("s"))


@query("n2_long_to_wide", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus='F') AS F, max(o_totalprice) FILTER (o_orderstatus='O') AS O FROM orders GROUP BY 1")
def n2_long_to_wide(spark, sf):
    long = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    return profile.long_to_wide(long, "o_custkey", "o_orderstatus", "v", ["F", "O"])


@query("n4_flat_summary", "SELECT o_orderstatus, round(avg(o_totalprice),4) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max, round(avg(o_custkey),4) AS o_custkey_mean, max(o_custkey) AS o_custkey_max FROM orders GROUP BY 1")
def n4_flat_summary(spark, sf):
    return rounded(profile.flat_summary(table(spark, sf, "orders"), ["o_orderstatus"], ["o_totalprice", "o_custkey"], {"mean": F.avg, "max": F.max}), 4)


@query("n6_seeded_sample", None)
def n6_seeded_sample(spark, sf):
    return profile.seeded_sample(table(spark, sf, "orders"), "o_orderkey", 100, 7)


__all__ = ["_ID", "number"]
