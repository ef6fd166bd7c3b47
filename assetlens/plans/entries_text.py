"""Entries of the scalar functions (B) and of the page patterns that a regular expression can say (C), over the raw assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlens.functions import catalog as C
from assetlens.functions import text as T
from assetlens.plans.registry import query, rounded
from assetlens.plans.views import ASSET, RAW_SQL, asset_usage, raw_assets

_WITH = f"WITH {RAW_SQL}"


def trimmed(x: str) -> str:
    return f"regexp_replace(coalesce({x},''),'^[\\s　]+|[\\s　]+$','','g')"


def spaced(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x},''),'[\\s　]+',' ','g'))"


def plain(x: str) -> str:
    return f"(CASE WHEN lower({trimmed(x)}) IN ('nan','none','<na>','nat') THEN '' ELSE {trimmed(x)} END)"


def emptyish(x: str) -> str:
    return f"(lower(trim(coalesce({x},''))) IN ('','nan','none','null'))"


def placeholder(x: str) -> str:
    return f"({plain(x)} IN ('','-','--','—','/','无','暂无','不详','未注明'))"


def number(x: str) -> str:
    return f"(CASE WHEN {plain(x)} NOT IN ('','-','--','—','/') THEN TRY_CAST(nullif(regexp_extract(replace({plain(x)},',',''),'-?\\d+(\\.\\d+)?'),'') AS DOUBLE) END)"


def terms(x: str, delimiters: str = "[;；|,\\n\\r\\t]") -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x},''),'{delimiters}'), lambda t: {trimmed('t')}), lambda t: t<>'')"


def _words(words) -> str:
    return "|".join(words).replace("(", "\\(").replace(")", "\\)")


@query("b2_normalized_text", f"{_WITH} SELECT row_no, {plain('note')} AS t, {plain('note')}='' AS blank FROM raw")
def b2_normalized_text(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.normalized_text("note").alias("t"), T.is_blank("note").alias("blank"))


@query("b1_normalize_wide_space", f"{_WITH} SELECT row_no, {spaced('note')} AS t FROM raw")
def b1_normalize_wide_space(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.normalize_space("note").alias("t"))


@query("b3_normalize_id", f"{_WITH} SELECT row_no, regexp_replace(trim(asset_id),'^(\\d+)\\.0$','\\1') AS id FROM raw")
def b3_normalize_id(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.normalize_id("asset_id").alias("id"))


@query("b5_placeholder", f"{_WITH} SELECT row_no, {placeholder('note')} AS p, {emptyish('note')} AS e FROM raw")
def b5_placeholder(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.is_placeholder("note").alias("p"), T.is_emptyish("note").alias("e"))


@query("b6_emptyish_counts", f"{_WITH} SELECT {emptyish('note')} AS e, {emptyish('number')} AS n, count(*) AS rows FROM raw GROUP BY 1,2")
def b6_emptyish_counts(spark, sf):
    return raw_assets(spark, sf).groupBy(T.is_emptyish("note").alias("e"), T.is_emptyish("number").alias("n")).agg(F.count(F.lit(1)).alias("rows"))


@query("b7_parse_mixed_numbers", f"{_WITH} SELECT row_no, {number('number')} AS n FROM raw")
def b7_parse_mixed_numbers(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.parse_number("number").alias("n"))


_SIZE = f"upper(regexp_replace({plain('data_size')},'[, ]','','g'))"
_UNIT = "(\\d+(?:\\.\\d+)?)(TB|GB|MB|KB|B|T|G|M|K|字节)?"


@query("b8_parse_size", f"""{_WITH}, s AS (SELECT row_no, TRY_CAST(nullif(regexp_extract({_SIZE},'{_UNIT}',1),'') AS DOUBLE) AS v, regexp_extract({_SIZE},'{_UNIT}',2) AS u FROM raw)
 SELECT row_no, v*CASE u WHEN 'KB' THEN 1024.0 WHEN 'K' THEN 1024.0 WHEN 'MB' THEN 1024.0**2 WHEN 'M' THEN 1024.0**2 WHEN 'GB' THEN 1024.0**3 WHEN 'G' THEN 1024.0**3 WHEN 'TB' THEN 1024.0**4 WHEN 'T' THEN 1024.0**4 ELSE 1 END AS bytes FROM s""")
def b8_parse_size(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.parse_size_bytes("data_size").alias("bytes"))


@query("b9_first_integer", f"{_WITH} SELECT row_no, CASE WHEN NOT {placeholder('number')} THEN TRY_CAST(nullif(replace(regexp_extract(number,'[\\d,]+'),',',''),'') AS BIGINT) END AS i FROM raw")
def b9_first_integer(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.first_integer("number").alias("i"))


@query("b10_all_digits", f"{_WITH} SELECT row_no, CASE WHEN NOT {placeholder('number')} THEN TRY_CAST(nullif(regexp_replace(number,'[^\\d]','','g'),'') AS BIGINT) END AS i FROM raw")
def b10_all_digits(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.all_digits("number").alias("i"))


@query("b11_number_value", f"{_WITH} SELECT row_no, CASE WHEN NOT {emptyish('number')} AND NOT isnan(TRY_CAST(trim(number) AS DOUBLE)) THEN TRY_CAST(trim(number) AS DOUBLE) END AS v FROM raw")
def b11_number_value(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.number_value("number").alias("v"))


@query("b12_to_number", f"{_WITH} SELECT row_no, CASE WHEN regexp_full_match(trim(number),'-?\\d+(\\.\\d+)?') THEN TRY_CAST(trim(number) AS DOUBLE) END AS v FROM raw")
def b12_to_number(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.to_number("number").alias("v"))


@query("b13_map_characters", f"{_WITH} SELECT row_no, replace(translate({spaced('text')},'鏁嵁a','數據A'),'數版','数据版') AS t, translate({spaced('text')},'鏁嵁a','數據A')<>{spaced('text')} AS residue FROM raw")
def b13_map_characters(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.map_characters("text", "鏁嵁a", "數據A", {"數版": "数据版"}).alias("t"), T.has_residue("text", "鏁嵁a", "數據A").alias("residue"))


@query("b15_mojibake", f"{_WITH} SELECT row_no, regexp_matches({spaced('text')},'{T.MOJIBAKE_PIPELINE}') AS a, regexp_matches({spaced('text')},'{T.MOJIBAKE_MONITOR}') AS b FROM raw")
def b15_mojibake(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.has_mojibake("text").alias("a"), T.has_mojibake("text", T.MOJIBAKE_MONITOR).alias("b"))


@query("b16_mojibake_rows", f"{_WITH} SELECT count(*) AS rows, sum((regexp_matches({spaced('text')},'{T.MOJIBAKE_MONITOR}') OR regexp_matches({spaced('note')},'{T.MOJIBAKE_MONITOR}'))::INT)::BIGINT AS mojibake_rows FROM raw")
def b16_mojibake_rows(spark, sf):
    broken = T.has_mojibake("text", T.MOJIBAKE_MONITOR) | T.has_mojibake("note", T.MOJIBAKE_MONITOR)
    return raw_assets(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.sum(broken.cast("int")).alias("mojibake_rows"))


@query("b17_noise_tokens", f"{_WITH} SELECT row_no, regexp_matches({spaced('description')},'{_words(T.NOISE_TOKENS)}') AS noise, regexp_matches({spaced('description')},'{T.POLLUTED_NAMES}') AS polluted FROM raw")
def b17_noise_tokens(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.has_noise_token("description").alias("noise"), T.matches("description", T.POLLUTED_NAMES).alias("polluted"))


@query("b20_polluted_names", f"{_WITH} SELECT regexp_matches({spaced('description')},'{T.POLLUTED_NAMES}') AS polluted, count(*) AS rows FROM raw GROUP BY 1")
def b20_polluted_names(spark, sf):
    return raw_assets(spark, sf).groupBy(T.matches("description", T.POLLUTED_NAMES).alias("polluted")).agg(F.count(F.lit(1)).alias("rows"))


@query("b18_terms", f"{_WITH} SELECT row_no, array_to_string({terms('field_names')},'+') AS terms, len({terms('field_names', '[;；,，\\n\\r]')})::INT AS n FROM raw")
def b18_terms(spark, sf):
    return raw_assets(spark, sf).select("row_no", F.array_join(T.split_terms("field_names"), "+").alias("terms"), F.size(T.split_terms("field_names", T.FIELD_DELIMITERS)).alias("n"))


def any_term(pattern: str, x: str = "field_names") -> str:
    return f"(len(list_filter({terms(x)}, lambda t: regexp_matches(t,'{pattern}')))>0)::INT"


@query("b19_time_and_place_terms", f"{_WITH} SELECT row_no, {any_term(T.TIME_TERM)} AS time, {any_term(T.GEO_TERM)} AS geo FROM raw")
def b19_time_and_place_terms(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.any_term_matches("field_names", T.TIME_TERM).alias("time"), T.any_term_matches("field_names", T.GEO_TERM).alias("geo"))


@query("b22_lengths_and_hints", f"{_WITH} SELECT row_no, length({spaced('note')})::INT AS n, regexp_matches(coalesce(description,''),'{T.FIELD_HINT}')::INT AS hint, ({'+'.join(f"contains(coalesce(description,''),'{k}')::INT" for k in T.SCENE_KEYWORDS)})::INT AS keywords FROM raw")
def b22_lengths_and_hints(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.text_length("note").alias("n"), T.has_field_hint("description").alias("hint"), T.distinct_keyword_count("description").alias("keywords"))


@query("b23_field_hint", f"{_WITH} SELECT regexp_matches(coalesce(description,''),'{T.FIELD_HINT}')::INT AS hint, count(*) AS rows FROM raw GROUP BY 1")
def b23_field_hint(spark, sf):
    return raw_assets(spark, sf).groupBy(T.has_field_hint("description").alias("hint")).agg(F.count(F.lit(1)).alias("rows"))


@query("b25_log_counts", f"WITH {ASSET} SELECT asset_id, round(ln(1+view_count),6) AS log_view_count, round(ln(1+download_count),6) AS log_download_count FROM asset")
def b25_log_counts(spark, sf):
    return rounded(asset_usage(spark, sf).withColumns(C.log1p_counts("view_count", "download_count")).select("asset_id", "log_view_count", "log_download_count"))


@query("b21_clip", f"{_WITH} SELECT row_no, least(greatest(coalesce(CASE WHEN regexp_full_match(trim(number),'-?\\d+(\\.\\d+)?') THEN TRY_CAST(trim(number) AS DOUBLE) END,0),0),1) AS c FROM raw")
def b21_clip(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.clip01("number").alias("c"))


@query("b26_first_nonempty", f"{_WITH} SELECT row_no, coalesce(nullif({plain('note')},''),nullif({plain('number')},''),nullif({plain('data_size')},''),'') AS v FROM raw")
def b26_first_nonempty(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.first_nonempty("note", "number", "data_size").alias("v"))


_CODE = "(CASE trim(resource_type) WHEN '数据产品' THEN 'cp' WHEN '数据接口' THEN 'jk' ELSE '' END)"
_ID = "regexp_replace(trim(asset_id),'^(\\d+)\\.0$','\\1')"
_URL = f"(CASE WHEN {_CODE}='' THEN '' ELSE 'https://data.sh.gov.cn/view/detail/index.html?type='||{_CODE}||'&&id='||{_ID}||'&&companyFlag=0' END)"


@query("b27_type_codes", f"{_WITH} SELECT row_no, {_CODE} AS code FROM raw")
def b27_type_codes(spark, sf):
    return raw_assets(spark, sf).select("row_no", C.resource_type_code("resource_type").alias("code"))


@query("b28_detail_urls", f"{_WITH} SELECT row_no, {_URL} AS url, CASE WHEN {_CODE}='' THEN '' ELSE {_ID} END AS id FROM raw")
def b28_detail_urls(spark, sf):
    d = raw_assets(spark, sf).withColumn("url", C.build_url(C.DETAIL_URL, C.resource_type_code("resource_type"), T.normalize_id("asset_id")))
    return d.select("row_no", "url", C.id_from_url("url").alias("id"))


_LEVEL = f"""(CASE WHEN trim(department)='' THEN '未知' WHEN regexp_matches(department,'街道|镇人民政府|乡人民政府') THEN '街镇级' WHEN regexp_matches(department,'{_words(C.DISTRICTS)}') THEN '区级'
 WHEN contains(department,'上海市') THEN '市级' WHEN regexp_matches(department,'长三角|国家|中国') THEN '跨区域/国家级' ELSE '其他/不确定' END)"""
_FOUND = "list_filter([" + ",".join(f"CASE WHEN contains({{x}},'{d}') THEN '{d}' END" for d in C.DISTRICTS) + "], lambda d: d IS NOT NULL)"


def places(x: str) -> str:
    found = _FOUND.replace("{x}", x)
    return f"(CASE WHEN len({found})>0 THEN array_to_string({found},';') WHEN contains({x},'上海市') OR starts_with({x},'市') THEN '上海市' ELSE '' END)"


@query("b29_admin_level", f"{_WITH} SELECT row_no, {_LEVEL} AS level FROM raw")
def b29_admin_level(spark, sf):
    return raw_assets(spark, sf).select("row_no", C.admin_level("department").alias("level"))


@query("b30_places", f"{_WITH} SELECT row_no, {places(spaced('department'))} AS places FROM raw")
def b30_places(spark, sf):
    return raw_assets(spark, sf).select("row_no", C.places_found("department").alias("places"))


def scored(x: str, scores: dict, other: float) -> str:
    return f"(CASE {plain(x)} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.items()) + f" ELSE {other} END)::DOUBLE"


@query("b32_lookup_score", f"{_WITH} SELECT row_no, {scored('domain', C.DOMAIN_SCORE, 0.6)} AS domain, {scored('update_frequency', C.FREQUENCY_SCORE, 0.4)} AS frequency, {scored('spatial_level', C.SPATIAL_SCORE, 0.5)} AS spatial FROM raw")
def b32_lookup_score(spark, sf):
    tables = {"domain": ("domain", C.DOMAIN_SCORE), "frequency": ("update_frequency", C.FREQUENCY_SCORE), "spatial": ("spatial_level", C.SPATIAL_SCORE)}
    return raw_assets(spark, sf).select("row_no", *[C.lookup_score(c, s, C.OTHER_SCORE[n]).alias(n) for n, (c, s) in tables.items()])


@query("b33_conversion", f"WITH {ASSET} SELECT asset_id, round(download_count/(view_count+1),6) AS download_conversion, round(api_call_count/(view_count+1),6) AS api_conversion, round((download_count+api_call_count)/(view_count+1),6) AS overall_conversion FROM asset")
def b33_conversion(spark, sf):
    made = C.conversion_ratios("view_count", "download_count", "api_call_count")
    return rounded(asset_usage(spark, sf).select("asset_id", *[c.alias(n) for n, c in made.items()]))


# ---- patterns on page texts, which are put together from the raw assets

#: A page's text of each asset, for both engines.
PAGE = """SELECT row_no, p_name, p_size, number, field_names, CASE row_no % 5
 WHEN 0 THEN '首页 > 数据资源 > 数据产品详情' || chr(10) || p_name || ' 数据' || chr(10) || '摘要：' || p_brand || ' 的说明' || chr(10) || '数据来源部门：' || p_type || chr(10) || '访问/下载次数：' || CAST(row_no AS STRING) || '/' || CAST(p_size AS STRING) || chr(10) || '格式 CSV JSON' || chr(10) || '用户评分：' || CAST(p_size AS STRING) || '.5 评论 ' || CAST(row_no AS STRING)
 WHEN 1 THEN p_name || chr(10) || '访问/下载次数/调用次数: ' || CAST(row_no AS STRING) || '/-/' || CAST(p_size AS STRING) || chr(10) || 'API说明文档 API-1(JSON) https://data.sh.gov.cn/interface/' || CAST(row_no AS STRING) || ' https://data.sh.gov.cn/interface/a' || chr(10) || '接口服务地址 请先申请使用' || chr(10) || 'XCSV rdf,xml'
 WHEN 2 THEN '数据集推荐' || chr(10) || p_name || ' 统计' || chr(10) || '查看 ' || p_name || chr(10) || CAST(row_no * 10000 AS STRING) || chr(10) || '了解详情' || chr(10) || '了解详情' || chr(10) || '了解详情' || chr(10) || 'abc'
 WHEN 3 THEN '上海市公共数据开放平台' || chr(10) || '首页' || chr(10) || 'DATA ITEM' || chr(10) || p_name || ' ' || p_brand || ' 位置' || chr(10) || '数据大小：' || CAST(p_size AS STRING) || ' KB 更新频率：每天' || chr(10) || '验证码'
 ELSE NULL END AS text FROM raw"""
_PAGES = f"WITH {RAW_SQL}, page AS ({PAGE})"
_T = "coalesce(text,'')"


def page_texts(spark, sf):
    return spark.sql(PAGE.replace("FROM raw", "FROM {raw}"), raw=raw_assets(spark, sf))


_LABELS = ("RDF", "XML", "CSV", "JSON", "XLSX")
_FORMATS = "list_filter([" + ",".join(f"CASE WHEN regexp_matches(upper({_T}),'(^|[^A-Z]){k}($|[^A-Z])') THEN '{k}' END" for k in _LABELS) + "], lambda f: f IS NOT NULL)"
_FORMAT_WORDS = "list_filter([" + ",".join(f"CASE WHEN regexp_matches(lower({_T}),'\\b{k}\\b') THEN '{k}' END" for k in sorted(T.FORMAT_WORDS)) + "], lambda f: f IS NOT NULL)"


@query("c1_formats", f"{_PAGES} SELECT row_no, array_to_string({_FORMATS},';') AS labels, array_to_string({_FORMAT_WORDS},';') AS words FROM page")
def c1_formats(spark, sf):
    return page_texts(spark, sf).select("row_no", F.array_join(T.formats_in_text("text"), ";").alias("labels"), F.array_join(T.format_words("text"), ";").alias("words"))


@query("c2_format_word_counts", f"{_PAGES} SELECT word, count(*) AS rows FROM (SELECT unnest({_FORMAT_WORDS}) AS word FROM page) GROUP BY 1")
def c2_format_word_counts(spark, sf):
    return page_texts(spark, sf).select(F.explode(T.format_words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))


@query("c3_format_record", f"{_PAGES}, f AS (SELECT row_no, {_FORMATS} AS f FROM page) SELECT row_no, array_to_string(f,';') AS download_formats, {', '.join(f"list_contains(f,'{k}')::INT AS has_{k.lower()}" for k in _LABELS)}, len(f)::INT AS format_count FROM f")
def c3_format_record(spark, sf):
    return page_texts(spark, sf).withColumn("f", T.formats_in_text("text")).select("row_no", T.format_record("f").alias("r")).select("row_no", "r.*")


@query("c6_value_after_label", f"{_PAGES} SELECT row_no, trim(regexp_replace(regexp_extract({_T},'数据大小[ \\t]*[:：]?[ \\t]*([^\\n\\r]{{1,80}})',1),'更新频率.*$','')) AS size, CASE WHEN contains({_T},'数据来源部门') THEN trim(regexp_extract({_T},'数据来源部门[:：]([^\\n]*)',1)) ELSE trim(regexp_extract({_T},'摘要[:：]([^\\n]*)',1)) END AS source FROM page")
def c6_value_after_label(spark, sf):
    return page_texts(spark, sf).select("row_no", F.coalesce(T.value_after_label("text", ("数据大小",)), F.lit("")).alias("size"), T.value_after_label("text", ("数据来源部门", "摘要")).alias("source"))


_CELLS = f"cell AS (SELECT row_no, unnest({terms('field_names', '[;；,，\\n\\r]')}) AS v FROM raw)"
_WEAK = f"(regexp_matches(v,'[一-鿿]') AND NOT regexp_matches(v,'[A-Za-z_]') AND NOT regexp_matches(v,'{_words(T.FIELD_HINTS)}'))"
_BANNED = "v IN (" + ",".join(f"'{w}'" for w in T.FIELD_BANNED) + ")"
_FIELD = f"""(regexp_matches(v,'^[A-Za-z_][A-Za-z0-9_]*$|^[一-鿿A-Za-z0-9_（）()、/.-]+$') AND NOT ({_BANNED} OR lower(v) IN ('','nan','none','null') OR starts_with(lower(v),'unnamed') OR regexp_matches(v,'标签|標籤|关键|關鍵|下载|下載')
 OR regexp_matches(v,'^\\d+$') OR regexp_matches(v,'^\\d{{4}}[./-]\\d{{1,2}}([./-]\\d{{1,2}})?$') OR regexp_matches(v,'^[\\d./:： -]+$') OR regexp_matches(v,'\\d+(米|号|號|年|月|日|:|：)')
 OR (contains(v,'路') AND regexp_matches(v,'约|進|进|出|侧|側|段|隧道')) OR length(v)>30 OR ({_WEAK} AND length(v)>12)))"""


@query("c8_field_names", f"WITH {RAW_SQL}, {_CELLS} SELECT row_no, v, {_FIELD} AS ok, {_WEAK} AS weak FROM cell")
def c8_field_names(spark, sf):
    d = raw_assets(spark, sf).select("row_no", F.explode(T.split_terms("field_names", T.FIELD_DELIMITERS)).alias("v"))
    return d.select("row_no", "v", T.looks_like_field_name("v").alias("ok"), T.is_weak_label("v").alias("weak"))


@query("c9_weak_label_counts", f"WITH {RAW_SQL}, {_CELLS} SELECT regexp_matches(v,'[一-鿿]') AND NOT regexp_matches(v,'[A-Za-z_]') AND NOT regexp_matches(v,'名称|地址') AS weak, count(*) AS rows FROM cell GROUP BY 1")
def c9_weak_label_counts(spark, sf):
    d = raw_assets(spark, sf).select(F.explode(T.split_terms("field_names", T.FIELD_DELIMITERS)).alias("v"))
    return d.groupBy(T.is_weak_label("v", ("名称", "地址")).alias("weak")).agg(F.count(F.lit(1)).alias("rows"))


_CLEAN = f"""clean AS (SELECT row_no, list_sort(list_distinct(list(v) FILTER ({_FIELD}))) AS n, coalesce(len(list_distinct(list(v) FILTER ({_FIELD} AND {_WEAK}))),0) AS weak FROM cell GROUP BY 1),
 cleaned AS (SELECT row_no, coalesce(CASE WHEN len(n)>=4 AND weak>=greatest(3,ceil(len(n)/2)) THEN list_filter(n, lambda v: NOT {_WEAK}) ELSE n END,[]) AS names FROM clean)"""


@query("c10_clean_field_names", f"WITH {RAW_SQL}, {_CELLS}, {_CLEAN} SELECT row_no, coalesce(array_to_string(names,';'),'') AS names, coalesce(len(names),0)::INT AS n FROM raw LEFT JOIN cleaned USING (row_no)")
def c10_clean_field_names(spark, sf):
    names = T.clean_field_names("field_names")
    return raw_assets(spark, sf).select("row_no", F.array_join(names, ";").alias("names"), F.size(names).alias("n"))


@query("d14_suspicious_field_names", f"""WITH {RAW_SQL}, {_CELLS} SELECT row_no, coalesce(bool_or(regexp_matches(v,'^\\d{{4}}[./-]\\d{{1,2}}([./-]\\d{{1,2}})?$')) OR (count(v)>=4 AND sum({_WEAK}::INT)>=greatest(3,ceil(count(v)/2))),false) AS suspicious FROM raw LEFT JOIN cell USING (row_no) GROUP BY 1""")
def d14_suspicious_field_names(spark, sf):
    return raw_assets(spark, sf).select("row_no", T.suspicious_field_names("field_names").alias("suspicious"))


@query("c12_recommendations", f"""{_PAGES} SELECT row_no, CASE WHEN row_no%5=2 THEN {spaced("p_name||' 统计'")} ELSE '' END AS recommended_dataset_names, CASE WHEN row_no%5=2 THEN 3 ELSE 0 END AS recommended_dataset_count FROM page""")
def c12_recommendations(spark, sf):
    return page_texts(spark, sf).select("row_no", *[c.alias(n) for n, c in T.recommendations("text").items()])


@query("c13_rating_and_comments", f"{_PAGES} SELECT row_no, CASE WHEN row_no%5=0 THEN p_size+0.5 END AS rating_score, CASE WHEN row_no%5=0 THEN row_no END AS comment_count FROM page")
def c13_rating_and_comments(spark, sf):
    return page_texts(spark, sf).select("row_no", *[c.alias(n) for n, c in T.rating_and_comments("text").items()])


@query("c14_need_apply", f"{_PAGES} SELECT row_no, regexp_matches({_T},'{_words(T.APPLY_WORDS)}')::INT AS apply FROM page")
def c14_need_apply(spark, sf):
    return page_texts(spark, sf).select("row_no", T.api_need_apply("text").alias("apply"))


_JOINED = f"lower(coalesce(field_names,'')||' '||{_T})"


@query("c15_field_flags", f"{_PAGES} SELECT row_no, regexp_matches({_JOINED},'{_words(T.TIME_TOKENS)}')::INT AS has_time_field, regexp_matches({_JOINED},'{_words(T.GEO_TOKENS)}')::INT AS has_geo_field FROM page")
def c15_field_flags(spark, sf):
    return page_texts(spark, sf).select("row_no", *[c.alias(n) for n, c in T.field_flags(T.split_terms("field_names"), "text").items()])


@query("c16_usage_counts", f"{_PAGES} SELECT row_no, CASE WHEN row_no%5<2 THEN row_no END AS view_count, CASE WHEN row_no%5=0 THEN p_size END::BIGINT AS download_count, CASE WHEN row_no%5=1 THEN p_size END::BIGINT AS api_call_count FROM page")
def c16_usage_counts(spark, sf):
    return page_texts(spark, sf).select("row_no", T.usage_counts("text").alias("u")).select("row_no", "u.*")


@query("c17_title_and_summary", f"{_PAGES} SELECT row_no, CASE row_no%5 WHEN 0 THEN {spaced("p_name||' 数据'")} WHEN 1 THEN CASE WHEN length({spaced('p_name')})>=6 THEN {spaced('p_name')} ELSE regexp_extract({_T},'访问[^\\n]*') END WHEN 2 THEN CASE WHEN length({spaced("p_name||' 统计'")})>=6 THEN {spaced("p_name||' 统计'")} ELSE '查看 '||p_name END WHEN 3 THEN regexp_extract({_T},'([^\\n]*) 位置') ELSE '' END AS title, CASE WHEN row_no%5=0 THEN p_type ELSE '' END AS source_department, CASE WHEN row_no%5=0 THEN p_brand||' 的说明' ELSE '' END AS summary FROM page JOIN (SELECT p_partkey AS row_no, p_type, p_brand FROM part) USING (row_no)")
def c17_title_and_summary(spark, sf):
    return page_texts(spark, sf).select("row_no", *[F.coalesce(c, F.lit("")).alias(n) for n, c in T.title_and_department("text").items()], F.coalesce(T.summary_text("text"), F.lit("")).alias("summary"))


@query("c18_api_info", f"{_PAGES} SELECT row_no, (row_no%5=1)::INT AS has_api_doc, (row_no%5=1)::INT AS has_api_json, 0 AS has_api_xml, CASE WHEN row_no%5=1 THEN 2 ELSE 0 END AS api_service_url_count, CASE WHEN row_no%5=1 THEN 'https://data.sh.gov.cn/interface/'||row_no||';https://data.sh.gov.cn/interface/a' ELSE '' END AS api_service_urls, (row_no%5=1)::INT AS api_service_hidden_or_need_apply FROM page")
def c18_api_info(spark, sf):
    return page_texts(spark, sf).select("row_no", *[c.alias(n) for n, c in T.api_info("text").items()])


@query("c21_remarks", f"{_PAGES} SELECT row_no, concat_ws('；', CASE WHEN len({_FORMATS})=0 THEN '未识别到格式标签' END, CASE WHEN coalesce(field_names,'')='' THEN '未识别到字段列表' END, CASE WHEN contains({_T},'验证码') THEN '页面疑似出现访问限制' END) AS remark FROM page")
def c21_remarks(spark, sf):
    parts = {"未识别到格式标签": F.size(T.formats_in_text("text")) > 0, "未识别到字段列表": ~T.is_blank("field_names")}
    return page_texts(spark, sf).select("row_no", T.absent_parts(parts, {"页面疑似出现访问限制": "验证码"}, "text").alias("remark"))


@query("l5_ordered_distinct", f"{_WITH} SELECT row_no, CASE WHEN p_brand=p_type THEN p_brand||';x' ELSE p_brand||';x;'||p_type END AS d FROM raw")
def l5_ordered_distinct(spark, sf):
    twice = F.array("p_brand", F.lit("x"), "p_type", "p_brand", F.lit("x"))
    return raw_assets(spark, sf).select("row_no", F.array_join(T.ordered_distinct(twice), ";").alias("d"))
