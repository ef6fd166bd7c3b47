"""Catalog features as column expressions: codes, links, admin levels, date features, score tables, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import text as T

#: Scores of a domain, an update frequency and a spatial level, and the scores of all others.
DOMAIN_SCORE = {"民生服务": 0.95, "卫生健康": 0.95, "公共安全": 0.90, "社保就业": 0.90, "城市建设": 0.85, "道路交通": 0.85, "资源环境": 0.85, "绿色低碳": 0.85, "经济建设": 0.80, "教育科技": 0.80, "农业农村": 0.75, "社会发展": 0.75, "信用服务": 0.70, "工业制造": 0.65, "气象服务": 0.65, "文化休闲": 0.60, "机构团体": 0.55}
FREQUENCY_SCORE = {"即时": 1.00, "每天": 0.95, "每周": 0.85, "每月": 0.75, "每季度": 0.65, "每半年": 0.55, "每年": 0.45, "不定期更新": 0.35, "静态数据": 0.25}
SPATIAL_SCORE = {"跨区域/国家级": 1.00, "市级": 0.85, "区级": 0.75, "其他/不确定": 0.30}
OTHER_SCORE = {"domain": 0.60, "frequency": 0.40, "spatial": 0.50}
#: Codes of the resource types, words of a spatial level, and districts by list order.
TYPE_CODES = {"数据产品": "cp", "数据接口": "jk"}
DETAIL_URL = "https://data.sh.gov.cn/view/detail/index.html?type=%s&&id=%s&&companyFlag=0"
DISTRICTS = ("浦东新区", "黄浦区", "徐汇区", "长宁区", "静安区", "普陀区", "虹口区", "杨浦区", "闵行区", "宝山区", "嘉定区", "金山区", "松江区", "青浦区", "奉贤区", "崇明区")
LEVEL_RULES = [("街镇级", ("街道", "镇人民政府", "乡人民政府")), ("区级", DISTRICTS), ("市级", ("上海市",)), ("跨区域/国家级", ("长三角", "国家", "中国"))]
LEVEL_BLANK, LEVEL_OTHER, CITY = "未知", "其他/不确定", "上海市"
#: Weights of the three counters' percentiles in the first version of actual use.
USE_V0 = {"view_count": 0.45, "download_count": 0.35, "api_call_count": 0.20}


def lookup_score(x, scores: dict[str, float], other: float) -> Column:
    """A dictionary's score by trimmed text. The dictionary is a literal map, so nothing is joined."""
    pairs = [F.lit(v) for kv in scores.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), T.normalized_text(x)), F.lit(other))


def resource_type_code(x, codes: dict[str, str] = TYPE_CODES) -> Column:
    t = T.normalize_space(x)
    return F.coalesce(*[F.when(t == k, v) for k, v in codes.items()], F.lit(""))


def build_url(template: str, *columns) -> Column:
    """The template with the columns' values; empty where one of them is."""
    parts = [F.coalesce(T.col(c).cast("string"), F.lit("")) for c in columns]
    blank = F.lit(False)
    for c in parts:
        blank = blank | (c == "")
    return F.when(blank, "").otherwise(F.format_string(template, *parts))


def id_from_url(x, name: str = "id") -> Column:
    """A query parameter's value; repeated separators are tolerated."""
    return F.regexp_extract(F.coalesce(T.col(x), F.lit("")), rf"[?&]{name}=([^&#]*)", 1)


def admin_level(x, rules: list[tuple[str, tuple[str, ...]]] = LEVEL_RULES, blank: str = LEVEL_BLANK, other: str = LEVEL_OTHER) -> Column:
    """The first rule one of whose words the text holds."""
    t = T.normalize_space(x)
    out = F.when(t == "", blank)
    for level, words in rules:
        out = out.when(T.contains_any(t, words), level)
    return out.otherwise(other)


def places_found(x, places: tuple[str, ...] = DISTRICTS, fallback: tuple[str, ...] = (CITY,), default: str = CITY, starts: str = "市") -> Column:
    """Places that the text holds, in list order, joined by semicolons; else the default if a fallback word occurs or the text starts so."""
    t = T.normalize_space(x)
    found = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(p)), p) for p in places]))
    alone = F.when(T.contains_any(t, fallback) | F.startswith(t, F.lit(starts)), default).otherwise("")
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise(alone)


def date_features(published, updated, as_of) -> dict[str, Column]:
    """Days since publication and update, and between them. as_of is a parameter: results don't depend on the day of the run."""
    p, u, d = (F.to_date(F.try_to_timestamp(T.col(c).cast("string"))) for c in (published, updated, as_of))
    return {"publication_age_days": F.datediff(d, p), "update_recency_days": F.datediff(d, u), "maintenance_span_days": F.datediff(u, p)}


def conversion_ratios(view, download, api) -> dict[str, Column]:
    v, d, a = (F.coalesce(T.to_number(c), F.lit(0.0)) for c in (view, download, api))
    return {"download_conversion": d / (v + 1), "api_conversion": a / (v + 1), "overall_conversion": (d + a) / (v + 1)}


def log1p_counts(*columns: str) -> dict[str, Column]:
    return {f"log_{c}": F.log1p(T.to_number(c)) for c in columns}


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("columns are missing: " + ", ".join(missing))
    return df


def ensure_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def existing_first(df: DataFrame, wanted, rest: bool = True) -> DataFrame:
    """Wanted columns that exist, in their order, then the others."""
    first = [c for c in wanted if c in df.columns]
    return df.select(*first, *([c for c in df.columns if c not in first] if rest else []))


def id_column(df: DataFrame, suffix: str = "ID") -> str:
    found = next((c for c in df.columns if c.endswith(suffix)), None)
    if found is None:
        raise ValueError(f"no column ends with {suffix}")
    return found
