"""The catalog's features, the table that users of the library end with, and the sync between master and checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import catalog as C
from assetlens.functions import text as T
from assetlens.operators.merge import merge_prefer_nonempty
from assetlens.operators.rank import add_percentile, add_percentiles

#: Columns that a detail page supplies, and their types in the catalog before any page was read.
SUPPLEMENT = {
    "download_formats": "string", "data_size": "string", "field_names": "string", "sample_field_headers": "string", "recommended_dataset_names": "string", "detail_spatial_scope": "string",
    "detail_time_scope": "string", "scrape_status": "string", "scrape_error": "string", "scraped_at": "string", "remark": "string", "has_rdf": "double", "has_xml": "double", "has_csv": "double", "has_json": "double",
    "has_xlsx": "double", "api_need_apply": "double", "has_time_field": "double", "has_geo_field": "double", "has_standard_field_description": "double", "has_data_sample": "double", "format_count": "double",
    "record_count": "double", "field_count": "double", "field_description_count": "double", "recommended_dataset_count": "double", "rating_score": "double", "comment_count": "double",
}
COUNTERS = tuple(C.USE_V0)


def actual_use_v0(df: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """log_<c> and <c>_percentile of each counter (null is 0), their weighted sum actual_use_v0 and its percentile."""
    d = df.withColumns({c: F.coalesce(T.to_number(c), F.lit(0.0)) for c in counters}).withColumns({f"log_{c}": F.log1p(c) for c in counters})
    d = add_percentiles(d, {f"{c}_percentile": f"log_{c}" for c in counters}, kind="pct")
    total = sum((F.lit(w) * F.col(f"{c}_percentile") for c, w in C.USE_V0.items()), F.lit(0.0))
    return add_percentile(d.withColumn("actual_use_v0", F.round(total, 12)), "actual_use_v0", "actual_use_percentile", kind="pct")


def catalog_features(df: DataFrame, as_of: Column) -> DataFrame:
    """The catalog with type code, link, spatial level and scope, dates in days, text lengths and hints, use scores, and empty supplement columns."""
    joined = F.concat_ws(" ", *[T.normalize_space(c) for c in ("name", "department", "description")])
    d = df.withColumn("type_code", C.resource_type_code("resource_type"))
    d = d.withColumns({
        "detail_url": C.build_url(C.DETAIL_URL, "type_code", T.normalize_id("asset_id")), "spatial_admin_level": C.admin_level("department"), "inferred_spatial_scope": C.places_found(joined),
        **C.date_features("first_publish_date", "last_update_date", as_of), "title_len": F.char_length(F.coalesce("name", F.lit(""))), "description_len": F.char_length(F.coalesce("description", F.lit(""))),
        "description_has_field_hint": T.has_field_hint("description"), "scene_keyword_count": T.distinct_keyword_count("description"),
    })
    d = actual_use_v0(d)
    empty = {c: F.lit("") if k == "string" else F.lit(None).cast(k) for c, k in SUPPLEMENT.items() if c not in d.columns}
    return d.withColumns(empty) if empty else d


def cleaned_fields(names: str, **words) -> dict[str, Column]:
    """field_names as sorted clean names, and their number."""
    clean = T.clean_field_names(names, **words)
    return {"field_names": F.array_join(clean, ";"), "field_count": F.size(clean)}


def minimum_required(df: DataFrame, characters: tuple[str, str] = ("", ""), **words) -> DataFrame:
    """The 22 columns of the contract; absent ones are empty. characters: a one-to-one character map for sizes and scopes."""
    has = lambda c: F.col(c) if c in df.columns else F.lit("")
    plain = lambda c: T.map_characters(c, *characters)
    fields = cleaned_fields("field_names", **words) if "field_names" in df.columns else {"field_names": F.lit(""), "field_count": F.lit(0)}
    scopes = [c for c in ("detail_spatial_scope", "inferred_spatial_scope") if c in df.columns]
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in scopes], F.lit(""))
    out = {
        "asset_id": has("asset_id"), "name": has("name"), "dataset_url": has("detail_url"), **{c: has(c) for c in ("download_formats", "has_csv", "has_json", "has_xlsx", "has_xml", "has_rdf")},
        "has_api_doc": (F.coalesce(F.col("resource_type"), F.lit("")) == "数据接口").cast("int") if "resource_type" in df.columns else F.lit(""), "api_need_apply": has("api_need_apply"),
        "record_count": has("record_count"), "data_size": plain(has("data_size")), "spatial_scope": plain(first), "time_scope": plain(has("detail_time_scope")), **fields,
        **{c: has(c) for c in ("has_time_field", "has_geo_field", "has_data_sample", "recommended_dataset_count", "remark")},
    }
    return df.select(*[v.alias(k) for k, v in out.items()])


def sync_master(master: DataFrame, checkpoint: DataFrame, key: str, **words) -> tuple[DataFrame, DataFrame]:
    """Master with the checkpoint's non-empty values, its field names cleaned and counted again; and the contract's table of it."""
    merged = merge_prefer_nonempty(master, checkpoint, key)
    if "field_names" in merged.columns:
        merged = merged.withColumns(cleaned_fields("field_names", **words))
    return merged, minimum_required(merged, **words)
