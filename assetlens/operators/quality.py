"""Row quality: missing fields, gating, repair, issue lists, scores and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import text as T


def names_where(flags: dict[str, Column]) -> Column:
    """Array of the names whose condition holds, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items()]))


def missing_core(core: list[str], separator: str = ";") -> dict[str, Column]:
    names = names_where({c: T.is_blank(c) for c in core})
    return {"core_missing_fields": F.array_join(names, separator), "core_missing_count": F.size(names)}


def sample_gate(df: DataFrame, core: list[str], status: str = "scrape_status") -> DataFrame:
    """Success, unavailable and completeness flags, the main sample, and why a row is outside it."""
    d = df.withColumns(missing_core(core))
    success, gone = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "success", F.lower(F.trim(F.coalesce(status, F.lit("")))) == "unavailable"
    complete = success & (F.col("core_missing_count") == 0)
    reasons = names_where({"unavailable": gone, "core_missing": F.col("core_missing_count") > 0})
    return d.withColumns({"is_scrape_success": success.cast("int"), "is_unavailable": gone.cast("int"), "is_core_complete": complete.cast("int"), "is_main_analysis_sample": complete.cast("int"), "is_modeling_candidate": complete.cast("int"), "analysis_exclusion_reason": F.array_join(reasons, ";")})


def issue_flags(issues: str, names: list[str]) -> dict[str, Column]:
    return {f"residual_{n}": F.coalesce(F.contains(F.col(issues), F.lit(n)), F.lit(False)).cast("int") for n in names}


def date_flags(df: DataFrame, scope: str, first: str, last: str, span: str) -> DataFrame:
    """Whether the time scope says something, whether dates are in disorder, and the span without negative values."""
    s = T.to_number(span)
    a, b = (F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) for c in (first, last))
    bad = F.coalesce(s < 0, F.lit(False)) | F.coalesce(a > b, F.lit(False))
    return df.withColumns({"has_meaningful_time_scope": (~T.is_placeholder(scope)).cast("int"), "date_order_anomaly": bad.cast("int"), span + "_clean": F.when(s >= 0, s)})


def field_count_repair(df: DataFrame, explicit: str, names: str, success: Column, low: int = 2) -> DataFrame:
    n = F.coalesce(T.to_number(explicit), F.when(~T.is_blank(names), F.size(T.split_terms(names)).cast("double")))
    return df.withColumn("field_count_clean", n).withColumn("low_field_count_flag", (success & F.coalesce(F.col("field_count_clean") <= low, F.lit(False))).cast("int"))


def int_flags(*columns: str) -> dict[str, Column]:
    return {c + "_clean": F.coalesce(T.to_number(c), F.lit(0.0)).cast("int") for c in columns}


def range_flags(rating: str, comments: str, most: int = 100_000) -> dict[str, Column]:
    r, c = T.to_number(rating), T.to_number(comments)
    return {"rating_score_invalid_flag": F.coalesce(~r.between(0, 5), F.lit(False)).cast("int"), "comment_count_invalid_flag": F.coalesce(c > most, F.lit(False)).cast("int")}


def disabled(columns: dict[str, str]) -> dict[str, Column]:
    """Columns that are out of use, as typed nulls."""
    return {c: F.lit(None).cast(kind) for c, kind in columns.items()}


def class_indicators(column: str, values: dict[str, str]) -> dict[str, Column]:
    return {name: F.coalesce(F.trim(column) == v, F.lit(False)).cast("int") for name, v in values.items()}


def all_zero(*columns: str) -> Column:
    return (sum((F.coalesce(T.to_number(c), F.lit(0.0)) for c in columns), F.lit(0.0)) == 0).cast("int")


def quality_issues(core: list[str], status: str, text_columns: list[str], names: str, field_count: str, reason: str | None = None, least_fields: int = 3) -> Column:
    """Issue names of a record: its status if it isn't a success, else what is missing or looks broken."""
    ok = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "success"
    flags = {f"missing_{c}": T.is_blank(c) for c in core}
    mojibake = F.lit(False)
    for c in text_columns:
        mojibake = mojibake | T.has_mojibake(c, T.MOJIBAKE_MONITOR)
    flags["mojibake"] = mojibake
    flags["suspicious_field_names"] = T.suspicious_field_names(names)
    few = F.coalesce(T.to_number(field_count) < least_fields, F.lit(True))
    flags["field_terms_too_few"] = few & F.coalesce(F.contains(F.col(reason), F.lit("field_terms_too_few")), F.lit(False)) if reason else few
    return F.when(ok, names_where(flags)).otherwise(F.array(F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("non_success"))))


#: Points of a record's status, of each thing that is missing or broken, and of fields and formats with their limits.
STATUS_POINTS = {"success": 10_000, "unavailable": -1_000, None: -2_000}
LOST_POINTS = {"missing": 600, "mojibake": 800, "suspicious": 300, "few": 250}
GAINED_POINTS = {"fields": (8, 200), "formats": (5, 50)}


def quality_score(status: str, missing: Column, mojibake: Column, suspicious: Column, few: Column, fields: Column, formats: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    out = F.when(s == "success", STATUS_POINTS["success"]).when(s == "unavailable", STATUS_POINTS["unavailable"]).otherwise(STATUS_POINTS[None])
    for name, c in {"missing": missing, "mojibake": mojibake, "suspicious": suspicious, "few": few}.items():
        out = out - LOST_POINTS[name] * F.coalesce(c.cast("int"), F.lit(0))
    for name, c in {"fields": fields, "formats": formats}.items():
        each, most = GAINED_POINTS[name]
        out = out + F.least(F.lit(most), each * F.coalesce(c, F.lit(0)))
    return out


def bool_mask(df: DataFrame, column: str) -> Column:
    """Rows where the column is 1; all false if there is no such column."""
    return F.coalesce(T.to_number(column) == 1, F.lit(False)) if column in df.columns else F.lit(False)


def terminal(status: str) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("success", "unavailable")


def leakage(features: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """feature and one 0/1 column per rule: whether the name holds a forbidden pattern, in any case."""
    name = F.lower("feature")
    return features.select("feature", *[F.coalesce(name.rlike(T.quoted([p.lower() for p in pats])), F.lit(False)).cast("int").alias(rule) for rule, pats in rules.items()])


def ensure_no_leakage(columns: list[str], forbidden: list[str]) -> None:
    hit = [c for c in columns if any(p.lower() in c.lower() for p in forbidden)]
    if hit:
        raise ValueError("features that leak the target: " + ", ".join(hit))


def prepared(df: DataFrame, categories: list[str], numbers: list[str], texts: list[str] = (), missing: str = "缺失", out: str = "combined_text") -> DataFrame:
    """Categories without blanks, numbers as doubles (0 where a column has none at all), texts joined by blanks."""
    made = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(missing)) for c in categories}
    none = df.agg(*[F.max(T.to_number(c)).isNull().alias(f"_none_{c}") for c in numbers]) if numbers else None
    d = df.crossJoin(F.broadcast(none)) if numbers else df
    made |= {c: F.when(F.col(f"_none_{c}"), 0.0).otherwise(T.to_number(c)) for c in numbers}
    if texts:
        made[out] = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
    return d.withColumns(made).drop(*[f"_none_{c}" for c in numbers])


def quality_gate(df: DataFrame, checks: dict[str, Column], fatal: list[str]) -> DataFrame:
    """Counts per check; raises if a fatal one isn't 0. The counts are one row."""
    out = df.agg(F.count(F.lit(1)).alias("rows_checked"), *[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in checks.items()])
    row = out.first()
    bad = [k for k in fatal if row[k]]
    if bad:
        raise ValueError("quality gate: " + ", ".join(f"{k}={row[k]}" for k in bad))
    return out
