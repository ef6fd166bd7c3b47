"""Page extraction: one Arrow pass with the standard library's parser, and patterns where a pattern is enough."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators.merge import name_hits
from assetlens.scratch import Scratch

PARTS = {"title": "string", "headings": "array<string>", "links": "array<struct<href:string,text:string,block:string>>", "tables": "array<array<array<string>>>", "body": "string"}
#: Elements that end a line of text, and those whose content is no text.
BREAKS = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "ul", "ol", "table", "header", "footer"))
HIDDEN = frozenset(("script", "style", "noscript", "template"))
#: Elements that hold no tags, in any version of the parser, and those that hold none in some; what may be a tag, and one of plain form.
RAW = frozenset(("script", "style"))
ODD = frozenset(("textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "listing"))
MARKS = re.compile("(<[^>]*>)")
PLAIN_TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9_-]*="[^"<>]*")*)>')
PLAIN_COMMENT = re.compile("<!--[^<>-]*-->")
ATTRIBUTE = re.compile(r' ([^=]*)="([^"]*)"')
#: Most tags that a task keeps as they were read.
TAGS_KEPT = 4096


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.links, self.tables = "", [], [], []
        self.out, self.hidden, self.inside = [], 0, []
        self.heading = self.link = self.cell = None
        self.block_start = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BREAKS:
            self.out.append("\n")
            self.block_start = len(self.out)
        if tag == "a":
            self.link = [dict(attrs).get("href") or "", len(self.out), self.block_start]
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = len(self.out)
        elif tag == "title":
            self.inside.append("title")
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = len(self.out)

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "a" and self.link:
            href, at, block = self.link
            self.links.append((href, self._text(at), self._text(block)))
            self.link = None
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.heading is not None:
            self.headings.append(self._text(self.heading))
            self.heading = None
        elif tag == "title" and self.inside:
            self.inside.pop()
        elif tag in ("td", "th") and self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(self._text(self.cell))
            self.cell = None
        if tag in BREAKS:
            self.out.append("\n")
            self.block_start = len(self.out)

    def handle_data(self, data):
        if self.inside:
            self.title += data
        elif not self.hidden:
            self.out.append(data)

    def _text(self, at: int) -> str:
        return " ".join("".join(self.out[at:]).split())

    def part(self, name: str):
        if name == "body":
            lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
            return "\n".join(x for x in lines if x)
        if name == "tables":
            tables = [[r for r in t if any(c.strip() for c in r)] for t in self.tables]
            return [t for t in tables if t]
        return " ".join(self.title.split()) if name == "title" else getattr(self, name)


class _Tag(HTMLParser):
    """The tag of a text that is one start tag."""

    def handle_starttag(self, tag, attrs):
        self.found = ("", tag, attrs)


def _plain_tag(mark: str) -> tuple[str, str, list]:
    """A slash for an end tag, the name and the attributes; a name that is empty if the tag isn't plain."""
    m = PLAIN_TAG.fullmatch(mark)
    if m is None or (m[1] and m[3]) or (name := m[2].lower()) in ODD:
        return "", "", []
    if "&" in m[3]:  # how references in values are read is the library's own
        t = _Tag()
        t.feed(mark)
        return t.found
    return m[1], name, [(a.lower(), v) for a, v in ATTRIBUTE.findall(m[3])]


def _plain_page(html: str, tags: dict) -> _Page | None:
    """The page if all of its tags are plain: the calls that HTMLParser would make, without its search for each kind of mark. None if any is not."""
    p, raw = _Page(), ""
    for k, x in enumerate(MARKS.split(html)):  # texts and marks in turn
        if not x:
            continue
        if raw:
            if x.lower() == f"</{raw}>":
                p.handle_endtag(raw)
                raw = ""
            elif "<!" in x or ("</" in x and raw in x.lower()):
                return None
            else:
                p.handle_data(x)
        elif k % 2 == 0:
            if "<" in x:
                return None
            p.handle_data(unescape(x) if "&" in x else x)
        else:
            if (tag := tags.get(x)) is None:
                if len(tags) >= TAGS_KEPT:
                    tags.clear()
                tag = tags[x] = _plain_tag(x)
            end, name, attrs = tag
            if not name:
                if k == 1 and x.lower() == "<!doctype html>" or not p.inside and PLAIN_COMMENT.fullmatch(x):
                    continue
                return None
            if end:
                p.handle_endtag(name)
            elif p.inside:
                return None
            else:
                p.handle_starttag(name, attrs)
                raw = name if name in RAW else ""
    return None if raw or p.inside else p


def read_page(html: str, tags: dict) -> _Page:
    """The page as HTMLParser reads it; pages of plain tags are read by a shorter way. tags keeps the tags that were seen."""
    p = _plain_page(html, tags)
    if p is None:
        p = _Page()
        p.feed(html)
        p.close()
    return p


def _lists(values: list, depth: int) -> pa.Array:
    """Texts in lists of lists, from one flat column and its offsets."""
    if not depth:
        return pa.array(values, pa.string())
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), _lists(list(chain.from_iterable(values)), depth - 1))


def _column(values: list, name: str) -> pa.Array:
    if name != "links":
        return _lists(values, {"headings": 1, "tables": 3}.get(name, 0))
    flat = list(chain.from_iterable(values))
    links = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in range(3)], names=["href", "text", "block"])
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), links)


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """key, the columns to keep and the parts (all of PARTS, or those that are named) of each page. Null html gives empty parts; broken html what the parser makes of it.

    A task parses the pages of one partition, so what compact files hold should be spread() first.
    """
    kinds_of = {f.name: f.dataType.simpleString() for f in pages.select(key, *keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = [read_page(text or "", tags) for text in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[_column([p.part(c) for p in read], c) for c in parts]], names=[*kinds_of, *parts])

    return pages.select(key, *keep, html).mapInArrow(run, ", ".join([f"`{c}` {k}" for c, k in kinds_of.items()] + [f"{c} {PARTS[c]}" for c in parts]))


def written_title(html: str) -> Column:
    """The title as it is written in the page, of whose character references only &amp; is read: other references, and those without a semicolon, stay."""
    return F.replace(F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), F.lit("&amp;"), F.lit("&"))


def table_metadata(tables: Column, labels: tuple[str, ...] = (), last_wins: bool = False, most: int = 30) -> Column:
    """Map of label to value from cells that follow each other, in a row or over its end. Of a label's values that aren't empty the first counts; or, for given labels, the last."""
    def neighbours(cells):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1))), lambda i: F.struct((F.get(cells, i - 1) if labels else F.regexp_replace(F.get(cells, i - 1), "[:：]+$", "")).alias("k"), F.get(cells, i).alias("v")))

    pairs = T.bound(F.flatten(F.flatten(tables)), neighbours)
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["k"] != ""))
    pairs = F.filter(pairs, lambda p: p["k"].isin(*labels)) if labels else F.filter(pairs, lambda p: (F.char_length(p["k"]) <= most) & (p["v"] != ""))
    # sorted by label and place, the first of each label's run is the one that counts
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i if last_wins else i).alias("at"), p["v"].alias("v"))))
    runs = T.bound(placed, lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["k"] != p["k"])))
    return F.map_from_entries(F.transform(runs, lambda p: F.struct(p["k"], p["v"])))


def link_records(parsed: DataFrame, key: str, id_param: str = "id") -> DataFrame:
    """Of each page's links with an id: the formats named in the link's block; the last link of an id counts."""
    link = parsed.select(key, F.posexplode("links").alias("pos", "link"))
    link = link.withColumn("asset_id", F.regexp_extract("link.href", rf"[?&]{id_param}=([^&#]*)", 1)).where("asset_id <> ''")
    link = link.withColumn("formats", T.formats_in_text(F.col("link.block")))
    return link.groupBy(key, "asset_id").agg(F.max_by("formats", "pos").alias("formats"))


def name_records(parsed: DataFrame, names: DataFrame, key: str, asset_id: str = "asset_id", name: str = "name", id_param: str = "id") -> DataFrame:
    """key, block, formats, match_count and asset_id: the fallback for pages of which no link with an id has formats.

    A block starts at a line of 4 to 80 characters; those that name formats count. asset_id is set where exactly one id's name
    is in the block, else the block is unmatched; names are a table of asset_id and name. Pages are parsed once, their blocks
    and the names written; all joins are shuffled, as Spark takes what it has not yet seen for smaller than it is.
    """
    scratch = Scratch(parsed.sparkSession, "names")
    parsed = scratch.written(parsed.select(key, "links", "body"), "pages")
    done = link_records(parsed, key, id_param).where(F.size("formats") > 0).select(key).distinct()
    blocks = parsed.select(key, "body").join(done.hint("merge"), key, "left_anti").select(key, F.explode(F.split("body", r"\n(?=[^\n]{4,80}(?:\n|$))")).alias("block"))
    blocks = scratch.written(blocks.withColumn("formats", T.formats_in_text("block")).where(F.size("formats") > 0), "blocks")
    scratch.drop("pages")
    ids = scratch.written(names.select(F.col(asset_id).alias("asset_id"), F.col(name).alias("_name")).where("asset_id is not null").distinct(), "ids")
    found = name_hits(blocks, ids, "block", "_name").join(ids.hint("merge"), "_name").groupBy("block").agg(F.countDistinct("asset_id").alias("match_count"), F.min("asset_id").alias("asset_id"))
    out = blocks.join(found.hint("merge"), "block", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return out.select(key, "block", "formats", "match_count", F.when(F.col("match_count") == 1, F.col("asset_id")).alias("asset_id"))


def detail_links(parsed: DataFrame, keyword: str, host: str | None = None) -> DataFrame:
    """Distinct hrefs that hold the keyword, relative or on the host."""
    href = parsed.select(F.explode("links.href").alias("href")).where(F.contains("href", F.lit(keyword)))
    if host:
        own = F.regexp_extract("href", "^[a-z]+://([^/?#]+)", 1)
        href = href.where((own == "") | (own == host))
    return href.distinct()


def field_info(tables: Column, name_words=("name", "field", "字段名称", "参数名"), text_words=("description", "说明", "字段描述"), banned=T.FIELD_BANNED, hints=T.FIELD_HINTS) -> Column:
    """names, described and headers from the first table with a name column; a table that is only a header lends it to the next one."""
    place = lambda row, words: F.array_position(F.transform(row, lambda c: F.lower(c).rlike(T.quoted([w.lower() for w in words]))), True)
    empty = F.array().cast("array<string>")

    def of_table(t):
        rows = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
        at = F.struct(place(F.get(t, F.lit(0)), name_words).cast("int").alias("name"), place(F.get(t, F.lit(0)), text_words).cast("int").alias("told"))
        names = T.bound(at, lambda at: F.transform(rows, lambda r: F.get(r, at["name"] - 1)))
        names = F.filter(names, lambda x: x.isNotNull() & T.looks_like_field_name(x, banned, hints))
        described = T.bound(at, lambda at: F.size(F.filter(rows, lambda r: (at["told"] > 0) & (F.coalesce(F.get(r, at["told"] - 1), F.lit("")) != ""))))
        return F.struct(F.array_sort(F.array_distinct(names)).alias("names"), described.alias("described"), empty.alias("headers"))

    def of_tables(sized):
        joined = F.transform(sized, lambda t, i: F.when((i > 0) & (F.size(F.get(sized, i - 1)) == 1), F.concat(F.get(sized, i - 1), t)).otherwise(t))
        found = F.slice(F.filter(joined, lambda t: (F.size(t) > 1) & (place(F.get(t, F.lit(0)), name_words) > 0)), 1, 1)
        headers = F.filter(F.get(F.get(sized, F.lit(0)), F.lit(0)), lambda x: T.looks_like_field_name(x, banned, hints))
        without = F.struct(empty.alias("names"), F.lit(0).alias("described"), F.coalesce(headers, empty).alias("headers"))
        return T.bound(found, lambda f: F.when(F.size(f) > 0, T.bound(F.get(f, F.lit(0)), of_table)).otherwise(without))

    return T.bound(F.filter(tables, lambda t: F.size(t) > 0), of_tables)


def detail_record(pages: DataFrame, key: str = "page_id", gone_markers: tuple[str, ...] = (), labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One record per page: status, formats, fields, values by label (table first, then text), usage counters and service links."""
    p = parse_pages(pages, key, parts=("title", "links", "tables", "body"))
    meta = table_metadata(F.col("tables"))
    p = p.withColumns({"meta": meta, "fields": field_info(F.col("tables")), "formats": T.formats_in_text(F.col("body")), "urls": T.service_urls(F.col("body")), "usage": T.usage_counts(F.col("body"))})
    gone = T.contains_any(F.col("body"), gone_markers) if gone_markers else F.lit(False)
    values = {n: F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(k)), F.lit("")) for k in ks], T.value_after_label(F.col("body"), ks)) for n, ks in (labels or {}).items()}
    out = {
        "scrape_status": F.when(gone, "unavailable").otherwise("success"), "title": F.col("title"), "download_formats": F.array_join("formats", ";"), "format_count": F.size("formats"),
        "field_names": F.array_join("fields.names", ";"), "field_count": F.size("fields.names"), "field_description_count": F.col("fields.described"), "sample_headers": F.array_join("fields.headers", ";"),
        "view_count": F.col("usage.view_count"), "download_count": F.col("usage.download_count"), "api_call_count": F.col("usage.api_call_count"), "service_url_count": F.size("urls"), "link_count": F.size("links"), **values,
    }
    nulls = [c for c in out if c != "scrape_status"]
    d = p.select(key, *[c.alias(n) for n, c in out.items()])
    return d.select(key, "scrape_status", *[F.when(F.col("scrape_status") == "success", F.col(c)).alias(c) for c in nulls])


def unavailable_record(key: str, url: str, at: Column) -> dict[str, Column]:
    """The typed record of a page that says its data set is gone: a final state, so nothing is tried again."""
    text = ("download_formats", "data_size", "field_names", "sample_field_headers", "recommended_dataset_names", "detail_spatial_scope", "detail_time_scope")
    numbers = ("api_need_apply", "record_count", "rating_score", "comment_count")
    counts = ("format_count", "field_count", "has_time_field", "has_geo_field", "field_description_count", "has_standard_field_description", "has_data_sample", "recommended_dataset_count")
    return {
        "asset_id": T.normalize_id(key), "detail_url": F.col(url), **{c: F.lit("") for c in text}, **{c: F.lit(None).cast("double") for c in numbers}, **{c: F.lit(0) for c in counts},
        "scrape_status": F.lit("unavailable"), "scrape_error": F.lit("the page says that the data set's id is wrong or removed"), "scraped_at": at,
    }


def gone_records(pages: DataFrame, key: str, url: str, text: str, at: Column, markers: tuple[str, ...] = T.GONE_MARKERS) -> DataFrame:
    """unavailable_record() of each page whose text holds a marker."""
    return pages.where(T.contains_any(text, markers)).select(*[c.alias(n) for n, c in unavailable_record(key, url, at).items()])


#: The labels of a detail page's table, in its order, by what they are called here.
AUDIT_LABELS = {
    "tags": "数据标签", "keywords": "关键词", "update_frequency": "更新频率", "theme_category": "国家主题分类", "data_quantity": "数据量（条）", "data_quantity_plain": "数据量(条)", "data_size": "数据大小", "first_publish_date": "首次发布日期",
    "update_date": "更新日期", "spatial_scope": "空间范围", "time_scope": "时间范围", "contact": "联系方式", "latest_dataset": "最新数据集", "open_condition": "开放条件", "open_condition_supplement": "开放条件补充", "data_agreement": "数据协议",
}


def audit_record(parsed: DataFrame, key: str) -> DataFrame:
    """One audit record per parsed page: title, department, summary, table values (the last of a label counts), formats, fields, counters, services and scores."""
    body = F.col("body")
    d = parsed.withColumns({"_meta": table_metadata(F.col("tables"), tuple(AUDIT_LABELS.values()), last_wins=True), "_fields": field_info(F.col("tables")), "_formats": T.format_words(body), "_usage": T.usage_counts(body)})
    values = {n: F.coalesce(F.try_element_at("_meta", F.lit(k)), F.lit("")) for n, k in AUDIT_LABELS.items()}
    values["data_quantity"] = F.coalesce(F.nullif(values["data_quantity"], F.lit("")), values.pop("data_quantity_plain"))
    made = {**T.title_and_department(body), "summary": T.summary_text(body), **values}
    made |= {"download_formats": F.array_join("_formats", ";"), "download_format_count": F.size("_formats"), "field_names": F.array_join("_fields.names", ";"), "field_count": F.size("_fields.names"), **T.field_flags("_fields.names", body)}
    made |= {c: F.col(f"_usage.{c}") for c in ("view_count", "download_count", "api_call_count")} | T.api_info(body) | {"recommended_dataset_count": T.recommendations(body)["recommended_dataset_count"]}
    d = d.select(key, *[v.alias(n) for n, v in made.items()])
    return d.withColumns(simple_scores())


def simple_scores() -> dict[str, Column]:
    """Counters that are known, the sum of their logarithms, and how many of eleven things an audit record has."""
    counters = [T.to_number(c) for c in ("view_count", "download_count", "api_call_count")]
    has = {c: F.col(c) != "" for c in ("summary", "theme_category", "keywords", "update_frequency", "update_date")}
    has |= {"fields": F.col("field_count") >= 5, "formats": F.col("download_format_count") >= 2, "recommended": F.col("recommended_dataset_count") >= 1, **{c: F.col(c) == 1 for c in ("has_time_field", "has_geo_field", "has_api_doc")}}
    known = sum((c.isNotNull().cast("int") for c in counters), F.lit(0))
    return {"actual_use_channels": known, "actual_use_log_sum": sum((F.coalesce(F.log1p(c), F.lit(0.0)) for c in counters), F.lit(0.0)), "audit_score": completeness_score(has)}


def completeness_score(conditions: dict[str, Column]) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions.values()), F.lit(0))
