"""Landed-feed readers: RSS/Atom XML, HTML pages, JSON APIs, line files, plain text feeds.

A landed feed is one file (one fetch). Files are read whole (one row per
file, ``wholetext``) so that item positions - which the per-feed caps are
defined on - are exact; a single feed is bounded by what one fetch returns,
while the number of feeds is unbounded and spreads across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.html import select_inner
from vigil.functions.text import LINE_BREAK, py_strip, strip_html

RAW_COLUMNS = ["source", "source_url", "raw_text", "raw_metadata", "pos"]
# RSS 2.0 items and Atom entries; Atom text and links may carry attributes, which the XML reader gives as fields
FEED_SCHEMA = ("channel struct<item: array<struct<title: string, description: string, link: string, pubDate: string, content: string, "
               "`content:encoded`: string>>>, "
               "entry array<struct<title: struct<_VALUE: string>, summary: struct<_VALUE: string>, content: struct<_VALUE: string>, "
               "link: array<struct<_href: string, _rel: string>>, published: string, updated: string>>")
TEXT_KEYS = ["text", "content", "body", "message", "title"]
URL_KEYS = ["url", "link", "source_url"]


# --- text assembly -------------------------------------------------------------

def join_parts(*parts: Column) -> Column:
    """Stripped, non-blank parts joined by newline ("" when none)."""
    cleaned = [F.when(py_strip(p) != "", py_strip(p)) for p in parts]
    return F.coalesce(F.concat_ws("\n", *cleaned), F.lit(""))


def apply_prefix(text: Column, prefix: str | None) -> Column:
    """Prefix (stripped) and one space in front of non-empty text; empty text stays empty."""
    if prefix is None or not prefix.strip():
        return F.coalesce(text, F.lit(""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(prefix.strip() + " "), text))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per landed file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


# --- RSS -------------------------------------------------------------------------

def rss_events(feeds: DataFrame, name: Column, feed_url: Column, max_items: int | None = None,
               prefix: str | None = None) -> DataFrame:
    """Feeds (one XML document per row in ``value``) -> one raw event per entry.

    ``max_items``, where a source's own configuration names one, counts entries before empty ones are dropped.
    """
    parsed = feeds.select(name.alias("source"), feed_url.alias("feed_url"), F.from_xml("value", FEED_SCHEMA, {"rowTag": "rss"}).alias("x"))
    rss = F.transform("x.channel.item", lambda i: F.struct(
        i["title"].alias("title"), i["description"].alias("description"), F.coalesce(i["content:encoded"], i["content"]).alias("content"),
        i["link"].alias("link"), i["pubDate"].alias("published")))
    alternate = lambda links: F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    atom = F.transform("x.entry", lambda e: F.struct(
        e["title"]["_VALUE"].alias("title"), e["summary"]["_VALUE"].alias("description"), e["content"]["_VALUE"].alias("content"),
        F.try_element_at(alternate(e["link"]), F.lit(1))["_href"].alias("link"), F.coalesce(e["published"], e["updated"]).alias("published")))
    items = parsed.select("source", "feed_url", F.posexplode(F.coalesce(rss, atom)).alias("pos", "it"))
    if max_items:
        items = items.filter(F.col("pos") < max_items)
    text = apply_prefix(join_parts(F.col("it.title"), F.col("it.description"), F.col("it.content")), prefix)
    out = items.select("source", F.coalesce(F.col("it.link"), F.col("feed_url")).alias("source_url"),
                       text.alias("raw_text"),
                       F.to_json(F.struct(F.coalesce(F.col("it.published"), F.lit("")).alias("published"))).alias("raw_metadata"),
                       "pos")
    return out.filter(F.col("raw_text") != "")


# --- HTML ------------------------------------------------------------------------

def node_text(html: Column, selector: str) -> Column:
    """Text of every matching element (markup stripped, nested elements whole), joined by a space."""
    return F.array_join(F.transform(select_inner(html, selector), lambda n: strip_html(F.concat(F.lit("<x>"), n, F.lit("</x>")))), " ")


def html_events(pages: DataFrame, name: Column, url: Column, html: Column, title_selector: str | None,
                content_selector: str | None, prefix: str | None = None) -> DataFrame:
    """One event per page: title text + content text (whole-page text without a content selector)."""
    title = node_text(html, title_selector) if title_selector else F.lit("")
    body = node_text(html, content_selector) if content_selector else strip_html(html)
    text = apply_prefix(join_parts(title, body), prefix)
    out = pages.select(name.alias("source"), url.alias("source_url"), text.alias("raw_text"),
                       F.lit("{}").alias("raw_metadata"), F.lit(0).alias("pos"))
    return out.filter(F.col("raw_text") != "")


# --- JSON ------------------------------------------------------------------------

def json_items(payload: Column, path: str | None) -> Column:
    """array<variant> of items: dotted path through objects, else the payload if an array, else its
    ``items``; anything else gives an empty array."""
    v = F.try_parse_json(payload)
    if path:
        target = F.try_variant_get(v, "$." + path, "array<variant>")
        return F.coalesce(target, F.array().cast("array<variant>"))
    as_list = F.try_variant_get(v, "$", "array<variant>")
    in_obj = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.items", "array<variant>"))
    return F.coalesce(as_list, in_obj, F.array().cast("array<variant>"))


def _string_field(item: Column, key: str) -> Column:
    """The field's value when it is a JSON string, else null."""
    f = F.try_variant_get(item, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(item, f"$.{key}", "string"))


def json_text(item: Column, fields: Sequence[str] | None) -> Column:
    """Listed string fields, stripped, non-blank, newline-joined; without a list the first string
    among text/content/body/message/title."""
    if not fields:
        return F.coalesce(*[_string_field(item, k) for k in TEXT_KEYS], F.lit(""))
    parts = [F.when(py_strip(_string_field(item, k)) != "", py_strip(_string_field(item, k))) for k in fields]
    return F.coalesce(F.concat_ws("\n", *parts), F.lit(""))


def json_url(item: Column) -> Column:
    """First non-blank string among url, link, source_url (value as given)."""
    return F.coalesce(*[F.when(py_strip(_string_field(item, k)) != "", _string_field(item, k)) for k in URL_KEYS])


def json_api_events(feeds: DataFrame, name: Column, feed_url: Column, payload: Column, json_path: str | None = None,
                    text_fields: Sequence[str] | None = None, max_items: int | None = None, prefix: str | None = None) -> DataFrame:
    """One event per JSON item; ``max_items``, where configured, counts items before the empty filter."""
    ex = feeds.select(name.alias("source"), feed_url.alias("feed_url"),
                      F.posexplode(json_items(payload, json_path)).alias("pos", "item"))
    if max_items:
        ex = ex.filter(F.col("pos") < max_items)
    text = apply_prefix(json_text(F.col("item"), text_fields), prefix)
    out = ex.select("source", F.coalesce(json_url(F.col("item")), F.col("feed_url")).alias("source_url"),
                    text.alias("raw_text"), F.to_json(F.struct(F.col("item").alias("item"))).alias("raw_metadata"), "pos")
    return out.filter(F.col("raw_text") != "")


# --- line files ------------------------------------------------------------------

def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of whole-file rows; line order is exact."""
    return files.select("path", F.posexplode(F.split("value", LINE_BREAK)).alias("line_no", "line"))


def file_events(lines: DataFrame, name: str, path_col: str = "path", text_fields: Sequence[str] | None = None,
                max_items: int = 0, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Local export: each non-blank line is a JSON object, or plain text as {"text": line}.

    Returns (events, quarantine); a JSON line that is not an object (a bare
    number, string or array) goes to quarantine instead of failing the file.
    Cap counts emitted events per file (0 = unlimited).
    """
    from pyspark.sql import Window

    t = lines.select(path_col, "line_no", py_strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    v = F.try_parse_json("line")
    t = t.withColumn("_v", v).withColumn("_kind", F.when(F.col("_v").isNull(), "text")
                                          .when(F.schema_of_variant("_v").startswith("OBJECT"), "object")
                                          .otherwise("scalar"))
    quarantine = t.filter(F.col("_kind") == "scalar").select(path_col, "line_no", "line",
                                                             F.lit("json value is not an object").alias("reason"))
    ok = t.filter(F.col("_kind") != "scalar")
    item_text = F.when(F.col("_kind") == "text", F.col("line")).otherwise(
        F.coalesce(F.when(json_text(F.col("_v"), text_fields) != "", json_text(F.col("_v"), text_fields)),
                   _string_field(F.col("_v"), "text")))
    url = F.when(F.col("_kind") == "object", _string_field(F.col("_v"), "url"))
    ev = ok.select(F.lit(name).alias("source"), F.coalesce(url, F.col(path_col)).alias("source_url"),
                   apply_prefix(item_text, prefix).alias("raw_text"),
                   F.when(F.col("_kind") == "object", F.to_json(F.struct(F.col("_v").alias("item"))))
                   .otherwise(F.to_json(F.struct(F.struct(F.col("line").alias("text")).alias("item")))).alias("raw_metadata"),
                   F.col("line_no").alias("pos"), path_col)
    ev = ev.filter(F.col("raw_text") != "")
    if max_items:
        w = Window.partitionBy(path_col).orderBy("pos")  # per landed file, bounded by the cap's input
        ev = ev.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_items).drop("_n")
    return ev.drop(path_col), quarantine


def text_feed_events(lines: DataFrame, name: Column | str, feed_url: Column | str, max_items: int | None = None,
                     prefix: str | None = None, path_col: str = "path") -> DataFrame:
    """Plain feed: trimmed lines, blanks and '#' comments skipped; url = the line when http(s).

    ``name`` / ``feed_url`` are literals or columns of ``lines`` (one config per landed file)."""
    from pyspark.sql import Window

    name = F.lit(name) if isinstance(name, str) else name
    feed_url = F.lit(feed_url) if isinstance(feed_url, str) else feed_url
    t = lines.select(path_col, "line_no", py_strip(F.col("line")).alias("line"), name.alias("_name"), feed_url.alias("_url"))
    t = t.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    ev = t.select(path_col, F.col("_name").alias("source"),
                  F.when(F.col("line").startswith("http://") | F.col("line").startswith("https://"), F.col("line"))
                  .otherwise(F.col("_url")).alias("source_url"),
                  apply_prefix(F.col("line"), prefix).alias("raw_text"),
                  F.to_json(F.struct(F.col("line").alias("indicator"))).alias("raw_metadata"),
                  F.col("line_no").alias("pos"))
    ev = ev.filter(F.col("raw_text") != "")
    if max_items:
        w = Window.partitionBy(path_col).orderBy("pos")
        ev = ev.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_items).drop("_n")
    return ev.drop(path_col)


def source_events(kind: str, landed: DataFrame, name: str, feed_url: Column | str = "", **config) -> DataFrame:
    """Raw events of one configured source from its landed rows (``path``, ``value``, and ``url`` of what was fetched).

    ``kind`` is rss, html, json_api, file or text_feed; ``config`` holds the options that the source's own reader takes.
    """
    url = F.coalesce(F.col("url") if "url" in landed.columns else F.lit(None).cast("string"), feed_url if isinstance(feed_url, Column) else F.lit(feed_url))
    if kind == "rss":
        return rss_events(landed, F.lit(name), url, **config)
    if kind == "html":
        return html_events(landed, F.lit(name), url, F.col("value"), config.pop("title_selector", None), config.pop("content_selector", None), **config)
    if kind == "json_api":
        return json_api_events(landed, F.lit(name), url, F.col("value"), **config)
    if kind == "file":
        return file_events(numbered_lines(landed), name, **config)[0]
    if kind == "text_feed":
        lines = landed.select("path", url.alias("url"), F.posexplode(F.split("value", LINE_BREAK)).alias("line_no", "line"))
        return text_feed_events(lines, name, F.col("url"), **config)
    raise ValueError(f"unsupported source type {kind}")


def union_sources(frames: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """Union of per-source event frames, each tagged with its read order."""
    out = None
    for order, df in frames:
        d = df.select(*RAW_COLUMNS).withColumn("source_order", F.lit(order))
        out = d if out is None else out.unionByName(d)
    return out
