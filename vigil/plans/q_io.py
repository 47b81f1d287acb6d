"""Registered queries: sources (landed files round trip), sinks, store, streams and the whole job.

Fixture files are written under the session's checkpoint folder (the
cluster's shared folder; a scratch folder only in local runs).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.text import py_strip
from vigil.operators import iocs as IO
from vigil.operators import store as ST
from vigil.plans import oracle as O
from vigil.plans.registry import arr, dbl, register, s_dbl, s_ts, ts
from vigil.plans.views import Chain, raw_events, read_table
from vigil.session import scratch
from vigil.sources import feeds as FD
from vigil.sources import stage as SG
from vigil.streaming import dedup as SD
from vigil.streaming import temporal as STT


CTRL = r"[\x00-\x08\x0B\x0C\x0D\x0E-\x1F]"
FEED_ITEMS = 50  # items per landed feed file in the fixtures
FEED_SQL = "source || '-' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR)"
SQL_STRIP = O.sql_strip


def sql_join2(a: str, b: str) -> str:
    return f"coalesce(concat_ws(chr(10), nullif({SQL_STRIP(a)}, ''), nullif({SQL_STRIP(b)}, '')), '')"


# --- RSS ------------------------------------------------------------------------------

def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@register("src_rss", f"""
WITH d AS (SELECT {FEED_SQL} AS source, doc_id, regexp_replace(text, '{CTRL}', '', 'g') AS t,
                  row_number() OVER (PARTITION BY {FEED_SQL} ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT source, 'doc://' || CAST(doc_id AS VARCHAR) AS source_url, {sql_join2("'Item ' || CAST(doc_id AS VARCHAR)", 't')} AS raw_text, pos
FROM d""")
def src_rss(spark, sf):
    d = read_table(spark, sf, "documents")
    t = F.regexp_replace("text", CTRL, "")
    item = F.concat(F.lit("<item><title>Item "), F.col("doc_id").cast("string"), F.lit("</title><description>"),
                    _xml_escape(t), F.lit("</description><link>doc://"), F.col("doc_id").cast("string"),
                    F.lit("</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    # one landed feed per (source, block of 50 ids): a fetch is bounded
    feed = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / FEED_ITEMS).cast("string"))
    feeds = d.groupBy(feed.alias("source")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("xs")) \
        .select("source", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("xs", lambda s: s["x"]), ""),
                                   F.lit("</channel></rss>")).alias("value"))
    path = scratch(spark, "rss")
    feeds.write.json(path)  # one landed document per row, many rows per file
    landed = spark.read.schema("source string, value string").json(path)
    ev = FD.rss_events(landed, F.col("source"), F.concat(F.lit("feed://"), F.col("source")))
    return ev.select("source", "source_url", "raw_text", F.col("pos").cast("long").alias("pos"))


# --- HTML -----------------------------------------------------------------------------

def _sql_nodes(html: str, tag: str) -> str:
    pat = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"  # the driver's pages nest neither title nor article
    return (f"array_to_string(list_transform(regexp_extract_all({html}, {O.q(pat)}, 1), "
            f"lambda n: {O.sql_strip_html(chr(39) + '<x>' + chr(39) + ' || n || ' + chr(39) + '</x>' + chr(39))}), ' ')")


@register("src_html_page", f"""
SELECT page_id, {sql_join2(_sql_nodes('html', 'title'), _sql_nodes('html', 'article'))} AS raw_text FROM pages
WHERE {sql_join2(_sql_nodes('html', 'title'), _sql_nodes('html', 'article'))} <> ''""")
def src_html_page(spark, sf):
    p = read_table(spark, sf, "pages", "page_id")
    title = FD.node_text(F.col("html"), "title")
    body = FD.node_text(F.col("html"), "article")
    out = p.select("page_id", FD.apply_prefix(FD.join_parts(title, body), None).alias("raw_text"))
    return out.filter(F.col("raw_text") != "")


@register("src_event_text", f"""
SELECT page_id, CASE WHEN {sql_join2(_sql_nodes('html', 'title'), 'url')} = '' THEN ''
       ELSE 'Page observed: ' || {sql_join2(_sql_nodes('html', 'title'), 'url')} END AS raw_text FROM pages""")
def src_event_text(spark, sf):
    p = read_table(spark, sf, "pages", "page_id")
    return p.select("page_id", FD.apply_prefix(FD.join_parts(FD.node_text(F.col("html"), "title"), F.col("url")),
                                               "  Page observed: ").alias("raw_text"))


# --- JSON -------------------------------------------------------------------------------

def _json_feeds(spark, sf):
    d = read_table(spark, sf, "documents")
    items = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("text"),
                     F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"))
    feed = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / FEED_ITEMS).cast("string"))
    return d.groupBy(feed.alias("source")).agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", items.alias("i")))), lambda s: s["i"])).alias("payload"))


DOCS_RANKED = ("d AS (SELECT * REPLACE (" + FEED_SQL + " AS source), row_number() OVER (PARTITION BY " + FEED_SQL
               + " ORDER BY doc_id) - 1 AS pos FROM documents)")


@register("src_json_api", f"""
WITH {DOCS_RANKED}
SELECT source, 'doc://' || CAST(doc_id AS VARCHAR) AS source_url, {SQL_STRIP('text')} AS raw_text, pos FROM d
WHERE {SQL_STRIP('text')} <> ''""")
def src_json_api(spark, sf):
    feeds = _json_feeds(spark, sf)
    path = scratch(spark, "json_api")
    feeds.write.json(path)
    landed = spark.read.json(path)
    ev = FD.json_api_events(landed, F.col("source"), F.concat(F.lit("api://"), F.col("source")), F.col("payload"),
                            text_fields=["text"])
    return ev.select("source", "source_url", "raw_text", F.col("pos").cast("long").alias("pos"))


@register("src_json_items", f"""
WITH {DOCS_RANKED}
SELECT source, shape, pos, doc_id AS id FROM d, (VALUES ('list'), ('items'), ('path')) s(shape)""")
def src_json_items(spark, sf):
    f = _json_feeds(spark, sf)
    shapes = [("list", F.col("payload"), None),
              ("items", F.concat(F.lit('{"items":'), F.col("payload"), F.lit("}")), None),
              ("path", F.concat(F.lit('{"data":{"records":'), F.col("payload"), F.lit("}}")), "data.records"),
              ("number", F.lit("42"), None),
              ("wrong_type", F.lit('{"items": 5}'), None)]
    out = None
    for name, payload, path in shapes:
        ex = f.select("source", F.lit(name).alias("shape"), F.posexplode(FD.json_items(payload, path)).alias("pos", "item"))
        ex = ex.select("source", "shape", F.col("pos").cast("long").alias("pos"),
                       F.variant_get("item", "$.id", "long").alias("id"))
        out = ex if out is None else out.unionByName(ex)
    return out


def _conv_json(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "text", F.try_parse_json(F.to_json(F.struct(
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("title"), "text", "role", "turn"))).alias("v"))


@register("src_json_text_fields", f"""
SELECT conv_id, turn, {sql_join2("'conv ' || CAST(conv_id AS VARCHAR)", 'text')} AS with_fields,
       coalesce(text, 'conv ' || CAST(conv_id AS VARCHAR)) AS default_text FROM conversations""")
def src_json_text_fields(spark, sf):
    c = _conv_json(spark, sf)
    return c.select("conv_id", "turn", FD.json_text(F.col("v"), ["title", "text", "turn"]).alias("with_fields"),
                    FD.json_text(F.col("v"), None).alias("default_text"))


@register("src_json_url", f"""
WITH j AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS u,
                  CASE WHEN page_id % 3 = 1 THEN '  ' ELSE 'link://' || CAST(page_id AS VARCHAR) END AS l,
                  'src://' || CAST(page_id AS VARCHAR) AS s FROM pages)
SELECT page_id, CASE WHEN {SQL_STRIP('u')} <> '' THEN u WHEN {SQL_STRIP('l')} <> '' THEN l ELSE s END AS url FROM j""")
def src_json_url(spark, sf):
    p = read_table(spark, sf, "pages")
    item = F.try_parse_json(F.to_json(F.struct(
        F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit("link://"), F.col("page_id").cast("string"))).alias("link"),
        F.concat(F.lit("src://"), F.col("page_id").cast("string")).alias("source_url"))))
    return p.select("page_id", FD.json_url(item).alias("url"))


# --- line files -------------------------------------------------------------------------

def _one_line(c):
    """Line breaks other than the line feed become blanks."""
    return F.regexp_replace(c, r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", " ")


@register("src_file_lines", r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]', ' ', 'g') AS t FROM conversations),
l AS (SELECT conv_id, turn, unnest(CASE WHEN turn % 2 = 0 THEN [t] ELSE string_split(t, chr(10)) END) AS l FROM c)
SELECT CASE WHEN turn % 2 = 0 THEN 'conv://' || CAST(conv_id AS VARCHAR) ELSE 'PATH' END AS source_url,
       CASE WHEN turn % 2 = 0 THEN l ELSE """ + SQL_STRIP("l") + """ END AS raw_text
FROM l WHERE (CASE WHEN turn % 2 = 0 THEN l ELSE """ + SQL_STRIP("l") + """ END) <> ''""")
def src_file_lines(spark, sf):
    c = read_table(spark, sf, "conversations")
    # whole texts: even turns as one JSON object each, odd turns as plain lines; a bare number must go to quarantine
    t = _one_line(F.col("text"))
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(t.alias("text"), F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("url")))) \
        .otherwise(F.concat(t, F.lit("\n"), F.col("turn").cast("string")))
    path = scratch(spark, "file_lines")
    c.select(line.alias("value")).write.option("maxRecordsPerFile", 1000).text(path)  # bounded files: each is read whole
    lines = FD.numbered_lines(FD.read_whole(spark, path))
    ev, _quarantine = FD.file_events(lines, "export", max_items=0)
    return ev.select(F.when(F.col("source_url").startswith("conv://"), F.col("source_url")).otherwise(F.lit("PATH")).alias("source_url"),
                     "raw_text")


@register("src_quarantine", """
WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST(event_id AS VARCHAR)
                                 WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS line FROM events)
SELECT event_id, CASE WHEN NOT json_valid(line) THEN 'text' WHEN json_type(line::JSON) = 'OBJECT' THEN 'object' ELSE 'scalar' END AS status,
       CASE WHEN json_valid(line) AND json_type(line::JSON) = 'OBJECT' THEN CAST(json_extract(line, '$.k') AS BIGINT) END AS k FROM l""")
def src_quarantine(spark, sf):
    e = read_table(spark, sf, "events")
    line = (F.when(F.col("event_id") % 11 == 0, F.col("event_id").cast("string"))
            .when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    v = F.try_parse_json(line)
    status = F.when(v.isNull(), "text").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("scalar")
    return e.select("event_id", status.alias("status"),
                    F.when(status == "object", F.try_variant_get(v, "$.k", "long")).alias("k"))


def _feed_lines(spark, sf):
    """Plain feeds per source: comment every 5th doc, a hash line per doc, a URL line for some, blanks."""
    d = read_table(spark, sf, "documents")
    idc = F.col("doc_id").cast("string")
    def row(sub, line):
        return F.struct(F.lit(sub).alias("sub"), line.alias("l"))

    rows = F.array(
        row(0, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# note "), idc))),
        row(1, F.sha2(F.col("text"), 256)),
        row(2, F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://feed.example.org/"), idc))),
        row(3, F.lit("   ")))
    feed = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / FEED_ITEMS).cast("string"))
    return d.select(feed.alias("source"), "doc_id", F.inline(rows)).withColumn("l", F.coalesce("l", F.lit("")))


@register("src_text_feed", f"""
WITH x AS (
  SELECT {FEED_SQL} AS source, doc_id, 0 AS sub, CASE WHEN doc_id % 5 = 0 THEN '# note ' || CAST(doc_id AS VARCHAR) ELSE '' END AS l FROM documents
  UNION ALL SELECT {FEED_SQL}, doc_id, 1, sha256(text) FROM documents
  UNION ALL SELECT {FEED_SQL}, doc_id, 2, CASE WHEN doc_id % 4 = 0 THEN 'https://feed.example.org/' || CAST(doc_id AS VARCHAR) ELSE '' END FROM documents),
k AS (SELECT * FROM x WHERE l <> '' AND NOT starts_with(l, '#')),
r AS (SELECT * FROM k)
SELECT source, CASE WHEN starts_with(l, 'http://') OR starts_with(l, 'https://') THEN l ELSE 'feed://' || source END AS source_url,
       'Indicator observed: ' || l AS raw_text FROM r""")
def src_text_feed(spark, sf):
    path = scratch(spark, "text_feed")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "sub", "l"))), lambda x: x["l"])
    # one landed feed (at most 50 documents) per row, many rows per file
    _feed_lines(spark, sf).groupBy("source").agg(F.array_join(in_order, "\n").alias("value")).write.json(path)
    files = spark.read.schema("source string, value string").json(path)
    lines = files.select(F.col("source").alias("path"), "source", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    ev = FD.text_feed_events(lines, F.col("source"), F.concat(F.lit("feed://"), F.col("source")), prefix="Indicator observed:")
    return ev.select("source", "source_url", "raw_text")


def _landed(spark, sf, kind):
    """(path, url, value) of one source of each kind, as it was fetched."""
    d = read_table(spark, sf, "documents")
    feed = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / FEED_ITEMS).cast("string"))
    if kind == "html":
        return read_table(spark, sf, "pages", "page_id").select(F.col("url").alias("path"), "url", F.col("html").alias("value"))
    if kind == "rss":
        item = F.concat(F.lit("<item><title>Item "), F.col("doc_id").cast("string"), F.lit("</title><description>"),
                        _xml_escape(F.regexp_replace("text", CTRL, "")), F.lit("</description></item>"))
        value = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
        return d.groupBy(feed.alias("path")).agg(value.alias("value")).select("path", F.col("path").alias("url"), "value")
    if kind == "json_api":
        return _json_feeds(spark, sf).select(F.col("source").alias("path"), F.col("source").alias("url"), F.col("payload").alias("value"))
    if kind == "file":
        c = read_table(spark, sf, "conversations")
        line = F.to_json(F.struct(F.col("text")))
        return c.groupBy("conv_id").agg(F.array_join(F.collect_list(line), "\n").alias("value")).select(
            F.col("conv_id").cast("string").alias("path"), F.lit(None).cast("string").alias("url"), "value")
    lines = _feed_lines(spark, sf).groupBy("source").agg(F.array_join(F.collect_list("l"), "\n").alias("value"))
    return lines.select(F.col("source").alias("path"), F.col("source").alias("url"), "value")


@register("src_union_sources", f"""
WITH {DOCS_RANKED},
f AS (SELECT text FROM conversations WHERE {SQL_STRIP('text')} <> ''),
t AS (SELECT sha256(text) AS l FROM documents UNION ALL SELECT 'https://feed.example.org/' || doc_id FROM documents WHERE doc_id % 4 = 0)
SELECT 'pages_html' AS source, 4 AS source_order, count(*) AS n_events FROM pages
  WHERE {sql_join2(_sql_nodes('html', 'title'), _sql_nodes('html', 'article'))} <> ''
UNION ALL SELECT 'rss_docs', 5, count(*) FROM d
UNION ALL SELECT 'docs_api', 2, count(*) FROM d WHERE {SQL_STRIP('text')} <> ''
UNION ALL SELECT 'convs_file', 3, count(*) FROM f
UNION ALL SELECT 'hash_feed', 6, count(*) FROM t""")
def src_union_sources(spark, sf):
    """One source of every type, read in the order of their groups; a source that is not enabled is left out."""
    config = [  # (group, name, type, enabled, options)
        ("advisories", "pages_html", "html", True, {"title_selector": "title", "content_selector": "article"}),
        ("blogs", "rss_docs", "rss", True, {}),
        ("forums", "docs_api", "json_api", True, {"text_fields": ["text"]}),
        ("telegram_channels", "convs_file", "file", True, {}),
        ("threat_feeds", "hash_feed", "text_feed", True, {"prefix": "Indicator observed:"}),
        ("paste_sites", "no_source", "rss", False, {}),
    ]
    from vigil.params import SOURCE_GROUP_ORDER
    frames = [(SOURCE_GROUP_ORDER.index(group) + 1, FD.source_events(kind, _landed(spark, sf, kind), name, **options))
              for group, name, kind, enabled, options in config if enabled]
    u = FD.union_sources(frames)
    return u.groupBy("source", "source_order").agg(F.count(F.lit(1)).alias("n_events"))


# --- stage tables ---------------------------------------------------------------------

STAGE_KEY = {"raw_events": "event_id", "normalized_events": "event_id", "iocs": "source_event_id", "analysis_results": "event_id",
             "correlation_results": "event_id", "campaigns": "campaign_id", "scores": "event_id"}
# optional columns that are left out of the files, and what the reader then gives
STAGE_LEFT_OUT = {
    "raw_events": ["raw_metadata", "content_hash"], "normalized_events": ["language", "language_confidence", "tokens", "raw_metadata"],
    "iocs": ["normalized_value", "confidence"], "analysis_results": ["sector", "sector_confidence", "cluster_confidence"],
    "correlation_results": ["shared_iocs", "mitre_tactics", "confidence"], "campaigns": ["name", "mitre_tactics"], "scores": ["severity_label"]}


@register("src_stage_tables", O.chain("sco") + f"""
SELECT 'raw_events' AS tbl, event_id AS id, raw_text AS kept, '{{}}' AS filled FROM raw
UNION ALL SELECT 'normalized_events', event_id, clean_text, 'unknown|0.0|0|{{}}' FROM norm
UNION ALL SELECT 'iocs', source_event_id, value, value || '|0.0' FROM ioc
UNION ALL SELECT 'analysis_results', event_id, incident_type, 'unknown|0.0|0.0' FROM ana
UNION ALL SELECT 'correlation_results', event_id, coalesce(campaign_id, ''), '0|0|0.0' FROM cor
UNION ALL SELECT 'campaigns', campaign_id, CAST(n_events AS VARCHAR), campaign_id || '|0' FROM camp
UNION ALL SELECT 'scores', event_id, {s_dbl('severity')}::VARCHAR, 'informational' FROM sco""")
def src_stage_tables(spark, sf):
    """All seven stage tables, written without their optional columns and read back with the defaults; a missing path is empty."""
    c = Chain.of(spark, sf)
    root = scratch(spark, "stage")
    size = lambda name: F.size(name).cast("string")
    text = lambda name: F.col(name).cast("string")
    shown = {
        "raw_events": ("raw_text", ["raw_metadata"]), "normalized_events": ("clean_text", ["language", "language_confidence", size("tokens"), "raw_metadata"]),
        "iocs": ("value", ["normalized_value", "confidence"]), "analysis_results": ("incident_type", ["sector", "sector_confidence", "cluster_confidence"]),
        "correlation_results": (F.coalesce("campaign_id", F.lit("")), [size("shared_iocs"), size("mitre_tactics"), "confidence"]),
        "campaigns": (text("n_events"), ["name", size("mitre_tactics")]), "scores": (dbl("severity").cast("string"), ["severity_label"])}
    out = SG.read_stage(spark, f"{root}/absent", "scores").select(F.lit("scores").alias("tbl"), F.col("event_id").alias("id"), F.lit("").alias("kept"), F.lit("").alias("filled"))
    for name, df in stage_tables(c).items():
        df.drop(*STAGE_LEFT_OUT[name]).write.json(f"{root}/{name}")
        kept, filled = shown[name]
        got = SG.read_stage(spark, f"{root}/{name}", name)
        out = out.unionByName(got.select(F.lit(name).alias("tbl"), F.col(STAGE_KEY[name]).alias("id"), (text(kept) if isinstance(kept, str) else kept).alias("kept"),
                                         F.concat_ws("|", *[text(x) if isinstance(x, str) else x for x in filled]).alias("filled")))
    return out


# --- sinks and store ----------------------------------------------------------------------

STAGE_COUNT_SQL = O.chain("sco") + """
SELECT 'raw_events' AS tbl, count(*) AS n_rows FROM raw UNION ALL SELECT 'normalized_events', count(*) FROM norm
UNION ALL SELECT 'iocs', count(*) FROM ioc UNION ALL SELECT 'analysis_results', count(*) FROM ana
UNION ALL SELECT 'correlation_results', count(*) FROM cor UNION ALL SELECT 'campaigns', count(*) FROM camp
UNION ALL SELECT 'scores', count(*) FROM sco"""


def stage_tables(c: Chain) -> dict:
    return {"raw_events": c.raw, "normalized_events": c.norm, "iocs": c.ioc, "analysis_results": c.ana,
            "correlation_results": c.cor, "campaigns": c.camp.withColumn("run_id", F.lit("r1")), "scores": c.sco}


@register("snk_stage_tables", STAGE_COUNT_SQL)
def snk_stage_tables(spark, sf):
    c = Chain.of(spark, sf)
    counts = ST.write_run(stage_tables(c), scratch(spark, "sink"), "r1")
    return spark.createDataFrame(list(counts.items()), "tbl string, n_rows long")


@register("sto_store_all", STAGE_COUNT_SQL)
def sto_store_all(spark, sf):
    c = Chain.of(spark, sf)
    root = scratch(spark, "store")
    ST.write_run(stage_tables(c), root, "r1")
    runs = ST.committed_runs(spark, root)
    return runs.select("table", "n_rows").withColumnRenamed("table", "tbl")


@register("sto_insert_ignore", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sto_insert_ignore(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target = o.filter(F.col("o_orderkey") % 2 == 0)
    batch = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, -1.0).otherwise(F.col("o_totalprice")))  # known keys: ignored
    batch = batch.unionByName(batch.withColumn("o_totalprice", F.col("o_totalprice") + 1))  # every key twice inside the batch
    return target.unionByName(ST.insert_ignore(target, batch, ["o_orderkey"]))


@register("sto_tables", O.chain("sco") + """,
st AS (SELECT source_event_id, ioc_type, normalized_value FROM ioc GROUP BY ALL)
SELECT 'raw_events' AS tbl, count(*) AS n_rows FROM raw UNION ALL SELECT 'normalized_events', count(*) FROM norm
UNION ALL SELECT 'iocs', count(*) FROM st UNION ALL SELECT 'analysis_results', count(*) FROM ana
UNION ALL SELECT 'correlation_results', count(*) FROM cor UNION ALL SELECT 'campaigns', count(*) FROM camp
UNION ALL SELECT 'scores', count(*) FROM sco""")
def sto_tables(spark, sf):
    """Every keyed table, stored in two overlapping batches: the first half of the rows by hash, then all of them."""
    c = Chain.of(spark, sf)
    root = scratch(spark, "keyed")
    out = []
    for name, df in (stage_tables(c) | {"raw_events": raw_events(spark, sf, dealt=False)}).items():  # no work on texts here
        df = IO.dedup(df) if name == "iocs" else df
        keys = ST.STORE_KEYS[name]
        half = df.filter(F.pmod(F.xxhash64(*keys), F.lit(2)) == 0)
        n = sum(ST.append_ignore(f"{root}/{name}", part, keys, spark) for part in (half, df))
        out.append((name, n))
    return spark.createDataFrame(out, "tbl string, n_rows long")


@register("sto_publish", O.chain("sco") + "SELECT count(*) AS n_rows FROM sco")
def sto_publish(spark, sf):
    c = Chain.of(spark, sf)
    uri = scratch(spark, "publish")
    ST.publish(c.sco.withColumn("severity_label", F.lit("stale")), uri, "scores", "v1")
    ST.publish(c.sco, uri, "scores", "v2")
    latest = ST.read_latest(spark, uri, "scores")
    return latest.agg(F.count(F.when(F.col("severity_label") != "stale", 1)).alias("n_rows"))


@register("qry_latest_report", O.chain("sco") + """
SELECT '2024-02-02 00:00:00' AS generated_at, count(*) AS n_items FROM ana JOIN sco USING (event_id)""")
def qry_latest_report(spark, sf):
    from vigil.operators import report as R
    c = Chain.of(spark, sf)
    items = R.items(c.ana, c.sco, c.cor, c.ioc)
    root = scratch(spark, "reports")
    for day, df in (("2024-02-01 00:00:00", items), ("2024-02-02 00:00:00", items)):
        df.withColumn("generated_at", F.lit(day)).write.mode("append").partitionBy("generated_at").parquet(root)
    rep = spark.read.parquet(root)
    latest = rep.agg(F.max("generated_at")).first()[0]
    latest_rows = rep.filter(F.col("generated_at") == latest)
    return latest_rows.groupBy(ts("generated_at").alias("generated_at")).agg(F.count(F.lit(1)).alias("n_items"))


# --- streams ----------------------------------------------------------------------------

@register("ing_stream_dedup", """
WITH dh AS (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS event_id,
                   sha256('documents' || '|' || '' || '|' || coalesce(text, '')) AS content_hash FROM documents)
SELECT content_hash, event_id FROM dh QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1""")
def ing_stream_dedup(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event_id"),
        F.lit("documents").alias("source"), F.lit("").alias("source_url"), F.col("text").alias("raw_text"))
    root = scratch(spark, "stream_dedup")
    d.repartition(9).write.parquet(f"{root}/in")  # landed files in no order, several per micro-batch
    SD.run_dedup_stream(spark, f"{root}/in", d.schema, f"{root}/out", f"{root}/ckpt", ["doc_id"], files_per_batch=3)
    return SD.first_events(spark, f"{root}/out", ["doc_id"]).select("content_hash", "event_id")


@register("cor_temporal_stream", f"""
SELECT {O.sql_temporal_key('ts')} AS temporal_cluster, count(*) AS n_events FROM events GROUP BY 1""")
def cor_temporal_stream(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts")
    root = scratch(spark, "stream_win")
    e.write.parquet(f"{root}/in")
    STT.run_window_stream(spark, f"{root}/in", e.schema, f"{root}/out", f"{root}/ckpt")
    return STT.latest_counts(spark, f"{root}/out")


# --- end-to-end job -------------------------------------------------------------------------

@register("job_pipeline", O.chain("sco") + f"""
SELECT event_id, {s_dbl('severity')} AS severity, severity_label FROM sco""")
def job_pipeline(spark, sf):
    from vigil.plans.jobs import run_pipeline
    out = run_pipeline(spark, sf)
    return out.scores.select("event_id", dbl("severity").alias("severity"), "severity_label")


@register("job_run_counts", STAGE_COUNT_SQL)
def job_run_counts(spark, sf):
    from vigil.plans.jobs import run_pipeline
    out = run_pipeline(spark, sf)
    return spark.createDataFrame(list(out.counts.items()), "tbl string, n_rows long")
