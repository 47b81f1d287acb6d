"""Registered queries: preprocessing, IOC extraction, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import ioc as I
from vigil.functions import keywords as K
from vigil.functions import text as T
from vigil.operators import iocs as IO
from vigil.operators import language as LG
from vigil.operators import suffixes as SX
from vigil.params import IOC_PATTERNS, PUBLIC_SUFFIXES
from vigil.plans import oracle as O
from vigil.plans.registry import arr, dbl, register, s_arr, s_dbl, s_ts, ts
from vigil.plans.views import TEST_INCIDENT, TEST_NOISE_PATTERNS, TEST_SECTOR, Chain, read_table

P = dict(IOC_PATTERNS)

# --- flagship ------------------------------------------------------------------


def top_iocs(spark, sf):
    """Indicators seen in the most distinct events (top 20)."""
    c = Chain.of(spark, sf)
    return (c.ioc.groupBy("ioc_type", "normalized_value")
            .agg(F.count_distinct("source_event_id").alias("n_events"))
            .orderBy(F.desc("n_events"), "ioc_type", "normalized_value").limit(20))


register("top_iocs", O.chain("ioc") + """
SELECT ioc_type, normalized_value, count(DISTINCT source_event_id) AS n_events FROM ioc
GROUP BY ioc_type, normalized_value ORDER BY n_events DESC, ioc_type, normalized_value LIMIT 20""")(top_iocs)

# --- PRE ---------------------------------------------------------------------


@register("pre_strip_html", O.chain("raw") + f"SELECT event_id, {O.sql_strip_html('raw_text')} AS text FROM raw")
def pre_strip_html(spark, sf):
    return Chain.of(spark, sf).raw.select("event_id", T.strip_html(F.col("raw_text")).alias("text"))


@register("pre_noise_lines", f"SELECT doc_id, {O.sql_noise('text', TEST_NOISE_PATTERNS)} AS text FROM documents")
def pre_noise_lines(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.remove_noise_lines(F.col("text"), TEST_NOISE_PATTERNS).alias("text"))


@register("pre_normalize_ws", f"SELECT doc_id, {O.sql_normalize_ws('text')} AS text FROM documents")
def pre_normalize_ws(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@register("pre_clean_text", O.chain("raw") + f"SELECT event_id, {O.sql_clean('raw_text', TEST_NOISE_PATTERNS)} AS clean_text FROM raw")
def pre_clean_text(spark, sf):
    return Chain.of(spark, sf).raw.select("event_id", T.clean_text(F.col("raw_text"), TEST_NOISE_PATTERNS).alias("clean_text"))


@register("pre_min_length", O.chain("raw") + f"""
SELECT event_id, length(c) AS n_chars FROM (SELECT event_id, {O.sql_clean('raw_text', TEST_NOISE_PATTERNS)} AS c FROM raw)
WHERE length(c) >= 20""")
def pre_min_length(spark, sf):
    raw = Chain.of(spark, sf).raw
    c = raw.select("event_id", T.clean_text(F.col("raw_text"), TEST_NOISE_PATTERNS).alias("c"))
    return c.filter(F.length("c") >= 20).select("event_id", F.length("c").cast("long").alias("n_chars"))


@register("pre_detect_language", O.chain("norm") + f"""
SELECT n.event_id, n.language, {s_dbl('n.language_confidence')} AS language_confidence
FROM norm n""")
def pre_detect_language(spark, sf):
    n = Chain.of(spark, sf).norm
    return n.select("event_id", "language", dbl("language_confidence").alias("language_confidence"))


@register("pre_language_model", f"""
WITH t AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
g AS MATERIALIZED (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM t, unnest(range(1, length(t) - 1)) r(i)),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
v AS (SELECT DISTINCT gram FROM c),
m AS MATERIALIZED (
  SELECT v.gram, l.lang, ln((coalesce(c.n, 0) + 1.0) / (l.total + (SELECT count(*) FROM v))) AS p FROM v CROSS JOIN l LEFT JOIN c ON c.gram = v.gram AND c.lang = l.lang),
s AS (SELECT doc_id, m.lang, round(sum(k * p), 6) AS s FROM (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY ALL) JOIN m USING (gram) GROUP BY ALL),
b AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM s),
r AS (SELECT doc_id, min(lang) FILTER (s = top) AS language, 1.0 / sum(exp(s - top)) AS confidence FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(language, 'unknown') AS language, {s_dbl('coalesce(confidence, 0.0)')} AS confidence FROM documents d LEFT JOIN r USING (doc_id)""")
def pre_language_model(spark, sf):
    """A character n-gram model learnt from the labelled documents, applied to all of them."""
    d = read_table(spark, sf, "documents", "doc_id").select("doc_id", "text", "lang")
    return LG.detect(d, LG.fit(d), "doc_id").select("doc_id", "language", dbl("confidence").alias("confidence"))


@register("pre_language_filter", O.chain("norm") + "SELECT event_id, language FROM norm WHERE language IN ('en', 'fr')")
def pre_language_filter(spark, sf):
    from vigil.operators.preprocess import normalize
    from vigil.plans.views import TEST_PRE
    import dataclasses
    p = dataclasses.replace(TEST_PRE, allowed_languages=("en", "fr"))
    return normalize(Chain.of(spark, sf).raw, p).select("event_id", "language")


@register("pre_tokenize", O.chain("norm") + f"SELECT event_id, {s_arr('tokens', True)} AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens FROM norm")
def pre_tokenize(spark, sf):
    n = Chain.of(spark, sf).norm
    return n.select("event_id", arr("tokens", True).alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@register("pre_normalize", O.chain("norm") + f"""
SELECT event_id, source, source_url, {s_ts('fetched_at')} AS fetched_at, language,
       {s_dbl('language_confidence')} AS language_confidence, clean_text, {s_arr('tokens', True)} AS tokens
FROM norm""")
def pre_normalize(spark, sf):
    n = Chain.of(spark, sf).norm
    return n.select("event_id", "source", "source_url", ts("fetched_at").alias("fetched_at"), "language",
                    dbl("language_confidence").alias("language_confidence"), "clean_text",
                    arr("tokens", True).alias("tokens"))


# --- IOC single types ----------------------------------------------------------

def _doc_matches(spark, sf, ioc_type, text_fn=None):
    d = read_table(spark, sf, "documents")
    text = text_fn(F.col("text")) if text_fn else F.col("text")
    return d.select("doc_id", F.explode(I.extract_type(text, ioc_type)).alias("value"))


def _sql_doc_matches(ioc_type, text="text", table="documents", id_col="doc_id"):
    return (f"SELECT {id_col}, unnest(list_distinct(regexp_extract_all({text}, {O.q(P[ioc_type])}))) AS value "
            f"FROM {table}")


for _t in ("ipv4", "email", "sha1"):
    register(f"ioc_{_t}", _sql_doc_matches(_t))(lambda spark, sf, _t=_t: _doc_matches(spark, sf, _t))

register("ioc_md5", _sql_doc_matches("md5", "text || chr(10) || md5(text)"))(
    lambda spark, sf: _doc_matches(spark, sf, "md5", lambda t: F.concat(t, F.lit("\n"), F.md5(t))))
register("ioc_sha256", _sql_doc_matches("sha256", "text || chr(10) || sha256(text)"))(
    lambda spark, sf: _doc_matches(spark, sf, "sha256", lambda t: F.concat(t, F.lit("\n"), F.sha2(t, 256))))


@register("ioc_url", _sql_doc_matches("url", "url", "pages", "page_id"))
def ioc_url(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", F.explode(I.extract_type(F.col("url"), "url")).alias("value"))


@register("ioc_domain", _sql_doc_matches("domain", "html", "pages", "page_id"))
def ioc_domain(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", F.explode(I.extract_type(F.col("html"), "domain")).alias("value"))


@register("ioc_extract_all", O.chain("ioc") + "SELECT source_event_id AS event_id, ioc_type, value FROM ioc_hits")
def ioc_extract_all(spark, sf):
    n = Chain.of(spark, sf).norm
    return n.select("event_id", F.explode(I.extract_all(F.col("clean_text"))).alias("h")) \
        .select("event_id", F.col("h.ioc_type").alias("ioc_type"), F.col("h.value").alias("value"))


@register("ioc_norm_domain", f"""
SELECT page_id, value, {O.sql_norm_domain('value')} AS normalized_value FROM ({_sql_doc_matches('domain', 'url', 'pages', 'page_id')})""")
def ioc_norm_domain(spark, sf):
    m = read_table(spark, sf, "pages").select("page_id", F.explode(I.extract_type(F.col("url"), "domain")).alias("value"))
    return m.select("page_id", "value", I.normalize_domain(F.col("value")).alias("normalized_value"))


@register("ioc_norm_domain_rules", f"""
SELECT page_id, value, {O.sql_norm_domain('value')} AS normalized_value FROM ({_sql_doc_matches('domain', 'url', 'pages', 'page_id')})""")
def ioc_norm_domain_rules(spark, sf):
    """The same names, with the suffix rules as a table."""
    m = read_table(spark, sf, "pages").select("page_id", F.explode(I.extract_type(F.col("url"), "domain")).alias("value"))
    rules = SX.rules_of(spark.createDataFrame([(r,) for r in PUBLIC_SUFFIXES], "rule string"))
    return SX.with_registrable(m, rules, "value", "page_id").select("page_id", "value", F.col("registrable").alias("normalized_value"))


@register("ioc_norm_url", f"SELECT page_id, lower({O.sql_strip('url')}) AS normalized_value FROM pages")
def ioc_norm_url(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", I.normalize_ioc(F.lit("url"), F.col("url")).alias("normalized_value"))


@register("ioc_norm_email", f"SELECT doc_id, value, lower({O.sql_strip('value')}) AS normalized_value FROM ({_sql_doc_matches('email')})")
def ioc_norm_email(spark, sf):
    m = _doc_matches(spark, sf, "email")
    return m.select("doc_id", "value", I.normalize_ioc(F.lit("email"), F.col("value")).alias("normalized_value"))


@register("ioc_norm_hash", f"""
SELECT doc_id, value, lower({O.sql_strip('value')}) AS normalized_value
FROM ({_sql_doc_matches('sha1', "upper(sha1(text)) || ' ' || text")})""")
def ioc_norm_hash(spark, sf):
    m = _doc_matches(spark, sf, "sha1", lambda t: F.concat(F.upper(F.sha1(t)), F.lit(" "), t))
    return m.select("doc_id", "value", I.normalize_ioc(F.lit("sha1"), F.col("value")).alias("normalized_value"))


@register("ioc_norm_ip", f"SELECT doc_id, value, {O.sql_strip('value')} AS normalized_value FROM ({_sql_doc_matches('ipv4')})")
def ioc_norm_ip(spark, sf):
    m = _doc_matches(spark, sf, "ipv4")
    return m.select("doc_id", "value", I.normalize_ioc(F.lit("ipv4"), F.col("value")).alias("normalized_value"))


@register("ioc_normalize", O.chain("ioc") + "SELECT source_event_id, ioc_type, value, normalized_value FROM ioc")
def ioc_normalize(spark, sf):
    return Chain.of(spark, sf).ioc.select("source_event_id", "ioc_type", "value", "normalized_value")


@register("ioc_context", O.chain("ioc") + "SELECT source_event_id, ioc_type, value, context FROM ioc")
def ioc_context(spark, sf):
    return Chain.of(spark, sf).ioc.select("source_event_id", "ioc_type", "value", "context")


@register("ioc_extract", O.chain("ioc") + f"""
SELECT ioc_type, value, normalized_value, {s_dbl('confidence')} AS confidence, source_event_id, context FROM ioc""")
def ioc_extract(spark, sf):
    i = Chain.of(spark, sf).ioc
    return i.select("ioc_type", "value", "normalized_value", dbl("confidence").alias("confidence"), "source_event_id", "context")


@register("ioc_count_by_event", O.chain("ioc") + """
SELECT source_event_id, count(*) AS ioc_count FROM ioc
WHERE source_event_id IS NOT NULL AND source_event_id <> '' GROUP BY source_event_id""")
def ioc_count_by_event(spark, sf):
    return IO.count_by_event(Chain.of(spark, sf).ioc)


def _doubled(spark, sf):
    """The IOC table twice, second copy upper-cased where normalisation lower-cases."""
    i = Chain.of(spark, sf).ioc
    up = i.select("ioc_type", F.when(F.col("ioc_type").isin("url", "email", "md5", "sha1", "sha256"), F.upper("value"))
                  .otherwise(F.col("value")).alias("value"), "normalized_value", "confidence", "source_event_id", "context")
    return i.withColumn("copy", F.lit(1)).unionByName(up.withColumn("copy", F.lit(2)))


_SQL_DOUBLED = """doubled AS (
  SELECT ioc_type, value, normalized_value, confidence, source_event_id, context, 1 AS copy FROM ioc
  UNION ALL
  SELECT ioc_type, CASE WHEN ioc_type IN ('url', 'email', 'md5', 'sha1', 'sha256') THEN upper(value) ELSE value END,
         normalized_value, confidence, source_event_id, context, 2 FROM ioc)"""


@register("ioc_dedup", O.chain("ioc") + "," + _SQL_DOUBLED + """
SELECT source_event_id, ioc_type, normalized_value, min(value) AS value, count(*) AS n_copies
FROM doubled GROUP BY source_event_id, ioc_type, normalized_value""")
def ioc_dedup(spark, sf):
    d = _doubled(spark, sf)
    kept = IO.dedup(d)
    n = d.groupBy(*IO.IOC_KEY).agg(F.count(F.lit(1)).alias("n_copies"))
    return kept.select(*IO.IOC_KEY, "value").join(n, IO.IOC_KEY)


@register("ioc_dedup_audit", O.chain("ioc") + "," + _SQL_DOUBLED + """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
       CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_keys
FROM (SELECT count(*) AS n FROM doubled GROUP BY source_event_id, ioc_type, normalized_value)""")
def ioc_dedup_audit(spark, sf):
    return IO.dedup_audit(_doubled(spark, sf))


@register("ioc_dedup_rebuild", O.chain("ioc") + "," + _SQL_DOUBLED + """,
withid AS (SELECT *, CAST(copy AS VARCHAR) || '|' || value AS id FROM doubled)
SELECT source_event_id, ioc_type, normalized_value, value, id FROM withid
WHERE id IN (SELECT min(id) FROM withid w2 WHERE w2.source_event_id = withid.source_event_id
             AND w2.ioc_type = withid.ioc_type AND w2.normalized_value = withid.normalized_value)""")
def ioc_dedup_rebuild(spark, sf):
    d = _doubled(spark, sf).withColumn("id", F.concat(F.col("copy").cast("string"), F.lit("|"), F.col("value")))
    return IO.dedup_rebuild(d, "id").select(*IO.IOC_KEY, "value", "id")


# --- CLS ---------------------------------------------------------------------

@register("cls_keyword_score", O.chain("norm") + "\n" + " UNION ALL ".join(
    f"SELECT event_id, {O.q(label)} AS label, CAST(len(list_filter({O.str_list(kws)}, lambda k: contains(lower(clean_text), k))) AS BIGINT) AS n_matches, "
    f"{s_dbl(f'CAST(len(list_filter({O.str_list(kws)}, lambda k: contains(lower(clean_text), k))) AS DOUBLE) / {float(len(kws))}')} AS score FROM norm"
    for label, kws in TEST_INCIDENT.items()))
def cls_keyword_score(spark, sf):
    n = Chain.of(spark, sf).norm
    lt = F.lower(F.col("clean_text"))
    rows = [F.struct(F.lit(label).alias("label"), F.size(K.keyword_matches(lt, kws)).cast("long").alias("n_matches"),
                     (F.size(K.keyword_matches(lt, kws)) / F.lit(float(len(kws)))).alias("score"))
            for label, kws in TEST_INCIDENT.items()]
    return n.select("event_id", F.explode(F.array(*rows)).alias("r")).select(
        "event_id", "r.label", "r.n_matches", dbl("r.score").alias("score"))


@register("cls_keyword_label", O.chain("ana") + f"""
SELECT event_id, incident_type, {s_dbl('incident_confidence')} AS incident_confidence, sector,
       {s_dbl('sector_confidence')} AS sector_confidence FROM ana""")
def cls_keyword_label(spark, sf):
    a = Chain.of(spark, sf).ana
    return a.select("event_id", "incident_type", dbl("incident_confidence").alias("incident_confidence"),
                    "sector", dbl("sector_confidence").alias("sector_confidence"))


@register("cls_keyword_explain", O.chain("ana") + f"""
SELECT event_id, {s_arr('expl_incident', True)} AS incident_explanation, {s_arr('expl_sector', True)} AS sector_explanation FROM ana""")
def cls_keyword_explain(spark, sf):
    a = Chain.of(spark, sf).ana
    return a.select("event_id", arr(F.col("explanations")["incident"], True).alias("incident_explanation"),
                    arr(F.col("explanations")["sector"], True).alias("sector_explanation"))


@register("cls_mitre_tactics", O.chain("norm") + f"""
SELECT event_id, {s_arr(O.sql_mitre('clean_text'), True)} AS mitre_tactics, CAST(len({O.sql_mitre('clean_text')}) AS BIGINT) AS n_tactics FROM norm""")
def cls_mitre_tactics(spark, sf):
    n = Chain.of(spark, sf).norm.select("event_id", K.mitre_tactics(F.col("clean_text")).alias("t"))
    return n.select("event_id", arr("t", True).alias("mitre_tactics"), F.size("t").cast("long").alias("n_tactics"))


@register("cls_analyze", O.chain("ana") + f"""
SELECT event_id, incident_type, {s_dbl('incident_confidence')} AS incident_confidence, sector,
       {s_dbl('sector_confidence')} AS sector_confidence, cluster_id, {s_dbl('cluster_confidence')} AS cluster_confidence,
       {s_arr('expl_incident', True)} AS incident_explanation, {s_arr('expl_sector', True)} AS sector_explanation FROM ana""")
def cls_analyze(spark, sf):
    a = Chain.of(spark, sf).ana
    return a.select("event_id", "incident_type", dbl("incident_confidence").alias("incident_confidence"), "sector",
                    dbl("sector_confidence").alias("sector_confidence"), "cluster_id",
                    dbl("cluster_confidence").alias("cluster_confidence"),
                    arr(F.col("explanations")["incident"], True).alias("incident_explanation"),
                    arr(F.col("explanations")["sector"], True).alias("sector_explanation"))
