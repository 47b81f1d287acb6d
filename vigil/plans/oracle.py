"""DuckDB SQL oracles, written independently of the Spark code.

Each stage is a named CTE over the driver tables (``raw``, ``norm``,
``ioc``, ``ana``, ``cor``, ``sco``...). A query's oracle is
``with_ctes([...]) + SELECT ...``. DuckDB's regex engine (RE2) has ASCII
``\\b``/``\\d``; on the driver data that makes no difference (checked), and
the non-ASCII border cases live in pytest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from vigil.params import IOC_PATTERNS, LANGUAGE_PROFILES, MITRE_TACTICS, PUBLIC_SUFFIXES, TOKEN_PATTERN
from vigil.operators import clusters as K
from vigil.plans import views as V

WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]" if items else "CAST([] AS VARCHAR[])"


def in_list(items: Sequence[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def sql_decode(x: str) -> str:
    """Character references, from the standard library's tables."""
    from html.entities import name2codepoint

    names = {"apos": "'"} | {n: chr(c) for n, c in name2codepoint.items()}
    named = f"MAP {{{', '.join(f'{q(n)}: {q(c)}' for n, c in names.items())}}}"
    latin = " ".join(f"WHEN {c} THEN {q(bytes([c]).decode('cp1252'))}" for c in range(128, 160) if c not in (129, 141, 143, 144, 157))
    code = "CASE WHEN p[3:3] IN ('x', 'X') THEN ('0x' || p[4:-2])::BIGINT ELSE (p[3:-2])::BIGINT END"
    char = f"CASE WHEN ({code}) = 0 OR ({code}) > 1114111 OR ({code}) BETWEEN 55296 AND 57343 THEN chr(65533) ELSE CASE ({code}) {latin} ELSE chr(({code})::INTEGER) END END"
    parts = f"regexp_extract_all({x}, {q('&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&')})"
    return (f"(CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({parts}, lambda p: CASE WHEN NOT starts_with(p, '&') OR p = '&' THEN p "
            f"WHEN p[2:2] = '#' THEN {char} ELSE coalesce({named}[p[2:-2]], p) END), '') ELSE {x} END)")


def sql_strip_html(t: str) -> str:
    x = t
    for pat in [r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
                r"(?s)<![^>]*>", r"(?s)<\?[^>]*>", r"(?s)</?[A-Za-z][^>]*>"]:
        x = f"regexp_replace({x}, {q(pat)}, ' ', 'g')"
    x = sql_decode(x)
    return f"(CASE WHEN contains({t}, '<') OR contains({t}, '>') THEN {x} ELSE {t} END)"


def sql_noise(t: str, patterns: Sequence[str]) -> str:
    if not patterns:
        return t
    conds = [f"{sql_strip('x')} <> ''"] + [f"NOT regexp_matches({sql_strip('x')}, {q('(?i)' + p)})" for p in patterns]
    return (f"array_to_string(list_transform(list_filter(regexp_split_to_array({t}, {q(LINE_BREAK)}), "
            f"lambda x: {' AND '.join(conds)}), lambda x: {sql_strip('x')}), chr(10))")


def sql_normalize_ws(t: str) -> str:
    return f"trim(regexp_replace(replace({t}, chr(0), ' '), {q(WS + '+')}, ' ', 'g'))"


def sql_clean(t: str, patterns: Sequence[str]) -> str:
    return sql_normalize_ws(sql_noise(sql_strip_html(t), patterns))


def sql_tokens(t: str, min_len: int = 2) -> str:
    base = f"regexp_extract_all({t}, {q(TOKEN_PATTERN)})"
    return base if min_len <= 1 else f"list_filter({base}, lambda w: length(w) >= {min_len})"


def sql_lang_counts(t: str) -> list[tuple[str, str]]:
    words = f"regexp_extract_all(lower({t}), '\\p{{L}}+')"
    return [(lang, f"len(list_filter({words}, lambda w: w IN {in_list(ws)}))") for lang, ws in LANGUAGE_PROFILES]


def sql_mitre(t: str) -> str:
    parts = []
    for tactic, kws in MITRE_TACTICS:
        cond = " OR ".join(f"contains(lower({t}), {q(k)})" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN {q(tactic)} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def sql_keyword_classify(t: str, label_keywords: Mapping[str, Sequence[str]], min_conf: float, prefix: str) -> str:
    """Columns {prefix}_label, {prefix}_conf, {prefix}_expl."""
    labels = list(label_keywords.items())
    ms = [f"list_filter({str_list([k.lower() for k in kws])}, lambda k: contains(lower({t}), k))" for _, kws in labels]
    ss = [f"(CAST(len({m}) AS DOUBLE) / {float(max(len(kws), 1))})" for m, (_, kws) in zip(ms, labels)]
    best = f"greatest({', '.join(ss)})" if len(ss) > 1 else ss[0]
    lab = "CASE WHEN best <= 0 THEN 'unknown' " + " ".join(
        f"WHEN {s} = best THEN {q(n)}" for s, (n, _) in zip(ss, labels)) + " END"
    expl = "CASE WHEN best <= 0 THEN CAST([] AS VARCHAR[]) " + " ".join(
        f"WHEN {s} = best THEN {m}[1:5]" for s, m in zip(ss, ms)) + " END"
    lab = lab.replace("best", f"({best})")
    expl = expl.replace("best", f"({best})")
    return (f"CASE WHEN ({best}) >= {min_conf} THEN {lab} ELSE 'unknown' END AS {prefix}_label, "
            f"CAST({best} AS DOUBLE) AS {prefix}_conf, "
            f"CASE WHEN ({best}) >= {min_conf} THEN {expl} ELSE CAST([] AS VARCHAR[]) END AS {prefix}_expl")


def sql_norm_domain(v: str) -> str:
    low = f"lower({v})"
    labels = f"string_split({low}, '.')"
    sfx = in_list(PUBLIC_SUFFIXES)
    first = f"list_filter(range(2, len({labels}) + 1), lambda i: array_to_string({labels}[i:], '.') IN {sfx})[1]"
    return (f"CASE WHEN ({first}) IS NULL OR {low} IN {sfx} THEN {low} "
            f"ELSE {labels}[({first}) - 1] || '.' || array_to_string({labels}[({first}):], '.') END")


def sql_normalize_ioc(t: str, v: str) -> str:
    return (f"CASE WHEN {t} = 'domain' THEN {sql_norm_domain(v)} "
            f"WHEN {t} IN ('url', 'email', 'md5', 'sha1', 'sha256') THEN lower({sql_strip(v)}) "
            f"ELSE {sql_strip(v)} END")


def sql_context(text: str, value: str, window: int = 40) -> str:
    pos = f"instr({text}, {value})"
    s0 = f"greatest({pos} - 1 - {window}, 0)"
    e0 = f"least({pos} - 1 + length({value}) + {window}, length({text}))"
    return f"CASE WHEN {pos} = 0 THEN '' ELSE {sql_strip(f'substring({text}, {s0} + 1, {e0} - {s0})')} END"


def sql_event_id(h: str) -> str:
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


def sql_temporal_key(ts: str, hours: int = 24) -> str:
    w = hours * 3600
    return f"'window_' || CAST(CAST(floor(epoch(CAST({ts} AS TIMESTAMP)) / {w}) * {w} AS BIGINT) AS VARCHAR)"


# ---------------------------------------------------------------------------
# Stage CTEs
# ---------------------------------------------------------------------------

RAW = """raw AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS event_id, source, 'doc://' || CAST(doc_id AS VARCHAR) AS source_url,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 240 AS BIGINT)) AS fetched_at, text AS raw_text
  FROM documents
  UNION ALL
  SELECT 'p' || CAST(page_id AS VARCHAR), 'pages', url,
         TIMESTAMP '2024-01-01' + to_hours(CAST(page_id % 240 AS BIGINT)), html
  FROM pages)"""


def cte_norm(patterns: Sequence[str] = V.TEST_NOISE_PATTERNS, min_len: int = 20, min_tok: int = 2,
             src: str = "raw") -> str:
    counts = sql_lang_counts("clean_text")
    cnt_cols = ", ".join(f"{c} AS n_{lang}" for lang, c in counts)
    names = [lang for lang, _ in counts]
    best = f"greatest({', '.join('n_' + n for n in names)})"
    lang = "CASE WHEN best <= 0 THEN 'unknown' " + " ".join(f"WHEN n_{n} = best THEN {q(n)}" for n in names) + " END"
    total = " + ".join("n_" + n for n in names)
    return f"""clean AS (
  SELECT event_id, source, source_url, fetched_at, {sql_clean('raw_text', patterns)} AS clean_text FROM {src}),
langc AS (
  SELECT *, {cnt_cols} FROM clean WHERE length(clean_text) >= {min_len}),
langb AS (SELECT *, {best} AS best FROM langc),
norm AS (
  SELECT event_id, source, source_url, fetched_at, {lang} AS language,
         CASE WHEN best <= 0 THEN 0.0 ELSE CAST(best AS DOUBLE) / ({total}) END AS language_confidence,
         clean_text, {sql_tokens('clean_text', min_tok)} AS tokens
  FROM langb)"""


def cte_ioc(src: str = "norm", text: str = "clean_text", conf: float = 0.75) -> str:
    hits = "\n  UNION ALL\n  ".join(
        f"SELECT event_id AS source_event_id, {text} AS _t, {q(name)} AS ioc_type, "
        f"unnest(list_distinct(regexp_extract_all({text}, {q(pat)}))) AS value FROM {src}"
        for name, pat in IOC_PATTERNS)
    return f"""ioc_hits AS (
  {hits}),
ioc AS (
  SELECT ioc_type, value, {sql_normalize_ioc('ioc_type', 'value')} AS normalized_value,
         {conf} AS confidence, source_event_id, {sql_context('_t', 'value')} AS context
  FROM ioc_hits)"""


def cte_vectors(max_features: int, src: str, text: str) -> str:
    """vec (doc, term, w): unit TF-IDF rows over the most frequent single words."""
    return f"""tfc AS (
  SELECT doc, term, count(*) AS tf FROM (
    SELECT event_id AS doc, unnest(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)) AS term FROM {src})
  GROUP BY doc, term),
tdf AS (SELECT term, count(*) AS df FROM tfc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_features}),
twt AS (SELECT doc, term, tf * (ln((1.0 + (SELECT count(*) FROM {src})) / (1.0 + df)) + 1.0) AS w FROM tfc JOIN tdf USING (term)),
vec AS MATERIALIZED (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM twt)"""


def cte_clusters(max_features: int = V.TEST_FEATURES, src: str = "norm", text: str = "clean_text", k: int = 10) -> str:
    """Mini-batch k-means over the TF-IDF rows of single words, seeds and batches drawn from hashes (k: the automatic number for 30 rows and more)."""
    def distance(n2: str, c2: str, dot: str) -> str:
        return f"round(sqrt(greatest({n2} + {c2} - 2 * {dot}, 0)), {K.DIGITS})"

    ctes = [cte_vectors(max_features, src, text), f"""vrow AS MATERIALIZED (
  SELECT event_id AS doc, coalesce(n2, 0.0) AS n2, ('0x' || substr(md5('{K.SEED}|batch|' || event_id), 1, 8))::BIGINT % {K.BATCHES} AS batch
  FROM {src} LEFT JOIN (SELECT doc, sum(w * w) AS n2 FROM vec GROUP BY doc) ON doc = event_id),
smp AS MATERIALIZED (SELECT doc, n2 FROM vrow ORDER BY md5('{K.SEED}|seed|' || doc), doc LIMIT {K.SEED_ROWS}),
sdot AS MATERIALIZED (
  SELECT a.doc AS a, b.doc AS b, round(a.n2 + b.n2 - 2 * coalesce(d.dot, 0), {K.DIGITS}) AS gap
  FROM smp a CROSS JOIN smp b LEFT JOIN (
    SELECT x.doc AS a, y.doc AS b, sum(x.w * y.w) AS dot FROM vec x JOIN vec y USING (term) SEMI JOIN smp s ON s.doc = x.doc SEMI JOIN smp r ON r.doc = y.doc
    GROUP BY x.doc, y.doc) d ON d.a = a.doc AND d.b = b.doc),
pick0 AS MATERIALIZED (SELECT doc, 0 AS c FROM smp ORDER BY md5('{K.SEED}|seed|' || doc), doc LIMIT 1)"""]
    for s in range(1, k):
        ctes.append(f"""pick{s} AS MATERIALIZED (
  SELECT * FROM pick{s - 1} UNION ALL
  SELECT * FROM (
    SELECT a, {s} FROM (SELECT a, min(gap) AS gap FROM sdot JOIN pick{s - 1} ON b = doc GROUP BY a) WHERE gap > 0
    ORDER BY ln((('0x' || substr(md5('{K.SEED}|{s}|' || a), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / gap DESC, a LIMIT 1))""")
    ctes.append(f"cen0 AS MATERIALIZED (SELECT c, term, w FROM pick{k - 1} JOIN vec USING (doc)),\ncnt0 AS (SELECT c, 0 AS n FROM pick{k - 1})")
    for b in range(K.BATCHES + 1):
        rows = f"(SELECT * FROM vrow WHERE batch = {b})" if b < K.BATCHES else "vrow"
        ctes.append(f"""dst{b} AS MATERIALIZED (
  SELECT r.doc, k.c, {distance('r.n2', 'coalesce(k.c2, 0)', 'coalesce(d.dot, 0)')} AS d
  FROM {rows} r CROSS JOIN (SELECT c, c2 FROM cnt{b} LEFT JOIN (SELECT c, sum(w * w) AS c2 FROM cen{b} GROUP BY c) USING (c)) k
  LEFT JOIN (SELECT v.doc, e.c, sum(v.w * e.w) AS dot FROM vec v JOIN cen{b} e USING (term) GROUP BY v.doc, e.c) d ON d.doc = r.doc AND d.c = k.c)""")
        if b < K.BATCHES:
            ctes.append(f"""asg{b} AS MATERIALIZED (SELECT doc, arg_min(c, (d, c)) AS c FROM dst{b} GROUP BY doc),
cnt{b + 1} AS MATERIALIZED (SELECT c, k.n + coalesce(m.n, 0) AS n, coalesce(m.n, 0) AS m, k.n AS before FROM cnt{b} k LEFT JOIN (SELECT c, count(*) AS n FROM asg{b} GROUP BY c) m USING (c)),
cen{b + 1} AS MATERIALIZED (
  SELECT c, term, CASE WHEN k.m = 0 THEN e.w ELSE (coalesce(e.w, 0) * k.before + coalesce(s.w, 0)) / k.n END AS w
  FROM cen{b} e FULL JOIN (SELECT a.c, v.term, sum(v.w) AS w FROM asg{b} a JOIN vec v USING (doc) GROUP BY a.c, v.term) s USING (c, term) JOIN cnt{b + 1} k USING (c))""")
    ctes.append(f"""clu AS (
  SELECT doc AS event_id, arg_min(c, (d, c)) AS cluster_id,
         CASE WHEN max(d) <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - min(d) / (max(d) + 1e-6))) END AS cluster_confidence FROM dst{K.BATCHES} GROUP BY doc)""")
    return ",\n".join(ctes)


def cte_ana(inc=V.TEST_INCIDENT, sec=V.TEST_SECTOR, min_conf: float = 0.6, clusters: bool = True) -> str:
    cid = "CAST(clu.cluster_id AS INTEGER)" if clusters else "CAST(NULL AS INTEGER)"
    cconf = "clu.cluster_confidence" if clusters else "0.0"
    join = "LEFT JOIN clu USING (event_id)" if clusters else ""
    return f"""{cte_clusters() + ',' if clusters else ''}
ana0 AS (
  SELECT event_id, {sql_keyword_classify('clean_text', inc, min_conf, 'i')},
         {sql_keyword_classify('clean_text', sec, min_conf, 's')} FROM norm),
ana AS (
  SELECT event_id, i_label AS incident_type, i_conf AS incident_confidence, s_label AS sector,
         s_conf AS sector_confidence, {cid} AS cluster_id, CAST({cconf} AS DOUBLE) AS cluster_confidence,
         i_expl AS expl_incident, s_expl AS expl_sector
  FROM ana0 {join})"""


def cte_graph(use_clusters: bool = False, use_temporal: bool = False, hours: int = 24, min_size: int = 2, min_shared: int = 1) -> str:
    parts = ["SELECT x.event_id AS src, '#ioc:' || x.value AS dst FROM ioc_idx x JOIN ioc_multi m USING (value)"]
    if min_shared > 1:  # event pairs
        parts = ["SELECT x.event_id AS src, y.event_id AS dst FROM ioc_idx x JOIN ioc_idx y USING (value) WHERE x.event_id < y.event_id "
                 f"GROUP BY x.event_id, y.event_id HAVING count(*) >= {min_shared}"]
    if use_clusters:
        parts.append("SELECT a.event_id, '#clu:' || CAST(a.cluster_id AS VARCHAR) FROM ana a JOIN "
                     "(SELECT cluster_id FROM ana WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(*) >= 2) c "
                     "USING (cluster_id)")
    if use_temporal:
        parts.append("SELECT event_id, '#win:' || temporal_cluster FROM ev_win WHERE window_size >= 2")
    hub = "\n    UNION ALL ".join(parts)
    return f"""ioc_idx AS (
  SELECT DISTINCT normalized_value AS value, source_event_id AS event_id FROM ioc
  WHERE normalized_value IS NOT NULL AND source_event_id IS NOT NULL),
ioc_multi AS (SELECT value FROM ioc_idx GROUP BY value HAVING count(*) >= 2),
ev_win0 AS (SELECT event_id, fetched_at, {sql_temporal_key('fetched_at', hours)} AS temporal_cluster FROM norm),
ev_win AS (SELECT e.*, count(*) OVER (PARTITION BY temporal_cluster) AS window_size FROM ev_win0 e),
hub AS ({hub}),
g_edges AS (SELECT src, dst FROM hub UNION SELECT dst, src FROM hub),
g_nodes AS (SELECT event_id AS node FROM norm UNION SELECT src FROM g_edges),
cc(node, comp) USING KEY (node) AS (
  SELECT node, node FROM g_nodes
  UNION
  SELECT e.dst, min(c.comp) FROM cc c JOIN g_edges e ON c.node = e.src JOIN recurring.cc r ON r.node = e.dst
  GROUP BY e.dst, r.comp HAVING min(c.comp) < r.comp),
ev_comp AS (
  SELECT c.node AS event_id, c.comp AS component, (n.event_id IS NOT NULL) AS known
  FROM cc c LEFT JOIN norm n ON n.event_id = c.node
  WHERE NOT (c.node LIKE '#ioc:%' OR c.node LIKE '#clu:%' OR c.node LIKE '#win:%')),
comp_rank AS (
  SELECT component, count(*) AS component_size,
         dense_rank() OVER (ORDER BY min(CASE WHEN known THEN '0' ELSE '1' END || event_id)) AS component_number
  FROM ev_comp GROUP BY component),
membership AS (
  SELECT e.event_id, e.known, r.component_number, r.component_size,
         CASE WHEN r.component_size >= {min_size} THEN printf('CAMP-%04d', r.component_number) END AS campaign_id
  FROM ev_comp e JOIN comp_rank r USING (component))"""


def cte_cor(w=(0.4, 0.2, 0.2, 0.1, 0.1)) -> str:
    return f"""shared AS (
  SELECT x.event_id, list_sort(list(x.value)) AS shared_iocs, count(*) AS n_shared
  FROM ioc_idx x JOIN ioc_multi m USING (value) GROUP BY x.event_id),
max_shared AS (SELECT coalesce(max(n_shared), 1) AS mx FROM shared),
csize AS (SELECT cluster_id, count(*) AS n_events FROM ana WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
cor AS (
  SELECT n.event_id, m.campaign_id, coalesce(s.shared_iocs, CAST([] AS VARCHAR[])) AS shared_iocs,
         w.temporal_cluster, {sql_mitre('n.clean_text')} AS mitre_tactics,
         greatest(0.0, least(1.0,
           {w[0]} * (CASE WHEN s.n_shared > 0 THEN least(1.0, s.n_shared / CAST((SELECT mx FROM max_shared) AS DOUBLE)) ELSE 0.0 END)
           + {w[1]} * (CASE WHEN a.cluster_id IS NOT NULL AND cs.n_events > 1 THEN 1.0 ELSE 0.0 END)
           + {w[2]} * (CASE WHEN w.window_size > 1 THEN 1.0 ELSE 0.0 END)
           + {w[3]} * coalesce(a.incident_confidence, 0.0)
           + {w[4]} * coalesce(a.sector_confidence, 0.0))) AS confidence
  FROM norm n
  LEFT JOIN ev_win w USING (event_id)
  LEFT JOIN shared s USING (event_id)
  LEFT JOIN ana a USING (event_id)
  LEFT JOIN csize cs ON cs.cluster_id = a.cluster_id
  LEFT JOIN membership m USING (event_id))"""


CTE_CAMP = """camp_iocs AS (
  SELECT DISTINCT m.campaign_id, u.ioc FROM membership m JOIN (SELECT event_id, unnest(shared_iocs) AS ioc FROM cor) u
  USING (event_id) WHERE m.campaign_id IS NOT NULL),
camp_tac AS (
  SELECT m.campaign_id, list_sort(list(DISTINCT u.t)) AS mitre_tactics FROM membership m
  JOIN (SELECT event_id, unnest(mitre_tactics) AS t FROM cor) u USING (event_id)
  WHERE m.campaign_id IS NOT NULL GROUP BY m.campaign_id),
camp AS (
  SELECT s.campaign_id, s.campaign_id AS name, s.start_time, s.end_time, s.n_events,
         coalesce(i.n_iocs, 0) AS n_iocs, coalesce(t.mitre_tactics, CAST([] AS VARCHAR[])) AS mitre_tactics,
         least(1.0, CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * s.n_events + CAST(0.05 AS DOUBLE) * coalesce(i.n_iocs, 0)) AS confidence
  FROM (SELECT m.campaign_id, count(*) AS n_events, min(n.fetched_at) AS start_time, max(n.fetched_at) AS end_time
        FROM membership m LEFT JOIN norm n USING (event_id) WHERE m.campaign_id IS NOT NULL GROUP BY m.campaign_id) s
  LEFT JOIN (SELECT campaign_id, count(*) AS n_iocs FROM camp_iocs GROUP BY campaign_id) i USING (campaign_id)
  LEFT JOIN camp_tac t USING (campaign_id))"""


def cte_sco(w=(0.35, 0.15, 0.30, 0.10, 0.10), th=(0.3, 0.6, 0.8)) -> str:
    sev = (f"greatest(0.0, least(1.0, {w[0]} * a.incident_confidence + {w[1]} * a.sector_confidence "
           f"+ {w[2]} * coalesce(c.confidence, 0.0) "
           f"+ {w[3]} * least(1.0, CAST(coalesce(k.ioc_count, 0) AS DOUBLE) / 10.0) "
           f"+ {w[4]} * (CASE WHEN c.event_id IS NULL THEN 0.0 ELSE least(1.0, CAST(len(c.mitre_tactics) AS DOUBLE) / 5.0) END)))")
    return f"""ioc_counts AS (
  SELECT source_event_id, count(*) AS ioc_count FROM ioc
  WHERE source_event_id IS NOT NULL AND source_event_id <> '' GROUP BY source_event_id),
sco AS (
  SELECT a.event_id, {sev} AS severity,
         CASE WHEN {sev} >= {th[2]} THEN 'high' WHEN {sev} >= {th[1]} THEN 'medium'
              WHEN {sev} >= {th[0]} THEN 'low' ELSE 'informational' END AS severity_label,
         greatest(a.incident_confidence, coalesce(c.confidence, 0.0)) AS confidence,
         a.incident_confidence AS incident_conf, a.sector_confidence AS sector_conf,
         coalesce(c.confidence, 0.0) AS correlation_conf,
         least(1.0, CAST(coalesce(k.ioc_count, 0) AS DOUBLE) / 10.0) AS ioc_score,
         CASE WHEN c.event_id IS NULL THEN 0.0 ELSE least(1.0, CAST(len(c.mitre_tactics) AS DOUBLE) / 5.0) END AS mitre_score
  FROM ana a LEFT JOIN cor c USING (event_id) LEFT JOIN ioc_counts k ON k.source_event_id = a.event_id)"""


STAGES = {
    "raw": lambda: RAW,
    "norm": cte_norm,
    "ioc": cte_ioc,
    "ana": cte_ana,
    "graph": cte_graph,
    "cor": cte_cor,
    "camp": lambda: CTE_CAMP,
    "sco": cte_sco,
}
ORDER = ["raw", "norm", "ioc", "ana", "graph", "cor", "camp", "sco"]


def chain(upto: str) -> str:
    """WITH clause holding every stage up to and including ``upto``."""
    names = ORDER[: ORDER.index(upto) + 1]
    return "WITH RECURSIVE " + ",\n".join(STAGES[n]() for n in names) + "\n"


def with_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
