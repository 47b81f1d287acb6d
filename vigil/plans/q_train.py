"""Registered queries: training split/metrics, Spark ML fit (rows-only) and weak labelling."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigil.functions.keywords import merge_keywords
from vigil.operators import train as TR
from vigil.operators import weak as W
from vigil.params import SOURCE_DOMAIN_MAP, WEAK_INCIDENT_KEYWORDS, WEAK_SECTOR_KEYWORDS, WeakLabelParams
from vigil.plans import oracle as O
from vigil.plans.registry import dbl, register, s_dbl
from vigil.plans.views import TEST_INCIDENT, TEST_SECTOR, Chain, read_table
from vigil.session import scratch

# --- metrics over labels (toxic read as a prediction of quality) ----------------

PC_SQL = """pc0 AS (
  SELECT CAST(quality AS VARCHAR) AS label, 1 AS is_t, 0 AS is_p, CAST(quality = toxic AS INTEGER) AS hit FROM labels
  UNION ALL SELECT CAST(toxic AS VARCHAR), 0, 1, CAST(quality = toxic AS INTEGER) FROM labels),
pc AS (SELECT label, sum(hit * is_t) AS tp, sum(is_p) - sum(hit * is_t) AS fp, sum(is_t) - sum(hit * is_t) AS fn,
              sum(is_t) AS support FROM pc0 GROUP BY label),
pr AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, support FROM pc),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


def labels_df(spark, sf):
    return read_table(spark, sf, "labels")


@register("trn_split", """
WITH h AS (SELECT doc_id, quality, sha256('42|' || CAST(doc_id AS VARCHAR)) AS k FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY k, doc_id) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, rk <= ceil(0.2 * n) AS is_test FROM r""")
def trn_split(spark, sf):
    return TR.stratified_split(labels_df(spark, sf), "quality", "doc_id").select("doc_id", "quality", "is_test")


@register("trn_class_weight", f"""
SELECT quality, count(*) AS n_c, {s_dbl('(SELECT count(*) FROM labels) / (CAST((SELECT count(DISTINCT quality) FROM labels) AS DOUBLE) * count(*))')} AS weight
FROM labels GROUP BY quality""")
def trn_class_weight(spark, sf):
    w = TR.class_weights(labels_df(spark, sf), "quality")
    return w.select("quality", "n_c", dbl("weight").alias("weight"))


@register("trn_accuracy", f"SELECT {s_dbl('avg(CAST(quality = toxic AS DOUBLE))')} AS accuracy FROM labels")
def trn_accuracy(spark, sf):
    return labels_df(spark, sf).agg(dbl(F.avg((F.col("quality") == F.col("toxic")).cast("double"))).alias("accuracy"))


@register("trn_f1_macro", "WITH " + PC_SQL + f"\nSELECT {s_dbl('avg(f1)')} AS f1_macro FROM rep")
def trn_f1_macro(spark, sf):
    m = TR.metrics(labels_df(spark, sf), "quality", "toxic")
    return m.select(dbl("f1_macro").alias("f1_macro"))


@register("trn_f1_weighted", "WITH " + PC_SQL + f"\nSELECT {s_dbl('sum(f1 * support) / sum(support)')} AS f1_weighted FROM rep")
def trn_f1_weighted(spark, sf):
    m = TR.metrics(labels_df(spark, sf), "quality", "toxic")
    return m.select(dbl("f1_weighted").alias("f1_weighted"))


@register("trn_class_report", "WITH " + PC_SQL + f"""
SELECT label, {s_dbl('precision')} AS precision, {s_dbl('recall')} AS recall, {s_dbl('f1')} AS f1, CAST(support AS BIGINT) AS support FROM rep
UNION ALL SELECT 'macro avg', {s_dbl('avg(precision)')}, {s_dbl('avg(recall)')}, {s_dbl('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'weighted avg', {s_dbl('sum(precision * support) / sum(support)')}, {s_dbl('sum(recall * support) / sum(support)')},
       {s_dbl('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM rep""")
def trn_class_report(spark, sf):
    r = TR.class_report(labels_df(spark, sf), "quality", "toxic")
    return r.select("label", dbl("precision").alias("precision"), dbl("recall").alias("recall"), dbl("f1").alias("f1"),
                    F.col("support").cast("long").alias("support"))


def labelled_docs(spark, sf):
    """documents joined with labels; label = quality as text."""
    d = read_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    lab = labels_df(spark, sf).select("doc_id", F.col("quality").cast("string").alias("label"))
    return d.join(lab, "doc_id")


_FITS: dict = {}


def _fit_eval(spark, sf):
    """Fit once per (session, input); the three training keys share the model."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        data = TR.stratified_split(labelled_docs(spark, sf), "label", "doc_id")
        model = TR.fit(data.filter(~F.col("is_test")).select("doc_id", "text", "label"))
        pred = TR.predict(model, data.filter(F.col("is_test")).select("doc_id", "text", "label"))
        _FITS[key] = (model, pred)
    return _FITS[key]


@register("trn_fit")
def trn_fit(spark, sf):
    _, pred = _fit_eval(spark, sf)
    return pred.select("doc_id", "label", "prediction_label", dbl("confidence").alias("confidence"))


@register("trn_train_job")
def trn_train_job(spark, sf):
    """Two classifiers (quality and toxic stand for incident and sector), each fitted, saved and scored."""
    d = read_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    jobs = TR.train_job(d.join(labels_df(spark, sf), "doc_id"), "doc_id", {"incident": "quality", "sector": "toxic"}, scratch(spark, "models"))
    one, two = (m.withColumn("classifier", F.lit(name)) for name, (_, m) in jobs.items())
    return one.unionByName(two)


@register("trn_model_io", """
WITH n AS (SELECT CAST(sum(ceil(0.2 * n)) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality))
SELECT n AS n_rows, n AS n_equal FROM n""")
def trn_model_io(spark, sf):
    from pyspark.ml import PipelineModel

    model, pred = _fit_eval(spark, sf)
    path = scratch(spark, "trn_model_io")
    model.write().save(path)
    again = TR.predict(PipelineModel.load(path), pred.select("doc_id", "text", "label"))
    a = pred.select("doc_id", F.col("prediction_label").alias("p1"))
    b = again.select("doc_id", F.col("prediction_label").alias("p2"))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum((F.col("p1") == F.col("p2")).cast("int")).alias("n_equal"))


@register("read_labeled", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, {O.sql_strip('d.text')} AS text, CAST(l.quality AS VARCHAR) AS label
FROM documents d JOIN labels l USING (doc_id) WHERE {O.sql_strip('d.text')} <> ''""")
def read_labeled(spark, sf):
    """Labelled rows written as CSV with a header, read back; blank text or label dropped."""
    path = scratch(spark, "labeled_csv")
    labelled_docs(spark, sf).write.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return TR.read_labeled(spark, path).select("doc_id", "text", "label")


@register("read_labeled_jsonl", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, {O.sql_strip('d.text')} AS text, CAST(l.quality AS VARCHAR) AS label
FROM documents d JOIN labels l USING (doc_id) WHERE {O.sql_strip('d.text')} <> ''""")
def read_labeled_jsonl(spark, sf):
    path = scratch(spark, "labeled_jsonl")
    labelled_docs(spark, sf).write.json(path)
    return TR.read_labeled(spark, path, "jsonl").select("doc_id", "text", "label")


# --- weak labels ----------------------------------------------------------------

WEAK_INC = merge_keywords(TEST_INCIDENT, WEAK_INCIDENT_KEYWORDS)
WEAK_SEC = merge_keywords(TEST_SECTOR, WEAK_SECTOR_KEYWORDS)
WEAK_DOMAINS = {**SOURCE_DOMAIN_MAP, "example.com": "corporate", "example.org": "govt", "example.net": "banking"}
WP = WeakLabelParams()
AUTH = O.q(W.AUTHORITY_RE)


def sql_hits(t: str, kws) -> str:
    seen, parts = [], []
    for k in kws:
        kk = k.lower().strip()
        if not kk or kk in seen:
            continue
        seen.append(kk)
        if re.fullmatch(r"[a-z0-9]+", kk):
            cond = f"regexp_matches(lower({t}), {O.q('(^|[^\\p{L}\\p{N}_])' + kk + '($|[^\\p{L}\\p{N}_])')})"
        else:
            cond = f"contains(lower({t}), {O.q(kk)})"
        parts.append(f"(CASE WHEN {cond} THEN 1 ELSE 0 END)")
    return " + ".join(parts) if parts else "0"


def sql_text_scores(src: str, id_col: str, t: str, kmap, weight: float) -> str:
    return " UNION ALL ".join(
        f"SELECT {id_col} AS id, {O.q(label)} AS label, CAST(({sql_hits(t, kws)}) * {float(weight)} AS DOUBLE) AS score FROM {src} "
        f"WHERE ({sql_hits(t, kws)}) > 0" for label, kws in kmap.items())


def sql_domain_scores(src: str, id_col: str, url: str, dmap, weight: float) -> str:
    host = f"lower(regexp_extract(coalesce({url}, ''), {AUTH}, 1))"
    return " UNION ALL ".join(
        f"SELECT {id_col} AS id, {O.q(lab)} AS label, CAST({float(weight)} AS DOUBLE) AS score FROM {src} WHERE contains({host}, {O.q(d)})"
        for d, lab in dmap.items())


def sql_choose(scores: str, min_score: float, margin: float) -> str:
    return f"""comb AS (SELECT id, label, sum(score) AS score FROM ({scores}) GROUP BY id, label),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn,
              lead(score) OVER (PARTITION BY id ORDER BY score DESC, label) AS nxt FROM comb),
chosen AS (SELECT id, label, score, coalesce(nxt, 0.0) AS runner_up FROM rk
           WHERE rn = 1 AND score >= {min_score} AND score - coalesce(nxt, 0.0) >= {margin})"""


SECTOR_TEXT = "trim(coalesce(clean_text, '') || chr(10) || coalesce(source, ''), ' ')"
INC_SQL = O.chain("norm") + "," + sql_choose(sql_text_scores("norm", "event_id", "clean_text", WEAK_INC, WP.weight_text),
                                             WP.incident_min_score, WP.margin)
SEC_SQL = O.chain("norm") + "," + sql_choose(
    sql_text_scores("norm", "event_id", SECTOR_TEXT, WEAK_SEC, WP.weight_text) + " UNION ALL "
    + sql_domain_scores("norm", "event_id", "source_url", WEAK_DOMAINS, WP.weight_domain),
    WP.sector_min_score, WP.margin)


@register("wek_keyword_hits", O.chain("norm") + "\n" + " UNION ALL ".join(
    f"SELECT event_id, {O.q(label)} AS label, CAST({sql_hits('clean_text', kws)} AS BIGINT) AS hits FROM norm"
    for label, kws in WEAK_INC.items()))
def wek_keyword_hits(spark, sf):
    from vigil.functions.keywords import keyword_hits
    n = Chain.of(spark, sf).norm
    rows = F.array(*[F.struct(F.lit(l).alias("label"), keyword_hits(F.col("clean_text"), k).cast("long").alias("hits"))
                     for l, k in WEAK_INC.items()])
    return n.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.label", "r.hits")


@register("wek_text_scores", O.chain("norm") + "\n" + sql_text_scores("norm", "event_id", "clean_text", WEAK_INC, 1.0)
          .replace("AS score FROM", "AS score_raw FROM").replace("SELECT event_id AS id", "SELECT event_id AS id")
          .replace("AS score_raw", "AS score"))
def wek_text_scores(spark, sf):
    n = Chain.of(spark, sf).norm
    return W.text_scores(n, "event_id", F.col("clean_text"), WEAK_INC, 1.0).select("id", "label", "score")


@register("wek_domain_scores", O.chain("norm") + "\n" + sql_domain_scores("norm", "event_id", "source_url", WEAK_DOMAINS, 0.7))
def wek_domain_scores(spark, sf):
    n = Chain.of(spark, sf).norm
    return W.domain_scores(n, "event_id", F.col("source_url"), WEAK_DOMAINS, 0.7).select("id", "label", "score")


@register("wek_combine", O.chain("norm") + f""",
comb AS (SELECT id, label, sum(score) AS score FROM ({sql_text_scores('norm', 'event_id', SECTOR_TEXT, WEAK_SEC, 1.0)}
  UNION ALL {sql_domain_scores('norm', 'event_id', 'source_url', WEAK_DOMAINS, 0.7)}) GROUP BY id, label)
SELECT id, label, {s_dbl('score')} AS score FROM comb""")
def wek_combine(spark, sf):
    n = Chain.of(spark, sf).norm
    text = F.btrim(F.concat(F.coalesce("clean_text", F.lit("")), F.lit("\n"), F.coalesce("source", F.lit(""))), F.lit(" "))
    c = W.combine(W.text_scores(n, "event_id", text, WEAK_SEC, 1.0),
                  W.domain_scores(n, "event_id", F.col("source_url"), WEAK_DOMAINS, 0.7))
    return c.select("id", "label", dbl("score").alias("score"))


@register("wek_choose_label", INC_SQL + f"\nSELECT id, label, {s_dbl('score')} AS score, {s_dbl('runner_up')} AS runner_up FROM chosen")
def wek_choose_label(spark, sf):
    n = Chain.of(spark, sf).norm
    c = W.label_incident(n, "event_id", "clean_text", WEAK_INC, WP)
    return c.select("id", "label", dbl("score").alias("score"), dbl("runner_up").alias("runner_up"))


@register("wek_incident", INC_SQL + "\nSELECT id AS event_id, label FROM chosen")
def wek_incident(spark, sf):
    n = Chain.of(spark, sf).norm
    return W.label_incident(n, "event_id", "clean_text", WEAK_INC, WP).select(F.col("id").alias("event_id"), "label")


@register("wek_sector", SEC_SQL + "\nSELECT id AS event_id, label FROM chosen")
def wek_sector(spark, sf):
    n = Chain.of(spark, sf).norm
    s = W.label_sector(n.withColumn("clean_text", F.btrim("clean_text", F.lit(" "))), "event_id", "clean_text", "source",
                       "source_url", WEAK_SEC, WEAK_DOMAINS, WP)
    return s.select(F.col("id").alias("event_id"), "label")


@register("wek_min_class", INC_SQL + """
SELECT id AS event_id, label FROM chosen WHERE label IN (SELECT label FROM chosen GROUP BY label HAVING count(*) >= 5)""")
def wek_min_class(spark, sf):
    n = Chain.of(spark, sf).norm
    lab = W.label_incident(n, "event_id", "clean_text", WEAK_INC, WP)
    return W.min_class(lab, WP.min_class_count).select(F.col("id").alias("event_id"), "label")


@register("wek_sample", """
SELECT doc_id, lang FROM documents ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def wek_sample(spark, sf):
    return W.seeded_sample(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


@register("wek_train_gate")
def wek_train_gate(spark, sf):
    """Weak incident and sector labels -> class filter -> each kind with at least two labels is trained, saved and scored."""
    n = Chain.of(spark, sf).norm
    weak = {"incident": W.label_incident(n, "event_id", "clean_text", WEAK_INC, WP),
            "sector": W.label_sector(n, "event_id", "clean_text", "source", "source_url", WEAK_SEC, WEAK_DOMAINS, WP)}
    jobs = W.train_gate(weak, n.select(F.col("event_id").alias("id"), F.col("clean_text").alias("text")), scratch(spark, "weak_models"), WP.min_class_count)
    out = spark.createDataFrame([], "accuracy double, f1_macro double, f1_weighted double, classifier string")
    for name, (_, m) in jobs.items():
        out = out.unionByName(m.withColumn("classifier", F.lit(name)))
    return out


@register("wek_prelabel_csv", O.chain("ana") + """
SELECT n.event_id, n.clean_text AS text, n.source, n.source_url,
       CASE WHEN a.incident_type = 'unknown' THEN '' ELSE a.incident_type END AS incident_label,
       CASE WHEN a.sector = 'unknown' THEN '' ELSE a.sector END AS sector_label
FROM norm n JOIN ana a USING (event_id)""")
def wek_prelabel_csv(spark, sf):
    c = Chain.of(spark, sf)
    sheet = c.norm.join(c.ana, "event_id").select(
        "event_id", F.col("clean_text").alias("text"), "source", "source_url",
        F.when(F.col("incident_type") == "unknown", "").otherwise(F.col("incident_type")).alias("incident_label"),
        F.when(F.col("sector") == "unknown", "").otherwise(F.col("sector")).alias("sector_label"))
    path = scratch(spark, "prelabel_csv")
    opts = {"header": True, "multiLine": True, "escape": '"', "emptyValue": "", "nullValue": None}
    sheet.write.options(**{k: v for k, v in opts.items() if v is not None}).csv(path)
    back = spark.read.options(header=True, multiLine=True, escape='"').schema(sheet.schema).csv(path)
    return back.select("event_id", "text", "source", "source_url", F.coalesce("incident_label", F.lit("")).alias("incident_label"),
                       F.coalesce("sector_label", F.lit("")).alias("sector_label"))
