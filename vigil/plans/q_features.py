"""Registered queries: text features, TF-IDF, clustering and the linear text model."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import classify
from vigil.operators import clusters as K
from vigil.operators import density as DE
from vigil.operators import features as FE
from vigil.plans import oracle as O
from vigil.plans.registry import arr, dbl, register, s_arr, s_dbl
from vigil.plans.views import Chain, read_table
from vigil.session import materialize

SW = O.in_list(FE.CLUSTER_STOP_WORDS)

TFIDF_SQL = f"""WITH u AS (
  SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), {O.q(FE.WORD_RUN)}),
                                    lambda w: length(w) >= 2 AND w NOT IN {SW}) AS u FROM documents),
t AS (SELECT doc, list_concat(u, CASE WHEN len(u) >= 2 THEN list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])
                                  ELSE CAST([] AS VARCHAR[]) END) AS terms FROM u),
tc AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM t) GROUP BY doc, term),
nd AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY term),
tw AS (SELECT tc.doc, tc.term, tc.tf * (ln((1.0 + (SELECT n FROM nd)) / (1.0 + voc.df)) + 1.0) AS w FROM tc JOIN voc USING (term)),
tfidf AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM tw)
"""


def docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id").select("doc_id", "text")


def weights(spark, sf, unit=False):
    return FE.text_weights(read_table(spark, sf, "documents"), "doc_id", "text", unit)  # which deals the texts out itself


@register("clu_terms", TFIDF_SQL + f"SELECT doc AS doc_id, {s_arr('terms', True)} AS terms, CAST(len(terms) AS BIGINT) AS n_terms FROM t")
def clu_terms(spark, sf):
    d = docs(spark, sf).select("doc_id", FE.terms(F.col("text")).alias("t"))
    return d.select("doc_id", arr("t", True).alias("terms"), F.size("t").cast("long").alias("n_terms"))


@register("clu_vocabulary", TFIDF_SQL + "SELECT term, cf, df FROM voc")
def clu_vocabulary(spark, sf):
    d = docs(spark, sf)
    return FE.vocabulary(FE.term_counts(FE.term_rows(d, "doc_id", "text")), d.count()).select("term", "cf", "df")


@register("clu_tfidf", TFIDF_SQL + f"SELECT doc AS doc_id, term, {s_dbl('weight')} AS weight FROM tfidf")
def clu_tfidf(spark, sf):
    return weights(spark, sf, unit=True).select(F.col("doc").alias("doc_id"), "term", dbl("w").alias("weight"))


CENTRES_SQL = """WITH cd AS (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS centre FROM cd GROUP BY label),
d AS (SELECT e.vec_id, c.label AS clabel, list_distance(CAST(e.embedding AS DOUBLE[]), c.centre) AS dist
      FROM embeddings e CROSS JOIN c)
"""


def label_centres(emb):
    """Per-label mean vectors (k rows x dim; k is the small label count) as Python lists."""
    p = emb.select("label", F.posexplode("embedding").alias("i", "x"))
    m = p.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()
    return [r["label"] for r in rows], [[x["m"] for x in r["c"]] for r in rows]


@register("clu_kmeans_confidence", CENTRES_SQL + f"""
SELECT vec_id, arg_min(clabel, dist) AS nearest_label,
       {s_dbl('CASE WHEN max(dist) <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - min(dist) / (max(dist) + 1e-6))) END')} AS confidence
FROM d GROUP BY vec_id""")
def clu_kmeans_confidence(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    labels, centres = label_centres(emb)
    d = FE.centre_distances(F.col("embedding"), centres)
    lab = F.array(*[F.lit(x) for x in labels])
    return emb.select("vec_id", F.element_at(lab, FE.nearest(d) + 1).alias("nearest_label"),
                      dbl(FE.kmeans_confidence(d)).alias("confidence"))


@register("clu_kmeans")
def clu_kmeans(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return FE.kmeans(emb, "vec_id", "embedding", n_clusters=10).select(
        F.col("id").alias("vec_id"), "cluster_id", dbl("cluster_confidence").alias("cluster_confidence"))


@register("clu_kmeans_text", "WITH src AS (SELECT CAST(doc_id AS VARCHAR) AS event_id, text FROM documents),\n" + O.cte_clusters(2000, "src", "text")
          + f" SELECT CAST(event_id AS BIGINT) AS doc_id, CAST(cluster_id AS INTEGER) AS cluster_id, {s_dbl('cluster_confidence')} AS cluster_confidence FROM clu")
def clu_kmeans_text(spark, sf):
    """Mini-batch k-means over the TF-IDF rows of single words."""
    c = K.kmeans_texts(docs(spark, sf), "doc_id", "text", 2000, ngram_max=1, stop_words=())
    return c.select("doc_id", "cluster_id", dbl("cluster_confidence").alias("cluster_confidence"))


DENSITY_FEATURES, EPS, MIN_SAMPLES = 500, 0.5, 3


@register("clu_dbscan", "WITH RECURSIVE src AS (SELECT doc_id AS event_id, text FROM documents),\n" + O.cte_vectors(DENSITY_FEATURES, "src", "text") + f""",
pairs AS MATERIALIZED (SELECT x.doc AS a, y.doc AS b FROM vec x JOIN vec y USING (term) GROUP BY x.doc, y.doc HAVING round(1 - sum(x.w * y.w), {DE.DIGITS}) <= {EPS}),
core AS MATERIALIZED (SELECT a AS node FROM pairs GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
edges AS MATERIALIZED (SELECT a AS src, b AS dst FROM pairs SEMI JOIN core c ON c.node = a SEMI JOIN core d ON d.node = b WHERE a <> b),
cc(node, comp) USING KEY (node) AS (
  SELECT node, node FROM core
  UNION
  SELECT e.dst, min(c.comp) FROM cc c JOIN edges e ON c.node = e.src JOIN recurring.cc r ON r.node = e.dst
  GROUP BY e.dst, r.comp HAVING min(c.comp) < r.comp),
num AS (SELECT node, dense_rank() OVER (ORDER BY comp) - 1 AS cluster_id FROM cc),
lab AS (SELECT node AS doc, cluster_id FROM num UNION ALL
        SELECT a, min(cluster_id) FROM pairs JOIN num ON b = node WHERE a NOT IN (SELECT node FROM core) GROUP BY a)
SELECT event_id AS doc_id, CAST(cluster_id AS INTEGER) AS cluster_id FROM src LEFT JOIN lab ON doc = event_id""")
def clu_dbscan(spark, sf):
    """Density clustering of the TF-IDF rows of single words by cosine distance."""
    v = K.text_vectors(docs(spark, sf), "doc_id", "text", DENSITY_FEATURES, ngram_max=1, stop_words=())
    return DE.density_clusters(v, EPS, MIN_SAMPLES).select(F.col("id").alias("doc_id"), "cluster_id")


@register("clu_cluster_summary", "SELECT count(DISTINCT label) AS n_clusters FROM embeddings WHERE label IS NOT NULL")
def clu_cluster_summary(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.filter(F.col("label").isNotNull()).agg(F.count_distinct("label").alias("n_clusters"))


# --- linear text model as joins -----------------------------------------------------

# Test model: a small fixed coefficient table over frequent driver terms.
COEFS = [("alpha", "de", 1.5), ("alpha", "la", 0.8), ("alpha", "les", 0.6),
         ("beta", "der", 1.7), ("beta", "und", 1.2), ("beta", "die", 0.9),
         ("gamma", "th", 1.3), ("gamma", "er", 1.0), ("gamma", "nd", 0.7)]
INTERCEPTS = {"alpha": 0.0, "beta": -0.1, "gamma": 0.1}
MIN_CONF = 0.6
COEF_SQL = ("coefs AS (SELECT * FROM (VALUES " + ", ".join(f"({O.q(l)}, {O.q(t)}, {c})" for l, t, c in COEFS)
            + ") v(label, term, coef)),\nlabs AS (SELECT * FROM (VALUES " + ", ".join(
                f"({O.q(l)}, {v}, {i})" for i, (l, v) in enumerate(INTERCEPTS.items())) + ") v(label, icpt, ord)),")
MODEL_SQL = TFIDF_SQL.replace("tfidf AS (", COEF_SQL + "\ntfidf AS (", 1).rstrip() + """,
sc AS (
  SELECT d.doc, l.label, l.ord, l.icpt + coalesce(sum(w.weight * c.coef), 0.0) AS score
  FROM (SELECT doc_id AS doc FROM documents) d CROSS JOIN labs l
  LEFT JOIN tfidf w ON w.doc = d.doc LEFT JOIN coefs c ON c.term = w.term AND c.label = l.label
  GROUP BY d.doc, l.label, l.ord, l.icpt),
pr2 AS (SELECT doc, label, ord, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY doc) AS p
        FROM (SELECT *, max(score) OVER (PARTITION BY doc) AS mx FROM sc)),
best AS (SELECT doc, label AS argmax_label, p FROM pr2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY p DESC, ord) = 1),
pred AS (SELECT doc, CASE WHEN p >= """ + str(MIN_CONF) + """ THEN argmax_label ELSE 'unknown' END AS label, p AS confidence, argmax_label FROM best)
"""


def _model(spark, sf):
    w = weights(spark, sf)
    coefs = spark.createDataFrame(COEFS, "label string, term string, coef double")
    scores = FE.linear_scores(w, coefs, INTERCEPTS, docs(spark, sf).select(F.col("doc_id").alias("doc")))
    return w, coefs, FE.softmax_predict(scores, list(INTERCEPTS), MIN_CONF)


@register("cls_model_predict", MODEL_SQL + f"SELECT doc AS doc_id, label, {s_dbl('confidence')} AS confidence, argmax_label FROM pred")
def cls_model_predict(spark, sf):
    _, _, p = _model(spark, sf)
    return p.select(F.col("doc").alias("doc_id"), "label", dbl("confidence").alias("confidence"), "argmax_label")


@register("cls_model_explain", MODEL_SQL + f""",
c AS (SELECT w.doc, w.term, w.weight * c.coef AS v FROM tfidf w JOIN coefs c USING (term)
      JOIN pred p ON p.doc = w.doc AND p.label = c.label),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY v DESC, term) AS rn FROM c)
SELECT doc AS doc_id, array_to_string(list(term ORDER BY rn), '|') AS terms FROM r WHERE rn <= 5 GROUP BY doc""")
def cls_model_explain(spark, sf):
    w, coefs, p = _model(spark, sf)
    e = FE.explain(w, coefs, p)
    return e.select(F.col("doc").alias("doc_id"), arr("terms", True).alias("terms"))


@register("cls_analyze_model", O.chain("ana").rstrip() + ",\n" + MODEL_SQL.removeprefix("WITH ").rstrip() + f"""
SELECT ana.event_id, coalesce(pred.label, incident_type) AS incident_type, {s_dbl('coalesce(pred.confidence, incident_confidence)')} AS incident_confidence,
       sector, {s_dbl('sector_confidence')} AS sector_confidence, cluster_id FROM ana LEFT JOIN pred ON ana.event_id = 'd' || pred.doc""")
def cls_analyze_model(spark, sf):
    """The analysis stage with a trained model for the incident type: its predictions where it has one, keywords elsewhere."""
    _, _, p = _model(spark, sf)
    predictions = materialize(p.select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("event_id"), "label", "confidence"), "predictions")
    c = Chain.of(spark, sf)
    a = classify.analyze(c.norm, c.inc, c.sec, c.clusters, incident_predictions=predictions)
    return a.select("event_id", "incident_type", dbl("incident_confidence").alias("incident_confidence"), "sector", dbl("sector_confidence").alias("sector_confidence"), "cluster_id")
