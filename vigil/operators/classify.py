"""Analysis: keyword classifiers for incident type and sector, joined with clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.keywords import classify_from_matches, keyword_classify, keyword_match_struct
from vigil.params import ClassifierParams


def _model_first(df: DataFrame, predictions: DataFrame | None, col: str) -> DataFrame:
    """A trained model's prediction where it has one, the keyword classifier's otherwise."""
    if predictions is None:
        return df
    p = predictions.select(F.col("event_id").alias("_pid"), F.struct(
        "label", F.col("confidence").cast("double").alias("confidence"),
        (F.col("explanation") if "explanation" in predictions.columns else F.array().cast("array<string>")).alias("explanation")).alias("_p"))
    return df.join(p, F.col("event_id") == F.col("_pid"), "left").withColumn(col, F.coalesce("_p", col)).drop("_pid", "_p")


def analyze(norm: DataFrame, incident: ClassifierParams | None = None,
            sector: ClassifierParams | None = None, clusters: DataFrame | None = None,
            text_col: str = "clean_text", incident_predictions: DataFrame | None = None,
            sector_predictions: DataFrame | None = None) -> DataFrame:
    """analysis_results rows: both predictions, cluster id/confidence, explanations map.

    ``incident_predictions`` / ``sector_predictions`` (event_id, label, confidence[, explanation]) come from trained
    models (``train.predict`` or ``features.softmax_predict``); events without one fall back to the keywords.

    A classifier given as None predicts ("unknown", 0.0, []). ``clusters`` is
    an optional (event_id, cluster_id, cluster_confidence) table; without it
    clustering is off (null, 0.0).
    """
    inc = incident if incident is not None else ClassifierParams()
    sec = sector if sector is not None else ClassifierParams()
    df = norm.select("event_id", F.col(text_col).alias("_t"))
    if inc.label_keywords and sec.label_keywords:
        # matches first, then the pick: each substring test runs once per row
        df = df.select("event_id", keyword_match_struct(F.col("_t"), inc.label_keywords).alias("_mi"),
                       keyword_match_struct(F.col("_t"), sec.label_keywords).alias("_ms"))
        df = df.select("event_id",
                       classify_from_matches(F.col("_mi"), inc.label_keywords, inc.min_confidence).alias("_i"),
                       classify_from_matches(F.col("_ms"), sec.label_keywords, sec.min_confidence).alias("_s"))
    else:
        df = df.select(
            "event_id",
            keyword_classify(F.col("_t"), inc.label_keywords, inc.min_confidence).alias("_i"),
            keyword_classify(F.col("_t"), sec.label_keywords, sec.min_confidence).alias("_s"),
        )
    df = _model_first(_model_first(df, incident_predictions, "_i"), sector_predictions, "_s")
    if clusters is not None:
        df = df.join(clusters.select("event_id", "cluster_id", "cluster_confidence"), "event_id", "left")
        cid = F.col("cluster_id").cast("int")
        cconf = F.coalesce(F.col("cluster_confidence"), F.lit(0.0)).cast("double")
    else:
        cid = F.lit(None).cast("int")
        cconf = F.lit(0.0)
    return df.select(
        "event_id",
        F.col("_i.label").alias("incident_type"),
        F.col("_i.confidence").alias("incident_confidence"),
        F.col("_s.label").alias("sector"),
        F.col("_s.confidence").alias("sector_confidence"),
        cid.alias("cluster_id"),
        cconf.alias("cluster_confidence"),
        F.create_map(F.lit("incident"), F.col("_i.explanation"),
                     F.lit("sector"), F.col("_s.explanation")).alias("explanations"),
    )

