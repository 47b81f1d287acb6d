"""Preprocessing: raw events -> normalized events (one narrow stage, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.params import PreprocessParams


def with_clean_text(raw: DataFrame, params: PreprocessParams = PreprocessParams(),
                    text_col: str = "raw_text") -> DataFrame:
    """Adds ``clean_text``, computed exactly once per row.

    The value is produced by a generator (``explode`` of a one-element
    array): filters on it cannot be pushed below the generator, so Catalyst
    never inlines the regex chain a second time into a pushed-down filter.
    """
    cols = [F.col(c) for c in raw.columns]
    return raw.select(*cols, F.explode(F.array(T.clean_text(F.col(text_col), params.noise_patterns))).alias("clean_text"))


def normalize(raw: DataFrame, params: PreprocessParams = PreprocessParams()) -> DataFrame:
    """clean -> min length -> language -> language filter -> tokens.

    The length filter sits below the language detector so short texts never
    reach it; no shuffle.
    """
    df = with_clean_text(raw, params)
    df = df.filter(F.length("clean_text") >= params.min_text_length)
    # counts first (in Arrow batches), then the pick, in separate projections
    df = df.withColumn("_cnt", T.profile_counts(F.col("clean_text"), params.language_profiles))
    df = df.withColumn("_lang", T.language_from_counts(F.col("_cnt"), params.language_profiles))
    if params.allowed_languages:
        df = df.filter(F.col("_lang.language").isin(*params.allowed_languages))
    cols = [c for c in ("event_id", "source", "source_url", "fetched_at") if c in df.columns]
    out = df.select(
        *cols,
        F.col("_lang.language").alias("language"),
        F.col("_lang.confidence").alias("language_confidence"),
        "clean_text",
        T.tokenize(F.col("clean_text"), params.min_token_length).alias("tokens"),
        *(c for c in ("raw_metadata", "content_hash") if c in df.columns),
    )
    return out
