"""Language identification by character n-grams, learnt from a labelled table.

A text is lower-cased and its runs of other characters than letters become single blanks; its grams are all runs of three characters. The
model is one row per gram with the smoothed log probability in each language: one aggregate over the labelled texts. Texts are scored by one
join on the gram and one aggregate per text that combines before the shuffle. Any number of languages; a gram that no
labelled text holds says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.features import lookup_side
from vigil.session import materialize

GRAM = 3


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # in alphabetical order
    grams: DataFrame  # (gram, p0, p1, ...): log probability per language


def grams(text: Column) -> Column:
    """All runs of ``GRAM`` characters of the normalised text (one pass over its characters)."""
    t = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    chars = F.filter(F.split(t, ""), lambda x: x != "")
    return F.transform(F.array(chars), lambda c: F.when(F.size(c) >= GRAM, F.transform(
        F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<string>")))[0]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of the rows with a text and a language."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = materialize(rows.select(F.col(lang_col).alias("lang"), F.explode(grams(F.col(text_col))).alias("gram"))
                         .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "language_grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    known = counts.agg(F.count_distinct("gram")).first()[0]
    languages = sorted(totals)
    logs = [F.log((F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) + 1.0) / float(totals[lang] + known)).alias(f"p{k}") for k, lang in enumerate(languages)]
    table = counts.groupBy("gram").agg(*logs) if languages else counts.select("gram").limit(0)
    return LanguageModel(languages, materialize(table, "language_model"))


def detect(docs: DataFrame, model: LanguageModel, id_col: str, text_col: str = "text", max_rows: int = 500_000) -> DataFrame:
    """(id_col, language, confidence) per row; ("unknown", 0.0) for texts without a known gram. Ids are unique.

    The model goes to the texts if it has at most ``max_rows`` grams (about 50 MB), and meets their grams in a merge join otherwise.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    n = len(model.languages)
    if not n:
        return ids.select(F.col("id").alias(id_col), F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))
    each = docs.select(F.col(id_col).alias("id"), F.explode(grams(F.col(text_col))).alias("gram"))
    sums = each.join(lookup_side(model.grams, max_rows), "gram").groupBy("id").agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in range(n)])
    scores = F.array(*[F.round(f"s{k}", 6) for k in range(n)])
    names = F.array(*[F.lit(lang) for lang in model.languages])
    best = F.array_max("scores")
    share = 1.0 / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - best))
    picked = sums.select("id", scores.alias("scores")).select("id", F.element_at(names, F.array_position("scores", best).cast("int")).alias("language"), share.alias("confidence"))
    return ids.join(picked, "id", "left").select(F.col("id").alias(id_col), F.coalesce("language", F.lit("unknown")).alias("language"),
                                                 F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
