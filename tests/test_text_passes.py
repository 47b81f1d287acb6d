"""Texts go to tasks as texts, not as lists of their words; what is found there is what the built-in expressions find."""

import random

from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.operators import preprocess
from vigil.params import LANGUAGE_PROFILES, TOKEN_PATTERN

PIECES = ["the", "der", "les", "DE", "el", "y", "½", "²", "7", "٣", "_", "Été", "İ", "a", "bé", "水", "x1", "-", ".", " ", "  ", "\n", "\t", " ", "　", "\x00", " ", "\U0001d7d8", "\U0001f600", "́"]


def table(spark, n=400):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.randrange(0, 30)))) for i in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "id long, t string")


def test_profile_hits_are_those_of_the_expressions(spark):
    profiles = [*LANGUAGE_PROFILES, ("x-y", ["de", "de", "été", "水"])]
    d = table(spark).select(T.language_count_struct(F.col("t"), profiles).alias("a"), T.profile_counts(F.col("t"), profiles).alias("b"))
    got = d.collect()
    assert all([*r.a] == [*r.b] if r.a else not r.b or set(r.b) == {None} for r in got) and any(max(filter(None, r.b), default=0) > 1 for r in got if r.a)
    assert d.select("b").schema["b"].dataType.names == [lang for lang, _ in profiles]


def test_normalize_makes_no_list_of_words_to_find_the_language(spark):
    raw = spark.createDataFrame([("e", "s", "u", "The end of the road and of the day")], "event_id string, source string, source_url string, raw_text string")
    out = preprocess.normalize(raw)
    assert (out.first().language, out.first().language_confidence) == ("en", 1.0)
    assert r"\p{L}+" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_and_tokens_as_before(spark):
    d = table(spark)
    old = F.btrim(F.regexp_replace(F.replace(F.col("t"), F.lit("\x00"), F.lit(" ")), rf"{T.WS}+", " "), F.lit(" "))
    got = d.select(old.alias("a"), T.normalize_whitespace(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    for least in (0, 1, 2, 4):
        tokens = F.filter(F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), 0), lambda x: F.length(x) >= least)
        assert all(r.a == r.b for r in d.select(tokens.alias("a"), T.tokenize(F.col("t"), least).alias("b")).collect())
