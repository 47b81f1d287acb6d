"""Texts are looked at as rarely as possible."""

import random

from pyspark.sql import functions as F

from vigil.functions import ioc as I
from vigil.functions import keywords as K
from vigil.functions import text as T


def test_text_is_lowered_once_for_all_keywords(spark):
    d = spark.createDataFrame([("Ab cD",), (None,), ("",)], "t string")
    found = d.select(K.found_keywords(F.lower("t"), ["b c", "ab", "zz"]).alias("f"))
    assert [r.f for r in found.collect()] == [["ab", "b c"], [], []]
    assert "contains(lower(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_indicators_with_and_without_the_first_look(spark):
    rng = random.Random(5)
    pieces = ["1.2.3.4", "٣.2.3.4", "1.2.3.٤", "a@b.co", "a@b", "http://x.y/z", "https:/x", "www.x.com", "x.c", "end. Next", "é1.1.1.1", "f" * 32, "A" * 40, "0" * 64, "g" * 32, " ", "-", ".", "\n", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(400)] + [None, ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in I.IOC_TYPES:
        got = d.select(I.extract_type(F.col("t"), kind).alias("a"), I.matches(F.col("t"), kind).alias("b")).collect()
        assert all(r.a == r.b for r in got) and any(r.a for r in got)


def test_profiles_share_one_scan(spark):
    profiles = [("a", ["the", "der", "l"]), ("b", ["the", "les", "é"]), ("c", ["l'eau", "eau"])]
    d = spark.createDataFrame([("The der DER les. thé é l l'eau the",), ("",), (None,)], "t string")
    got = [tuple(r.c) if r.c else r.c for r in d.select(T.language_count_struct(F.col("t"), profiles).alias("c")).collect()]
    assert got == [(6, 4, 1), (0, 0, 0), (None, None, None)]
    plan = d.select(T.language_count_struct(F.col("t"), profiles[:2]).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
