"""Terms are counted where the texts are, not in a written table; they are those of the built-in expressions."""

import math

from pyspark.sql import functions as F

from test_text_passes import table
from vigil.operators import clusters, features


def test_terms_in_tasks_are_those_of_the_expressions(spark):
    d = table(spark)
    for kw in ({"ngram_max": 1, "stop_words": ()}, {}, {"stop_words": ["the", "x1"]}):
        rows = d.select("id", features.terms(F.col("t"), **kw).alias("t"), F.lower("t").alias("low")).collect()
        assert all((r.t or []) == features.text_terms(r.low, **kw) for r in rows)
        long = d.select("id", F.explode(features.terms(F.col("t"), **kw)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        want = {(r.term, r.cf, r.df) for r in features.vocabulary(long, 0, max_df=float("inf")).collect()}
        assert {(r.term, r.cf, r.df) for r in features.corpus_terms(d, "t", **kw).collect()} == want and len(want) > 20


def test_vectors_without_a_table_of_terms(spark, monkeypatch):
    written, write = [], clusters.materialize
    monkeypatch.setattr(features, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    d = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None), (4, "blue")], "id long, t string")
    got = {r.id: (r["at"], r.w) for r in clusters.text_vectors(d, "id", "t", 2, ngram_max=1, stop_words=()).collect()}
    blue, red = math.log(5 / 4) + 1, 2 * (math.log(5 / 2) + 1)
    size = math.hypot(blue, red)
    assert got[3] == ([], []) and got[2] == got[4] == ([0], [1.0]) and not written
    assert got[1][0] == [0, 1] and all(math.isclose(a, b) for a, b in zip(got[1][1], [blue / size, red / size]))
