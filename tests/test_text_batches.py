"""Texts go to Arrow helpers in bounded batches, and these give what the plain forms give."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.functions import keywords as K
from vigil.operators import features
from vigil.session import arrow_rows

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_bounded_for_the_time_being(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    def sizes():
        return [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()]

    before = spark.conf.get(KEY)
    with arrow_rows(spark, 700):
        assert max(sizes()) == 700
    with pytest.raises(ValueError), arrow_rows(spark, 700):
        raise ValueError
    assert spark.conf.get(KEY) == before and max(sizes()) == min(5000, int(before))


def test_terms_are_counted_as_one_by_one(spark):
    rng = random.Random(7)
    words = ["a", "b", "é", "z\U0001f600", "￮", "ab", "B"]
    rows = [(i if i % 7 else None, rng.choices(words, k=rng.randrange(0, 9)) if i % 11 else None) for i in range(300)]
    table = pa.table({"doc": pa.array([r[0] for r in rows], pa.int64()), "t": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    got = [r for b in features._count_terms(table.slice(3).to_batches(max_chunksize=50)) for r in b.to_pylist()]
    want = [{"doc": d, "tfs": [{"term": t, "tf": n} for t, n in sorted(Counter(ts or []).items(), key=lambda x: x[0].encode())]} for d, ts in rows[3:]]
    assert got == want


def test_terms_of_no_more_rows_than_named_are_held_at_a_time(spark, monkeypatch):
    seen, write = [], features.materialize
    monkeypatch.setattr(features, "materialize", lambda df, name: (seen.append(int(spark.conf.get(KEY))), write(df, name))[1])
    rows = features.term_rows(spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "id long, t string"), "id", "t", ngram_max=1, stop_words=()).orderBy("doc")
    assert [(r.doc, [tuple(x) for x in r.tfs]) for r in rows.collect()] == [(1, []), (2, []), (3, [])] and seen == [features.COUNT_ROWS]


def test_keywords_are_found_in_batches(spark):
    rng = random.Random(9)
    words = ["phish", "data leak", "é", "ß", "İ", "c2", "", " "]
    texts = ["".join(rng.choices([*words, "x", "PHISH", "\x00"], k=rng.randrange(0, 6))) for _ in range(300)] + [None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.transform(F.array(F.lower("t")), lambda t: F.filter(F.array(*[F.lit(k) for k in sorted(filter(None, words))]), lambda k: F.contains(t, k)))[0]
    found = d.select(K.found_keywords(F.lower("t"), words).alias("a"), plain.alias("b"))
    got = found.collect()
    assert all(r.a == r.b for r in got) and any(len(r.a) > 2 for r in got)
    assert "contains(" not in d.select(K.mitre_tactics(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()
