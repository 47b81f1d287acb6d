import math
import os
import random
import subprocess
import sys
import tempfile
from collections import Counter

import pytest

from vigil.operators import features as FE


@pytest.mark.parametrize("rows", [7, 2048])
def test_weights_of_texts_without_a_table_of_postings(spark, monkeypatch, rows):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["the", "é", "É", "x" * 300, "一二"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for k in range(90)] + [(3, "w1 w1 again"), (None, "w2 w3"), (None, "w2 null"), (900, None), (901, "")]
    docs = spark.createDataFrame(texts, "id long, t string").repartition(3)
    monkeypatch.setattr(FE, "PART_ROWS", rows)
    monkeypatch.setattr(FE, "materialize", lambda *a: pytest.fail("a table was written"))
    counts = [(d, Counter(FE.text_terms(t.lower() if t else t, stop_words=frozenset(FE.CLUSTER_STOP_WORDS)))) for d, t in texts]
    df = Counter(x for _, c in counts for x in c)
    want = [(d, x, n * (math.log((1 + len(texts)) / (1 + df[x])) + 1)) for d, c in counts for x, n in c.items()]
    norm = Counter()
    for d, _, w in want:
        norm[d] += w * w
    plain, unit = (FE.text_weights(docs, "id", "t", unit=u) for u in (False, True))
    shown = lambda rs: Counter((d, x, round(w, 9)) for d, x, w in rs)
    assert shown(plain.collect()) == shown(want) and shown(unit.collect()) == shown((d, x, w / math.sqrt(norm[d])) for d, x, w in want)
    plan = unit._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(doc" not in plan  # no posting is sent
    assert FE.text_weights(docs.limit(0), "id", "t").count() == 0 and FE.text_weights(docs.filter("id >= 900"), "id", "t", unit=True).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    code = """
import glob, os, sys, time
from vigil.session import *
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "4").getOrCreate()
t = materialize(s.range(200000).repartition(3, "id").groupBy("id").count(), "t")
left = lambda: [f for f in glob.glob(sys.argv[1] + "/**/shuffle_*.data", recursive=True)]
end = time.time() + 20
while left() and time.time() < end:
    time.sleep(0.2)
print("left", len(left()))
assert t.count() == 200000 and s.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
print("whole")
"""
    done = subprocess.run([sys.executable, "-c", code, tempfile.mkdtemp()], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False)
    assert "left 0\nwhole" in done.stdout, done.stderr[-2000:]


def test_the_models_predictions_are_written_before_the_stages(spark, monkeypatch):
    from vigil.plans import q_features, views
    from vigil.session import materialize

    written = []
    for module in (q_features, views):
        monkeypatch.setattr(module, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    views.forget()
    assert q_features.cls_analyze_model(spark, "/root/testdata/sf0.001").count() > 0
    assert written.index("predictions") < written.index("norm")  # so their shuffles are gone by then
