import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import density as DE


def brute(rows, eps, least):
    near = {a: [b for b in rows if a == b or round(1 - sum(w * rows[b].get(f, 0) for f, w in rows[a].items()), DE.DIGITS) <= eps] for a in rows if rows[a]}
    core, comp = sorted(a for a in near if len(near[a]) >= least), {}
    for a in core:
        todo = [a] if a not in comp else []
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = a
                todo += [b for b in near[x] if b in near and len(near[b]) >= least]
    number = {c: i for i, c in enumerate(sorted(set(comp.values())))}
    return {a: number[comp[a]] if a in comp else min((number[comp[b]] for b in near.get(a, []) if b in comp), default=None) for a in rows}


def unit(terms):
    size = math.sqrt(sum(w * w for w in terms.values()))
    return {f: w / size for f, w in sorted(terms.items())}


def table(spark, rows):
    return spark.createDataFrame([(k, list(v), list(v.values())) for k, v in rows.items()], "id long, at array<int>, w array<double>").repartition(3)


@pytest.mark.parametrize("pivots", [3, 40])
def test_few_pivots_find_what_brute_force_finds(spark, monkeypatch, pivots):
    for name, size in (("BLOCK", 25), ("SMALL", 6), ("TILE", 7), ("PIVOTS", pivots)):
        monkeypatch.setattr(DE, name, size)
    rng = random.Random(5)
    kinds = [[rng.randrange(30) for _ in range(6)] for _ in range(4)]
    rows = {k: unit({f: rng.random() + 0.1 for f in {*rng.sample(range(30), 3), *(kinds[k % 4] if k % 5 else [])}}) for k in range(140)}
    rows |= {200 + k: rows[k % 2] for k in range(4)} | {300: {}, 301: {31: 1.0}}
    for eps, least in ((0.3, 3), (0.15, 4)):
        want = brute(rows, eps, least)
        assert {r.id: r.cluster_id for r in DE.density_clusters(table(spark, rows), eps, least).collect()} == want and len(set(want.values())) > 2


def test_a_dense_corpus_is_settled_by_pivots(spark, monkeypatch):
    for name, size in (("BLOCK", 25), ("SMALL", 6), ("PIVOTS", 30)):
        monkeypatch.setattr(DE, name, size)
    rng = random.Random(6)
    rows = {k: unit({0: 3.0, 1: 3.0, rng.randrange(2, 40): rng.random(), rng.randrange(2, 40): 1.0}) for k in range(400)} | {900 + k: {50 + k: 1.0} for k in range(4)}
    classes = table(spark, rows).select(F.col("id").alias("cid"), F.md5(F.col("id").cast("string")).alias("key"), "id", F.lit(1).cast("long").alias("m"), "at", "w")
    met = DE._meet_pivots(classes, 0.5, 3).withColumn("open", ~F.col("known"))
    assert met.filter("known").count() == 400 and met.filter("known").select("grp").distinct().count() == 1
    sent = DE._open_blocks(met.select("cid", "m", "at", "w", "open"))
    assert sent.filter("NOT open").count() == 400  # once each, not once a part: they do not meet each other
