import math
import random

from vigil.operators import density as DE


def test_parts_and_tiles_find_what_brute_force_finds(spark, monkeypatch):
    for name, size in (("BLOCK", 30), ("SMALL", 8), ("TILE", 8)):
        monkeypatch.setattr(DE, name, size)
    rng = random.Random(3)
    kinds = [[rng.randrange(30) for _ in range(5)] for _ in range(6)]
    rows = {}
    for k in range(110):
        at = sorted(set(rng.sample(range(30), 3) + (rng.choice(kinds) if k % 3 else [])))
        w = [rng.random() + 0.1 for _ in at]
        rows[k] = dict(zip(at, (x / math.sqrt(sum(y * y for y in w)) for x in w), strict=True))
    rows |= {200 + k: rows[k % 2] for k in range(4)} | {300: {}, 301: {7: 1.0}, 302: {8: 0.5, 9: math.sqrt(0.75)}, 303: {8: 1.0}}  # 302 and 303: at the limit
    eps, least = 0.3, 3
    near = {a: [b for b in rows if a == b or round(1 - sum(w * rows[b].get(f, 0) for f, w in rows[a].items()), DE.DIGITS) <= eps] for a in rows if rows[a]}
    core = sorted(a for a in near if len(near[a]) >= least)
    comp = {}
    for a in core:
        todo = [a] if a not in comp else []
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = a
                todo += [b for b in near[x] if b in core]
    number = {c: i for i, c in enumerate(sorted(set(comp.values())))}
    want = {a: number[comp[a]] if a in comp else min((number[comp[b]] for b in near.get(a, []) if b in comp), default=None) for a in rows}
    vectors = spark.createDataFrame([(k, list(v), list(v.values())) for k, v in rows.items()], "id long, at array<int>, w array<double>").repartition(3)
    sent = DE._blocks(vectors.selectExpr("id AS cid", "1L AS m", "false AS core", "at", "w"), 4)
    assert sent.count() == 4 * len(rows)  # once per part, not once per feature and part
    got = {r.id: r.cluster_id for r in DE.density_clusters(vectors, eps, least).collect()}
    assert got == want and len(set(want.values())) > 2 and any(a not in comp and want[a] is not None for a in rows)
