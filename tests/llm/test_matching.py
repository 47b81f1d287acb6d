"""Near duplicates, nearest neighbours, toxicity and the WARC audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.session import materialize
from vigil.llm import ann, near_dedup, toxicity, warc
from vigil.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)})


def components_brute(rows, percent=85):
    """(doc_id, set size, smallest doc_id reachable) over all pairs of distinct sets."""
    sets, by_set = {}, defaultdict(list)
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for d, t in rows:
        parent[d] = d
        sets[d] = shingles(t)
        if sets[d]:
            by_set[sets[d]].append(d)
    for same in by_set.values():
        for d in same:
            join(same[0], d)
    distinct = sorted(by_set, key=len)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            n = len(a & b)
            if 100 * n >= percent * (len(a) + len(b) - n):
                join(by_set[a][0], by_set[b][0])
    return sorted((d, len(sets[d]), root(d)) for d in parent)


def near_copies(seed=5):
    """Families of edited copies around the threshold, chains, exact copies in other white space and case, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [None, "", "a b", "A  b", "a b c d e", "x"]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(w))
        texts += [" ".join(base).upper(), " ".join(base) + " " + word()]
        chain = list(base)
        for _ in range(5):
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("block", "window", "chunk"), [(near_dedup.BLOCK, near_dedup.WINDOW, near_dedup.CHUNK), (3, 2, 7), (4, 1, 5)])
def test_near_duplicates(llm_spark, monkeypatch, block, window, chunk):
    """Block 3 splits nearly every region, so that the second phase has to find what the first parted."""
    for name, value in (("BLOCK", block), ("WINDOW", window), ("CHUNK", chunk)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = near_copies()
    df = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("node", "sig", "tree", "size", "s1")})
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in got if r.kept)


def test_near_duplicates_large_group(llm_spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = []
    for k in range(700):
        w = list(base)
        w[rng.randrange(300)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_null_and_repeated_ids(llm_spark):
    rows = [(None, "p q r s t u v"), (5, "p q r s t u v"), (5, "other words stand in this one here"), (9, "OTHER words stand in this one here"), (7, "p q r s t u v"), (8, None)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, 3, None, True), (5, 3, 5, True), (9, 3, 5, False), (7, 3, 5, False), (8, 0, 8, True)}
    assert sorted((r.doc_id or -1) for r in near_dedup.near_dedup(df).collect()) == [-1, 5, 8]


def test_components_of_a_long_chain_and_a_star(llm_spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.component for r in components(llm_spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}, 5000: 5000, 5001: 5000}


def nearest_brute(rows, k=20):
    usable = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8
              and np.isfinite(np.array(v, np.float64)).all() and np.any(v)]
    out = {}
    for i in {i for i, _ in usable if i % 20 == 0}:
        q = min((v.tolist() for j, v in usable if j == i))
        best = {}
        for j, v in usable:
            if j != i:
                best[j] = max(best.get(j, -np.inf), float(np.dot(q, v)))
        out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def test_nearest_neighbours_cases(llm_spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(8).round(2).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(100)]  # many equal vectors: ties by id
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0] * 7 + [float("nan")]), (403, [1.0] * 7 + [None]), (404, [1.0] * 7 + [float("inf")]), (405, [1.0]),
             (None, [1.0] * 8), (7, rows[7][1]), (420, [50.0] + [0.0] * 7)]
    df = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("v", "ids", "entry", "nth", "label")})
    got = ann.nearest(df).toPandas()
    want = nearest_brute(rows)
    assert set(got.query_id) == set(want)
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and g.vec_id.tolist() == [j for _, j in want[q]]
        assert np.allclose(g.score, [-s for s, _ in want[q]], rtol=0, atol=1e-9)


@pytest.mark.parametrize("sample", [8192, 30])
def test_nearest_neighbours_of_ids_with_many_vectors(llm_spark, monkeypatch, sample):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(8).round(3).tolist()) for k in range(1, 200)]
    near = np.array(rows[39][1], np.float64)  # of query 40
    rows += [(1001, (near * (2 + j / 7) + rng.standard_normal(8) / 20).tolist()) for j in range(60)]  # one id crowds the place around it
    rows += [(40, (near * (1 + j / 9)).tolist()) for j in range(1, 50)] + [(1001, rows[39][1]), (7, rows[210][1])]  # and the query's own
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got = ann.nearest(llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).toPandas()
    want = nearest_brute(rows)
    assert set(got.query_id) == set(want) == set(range(20, 200, 20))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g.vec_id.tolist() == [j for _, j in want[q]]
        assert np.allclose(g.score, [-x for x, _ in want[q]], rtol=0, atol=1e-9)


def clustered(n, dim=32, seed=5):
    """Unit-like vectors around 400 centres, of one size."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((400, dim))
    x = centres[rng.integers(0, 400, n)] + 0.35 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("kind", ["sf0.01", "clustered"])
def test_nearest_neighbours_recall(llm_spark, kind, tmp_path):
    if kind == "clustered":  # 20,000 vectors, of which a query meets a part
        import pyarrow as pa
        import pyarrow.parquet as pq

        x = clustered(20_000)
        pq.write_table(pa.table({"vec_id": np.arange(len(x)) * 4, "embedding": list(x)}), f"{tmp_path}/embeddings.parquet")
        df = llm_spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    else:
        df = llm_spark.read.parquet(f"/root/testdata/{kind}/embeddings.parquet")
    t = df.toPandas()
    x, ids = np.array(t.embedding.tolist(), np.float64), t.vec_id.to_numpy()
    got = ann.nearest(df, n_leaves=ann.LEAVES // 4 if kind == "clustered" else ann.LEAVES).toPandas()
    at = {i: k for k, i in enumerate(ids)}
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        assert len(g) == 20 and g.vec_id.is_unique and q not in set(g.vec_id)
        hits, total = hits + len(best & set(g.vec_id)), total + 20
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.9


def test_nearest_neighbours_queue_meets_a_part_of_the_vectors():
    x = clustered(20_000)
    f = ann.Forest(x[:ann.SAMPLE_ROWS], 1.0)
    leaf, mask = f.leaves(x), f.visits(x[:100], ann.LEAVES // 4)
    met = np.zeros((100, len(x)), bool)
    for t in range(ann.N_TREES):
        met |= mask[:, t * 2 ** f.depth + leaf[:, t]]
    assert met.mean() < 0.25


def test_nearest_neighbours_few_and_none(llm_spark):
    few = llm_spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 4.0), (0, 2, 2, -1.0)]
    assert ann.nearest(few.filter("vec_id < 0")).count() == 0


def test_toxicity_held_out(llm_spark):
    d = "/root/testdata/sf0.1"
    docs, labels = llm_spark.read.parquet(f"{d}/documents.parquet"), llm_spark.read.parquet(f"{d}/labels.parquet")
    r = toxicity.toxicity_scores(docs, labels).toPandas()
    assert len(r) == docs.count() and r.score.between(0, 1).all()
    assert (r.predicted == (r.score >= 0.7)).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in r.doc_id]).all()
    m = r[r.held_out].merge(labels.toPandas(), on="doc_id")
    toxic = m.toxic == 1
    assert m.predicted[toxic].mean() >= 0.8 and m.predicted[~toxic].mean() <= 0.01
    rank = m.score.rank()
    assert (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.95


def test_toxicity_reads_no_held_out_label(llm_spark, docs):
    rows = [(r.doc_id, 1, int(r.doc_id % 14 == 0)) for r in docs.select("doc_id").collect()]
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in rows]
    a, b = (toxicity.fit(docs, llm_spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (rows, flip))
    assert a == b


def test_toxicity_cases(llm_spark, clashing, no_docs):
    labels = llm_spark.createDataFrame([(0, 1), (1, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    s = toxicity.toxicity_scores(clashing, labels).collect()  # no clean label: the default voters
    assert len(s) == clashing.count() and all(0 <= r.score <= 1 for r in s)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    odd = llm_spark.createDataFrame([(None, "you are an idiot and scum, moron"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    got = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert [r.predicted for r in got if r.doc_id is None] == [1] and len({r.score for r in got if r.doc_id is not None}) == 1
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns


def test_toxicity_fits_on_one_row_of_a_doc_id(llm_spark, docs, monkeypatch):
    labels = llm_spark.createDataFrame([(r.doc_id, int(r.doc_id % 14 == 0)) for r in docs.select("doc_id").collect()], "doc_id long, toxic int")
    hot = min(r.doc_id for r in labels.filter("toxic = 1").filter(~toxicity.held_out(F.col("doc_id"))).collect())
    copies = docs.crossJoin(llm_spark.range(500)).filter((F.col("doc_id") == hot) | (F.col("id") == 0)).drop("id")
    assert toxicity.fit(copies, labels) == toxicity.fit(docs, labels)
    seen = []
    monkeypatch.setattr(toxicity, "label_model", lambda votes, given, f=toxicity.label_model: seen.append(len(votes)) or f(votes, given))
    other = copies.withColumn("text", F.when(F.col("doc_id") == hot, F.concat(F.lit("x"), F.monotonically_increasing_id())).otherwise(F.col("text")))
    once = materialize(other, "copies")
    a, b = (toxicity.fit(x, labels) for x in (once, once.repartition(4)))
    assert a == b and seen == [labels.filter(~toxicity.held_out(F.col("doc_id"))).count()] * 2


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.2
    good = [(rng.random(3000) < np.where(y, 0.5, 0.01)) for _ in range(5)]
    copies = [good[0]] * 20  # correlated voters must not outvote
    bad = [rng.random(3000) < 0.1 for _ in range(5)]
    given = np.where(rng.random(3000) < 0.03, ~y, y).astype(int)
    q = toxicity.label_model(np.column_stack([*good, *copies, *bad]).astype(float), given)
    assert ((q > 0.5) == y).mean() >= (given == y).mean() - 0.02


def test_warc_audit(llm_spark):
    rng = random.Random(8)
    rows = [(k, f"http://x/{k}", "<p>" + "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" * rng.randint(0, 9)) for k in range(300)]
    rows += [(None, None, None), (5, "http://x/5", rows[5][2]), (300, "", ""), (301, "u\r\nv", "z" * 100_000)]
    pages = llm_spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit(1) for c in ("h", "nth", "record", "file", "hash")})
    got = warc.audit_pages(pages).collect()

    def rec(i, url, html):
        body = (html or "").encode()
        return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {re.sub('[\r\n]', '', url or '')}"
                f"\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    want = [(i if i is not None else -1, len(rec(i, u, h)), hashlib.sha256(rec(i, u, h)).hexdigest(),
             hashlib.md5(str("" if i is None else i).encode()).hexdigest()[0] == "0") for i, u, h in rows]
    assert sorted((r.page_id if r.page_id is not None else -1, r.record_bytes, r.record_sha256, r.corrupt) for r in got) == sorted(want)
    assert any(w[3] for w in want)


def test_warc_equal_replicas_and_damage(llm_spark, tmp_path):
    pages = llm_spark.createDataFrame([(k, "u", hashlib.sha256(str(k).encode()).hexdigest() * k) for k in range(400)], "page_id long, url string, html string")
    a = f"file://{tmp_path}/a"
    warc.write_warc(pages, a, file_bytes=9000)
    assert warc.audit(llm_spark, a, a).filter("corrupt").count() == 0
    files = [bytes(r.content) for r in warc._files(llm_spark, a).collect()]
    assert len(files) > 5 and any(max(at for at, _ in warc.members(f)) > 5000 for f in files)
    # a file without a readable name, a record with a broken header, one with a wrong length, a missing file
    no_name = bytearray(files[0])
    no_name[30] ^= 255
    broken, wrong = bytearray(files[1]), bytearray(files[2])
    second, third = [list(warc.members(f))[1][0] for f in files[1:3]]
    broken[second] ^= 255
    wrong[third + 16] ^= 7
    bad = [bytes(x) for x in (no_name, broken, wrong)] + files[4:]
    warc._write_files(llm_spark.createDataFrame([(bytearray(x[:-1]),) for x in bad], "file binary"), f"file://{tmp_path}/b")
    rows = warc.audit(llm_spark, a, f"file://{tmp_path}/b").filter("corrupt").collect()
    got = {(r.file, r.offset) for r in rows}
    want = {(warc.file_name(f), at) for f in (files[0], files[3]) for at, _ in warc.members(f)}
    want |= {(warc.file_name(files[1]), second), (warc.file_name(files[2]), third)}
    assert got == want


def test_warc_damage_in_the_primary_and_records_of_one_replica(llm_spark, tmp_path):
    pages = llm_spark.createDataFrame([(k, "u", hashlib.sha256(str(k).encode()).hexdigest() * k) for k in range(400)], "page_id long, url string, html string")
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    warc.write_warc(pages, a, file_bytes=9000)
    files = sorted((bytes(r.content)[:-1] for r in warc._files(llm_spark, a).collect()), key=lambda x: warc.file_name(x + b"\n"))
    at = [dict(warc.members(f + b"\n")) for f in files]
    name = [warc.file_name(f + b"\n") for f in files]

    def ids(k):
        return {int(warc._ID.search(warc.content(files[k][o:o + n]))[1]) for o, n in at[k].items() if o}

    # in the primary: a damaged name, a damaged first header, a hidden record, a missing file, and damaged names in both
    ours, theirs = [bytearray(f) for f in files], [bytearray(f) for f in files]
    ours[0][30] ^= 255
    ours[1][0] ^= 255
    hidden = list(at[2])[1]
    ours[2][hidden] ^= 255
    ours[4][30] ^= 255
    theirs[4][31] ^= 255
    del theirs[5:7], ours[3]
    for path, x in ((b, ours), (c, theirs)):
        warc._write_files(llm_spark.createDataFrame([(f,) for f in x], "file binary"), path)
    rows = warc.audit(llm_spark, b, c).collect()
    bad = [r for r in rows if r.corrupt]
    assert len(rows) == len({(r.file, r.offset) for r in rows}) == sum(map(len, at))
    assert {r.page_id for r in rows if r.offset} == set(range(400))
    want = {(name[k], o) for k in (0, 1, 3, 5, 6) for o in at[k]} | {(name[2], hidden)}
    unnamed = [r for r in bad if r.file not in name]
    assert {(r.file, r.offset) for r in bad if r.file in name} == want
    assert len({r.file for r in unnamed}) == 1 and {r.offset for r in unnamed} == set(at[4]) and {r.page_id for r in unnamed if r.offset} == ids(4)
    # the other way round, and against nothing
    assert {(r.file, r.offset) for r in warc.audit(llm_spark, c, b).filter("corrupt").collect() if r.file in name} == want


def test_empty_tables(llm_spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.near_dedup(no_docs).count() == 0
    assert warc.audit_pages(llm_spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unlike_texts_that_share_a_long_passage(llm_spark):
    """5,000 texts with 90 words in common, some of them with a near copy: stretches are far wider than the window, and no link is lost."""
    rng = random.Random(12)
    shared = " ".join(f"common{k}" for k in range(90))
    rows, want = [], {}
    for k in range(5000):
        own = [f"own{k}x{j}" for j in range(20)]
        rows.append((2 * k, f"{shared} {' '.join(own)}"))
        want[2 * k] = 2 * k
        if k % 25 == 0:  # one word at the end is another: 105 of 107 shingles
            rows.append((2 * k + 1, f"{shared} {' '.join([*own[:-1], 'other'])}"))
            want[2 * k + 1] = 2 * k
    rng.shuffle(rows)
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
