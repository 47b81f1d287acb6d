"""Star contraction, overlap links, per-key joins, text features, clusters, stream state, pages, the keyed store, suffix rules and keywords at scale."""

import html
import math
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigil import session
from vigil.functions import keywords as K
from vigil.functions.ioc import normalize_domain
from vigil.functions.text import decode_references
from vigil.operators import clusters as CL
from vigil.operators import features as FE
from vigil.operators import pages as PG
from vigil.operators import serve as SV
from vigil.operators import store as ST
from vigil.operators import suffixes as SX
from vigil.operators.graph import component_ids, connected_components
from vigil.operators.overlap import overlap_links
from vigil.operators.skew import join_per_key
from vigil.streaming import dedup as SD


def union_find(edges, nodes):
    g = {n: n for n in nodes}

    def root(x):
        while g[x] != x:
            g[x] = g[g[x]]
            x = g[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            g[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# --- components -----------------------------------------------------------------------

def test_components_of_random_graphs_chains_and_hubs(spark):
    rng = random.Random(3)
    chain = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(1000)]
    hub = [(f"h{k}", "#hub") for k in range(2000)]
    nodes = [f"x{k}" for k in range(400)]
    loose = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(300)] + [("x1", "x1"), ("x2", "x3"), ("x3", "x2")]
    edges = chain + hub + loose
    rng.shuffle(edges)
    want = union_find(edges, [*nodes, *{x for e in edges for x in e}])
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges + [(None, "x1"), ("x1", None)], "src string, dst string"))
    assert {r.node: r.component for r in got.collect()} == want


def test_settled_components_leave_the_edge_table(spark, caplog):
    with caplog.at_level("INFO", "vigil.operators.graph"):
        stars = spark.range(3000).select((F.col("id") % 3).alias("a"), (F.col("id") + 10).alias("b"))
        roots = component_ids(stars)
        assert roots.count() == 3000 and roots.select("root").distinct().count() == 3
        assert [r.message for r in caplog.records] == ["components, round 0: 3000 edges, then 0"]
        caplog.clear()
        component_ids(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    rounds = [tuple(map(int, (r.message.split()[3], r.message.split()[6]))) for r in caplog.records]
    assert len(rounds) <= 12 and all(after < before for before, after in rounds)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_overlap_links_equal_brute_force(spark, k):
    rng = random.Random(k)
    sets = {f"e{i}": set(rng.sample(range(rng.choice([12, 40])), rng.randint(0, 7))) for i in range(90)}
    sets |= {f"h{i}": {100, 101} | set(rng.sample(range(200, 260), 3)) for i in range(40)}  # two values that many hold
    sets |= {f"s{i}": {300, 301, 302} for i in range(30)} | {"t": {300, 301}}  # equal sets
    want = union_find([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= k], sets)
    index = spark.createDataFrame([(e, f"v{v}") for e in sets for v in sets[e]], "event_id string, value string")
    for block in (2, 5, 64):
        links = overlap_links(index, "event_id", "value", k, block)
        edges = links.select(F.col("member").alias("src"), F.concat(F.lit("~"), "hub").alias("dst"))
        got = {r.node: r.component for r in connected_components(spark.createDataFrame([(x,) for x in sets], "node string"), edges).collect()}
        assert {e: got[e] for e in sets} == want


def test_overlap_of_hot_values_sends_rows_in_proportion(spark):
    """4,000 events share two values: for k = 3 no pair of them is ever listed."""
    n = 4000
    index = spark.range(n).select(F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.explode(F.array(F.lit("hot1"), F.lit("hot2"), F.concat(F.lit("own"), F.floor(F.col("id") / 2)))).alias("value"))
    links = session.materialize(overlap_links(index, "event_id", "value", 3), "links")
    assert links.count() <= 3 * n
    c = connected_components(index.select(F.col("event_id").alias("node")).distinct(), links.select(F.col("member").alias("src"), F.col("hub").alias("dst")))
    sizes = c.filter("node LIKE 'e%'").groupBy("component").count()
    assert sizes.count() == n / 2 and sizes.filter("count != 2").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_per_key_copies_no_row(spark, how):
    df = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"))
    per_key = df.filter("k IS NOT NULL AND k != 'k3'").groupBy("k").agg(F.count(F.lit(1)).alias("n_events"), F.min("id").alias("low"))
    got = {tuple(r) for r in join_per_key(df, per_key, "k", "id", how, hot_rows=1000).select("k", "id", "n_events", "low").collect()}
    assert got == {tuple(r) for r in df.join(per_key, "k", how).select("k", "id", "n_events", "low").collect()}


# --- text features ----------------------------------------------------------------------

def test_no_side_that_grows_is_broadcast_for_term_weights(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common words"), F.concat(F.lit("own"), "id"), F.concat(F.lit("two"), F.floor(F.col("id") / 2))).alias("text"))
    rows = FE.term_rows(docs, "doc_id", "text")
    w = FE.term_weights(rows, FE.vocabulary(FE.term_counts(rows), 300), 300)
    coefs = spark.createDataFrame([("a", "common", 1.0), ("b", "words", 2.0)], "label string, term string, coef double")
    scores = FE.linear_scores(w, coefs, {"a": 0.0, "b": 0.1}, docs.select(F.col("doc_id").alias("doc")))
    assert scores.count() == 600
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    # what is hinted for a broadcast is the hot terms and the counted coefficients; the rest of the vocabulary is merged
    assert plan.count("strategy=broadcast") == 3 and "strategy=merge" in plan
    got = {(r.doc, r.label): r.score for r in scores.collect()}
    counts = [Counter(["common", "words", f"own{i}", f"two{i // 2}", "common words", f"words own{i}", f"own{i} two{i // 2}"]) for i in range(300)]
    df = Counter(t for c in counts for t in c)
    for i in (0, 7, 299):
        x = {t: n * (math.log(301 / (1 + df[t])) + 1) for t, n in counts[i].items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        assert got[(i, "a")] == pytest.approx(x["common"] / norm) and got[(i, "b")] == pytest.approx(0.1 + 2 * x["words"] / norm)


def test_hot_and_rare_terms_have_the_same_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 7 + 1)) + " w0") for k in range(60)] + [(60, ""), (61, None)], "id long, t string")
    rows = FE.term_rows(docs, "id", "t", ngram_max=1)
    vocab = FE.vocabulary(FE.term_counts(rows), 62)
    out = []
    for hot in (1, 3, 50_000):
        monkeypatch.setattr(FE, "HOT_TERMS", hot)
        out.append({(r.doc, r.term): round(r.weight, 9) for r in FE.tfidf(rows, vocab, 62).collect()})
    assert out[0] == out[1] == out[2] and len(out[0]) > 100
    assert {r.tf for r in FE.term_counts(rows).filter("doc = 0 AND term = 'w0'").collect()} == {2}


def test_kmeans_separates_kinds_of_text_and_repeats(spark):
    kinds = [["alpha", "beta", "gamma"], ["delta", "epsilon"], ["zeta", "eta", "theta"]]
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(kinds[k % 3], k=9))) for k in range(240)] + [(900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(5)
    a, b = (CL.kmeans_texts(d, "id", "t", 50, n_clusters=3, ngram_max=1, stop_words=()).collect() for d in (docs, docs.repartition(2)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 242
    label = {r.id: r.cluster_id for r in a}
    assert all(len({label[k] for k in range(i, 240, 3)}) == 1 for i in range(3)) and len({label[k] for k in range(3)}) == 3
    few = CL.kmeans_texts(docs.limit(2), "id", "t", 50).collect()
    assert [(r.cluster_id, r.cluster_confidence) for r in few] == [(None, 0.0)] * 2
    same = CL.kmeans_texts(spark.createDataFrame([(k, "one text") for k in range(9)], "id long, t string"), "id", "t", 50, n_clusters=4).collect()
    assert {(r.cluster_id, r.cluster_confidence) for r in same} == {(0, 1.0)}


# --- stream, pages, store -----------------------------------------------------------------

def test_stream_state_holds_hashes_and_places_only(spark, tmp_path):
    cols = "doc_id long, event_id string, source string, source_url string, raw_text string"
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("s").alias("source"), F.lit("u").alias("source_url"),
                                    F.repeat(F.concat(F.lit("long text "), F.col("id") % 1500), 200).alias("raw_text"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    SD.run_dedup_stream(spark, f"{tmp_path}/in", cols, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["doc_id"], files_per_batch=2)
    first = SD.first_events(spark, f"{tmp_path}/out", ["doc_id"])
    assert first.count() == 1500 and first.agg(F.max("doc_id")).first()[0] == 1499
    state = spark.read.format("statestore").load(f"{tmp_path}/ckpt")
    assert state.count() == 1500 and "raw_text" not in state.schema.simpleString()
    sizes = state.select((F.length("key.key") + F.length(F.col("value").getField("groupState").getField("at")) if "groupState" in state.schema["value"].dataType.names
                          else F.lit(0)).alias("n")).agg(F.max("n")).first()[0]
    files = sum(p.stat().st_size for p in Path(f"{tmp_path}/ckpt/state").rglob("*.delta"))
    assert sizes <= 40 and files / 1500 < 100  # bytes of a hash in the state's own files


def test_stream_takes_a_late_earlier_event(spark, tmp_path):
    cols = "ts timestamp, name string, source string, source_url string, raw_text string"
    row = lambda s, n, t: (s, n, "s", "u", t)
    make = lambda *rows: spark.createDataFrame(list(rows), "s long, name string, source string, source_url string, raw_text string").select(
        F.timestamp_seconds("s").alias("ts"), "name", "source", "source_url", "raw_text")
    args = (spark, f"{tmp_path}/in", cols, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["ts", "name"])
    make(row(50, "b", "x"), row(50, "a", "x"), row(-5, "z", "y")).write.parquet(f"{tmp_path}/in")
    SD.run_dedup_stream(*args)
    make(row(50, "A", "x"), row(7, "q", "y"), row(None, "n", "w"), row(1, "m", "w")).write.mode("append").parquet(f"{tmp_path}/in")
    SD.run_dedup_stream(*args)
    got = {r.raw_text: r.name for r in SD.first_events(spark, f"{tmp_path}/out", ["ts", "name"]).collect()}
    assert got == {"x": "A", "y": "z", "w": "n"}


def test_pages_read_few_files(spark, tmp_path):
    n, path = 20_000, f"{tmp_path}/listing"
    df = spark.range(n).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("event_id"), (F.xxhash64("id") % 50 / 50.0).alias("severity"),
                               F.when(F.col("id") % 100 == 0, "high").otherwise("low").alias("severity_label"), F.lit("x").alias("incident_type"), F.lit("y").alias("sector"))
    SV.write_event_pages(path, df, rows_a_file=1000)
    want = [r.event_id for r in df.orderBy(F.desc("severity"), "event_id").collect()]
    for offset in (0, 7, 990, 12_345, n - 30, n - 3, n, n + 50):
        page = SV.events(spark, path, limit=50, offset=offset)
        assert [r.event_id for r in page.collect()] == want[offset:offset + 50]
        assert len(page.inputFiles()) <= 2 or offset >= n
    high = [r.event_id for r in df.filter("severity_label = 'high'").orderBy(F.desc("severity"), "event_id").collect()]
    assert [r.event_id for r in SV.events(spark, path, severity="high", limit=20, offset=170).collect()] == high[170:190]
    assert SV.events(spark, path, severity="none").count() == 0 and SV.events(spark, path, sector="y", limit=3).count() == 3
    with pytest.raises(ValueError):
        SV.events(spark, path, limit=501)
    ids = spark.range(500).withColumnRenamed("id", "n").withColumn("id", F.format_string("%05d", "n"))
    SV.write_ioc_pages(f"{tmp_path}/iocs", ids, rows_a_file=100)
    assert [r.n for r in SV.ioc_page(spark, f"{tmp_path}/iocs", limit=10, offset=95).collect()] == list(range(404, 394, -1))
    empty = f"{tmp_path}/empty"
    PG.write_clustered(df.limit(0), SV.event_order(), empty, SV.EVENT_FILTERS)
    assert SV.events(spark, empty).count() == 0


def test_store_append_of_new_keys_reads_no_rows(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    batch = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.concat(F.lit("s"), "id").alias("s"), F.lit(v).alias("v"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    assert ST.append_ignore(path, batch(0, 3000, "first"), ["k", "s"], spark) == 3000
    looked_up = []
    real = ST._in_filters
    monkeypatch.setattr(ST, "_in_filters", lambda *a: looked_up.append(real(*a)) or looked_up[-1])
    assert ST.append_ignore(path, batch(10_000, 12_000, "second"), ["k", "s"], spark) == 2000
    assert looked_up[0].count() <= 10  # of 2,000 new keys, so at most as many buckets are read
    assert ST.append_ignore(path, batch(2500, 3500, "third"), ["k", "s"], spark) == 500
    assert 500 <= looked_up[1].count() <= 510 and set(map(tuple, looked_up[1].select("k").collect())) >= {(k,) for k in range(2500, 3000)}
    assert ST.append_ignore(path, batch(0, 3500, "again"), ["k", "s"], spark) == 0 and ST.append_ignore(path, batch(0, 0, "none"), ["k", "s"], spark) == 0
    t = spark.read.parquet(path)
    assert t.count() == 5500 and {tuple(r) for r in t.groupBy("v").count().collect()} == {("first", 3000), ("second", 2000), ("third", 500)}


def test_a_run_can_be_dropped_whole(spark):
    import subprocess
    import sys

    code = """
import os, tempfile
from vigil.session import *
s = build_session("local[2]", 2)
t = materialize(s.range(5), "t"); s.range(3).write.parquet(scratch(s, "f"))
root = run_folder(s)
local = root.removeprefix("file:")
assert sorted(os.listdir(local)) == ["files", "tables"], os.listdir(local)
drop_tables(s)
assert not os.path.exists(local)
print("dropped")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[1], check=False)
    assert "dropped" in done.stdout, done.stderr[-2000:]


# --- names, references, keywords ------------------------------------------------------------

def test_suffix_rules_from_a_table_of_any_length(spark, tmp_path):
    rules = ["com", "ug", "co.ug", "sg", "edu.sg", "*.ck", "!www.ck", "uk", "co.uk", "*.compute.example.com"]
    (tmp_path / "list.dat").write_text("// a comment\n\n" + "\n".join(f"{r} trailing" if r == "uk" else r for r in rules) + "\n" + "\n".join(f"x{k}.filler" for k in range(10_000)))
    names = ["foo.bar.co.ug", "x.y.edu.sg", "a.b.c.ck", "q.www.ck", "www.ck", "c.ck", "ck", "A.B.com", "edu.sg", "host.local", "com", "", "a..com", "x.compute.example.com", "y.x.compute.example.com",
             "deep." * 50 + "co.uk", "z.x77.filler", "filler"]
    df = spark.createDataFrame([(n,) for n in names] + [(names[0],)], "value string")
    table = SX.read_rules(spark, f"{tmp_path}/list.dat")
    got = {r.value: r.registrable for r in SX.registrable(df, table).collect()}
    want = {r.value: r.d for r in df.select("value", normalize_domain(F.col("value"), rules + ["x77.filler"]).alias("d")).distinct().collect()}
    assert got == want and got["y.x.compute.example.com"] == "y.x.compute.example.com" and got["z.x77.filler"] == "z.x77.filler"
    rows = df.withColumn("id", F.monotonically_increasing_id()).unionByName(spark.createDataFrame([(None, 99)], "value string, id long"))
    again = SX.with_registrable(rows, table, "value", "id").collect()
    assert len(again) == len(names) + 2 and all(r.registrable == want.get(r.value) for r in again)


def test_references_follow_the_rules_of_html_5(spark):
    rng = random.Random(1)
    names = rng.sample(sorted(html.entities.html5), 400)
    texts = [f"&{n}" for n in names] + [f"x &{n}y" for n in names[:150]] + [f"&{n.rstrip(';')}1;" for n in names[:150]]
    texts += ["&notit; &copyright &amp;amp &AMP &#65 &#x41g &#0; &#13; &#128; &#x8d; &#1; &#xFFFE; &#55555555555; &#00000000065; &#; &#x; & &; &&lt; &a&b; &ampamp;", "&" + "a" * 40 + ";",
              "&\u00e9; &CounterClockwiseContourIntegral;"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", decode_references(F.col("t")).alias("d")).collect()
    assert [(texts[r.k], r.d) for r in got if r.d != html.unescape(texts[r.k])] == []


@pytest.mark.parametrize("few", [0, 1000])
def test_overlapping_keywords_are_all_found(spark, few, monkeypatch):
    monkeypatch.setattr(K, "FEW", few)
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)] + ["a.b", "c(", "é", "data breach", "breach"]
    texts = ["".join(rng.choices("abc.( é", k=rng.randint(0, 40))) for _ in range(150)] + ["a Data Breach", "", None]
    maps = {"one": words[:30], "two": words[30:]}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.m for r in df.select("k", K.keyword_match_struct(F.col("t"), maps).alias("m")).collect()}
    for k, t in enumerate(texts):
        want = [] if t is None else [[w for w in ws if w in t.lower()] for ws in maps.values()]
        assert ([got[k].m0, got[k].m1] if t is not None else []) == want
    hits = {r.k: r.n for r in df.select("k", K.keyword_hits(F.col("t"), words).alias("n")).collect()}
    import re
    for k, t in enumerate(texts):
        low = (t or "").lower()
        alnum = {w for w in words if re.fullmatch("[a-z0-9]+", w) and re.search(rf"(?<!\w){w}(?!\w)", low)}
        assert hits[k] == len(alnum) + len({w for w in words if not re.fullmatch("[a-z0-9]+", w) and w in low})


def test_many_keywords_cost_little_more_than_few(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000))
    df = session.materialize(spark.range(60).select("id", F.concat(F.lit(text), "id").alias("t")).coalesce(1), "texts")
    words = ["".join(rng.choices("bcfgjkmpqvwxyz", k=8)) for _ in range(1000)]

    def seconds(n):
        began = time.time()
        df.select(K.keyword_match_struct(F.col("t"), {"a": words[:n // 2], "b": words[n // 2:n]})).write.format("noop").mode("overwrite").save()
        return time.time() - began

    monkeypatch.setattr(K, "FEW", 0)  # by one pattern, however few there are
    seconds(20), seconds(1000)
    assert min(seconds(1000) for _ in range(3)) < 2 * min(seconds(20) for _ in range(3)) + 0.5


def test_language_model_on_held_out_texts(spark):
    from vigil.operators import language as LG

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").repartition(8)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = LG.fit(d.filter(~held))
    found = LG.detect(d.filter(held), model, "doc_id").join(d.select("doc_id", "lang"), "doc_id")
    n, right = found.agg(F.count(F.lit(1)), F.sum((F.col("language") == F.col("lang")).cast("int"))).first()
    assert n > 2000 and right / n >= 0.98 and model.languages == ["de", "en", "es", "fr"]


def test_language_model_of_many_languages_and_odd_texts(spark):
    from vigil.operators import language as LG

    rows = [(k, chr(0x430 + k % 30) * 3 + " word", f"l{k % 30:02d}") for k in range(90)] + [(900, None, "xx"), (901, "text", None)]
    model = LG.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    odd = spark.createDataFrame([(0, chr(0x435) * 9), (1, None), (2, ""), (3, "12 34"), (4, "\u4e00\u4e00\u4e00"), (5, "a"), (6, "word")], "id long, text string")
    got = {r.id: (r.language, round(r.confidence, 3)) for r in LG.detect(odd, model, "id").collect()}
    assert len(model.languages) == 30 and got[0][0] == "l05" and got[0][1] > 0.9 and got[6][0] == "l00"
    assert all(got[k] == ("unknown", 0.0) for k in (1, 2, 3, 4, 5))
    assert LG.detect(odd, LG.fit(spark.createDataFrame([], "id long, text string, lang string")), "id").filter("language = 'unknown'").count() == 7


@pytest.mark.parametrize("block", [3, 512])
def test_density_clusters_equal_brute_force(spark, monkeypatch, block):
    from vigil.operators import density as DE

    monkeypatch.setattr(DE, "BLOCK", block)
    rng = random.Random(8)
    kinds = [[rng.randrange(40) for _ in range(6)] for _ in range(9)]
    rows = []
    for k in range(130):
        at = sorted(set(rng.sample(range(40), 4) + (rng.choice(kinds) if k % 3 else [])))
        w = [rng.random() + 0.1 for _ in at]
        rows.append((k, at, w))
    rows += [(200 + k, rows[k % 2][1], rows[k % 2][2]) for k in range(6)] + [(300, [], []), (301, [], []), (302, [39], [5.0])]
    unit = [(k, at, [x / math.sqrt(sum(y * y for y in w)) for x in w]) for k, at, w in rows]
    vectors = spark.createDataFrame(unit, "id long, at array<int>, w array<double>").repartition(4)
    for eps, least in ((0.35, 3), (0.2, 2), (0.6, 5), (0.35, 1)):
        dense = {k: dict(zip(at, w, strict=True)) for k, at, w in unit}
        near = {a: [b for b in dense if a == b or round(1 - sum(x * dense[b].get(f, 0) for f, x in dense[a].items()), DE.DIGITS) <= eps] for a in dense if dense[a]}
        core = {a for a in near if len(near[a]) >= least}
        comp = union_find([(a, b) for a in core for b in near[a] if b in core], core)
        number = {c: i for i, c in enumerate(sorted(set(comp.values())))}
        want = {a: number[comp[a]] if a in core else min((number[comp[b]] for b in near.get(a, []) if b in core), default=None) for a in dense}
        got = {r.id: r.cluster_id for r in DE.density_clusters(vectors, eps, least).collect()}
        assert got == want and len(set(want.values())) > 1
    assert DE.density_clusters(vectors.limit(0), 0.5, 3).count() == 0
