"""Ranks and skewed joins at size, stream restarts, feed and page parsing, suffix rules, training input."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vigil.functions.html import inner_html
from vigil.functions.ioc import normalize_domain
from vigil.functions.keywords import merge_keywords
from vigil.functions.text import decode_references, detect_language, strip_html
from vigil.operators import classify, correlate
from vigil.operators import features as FE
from vigil.operators import store as ST
from vigil.operators import train as TR
from vigil.operators.graph import connected_components, global_rank
from vigil.operators.skew import join_per_key
from vigil.params import ClassifierParams
from vigil.sources import feeds as FD
from vigil.streaming import dedup as SD
from vigil.streaming import temporal as STT


def test_global_rank_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", (F.col("id") % 7).alias("label"), F.lit("x").alias("other"))
    r = global_rank(df.repartition(6), [F.asc("k"), F.asc("id")])
    a = r.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count(F.lit(1))).first()
    assert tuple(a) == (1, n, n, n)
    from pyspark.sql import Window
    late = r.withColumn("before", F.lag("k").over(Window.partitionBy((F.col("rank") / 1000).cast("long")).orderBy("rank"))).filter("before > k")
    assert late.count() == 0


def test_split_sizes_are_exact_on_many_rows(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit(1).alias("z"))
    got = {r.label: (r.n, r.t) for r in TR.stratified_split(df, "label", "id").groupBy("label")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {"a": (66667, 13334), "b": (133333, 26667)}


def test_component_numbers_name_one_component_each(spark):
    ev = spark.range(30_000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.lit("t").alias("clean_text"),
                                    F.timestamp_seconds(F.col("id") * 86400).alias("fetched_at"))
    iocs = spark.range(30_000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("source_event_id"),
                                      F.floor(F.col("id") / 2).cast("string").alias("normalized_value"))
    ana = ev.select("event_id", F.lit(None).cast("int").alias("cluster_id"), F.lit(0.0).alias("incident_confidence"), F.lit(0.0).alias("sector_confidence"))
    from vigil.params import CorrelationParams
    m = correlate.campaign_membership(ev, iocs, ana, CorrelationParams(use_analysis_clusters=False, use_temporal_window=False))
    a = m.groupBy("component_number").count().agg(F.count(F.lit(1)), F.min("count"), F.max("count"), F.max("component_number")).first()
    assert tuple(a) == (15_000, 2, 2, 15_000)


@pytest.mark.parametrize("hot", ["null", "one"])
def test_hot_and_null_keys_are_dealt_out(spark, hot):
    key = F.lit(None).cast("string") if hot == "null" else F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot")
    df = spark.range(20_000).select("id", key.alias("k"))
    per_key = df.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = join_per_key(df, per_key, "k", "id", rows="n", hot_rows=1000)
        rows = j.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 10_000
        assert j.filter("k = 'hot' AND n != 18000").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(f"n{k:04d}", f"n{k + 1:04d}") for k in range(n)], "src string, dst string")
    c = connected_components(spark.createDataFrame([("alone",)], "node string"), edges).collect()
    assert {r.component for r in c if r.node != "alone"} == {"n0000"} and len(c) == n + 2


def test_dedup_stream_goes_on_after_a_restart(spark, tmp_path):
    cols = "doc_id long, event_id string, source string, source_url string, raw_text string"
    row = lambda k, t: (k, f"e{k}", "s", "u", t)
    args = (spark, f"{tmp_path}/in", spark.createDataFrame([], cols).schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["doc_id"])
    spark.createDataFrame([row(5, "a"), row(6, "b"), row(7, "a")], cols).repartition(3).write.parquet(f"{tmp_path}/in")
    SD.run_dedup_stream(*args)
    spark.createDataFrame([row(8, "a"), row(9, "c"), row(2, "b")], cols).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    SD.run_dedup_stream(*args, files_per_batch=1)
    assert sorted(r.event_id for r in SD.first_events(spark, f"{tmp_path}/out", ["doc_id"]).collect()) == ["e2", "e5", "e9"]
    SD.run_dedup_stream(*args)
    assert SD.first_events(spark, f"{tmp_path}/out", ["doc_id"]).count() == 3


def test_window_stream_updates_and_drops_late_rows(spark, tmp_path):
    day = 86_400
    schema = "ts timestamp"
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "s long").select(F.timestamp_seconds("s").alias("ts"))
    args = (spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    rows(10, 20, day + 5).write.parquet(f"{tmp_path}/in")
    STT.run_window_stream(*args)
    rows(day + 9, 3 * day).write.mode("append").parquet(f"{tmp_path}/in")
    STT.run_window_stream(*args)
    rows(30, 3 * day + 1).write.mode("append").parquet(f"{tmp_path}/in")  # the first window is long closed
    STT.run_window_stream(*args)
    got = {r.temporal_cluster: r.n_events for r in STT.latest_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {"window_0": 2, f"window_{day}": 2, f"window_{3 * day}": 2}


def test_store_first_row_is_fixed_and_errors_are_raised(spark, tmp_path):
    batch = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "z", 0)], "k int, s string, v int")
    assert sorted(map(tuple, ST.first_per_key(batch, ["k"]).collect())) == [(1, "a", 9), (2, "z", 0)]
    path = f"{tmp_path}/t"
    assert ST.append_ignore(path, batch, ["k"], spark) == 2 and ST.append_ignore(path, batch, ["k"], spark) == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017 - anything but an empty table
        ST.append_ignore(f"{tmp_path}/broken", batch, ["k"], spark)
    from vigil.sources.stage import read_stage
    assert read_stage(spark, f"{tmp_path}/absent", "scores").count() == 0
    from vigil.session import read_if_exists
    with pytest.raises(AnalysisException):
        read_if_exists(lambda: spark.sql("SELECT no_such_column FROM range(1)"))


def feed(spark, xml):
    df = spark.createDataFrame([("f", xml)], "name string, value string")
    ev = FD.rss_events(df, F.col("name"), F.lit("feed://f"))
    return [(r.source_url, r.raw_text, r.raw_metadata) for r in ev.orderBy("pos").collect()]


def test_rss_with_encoded_content(spark):
    xml = ('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>'
           "<item><title>One</title><description>d1</description><content:encoded><![CDATA[<p>full</p>]]></content:encoded><link>http://a/1</link><pubDate>x</pubDate></item>"
           "<item><title>Two</title></item></channel></rss>")
    assert feed(spark, xml) == [("http://a/1", "One\nd1\n<p>full</p>", '{"published":"x"}'), ("feed://f", "Two", '{"published":""}')]


def test_atom_entries(spark):
    xml = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'
           '<entry><title type="text">First</title><summary>sum</summary><content type="html">body</content>'
           '<link rel="self" href="http://a/self"/><link href="http://a/1"/><updated>2024-01-01</updated></entry>'
           '<entry><title>Second</title><link rel="alternate" href="http://a/2"/><published>2024-01-02</published></entry></feed>')
    assert feed(spark, xml) == [("http://a/1", "First\nsum\nbody", '{"published":"2024-01-01"}'), ("http://a/2", "Second", '{"published":"2024-01-02"}')]


def test_item_limit_only_where_configured(spark):
    xml = "<rss><channel>" + "".join(f"<item><title>t{k}</title></item>" for k in range(120)) + "</channel></rss>"
    df = spark.createDataFrame([("f", xml)], "name string, value string")
    assert FD.rss_events(df, F.col("name"), F.lit("u")).count() == 120
    assert FD.rss_events(df, F.col("name"), F.lit("u"), max_items=7).count() == 7


@pytest.mark.parametrize(("selector", "want"), [
    ("div", ["a<div>b</div>c", "b", "<p class='k x'>d<br>e</p>"]),
    (".k", ["d<br>e"]), ("div p", ["d<br>e"]), ("p.k.x", ["d<br>e"]), ("div#two > p", None), ("#two", ["<p class='k x'>d<br>e</p>"]),
    ("[data-n]", ["f"]), ("span[data-n=7]", ["f"]), ("span[data-n=8]", []), ("p, span", ["d<br>e", "f"]),
])
def test_selectors(selector, want):
    html = "<body><div>a<div>b</div>c</div><div id=two><p class='k x'>d<br>e</p></div><span data-n='7'>f</span></body>"
    if want is None:
        with pytest.raises(ValueError):
            inner_html(html, selector)
    else:
        assert inner_html(html, selector) == want


def test_node_text_and_unclosed_elements(spark):
    df = spark.createDataFrame([("<div>a<div>b</div>c</div>",), ("<ul><li>x<li>y</ul>z",), (None,)], "h string")
    got = [" ".join((r.t or "").split()) for r in df.select(FD.node_text(F.col("h"), "div").alias("t")).collect()]
    assert got == ["a b c b", "", ""]
    assert inner_html("<ul><li>x<li>y</ul>z", "ul") == ["<li>x<li>y"]


def test_character_references(spark):
    text = "caf&eacute; it&#8217;s &uuml; &amp;lt; &#x41;&#X1F600; &#128; &#0; &#xD800; &nosuch; & &; &lt;b&gt; &apos;"
    got = spark.createDataFrame([(text, "<p>" + text)], "a string, b string").select(decode_references(F.col("a")).alias("a"), strip_html(F.col("b")).alias("b")).first()
    want = "café it’s ü &lt; A😀 € � � &nosuch; & &; <b> '"
    assert got.a == want and got.b == " " + want


def test_suffix_rules(spark):
    suffixes = ["ug", "co.ug", "sg", "edu.sg", "*.ck", "!www.ck", "com"]
    cases = {"foo.bar.co.ug": "bar.co.ug", "x.y.edu.sg": "y.edu.sg", "a.b.c.ck": "b.c.ck", "q.www.ck": "www.ck", "c.ck": "c.ck", "A.B.com": "b.com",
             "edu.sg": "edu.sg", "host.local": "host.local"}
    df = spark.createDataFrame(list(cases), "string").toDF("d")
    assert {r.d: r.n for r in df.select("d", normalize_domain(F.col("d"), suffixes).alias("n")).collect()} == cases


def test_language_profiles_are_an_input(spark):
    df = spark.createDataFrame([("il gatto e la casa",)], "t string")
    got = df.select(detect_language(F.col("t"), [("it", ["il", "la", "e"]), ("en", ["the"])]).alias("l")).first().l
    assert (got.language, got.confidence) == ("it", 1.0)


def test_merge_keywords():
    assert merge_keywords({"b": ["X", "y"], "a": ["q"]}, {"b": ["x", "Z", "Y"], "c": ["m", "M"]}) == {"a": ["q"], "b": ["X", "y", "Z"], "c": ["m"]}


def test_model_predictions_come_before_keywords(spark):
    norm = spark.createDataFrame([("e1", "ransom note"), ("e2", "ransom note")], "event_id string, clean_text string")
    p = ClassifierParams(label_keywords={"ransomware": ["ransom"]}, min_confidence=0.5)
    pred = spark.createDataFrame([("e2", "phishing", 0.9)], "event_id string, label string, confidence double")
    got = {r.event_id: (r.incident_type, r.incident_confidence) for r in classify.analyze(norm, p, p, incident_predictions=pred).collect()}
    assert got == {"e1": ("ransomware", 1.0), "e2": ("phishing", 0.9)}


def test_text_clusters_by_fixed_centres(spark):
    d = spark.createDataFrame([("a", "cat cat dog"), ("b", "fish"), ("c", "")], "event_id string, t string")
    got = {r.event_id: r for r in FE.text_clusters(d, "event_id", "t", [{"cat": 1.0}, {"fish": 0.9}], ngram_max=1, stop_words=()).collect()}
    assert (got["a"].cluster_id, got["b"].cluster_id, got["c"].cluster_id) == (0, 1, 1)
    assert 0 <= got["c"].cluster_confidence < got["a"].cluster_confidence < got["b"].cluster_confidence <= 1


def test_every_text_gets_a_prediction(spark):
    weights = spark.createDataFrame([("d1", "x", 1.0)], "doc string, term string, w double")
    coefs = spark.createDataFrame([("l", "x", 2.0)], "label string, term string, coef double")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc string")
    p = FE.softmax_predict(FE.linear_scores(weights, coefs, {"l": 0.0, "m": 0.5}, docs), ["l", "m"], 0.0)
    assert {r.doc: r.label for r in p.collect()} == {"d1": "l", "d2": "m"}


def test_train_job_saves_one_model_per_label_column(spark, tmp_path):
    rows = [(k, f"{'attack malware' if k % 2 else 'bank money'} {'north' if k % 3 else 'south'} t{k % 5}", "i1" if k % 2 else "i2", "s1" if k % 3 else "s2") for k in range(60)]
    path = f"{tmp_path}/labels.jsonl"
    spark.createDataFrame(rows, "id long, text string, incident_label string, sector_label string").write.json(path)
    data = TR.read_labeled(spark, path, "jsonl")
    assert data.count() == 60
    jobs = TR.train_job(data, "id", {"incident": "incident_label", "sector": "sector_label"}, f"{tmp_path}/models")
    from pyspark.ml import PipelineModel
    for folder, metrics in jobs.values():
        assert metrics.first()["accuracy"] == 1.0 and PipelineModel.load(folder).stages
    with pytest.raises(ValueError):
        TR.read_labeled(spark, path, "xml")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from vigil import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
