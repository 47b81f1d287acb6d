"""Source readers on hand-made landed payloads (FIXTURES §5 edge rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.sources import feeds as FD


def _one_col(spark, values, name="value"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_json_item_shapes(spark):
    df = _one_col(spark, ['[{"a":1},{"a":2}]', '{"items":[{"a":3}]}', '{"data":{"records":[{"a":4}]}}', "42", '{"items":5}'])
    got = [r["n"] for r in df.select(F.size(FD.json_items(F.col("value"), None)).alias("n")).collect()]
    assert got == [2, 1, 0, 0, 0]
    got = [r["n"] for r in df.select(F.size(FD.json_items(F.col("value"), "data.records")).alias("n")).collect()]
    assert got == [0, 0, 1, 0, 0]


def test_json_text_and_url_rules(spark):
    df = _one_col(spark, ['{"title":"  T ","text":"body","n":3,"url":"  ","link":"L"}', '{"content":5,"body":"B"}'])
    v = F.try_parse_json("value")
    r = df.select(FD.json_text(v, ["title", "n", "text"]).alias("t"), FD.json_text(v, None).alias("d"),
                  FD.json_url(v).alias("u")).collect()
    assert (r[0]["t"], r[0]["d"], r[0]["u"]) == ("T\nbody", "body", "L")
    assert (r[1]["d"], r[1]["u"]) == ("B", None)


def test_json_api_cap_counts_items_before_empty_filter(spark):
    payload = '[{"text":"a"},{"text":"  "},{"text":"b"},{"text":"c"}]'
    df = spark.createDataFrame([("f", payload)], "name string, payload string")
    ev = FD.json_api_events(df, F.col("name"), F.lit("api://f"), F.col("payload"), text_fields=["text"], max_items=3)
    assert [r["raw_text"] for r in ev.orderBy("pos").collect()] == ["a", "b"]


def test_file_lines_quarantine_and_plain_text(spark):
    lines = spark.createDataFrame(
        [("p", 0, '{"text":"x","url":"u"}'), ("p", 1, "123"), ("p", 2, '"abc"'), ("p", 3, "{broken"), ("p", 4, "  "),
         ("p", 5, "plain line")], "path string, line_no int, line string")
    ev, q = FD.file_events(lines, "export")
    got = sorted((r["raw_text"], r["source_url"]) for r in ev.collect())
    assert got == [("plain line", "p"), ("x", "u"), ("{broken", "p")]
    assert sorted(r["line"] for r in q.collect()) == ['"abc"', "123"]


def test_text_feed_comments_prefix_and_cap(spark):
    lines = spark.createDataFrame([("p", i, l) for i, l in enumerate(
        ["# c", "", "https://x.org/a", "1.2.3.4", "  5.6.7.8  ", "9.9.9.9"])], "path string, line_no int, line string")
    ev = FD.text_feed_events(lines, "feed", "feed://u", max_items=3, prefix=" IP: ").orderBy("pos").collect()
    assert [r["raw_text"] for r in ev] == ["IP: https://x.org/a", "IP: 1.2.3.4", "IP: 5.6.7.8"]
    assert [r["source_url"] for r in ev] == ["https://x.org/a", "feed://u", "feed://u"]


def test_rss_cap_before_empty_and_link_fallback(spark):
    xml = ("<rss><channel><item><title> </title></item><item><title>A</title><link>l1</link></item>"
           "<item><title>B</title></item><item><title>C</title></item></channel></rss>")
    df = spark.createDataFrame([(xml,)], "value string")
    ev = FD.rss_events(df, F.lit("r"), F.lit("feed://r"), max_items=3).orderBy("pos").collect()
    assert [(r["raw_text"], r["source_url"]) for r in ev] == [("A", "l1"), ("B", "feed://r")]


def test_html_selectors(spark):
    html = ('<html><head><title>T &amp; U</title></head><body><div class="ad x">ad</div>'
            '<article><p>one</p><p>two</p></article><div id="m">main</div></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(FD.node_text(F.col("html"), "title").alias("t"), FD.node_text(F.col("html"), "div.ad").alias("a"),
                  FD.node_text(F.col("html"), "div#m").alias("m"), FD.node_text(F.col("html"), "article").alias("b")).first()
    assert r["t"].strip() == "T & U" and r["a"].strip() == "ad" and r["m"].strip() == "main"
    assert " ".join(r["b"].split()) == "one two"
