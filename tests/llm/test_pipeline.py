"""The pipeline against a version in plain Python, stage by stage, and end to end on the smallest tables."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from test_matching import components_brute
from test_tokens import pieces_brute

from vigil.llm import line_dedup, mixing, toxicity

SPACE = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_on_the_smallest_tables(llm_spark):
    d = "/root/testdata/sf0.001"
    docs = llm_spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, llm_spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = [r for r in rows if scores[r[0]] < toxicity.THRESHOLD]

    found = defaultdict(set)
    for r in rows:
        for x in r[1].split("\n"):
            if key := x.strip(SPACE).translate(AZ):
                found[key].add(r[0])
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if len(found[x.strip(SPACE).translate(AZ)]) < line_dedup.MIN_DOCS), r[2], r[3]) for r in rows]

    component = {i: c for i, _, c in components_brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if component[r[0]] == r[0]]

    kept = llm_spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(kept).collect()}
    want = Counter()
    for p in pieces_brute([r for r in rows for _ in range(copies[r[0]])], 2048):
        want[p] += 1

    got = pipeline.run(llm_spark, d).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for places in slots.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(llm_spark, docs, d).columns == columns


def test_stages_carry_other_columns_and_odd_rows(llm_spark, clashing):
    d = "/root/testdata/sf0.001"
    docs = clashing
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(llm_spark, docs, d)
        assert after.columns == clashing.columns
        docs = after
    left = docs.collect()
    assert left and all(re.search(r"\S", r.text) for r in left)
    assert pipeline.STAGES[-1][1](llm_spark, docs, d).count() >= len(left)


def test_stages_on_an_empty_table(llm_spark, no_docs):
    docs = no_docs
    for _, stage in pipeline.STAGES:
        docs = stage(llm_spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
