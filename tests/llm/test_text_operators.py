"""Line dedup, license scan, quality rules and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.llm import licenses, line_dedup, mixing, quality
from vigil.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_brute(rows, min_docs):
    found = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if key := x.strip(SPACE).translate(AZ):
                found[key].add((r[0], r[1]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(found[x.strip(SPACE).translate(AZ)]) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_line_dedup(clashing, docs_rows, min_docs):
    got = line_dedup.dedup_digest(clashing, min_docs=min_docs).collect()
    assert sorted(map(tuple, got)) == dedup_brute(docs_rows, min_docs)


def test_line_dedup_hot_line_over_many_ranges(llm_spark):
    rows = [(k, f"own {k}\nHOT\nhot", "x", "s", 1) for k in range(3000)] + [(None, "hot", "x", "s", 1)] * 3
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = line_dedup.drop_lines(df, min_docs=10).select("row.doc_id", "n_dropped", "kept").collect()
    assert len(got) == 3003
    assert all((r.n_dropped, r.kept) == ((1, "") if r.doc_id is None else (2, f"own {r.doc_id}")) for r in got)


def test_line_dedup_counts_below_the_bound_across_batches():
    """Nine documents keep a line wherever the batches are cut, ten lose it."""
    import pyarrow as pa

    rows = [(1, 1, d, 0, 0) for d in range(9)] + [(2, 2, d, 0, 0) for d in range(10)] + [(3, 3, 1, 0, p) for p in range(20)] + [(4, 4, 1, 0, 0)]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), line_dedup._LINES, strict=True)], schema=line_dedup._LINES)
    for size in (1, 3, 7, 100):
        out = pa.Table.from_batches(list(line_dedup._stream(table.to_batches(max_chunksize=size), 10)), line_dedup._OUT).to_pylist()
        assert Counter(r["h1"] for r in out if r["kind"] == 0) == {2: 10}
        assert {r["h1"]: r["n_docs"] for r in out if r["kind"] == 2} == {1: 9, 4: 1}
        assert Counter(r["h1"] for r in out if r["kind"] == 1) == {1: 9, 4: 1}


LICENSE_TEXTS = [
    None, "", "MIT", "The MIT License.", "mit license mit LICENSE", "licensed under the GNU\n General Public License, version 3. cc BY-NC 4.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Apache Licenses", "xcc by", "éCC by ccé by cc by", "All rights reserved. Copyright (c) 2020 x",
    "Licensed under the Apache License, Version 2.0.", "Creative Commons Attribution NonCommercial 4.0", "a work under CDDL 1.0", "FreeBSD license", "the 2-clause BSD",
    "gplv3 or AGPL", "EUPL 1.2", "released under WTFPL", "CC0 and creative commons zero", "Modified BSD License", "The Unlicense", "GNU Lesser General Public Licence 2.1",
    "Redistribution and use in source and binary forms", "public domain dedication", "SPDX-License-Identifier: MPL-2.0", "odbl sspl gfdl", "creative commons", ("word " * 500 + "cc by ") * 20,
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def test_license_scan(llm_spark, docs_rows):
    texts = LICENSE_TEXTS + [r[1] for r in docs_rows]
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("norm", F.lit(2))
    scan = licenses.scan_licenses(df)
    got = {r.doc_id: r for r in licenses.license_digest(scan).collect()}
    spans = {r.doc_id: r for r in scan.collect()}
    rules = [(t, label, re.compile(f"(?<= )(?:{p})(?= )")) for t, label, p, _ in licenses.signature_rules()]
    for k, text in enumerate(texts):
        w = words_of(text)
        base = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert r.n_words == len(w) and r.n_base == len(base)
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        norm = " " + " ".join(w) + " "
        found = []
        for t, label, p in rules:
            for m in p.finditer(norm):
                first = len(norm[:m.start()].split())
                found.append((t, label, first, first + len(m[0].split())))
        assert sorted(map(tuple, spans[k].detections)) == sorted(found)
        kept = [d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[0] < d[0] or e[0] == d[0] and e[3] - e[2] > d[3] - d[2]) for e in found)]
        assert sorted(map(tuple, spans[k].kept)) == sorted(kept)
        assert r.labels == ",".join(sorted({x for _, x in base} | {d[1] for d in kept}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(base or kept)


GLUED_TEXTS = [
    "released under LGPLv3", "LGPLv3", "AGPLv3", "LGPL2.1", "LGPL-3", "GPL3", "GPLv3", "EUPLv1.2", "eupl1.1 only", "CDDLv1.1", "SSPLv1", "GFDL1.3", "ODbLv1.0", "WTFPL2",
    "CC01.0", "CC0v1", "LGPLversion 3", "AGPLver 3 or later", "GPLv 2", "Creative Commons Attribution4.0", "cc by4.0", "dual released with the AGPL3", "lgplx", "xLGPLv3", "LGPLv3x",
]


def test_license_scan_of_versions_glued_to_the_name(llm_spark):
    test_license_scan(llm_spark, [(k, t) for k, t in enumerate(GLUED_TEXTS)])
    got = licenses.license_digest(licenses.scan_licenses(llm_spark.createDataFrame(list(enumerate(GLUED_TEXTS)), "doc_id long, text string"))).collect()
    assert [GLUED_TEXTS[r.doc_id] for r in got if not r.labels] == ["lgplx", "xLGPLv3", "LGPLv3x"]


def test_license_rules_are_many_and_gated():
    rules = licenses.signature_rules()
    assert len(rules) >= 300 and len(set(rules)) == len(rules)
    gate = re.compile(licenses._gate(rules))
    for _, _, p, k in rules:
        re.compile(p)
        assert gate.search(" " + k) or re.search(r"\blicen", p)


def quality_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(marked), failed)


def test_quality(clashing, docs_rows):
    want = {r[0]: quality_brute(r[1]) for r in docs_rows}
    got = quality.repetition_quality(clashing).collect()
    assert len(got) == len(docs_rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def coverage_brute(text):
    """Shares of word characters inside repeated windows and in repeated lines, and the verdict."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, w))
    share = {}
    for n in quality.MAX_COVERAGE:
        at = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        many = Counter(at)
        marked = {j for i, x in enumerate(at) if many[x] > 1 for j in range(i, i + n)}
        share[n] = sum(len(w[j]) for j in marked) / chars if chars else 0.0
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        found = re.findall(r"[^\x20\x09-\x0D]+", line)
        if found and line in seen:
            again += sum(map(len, found))
        seen.add(line)
    lines = again / chars if chars else 0.0
    fine = lines <= quality.MAX_LINE_COVERAGE and len(re.findall(r"[#*$%&|<>]", text or "")) <= quality.MAX_SYMBOL_SHARE * chars
    return share, lines, fine and all(share[n] <= quality.MAX_COVERAGE[n] for n in share)


def test_quality_verdict_and_coverage_against_brute_force(llm_spark, docs_rows):
    texts = [r[1] for r in docs_rows] + ["a b c d e f g h i j k l m n o p q r s t " * 2, "### " * 5 + " ".join(map(str, range(60))), "one line here\n" * 9 + " ".join(map(str, range(99)))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (None, None), (3, texts[3]), (3, texts[3])]
    got = quality.repetition_quality(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    verdicts = set()
    for r in got:
        text = texts[-1] if r.doc_id is None and r.n_words else None if r.doc_id is None else texts[r.doc_id]
        share, lines, fine = coverage_brute(text)
        assert r.line_coverage == pytest.approx(lines) and all(r[f"coverage_{n}"] == pytest.approx(x) for n, x in share.items())
        assert r.kept == (not r.base_failed and fine)
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, True), (False, False)}
    assert quality.repetition_quality(llm_spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_coverage_counts_characters():
    from vigil.llm.words import WordHashes

    text = "aa bb cc dd ee " * 2 + "x y z"
    m = quality.measure(text.encode(), WordHashes())
    assert m["coverage_5"] == pytest.approx(20 / 23) and m["coverage_8"] == 0


def test_quality_keeps_clean_labelled_documents(llm_spark):
    d = "/root/testdata/sf0.01"
    r = quality.repetition_quality(llm_spark.read.parquet(f"{d}/documents.parquet")).join(llm_spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    clean = r[(r.quality == 1) & ~r.base_failed]
    assert clean.kept.mean() > 0.98
    assert r[r.quality == 0].kept.mean() < 0.15


def water_fill(sizes, weights, cap):
    """Targets by resharing the excess again and again."""
    total, target, closed = sum(sizes.values()), {}, set()
    while True:
        left, w = total - sum(cap * sizes[s] for s in closed), sum(weights[s] for s in sizes if s not in closed)
        target = {s: cap * sizes[s] if s in closed else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in closed and target[s] > cap * sizes[s]}
        if not over:
            return target
        closed |= over


def test_mixing(clashing, docs_rows, llm_spark):
    plan = mixing.mix_plan(clashing).collect()
    source = {r[0]: r[3] for r in docs_rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs_rows}
    by_source = Counter()
    for d, s in source.items():
        by_source[s] += size[d]
    order = sorted((s for s in by_source if s is not None)) + [None]
    target = water_fill(by_source, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    taken = Counter()
    for r in plan:
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size[d] for d in size if source[d] == s) / 2 + 1e-6
    assert sorted(plan) == sorted(mixing.mix_plan(clashing.repartition(3)).collect())
    mixed = mixing.mix_documents(clashing)
    assert mixed.columns == clashing.columns
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert copies == Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_mixing_skewed_source_and_caps(llm_spark):
    rows = [(k, "w " * (1 + k % 5), "big" if k < 900 else f"s{k % 3}") for k in range(1000)]
    plan = mixing.mix_plan(llm_spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    src = {k: s for k, _, s in rows}
    plan["source"] = plan.doc_id.map(src)
    g = plan.groupby("source").agg(t=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((g.t - g.taken).abs() <= 3).all() and (g.t <= 3 * g["size"] + 1e-9).all()
    assert g.t.sum() == pytest.approx(plan["size"].sum())


def test_mixing_repeated_rows_and_no_words(llm_spark):
    rows = [(1, "a b", "s")] * 3 + [(2, None, "t"), (3, "", None), (None, "c d e", "s")]
    plan = mixing.mix_plan(llm_spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(plan) == 6 and len({r.taken for r in plan if r.doc_id == 1}) == 1
    assert all(r.taken == 0 and r.target == 0 for r in plan if r.size == 0)


def test_empty_tables(no_docs):
    assert line_dedup.dedup_digest(no_docs).count() == 0
    assert licenses.license_digest(licenses.scan_licenses(no_docs)).count() == 0
    assert quality.repetition_quality(no_docs).count() == 0
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(llm_spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = QUERIES[name](llm_spark, d).toPandas()
    want = con.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    key = got.columns[0]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert (got[c] - want[c]).abs().max() < 1e-6
        else:
            assert (got[c] == want[c]).all(), c


def test_license_scan_of_a_very_long_text(llm_spark):
    text = "licensed under the Apache License, version 2.0 or cc by and gplv3 with some more words; " * 400
    df = llm_spark.createDataFrame([(None, text), (1, text[:2000]), (1, text[:2000])], "doc_id long, text string")
    got = sorted(licenses.license_digest(licenses.scan_licenses(df)).collect(), key=lambda r: r.n_words)
    assert got[0] == got[1] and got[2].n_words == len(words_of(text)) and got[2].n_base == 2 * 400 and got[2].doc_id is None
    assert got[2].labels == got[0].labels and got[2].n_kept == 3 * 400


@pytest.mark.parametrize("hot", [7, None])
def test_mix_meets_its_target_when_rows_share_an_id(llm_spark, hot):
    """600 of 1,000 rows hold one id, or none; equal rows are taken in part."""
    same, own = "w " * 10, lambda k: f"{k} " * 10
    for text in (lambda k: same, own):
        rows = [(hot if k < 600 else k + 1000, text(k), "en", "a", 20) for k in range(1000)] + [(5000 + k, own(k), "en", "b", 20) for k in range(4000)]
        df = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        plan = mixing.mix_plan(df, weights=(1, 7), max_repeat=3).collect()
        for size in {r.source_size for r in plan}:
            part = [r for r in plan if r.source_size == size]
            assert abs(sum(r.taken for r in part) - part[0].target) <= 0.005 * part[0].target + 20


def test_mix_takes_documents_as_often_as_their_odds_say(llm_spark):
    """Over many seeds the documents of one size are taken as often as their share of the words wanted says."""
    rows = [(k, "w " * (5 if k % 2 else 400), "en", "a" if k < 200 else "b", 1) for k in range(400)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    seeds = 12
    taken = Counter()
    for s in range(seeds):
        for r in mixing.mix_plan(df, weights=(1, 3), max_repeat=3, seed=f"s{s}").collect():
            taken[(r.size, r.source_size and r.doc_id < 200)] += r.copies
    target = 200 * 202.5 * 2 / 4  # words of the first source that the mix wants
    words = (taken[(5, True)] * 5 + taken[(400, True)] * 400) / seeds
    assert abs(words - target) <= 0.02 * target
    small, large = (taken[(n, True)] / seeds / 100 for n in (5, 400))
    odds = lambda p: p / (1 - p)
    assert 0 < small < large < 1
    assert odds(large) / odds(small) == pytest.approx((400 / 500) / (5 / 105), rel=0.35)
