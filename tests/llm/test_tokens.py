"""Encoder, packing and token files against the tokenizers library used plainly."""

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import elias_fano, packing, token_files
from vigil.llm.queries import tokenizer_file
from vigil.llm.tokens import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {}


def enc(name):
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(tokenizer_file(name))
    return ENCODERS[name]


def plain(name, text):
    return enc(name).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_encoder_kinds(name):
    assert enc(name).kind == ("word" if name.startswith("word") else "byte")


@pytest.mark.parametrize("name", FILES)
def test_encoder_odd_texts(name, docs_rows):
    texts = ["", "a", " a", "a ", "a  b", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a\tb", "it's 's don't I'LL 'll", "ß. É, ñandú; 12 34. x1 1x", "a..b ... c!? d.",
             "İstanbul ΣΑΣ Σ", "é́ x́", "日本 語。 x", "\u0001a b\u0001 c", "a b c", "a b", "🙂 x 🙂🙂", "<|endoftext|> x<|endoftext|>", "ª º µ", "ﬁ ǅ",
             *[r[1] or "" for r in docs_rows]]
    got = [x.tolist() for x in enc(name).ids(texts)]
    assert got == [plain(name, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abTé ñß\n\t.,'s!1<|> ́\u0001Σ漢")), max_size=30), max_size=5))
def test_encoder_any_text(texts):
    for name in FILES:
        assert [x.tolist() for x in enc(name).ids(texts)] == [plain(name, t) for t in texts]


def test_encoder_cache_turnover(monkeypatch, docs_rows):
    import vigil.llm.tokens as T

    monkeypatch.setattr(T, "MAX_CACHED", 50)
    monkeypatch.setattr(T, "GROUP_CHARS", 300)
    for name in FILES:
        e = Encoder(tokenizer_file(name))
        texts = [r[1] or "" for r in docs_rows]
        assert [x.tolist() for x in e.ids(texts)] == [plain(name, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_rank_once(counts):
    steps = packing.plan_histogram(counts, 64)
    used, ranks = {}, {}
    for length, a, z, first, offset in steps:
        for k in range(z - a):
            used.setdefault(first + k, []).append((offset, length))
        ranks.setdefault(length, []).append((a, z))
    for length, n in counts.items():
        spans = sorted(ranks[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    # as good as best-fit decreasing over single pieces
    free = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((f for f in free if f >= length), default=None)
        if fit is None:
            free.append(64 - length)
        else:
            free[free.index(fit)] = fit - length
    assert len(used) <= 1.1 * len(free) + 1


def pieces_brute(rows, capacity):
    out = []
    for r in rows:
        ids = array("I", [*plain(FILES[0], r[1]), 0])
        out += [(r[0], k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(clashing, docs_rows, capacity):
    rows = packing.pack_documents(clashing, tokenizer_file(FILES[0]), capacity=capacity).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_brute(docs_rows, capacity)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= 1.1 * sum(r.length for r in rows) / capacity + 1


def test_packing_repeated_rows_null_ids_and_sequences(llm_spark):
    df = llm_spark.createDataFrame([(1, "a b c", 1)] * 5 + [(None, None, 2)], "doc_id long, text string, length int").repartition(3)
    packed = packing.pack_documents(df, tokenizer_file(FILES[0]), capacity=8, with_ids=True)
    assert packed.count() == 6
    got = packing.sequences(packed).collect()
    assert sum(r.n_ids for r in got) == 5 * 4 + 1 and all(len(r.ids) == 4 * r.n_ids <= 32 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2 ** 63, 2 ** 63 - 1), max_size=60))
def test_elias_fano_round_trip(values):
    v = np.array(sorted(values), np.int64)
    data = b"xy" + elias_fano.encode(v) + b"rest"
    s = elias_fano.Sequence(data, 2)
    assert s.select_many(np.arange(len(v))).tolist() == v.tolist() and data[s.end:] == b"rest"
    assert [s.select(i) for i in range(len(v))] == v.tolist()
    some = np.arange(len(v))[::-3]
    assert s.select_many(some).tolist() == v[some].tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(elias_fano.encode(v)) < 13 * len(v) / 8 + 1000  # 2 + log2(1000) bits and the counts
    s = elias_fano.Sequence(elias_fano.encode(v))
    assert [s.select(i) for i in (0, 1, 5000, 9999)] == v[[0, 1, 5000, 9999]].tolist()


@pytest.mark.parametrize("shard_bytes", [2 ** 24, 500])
def test_token_files(clashing, docs_rows, shard_bytes):
    got = token_files.round_trip(clashing, tokenizer_file(FILES[1]), shard_bytes=shard_bytes).orderBy("doc_id").collect()
    at, want = 0, []
    for r in sorted(docs_rows):
        ids = array("I", [*plain(FILES[1], r[1]), 0])
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert list(map(tuple, got)) == want


def test_token_files_null_and_repeated_ids(llm_spark):
    rows = [(None, "n")] * 2 + [(-5, "minus"), (3, None), (3, "three\n"), (2 ** 62, "far")]
    got = token_files.round_trip(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tokenizer_file(FILES[1])).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -5, 3, 3, 2 ** 62]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_shard_random_access():
    ids = [np.arange(k, dtype="<u4") for k in (3, 0, 70_000)]
    s = token_files.Shard(token_files.encode_shard(0, 0, [None, 4, 9], ids))
    assert s.width == 4
    for k, d in enumerate((None, 4, 9)):
        doc, got = s.doc(k)
        assert doc == d and got.tolist() == ids[k].tolist()


def test_empty_tables(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_file(FILES[0])).count() == 0
    assert token_files.round_trip(no_docs, tokenizer_file(FILES[1])).count() == 0


def test_elias_fano_select_reads_few_blocks():
    v = np.cumsum(np.random.default_rng(2).integers(0, 3000, 200_000))
    s = elias_fano.Sequence(elias_fano.encode(v))
    for i in (np.arange(5), np.arange(150_000, 154_097), np.array([199_999, 0, 77])):
        assert s.select_many(i).tolist() == v[i].tolist()


def test_token_files_rows_of_one_id_have_one_order(llm_spark):
    rows = [(5 if k % 3 else k, f"text number {k}") for k in range(600)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, token_files.round_trip(docs.repartition(n), tokenizer_file("byte_bpe_50k.json"), shard_bytes=400).collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 600


def test_packing_holds_few_texts_at_a_time(llm_spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.materialize
    before = llm_spark.conf.get(key)
    monkeypatch.setattr(packing, "materialize", lambda df, name: (seen.append(int(llm_spark.conf.get(key))), write(df, name))[1])
    docs = llm_spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json")).count() == 5
    assert seen == [packing.BATCH_ROWS] and packing.BATCH_ROWS < 10_000 and llm_spark.conf.get(key) == before
