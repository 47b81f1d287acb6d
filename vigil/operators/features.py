"""Text features in long form: terms, vocabulary, TF-IDF, k-means helpers and a
linear text model applied as joins (no per-row model calls)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import arrow_rows, materialize

HOT_TERMS = 50_000  # rows of a broadcast term table at most
HOT_CHARS = 200
COUNT_ROWS = 1024  # texts whose terms are counted together
PART_ROWS, PART_BYTES = 2048, 8 << 20  # texts of a part, on average, whose terms are looked up together
OUT_ROWS = 65_536  # weights that leave a task together
# Own choice: a short English stop-word list (the list is a parameter; libraries differ).
CLUSTER_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its",
    "of", "on", "or", "that", "the", "to", "was", "were", "will", "with", "this", "these", "those", "not",
    "but", "they", "she", "his", "her", "we", "you", "i",
]
WORD_RUN = r"[\p{L}\p{N}_]+"
WORDS = re.compile(r"\w{2,}")  # the runs of ``WORD_RUN`` that ``unigrams`` keeps


def unigrams(text: Column, stop_words: Sequence[str] = CLUSTER_STOP_WORDS) -> Column:
    """Lower-cased runs of 2+ word characters, stop words removed (in text order)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 0)
    sw = tuple(stop_words)
    return F.filter(runs, lambda w: (F.length(w) >= 2) & ~w.isin(*sw)) if sw else \
        F.filter(runs, lambda w: F.length(w) >= 2)


def terms(text: Column, ngram_max: int = 2, stop_words: Sequence[str] = CLUSTER_STOP_WORDS) -> Column:
    """1..2-grams of the unigrams, unigrams first then bigrams."""
    u = unigrams(text, stop_words)
    if ngram_max < 2:
        return u
    bi = F.zip_with(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))),
                    F.slice(u, 2, F.greatest(F.size(u) - 1, F.lit(0))),
                    lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(u, F.when(F.size(u) >= 2, bi).otherwise(F.array().cast("array<string>")))


def text_terms(lower_text: str | None, ngram_max: int = 2, stop_words: Sequence[str] = CLUSTER_STOP_WORDS) -> list[str]:
    """``terms`` of one lower-cased text, inside a task: a text goes there faster than the list of its words."""
    u = WORDS.findall(lower_text) if lower_text else []
    if stop_words:
        u = [w for w in u if w not in stop_words]
    return u if ngram_max < 2 else [*u, *(f"{a} {b}" for a, b in zip(u, u[1:]))]


def term_rows(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(doc, tfs): each row's distinct terms with their counts, as one sorted array, empty without terms; written once, no shuffle.

    Counting is a run-length over the row's sorted terms, so a term table of the corpus is never grouped by document.
    """
    t = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("t"))
    kw = _set_of_stop_words(kw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_terms(pa.RecordBatch.from_arrays([b.column(0), pa.array([text_terms(x, **kw) for x in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc", "t"])
                                for b in batches)

    with arrow_rows(docs.sparkSession, COUNT_ROWS):
        return materialize(t.mapInArrow(count, f"doc {dict(t.dtypes)['doc']}, tfs array<struct<term:string,tf:bigint>>"), "terms")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, terms) -> (doc, tfs): a batch's different terms are sorted once, then its rows' terms as numbers."""
    for b in batches:
        t = b.column(1)
        sizes = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
        coded = t.flatten().dictionary_encode()
        names = coded.dictionary.take(order := pc.sort_indices(coded.dictionary))
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        cells = np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + rank[coded.indices.to_numpy()]
        cells, tf = np.unique(cells, return_counts=True)
        row, term = np.divmod(cells, max(len(names), 1))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]), pa.int32())
        tfs = pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(tf, pa.int64())], names=["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, tfs)], names=["doc", "tfs"])


def _set_of_stop_words(kw: dict) -> dict:
    return {**kw, "stop_words": frozenset(kw.get("stop_words", CLUSTER_STOP_WORDS))}


def term_counts(rows: DataFrame) -> DataFrame:
    """(doc, term, tf) long form of ``term_rows``."""
    return rows.select("doc", F.inline("tfs"))


def vocabulary(tc: DataFrame, n_docs: int, max_features: int | None = None, min_df: float = 1,
               max_df: float = 1.0) -> DataFrame:
    """(term, cf, df) kept after df limits, the top ``max_features`` by corpus frequency (term breaks ties)."""
    return kept_terms(tc.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")), n_docs, max_features, min_df, max_df)


def corpus_terms(docs: DataFrame, text_col: str, **kw) -> DataFrame:
    """(term, cf, df) of all terms. The texts of a batch are counted together, so a term comes to the shuffle once for each batch that holds it.

    To be run within ``arrow_rows``, which bounds the texts, and so the terms, that a task holds.
    """
    kw = _set_of_stop_words(kw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_terms(text, **kw) for text in b.column(0).to_pylist()]
            coded = pa.array([t for ts in found for t in ts], pa.string()).dictionary_encode()
            n, codes = len(coded.dictionary), coded.indices.to_numpy()
            held = pc.unique(pa.array(np.repeat(np.arange(len(found)), [len(ts) for ts in found]) * max(n, 1) + codes)).to_numpy()
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(np.bincount(x, minlength=n), pa.int64()) for x in (codes, held % max(n, 1)))], names=["term", "cf", "df"])

    part = docs.select(F.lower(text_col).alias("t")).mapInArrow(count, "term string, cf long, df long")
    return part.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def kept_terms(v: DataFrame, n_docs: int, max_features: int | None = None, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """Those of the terms ``v`` (term, cf, df) that the limits of ``vocabulary`` keep."""
    lo = min_df if isinstance(min_df, int) or min_df >= 1 else min_df * n_docs
    hi = max_df * n_docs if isinstance(max_df, float) and max_df <= 1.0 else max_df
    v = v.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features:
        v = v.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return v


def term_weights(rows: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, w) with w = tf * (ln((1+N)/(1+df)) + 1), not normalised, for the terms of ``vocab`` (term, df).

    Terms with the highest document counts stand in most rows: at most ``HOT_TERMS`` terms can have ``total / HOT_TERMS`` postings or
    more, so these are looked up where the rows are, by a broadcast of that many rows. All other postings meet the vocabulary in
    a sort-merge join on the term, where no term has more than that share of them.
    """
    vocab = materialize(vocab.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), "vocabulary")
    total = vocab.agg(F.sum("df")).first()[0] or 0
    is_hot = (F.col("df") >= max(2, -(-total // HOT_TERMS))) & (F.length("term") <= HOT_CHARS)
    hot = vocab.filter(is_hot).select("term", "idf")
    postings = term_counts(rows)
    common = postings.join(F.broadcast(hot), "term")
    rest = postings.join(F.broadcast(hot.select("term")), "term", "left_anti")
    rare = rest.hint("merge").join(vocab.filter(~is_hot).select("term", "idf").hint("merge"), "term")
    return common.unionByName(rare).select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf(rows: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, weight): ``term_weights``, L2-normalised per document."""
    w = term_weights(rows, vocab, n_docs)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("weight"))


def text_weights(docs: DataFrame, id_col: str, text_col: str, unit: bool = False, **kw) -> DataFrame:
    """(doc, term, w) of every term of the texts: ``term_weights`` over the whole vocabulary, or with ``unit`` the weights of ``tfidf``.

    Texts are dealt into parts by id, once. A part sends each of its different terms once, with the number of its texts that hold it, in packed lists to the
    buckets of the terms' hashes; a bucket adds the numbers of equal terms up and answers every list with a list of sums, without the terms. The part finds its
    terms again in the same order and weighs them where the texts are. So neither postings nor the vocabulary are written or sent, and what a
    task holds is a part or a bucket, of which there are as many.
    """
    kw = _set_of_stop_words(kw)
    n_docs, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    parts = max(1, -(-n_docs // PART_ROWS), -(-size // PART_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // 64)))
    texts = docs.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.col(id_col).alias("doc"), F.lower(text_col).alias("t")).repartition(parts, "part")
    kind = np.uint32 if n_docs < 2 ** 32 else np.uint64

    def lists(t: pa.Table) -> pa.Table:
        names, hashes, _, code, _ = _part_terms(t, **kw)
        order, bucket = _bucket_order(hashes, parts)
        held = np.bincount(code, minlength=len(names))[order].astype(np.uint32)
        names = names.take(pa.array(order))
        ends, data = _string_buffers(names)
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        pack = lambda x: zlib.compress(memoryview(x), 1)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()] * len(spans), pa.int32()), "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                         "terms": pa.array([pack(data[ends[a]:ends[z]]) for a, z in spans], pa.binary()),
                         "sizes": pa.array([pack(np.diff(ends[a:z + 1]).astype(np.uint32)) for a, z in spans], pa.binary()),
                         "held": pa.array([pack(held[a:z]) for a, z in spans], pa.binary())})

    def sums(t: pa.Table) -> pa.Table:
        column = lambda name, of: [np.frombuffer(zlib.decompress(x), of) for x in t.column(name).to_pylist()]
        sizes, held = column("sizes", np.uint32), np.concatenate(column("held", np.uint32))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        terms = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(column("terms", np.uint8)))])
        codes = terms.dictionary_encode().indices.to_numpy()
        df = np.bincount(codes, held).astype(kind)[codes]
        at = np.cumsum([0, *map(len, sizes)])
        return pa.table({"part": t.column("part"), "bucket": t.column("bucket"),
                         "df": pa.array([zlib.compress(memoryview(df[a:z]), 1) for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    def weigh(t: pa.Table, found: pa.Table) -> pa.Table:
        names, hashes, row, code, tf = _part_terms(t, **kw)
        df = np.zeros(len(names))
        if len(names):
            df[_bucket_order(hashes, parts)[0]] = np.concatenate([np.frombuffer(zlib.decompress(x), kind) for x in found.sort_by("bucket").column("df").to_pylist()])
        w = tf * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)[code]
        if unit:
            doc = t.column("doc").combine_chunks().dictionary_encode("encode").indices.to_numpy()[row]
            w = w / np.sqrt(np.bincount(doc, w * w))[doc] if len(w) else w
        out = pa.table({"doc": t.column("doc").take(pa.array(row)), "term": names.take(pa.array(code)), "w": w})
        return pa.Table.from_batches(out.to_batches(OUT_ROWS), out.schema)

    kind_of = dict(texts.dtypes)["doc"]
    sent = texts.groupBy("part").applyInArrow(lists, "part int, bucket int, terms binary, sizes binary, held binary")
    answers = sent.groupBy("bucket").applyInArrow(sums, "part int, bucket int, df binary")
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(weigh, f"doc {kind_of}, term string, w double")


def _part_terms(t: pa.Table, ngram_max: int = 2, stop_words: frozenset = frozenset()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different terms (``text_terms``) of a part's texts and their hashes, and text, number and count of every term of a text.

    The terms come words first, in an order and with hashes that follow from the terms alone; two words are joined once a part.
    """
    pieces, sizes = [], []
    for b in t.select(["t"]).to_batches(COUNT_ROWS // 4):
        found = [WORDS.findall(text) if text else [] for text in b.column(0).to_pylist()]
        sizes += map(len, found)
        pieces.append(pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode())
    coded = pa.chunked_array(pieces, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().combine_chunks()
    words = coded.dictionary.take(order := pc.sort_indices(coded.dictionary))
    listed = words.to_pylist()
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    word, row = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    if stop_words:
        keep = np.array([w not in stop_words for w in listed], bool)[word]
        word, row = word[keep], row[keep]
    kept, own = np.unique(word, return_inverse=True)
    mixed = np.array([zlib.crc32(w.encode()) for w in listed], np.uint64)
    names, hashes, rows, codes = [words.take(pa.array(kept))], [mixed[kept]], [row], [own]
    if ngram_max > 1:
        near = np.flatnonzero(row[1:] == row[:-1])
        pairs, at = np.unique(word[near] * max(len(words), 1) + word[near + 1], return_inverse=True)
        a, b = np.divmod(pairs, max(len(words), 1))
        names.append(pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " "))
        hashes.append((mixed[a] * np.uint64(0x9E3779B1) + mixed[b]) * np.uint64(0x85EBCA6B) >> np.uint64(17))
        rows.append(row[near])
        codes.append(len(kept) + at)
    n = max(sum(map(len, names)), 1)
    cells, tf = np.unique(np.concatenate(rows) * n + np.concatenate(codes), return_counts=True)
    row, code = np.divmod(cells, n)
    return pa.concat_arrays(names), np.concatenate(hashes), row, code, tf


def _bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a part's terms in the order of their buckets, and the buckets in that order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from 0) and bytes of a string array without an offset."""
    _, ends, data = a.buffers()
    ends = np.frombuffer(ends, np.int32)[:len(a) + 1] if len(a) else np.zeros(1, np.int32)
    return ends, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def centre_distances(vec: Column, centres: Sequence[Sequence[float]]) -> Column:
    """array of Euclidean distances from ``vec`` to each (small, fixed) centre."""
    ds = []
    for c in centres:
        lit = F.array(*[F.lit(float(x)) for x in c])
        sq = F.zip_with(vec, lit, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        ds.append(F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x)))
    return F.array(*ds)


def kmeans_confidence(dists: Column) -> Column:
    """clip01(1 - d_min / (d_max + 1e-6)); 1.0 when d_max <= 0."""
    dmin, dmax = F.array_min(dists), F.array_max(dists)
    c = F.lit(1.0) - dmin / (dmax + F.lit(1e-6))
    return F.when(dmax <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def nearest(dists: Column) -> Column:
    """0-based index of the smallest distance (first on ties)."""
    return F.array_position(dists, F.array_min(dists)).cast("int") - 1


def auto_k(n: int, n_clusters: int = 0, min_cluster_size: int = 3) -> int | None:
    """The automatic cluster count for callers that configure none: max(2, min(10, n div min_size)), never above n; None below the minimum."""
    if n < max(min_cluster_size, 2):
        return None
    k = n_clusters if n_clusters > 0 else max(2, min(10, n // max(min_cluster_size, 1)))
    return min(k, n)


def kmeans(df: DataFrame, id_col: str, vec_col: str, n_clusters: int, seed: int = 42) -> DataFrame:
    """(id, cluster_id, cluster_confidence) with Spark ML k-means on dense vectors; ``n_clusters`` is the caller's choice."""
    return assign(df, id_col, vec_col, fit_centres(df, vec_col, n_clusters, seed))


def fit_centres(df: DataFrame, vec_col: str, n_clusters: int, seed: int = 42) -> list[list[float]]:
    """``n_clusters`` fitted centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n_clusters, seed=seed, featuresCol="features").fit(df.select(array_to_vector(F.col(vec_col)).alias("features")))
    return [list(map(float, c)) for c in model.clusterCenters()]


def assign(df: DataFrame, id_col: str, vec_col: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(id, cluster_id, cluster_confidence): the nearest centre and how clearly it is the nearest."""
    d = df.select(F.col(id_col).alias("id"), centre_distances(F.col(vec_col), centres).alias("d"))
    return d.select("id", nearest(F.col("d")).alias("cluster_id"), kmeans_confidence(F.col("d")).alias("cluster_confidence"))


def text_clusters(docs: DataFrame, id_col: str, text_col: str, centres: Sequence[Mapping[str, float]], **kw) -> DataFrame:
    """(id_col, cluster_id, cluster_confidence) of every text by its TF-IDF row and sparse centres (term -> weight).

    Distances come from sums per text (|x|^2 = 1, x.c over the centre's terms), so a row is never gathered as a dense
    vector; a text without terms is the zero vector. Distances are compared at 9 decimals, ties go to the first centre.
    """
    rows = term_rows(docs, id_col, text_col, **kw)
    w = term_weights(rows, vocabulary(term_counts(rows), 0, max_df=float("inf")), docs.count())

    def weight_in(centre: Mapping[str, float]) -> Column:
        table = F.create_map(*[x for t, c in centre.items() for x in (F.lit(t), F.lit(float(c)))])
        return F.coalesce(F.try_element_at(table, F.col("term")), F.lit(0.0))

    sums = w.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("n2"), *[F.sum(F.col("w") * weight_in(c)).alias(f"s{k}") for k, c in enumerate(centres)])
    j = docs.select(F.col(id_col).alias("doc")).join(sums, "doc", "left")
    has = F.col("n2").isNotNull()
    d = [F.round(F.sqrt(F.greatest(F.lit(0.0), F.when(has, F.lit(1.0) - 2 * F.col(f"s{k}") / F.sqrt("n2")).otherwise(0.0) + sum(v * v for v in c.values()))), 9)
         for k, c in enumerate(centres)]
    j = j.select("doc", F.array(*d).alias("d"))
    return j.select(F.col("doc").alias(id_col), nearest(F.col("d")).alias("cluster_id"), kmeans_confidence(F.col("d")).alias("cluster_confidence"))


def linear_scores(weights: DataFrame, coefs: DataFrame, intercepts: Mapping[str, float], docs: DataFrame) -> DataFrame:
    """(doc, label, score) = intercept + sum of normalised weight x coefficient; every label for every row of ``docs`` (doc),
    also for texts without a known term.

    ``weights`` are ``term_weights``: the coefficients (one row a term, size checked) go to where the weights are, and norm and products are
    sums per document in one aggregate.
    """
    labels = list(intercepts)
    wide = lookup_side(coefs.groupBy("term").agg(*[F.max(F.when(F.col("label") == lab, F.col("coef"))).alias(f"c{k}") for k, lab in enumerate(labels)]))
    sums = weights.join(wide, "term", "left").groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[F.sum(F.col("w") * F.col(f"c{k}")).alias(f"s{k}") for k in range(len(labels))])
    each = F.array(*[F.struct(F.lit(lab).alias("label"), (F.lit(float(intercepts[lab])) + F.coalesce(F.col(f"s{k}") / F.col("norm"), F.lit(0.0))).alias("score"))
                     for k, lab in enumerate(labels)])
    return docs.select("doc").join(sums, "doc", "left").select("doc", F.inline(each))


def lookup_side(table: DataFrame, max_rows: int = HOT_TERMS) -> DataFrame:
    """``table`` written once, to be broadcast if it has at most ``max_rows`` rows and to be merged otherwise."""
    table = materialize(table, "lookup")
    return F.broadcast(table) if table.count() <= max_rows else table.hint("merge")


def softmax_predict(scores: DataFrame, label_order: Sequence[str], min_confidence: float) -> DataFrame:
    """(doc, label, confidence): stable softmax per doc, argmax (first label on ties), 'unknown' below min."""
    w = Window.partitionBy("doc")
    z = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    p = z.withColumn("p", F.col("_e") / F.sum("_e").over(w))
    order = F.create_map(*[x for i, lab in enumerate(label_order) for x in (F.lit(lab), F.lit(i))])
    best = p.groupBy("doc").agg(F.max_by(F.struct("label", "p"),
                                         F.struct(F.col("p"), -F.element_at(order, F.col("label")))).alias("b"))
    return best.select("doc", F.when(F.col("b.p") >= min_confidence, F.col("b.label")).otherwise("unknown").alias("label"),
                       F.col("b.p").alias("confidence"), F.col("b.label").alias("argmax_label"))


def explain(weights: DataFrame, coefs: DataFrame, predictions: DataFrame, top_n: int = 5) -> DataFrame:
    """(doc, terms): top-n terms by weight x coefficient of the predicted label, descending; a row's norm does not change their order."""
    j = weights.join(lookup_side(coefs.select("term", "label", "coef")), "term").join(
        predictions.filter(F.col("label") != "unknown").select("doc", "label"), ["doc", "label"])
    c = j.select("doc", F.struct((-F.col("w") * F.col("coef")).alias("c"), "term").alias("x"))
    top = c.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list("x")), 1, top_n).alias("top"))  # terms of one text
    return top.select("doc", F.transform("top", lambda x: x["term"]).alias("terms"))
