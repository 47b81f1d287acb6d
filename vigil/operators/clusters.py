"""Mini-batch k-means over the TF-IDF rows of texts.

Rows are sparse unit vectors over the ``max_features`` most frequent terms (the caller's number), written once. The seeds are chosen
among the ``SEED_ROWS`` rows whose ids hash lowest, each next one with odds in proportion to its squared distance from those chosen
(k-means++; the odds are drawn from hashes, so a run repeats). Then the corpus is dealt into ``BATCHES`` batches by hash, so all rows take
part: each batch is assigned to the nearest centres, and every centre moves to the mean of all rows it has got so far. What tasks get and send back
(centres, sums per centre and term) is bounded by k x max_features; vectors are never shuffled after they are made.

Distances are compared at ``DIGITS`` decimals, ties go to the first centre. A text without a known term is the zero vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import features
from vigil.session import arrow_rows, materialize

SEED = 42
SEED_ROWS = 256
BATCHES = 4
DIGITS = 9


def text_vectors(docs: DataFrame, id_col: str, text_col: str, max_features: int, **kw) -> DataFrame:
    """(id, batch, at, w) per row of ``docs``: positions of its terms in the vocabulary and unit weights, both empty without a term."""
    n_docs = docs.count()
    with arrow_rows(docs.sparkSession, features.COUNT_ROWS):
        vocab = features.kept_terms(features.corpus_terms(docs, text_col, **kw), n_docs, max_features).orderBy("term").collect()  # at most max_features
    known = {r["term"]: at for at, r in enumerate(vocab)}
    idf = np.array([math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in vocab])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[at for at in map(known.get, features.text_terms(text, **kw)) if at is not None] for text in b.column(2).to_pylist()]
            cells = np.repeat(np.arange(b.num_rows), [len(x) for x in found]) * max(len(known), 1) + np.fromiter(chain.from_iterable(found), np.int64)
            cells, tf = np.unique(cells, return_counts=True)
            row, at = np.divmod(cells, max(len(known), 1))
            at = at.astype(np.int32)
            w = tf * idf[at] if len(at) else np.zeros(0)
            norm = np.sqrt(np.bincount(row, w * w, b.num_rows))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(at)),
                                              pa.ListArray.from_arrays(ends, pa.array(w / norm[row] if len(row) else w))], names=["id", "batch", "at", "w"])

    texts = docs.select(F.col(id_col).alias("id"), _batch(F.col(id_col)).alias("batch"), F.lower(text_col).alias("t"))
    with arrow_rows(docs.sparkSession, features.COUNT_ROWS):
        return materialize(texts.mapInArrow(vectors, f"id {dict(texts.dtypes)['id']}, batch int, at array<int>, w array<double>"), "text_vectors")


def _batch(c):
    """The batch of a row, from a hash of its id."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|batch|"), c.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(BATCHES)).cast("int")


def _hash_order(c):
    return F.md5(F.concat(F.lit(f"{SEED}|seed|"), c.cast("string")))


def seed_centres(vectors: DataFrame, k: int, n_features: int) -> np.ndarray:
    """Up to k rows of a bounded sample as first centres; fewer if there are fewer different ones."""
    sample = vectors.orderBy(_hash_order(F.col("id")), "id").limit(SEED_ROWS).select(F.col("id").cast("string").alias("id"), "at", "w").collect()
    x = np.zeros((len(sample), n_features))
    for row, r in enumerate(sample):
        x[row, r["at"]] = r["w"]
    if not len(x):
        return x
    chosen, nearest = [0], None
    while len(chosen) < k:
        new = x[chosen[-1]]
        d = np.round((x ** 2).sum(1) + (new ** 2).sum() - 2 * (x @ new), DIGITS)
        nearest = d if nearest is None else np.minimum(nearest, d)
        keys = [math.log(_uniform(len(chosen), r["id"])) / gap if gap > 0 else -math.inf for r, gap in zip(sample, nearest.tolist(), strict=True)]
        best = max(range(len(keys)), key=keys.__getitem__)
        if keys[best] == -math.inf:
            break
        chosen.append(best)
    return x[chosen]


def _uniform(step: int, row: str) -> float:
    return (int(hashlib.md5(f"{SEED}|{step}|{row}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52


def _distances(at: pa.Array, w: pa.Array, centres: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(rows, centres) distances of sparse rows."""
    sizes = np.diff(at.offsets.to_numpy()) if not at.null_count else np.array([len(x) for x in at.to_pylist()])
    terms, weights = at.flatten().to_numpy(), w.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    # a centre at a time: sums in the terms' order, without a table of terms by centres
    dots = np.zeros((len(sizes), len(centres)))
    for c, centre in enumerate(centres):
        dots[:, c] = np.bincount(row, weights * centre[terms], len(sizes))
    own = np.bincount(row, weights * weights, len(sizes))
    return np.round(np.sqrt(np.maximum(own[:, None] + norms - 2 * dots, 0)), DIGITS)


def move_centres(vectors: DataFrame, centres: np.ndarray, counts: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres after one batch: each is the mean of all rows assigned to it up to now."""
    norms = (centres ** 2).sum(1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            if b.num_rows:
                at, w = b.column(0), b.column(1)
                near = _distances(at, w, centres, norms).argmin(1)
                sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
                cell = np.repeat(near, sizes) * centres.shape[1] + at.flatten().to_numpy()
                total += np.bincount(cell, w.flatten().to_numpy(), centres.size).reshape(centres.shape)
                n += np.bincount(near, minlength=len(n))
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, np.arange(len(n))]), pa.int64()), pa.array(np.concatenate([at, np.full(len(n), -1)]), pa.int64()),
                                          pa.array(np.concatenate([total[c, at], n.astype(float)]))], names=["c", "at", "s"])

    part = vectors.filter(F.col("batch") == batch).select("at", "w").mapInArrow(sums, "c long, at long, s double").groupBy("c", "at").agg(F.sum("s").alias("s"))
    total, n = np.zeros_like(centres), np.zeros(len(centres))
    for r in part.collect():  # at most k x (max_features + 1)
        if r["at"] < 0:
            n[r["c"]] = r["s"]
        else:
            total[r["c"], r["at"]] = r["s"]
    after = counts + n
    moved = n > 0
    centres = centres.copy()
    centres[moved] = (centres[moved] * counts[moved, None] + total[moved]) / after[moved, None]
    return centres, after


def fit_centres(vectors: DataFrame, k: int, n_features: int) -> np.ndarray:
    centres = seed_centres(vectors, k, n_features)
    counts = np.zeros(len(centres))
    for batch in range(BATCHES if len(centres) else 0):
        centres, counts = move_centres(vectors, centres, counts, batch)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, id_col: str) -> DataFrame:
    """(id_col, cluster_id, cluster_confidence): the nearest centre and how clearly it is the nearest."""
    norms = (centres ** 2).sum(1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(b.column(1), b.column(2), centres, norms)
                low, high = d.min(1), d.max(1)
                sure = np.where(high <= 0, 1.0, np.clip(1 - low / (high + 1e-6), 0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(1), pa.int32()), pa.array(sure)], names=[id_col, "cluster_id", "cluster_confidence"])

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "at", "w").mapInArrow(near, f"{id_col} {kind}, cluster_id int, cluster_confidence double")


def kmeans_texts(docs: DataFrame, id_col: str, text_col: str, max_features: int, n_clusters: int = 0, min_cluster_size: int = 3, **kw) -> DataFrame:
    """(id_col, cluster_id, cluster_confidence) of every row; null and 0.0 if there are too few rows to cluster."""
    k = features.auto_k(docs.count(), n_clusters, min_cluster_size)
    if k is None:
        return docs.select(id_col, F.lit(None).cast("int").alias("cluster_id"), F.lit(0.0).alias("cluster_confidence"))
    vectors = text_vectors(docs, id_col, text_col, max_features, **kw)
    n_features = (vectors.agg(F.max(F.array_max("at"))).first()[0] or 0) + 1
    return assign(vectors, fit_centres(vectors, k, n_features), id_col)
