"""Periodic runs of words: an online catcher of squares over power-of-two blocks.

Words are appended in chunks. When a block of ``L = 2**l`` words is complete, the catchers of its level take it up: each word that
completes a window of ``L`` words has that window compared with the two blocks that begin 2L to 4L words earlier (three for L = 1), so
every period p has one level. A square of period p >= 2L holds a whole block in its first half and the block's copy p words later, so
none is missed. A match opens a suffix comparison: it reaches to the left as far as the words agree at distance p, and each appended word
advances it to the right until one differs. As soon as the stretch is 2p words long it is a square; when it closes, it is a maximal
stretch of period p, and stretches of several periods over the same words merge into one run of the smallest.

Window names are 64-bit hashes of two half windows (a tree, not a polynomial, so words with an inner order such as Thue and Morse's
do not collide); equal words have equal numbers in a text. Extensions jump by powers of two. A text of n words takes O(n log n) time
and 8 n log n bytes; matches that continue the one a block before open nothing, so a text that is one word over and over opens two
comparisons a period only.

Cases: null and empty texts have no words and no runs; every row gives one row, repeated ids included; a null doc_id stays null; an empty table gives none; a very
long text is one row of an Arrow batch and is taken in chunks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow import batch, slices
from vigil.llm.words import MULTIPLIER, mix

MIN_LENGTH = 12
CHUNK = 1 << 15  # words appended at a time
PACK = 1 << 15  # words of several short texts in one stream
ROWS = 512  # rows of a batch held as Python words at a time


class Catchers:
    """Online square catching over a sequence of numbers; ``append`` and then ``finish``. No run is longer than ``longest``."""

    def __init__(self, longest: int) -> None:
        self.widest = max(1, longest // 4)  # a block in the first half of a square, at a period of two blocks or more
        self.names: list[np.ndarray] = []  # level l: names of all complete windows of 2**l
        self.start = np.empty(0, np.int64)  # open comparisons: the stretch begins here,
        self.period = np.empty(0, np.int64)  # repeats at this distance
        self.end = np.empty(0, np.int64)  # and agrees up to here
        self.closed: list[np.ndarray] = []  # (start, length, period) of maximal stretches of two periods or more

    def append(self, ids: np.ndarray) -> None:
        known = [len(x) for x in self.names]
        self._name(ids)
        self._advance()
        found = [c for level, x in enumerate(self.names) for c in self._catch(level, known[level] if level < len(known) else 0, len(x))]
        if found:
            block, period, end = (np.concatenate(c) for c in zip(*found, strict=True))
            self.start = np.concatenate([self.start, block - self._agree_before(block, period)])
            self.period = np.concatenate([self.period, period])
            self.end = np.concatenate([self.end, end])
            self._advance()

    def finish(self) -> np.ndarray:
        """Rows (start, length, period), sorted: every maximal stretch of two or more of its smallest period."""
        self._close(np.ones(len(self.start), bool))
        if not self.closed:
            return np.empty((0, 3), np.int64)
        x = np.concatenate(self.closed)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]  # of several periods of one stretch, the first is the smallest
        first = np.concatenate(([True], (x[1:, :2] != x[:-1, :2]).any(axis=1)))
        x = x[first]
        return x[np.lexsort((x[:, 2], x[:, 0]))]

    def _name(self, ids: np.ndarray) -> None:
        """Names of the windows that the new words complete."""
        if not self.names:
            self.names.append(np.empty(0, np.uint64))
        self.names[0] = np.concatenate([self.names[0], mix((ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)])
        n, level, width = len(self.names[0]), 1, 2
        while width <= min(n, self.widest):
            if level == len(self.names):
                self.names.append(np.empty(0, np.uint64))
            half, have, now = self.names[level - 1], len(self.names[level]), n - width + 1
            new = mix((half[have:now] * MULTIPLIER) ^ (half[have + width // 2:now + width // 2] + np.uint64(level)))
            self.names[level] = np.concatenate([self.names[level], new])
            level, width = level + 1, 2 * width

    def _catch(self, level: int, known: int, now: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(block, period, end) of windows known..now that equal a live block and do not continue the match one block before."""
        names, width = self.names[level], 1 << level
        for back in (2, 3) if level else (1, 2, 3):
            at = np.arange(max(known, back * width), now)
            if not len(at):
                continue
            block = ((at >> level) - back) << level
            hit = names[at] == names[block]
            at, block = at[hit], block[hit]
            goes_on = (block >= width) & (names[at - width] == names[np.maximum(block - width, 0)])
            at, block = at[~goes_on], block[~goes_on]
            if len(at):
                yield block, at - block, at + width

    def _agree_before(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before i agree with those ``period`` later."""
        at = i.copy()
        for level in self._steps():
            back = at - (1 << level)
            live = np.flatnonzero(back >= 0)
            while len(live):
                back = at[live] - (1 << level)
                ok = self.names[level][back] == self.names[level][back + period[live]]
                live, back = live[ok], back[ok]
                at[live] = back
                live = live[(back >= 1 << level) & (level == len(self.names) - 1)]  # on the top level again and again
        return i - at

    def _steps(self) -> range:
        return range(len(self.names) - 1, -1, -1)

    def _advance(self) -> None:
        """Open comparisons go on to the first word that differs or to the end of what is appended; those that ended close."""
        if not len(self.start):
            return
        n = len(self.names[0])
        for level in self._steps():
            live = np.flatnonzero(self.end + (1 << level) <= n)
            while len(live):
                end = self.end[live]
                ok = self.names[level][end] == self.names[level][end - self.period[live]]
                live = live[ok]
                self.end[live] += 1 << level
                live = live[(self.end[live] + (1 << level) <= n) & (level == len(self.names) - 1)]
        self._close(self.end < n)

    def _close(self, over: np.ndarray) -> None:
        square = over & (self.end - self.start >= 2 * self.period)
        if square.any():
            self.closed.append(np.stack([self.start[square], (self.end - self.start)[square], self.period[square]], axis=1))
        self.start, self.period, self.end = self.start[~over], self.period[~over], self.end[~over]


def runs_of_many(texts: list[list], min_length: int = MIN_LENGTH, chunk: int = CHUNK) -> list[np.ndarray]:
    """For each list of words the rows (start, length, period) of its runs of at least ``min_length`` words, by start, then period.

    Texts of like length follow each other in one stream of words, with a mark between them that no other word equals.
    """
    out = [np.empty((0, 3), np.int64)] * len(texts)
    waiting = sorted((k for k, w in enumerate(texts) if len(w) >= max(min_length, 2)), key=lambda k: len(texts[k]))
    while waiting:
        pack, n = [], 0
        while waiting and (not pack or n + len(texts[waiting[-1]]) < PACK):
            pack.append(waiting.pop())
            n += len(texts[pack[-1]]) + 1
        number = defaultdict(count().__next__)
        stream = [np.append(np.fromiter(map(number.__getitem__, texts[k]), np.int64, len(texts[k])), -1 - j) for j, k in enumerate(pack)]
        begins = np.cumsum([0, *map(len, stream)])
        ids = np.concatenate(stream)
        c = Catchers(len(texts[pack[0]]))
        for k in range(0, len(ids), chunk):
            c.append(ids[k:k + chunk])
        found = c.finish()
        found = found[found[:, 1] >= min_length]
        of = np.searchsorted(begins, found[:, 0], "right") - 1
        found[:, 0] -= begins[of]
        for j in np.unique(of):
            out[pack[j]] = found[of == j]
    return out


def runs_of(words: list, min_length: int = MIN_LENGTH, chunk: int = CHUNK) -> np.ndarray:
    return runs_of_many([words], min_length, chunk)[0]


def repeats(n: int, found: np.ndarray) -> np.ndarray:
    """Marks the words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def plant(words: list, doc_id: int | None) -> list:
    """The stated test input: in a tenth of the documents, by the checksum of the id, the words from some place on repeat. A null id: as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs by start, then period, and the text without the words that a run repeats."""
    def run(batches):
        for b in slices(batches, ROWS):
            ids, texts = b.column(0).to_pylist(), b.column(1)
            out = {f.name: [] for f in _ARROW}
            split = [(x or b"").split() for x in texts.to_pylist()]
            if planted:
                split = list(map(plant, split, ids))
            for doc_id, words, found in zip(ids, split, runs_of_many(split, min_length), strict=True):
                kept = compress(words, ~repeats(len(words), found)) if len(found) else words
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                out["collapsed"].append(b" ".join(kept).decode("utf-8", "replace"))
            yield batch(_ARROW, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def run_digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    x = found.withColumn("longest", longest)
    length = -F.col("longest.n")
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), F.col("longest.period").alias("period"),
                    F.floor(1000 * length / F.col("longest.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))
