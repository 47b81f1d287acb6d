"""Quality rules by repetition coverage: how much of a text stands inside repeated word windows and lines.

Per document, in numpy: rolling hashes of windows of several lengths; a window found twice or more marks its
words; coverage is the share of the words' characters that are marked. Repeated lines are measured likewise. The
base rules count words, word characters, symbols, repeated lines and words in repeated 8-word windows.

One narrow pass over the texts, no shuffle; a task holds one Arrow batch. Null and empty texts have no words and fail
the base rules; equality is on bytes, case included; every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow import batch
from vigil.llm.words import WordHashes, window_hashes, word_hashes

BASE_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# largest share of word characters inside repeated windows, by window length, and inside repeated lines
MAX_COVERAGE = {5: 0.30, 6: 0.28, 8: 0.26, 10: 0.25}
MAX_LINE_COVERAGE = 0.30
MAX_SYMBOL_SHARE = 0.10  # symbols per word character

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LATER = np.zeros(256, bool)  # UTF-8 continuation bytes: not the first of a character
_LATER[0x80:0xC0] = True

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in MAX_COVERAGE))
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("line_coverage", pa.float64()), *[(f"coverage_{n}", pa.float64()) for n in MAX_COVERAGE]])


def repeated_words(h: np.ndarray, n: int) -> np.ndarray:
    """Marks the words in ``n``-word windows that are found twice or more."""
    marked = np.zeros(len(h), bool)
    w = window_hashes(h, n)
    if len(w) < 2:
        return marked
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return marked
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(data: bytes, hashes: WordHashes) -> dict:
    a = np.frombuffer(data, np.uint8)
    words = data.split()
    space, counted = _SPACE[a], ~_LATER[a]
    chars = int((counted & ~space).sum())
    h = hashes.of(words)
    # characters of each word: differences of the running character count at word starts and ends
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    upto = np.concatenate(([0], np.cumsum(counted)))
    lengths = upto[np.flatnonzero(edge == 1)] - upto[np.flatnonzero(edge == -1)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    again, again_chars = 0, 0
    if len(set(lines)) < len(lines):
        for x in lines:
            if x in seen:
                again += 1
                again_chars += sum(map(len, x.decode("utf-8", "replace").split()))
            seen.add(x)
    n_repeat = int(repeated_words(h, BASE_WINDOW).sum())
    cover, alive = {}, True
    for n in MAX_COVERAGE:
        share = 0.0
        if alive and chars:
            share = float(lengths[repeated_words(h, n)].sum()) / chars
            alive = share > 0  # no repeated window of this length: none of a greater length
        cover[f"coverage_{n}"] = share
    n_symbols = int(_SYMBOL[a].sum())
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    line_cover = again_chars / chars if chars else 0.0
    fine = (line_cover <= MAX_LINE_COVERAGE and n_symbols <= MAX_SYMBOL_SHARE * chars
            and all(cover[f"coverage_{n}"] <= most for n, most in MAX_COVERAGE.items()))
    return {"n_words": len(words), "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": again, "n_repeat_words": n_repeat,
            "base_failed": base_failed, "kept": not base_failed and fine, "line_coverage": line_cover, **cover}


def repetition_quality(docs: DataFrame) -> DataFrame:
    def run(batches):
        hashes = word_hashes()
        for b in batches:
            rows = [measure(x or b"", hashes) for x in b.column("text").to_pylist()]
            yield batch(_ARROW, doc_id=b.column("doc_id"), **{f.name: [r[f.name] for r in rows] for f in _ARROW if f.name != "doc_id"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
