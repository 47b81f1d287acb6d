"""Keyword-rule classifiers as column expressions (no join, no shuffle)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.params import MITRE_TACTICS

# Word-character class shared by the whole-word keyword rule (Python's \w).
WORD = r"[\p{L}\p{N}_]"


def _kw_array(keywords: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")


def trie_pattern(keywords: Sequence[str]) -> str:
    """One pattern that matches, at any place, the longest of the keywords that begin there.

    Keywords share their beginnings, so a place of a text costs the letters it has in common with some keyword, not the number
    of keywords.
    """
    root: dict = {}
    for k in keywords:
        node = root
        for ch in k:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        branches = [re.escape(ch) + pattern(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        first = "(?=[" + "".join(re.escape(ch) for ch in sorted(node) if ch) + "])" if len(branches) > 3 else ""  # one look at the letter
        return f"(?:{first}(?:" + "|".join(branches) + "))" + ("?" if ends else "")

    return pattern(root)


FEW = 100  # up to so many keywords, a plain search for each is faster than one pattern's look at every place


def plain_search(keywords: Sequence[str]):
    """Arrow function: lower-cased texts (UTF-8 bytes) -> those of ``keywords`` that stand in each. Python's search of bytes skips ahead by a
    keyword's length where it can; the built-in ``contains`` tries every place and takes twice as long, transfer counted.
    """
    wanted = [(k, k.encode()) for k in keywords]

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[k for k, raw in wanted if raw in t] if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(found, "array<string>")


def found_keywords(lower_text: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords that stand in the text, at least the longest of those that begin at one place; overlapping ones are all found."""
    kws = sorted({k for k in keywords if k})
    if not kws:
        return F.array().cast("array<string>")
    if len(kws) <= FEW:
        return plain_search(kws)(lower_text.cast("binary"))
    return F.array_distinct(F.regexp_extract_all(lower_text, F.lit(f"(?s)(?=({trie_pattern(kws)}))"), 1))


def _held(found: Column, keywords: Sequence[str]) -> Column:
    """The keywords (in configured order) that begin one of the found ones; an empty keyword stands in any text."""
    return F.filter(_kw_array([k.lower() for k in keywords]), lambda k: F.when(k == "", found.isNotNull()).otherwise(F.exists(found, lambda f: f.startswith(k))))


def keyword_matches(lower_text: Column, keywords: Sequence[str]) -> Column:
    """Keywords (in configured order) that occur as substrings of the lower-cased text."""
    found = found_keywords(lower_text, [k.lower() for k in keywords])
    return F.transform(F.array(found), lambda f: _held(f, keywords))[0]


def keyword_match_struct(text: Column, label_keywords: Mapping[str, Sequence[str]]) -> Column:
    """struct<label_i: matched keywords> (configured order) of all labels, from one scan of the text; to be selected as its own column."""
    found = found_keywords(F.lower(text), [k.lower() for kws in label_keywords.values() for k in kws])
    return F.transform(F.array(found), lambda f: F.struct(*[_held(f, kws).alias(f"m{i}") for i, kws in enumerate(label_keywords.values())]))[0]


def classify_from_matches(matches_col: Column, label_keywords: Mapping[str, Sequence[str]], min_confidence: float) -> Column:
    """The keyword classifier's struct(label, confidence, explanation) from ``keyword_match_struct``."""
    labels = list(label_keywords.items())
    matches = [matches_col[f"m{i}"] for i in range(len(labels))]
    return _classify(labels, matches, min_confidence)


def keyword_classify(text: Column, label_keywords: Mapping[str, Sequence[str]], min_confidence: float) -> Column:
    """struct(label, confidence, explanation) of the keyword classifier.

    Score per label = matched keywords / keywords. The first label (configured
    order) with the highest positive score wins; below ``min_confidence`` the
    label is "unknown" and the explanation empty, the confidence is kept.
    """
    if not label_keywords:
        return F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"),
                        F.array().cast("array<string>").alias("explanation"))
    labels = list(label_keywords.items())
    matches = keyword_match_struct(text, label_keywords)
    return _classify(labels, [matches[f"m{i}"] for i in range(len(labels))], min_confidence)


def _classify(labels, matches, min_confidence: float) -> Column:
    scores = [F.size(m) / F.lit(float(max(len(kws), 1))) for m, (_, kws) in zip(matches, labels)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    label = F.when(best <= 0, F.lit("unknown"))
    expl = F.when(best <= 0, F.array().cast("array<string>"))
    for (name, _), s, m in zip(labels, scores, matches):
        label = label.when(s == best, F.lit(name))
        expl = expl.when(s == best, F.slice(m, 1, 5))
    ok = best >= F.lit(float(min_confidence))
    return F.struct(
        F.when(ok, label).otherwise(F.lit("unknown")).alias("label"),
        best.cast("double").alias("confidence"),
        F.when(ok, expl).otherwise(F.array().cast("array<string>")).alias("explanation"),
    )


def mitre_tactics(text: Column, tactics: Sequence[tuple[str, Sequence[str]]] = MITRE_TACTICS) -> Column:
    """Ordered tactics whose keywords occur in the lower-cased text, from one scan of it."""
    found = found_keywords(F.lower(text), [k for _, kws in tactics for k in kws])
    hit = F.transform(F.array(found), lambda f: F.array(*[F.when(F.size(_held(f, kws)) > 0, F.lit(tactic)) for tactic, kws in tactics]))[0]
    return F.array_compact(hit)


def merge_keywords(primary: Mapping[str, Sequence[str]], extra: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Ordered union of two keyword maps by label (labels in alphabetical order); of spellings that differ in case the first stays."""
    def union(label: str) -> list[str]:
        spelling: dict[str, str] = {}
        for keyword in (*primary.get(label, ()), *extra.get(label, ())):
            spelling.setdefault(keyword.lower(), keyword)
        return list(spelling.values())

    return {label: union(label) for label in sorted(primary.keys() | extra.keys())}


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Number of distinct (lower-cased, stripped) keywords hit by the text."""
    return keyword_hits_by_label(text, {"": keywords})[0]


def keyword_hits_by_label(text: Column, label_keywords: Mapping[str, Sequence[str]]) -> Column:
    """Per label (in configured order) the number of its distinct (lower-cased, stripped) keywords hit by the text.

    Alphanumeric keywords count as whole words: one scan with the keywords of all labels finds every such occurrence (word boundaries as
    look-arounds); other keywords count as substrings, found by one scan as well.
    """
    cleaned = [list(dict.fromkeys(k.lower().strip() for k in kws if k.strip())) for kws in label_keywords.values()]
    every = list(dict.fromkeys(k for kws in cleaned for k in kws))
    words = [k for k in every if re.fullmatch(r"[a-z0-9]+", k)]
    others = [k for k in every if k not in words]
    lt, none = F.lower(text), F.array().cast("array<string>")
    whole = F.array_distinct(F.regexp_extract_all(lt, F.lit(f"(?<!{WORD}){trie_pattern(words)}(?!{WORD})"), 0)) if words else none
    found = F.struct(whole.alias("whole"), found_keywords(lt, others).alias("parts"))

    def hits(f: Column, kws: list[str]) -> Column:
        own = [k for k in kws if k in words]
        count = F.size(F.array_intersect(f["whole"], _kw_array(own))) if own else F.lit(0)
        rest = [k for k in kws if k not in words]
        return count + (F.size(_held(f["parts"], rest)) if rest else F.lit(0))

    counts = F.transform(F.array(found), lambda f: F.array(*[hits(f, kws) for kws in cleaned]))[0]
    return F.when(text.isNull() | (text == ""), F.array(*[F.lit(0)] * len(cleaned))).otherwise(counts)
