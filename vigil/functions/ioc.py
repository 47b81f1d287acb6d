"""Indicator-of-compromise extraction and normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.text import py_strip
from vigil.params import IOC_PATTERNS, PUBLIC_SUFFIXES

IOC_TYPES = [name for name, _ in IOC_PATTERNS]
HASH_TYPES = ("md5", "sha1", "sha256")


# What every match of a type holds. One look for it is cheaper than the pattern's own try at each word, and most texts fail it. The types
# of a hash share one.
NEEDED = {"ipv4": r"\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}", "email": "@", "url": "://", "domain": r"\.[A-Za-z]{2}", **dict.fromkeys(HASH_TYPES, "[a-fA-F0-9]{32}")}


def java_pattern(pattern: str) -> str:
    """Unicode-aware form: Java's \\b and \\d are ASCII-only without (?U)."""
    return "(?U)" + pattern


def extract_type(text: Column, ioc_type: str) -> Column:
    """Distinct matches of one indicator type in ``text``."""
    return F.when(may_hold(text, NEEDED[ioc_type]), matches(text, ioc_type)).otherwise(F.array().cast("array<string>"))


def may_hold(text: Column, need: str) -> Column:
    return text.isNull() | (text.contains(need) if need in ("@", "://") else text.rlike(need))


def matches(text: Column, ioc_type: str) -> Column:
    """``extract_type`` without a look for what a match needs."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(java_pattern(dict(IOC_PATTERNS)[ioc_type])), 0))


def extract_all(text: Column, types: Sequence[str] = IOC_TYPES) -> Column:
    """array<struct<ioc_type, value>> of every type's distinct matches."""
    def tagger(t):
        return lambda v: F.named_struct(F.lit("ioc_type"), F.lit(t), F.lit("value"), v)

    parts = []
    for need, same in groupby(types, NEEDED.get):  # one look for neighbours that need the same
        found = [F.transform(matches(text, t), tagger(t)) for t in same]
        hit = F.concat(*found) if len(found) > 1 else found[0]
        parts.append(F.when(may_hold(text, need), hit).otherwise(F.array().cast("array<struct<ioc_type:string,value:string>>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def normalize_domain(d: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Registrable domain (label before the longest known public suffix), lower-cased.

    ``suffixes`` is a public suffix list: plain names, wildcards (``*.ck``: any label before ``ck`` is part of the suffix) and
    exceptions to them (``!www.ck``). Without a known suffix, or when the whole name is a suffix, the lower-cased
    input is returned. Pure expression: the list is an in-set lookup.
    """
    plain = [s for s in suffixes if s[:2] != "*." and s[:1] != "!"]
    wild = [s[2:] for s in suffixes if s[:2] == "*."]
    spared = [s[1:] for s in suffixes if s[:1] == "!"]
    low = F.lower(d)
    labels = F.split(low, r"\.")
    n = F.size(labels)

    def tail(i) -> Column:
        return F.array_join(F.slice(labels, i, n), ".")

    def is_suffix(i) -> Column:
        hit = tail(i).isin(*plain)
        if wild:
            hit = hit | ((i < n) & tail(i + 1).isin(*wild))
        if spared:  # what follows an exception's first label is the suffix
            hit = (hit & ~tail(i).isin(*spared)) | ((i > 1) & tail(F.greatest(i - 1, F.lit(1))).isin(*spared))
        return hit

    # Candidate start positions 2..n (1-based); the first hit is the longest suffix.
    starts = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: (i <= n) & is_suffix(i))
    first = F.try_element_at(starts, F.lit(1))
    registrable = F.concat_ws(".", F.try_element_at(labels, first - 1), F.array_join(F.slice(labels, first, n), "."))
    return F.when(first.isNull() | is_suffix(F.lit(1)), low).otherwise(registrable)


def normalize_ioc(ioc_type: Column, value: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Per-type normal form: domains registrable+lower, urls/emails/hashes strip+lower, rest strip."""
    stripped = py_strip(value)
    return (F.when(ioc_type == "domain", normalize_domain(value, suffixes))
            .when(ioc_type.isin("url", "email", *HASH_TYPES), F.lower(stripped))
            .otherwise(stripped))


def context_expr(text_col: str, value_col: str, window: int = 40) -> Column:
    """SQL-expression form of the context snippet (``instr`` takes columns there)."""
    pos = f"instr({text_col}, {value_col})"
    start0 = f"greatest({pos} - 1 - {window}, 0)"
    end0 = f"least({pos} - 1 + char_length({value_col}) + {window}, char_length({text_col}))"
    snippet = f"substring({text_col}, {start0} + 1, {end0} - {start0})"
    return F.when(F.expr(pos) == 0, F.lit("")).otherwise(py_strip(F.expr(snippet)))
