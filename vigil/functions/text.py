"""Text cleaning as built-in column expressions (no Python UDFs).

Every function takes and returns a ``Column`` so the whole cleaning chain
runs inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from html.entities import html5
from operator import and_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vigil.params import LANGUAGE_PROFILES, TOKEN_PATTERN

# Unicode whitespace as Python's str.isspace sees it (Java's plain \s is ASCII).
WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"
# Line boundaries as Python's str.splitlines sees them.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# The characters of ``WS``, and runs of line boundaries (where empty lines don't matter; single characters are looked up by bit).
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS = r"[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]+"

# Markup removal, applied in this order. Blocks whose text is not page text
# (comments, scripts, styles, declarations) go first so that a "</p>" inside
# a script string is never read as a tag.
_MARKUP_STEPS: list[tuple[str, str]] = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", " "),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", " "),
    (r"(?s)<![^>]*>", " "),
    (r"(?s)<\?[^>]*>", " "),
    (r"(?s)</?[A-Za-z][^>]*>", " "),
]
# Character references are decoded in one pass after tag removal, so "&amp;lt;" becomes "&lt;", by the rules of HTML 5: all of its names, the
# old ones also without a semicolon and with letters after them; numbers 128-159 stand for Windows-1252 characters, impossible
# numbers for U+FFFD, and numbers of non-characters for nothing.
NAMED_REFERENCES: dict[str, str] = dict(sorted(html5.items()))  # with their semicolons, where they need one
COMMON_REFERENCES = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;")  # looked up first
OLD_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))
LATIN_REFERENCES: dict[int, str] = {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {0x0D: "\r", 0x81: "\x81",
                                    0x8D: "\x8d", 0x8F: "\x8f", 0x90: "\x90", 0x9D: "\x9d"}
LETTERS = re.compile(r"[^\W\d_]+")  # letter runs, apart from numbers that are no digits
REFERENCE_PARTS = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"


def py_strip(c: Column) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def _literal_map(pairs: dict) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()]))


def _name_map(pairs: dict[str, str]) -> Column:
    """As one text literal: a literal per name would be walked by every rule of the planner."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def decode_references(c: Column) -> Column:
    """Named and numeric character references -> characters; unknown names stay."""
    common = _name_map({n: NAMED_REFERENCES[n] for n in COMMON_REFERENCES})
    named, latin = _name_map(NAMED_REFERENCES), _literal_map(LATIN_REFERENCES)

    def character(digits: Column, base: int) -> Column:
        short = F.regexp_replace(F.rtrim(digits, F.lit(";")), "^0+(?=.)", "")
        code = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("long"))
        wrong = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        none = code.between(1, 8) | code.between(0x0E, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0x0B) | (code % 65536 >= 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(wrong, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(latin, code.cast("int")), F.when(none, F.lit("")), plain))

    def by_name(name: Column) -> Column:
        old = F.regexp_extract(name, f"^(?:{OLD_NAMES})", 0)
        longest = F.when(old != "", F.concat(F.try_element_at(named, old), F.substring(name, F.length(old) + 1, F.length(name))))
        return F.coalesce(F.try_element_at(common, name), F.try_element_at(named, name), longest, F.concat(F.lit("&"), name))

    def decoded(part: Column) -> Column:
        rest = F.substring(part, F.lit(3), F.length(part))
        return F.when(~part.startswith("&") | (part == "&"), part) \
            .when(part.rlike("^&#[xX][0-9A-Fa-f]"), character(F.substring(part, F.lit(4), F.length(part)), 16)) \
            .when(part.rlike("^&#[0-9]"), character(rest, 10)) \
            .otherwise(by_name(F.substring(part, F.lit(2), F.length(part))))

    parts = F.regexp_extract_all(c, F.lit(REFERENCE_PARTS), 0)
    return F.when(c.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def strip_html(c: Column) -> Column:
    """Visible text of an HTML document; text without ``<``/``>`` is returned as is."""
    x = c
    for pattern, repl in _MARKUP_STEPS:
        x = F.regexp_replace(x, pattern, repl)
    # bound once: the decoder reads its text in three places
    x = F.transform(F.array(x), decode_references)[0]
    has_markup = c.contains("<") | c.contains(">")
    return F.when(has_markup, x).otherwise(c)


def noise_regex(patterns: Sequence[str]) -> str:
    """One case-insensitive search pattern matching when any of ``patterns`` matches."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def remove_noise_lines(c: Column, patterns: Sequence[str]) -> Column:
    """Drop blank lines and lines matching any pattern (case-insensitive search).

    Each line is stripped once, then tested against one combined pattern
    (patterns must not use numbered back-references). Patterns that begin
    with ``^`` are tried at the line's first place only, not at every one.
    """
    if not patterns:
        return c
    stripped = F.transform(F.split(c, LINE_BREAKS), lambda line: F.btrim(line, F.lit(WS_CHARS)))
    at_start = [p for p in patterns if re.match(r"\^[^|*+?{]*$", p)]
    loose = [p for p in patterns if p not in at_start]
    tests = [noise_regex(loose)] if loose else []
    if at_start:
        tests.append("(?i)^(?:" + "|".join(f"(?:{p[1:]})" for p in at_start) + ")")
    kept = F.filter(stripped, lambda line: reduce(and_, [~line.rlike(t) for t in tests], line != F.lit("")))
    return F.array_join(kept, "\n")


def normalize_whitespace(c: Column) -> Column:
    """NUL -> space, runs of Unicode whitespace -> one space, trimmed."""
    x = F.replace(c, F.lit("\u0000"), F.lit(" "))
    x = F.regexp_replace(x, rf"{WS}{{2,}}|(?! ){WS}", " ")  # a single space stays as it is
    return F.btrim(x, F.lit(" "))


def clean_text(c: Column, noise_patterns: Sequence[str] = ()) -> Column:
    """HTML strip -> noise-line removal -> whitespace normalisation."""
    return normalize_whitespace(remove_noise_lines(strip_html(c), noise_patterns))


def tokenize(c: Column, min_token_length: int = 2) -> Column:
    """IOC-friendly ASCII tokens, shorter ones dropped when the minimum is above 1."""
    least = f"{{{max(min_token_length, 1) - 1},}}"  # a token is all of a run from its first letter or digit on
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN.removesuffix("*") + least), 0)


def language_counts(text: Column, profiles: Iterable[tuple[str, list[str]]] = LANGUAGE_PROFILES) -> list[tuple[str, Column]]:
    """Per language: number of words (maximal letter runs, lower-cased) found in its profile."""
    profiles = list(profiles)
    counts = language_count_struct(text, profiles)
    return [(lang, counts[lang]) for lang, _ in profiles]


def _bounded(words: Iterable[str]) -> str:
    return rf"(?<!\p{{L}})(?:{'|'.join(sorted(words, key=len, reverse=True))})(?!\p{{L}})"


def language_count_struct(text: Column, profiles: Sequence[tuple[str, list[str]]] = LANGUAGE_PROFILES) -> Column:
    """struct<lang: count> of profile hits; select it as its own column before ``language_from_counts``
    so each regex scan runs once (CASE branches are outside common-subexpression elimination).

    Profiles of words of letters only share one scan: it takes the text's letter runs, those that stand in any profile are kept and then dealt out; a
    profile with anything else in it (its hits could overlap another's) is scanned for by itself.
    """
    lt = F.lower(text)
    plain = [lang for lang, ws in profiles if ws and all(w.isalpha() for w in ws)]
    every = {w for lang, ws in profiles if lang in plain for w in ws}

    def scan(words) -> Column:
        return F.regexp_extract_all(lt, F.lit(_bounded(words)), 0)

    if len(plain) < 2:
        return F.struct(*[F.size(scan(ws)).alias(lang) for lang, ws in profiles])
    def held(found: Column, words) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*words)))

    runs = F.regexp_extract_all(lt, F.lit(r"\p{L}+"), 0)
    found = F.transform(F.array(F.filter(runs, lambda w: w.isin(*sorted(every)))), lambda f: F.struct(*[held(f, ws).alias(lang) for lang, ws in profiles if lang in plain]))[0]
    if len(plain) == len(profiles):
        return found
    return F.struct(*[(found[lang] if lang in plain else F.size(scan(ws))).alias(lang) for lang, ws in profiles])


def profile_hits(profiles: Sequence[tuple[str, Sequence[str]]]):
    """Arrow function: lower-cased texts -> the struct of ``language_count_struct``, for profiles of words of letters only.

    The letter runs of a text are counted as they are found; the built-in expressions make a list of them and look at it once for each profile.
    """
    words = [tuple(dict.fromkeys(ws)) for _, ws in profiles]
    every = frozenset(w for ws in words for w in ws)
    kind = StructType([StructField(lang, IntegerType()) for lang, _ in profiles])

    def hits(texts: pa.Array) -> pa.Array:
        found = [None if t is None else Counter(filter(every.__contains__, _letter_runs(t))) for t in texts.to_pylist()]
        rows = [[None if c is None else sum(c.get(w, 0) for w in ws) for ws in words] for c in found]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(len(words))], names=kind.names)

    hits.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hits, kind)


def _letter_runs(text: str) -> list[str]:
    found = LETTERS.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in text).split(" ")  # numbers such as \u00bd end a run


def profile_counts(text: Column, profiles: Sequence[tuple[str, Sequence[str]]] = LANGUAGE_PROFILES) -> Column:
    """``language_count_struct``, by ``profile_hits`` where all words are of letters only."""
    if profiles and all(ws and all(w.isalpha() for w in ws) for _, ws in profiles):
        return profile_hits(profiles)(F.lower(text))
    return language_count_struct(text, profiles)


def language_from_counts(counts_col: Column, profiles: Sequence[tuple[str, list[str]]] = LANGUAGE_PROFILES) -> Column:
    """struct(language, confidence) from a ``language_count_struct`` column."""
    return _pick_language([(lang, counts_col[lang]) for lang, _ in profiles])


def detect_language(text: Column, profiles: Sequence[tuple[str, list[str]]] = LANGUAGE_PROFILES) -> Column:
    """struct(language, confidence): the profile with most word hits and its share of all hits.

    No hit at all gives ("unknown", 0.0); ties go to the earlier profile.
    """
    return _pick_language(language_counts(text, profiles))


def _pick_language(counts: list[tuple[str, Column]]) -> Column:
    total = sum((cnt for _, cnt in counts), F.lit(0))
    best = F.greatest(*[cnt for _, cnt in counts]) if len(counts) > 1 else counts[0][1]
    lang = F.when(best <= 0, F.lit("unknown"))
    for name, cnt in counts:
        lang = lang.when(cnt == best, F.lit(name))
    conf = F.when(best <= 0, F.lit(0.0)).otherwise(best / total)
    return F.struct(lang.alias("language"), conf.cast("double").alias("confidence"))
