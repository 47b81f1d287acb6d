"""Token ids of whole texts by a tokenizer file, with the ids of recurring units kept between texts.

A byte-pair tokenizer first cuts a text into pre-tokens that never reach across certain places. Between two such places the ids
depend on the characters there alone, so a unit's ids are computed once by the tokenizers library and kept in a bounded cache of the
worker process; a group of texts is cut into units, its distinct units are looked up, and the ids are gathered in numpy.

* word tokenizers (white space dropped by the pre-tokenizer): units stand between blanks and line feeds;
* byte-level tokenizers: a unit starts before a single blank between two non-blank characters, and at a single
  line feed between two such characters; other white space stays inside a unit;
* any other tokenizer file, and texts that hold a special token's string: whole texts are encoded.

A unit of Latin letters alone is one pre-token, so the file's model is applied to it without the normalizer and the
pre-tokenizer, which would change nothing there and cost most of the time.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigil.llm.worker import keep

MAX_CACHED = 350_000  # units
GROUP_CHARS = 16_000_000  # characters of the texts that are looked up together
CALL_UNITS = 20_000  # units of one call to the tokenizer, which needs a few hundred bytes a token meanwhile
CLOSING = ".,;:!?"
PLAIN = "\u0001"  # marks a unit that has no blank before it

# a blank or a line feed that stands alone between two characters that aren't white space
_BYTE_UNITS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SPACED = 1  # stands for the letter of a blank in front of a unit


def _byte_letters() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...; here blanks only part units."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = np.arange(256, dtype="<u2")
    letters[[x for x in range(256) if x not in own]] = 256 + np.arange(256 - len(own))
    letters[SPACED], letters[ord(" ")] = letters[ord(" ")], ord(" ")
    return letters


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of every run in turn."""
    before = np.cumsum(size, dtype=np.int32) - size
    return np.arange(int(size.sum()), dtype=np.int32) + np.repeat(first - before, size)


class Units:
    """unit -> its run of ids in one table. When full, it keeps the units of the group at hand and goes on."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.first = np.zeros(1024, np.int32)
        self.size = np.zeros(1024, np.int32)
        self.table = np.zeros(4096, "<u4")
        self.used = 0

    def add(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.at), len(units)
        while n + k > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.table):
            self.table = np.resize(self.table, 2 * len(self.table))
        self.first[n:n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + k] = sizes
        self.table[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.at.update(zip(units, range(n, n + k), strict=True))

    def find(self, units: list[str]) -> np.ndarray:
        get = self.at.get
        return np.array([get(u, -1) for u in units], np.int32)

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.table[_runs(self.first[at], self.size[at])]

    def keep(self, units: list[str], at: np.ndarray) -> None:
        kept = [u for u, k in zip(units, at.tolist(), strict=True) if k >= 0]
        at = at[at >= 0]
        ids, sizes = self.ids(at), self.size[at]
        self.__init__()
        self.add(kept, ids, sizes)


class Encoder:
    """``ids(texts)`` for the tokenizer file at ``path``, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        parts = pre.get("pretokenizers", [])
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.kind = "byte"
        elif parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") \
                and parts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") and spec["model"].get("end_of_word_suffix") \
                and any(n.get("type") == "Lowercase" for n in (normal or {}).get("normalizers", [])):
            self.kind = "word"
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters = _byte_letters()
        # byte-level: a token that starts with a blank's letter starts a spaced unit; words: a token with the end mark ends one
        vocabulary = self.tokenizer.get_vocab()
        self.edges = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edges[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.kind == "byte" else t.endswith("</w>"))]] = True
        self.units = Units()
        mark = "" if self.kind == "word" else PLAIN
        self.marks = [mark + c for c in CLOSING]
        self.letters_only = f"^[{_LATIN}]+$"
        self.closed = f"^[{_LATIN}]+[{CLOSING}]$"
        self.plain_only = f"^{PLAIN}[{_LATIN}]+$"
        self.blank = vocabulary.get("Ġ") if self.kind == "byte" else None

    # units -> ids ---------------------------------------------------------

    def _full(self, units: list[str]) -> None:
        """By the whole tokenizer, each unit as it stands in a text."""
        for k in range(0, len(units), CALL_UNITS):
            self._full_call(units[k:k + CALL_UNITS])

    def _full_call(self, units: list[str]) -> None:
        raw = units if self.kind == "word" else [u[1:] if u[:1] == PLAIN else u if u == "\n" else " " + u for u in units]
        got = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
        self.units.add(units, np.frombuffer(b"".join(got), "<u4"), np.array([len(x) for x in got], np.int64))

    def _letters(self, units: list[str]) -> None:
        """Units of Latin letters (byte-level: after a blank) by the model alone, many in one call."""
        for k in range(0, len(units), CALL_UNITS):
            self._letters_call(units[k:k + CALL_UNITS])

    def _letters_call(self, units: list[str]) -> None:
        joined = " ".join(units).lower() if self.kind == "word" else chr(SPACED) + f" {chr(SPACED)}".join(units)
        joined = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        edge = np.flatnonzero(self.edges[ids])
        if len(edge) != len(units):
            self._full(units)
            return
        sizes = np.diff(np.append(edge, len(ids))) if self.kind == "byte" else np.diff(np.concatenate(([-1], edge)))
        self.units.add(units, ids, sizes)

    def _plain_call(self, units: list[str]) -> None:
        """Byte-level units of Latin letters without a blank before them; a lone blank's letter parts them."""
        joined = f" {chr(SPACED)} ".join(u[1:] for u in units)
        joined = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        parts = ids == self.blank
        if int(parts.sum()) != len(units) - 1:
            self._full(units)
            return
        sizes = np.diff(np.concatenate(([-1], np.flatnonzero(parts), [len(ids)]))) - 1
        self.units.add(units, ids[~parts], sizes)

    def _lookup(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct units in the table; what is new is encoded in a few calls."""
        names = distinct.to_pylist()
        at = self.units.find(names)
        if len(miss := np.flatnonzero(at < 0)):
            if full := len(self.units.at) + 2 * len(miss) > MAX_CACHED:
                self.units.keep(names, at)
            new = distinct.take(pa.array(miss))
            plain = pc.match_substring_regex(new, self.letters_only).to_numpy(zero_copy_only=False)
            closed = pc.match_substring_regex(new, self.closed).to_numpy(zero_copy_only=False)
            letters, marked = new.filter(pa.array(plain)).to_pylist(), new.filter(pa.array(closed)).to_pylist()
            stems = {u[:-1] for u in marked}.difference(letters)
            letters += [u for u in stems if u not in self.units.at]
            rest = new.filter(pa.array(~plain & ~closed))
            if self.blank is not None:
                first = pc.match_substring_regex(rest, self.plain_only).to_numpy(zero_copy_only=False)
                starts, rest = rest.filter(pa.array(first)).to_pylist(), rest.filter(pa.array(~first))
                for k in range(0, len(starts), CALL_UNITS):
                    self._plain_call(starts[k:k + CALL_UNITS])
            self._letters(letters)
            self._full([u for u in {*rest.to_pylist(), *self.marks} if u not in self.units.at])
            if marked:
                mark = "" if self.kind == "word" else PLAIN
                both = np.column_stack([self.units.find([u[:-1] for u in marked]), self.units.find([mark + u[-1] for u in marked])])
                self.units.add(marked, self.units.ids(both.reshape(-1)), self.units.size[both].sum(1))
            if full:
                at = self.units.find(names)
            else:
                at[miss] = self.units.find(new.to_pylist())
        return at

    # texts -> units -------------------------------------------------------

    def _regular(self, text: str) -> bool:
        """Single blanks and line feeds between other characters are all the white space there is."""
        flat = text.replace("\n", " ")
        return bool(flat) and flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "

    @staticmethod
    def _marked(unit: str) -> str:
        spaced = unit[0] == " " and len(unit) > 1 and unit[1] != PLAIN and not any(c.isspace() for c in unit[1:])
        return unit[1:] if spaced else unit if unit == "\n" else PLAIN + unit

    def _units(self, texts: list[str]) -> pa.ListArray:
        if self.kind == "word":
            return pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
        marked, odd = [], {}
        for k, t in enumerate(texts):
            if self._regular(t):
                marked.append(PLAIN + t.replace("\n", " \n " + PLAIN))
            else:
                marked.append("")
                odd[k] = [self._marked(u) for u in _BYTE_UNITS.split(t)] if t else []
        units = pc.split_pattern(pa.array(marked, pa.string()), " ")
        if not odd:
            return units
        rows = units.to_pylist()
        for k, u in odd.items():
            rows[k] = u
        return pa.array(rows, pa.list_(pa.string()))

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.kind == "whole":
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, "<u4")
            return
        units = self._units(texts)
        ends = units.offsets.to_numpy() - units.offsets[0].as_py()
        coded = units.flatten().dictionary_encode()
        del units  # each of these is as large as the texts
        at = self._lookup(coded.dictionary)[coded.indices.to_numpy()]
        del coded
        bounds = np.concatenate(([0], np.cumsum(self.units.size[at], dtype=np.int32)))[ends]
        ids = self.units.ids(at)
        del at
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:z]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as little-endian unsigned 32-bit integers."""
        group, chars = [], 0
        for t in texts:
            special = any(s in t for s in self.special)
            if group and (special or chars >= GROUP_CHARS):
                yield from self._group(group)
                group, chars = [], 0
            if special:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                group.append(t)
                chars += len(t)
        if group:
            yield from self._group(group)


def encoder(path: str) -> Encoder:
    """The worker process's encoder of a file; tasks of one worker share its cache."""
    return keep(("encoder", path), lambda: Encoder(path))
