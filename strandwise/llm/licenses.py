"""License scans: short notices, also slightly misspelt ones, and where they stand.

A text becomes its words (letters and digits, A-Z lower-cased, and all that is not ASCII),
one space apart, so that punctuation and line ends inside a notice do not matter. A notice
is a row of parts: some must stand exactly (a name, a version), each other part may have
one edit in twelve characters, at least one. A part with k edits allowed is cut into k + 1
pieces; at least one of them stands unchanged wherever the part does (pigeonhole), so the
pieces, found in one Aho-Corasick pass, give all candidates. Each candidate's surroundings
are matched by the ``regex`` library with the edits bounded; what it confirms is reported.

One pass over the texts, no shuffle; a task holds one slice of texts at a time.

Edge cases: null or empty text has no words, no places and score 0; a null ``doc_id`` and
repeated rows give a row each; columns besides ``doc_id`` and ``text`` are not read; an
empty table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: The three base notices, and notices of well-known licenses. Between bars
#: stands what must be exact.
BASE = [("mit", "under the| mit |license"), ("apache-2", "apache license version| 2"), ("cc-by-nc", "|cc by nc")]
NOTICES = [
    ("mit", "permission is hereby granted free of charge"),
    ("apache-2", "www apache org licenses license| 2 0"),
    ("agpl", "gnu affero general public license"),
    ("boost", "boost software license version| 1 0"),
    ("bsd", "under the| bsd |license"),
    ("bsd", "redistribution and use in source and binary"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "|cc by sa"),
    ("epl", "eclipse public license"),
    ("gpl", "gnu general public license"),
    ("isc", "with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "mozilla public license"),
    ("ofl", "sil open font license"),
    ("unlicense", "free and unencumbered software released"),
]

#: One edit is allowed in so many characters of a part. Notices are short on purpose: the
#: bounded-error match costs a multiple with each further edit.
PER_EDIT = 12
#: An exact part of so many characters is searched for itself.
RARE = 5

SPAN = "array<struct<label:string,word:long,n_words:long,edits:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"

_SPAN = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    base: bool
    edits: int
    pattern: regex.Pattern
    #: Per part its pieces, of which at least one stands in every match.
    pieces: tuple[tuple[str, ...], ...]
    #: The pieces of one part, with their places in the phrase.
    seeds: tuple[tuple[str, int], ...]


def _pieces(part: str, allowed: int) -> list[tuple[str, int]]:
    """``allowed + 1`` pieces of a part, with their places in it."""
    cuts = [len(part) * j // (allowed + 1) for j in range(allowed + 2)]
    return [(part[a:b], a) for a, b in zip(cuts, cuts[1:])]


def notice(label: str, marked: str, base: bool = False) -> Notice:
    pattern, parts, at, edits = "", [], 0, 0
    for i, part in enumerate(marked.split("|")):
        allowed = 0 if i % 2 else max(1, len(part) // PER_EDIT)
        if part:
            parts.append((part, at, allowed))
            pattern += f"(?:{part})" + (f"{{e<={allowed}}}" if allowed else "")
            edits += allowed
        at += len(part)
    cut = {p: _pieces(p[0], p[2]) for p in parts}
    whole = [p for p in parts if not p[2] and len(p[0]) >= RARE]
    part = max(whole or [p for p in parts if p[2]] or parts, key=lambda p: len(p[0]))
    seeds = tuple((piece, part[1] + a) for piece, a in cut[part])
    return Notice(label, marked.replace("|", ""), base, edits, regex.compile(f"(?b)(?<= ){pattern}(?= )"), tuple(tuple(piece for piece, _ in x) for x in cut.values()), seeds)


@functools.lru_cache(4)
def _search(notices: tuple[tuple[str, str, bool], ...]) -> tuple[list[Notice], ahocorasick.Automaton]:
    made = [notice(*x) for x in notices]
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(made):
        for piece, at in n.seeds:
            pieces.setdefault(piece, []).append((i, at))
    seeds = ahocorasick.Automaton()
    for piece, owners in pieces.items():
        seeds.add_word(piece, (len(piece), owners))
    seeds.make_automaton()
    return made, seeds


def words_text(data: bytes) -> tuple[str, int]:
    """The words of a text, one space apart and around, as Latin-1; and their number."""
    words = data.translate(_LETTERS).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


def scan(text: str, notices: list[Notice], seeds: ahocorasick.Automaton) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]]]:
    """Base places (label, offset) and confirmed spans (label, start, end, edits)."""
    exact: set[tuple[str, int]] = set()
    near: dict[int, list[list[int]]] = {}
    for end, (size, owners) in seeds.iter(text):
        for i, at in owners:
            n = notices[i]
            start = end + 1 - size - at
            if n.base and start > 0 and text.startswith(f" {n.phrase} ", start - 1):
                exact.add((n.label, start))
            # the piece may have moved by the edits before it, and the rest by those after
            low, high = max(0, start - n.edits - 1), start + len(n.phrase) + n.edits + 1
            windows = near.setdefault(i, [])
            if windows and low <= windows[-1][1]:
                windows[-1] = [min(low, windows[-1][0]), max(high, windows[-1][1])]
            else:
                windows.append([low, high])
    spans = []
    for i, windows in near.items():
        for low, high in windows:
            around = text[low:high]
            if not all(any(piece in around for piece in part) for part in notices[i].pieces):
                continue
            for m in notices[i].pattern.finditer(text, low, high):
                spans.append((notices[i].label, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(exact, key=lambda x: x[1]), sorted(spans, key=lambda x: (x[1], x[2], x[0]))


def _scan(notices: tuple[tuple[str, str, bool], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seeds = _search(notices)
        for s in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for i in range(len(s)):
                text, n_words = words_text(s.doc(i))
                base, spans = scan(text, made, seeds)
                places = [text.count(" ", 0, at) - 1 for _, at in base]
                found = [{"label": label, "word": text.count(" ", 0, a) - 1, "n_words": text.count(" ", a, b) + 1, "edits": e} for label, a, b, e in spans]
                own = sorted({label for label, _ in base})
                every = sorted({*own, *(x[0] for x in spans)})
                score = max([1.0 if base else 0.0, *(1 - e / max(1, b - a) for _, a, b, e in spans)])
                row = (n_words, len(base), min(places, default=None), max(places, default=None), ",".join(own), ",".join(every), max(0.0, score), found)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
            yield pa.RecordBatch.from_arrays([s.columns[0], *(pa.array(v, k) for v, k in zip(out, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: ``doc_id, n_words``; ``n_base`` places of the base notices, word
    for word, with the smallest and largest start as ``first_word`` and ``last_word``;
    ``base_labels``, ``labels`` (also of notices with edits), ``score`` (share of unedited
    characters of the best match) and ``spans`` (label, first word, words, edits)."""
    every = tuple((label, phrase, True) for label, phrase in base) + tuple((label, phrase, False) for label, phrase in notices)
    return docs.select("doc_id", "text").mapInArrow(_scan(every), SCHEMA)
