"""Licence notices in texts: exact phrases, and short notices with a few edits."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import regex
from pyspark.sql import DataFrame

from cohorta.llm.common import append_columns

# Lower-case ASCII letters, then words of letters, digits and all beyond ASCII.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    """A phrase of words, the label it stands for, and the edits allowed (0: exact only)."""

    phrase: str
    label: str
    edits: int = 0


# Phrases that count where their words stand consecutively.
BASE = (
    Notice("the mit license", "mit"),
    Notice("apache license version 2", "apache-2"),
    Notice("cc by nc", "cc-by-nc"),
)

# Short notices searched with errors, one edit for about twelve characters.
FUZZY = (
    Notice("the mit license", "mit", 1),
    Notice("apache license version 2", "apache-2", 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("mozilla public license", "mpl", 1),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
)


def normal_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def split_seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """Cut into edits + 1 pieces: a match with that many edits keeps one piece whole."""
    cuts = [len(phrase) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Seeds of all notices in one automaton; candidates verified with bounded errors."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = list(notices)
        self.seeds = ahocorasick.Automaton()
        for k, notice in enumerate(self.notices):
            for offset, piece in split_seeds(notice.phrase, notice.edits):
                places = self.seeds.get(piece, [])
                self.seeds.add_word(piece, [*places, (k, offset, len(piece))])
        if self.notices:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}") for n in self.notices]

    def spans(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in the blank-joined words, by start; non-overlapping per notice."""
        if not self.notices:
            return []
        starts: dict[int, set[int]] = {}
        for end, places in self.seeds.iter(line):
            for k, offset, size in places:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        found = []
        for k, places in starts.items():
            notice, done = self.notices[k], 0
            for place in sorted(places):
                low = max(done, place - notice.edits, 0)
                high = min(len(line), place + len(notice.phrase) + 2 * notice.edits)
                if high <= low:
                    continue
                match = self.patterns[k].search(line, low, high)
                if match:
                    found.append((match.start(), match.end(), k, sum(match.fuzzy_counts)))
                    done = match.end()
        return sorted(found)


def exact_places(line: str, phrase: str) -> list[int]:
    """Starts of a phrase of whole words in the blank-joined words, overlaps included."""
    padded, sought, places = f" {line} ", f" {phrase} ", []
    at = padded.find(sought)
    while at >= 0:
        places.append(at)
        at = padded.find(sought, at + 1)
    return places


def beyond_words(line: str, start: int, end: int) -> int:
    """Characters by which a span must grow to end where words do, on both sides."""
    left = right = 0
    if line[start] != " " and start:
        left = start - (line.rfind(" ", 0, start) + 1)
    if line[end - 1] != " " and end < len(line):
        stop = line.find(" ", end)
        right = (stop if stop >= 0 else len(line)) - end
    return left + right


def scan_texts(search: NoticeSearch, base: Sequence[Notice], texts: list) -> list[list]:
    out: list[list] = [[] for _ in range(8)]
    for text in texts:
        words = normal_words(text)
        line = " ".join(words)
        begins = list(accumulate((len(w) + 1 for w in words), initial=0))
        exact = [(bisect_right(begins, at) - 1, n.label) for n in base for at in exact_places(line, n.phrase)]
        spans, best = [], 0.0
        for start, end, k, edits in search.spans(line):
            notice = search.notices[k]
            # Letters of the same words around a match are edits, too: no notice inside longer words.
            edits += beyond_words(line, start, end) if end > start else 0
            if edits > notice.edits:
                continue
            first = bisect_right(begins, start) - 1 + (line[start] == " ")
            last = bisect_right(begins, max(start, end - 1)) - (line[end - 1] == " ")
            spans.append((first, max(last, first + 1), notice.label, edits))
            best = max(best, 1.0 - edits / len(notice.phrase))
        places = [at for at, _ in exact]
        labels = {label for _, label in exact}
        row = (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[2] for s in spans})),
            1.0 if places else best,
            [dict(zip(("first", "end", "label", "edits"), s)) for s in spans],
        )
        for column, value in zip(out, row):
            column.append(value)
    return out


def scan_licenses(
    df: DataFrame, text: str = "text", notices: Sequence[Notice] = FUZZY, base: Sequence[Notice] = BASE
) -> DataFrame:
    """Append licence findings to every row.

    ``n_base``, ``first_word`` and ``last_word`` count exact phrases; ``spans`` are
    the fuzzy matches as word ranges with their edits, to which the letters count that
    a match leaves over of its first and last word. Null and empty texts have no
    words, null first and last words, empty labels and score 0. Repeated phrases
    count at each place. Input columns named like a result are replaced.
    """
    for n in (*notices, *base):
        if " ".join(normal_words(n.phrase)) != n.phrase or not n.phrase:
            raise ValueError(f"not a phrase of plain lower-case words: {n.phrase!r}")
        if n.edits and len(n.phrase) < 2 * (n.edits + 1):
            raise ValueError(f"too many edits for {n.phrase!r}")

    def make() -> Callable[[list], list]:
        search = NoticeSearch(notices)
        return lambda texts: scan_texts(search, base, texts)

    fields = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<first:long,end:long,label:string,edits:int>>"
    )
    return append_columns(df, text, fields, make)
