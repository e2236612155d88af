"""Byte-pair encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from cohorta.llm.common import append_columns

# Words a task remembers before it begins anew, and the longest of them.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 64
# Beyond these code points no letter, number or mark is assigned (the last range: tags and variants).
ASSIGNED = ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE0200))


@dataclass(frozen=True)
class CharacterTables:
    """Where the tokenizers library's character tables, of an older Unicode, differ from this program's."""

    no_letters: frozenset[str]
    no_numbers: frozenset[str]
    odd: frozenset[str]

    @classmethod
    @lru_cache(maxsize=1)
    def of_library(cls) -> CharacterTables:
        """Compare both, character by character; once a driver, as it takes a second."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        every = "".join(chr(i) for a, b in ASSIGNED for i in range(a, b))

        def members(kind: str) -> set[str]:
            found = pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every)
            return set("".join(piece for piece, _ in found))

        letters, numbers = members(r"\p{L}"), members(r"\p{N}")
        own_letters, own_numbers = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every))
        if letters - own_letters or numbers - own_numbers:
            raise RuntimeError("the tokenizers library knows letters that the regex package does not")
        apart = [c for c in every if not c.isspace()]
        lower = normalizers.Lowercase().normalize_str(" ".join(apart)).split(" ")
        # Marks behind the character show its place among marks and what it composes with.
        marked = " ".join(f"a{c}\u0323\u0301" for c in apart)
        composed = zip(normalizers.NFC().normalize_str(marked).split(" "), unicodedata.normalize("NFC", marked).split(" "))
        odd = {c for c, a in zip(apart, lower) if a != c.lower()} | {c for c, (a, b) in zip(apart, composed) if a != b}
        no_letters, no_numbers = own_letters - letters, own_numbers - numbers
        return cls(frozenset(no_letters), frozenset(no_numbers), frozenset(odd | no_letters | no_numbers))

    def pattern(self, split: str) -> regex.Pattern:
        """``split`` with the library's letters and numbers."""
        for name, less in ((r"\p{L}", self.no_letters), (r"\p{N}", self.no_numbers)):
            if less:
                split = split.replace(name, f"[{name}--[{_ranges(less)}]]")
        return regex.compile(split, regex.V1)


def _ranges(characters: Iterable[str]) -> str:
    codes = sorted(map(ord, characters))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Memory(dict):
    """Results by word, made when first asked for.

    When it is full, it is put aside and a new one begun; a word found in the one put
    aside is taken over, so what is still in use stays and the size is bounded.
    """

    def __init__(self, make: Callable[[str], tuple], words: int | None = None):
        super().__init__()
        self.make, self.words, self.aside = make, words or MEMORY_WORDS, {}

    def __missing__(self, word: str) -> tuple:
        if len(word) > MEMORY_CHARS:
            return self.make(word)
        found = self.aside.get(word) or self.make(word)
        if len(self) >= self.words:
            self.aside = dict(self)
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else one from 256 up."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder for a vocabulary of kind ``BPE`` with word ends.

    Special strings of the file are found first, as the file says; the text between is
    composed (NFC), letters become lower case one by one, and the file's pattern gives
    the words, which hold no white space. A word's bytes are merged in the order of the
    merge ranks, leftmost first among equals; its ids, as bytes, and its vocabulary
    strings are remembered.
    """

    def __init__(self, path: str, tables: CharacterTables | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.tables = tables or CharacterTables.of_library()
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        # Rank (in the upper half of a number) of a pair of ids (as one number), and the id a rank makes.
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank << 32 for rank, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.inner = [self.vocab.get(c) for c in byte_letters()]
        self.last = [self.vocab.get(c + self.suffix) for c in byte_letters()]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.words_of_odd = regex.compile(split), self.tables.pattern(split)
        self.beyond = re.compile(f"[{min(self.tables.odd, default=chr(0x10FFFF))}-\U0010ffff]")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.of_word = Memory(self._word)

    def parts(self, text: str | None) -> list[tuple[bytes, str]]:
        """Packed ids and joined vocabulary strings of the text, word by word."""
        text = text or ""
        if self.marks is None or not any(mark in text for mark in self.special):
            return self._plain(text)
        found, at = [], 0
        for mark in self.marks.finditer(text):
            found += self._plain(text[at : mark.start()])
            found.append((struct.pack("<I", self.special[mark.group()]), mark.group()))
            at = mark.end()
        return found + self._plain(text[at:])

    def encode(self, text: str | None) -> list[int]:
        packed = b"".join([p[0] for p in self.parts(text)])
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of the ids, joined by blanks, as the file names no decoder; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        words = self.words
        if text.isascii():
            text = text.lower()
        elif self.beyond.search(text) is None or self.tables.odd.isdisjoint(text):
            text = unicodedata.normalize("NFC", text)
            # Lower case without context: a final sigma becomes an ordinary one.
            text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
        else:
            from tokenizers import normalizers

            words = self.words_of_odd
            text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return list(map(self.of_word.__getitem__, words.findall(text)))

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word.

        Symbols form a doubly linked list; a queue holds rank and place, as one number.
        An entry whose pair no longer stands at its place is stale and skipped.
        """
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n, rank_of, made_by = len(symbols), self.ranks.get, self.made
        ranks = map(rank_of, [a << 32 | b for a, b in zip(symbols, symbols[1:])])
        queue = [rank | place for place, rank in enumerate(ranks) if rank is not None]
        heapq.heapify(queue)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            place = entry & 0xFFFFFFFF
            follower = after[place]
            if follower < 0 or rank_of(symbols[place] << 32 | symbols[follower]) != entry - place:
                continue
            made = symbols[place] = made_by[entry >> 32]
            symbols[follower] = -1
            behind = after[place] = after[follower]
            after[follower] = -1
            if behind >= 0:
                before[behind] = place
                fresh = rank_of(made << 32 | symbols[behind])
                if fresh is not None:
                    heapq.heappush(queue, fresh | place)
            left = before[place]
            if left >= 0:
                fresh = rank_of(symbols[left] << 32 | made)
                if fresh is not None:
                    heapq.heappush(queue, fresh | left)
        return tuple([s for s in symbols if s >= 0])


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``token_ids``, an array of integers. Null and empty texts give an empty array.

    ``path`` is a vocabulary file that every executor has. Equal texts give equal
    ids; input columns named like a result are replaced.
    """

    tables = CharacterTables.of_library()

    def make():
        codec = BytePairCodec(path, tables)
        return lambda texts: [[codec.encode(t) for t in texts]]

    return append_columns(df, text, "token_ids array<int>", make, batch=128)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Append ``decoded``; null ids give an empty text, ids beyond the vocabulary are left out."""

    tables = CharacterTables.of_library()

    def make():
        codec = BytePairCodec(path, tables)
        return lambda rows: [[codec.decode(i for i in row or () if i is not None) for row in rows]]

    return append_columns(df, ids, "decoded string", make, batch=128)


def encode_and_decode(df: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Append ``n_tokens``, digests of the ids and of the decoded text, and (if kept) ``token_ids``.

    The codec of ``encode_texts`` and ``decode_ids``, both where the text is read, so
    that the ids need not be moved. Null and empty texts give 0 tokens and the digests
    of nothing.
    """

    tables = CharacterTables.of_library()

    def make():
        codec = BytePairCodec(path, tables)

        def compute(texts: list) -> list:
            out: list[list] = [[], [], [], []]
            for value in texts:
                parts = codec.parts(value)
                packed = b"".join([p[0] for p in parts])
                out[0].append(len(packed) // 4)
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(text_digest(" ".join([p[1] for p in parts if p[0]])))
                out[3].append(list(struct.unpack(f"<{len(packed) // 4}I", packed)) if keep_ids else None)
            return out[: 3 + keep_ids]

        return compute

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")
    return append_columns(df, text, fields, make, batch=128)
