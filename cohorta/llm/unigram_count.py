"""Token counts under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import regex
from pyspark.sql import DataFrame

from cohorta.llm.common import append_columns

BLANK = "▁"
# Unicode white space, at which words end.
WORD = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")
UNKNOWN_PENALTY = 10.0
# Distinct words remembered per task, and the longest of them.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 64


def words_of(text: str | None) -> list[str]:
    """Words with a leading word mark; a mark inside a word starts a new one."""
    words = []
    for word in WORD.findall(text or ""):
        word = word if word.startswith(BLANK) else BLANK + word
        if word.count(BLANK) == 1:
            words.append(word)
        else:
            words.extend(BLANK + rest for rest in word.split(BLANK)[1:])
    return words


class UnigramCounter:
    """Piece count and best-path score of a word.

    Of several matches that end at a place the longest is tried first, and a later
    one replaces it only when its score is strictly greater; a character that no
    one-character piece covers may become an unknown piece, tried last; neighbouring
    unknowns count as one piece, or with ``to_bytes`` each as its UTF-8 bytes.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], to_bytes: bool = False):
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.to_bytes = to_bytes
        self.parts = self._parts({p for p, _ in pieces})
        self.memory: dict[str, tuple[int, float]] = {}

    @staticmethod
    def _parts(pieces: set[str]) -> re.Pattern:
        """Parts of a text whose border no piece crosses."""
        letters = {c for p in pieces for c in p} - {BLANK}
        some = "[" + "".join(map(re.escape, sorted(letters))) + "]" if letters else r"(?!)"
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            return re.compile(f"(?:{some}|{BLANK})+|.", re.DOTALL)
        return re.compile(f"{BLANK}+{some}*|{some}+|.", re.DOTALL)

    def count_text(self, text: str | None) -> tuple[int, float]:
        """Piece count and best-path score of a whole text, white space included.

        As the file's tokenizer has it, a blank stands before the text, blanks become
        word marks, and nothing else is changed or left out. Empty texts have no piece.
        """
        if not text:
            return 0, 0.0
        found = [self.count(part) for part in self.parts.findall(BLANK + text.replace(" ", BLANK))]
        return sum(n for n, _ in found), sum(s for _, s in found)

    def count(self, word: str) -> tuple[int, float]:
        if word in self.memory:
            return self.memory[word]
        result = self._path(word)
        if len(word) <= MEMORY_CHARS and len(self.memory) < MEMORY_WORDS:
            self.memory[word] = result
        return result

    def _path(self, word: str) -> tuple[int, float]:
        scores, counts, unknown = [0.0], [0], [False]
        matches = iter(self.pieces.iter(word)) if len(self.pieces) else iter(())
        ahead = next(matches, None)
        for end, char in enumerate(word):
            best = None
            while ahead is not None and ahead[0] == end:
                size, score = ahead[1]
                start = end + 1 - size
                total = score + scores[start]
                if best is None or total > best:
                    best, n = total, counts[start] + 1
                ahead = next(matches, None)
            strange = False
            if char not in self.single:
                total = self.unknown + scores[end]
                if best is None or total > best:
                    best, strange = total, True
                    if self.to_bytes:
                        n = counts[end] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        n = counts[end] + (0 if unknown[end] else 1)
            scores.append(best)
            counts.append(n)
            unknown.append(strange)
        return counts[-1], scores[-1]


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


def count_tokens(
    df: DataFrame, pieces: Sequence[tuple[str, float]], text: str = "text", whole: bool = False
) -> DataFrame:
    """Append ``n_words``, ``n_tokens`` and ``path_score`` (sum of the best paths).

    The vocabulary (a file of fixed size) travels as a broadcast. Without ``whole``
    words count one by one, and white space not at all; with it the text counts as it
    is, blanks and line ends too, and unlisted characters as their bytes. Null and empty
    texts count 0, and without ``whole`` blank ones. Equal scores follow the tokenizer: the longer last piece
    stays. Input columns named like a result are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(pieces))

    def make():
        counter = UnigramCounter(shared.value, to_bytes=whole)

        def compute(texts: list) -> list:
            out: list[list] = [[], [], []]
            for text in texts:
                words = words_of(text)
                found = [counter.count_text(text)] if whole else [counter.count(w) for w in words]
                out[0].append(len(words))
                out[1].append(sum(n for n, _ in found))
                out[2].append(float(sum(s for _, s in found)))
            return out

        return compute

    return append_columns(df, text, "n_words long, n_tokens long, path_score double", make)
