"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.common import append_columns

UNKNOWN = "und"
# How many spreads below the middle a text may lie, the tenth percentile of a normal law in
# spreads, and the n-grams that one character is part of (they are not independent).
SPREADS, TENTH, GRAMS_OVERLAP = 6.0, 1.2816, 6
# Characters hashed at once; longer texts go in overlapping windows.
WINDOW = 1 << 20
# Languages a task counts at once, and n-grams times languages weighed at once.
OPEN_LANGUAGES = 64
SCORE_CELLS = 1 << 23


@dataclass(frozen=True)
class LanguageModel:
    """Languages in alphabetic order, their log priors and log probabilities (bucket x language)."""

    languages: tuple[str, ...]
    priors: np.ndarray
    log_probs: np.ndarray
    orders: tuple[int, ...]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one blank; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    words = np.where(letter, codes, np.uint32(32))[keep]
    return np.concatenate((np.array([32], np.uint32), words, np.array([32], np.uint32)))


def gram_counts(text: str | None, dims: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs."""
    codes = letter_codes(text or "").astype(np.uint64)
    total = np.zeros(0, np.int64)
    found = []
    reach = max(orders) - 1
    for at in range(0, len(codes), WINDOW):
        piece = codes[at : at + WINDOW + reach]
        own = min(WINDOW, len(codes) - at)
        hashed = np.zeros(len(piece), np.uint64)
        for n in range(1, max(orders) + 1):
            # Polynomial hash of the n characters from each place, modulo 2**64.
            hashed = hashed[: len(piece) - n + 1] * np.uint64(1_000_003) + piece[n - 1 :] + np.uint64(n)
            if n in orders:
                mixed = hashed[:own] * np.uint64(0x9E3779B97F4A7C15)
                found.append(((mixed >> np.uint64(33)) % np.uint64(dims)).astype(np.int64))
        if len(found) > 64:
            total = _tally(found, total, dims)
            found = []
    if len(total):
        total = _tally(found, total, dims)
        ids = np.flatnonzero(total)
        return ids, total[ids]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.concatenate(found)
    if len(grams) < dims // 2:
        return np.unique(grams, return_counts=True)
    total = np.bincount(grams, minlength=dims)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def _tally(found: list, total: np.ndarray, dims: int) -> np.ndarray:
    counts = np.bincount(np.concatenate(found), minlength=dims) if found else np.zeros(dims, np.int64)
    return counts + total if len(total) else counts


def fit_language_model(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    dims: int = 1 << 14,
    orders: tuple[int, ...] = (1, 2, 3),
    smoothing: float = 0.5,
    max_languages: int = 2048,
) -> LanguageModel:
    """Learn from every row whose text and language are not null.

    Each task adds its texts up to one count per (language, bucket) before the
    shuffle, for ``OPEN_LANGUAGES`` languages at a time: beyond them it hands on what
    it has and starts anew. The model holds ``dims`` numbers per language, so its size
    is known; more than ``max_languages`` languages are an error. Texts without a letter add
    a document to the prior only. Without any row the model has no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def added() -> Iterator[pa.RecordBatch]:
            for name, row in totals.items():
                ids = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(row[ids])],
                    names=["language", "bucket", "n"],
                )
            totals.clear()

        for batch in batches:
            for value, language in zip(batch.column(0), batch.column(1)):
                name = language.as_py()
                if name not in totals:
                    if len(totals) == OPEN_LANGUAGES:
                        yield from added()
                    totals[name] = np.zeros(dims + 1, np.int64)
                ids, n = gram_counts(value.as_py(), dims, orders)
                totals[name][ids] += n
                totals[name][dims] += 1
        yield from added()

    known = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    sums = (
        known.mapInArrow(count, "language string, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("language")
        # dims + 1 numbers per language at most.
        .agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
        .select("language", F.col("counts.bucket").alias("buckets"), F.col("counts.n").alias("counts"))
    )
    # Packed columns, at most twelve bytes for each number of the model.
    rows = sums.limit(max_languages + 1).toArrow()
    if rows.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    names = rows.column("language").to_pylist()
    matrix = np.zeros((dims + 1, len(names)))
    order = sorted(range(len(names)), key=names.__getitem__)
    buckets, counts = rows.column("buckets").combine_chunks(), rows.column("counts").combine_chunks()
    for k, row in enumerate(order):
        matrix[buckets[row].values.to_numpy(), k] = counts[row].values.to_numpy()
    grams = matrix[:dims] + smoothing
    return LanguageModel(
        tuple(names[row] for row in order),
        np.log(matrix[dims] / max(1.0, matrix[dims].sum())),
        np.log(grams / grams.sum(axis=0)) if names else grams,
        orders,
    )


def _log_sums(model: LanguageModel, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts with a letter; for each its log probabilities without priors, n-grams and different n-grams."""
    dims = len(model.log_probs)
    rows, sizes, ids, counts = [], [], [], []
    for k, text in enumerate(texts):
        where, n = gram_counts(text, dims, model.orders)
        if len(where):
            rows.append(k)
            sizes.append(len(where))
            ids.append(where)
            counts.append(n)
    if not rows:
        return rows, np.zeros((0, len(model.languages))), np.zeros(0), np.zeros(0)
    # The batch as a sparse matrix: row starts, buckets, counts.
    ends = np.cumsum(sizes)
    starts = np.concatenate(([0], ends[:-1]))
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    # Whole texts at a time, so a text's sums do not depend on the others, of bounded n-grams times languages.
    most, logs, first = SCORE_CELLS // len(model.languages), [], 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, "right")))
        part = slice(starts[first], ends[last - 1])
        weights = model.log_probs[ids[part]] * counts[part, None]
        logs.append(np.add.reduceat(weights, starts[first:last] - starts[first], axis=0))
        first = last
    return rows, np.concatenate(logs), np.add.reduceat(counts, starts), np.array(sizes)


def score_texts(model: LanguageModel, texts: list) -> tuple[list, list]:
    """Most probable language and its probability; ``und`` and 0 without a letter or without a model."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return languages, scores
    rows, logs, _, _ = _log_sums(model, texts)
    if not rows:
        return languages, scores
    logs = logs + model.priors
    best = logs.argmax(axis=1)  # the first of equals: alphabetic
    sure = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    for k, b, s in zip(rows, best, sure):
        languages[k], scores[k] = model.languages[b], float(s)
    return languages, scores


@dataclass(frozen=True)
class LanguageRange:
    """By language of a model: middle and spread of its own texts' mean log probability, and the spread of one n-gram."""

    middle: np.ndarray
    spread: np.ndarray
    gram_spread: np.ndarray

    def least(self, language: np.ndarray, different: np.ndarray) -> np.ndarray:
        """Least mean of a text of the language with so many different n-grams; short texts vary more."""
        noise = GRAMS_OVERLAP * self.gram_spread[language] ** 2 / different
        return self.middle[language] - SPREADS * np.sqrt(self.spread[language] ** 2 + noise)


def fit_language_range(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> LanguageRange:
    """What mean log probability per n-gram the labelled texts have in their own language.

    The middle is the median, the spread comes from the tenth percentile, so a few
    odd texts among the labelled ones do not widen the range.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(shared.value.languages)}
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                names = batch.column(1).to_pylist()
                rows, logs, n, _ = _log_sums(shared.value, batch.column(0).to_pylist())
                own = [place[names[k]] for k in rows]
                mean = logs[np.arange(len(rows)), own] / n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array(mean, pa.float64())], names=["language", "mean"]
                )

    known = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    found = (
        known.mapInArrow(means, "language int, mean double")
        .groupBy("language")
        .agg(F.percentile_approx("mean", [0.1, 0.5], 10_000).alias("q"))
        .collect()  # a row per language
    )
    middle, spread = np.full(len(model.languages), np.inf), np.zeros(len(model.languages))
    for r in found:
        middle[r["language"]], spread[r["language"]] = r["q"][1], (r["q"][1] - r["q"][0]) / TENTH
    p = np.exp(model.log_probs)
    mean = (p * model.log_probs).sum(axis=0)
    return LanguageRange(middle, spread, np.sqrt((p * (model.log_probs - mean) ** 2).sum(axis=0)))


def keep_known_languages(df: DataFrame, model: LanguageModel, known: LanguageRange, text: str = "text") -> DataFrame:
    """Append ``in_language``: whether a text is like the labelled texts of its most probable language.

    The measure is per n-gram, so neither long texts of a language that was never
    learned nor letter junk pass by their length. Texts without a letter do not pass.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, known))

    def make():
        model, known = shared.value

        def compute(texts: list) -> list:
            passed = [False] * len(texts)
            rows, logs, n, different = _log_sums(model, texts)
            if rows:
                best = (logs + model.priors).argmax(axis=1)
                mean = logs[np.arange(len(rows)), best] / n
                for k, ok in zip(rows, mean >= known.least(best, different)):
                    passed[k] = bool(ok)
            return [passed]

        return compute

    return append_columns(df, text, "in_language boolean", make, batch=128)


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``; every row stays.

    Null and empty texts and texts without a letter get ``und`` and 0.0. Equal
    probabilities go to the alphabetically first language. Input columns named
    like a result are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: score_texts(shared.value, texts)

    return append_columns(df, text, "lang_pred string, score double", make, batch=128)
