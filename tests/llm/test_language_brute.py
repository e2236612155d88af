"""The language query against naive Bayes written plainly, n-gram by n-gram."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from cohorta.llm import lang_id
from cohorta.llm import queries as Q

DIMS = 1 << 14


def buckets(text):
    """Hashed 1- to 3-grams of the letters, every run of other characters one blank."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    chars = [ord(c) for c in " " + " ".join(words) + " "]
    found = Counter()
    for n in (1, 2, 3):
        for at in range(len(chars) - n + 1):
            h = 0
            for i, c in enumerate(chars[at : at + n], 1):
                h = (h * 1_000_003 + c + i) % 2**64
            found[(h * 0x9E3779B97F4A7C15 % 2**64 >> 33) % DIMS] += 1
    return found


def plain_bayes(rows):
    """{doc_id: (held out, language, probability)}"""
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    learned, documents = {}, Counter()
    for i, text, lang in rows:
        if not held[i] and text is not None and lang is not None:
            learned.setdefault(lang, Counter()).update(buckets(text))
            documents[lang] += 1
    sizes = {lang: sum(c.values()) + 0.5 * DIMS for lang, c in learned.items()}
    out = {}
    for i, text, _ in rows:
        grams = buckets(text or "")
        if not grams or not learned:
            out[i] = (held[i], "und", 0.0)
            continue
        logs = {
            lang: math.log(documents[lang] / documents.total())
            + math.fsum(n * math.log((learned[lang][b] + 0.5) / sizes[lang]) for b, n in grams.items())
            for lang in sorted(learned)
        }
        best = max(logs, key=logs.get)
        out[i] = (held[i], best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


def test_query_is_naive_bayes(spark, tmp_path):
    rng = random.Random(4)
    alphabets = {"aa": "abcdefgh", "bb": "defghijk", "cc": "αβγδabc", "dd": "éèàüßABC"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(alphabets))
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 12))]
        text = rng.choice([" ", "\n", ", ", "1-"]).join(words)
        rows.append((i, None if i % 41 == 0 else text, None if i % 17 == 0 else lang, "s", 1))
    rows += [(300, "", "aa", "s", 0), (301, "123 !?", "bb", "s", 0), (302, "İSTANBUL ſ", None, "s", 0), (303, "abc" * 5000, "aa", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_bayes([r[:3] for r in rows])
    got = Q.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, lang, score = want[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (held, lang), r
        assert abs(r["score"] - score) < 1e-6


def test_many_languages_in_bounded_memory(spark):
    """More languages than a task counts at once, and batches weighed in parts, give the plain model."""
    rng = random.Random(7)
    letters = [chr(0x3B1 + k) for k in range(20)] + list("abcdefghij")
    rows = []
    for i in range(900):
        lang = f"l{i % 300:03d}"
        own = random.Random(lang).sample(letters, 6)
        rows.append((i, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(8)), lang))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = lang_id.fit_language_model(frame)
    assert model.languages == tuple(sorted({r[2] for r in rows}))
    counted = np.zeros((DIMS, 300))
    for _, text, lang in rows:
        for bucket, n in buckets(text).items():
            counted[bucket, int(lang[1:])] += n
    assert np.allclose(model.log_probs, np.log((counted + 0.5) / (counted + 0.5).sum(axis=0)), rtol=0, atol=1e-12)
    assert np.allclose(model.priors, np.log(1 / 300))
    texts = [r[1] for r in rows[:120]] + ["", "12", "a" * 3000]
    whole = lang_id.score_texts(model, texts)
    assert sum(p == r[2] for p, r in zip(whole[0], rows)) >= 110
    for cells in (1, 300 * 50, 300 * 700):
        with_cells, lang_id.SCORE_CELLS = lang_id.SCORE_CELLS, cells
        try:
            assert lang_id.score_texts(model, texts) == whole
        finally:
            lang_id.SCORE_CELLS = with_cells
    with np.testing.assert_raises(ValueError):
        lang_id.fit_language_model(frame, max_languages=299)
