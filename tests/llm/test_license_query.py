"""The licence query against its phrases searched word by word."""

import random
import re

from cohorta.llm import queries as Q

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BITS = [
    "under the mit license", "Under THE\nMIT-License", "the mit license", "under", "the", "apache license version 2", "apache license version 2.0",
    "apache licence version 2", "Apache License, Version 2", "cc by nc", "CC-BY-NC", "cc by ncs", "under the mit licenses", "É", "\u00a0", "\x7f", "\x00", "_", "ſ", "2",
]


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(at, label) for p, label in PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
    places = [at for at, _ in found]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found})))


def test_license_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice(BITS) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += [None, "", "licensed the mit license", "it is under the MIT license, under the mit license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.op2_license_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, texts[r["doc_id"]]
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, want[4].split(","))) <= set(labels) and 0 <= r["score"] <= 1
