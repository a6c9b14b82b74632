"""Spelling variants against a comparison of all words with each other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from samplekit.llm import spelling

TO_LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=5):
    form, out = {}, []
    others = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in counts}
    for w, found in others.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), counts.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def vocabulary(seed, n, letters="abé", low=1, high=9):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(low, high))): 5 ** r.randint(0, 6) + r.randint(0, 2) for _ in range(n)}


@pytest.mark.parametrize("most_words", [4096, 20])
def test_against_all_pairs(spark, most_words):
    counts = vocabulary(1, 700) | vocabulary(2, 200, "ÿàxyz", 6, 7) | {"a" * 60: 5, "a" * 61: 900, "b" * 3000: 7, "b" * 1500 + "c" + "b" * 1499: 90}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(spelling.spelling_variants(words, most_words=most_words)) == brute(counts)
    sizes = spelling.shards(words, most_words=20).where("width > 1").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 20


def test_whole_operator(spark, docs, nothing):
    base = "colour behaviour flavour neighbour Éclairant éclairants the of straße"
    extra = spark.createDataFrame([(1000 + i, base + (" neighbor flavoür" if i % 6 == 0 else ""), "x") for i in range(60)] + [(None, base, "y")], "doc_id long, text string, word string")
    both = docs.select("doc_id", "text", "term").withColumnRenamed("term", "word").unionByName(extra).repartition(4)
    counts = Counter()
    for r in both.collect():
        for run in re.findall(f"[{spelling.LETTERS}]+", r.text or ""):
            run = run.translate(TO_LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    want = brute(counts)
    assert rows(spelling.op11_spelling_variants(both)) == want
    assert {w[0]: w[1] for w in want}["neighbor"] == "neighbour"
    assert spelling.op11_spelling_variants(nothing).count() == 0
