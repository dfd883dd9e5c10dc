"""The automaton scan against plain counting."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import term_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in merged.items():
        scored = []
        for doc, c in counted:
            if doc is None:
                continue
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in wanted.items() if t in c
            )
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    texts = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in term_scan.rank(texts, asked, **options).collect()), key=str)


WORDS = ["a", "An", "été", "ÉTÉ", "x1", "the", "then", "hen", "naïve", "co-op", "don't", "日本", "a b", "end"]


def corpus(n=400):
    rng = np.random.default_rng(2)
    docs = [(int(i), "".join(f"{rng.choice(WORDS)}{rng.choice([' ', ', ', '\\n', '...', '_', '\\t'])}" for _ in range(rng.integers(1, 40)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(1000, None), (1001, ""), (1002, " .,;\n"), (None, docs[5][1]), (7, "the hen"), (7, "an end")]
    return docs + [(1003, "then " * 50_000)]


ITEMS = [(0, "the hen"), (1, "An ÉTÉ été a a a"), (2, None), (3, "!!!"), (4, "unknown words"), (5, "co-op don't"), (5, "日本 end"), (None, "x1 the")]


def test_matches_plain_counting(spark):
    docs = corpus()
    want = brute(docs, ITEMS, 20)
    assert {r[0] for r in want} == {0, 1, 5, None}
    assert run(spark, docs, ITEMS) == want
    # Every item in a scan of its own gives the same.
    assert run(spark, docs, ITEMS, group_bytes=1) == want
    assert run(spark, docs, ITEMS, k=3) == brute(docs, ITEMS, 3)


def test_long_items_are_added_as_integers(spark, monkeypatch):
    docs = corpus(60)
    monkeypatch.setattr(term_scan, "_exact", lambda *_: False)
    group = term_scan.Group([(0, {b"the": 2, b"hen": 1})])
    found = [Counter({0: 3, 1: 1})]
    weights = np.array([10, 20])
    exact = term_scan.scores_of(group, weights, 5, 100, [10], found)
    assert exact.dtype == np.int64
    monkeypatch.undo()
    assert (exact == term_scan.scores_of(group, weights, 5, 100, [10], found)).all()
    assert run(spark, docs, [(0, "the " * 3000)]) == brute(docs, [(0, "the " * 3000)], 20)


@pytest.mark.parametrize("docs, items", [([], ITEMS), ([(1, "the hen")], []), ([(1, None)], [(1, None)]), ([(1, "a")], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_guards_keep_to_whole_terms():
    group = term_scan.Group([(0, {b"he": 1, b"the": 1, b"then": 1})])
    n, found = term_scan.occurrences(group.automaton(), "the then THE-he, thenhe".encode())
    assert n == 5
    assert {group.terms[i]: c for i, c in found.items()} == {b"the": 2, b"then": 1, b"he": 1}
