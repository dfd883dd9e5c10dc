"""Spelling variants against plain edit distances."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from ledgerspark.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    rows, form = {}, {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        if best and -best[0] >= ratio * n:
            form[w] = best[1]
        rows[w] = len(others)
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, rows[w], counts[f] if f else None))
    return sorted(out, key=str)


def brute_vocabulary(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def words(spark, counts):
    return spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")


def run(spark, counts, **options):
    return sorted((tuple(r) for r in spelling.variants(words(spark, counts), **options).collect()), key=str)


def random_counts(seed, n):
    rng = np.random.default_rng(seed)
    found = Counter()
    for _ in range(n):
        w = "".join(rng.choice(list("abcé"), rng.integers(5, 9)))
        found[w] += int(rng.integers(3, 9)) ** int(rng.integers(1, 4))
    return dict(found)


def test_matches_plain_distances(spark):
    counts = random_counts(1, 700)
    want = brute(counts)
    assert sum(r[4] > 0 for r in want) > 300 and any(r[1] and r[2] != r[1] for r in want)
    assert run(spark, counts) == want
    assert run(spark, counts, block=20) == want


def test_long_chains_end_at_their_root(spark):
    counts = {"q" * i + "x" * (40 - i): 3 * 2**i for i in range(12)}
    counts |= {"z" * 5: 3, "z" * 6: 6, "abcde": 5, "abcdf": 10, "abcdg": 10}
    assert run(spark, counts) == brute(counts)


def test_vocabulary(spark):
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(rng.choice(["Hello", "WORLD", "Ñandú", "naïve", "ÀÉÎ÷×ab", "it's", "longerword", "日本abcdef"], 30))) for i in range(300)]
    docs += [(9, None), (10, ""), (None, "hello hello hello hello2hello"), (3, docs[3][1]), (400, "hello_" * 40_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(4)
    got = {r.word: r.n for r in spelling.vocabulary(frame).collect()}
    assert got == brute_vocabulary(docs)
    assert any("hell" in w and w != "hello" for w in got) or len(got) > 8


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    docs = [(i, "alpha bravo charlie delta1echoo " * 3) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(spelling, "COUNTED", 1)
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == brute_vocabulary(docs)


def test_empty(spark):
    assert run(spark, {}) == []
    assert run(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    assert spelling.variants(words(spark, {"alone": 3}).unionByName(spark.createDataFrame([(None, 4, "x")], "word string, n long, form string"))).count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abßÿ", min_size=5, max_size=6), min_size=1, max_size=90, unique=True))
def test_index_finds_all_pairs(names):
    short = [w for w in names if len(w) == 5]
    if not short:
        return
    q, w = spelling.near_pairs(short, names, 5)
    want = {(a, b) for a in short for b in names if near(a, b)}
    assert {(short[i], names[j]) for i, j in zip(q, w)} == want and len(q) == len(want)
    q, w = spelling.near_pairs(short, names, 5, affix=2)
    assert {(short[i], names[j]) for i, j in zip(q, w)} == {(a, b) for a, b in want if a[:2] != b[:2]}
