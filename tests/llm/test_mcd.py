"""Quality rules: statistics by plain counting, the robust estimate against a dense one, verdicts on planted junk."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import mcd

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    text = text or ""
    raw = text.encode().split()
    words = [w.decode() for w in raw]
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            repeated += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), lines


def corpus():
    rng = random.Random(3)
    stems = ["river", "mill", "carpenter", "a", "the", "meadow", "was", "boats", "spring", "étés"]

    def prose(n):
        return " ".join(rng.choice(stems) + rng.choice("abcdefgh") for _ in range(n)).replace("a ", "a.\n", 3)

    rows = [(i, prose(rng.randint(60, 300)), rng.choice(["en", "fr"]), rng.choice(["s1", "s2"])) for i in range(600)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(100).split()), "en", "s1") for i in range(40)]
    rows += [(2000 + i, "\n".join([prose(12)] * 12), "en", "s2") for i in range(20)]
    rows += [(3000 + i, prose(80), None, None) for i in range(3)]
    rows += [(4000, None, "en", "s1"), (4001, "", None, "s1"), (4002, " \t\n", "en", None), (4003, "a b c a b c", "en", "s1"), (4004, "w " * 100_000, "en", "s1")]
    return rows + [rows[0]]


def test_statistics_and_verdicts(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "e") for r in rows], SCHEMA + ", n_words int, g string").repartition(3)
    out = mcd.judge(frame)
    assert [c for c in out.columns if c not in (*mcd.STATS, "base_failed", "distance", "kept")] == ["doc_id", "text", "lang", "source", "g"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in mcd.STATS) == plain(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.doc_id < 1000 or 3000 <= r.doc_id < 4000), (r.doc_id, r.distance)
    assert mcd.judge(frame.limit(0)).collect() == []


def test_estimate_matches_dense_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([1, 2, 3, 4], np.diag([1, 4, 0.25, 1]) + 0.3, size=800)
    x[:150] += 12  # far points that the estimate must not see
    rows = [("g", *map(float, r)) for r in x]
    frame = spark.createDataFrame(rows, "g string, " + ", ".join(f"__x{i} double" for i in range(4))).repartition(5)
    e = mcd.mcd_estimates(frame).first()
    assert e.n == 800
    center = np.array([e[f"__m{i}"] for i in range(4)])
    factor = np.array([[e[f"__l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    # A further concentration step by dense algebra moves the estimate but little.
    y = np.linalg.solve(factor, (x - center).T)
    d = (y * y).sum(axis=0)
    near = x[np.argsort(d)[: int(0.75 * len(x))]]
    assert near.mean(axis=0) == pytest.approx(center, abs=0.05)
    want = np.cov(near.T, bias=True) * mcd.CONSISTENCY + np.diag(np.square(mcd.FLOORS))
    assert factor @ factor.T == pytest.approx(want, rel=0.1, abs=0.06)
    assert (d[:150] > 50).all() and np.median(d[150:]) < 10


def test_constant_statistics_have_a_distance(spark):
    text = "one two three four five six seven eight nine ten " * 1
    rows = [(i, text + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(30)]
    got = mcd.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept and r.distance is not None for r in got)


def test_each_statistic_alone_rejects(spark):
    words = lambda i, n, size=6: [f"{i}x{j}".rjust(size, "w") for j in range(n)]
    rows = [(i, " ".join(words(i, 100)), "en", "s") for i in range(300)]
    symbols = words(600, 100)
    symbols[::5] = [w[:-1] + "#" for w in symbols[::5]]  # 20 of 600 characters
    symbols[1] = "w####w"
    lines = [" ".join(words(601, 200)[k : k + 2]) for k in range(0, 110, 2)]
    for k in range(45):
        lines.insert(2 * k + 1, "again again2")
    repeated = words(602, 86)
    repeated += repeated[:32]  # 64 of 150 words
    repeated += words(603, 32)
    bad = [" ".join(symbols), "\n".join(lines), " ".join(repeated), " ".join(words(604, 100, 9))]
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(bad)]
    got = {r.doc_id: r for r in mcd.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(300))
    for i in range(1000, 1004):
        r = got[i]
        away = [r.n_symbols > 0, r.n_dup_lines > 0, r.n_repeat_words > 0, r.word_chars / r.n_words > 7]
        assert not r.base_failed and away == [i == 1000 + k for k in range(4)] and not r.kept, (i, r.distance, away)
