"""Near duplicates against all pairs on small tables, on every path."""

import random

import numpy as np

from ledgerspark.llm import bottomk
from ledgerspark.llm.components import connected_components


def brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(w if r > share else "".join(rng.choice("xyz") for _ in range(6)))
        if r > 1 - share / 4:
            out.append("new" + str(rng.randrange(10**6)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 200))] for _ in range(30)]
    family = [rng.choice(vocabulary) for _ in range(150)]
    texts += [edited(rng, family, rng.choice([0.0, 0.01, 0.03, 0.06, 0.1, 0.2])) for _ in range(60)]
    branch = edited(rng, family, 0.25)  # a family within the family
    texts += [edited(rng, branch, rng.choice([0.01, 0.05, 0.1])) for _ in range(25)]
    texts += [family[: rng.randint(100, 150)] for _ in range(12)]  # shorter ones: only deletions
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts += [[rng.choice(vocabulary) for _ in range(80)] + passage for _ in range(15)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(t).capitalize()) for i, t in enumerate(texts)]
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One"), (9004, "one "), (9005, "one two"), (9006, "w1 w2 w3 w4"), (9007, rows[0][1].upper())]
    return rows


def test_families_match_all_pairs(spark):
    for seed, words, percent, levels in [(1, 3, 85, 3), (2, 5, 80, 3), (3, 3, 85, 1)]:
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, id int, digest string")
        got = bottomk.near_duplicates(docs, words, percent, levels=levels)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, words, percent)


def test_families_in_small_blocks_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "BLOCK", 7)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bottomk.near_duplicates(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 85)


def test_a_family_below_the_threshold_makes_no_rows_per_pair(spark, monkeypatch):
    rng = random.Random(5)
    base = ["w%d" % i for i in range(200)]
    choices = [["%s%s" % (x, w) for x in "abc"] for w in base]

    def variant():  # a tenth of the words replaced, each by one of three
        return " ".join(rng.choice(choices[i]) if rng.random() < 0.1 else w for i, w in enumerate(base))

    rows = [(0, " ".join(base))] + [(i, variant()) for i in range(1, 200)]
    written, materialize = {}, bottomk.materialize

    def counted(df, label):
        out = materialize(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(bottomk, "materialize", counted)
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 85)
    assert max(written.get(x, 0) for x in ("bottomk-likely", "bottomk-met", "bottomk-rest")) < len(rows)


def test_members_of_open_lists_make_no_rows_per_pair(spark, monkeypatch):
    rng = random.Random(7)
    drawn = lambda n: ["w%d" % rng.randrange(5000) for _ in range(n)]
    shared, passages = drawn(60), [drawn(40), drawn(40)]
    # Texts of one passage are far from a leader with the other one, and share many of its lists.
    rows = [(i, " ".join(shared + passages[i % 2] + drawn(40))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, materialize = {}, bottomk.materialize

    def counted(df, label):
        out = materialize(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(bottomk, "materialize", counted)
    for block in (bottomk.BLOCK, 7):
        monkeypatch.setattr(bottomk, "BLOCK", block)
        got = bottomk.near_duplicates(docs, 3, 85)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 85)
        assert written["bottomk-held"] > 30
        assert max(written.get(x, 0) for x in ("bottomk-met", "bottomk-rest")) < len(rows)


def test_shared_values_of_rare_and_common_ones(monkeypatch):
    monkeypatch.setattr(bottomk, "COLUMNS", 5)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(-40, 40 + 60 * (i % 3), 30)) for i in range(50)] + [np.zeros(0, np.int64)]
    owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    got = bottomk._shared(owners, np.concatenate(sets), len(sets))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(x, y))


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in bottomk.near_duplicates(docs).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]
    assert bottomk.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (8, 9), (9, 8), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.id: r.component for r in found.collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(200, 260)}, 9: 8}
