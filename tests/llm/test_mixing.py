"""Mixing: budgets against a recursive deal, and prefixes against a sort."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerspark.llm import mixing

WEIGHTS = ({"a": 3.0, "z": 0.0}, {"en": 2.0}, {"s1": 0.5, "s2": 4.0})


def deal(total, supply, weight):
    """Repeated rounds: by weight among the children that aren't full yet."""
    out = dict.fromkeys(supply, 0.0)
    open_ = set(supply)
    while open_ and total > 1e-9:
        whole = sum(weight[c] for c in open_)
        full = {c for c in open_ if supply[c] - out[c] <= total * weight[c] / whole + 1e-9}
        for c in full or open_:
            out[c] += supply[c] - out[c] if full else total * weight[c] / whole
        if not full:
            break
        total -= sum(supply[c] for c in full)
        open_ -= full
    return out


def brute(rows, share, epochs, seed):
    leaves = defaultdict(list)
    for d, t, dom, lang, src in rows:
        leaves[dom, lang, src].append((d, len((t or "").encode().split())))
    avail = {k: sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(avail.values()) * share
    names = lambda i, v: WEIGHTS[i].get(v, 1.0)
    tree = {k: a * epochs for k, a in avail.items() if a and all(names(i, v) for i, v in enumerate(k))}

    def down(prefix, budget, out):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = budget
            return
        supply = defaultdict(float)
        for k, s in tree.items():
            if k[:depth] == prefix:
                supply[k[depth]] += s
        weight = {c: names(depth, c) for c in supply}
        for c, b in deal(min(budget, sum(supply.values())), supply, weight).items():
            down((*prefix, c), b, out)

    budget = {}
    down((), total, budget)
    copies = {}
    for leaf, docs in leaves.items():
        b = int(budget.get(leaf, 0) + 1e-6)
        whole = min(epochs, b // avail[leaf]) if avail[leaf] else 0
        rest = b - whole * avail[leaf]
        place = lambda d: int(hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
        run, taken = 0, set()
        for d, n in sorted(docs, key=lambda x: (place(x[0]), x[0] or -1)):
            run += n
            if run <= rest:
                taken.add(d)
        for d, _ in docs:
            if leaf in budget and whole + (d in taken and rest > 0):
                copies[leaf, d] = whole + (d in taken and rest > 0)
    return copies


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(500):
        hot = rng.random() < 0.4
        leaf = ("a", "en", "s1") if hot else (rng.choice(["a", "b", "c", "z", None]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]))
        out.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), *leaf))
    out += [(1000, None, "b", "de", "s1"), (1001, "", "empty", "de", "s9"), (1002, "w " * 50_000, "c", "de", "s3")]
    return out


def taken(frame, share, epochs, seed):
    out = mixing.mix(frame, F.col("dom"), share, epochs, WEIGHTS, seed)
    return {((r.dom, r.lang, r.source), r.doc_id): r.copies for r in out.collect()}


SCHEMA = "doc_id long, text string, dom string, lang string, source string"


def test_matches_recursive_deal(spark):
    given = rows()
    frame = spark.createDataFrame([(*r, 5, 6) for r in given], SCHEMA + ", copies int, weight int").repartition(4)
    for share, epochs, seed in [(0.3, 1, 1), (0.8, 2, 2), (5.0, 2, 3), (0.0, 1, 4)]:
        assert taken(frame, share, epochs, seed) == brute(given, share, epochs, seed), (share, epochs)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 10), ("a", "en", "s9", 1000), ("a", "de", "s9", 1000), ("b", "en", "s9", 1000)],
        "__l0 string, __l1 string, __l2 string, avail long",
    )
    got = {(r["__l0"], r["__l1"], r["__l2"]): r.budget for r in mixing.budgets(leaves, 400 / 3010, 1, ({}, {}, {})).collect()}
    # 200 for a, 100 for each language; s1 has 10 only, its sibling takes the other 90.
    assert {k: round(v, 6) for k, v in got.items()} == {("a", "en", "s1"): 10, ("a", "en", "s9"): 90, ("a", "de", "s9"): 100, ("b", "en", "s9"): 200}


def test_repeated_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b", "a", "en", "s1"), (1, "a b", "a", "en", "s1"), (None, "c", "a", "en", "s1")], SCHEMA)
    assert mixing.mix(frame, F.col("dom"), 1.0, 1).count() == 3
    assert mixing.mix(frame.limit(0), F.col("dom")).collect() == []
