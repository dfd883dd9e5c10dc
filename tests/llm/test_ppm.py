"""PPM against a dictionary model that follows the definition byte by byte."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from ledgerspark.llm import ppm
from ledgerspark.llm.queries import fifth_held_out

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def framed(token):
    return b" " + token + (b" " if token != b"\n" else b"")


def brute(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    counts, model = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for d, t in rows:
        if not held[d]:
            for token in tokens(t):
                counts[token] += 1
                data = framed(token)
                for i in range(1, len(data)):
                    for order in range(min(ppm.ORDER, i) + 1):
                        model[data[i - order : i]][data[i]] += 1
    total, distinct = sum(counts.values()), len(counts)

    def cost(context, byte):
        gone, out = set(), 0.0
        for order in range(len(context), -1, -1):
            seen = model.get(context[len(context) - order :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if byte in left:
                return out + math.log10(left[byte] / whole)
            if left:
                out += math.log10(len(left) / whole)
            gone |= set(left)
        return out - math.log10(max(1, ppm.ALPHABET - len(gone)))

    def spelled(x):
        return sum(cost(framed(x)[max(0, i - ppm.ORDER) : i], framed(x)[i]) for i in range(1, len(framed(x))))

    singles = sum(c == 1 for c in counts.values())
    rest = 1 - sum(10 ** spelled(x) for x in counts)

    def whole(x):
        if x in counts:
            return math.log10(counts[x] / (total + singles + 1))
        return math.log10((singles + 1) / (total + singles + 1)) + spelled(x) - math.log10(max(rest, ppm.LEAST_REST))

    want = []
    for d, t in rows:
        parts = tokens(t)
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in parts)
        score = sum(map(whole, parts))
        want.append((d, held[d], len(parts), sum(counts.get(x, 0) > 0 for x in parts), total, base, score))
    return want


def compare(frame, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in ppm.score(frame, fifth_held_out()).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_matches_definition(spark, monkeypatch):
    rng = random.Random(6)
    stems = ["the", "then", "theory", "an", "and", "étude", "zebra", "x", "antidisestablishmentarianism"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "!", "é"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Qq \x00\x1c　 unseen中"), (None, "the an"), (3, rows[3][1]), (104, "and " * 30_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", block int, word string").repartition(3)
    compare(frame, rows)


def test_without_training_text_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    frame = spark.createDataFrame([(held, "some text")], SCHEMA)
    compare(frame, [(held, "some text")])
    assert ppm.score(frame.limit(0), fifth_held_out()).collect() == []


def test_probabilities_of_a_context_add_up_to_one(spark):
    from pyspark.sql import functions as F

    rows = [(i, "banana band ban bandit an ant") for i in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    counts = spark.createDataFrame([(w, 3) for w in (b"banana", b"band", b"ant", b"\n")], "word binary, c long")
    pairs = ppm.trie(counts, 4).cache()
    words = [bytes([b]) for b in range(256) if bytes([b]) not in b" \t\n\x0b\x0c\r"]
    # After "ban": one more byte of any kind, or the space.
    keys = {int(ppm.pair_keys([b"ban" + w], False)[0][3]) for w in words} | {int(ppm.pair_keys([b"ban"], False)[0][3])}
    asked = spark.createDataFrame([(k,) for k in keys], "pair long")
    costs = [10 ** r.cost for r in ppm.pair_costs(asked, pairs, ppm.nodes(pairs)).collect()]
    # The end mark is the one symbol that can't follow; it takes its part of the mass.
    assert len(costs) == 251 and 0.97 < sum(costs) <= 1 + 1e-9
    assert frame.count() == 4 and F
