"""PPM over whole texts against a dictionary model that follows the definition byte by byte."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from ledgerspark.llm import ppm_text
from ledgerspark.llm.ppm import ALPHABET, ORDER
from ledgerspark.llm.queries import fifth_held_out

SCHEMA = "doc_id long, text string"


def brute(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    counts, model = defaultdict(int), defaultdict(lambda: defaultdict(int))

    def read(text):
        tokens = (text or "").encode().lower().split()
        return [*tokens, b"\n"], b"\n" * ORDER + b"".join(t + b" " for t in tokens) + b"\n"

    for d, t in rows:
        if not held[d]:
            tokens, data = read(t)
            for token in tokens:
                counts[token] += 1
            for i in range(ORDER, len(data)):
                for order in range(ORDER + 1):
                    model[data[i - order : i]][data[i]] += 1
    total, distinct = sum(counts.values()), len(counts)

    def cost(context, byte):
        gone, out = set(), 0.0
        for order in range(ORDER, -1, -1):
            seen = model.get(context[ORDER - order :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if byte in left:
                return out + math.log10(left[byte] / whole)
            if left:
                out += math.log10(len(left) / whole)
            gone |= set(left)
        return out - math.log10(max(1, ALPHABET - len(gone)))

    want = []
    for d, t in rows:
        tokens, data = read(t)
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens)
        score = sum(cost(data[i - ORDER : i], data[i]) for i in range(ORDER, len(data)))
        want.append((d, held[d], len(tokens), sum(counts.get(x, 0) > 0 for x in tokens), total, base, score))
    return want


def compare(frame, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in ppm_text.score(frame, fifth_held_out()).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_matches_definition(spark, monkeypatch, small):
    if small:  # many blocks, runs and buckets
        for name, size in (("BLOCK_BYTES", 3000), ("RUN_BYTES", 500), ("BUCKET_BYTES", 5000)):
            monkeypatch.setattr(ppm_text, name, size)
    rng = random.Random(6)
    stems = ["the", "then", "theory", "an", "and", "étude", "zebra", "x", "antidisestablishmentarianism"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "!", "é"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Qq \x00\x1c　 unseen中\n\nA"), (None, "the an"), (3, rows[3][1]), (104, "and " * 3_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", block int, pair string").repartition(3)
    compare(frame, rows)


def test_without_training_text_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    frame = spark.createDataFrame([(held, "some text")], SCHEMA)
    compare(frame, [(held, "some text")])
    assert ppm_text.score(frame.limit(0), fifth_held_out()).collect() == []


def test_order_of_words_counts(spark, tmp_path):
    from ledgerspark.llm.queries import QUERIES

    text = "we hold these truths to be self evident that all of them are created equal"
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    rows = [(i, text) for i in train] + [(held[0], text), (held[1], " ".join(reversed(text.split())))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r.doc_id: r for r in QUERIES["op5_ppm"](spark, str(tmp_path)).collect()}
    first, second = scores[held[0]], scores[held[1]]
    assert first.base_score == pytest.approx(second.base_score)
    assert first.n_known == second.n_known == first.n_tokens
    assert first.score > second.score + 10
