"""Block tiles against brute force in the same order of additions."""

import numpy as np

from ledgerspark.llm import tiles


def brute(rows, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in fine:
        if q % 20 == 0:
            scored = []
            for c, y in fine:
                if c != q:
                    s = 0.0
                    for a, b in zip(x, y):
                        s += float(a) * float(b)
                    scored.append((-s, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_matches_brute_force_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(40 + 2000, rows[40][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [nan] * 24), (3003, [inf] + [0.0] * 23), (3004, [None] + [1.0] * 23), (None, [1.0] * 24)]
    rows += [(3020, [1e30] * 24), (3040, [1e-30] * 24)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, id int, v int")
        given = [(r.vec_id, r.embedding) for r in frame.collect()]
        got = tiles.nearest(frame, block=64)
        assert sorted(tuple(r) for r in got.collect()) == brute(given, 20)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in tiles.nearest(frame).collect()) == brute(rows, 20)
    assert tiles.nearest(frame.where("vec_id = 0")).collect() == []
    assert tiles.nearest(frame.limit(0)).collect() == []


def test_error_bound_holds_for_long_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3000)) * np.exp(rng.normal(size=(40, 1)) * 3)
    packed = tiles.unpack(tiles.pack(np.arange(40), x))
    found = tiles.nearest_in_tile(packed, packed, 3)
    for q, scores, ids in found:
        exact = sorted(((-float(np.dot(x[q], x[c])), c) for c in range(40) if c != q))[:3]
        assert ids == [c for _, c in exact]
