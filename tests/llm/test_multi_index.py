"""The inverted multi-index against all pairs."""

import numpy as np
import pytest

from ledgerspark.llm import multi_index as mi

FIELDS = "vec_id long, embedding array<float>, label int, no string, x int"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute(rows, cosine=0.93):
    """vec_id, n_links, component_id by all pairs of equal labels."""
    fine = [i for i, (_, v, label, *_) in enumerate(rows) if usable(v) and label is not None]
    links, parent = {i: set() for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = {i: np.asarray(rows[i][1], np.float64) for i in fine}
    x = {i: v / np.abs(v).max() for i, v in x.items()}
    for i in fine:
        for j in fine:
            if i < j and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine:
                links[i].add(j), links[j].add(i)
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], len(links[i]), min(ids.get(find(i), [None]))) for i, r in enumerate(rows)), key=str)


def vectors(rng, n, dim=32):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return x


def family(rng, x, n, noise):
    return (x + noise * np.linalg.norm(x) * rng.normal(size=(n, len(x))) / len(x) ** 0.5).astype(np.float32)


def rows_of(x, start, label):
    return [(start + i, [float(c) for c in v], label, "a", 1) for i, v in enumerate(x)]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, FIELDS).repartition(5)
    return sorted((tuple(r) for r in mi.near_duplicates(frame, **options).collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = vectors(rng, 300)
    rows = rows_of(base, 0, 1) + rows_of(base[:40], 1000, 2)  # the same vectors with another label are no copies
    rows += rows_of(np.repeat(base[5:6], 30, axis=0), 2000, 1)  # exact copies
    rows += rows_of(base[6:7] * 3, 2100, 1)  # same direction
    rows += rows_of(family(rng, base[7], 60, 0.1), 3000, 1)  # a family of edited copies
    rows += rows_of(family(rng, base[8], 40, 0.27), 4000, 1)  # pairs on both sides of the threshold
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 32, [nan] + [1.0] * 31, [inf] + [1.0] * 31, [None] + [1.0] * 31, []]
    rows += [(5000 + i, v, 1, None, None) for i, v in enumerate(odd)]
    rows += [(6000, rows[5][1], None, "a", 1), (None, rows[9][1], 1, "a", 1), (9, rows[200][1], 1, "a", 1)]
    rows += [(7000, [1e30] * 32, 1, "a", 1), (7001, [1e-30] * 32, 1, "a", 1)]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 140
    assert run(spark, rows, block=16, cell=8) == want
    assert run(spark, rows) == want


def test_label_may_be_left_out(spark):
    rng = np.random.default_rng(4)
    x = vectors(rng, 20)
    rows = rows_of(x, 0, 1) + rows_of(x, 100, 2)
    want = brute([(*r[:2], 0) for r in rows])
    assert run(spark, rows, label_col=None, cell=4) == want


def test_empty_and_single_and_mixed(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1, "a", 1)]) == [(1, 0, 1)]
    assert run(spark, [(1, [0.5, 1.0], 1, "a", 1)]) == [(1, 0, 1)]
    assert run(spark, [(1, [2.0], 1, "a", 1), (2, [4.0], 1, "a", 1), (3, [-1.0], 1, "a", 1)]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    with pytest.raises(ValueError, match="components"):
        run(spark, [(1, [2.0], 1, "a", 1), (2, [4.0, 1.0], 1, "a", 1)])


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs at cosine 0.93 to 0.95, the hardest, in a grid of many cells."""
    rng = np.random.default_rng(5)
    base = vectors(rng, 1500, 64)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    mates = mi.turned(unit.astype(np.float64), 0.94, rng)
    rows = rows_of(unit, 0, 1) + rows_of(mates, 10_000, 1)
    want, got = brute_links(rows), {r[0]: r[1] for r in run(spark, rows, cell=16)}
    assert sum(want.values()) >= 3000
    assert sum(got.values()) >= 0.98 * sum(want.values())
    assert all(got[i] <= want[i] for i in got)


def brute_links(rows):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return dict(zip([r[0] for r in rows], ((x @ x.T) >= 0.93).sum(1) - 1))


def test_traversal_is_ordered_and_complete():
    rng = np.random.default_rng(6)
    first, second = rng.random(9), rng.random(7)
    cells = list(mi.multi_sequence(first, second, 1.1))
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert set(cells) == {(i, j) for i in range(9) for j in range(7) if first[i] + second[j] <= 1.1}


def test_forest_spans_components():
    linked = np.zeros((4, 3), bool)
    linked[0, 0] = linked[1, 0] = linked[1, 1] = linked[3, 2] = True
    assert mi.forest(linked).tolist() == [0, 0, 2, 3, 0, 0, 3]
