"""Gear chunks: cuts against the plain rolling hash, shifts, and removal of repeats."""

import random

import numpy as np

from ledgerspark.llm import gear


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    table, h, want = gear.gear_table(), 0, []
    for b in data:
        h = (2 * h + int(table[b])) % 2**32
        want.append(h)
    assert gear.gear_hashes(data, table).tolist() == want


def test_cuts_cover_the_text_within_bounds_and_between_characters():
    raw = (words(random.Random(2), 400) + "é中" * 900 + "a" * 5000).encode()
    cuts = gear.cut_points(np.frombuffer(raw, np.uint8), gear.gear_table(), 48, 6, 512)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(raw) and sizes.max() <= 512 and sizes[:-1].min() >= 48 - 3
    for a, b in zip([0, *cuts], cuts):
        raw[a:b].decode()


def test_passages_shifted_by_insertions_are_removed_and_others_stay(spark):
    rng = random.Random(3)
    passage = words(rng, 60)
    clean = [words(rng, 120) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, words(rng, 30 + i) + " " + passage + " " + words(rng, 40)) for i in range(5)]
    got = {r.doc_id: r for r in gear.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert all(got[i].text == text[i] and got[i].spans == [] for i in [*range(20), 100])
    for i in range(101, 105):
        assert got[i].removed_bytes >= 100 and {s.first_id for s in got[i].spans} == {100}
        raw = text[i].encode()
        gone = b"".join(raw[s.start : s.start + s.size] for s in got[i].spans)
        assert gone.decode() in text[100] or all(raw[s.start : s.start + s.size].decode() in text[100] for s in got[i].spans)
        assert len(got[i].text.encode()) + got[i].removed_bytes == len(raw)


def test_matches_brute_force_and_odd_rows(spark):
    rng = random.Random(4)
    base = [words(rng, 80) for _ in range(6)]
    texts = [base[rng.randrange(6)] + "\n" + base[rng.randrange(6)] for _ in range(30)] + [None, "", "short", "z" * 300_000]
    rows = [(i, t, b"x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest binary, id string")
    seen, want = set(), {}
    table = gear.gear_table()
    for i, t, *_ in rows:
        raw, start, kept = (t or "").encode(), 0, b""
        for end in gear.cut_points(np.frombuffer(raw, np.uint8), table, gear.MIN_BYTES, gear.MEAN_BITS, gear.MAX_BYTES):
            piece = raw[start:end]
            if len(piece) < gear.MIN_BYTES or piece not in seen:
                kept += piece
            if len(piece) >= gear.MIN_BYTES:
                seen.add(piece)
            start = end
        want[i] = kept.decode()
    assert {r.doc_id: r.text for r in gear.dedup_substrings(docs).collect()} == want
    assert gear.dedup_substrings(docs.limit(0)).collect() == []


def test_rows_go_by_their_own_number(spark):
    rng = random.Random(7)
    one, two, three, umlauts = words(rng, 60), words(rng, 60), words(rng, 60), "äöü中" * 200
    rows = [(1, one), (1, two), (1, one), (2, umlauts + two), (2, three + umlauts), (None, three), (None, three)]
    got = gear.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(rows)
    table, seen, want = gear.gear_table(), set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        raw, start, kept = rows[i][1].encode(), 0, b""
        for end in gear.cut_points(np.frombuffer(raw, np.uint8), table, gear.MIN_BYTES, gear.MEAN_BITS, gear.MAX_BYTES):
            piece = raw[start:end]
            if len(piece) < gear.MIN_BYTES or piece not in seen:
                kept += piece
            if len(piece) >= gear.MIN_BYTES:
                seen.add(piece)
            start = end
        want.append((str(rows[i][0]), kept.decode()))
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted(want)
