"""Line chunks: boundaries and removal against a plain walk over the lines."""

import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import line_chunks as lc

SPACE = " \t\n\x0b\x0c\r"


def worded(line):
    return bool(re.search(r"[^\x20\x09-\x0D]", line))


def chunks(text):
    lines = text.split("\n")
    own = [i for i, x in enumerate(lines) if worded(x)]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) % lc.MODULUS for i in own]
    ends, mark = [], -1
    for n in range(len(own)):
        rolling = sum((h[n - b] if n >= b else 0) * 31**b for b in range(lc.WINDOW)) % lc.MODULUS
        if rolling % lc.DIVISOR == 0 or n == len(own) - 1:
            ends.append(n)
            mark = n
        elif (n - mark) % lc.MAX_LINES == 0:
            ends.append(n)
    out, first = [], 0
    for n in ends:
        out.append((first, own[n], "\n".join(lines[first : own[n] + 1])))
        first = own[n] + 1
    return out


def brute(rows):
    seen, want = set(), []
    for d, t in rows:
        lines, gone = (t or "").split("\n"), set()
        for first, last, body in chunks(t or ""):
            if sum(map(worded, body.split("\n"))) >= lc.MIN_LINES and len(body) >= lc.MIN_CHARS:
                if body in seen:
                    gone |= set(range(first, last + 1))
                seen.add(body)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((d, t if not gone else kept, len(gone), 0 if t is None else len(t) - (len(kept) if gone else len(t))))
    return want


def rows(seed=1):
    rng = random.Random(seed)
    pool = [" ".join("w%d" % rng.randrange(50) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["", "  ", "\t", "é中"]
    passage = [" ".join("p%d" % rng.randrange(900) for _ in range(9)) for _ in range(14)]
    texts = []
    for i in range(50):
        own = [" ".join(f"d{i}x{rng.randrange(999)}" for _ in range(6)) for _ in range(rng.randint(0, 8))]
        texts.append("\n".join([*own, *(passage if rng.random() < 0.4 else []), *(rng.choice(pool) for _ in range(rng.randint(0, 30)))]))
    texts += [None, "", "\n\n", "one line", "\n".join("same line" for _ in range(70)), "\n".join("l%d" % i for i in range(20_000)), "a\r\nb\r\nc"]
    return list(enumerate(texts))


def test_matches_plain_walk(spark):
    given = rows()
    frame = spark.createDataFrame([(*r, 7, 8, "x") for r in given], "doc_id long, text string, hash int, removed_lines int, body string")
    out = lc.dedup_lines(frame)
    assert out.columns == ["doc_id", "text", "hash", "body", "removed_lines", "removed_chars"]
    got = sorted(tuple(r) for r in out.select("doc_id", "text", "removed_lines", "removed_chars").collect())
    assert got == brute(given)


def test_repeated_rows_and_empty(spark):
    text = "\n".join(f"line number {i} of the text" for i in range(12))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text + "\nand one more")], "doc_id long, text string").coalesce(1)
    got = lc.dedup_lines(frame).collect()
    assert sorted(r.removed_lines > 0 for r in got if r.doc_id == 1) == [False, True]
    assert lc.dedup_lines(frame.limit(0)).collect() == []


def test_boundaries_survive_shifts():
    rng = random.Random(9)
    passage = [" ".join("p%d" % rng.randrange(900) for _ in range(9)) for _ in range(40)]
    one = {c[2] for c in chunks("\n".join(passage))}
    two = {c[2] for c in chunks("\n".join(["inserted", "lines", "here", *passage]))}
    assert len(one & two) >= len(one) - 2


def brute_runs(rows):
    """Lines of all runs that stand before, at the same line breaks, by comparing every run with every earlier one."""
    seen, want = set(), []
    for d, t in rows:
        lines, gone = (t or "").split("\n"), set()
        own = [i for i, x in enumerate(lines) if worded(x)]
        for a in range(len(own)):
            for b in range(a + lc.MIN_LINES - 1, len(own)):
                body = "\n".join(lines[own[a] : own[b] + 1])
                if len(body) >= lc.MIN_CHARS:
                    if body in seen:
                        gone |= set(range(own[a], own[b] + 1))
                    seen.add(body)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((d, t if not gone else kept, len(gone)))
    return want


def test_whole_repeated_runs_go(spark):
    rng = random.Random(5)
    unique = lambda n: [" ".join("u%d" % rng.randrange(10**6) for _ in range(6)) for _ in range(n)]
    given = []
    for m in range(2, 12):
        passage = unique(m)
        given += [(2 * m, "\n".join(unique(3) + passage + unique(2))), (2 * m + 1, "\n".join(unique(2) + passage + unique(4)))]
    out = lc.dedup_runs(spark.createDataFrame(given, "doc_id long, text string"))
    assert {r.doc_id: r.removed_lines for r in out.collect()} == {i: i // 2 * (i % 2) for i, _ in given}


def test_runs_match_every_run(spark):
    given = [r for r in rows(2) if len(r[1] or "") < 10_000]
    given += [(500, "a\n\nb\n" * 30), (501, "x\ny\nz\n" + "long line " * 5 + "\nq\n \nr"), (502, "z\n" + "long line " * 5 + "\nq\n \nr\ns"), (503, "a\n\nb")]
    frame = spark.createDataFrame([(*r, 7, 8, "x") for r in given], "doc_id long, text string, hash int, removed_lines int, body string").repartition(3)
    out = lc.dedup_runs(frame)
    assert out.columns == ["doc_id", "text", "hash", "body", "removed_lines", "removed_chars"]
    assert sorted(tuple(r) for r in out.select("doc_id", "text", "removed_lines").collect()) == brute_runs(given)
    assert lc.dedup_runs(frame.limit(0)).collect() == []
    long = "\n".join("l%d" % i for i in range(20_000))
    got = lc.dedup_runs(spark.createDataFrame([(1, long), (2, long), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.removed_lines) for r in got) == [(1, 0), (2, 20_000), (3, 0)]


def test_passages_are_chunks_completed_by_runs(spark):
    rng = random.Random(8)
    lines = [f"line {i} of a text with some words in it" if i % 3 else "" for i in range(60)]
    rows = []
    for d in range(40):
        at = rng.randrange(len(lines) - 12)
        text = [rng.choice(["", f"own {d} {i} words of this text alone"]) for i in range(6)] + lines[at : at + rng.randint(2, 12)]
        text.insert(rng.randrange(len(text)), " ")
        rows.append((d, "\n".join(text + [f"end {d}"])))
    for d in range(6):  # equal texts that begin with a blank line
        rows += [(40 + 2 * d + twice, "\n" + "\n".join(f"head {d} line {i} with some words in it" for i in range(8))) for twice in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text.split("\n") for r in docs.collect()}

    def gone(large):
        """Line numbers per document of the pieces that stand before."""
        pieces = sorted((r.doc_id, r.p.first, r.p.last, r.p.body) for r in large.collect())
        first, out = {}, {d: set() for d in texts}
        for d, a, b, body in pieces:
            if (at := first.setdefault(body, (d, a))) != (d, a):
                assert at < (d, a)
                out[d] |= set(range(a, b + 1))
        return out

    every = docs.select("doc_id", F.explode(lc.chunks(docs)).alias("p"))
    chunks = gone(every.where((F.col("p.worded") >= 2) & (F.char_length("p.body") >= 40)))
    runs = gone(docs.select("doc_id", F.explode(lc.shortest_runs(docs)).alias("p")))
    assert any(chunks[d] - runs[d] for d in texts) and any(runs[d] - chunks[d] for d in texts)
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, docs.selectExpr("*", "'en' lang", "'s' source", "0L n_chars"), "").collect()}
    for d, x in texts.items():
        assert got[d] == ([line for i, line in enumerate(x) if i not in chunks[d] | runs[d]] or [""])
