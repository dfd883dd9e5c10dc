"""Deduplication of repeated multi-line chunks with content-defined boundaries, by built-in functions alone.

Each line has a hash.  A rolling hash over the last ``WINDOW`` line hashes marks a line as the last one of its chunk
when it is divisible by ``DIVISOR``, so boundaries depend on nearby lines alone and survive shifts: text inserted
before a passage moves no boundary inside it.  Chunks longer than ``MAX_LINES`` are cut there.  Lines without a word
neither hash nor count, so blank lines don't move boundaries either.

A chunk of at least ``MIN_LINES`` lines with words and ``MIN_CHARS`` characters that stands anywhere before, in the
order of document id and position, is removed.  Repeats are found by a 64-bit hash of the chunk, then the bytes of the
chunks decide: only equal texts count as repeats.  Counting is by partial sums and the join back has plain exchanges on
both sides, so adaptive execution splits a chunk that very many documents share.  Documents are shuffled once, into
buckets of their row number; suspects and spans then meet them there, and only suspected chunks travel as texts.

``dedup_lines`` compares chunks alone, so lines of a repeated passage that share a chunk with other lines stay.
``dedup_runs`` removes whole repeated runs instead: each line that lies in a run of at least ``MIN_LINES`` lines with
words and ``MIN_CHARS`` characters, from a line with words to another, that stands anywhere before.  It compares the
shortest such run from each line on and up to each line; these cover the lines of every longer run, and each of them
stands before when the longer run does.  Runs may overlap their own copies; the first place of any line stays.
``dedup_passages`` does both at once: repeated chunks go, and the runs complete them at their edges.

Null and empty texts have no chunks and stay as they are.  Repeated rows are repeats of each other like any others;
rows with equal ids are told apart by an arbitrary but fixed row number.  Other columns are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark.llm.base import SPACE_BYTES, materialize, partitions
from ledgerspark.storage import scratch_path

WINDOW = 2
DIVISOR = 3
MAX_LINES = 16
MIN_LINES = 2
MIN_CHARS = 40
MODULUS = 1_000_003


def line_hash(line: Column) -> Column:
    """A hash of one line, the first 32 bits of its MD5 below ``MODULUS``; -1 for a line without words."""
    number = F.conv(F.left(F.md5(line.cast("binary")), F.lit(8)), 16, 10).cast("long") % MODULUS
    return F.when(line.rlike(f"[^{SPACE_BYTES}]"), number).otherwise(F.lit(-1).cast("long"))


def chunk_ends(lines: Column, window: int, divisor: int, max_lines: int) -> Column:
    """0-based numbers of the lines that end a chunk, in order."""

    def of_hashes(h: Column) -> Column:
        worded = F.filter(F.transform(h, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] >= 0)

        def of_worded(w: Column) -> Column:
            def mark(s: Column, n: Column) -> Column:
                # Positions before the first line count as zero.
                rolling = F.lit(0).cast("long")
                for back in range(window):
                    value = F.when(n >= back, F.get(w, n - back)["x"]).otherwise(F.lit(0).cast("long"))
                    rolling = (rolling + value * F.lit(31**back)) % MODULUS
                return F.when(rolling % divisor == 0, n)

            marked = F.filter(F.transform(w, mark), lambda n: n.isNotNull())
            last = F.size(w) - 1
            bounds = F.array_distinct(F.concat(F.array(F.lit(-1)), marked, F.array(last)))

            def cut(b: Column) -> Column:
                # Long stretches between marks are cut every ``max_lines`` lines.
                spans = F.transform(
                    F.sequence(F.lit(1), F.size(b) - 1),
                    lambda k: F.filter(
                        F.sequence(b[k - 1] + max_lines, b[k] + max_lines, F.lit(max_lines)), lambda x: x < b[k]
                    ),
                )
                return F.array_sort(F.array_distinct(F.concat(F.filter(b, lambda x: x >= 0), F.flatten(spans))))

            ends = F.transform(F.transform(F.array(bounds), cut)[0], lambda n: w[n]["i"])
            return F.when(F.size(w) > 0, ends).otherwise(F.expr("array()").cast("array<int>"))

        return F.transform(F.array(worded), of_worded)[0]

    return F.transform(F.array(F.transform(lines, line_hash)), of_hashes)[0]


def chunks(docs: DataFrame, text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, max_lines: int = MAX_LINES) -> Column:
    """The text's chunks, ``array<struct<first int, last int, worded int, body string>>``; lines after the last chunk
    have no words and belong to none."""
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)

    def of_lines(x: Column) -> Column:
        def of_ends(e: Column) -> Column:
            def piece(end: Column, k: Column) -> Column:
                first = F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)
                part = F.slice(x, first + 1, end - first + 1)
                return F.struct(
                    first.alias("first"),
                    end.alias("last"),
                    F.size(F.filter(part, lambda y: y.rlike(f"[^{SPACE_BYTES}]"))).alias("worded"),
                    F.array_join(part, "\n").alias("body"),
                )

            return F.transform(e, piece)

        return F.transform(F.array(chunk_ends(x, window, divisor, max_lines)), of_ends)[0]

    return F.transform(F.array(lines), of_lines)[0]


def shortest_runs(
    docs: DataFrame, text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, with_chunks: bool = False
) -> Column:
    """The text's shortest runs that are long enough, from each line with words on and up to each,
    ``array<struct<first int, last int, body string>>``; and its chunks that are long enough, each piece once."""
    # Lines with words have a character and a line break at least, so no shortest run has more steps.
    steps = range(min_lines - 1, max(min_lines - 1, (min_chars + 1) // 2) + 1)

    def of_lines(x: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i).rlike(f"[^{SPACE_BYTES}]"))

        def body(first: Column, last: Column) -> Column:
            return F.array_join(F.slice(x, first + 1, last - first + 1), "\n")

        def of_worded(w: Column) -> Column:
            def code(a: Column, b: Column) -> Column:
                long_enough = (a >= 0) & (b < F.size(w)) & (F.char_length(body(F.get(w, a), F.get(w, b))) >= min_chars)
                return F.when(long_enough, F.shiftleft(F.get(w, a).cast("long"), 32) + F.get(w, b))

            onward = F.transform(w, lambda i, n: F.coalesce(*[code(n, n + k) for k in steps]))
            back = F.transform(w, lambda i, n: F.coalesce(*[code(n - k, n) for k in steps]))
            found = [onward, back, *([chunk_codes()] if with_chunks else [])]
            return F.filter(F.array_distinct(F.concat(*found)), lambda c: c.isNotNull())

        def chunk_codes() -> Column:
            def of_ends(e: Column) -> Column:
                def code(end: Column, k: Column) -> Column:
                    first = F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)
                    lines = F.size(F.filter(F.slice(x, first + 1, end - first + 1), lambda y: y.rlike(f"[^{SPACE_BYTES}]")))
                    long_enough = (lines >= min_lines) & (F.char_length(body(first, end)) >= min_chars)
                    return F.when(long_enough, F.shiftleft(first.cast("long"), 32) + end)

                return F.transform(e, code)

            return F.transform(F.array(chunk_ends(x, WINDOW, DIVISOR, MAX_LINES)), of_ends)[0]

        def piece(c: Column) -> Column:
            first, last = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            return F.struct(first.alias("first"), last.alias("last"), body(first, last).alias("body"))

        return F.transform(F.transform(F.array(worded), of_worded)[0], piece)

    return F.transform(F.array(F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)), of_lines)[0]


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` written in buckets of ``key``: shuffled once, then joined by the key without moving them again."""
    spark = rows.sparkSession
    n = partitions(spark)
    name = f"lines_{uuid.uuid4().hex}"
    writer = rows.repartition(n, key).write.format("parquet").bucketBy(n, key)
    writer.option("path", scratch_path(spark, "lines-documents")).saveAsTable(name)
    return spark.table(name)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
    max_lines: int = MAX_LINES,
    min_lines: int = MIN_LINES,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text_col``, and ``removed_lines``, ``removed_chars`` (both long).

    Columns named like the last two are replaced.
    """
    numbered = _numbered(docs)
    parts = numbered.select(
        F.col(id_col).alias("__id"), "__row", F.explode(chunks(numbered, text_col, window, divisor, max_lines)).alias("__chunk")
    )
    large = parts.where((F.col("__chunk.worded") >= min_lines) & (F.char_length("__chunk.body") >= min_chars))
    return _without_repeats(numbered, large, text_col)


def dedup_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Like ``dedup_lines``, with all lines of repeated runs taken out."""
    numbered = _numbered(docs)
    runs = F.explode(shortest_runs(numbered, text_col, min_lines, min_chars)).alias("__chunk")
    return _without_repeats(numbered, numbered.select(F.col(id_col).alias("__id"), "__row", runs), text_col)


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Like ``dedup_lines``, with all lines of repeated runs taken out as well; both are found on the texts as they came."""
    numbered = _numbered(docs)
    pieces = F.explode(shortest_runs(numbered, text_col, min_lines, min_chars, with_chunks=True)).alias("__chunk")
    return _without_repeats(numbered, numbered.select(F.col(id_col).alias("__id"), "__row", pieces), text_col)


def _numbered(docs: DataFrame) -> DataFrame:
    names = [c for c in docs.columns if c not in ("removed_lines", "removed_chars")]
    return bucketed(docs.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__row")), "__row")


def _without_repeats(numbered: DataFrame, large: DataFrame, text_col: str) -> DataFrame:
    """``numbered`` without the lines of those pieces ``__id, __row, __chunk`` that stand before."""
    names = [c for c in numbered.columns if c != "__row"]
    large = large.select(
        F.struct("__id", "__row", F.col("__chunk.first").alias("first")).alias("at"),
        F.col("__chunk.last").alias("last"),
        F.xxhash64("__chunk.body").alias("hash"),
    )
    # A hash that occurs twice may be two equal texts; only then are texts sent out to be compared.
    repeated = materialize(large.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "lines-hashes")
    suspects = large.join(repeated, "hash").groupBy(F.col("at.__row").alias("__of"))
    suspects = suspects.agg(F.collect_list(F.struct("at", "last", "hash")).alias("__suspects"))
    bodies = numbered.join(suspects, F.col("__row") == F.col("__of")).select(
        F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1).alias("lines"), "__suspects"
    )
    piece = F.transform(
        F.array(F.struct("lines", "__suspects")),
        lambda p: F.transform(
            p["__suspects"],
            lambda s: F.struct(
                s["at"].alias("at"),
                s["last"].alias("last"),
                s["hash"].alias("hash"),
                F.array_join(F.slice(p["lines"], s["at"]["first"] + 1, s["last"] - s["at"]["first"] + 1), "\n").alias("body"),
            ),
        ),
    )[0]
    pieces = materialize(bodies.select(F.inline(piece)), "lines-candidates")
    first = pieces.groupBy("hash", "body").agg(F.min("at").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keepers = materialize(first.select("hash", "body", "keeper"), "lines-keepers")
    gone = (
        pieces.join(keepers.withColumnRenamed("body", "same"), "hash")
        .where("body = same and at != keeper")
        .select(F.col("at.__row").alias("__of"), F.col("at.first").alias("first"), "last")
    )
    spans = gone.groupBy("__of").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    rows = numbered.join(spans, F.col("__row") == F.col("__of"), "left")

    lines = F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)
    removed = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["first"], s["last"]))))
    left = F.transform(
        F.array(F.struct(lines.alias("x"), removed.alias("gone"))),
        lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p["x"]) - 1), p["gone"]), lambda i: p["x"][i]),
    )[0]
    text = F.when(F.col("__spans").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))
    rows = rows.withColumn("__text", text)
    return rows.select(
        *[(F.col("__text") if c == text_col else F.col(f"`{c}`")).alias(c) for c in names],
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.char_length(f"`{text_col}`") - F.char_length("__text"), F.lit(0)).cast("long").alias("removed_chars"),
    )
