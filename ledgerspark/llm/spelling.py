"""Spelling variants of a corpus vocabulary by a bit-sliced position index.

Two words are near if exactly one code point is inserted, deleted or replaced.  For the words of a block the index holds
one bitset per (position, letter): bit w is set if word w has the letter there.  For a query the sets of all words are
carried through its letters at once, 64 words to a machine word, and many queries together:

    Z   words that agree so far
    S   words that differ in one replaced letter so far      S = S & B[k][q_k]  |  Z & ~B[k][q_k]
    I   words with one letter more so far (shifted by one)    I = I & B[k+1][q_k]  |  Z'

The shorter word of a pair is always the query, so a deletion is the other word's insertion.

Words meet in groups, so that not all are compared with all.  A pair whose shorter word has L letters agrees in the first
or in the last ``h = min(AFFIX, L // 2)`` letters, as one edit cannot touch both; a group holds the words of L and L+1
letters with the same ``h`` letters at one end.  A pair that agrees at both ends counts at the front only: there the
set Z after ``h`` letters takes it out at the back.  Large groups are dealt into blocks, and blocks of queries meet
blocks of the index; what leaves a task is one row per word with the number of its near words and the best of them.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that count is at least
``ratio`` times its own; following forms to the last gives its root, by joins that double the length of the steps.
Counts at least double along the way, so it ends.

Words are those of ``vocabulary``: maximal runs of letters with A-Z lower-cased.  Null and empty texts have none; a null
doc_id reads as an empty one; repeated rows count again.  ``variants`` takes any table of distinct words with counts;
null words are left out.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerspark.llm.base import bound_batches, materialize
from ledgerspark.storage import lookup

#: Letters that the words of a group share at one end, at most.
AFFIX = 3
#: Words per block, about.
BLOCK = 4_096
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Machine words in one step of the recurrences.
STEP = 1 << 17
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def spelled(doc_id: str, run: str, every: int) -> str:
    """The run, without one letter if ``every`` divides its hash with the document's id."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    every: int = 97,
) -> DataFrame:
    """``word, n``: the distinct words of all texts with at least so many letters and occurrences.

    Runs whose hash with the document's id ``every`` divides lose a letter first: misspellings to be found.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    ).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"]
            )
            words.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                runs = Counter(_RUN.findall(text.as_py().translate(_LOWER).decode("utf-8", "replace")))
                for run, n in runs.items():
                    word = spelled(doc_id, run, every)
                    if len(word) >= min_letters:
                        words[word] += n
                if len(words) >= COUNTED:
                    yield passed_on()
        yield passed_on()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---- the index ---------------------------------------------------------------------------------------------
def letters(words: list[str], width: int) -> np.ndarray:
    """Code points in rows per word, 0 beyond its end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def bitsets(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)])).view("<u8")


def near_pairs(short: list[str], words: list[str], length: int, affix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``short``, in ``words``) of all pairs with one edit; ``short`` have ``length`` letters, ``words`` as
    many or one more.  With ``affix``, pairs that agree in so many first letters are left out."""
    codes = letters(words, length + 1)
    known, place = np.unique(codes, return_inverse=True)
    place = place.reshape(codes.shape)
    # One row more than letters, all zero, for letters of queries that no word has.
    index = np.stack([bitsets(np.vstack([place[:, k] == c for c in range(len(known))] + [np.zeros(len(words), bool)])) for k in range(length + 1)])
    every = bitsets(np.ones((1, len(words)), bool))
    longer = bitsets(codes[:, length][None, :] != 0)
    asked = letters(short, length)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    asked = np.where(known[at] == asked, at, len(known))

    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, STEP // every.shape[1])
    for start in range(0, len(short), step):
        q = asked[start : start + step]
        agree = np.repeat(every, len(q), axis=0)
        replaced = np.zeros_like(agree)
        inserted = agree.copy()
        front = None
        for k in range(length):
            here, shifted = index[k][q[:, k]], index[k + 1][q[:, k]]
            replaced = (replaced & here) | (agree & ~here)
            agree = agree & here
            inserted = (inserted & shifted) | agree
            if k + 1 == affix:
                front = agree
        near = (replaced & ~longer) | (inserted & longer)
        if front is not None:
            near &= ~front
        i, lane = np.nonzero(near)
        hit, bit = np.nonzero(np.unpackbits(near[i, lane][:, None].view(np.uint8), axis=1, bitorder="little"))
        rows.append(i[hit] + start)
        cols.append(lane[hit] * 64 + bit)
    return np.concatenate(rows), np.concatenate(cols)


def best_of(whose: np.ndarray, near: np.ndarray, size: int, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` words how many near ones it has, and the position of the best in ``words`` (or their number)."""
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    rank = np.empty(len(words) + 1, np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(size, len(words))
    np.minimum.at(best, whose, rank[near])
    order.append(len(words))
    return np.bincount(whose, minlength=size), np.array(order)[best]


FOUND = "word string, n_near long, best_n long, best string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            length, affix = row["length"], row["affix"] if row["back"] else 0
            short = [x["word"] for x in row["queries"] if len(x["word"]) == length]
            short_n = np.array([x["n"] for x in row["queries"] if len(x["word"]) == length], np.int64)
            words, words_n = [x["word"] for x in row["words"]], np.array([x["n"] for x in row["words"]], np.int64)
            if not short:
                continue
            q, w = near_pairs(short, words, length, affix)
            # A pair of equal length is met from both ends, one of different length only here.
            is_longer = np.array([len(words[i]) > length for i in w.tolist()], bool)
            out: list[tuple[str, int, int, str]] = []
            for names, (n_near, best), others, n in (
                (short, best_of(q, w, len(short), words, words_n), words, words_n),
                (words, best_of(w[is_longer], q[is_longer], len(words), short, short_n), short, short_n),
            ):
                some = np.nonzero(n_near)[0]
                out += [(names[i], int(n_near[i]), int(n[best[i]]), others[best[i]]) for i in some.tolist()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["word", "n_near", "best_n", "best"]
            )


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` of each word of ``words (word, n)`` that has near ones."""
    bound_batches(words.sparkSession)
    size = F.char_length("word")
    lengths = F.filter(F.array(size, size - 1), lambda x: x >= min_letters)
    each = words.select("word", "n", F.explode(lengths).alias("length")).withColumn("affix", F.least(F.lit(AFFIX), F.expr("int(length div 2)")))
    each = each.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    each = each.withColumn("ends", F.when(F.col("back"), F.right("word", F.col("affix"))).otherwise(F.left("word", F.col("affix"))))
    group = ["length", "affix", "back", "ends"]
    sizes = materialize(each.groupBy(*group).agg(F.count(F.lit(1)).alias("members")), "spelling-groups")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = lookup(each, sizes, group, ["blocks"], spread_by="word", weight="members")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy(*group, "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    packed = materialize(packed, "spelling-blocks")
    queries = packed.select(*group, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("words").alias("queries"))
    pairs = queries.join(packed.select(*group, "block", "words"), [*group, "block"]).select("length", "affix", "back", "queries", "words")
    found = pairs.mapInArrow(_compare, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: the last form of each word that has one."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left"), "spelling-roots")
        if joined.where("next is not null").isEmpty():
            return now
        now = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, min_letters: int = MIN_LETTERS, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``words (word, n)``."""
    words = materialize(words.where("word is not null").select("word", "n"), "spelling-words")
    known = words.join(near_words(words, min_letters, block), "word", "left")
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    known = known.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    known = materialize(known, "spelling-known")
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
