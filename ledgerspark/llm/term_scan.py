"""Ranked lexical search without an index of the documents: an Aho-Corasick automaton of all item terms runs over the
texts.

Terms are maximal runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased.  Texts are brought to a
form in which every separator is one blank and a blank stands at both ends; the automaton's words are the terms with a
blank on each side, so that these guards let it report whole terms only, and neighbours share a blank.

The documents are read twice.  The first scan counts, per task, documents with a term, all terms, and for each item term
the documents that hold it; a small aggregate adds these up.  The second scan counts each term's occurrences again, turns
them into integer scores of all items that hold the term, and keeps the best ``k`` documents per item in a heap; the heaps
of all tasks are ranked at the end.  Nothing is written per document and term.

The automaton travels to every task, so its size is bound: items are taken in groups whose terms hold at most
``GROUP_BYTES`` bytes, and each group has a scan of its own.  An item with more terms than that stands alone.

Scores are sums of ``weight * ((10^9 * tf) div (1000 * tf + 12 * m))`` with ``weight = floor(1000 * ln((2N + 2) / (2df + 1)))``
and ``m = 100 - 25 + (25 * n * N) div L``; N, L and n count documents with a term, their terms, and the terms of one
document.  Every addend is a whole number below 2^53 and so is every sum that ``_exact`` lets pass, so that adding them as
doubles is exact; longer items are added as 64-bit integers.

Null and empty texts have no term: such documents are not ranked and not counted, such items have no rows.  Items with
equal ids are one item, its terms added up; a null id is an id like any other.  Documents without an id are counted but
cannot be named and are not ranked; documents with equal ids are ranked one by one.  Equal scores go to the smaller
doc_id.  Scores of 0 are left out.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerspark.llm.base import bound_batches, materialize

#: Bytes of the distinct terms of one automaton.
GROUP_BYTES = 4 * 1024 * 1024
#: Documents scored together.
SCORED = 256

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def plain(text: bytes) -> bytes:
    """The text with one blank for each separator byte and A-Z lower-cased."""
    return text.translate(_PLAIN)


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, terms, counts``: one row per item id, its distinct terms and how often each occurs in it."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(plain(t).split()) if t else Counter() for t in batch.column("text").to_pylist()]
            terms = pa.array([list(f) for f in found], pa.list_(pa.binary()))
            counts = pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), terms, counts], names=["item", "terms", "counts"])

    kind = rows.schema["item"].dataType.simpleString()
    each = rows.mapInArrow(run, f"item {kind}, terms array<binary>, counts array<bigint>")
    each = each.select("item", F.inline(F.arrays_zip("terms", "counts"))).groupBy("item", "terms").agg(F.sum("counts").alias("n"))
    return each.groupBy("item").agg(F.collect_list(F.struct("terms", "n")).alias("terms"))


class Group:
    """Items with their terms as a matrix in rows per term, and what a scan of the texts for them needs."""

    def __init__(self, items: list[tuple[object, dict[bytes, int]]]):
        self.items = [item for item, _ in items]
        self.terms = sorted(set(chain.from_iterable(terms for _, terms in items)))
        number = {t: i for i, t in enumerate(self.terms)}
        entries = sorted((number[t], at, n) for at, (_, terms) in enumerate(items) for t, n in terms.items())
        rows, self.holders, self.times = (np.array(c, np.int64) for c in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 3
        self.starts = np.searchsorted(rows, np.arange(len(self.terms) + 1))
        self.longest = max((sum(terms.values()) for _, terms in items), default=0)

    def automaton(self) -> ahocorasick.Automaton:
        """Guarded terms, each with its number."""
        found = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            found.add_word(f" {decoded(term)} ", number)
        found.make_automaton()
        return found


def grouped_items(items: DataFrame, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """The items in groups of bounded size; one group at a time is on the driver."""
    taken: list[tuple[object, dict[bytes, int]]] = []
    size = 0
    for row in items.toLocalIterator():
        terms = {bytes(t["terms"]): t["n"] for t in row["terms"]}
        more = sum(map(len, terms)) + 64 * len(terms)
        if taken and size + more > limit:
            yield Group(taken)
            taken, size = [], 0
        taken.append((row["item"], terms))
        size += more
    if taken:
        yield Group(taken)


def occurrences(automaton: ahocorasick.Automaton, text: bytes) -> tuple[int, Counter]:
    """The number of all terms of a text, and how often each of the automaton's terms occurs."""
    form = plain(text)
    return len(form.split()), Counter(number for _, number in automaton.iter(f" {decoded(form)} "))


def statistics(texts: DataFrame, group: Group) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term of the group the documents that hold it."""
    n_terms = len(group.terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = group.automaton(), np.zeros(n_terms, np.int64)
        documents = words = 0
        for batch in batches:
            for text in batch.column("text"):
                n, found = occurrences(automaton, text.as_py())
                documents, words = documents + (n > 0), words + n
                held[list(found)] += 1
        some = np.nonzero(held)[0]
        numbers = np.concatenate([some, [-1, -2]])
        counts = np.concatenate([held[some], [documents, words]])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts, pa.int64())], names=["number", "n"])

    counted = texts.select("text").mapInArrow(scan, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    known = {r["number"]: r["n"] for r in counted.toLocalIterator()}  # at most one row per term of the group
    return known.get(-1, 0), known.get(-2, 0), np.array([known.get(i, 0) for i in range(n_terms)], np.int64)


def _exact(group: Group, weights: np.ndarray) -> bool:
    """Whether sums of doubles are exact: no addend exceeds weight times 10^6, an item has ``longest`` of them."""
    return int(weights.max(initial=0)) * 1_000_000 * group.longest < 2**53


class Best:
    """The ``k`` best documents of each item so far: heaps of (score, -doc_id)."""

    def __init__(self, n_items: int, k: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items)  # scores below cannot enter
        self.k = k

    def add(self, scores: np.ndarray, ids: list[int]) -> None:
        for at, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least[None, :]))):
            heap, entry = self.heaps[item], (int(scores[at, item]), -ids[at])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = max(1, heap[0][0])


def scores_of(group: Group, weights: np.ndarray, n_docs: int, n_words: int, lengths: list[int], found: list[Counter]) -> np.ndarray:
    """Scores of all items (columns) for some documents (rows)."""
    document = np.repeat(np.arange(len(found)), [len(f) for f in found])
    term = np.fromiter(chain.from_iterable(found), np.int64, len(document))
    tf = np.fromiter(chain.from_iterable(f.values() for f in found), np.int64, len(document))
    m = np.array([75 + 25 * n * n_docs // n_words for n in lengths], np.int64)  # Python integers: the product may be large
    value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[document]))
    # Each (document, term) meets the items that hold the term.
    width = group.starts[term + 1] - group.starts[term]
    entry = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(group.starts[term], width)
    cell = np.repeat(document, width) * len(group.items) + group.holders[entry]
    addend = np.repeat(value, width) * group.times[entry]
    size = len(found) * len(group.items)
    if _exact(group, weights):
        return np.bincount(cell, addend, size).reshape(len(found), -1)
    total = np.zeros(size, np.int64)
    np.add.at(total, cell, addend)
    return total.reshape(len(found), -1)


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``item_id, rank int, doc_id long, score long``: each item's ``k`` highest-scoring documents, best first."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").cast("binary").alias("text")).where("text is not null")
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    for group in grouped_items(materialize(item_terms(items, item_id, item_text), "scan-items"), group_bytes):
        n_docs, n_words, held = statistics(texts, group)
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
        heaps = texts.where("id is not null").mapInArrow(_scorer(group, weights, n_docs, n_words, k), "item int, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(group.items)), f"item int, {item_id} {kind}")
        found.append(ranked(materialize(heaps, "scan-heaps"), k).join(F.broadcast(names), "item"))
    if not found:
        return spark.createDataFrame([], f"{item_id} {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found).select(item_id, "rank", "doc_id", "score")


def ranked(heaps: DataFrame, k: int) -> DataFrame:
    """Ranks over the heaps of all tasks; Spark takes the first ``k`` of each partition before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scorer(group: Group, weights: np.ndarray, n_docs: int, n_words: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best = group.automaton(), Best(len(group.items), k)
        ids: list[int] = []
        lengths: list[int] = []
        found: list[Counter] = []

        def settle() -> None:
            if found:
                best.add(scores_of(group, weights, n_docs, n_words, lengths, found), ids)
            ids.clear(), lengths.clear(), found.clear()

        for batch in batches:
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                n, hits = occurrences(automaton, text.as_py())
                if hits:
                    ids.append(number), lengths.append(n), found.append(hits)
                if len(found) == SCORED:
                    settle()
        settle()
        rows = [(item, -negative, value) for item, heap in enumerate(best.heaps) for value, negative in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"]
        )

    return score
