"""Code length of whole documents under prediction by partial matching (PPM), byte by byte.

The text is read as lower-case (A-Z) words, each followed by a space, and one end mark; ``ORDER`` end marks stand before
it.  Every byte is predicted from the ``ORDER`` bytes before it, across words: the longest context known from training
comes first, and when it has not seen the byte, an escape (method C: as likely as the number of different bytes seen)
leads to the context one byte shorter, where the bytes of the longer one are excluded.  After the empty context all
bytes not yet seen are equally likely.

1. Documents are read once, in blocks of bounded size; a block is one row that keeps its texts compressed.
2. A block counts its distinct windows (``ORDER`` bytes of context and the byte) and its distinct words in training
   texts, and deals them over buckets by a hash of the context or word.  The number of buckets follows the text.
3. A bucket holds all bytes of a context, so it adds up the counts of all blocks and answers to each block what its
   words count and what its windows and their contexts count, but for windows not seen in training.
4. Windows not seen in training go down order by order until their byte is found; counts of a shorter context follow
   from those of the longer ones, and are dealt again by that context.  Below order ``LEAST_DEALT`` contexts are few, and
   may be frequent: there the pairs, as few, are joined (``ppm.pair_costs``).
5. Answers go back to the blocks, and each block adds up its documents.

Nothing but a few totals comes to the driver.  Null and empty texts have the end mark alone.  Repeated rows are scored
each for itself, a null id counts as the empty text when folds are dealt.  Without training text all bytes are equally
likely.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerspark.llm.base import materialize, slices, text_or_empty
from ledgerspark.llm.ppm import END, ORDER, _cut, _node, nodes, pair_costs

BLOCK_BYTES = 12_000_000
#: Windows of a block are made from runs of about this many bytes.
RUN_BYTES = 1_000_000
BUCKET_BYTES = 8_000_000
LONGEST = np.uint64(ORDER << 56)
#: The lowest order at which pairs are dealt by context.
LEAST_DEALT = 3

BLOCKS = "block long, ids array<{id}>, held_out array<boolean>, texts binary"
ASKED = "block long, bucket int, windows binary, trained binary, words binary, counts binary"
ANSWERS = "block long, bucket int, seen binary, out_of binary, counts binary, pair long, c long, cost double, total long, distinct long"
LOWER = "pair long, c long, cost double, found boolean"


def shrink(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if len(raw) else b""


def grow(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True) if packed else b""


def shrink_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as eight runs of bytes: those of like weight compress well."""
    return shrink(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def grow_numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(grow(packed), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def table_of(schema: pa.Schema, rows: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def read_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    ddl = BLOCKS.format(id=docs.schema[id_col].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))

    def run(batches):
        made, size, ids, held, texts = TaskContext.get().partitionId() << 32, 0, [], [], []

        def block():
            lists = ([made], [ids], [held], [shrink(b"".join(texts))])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(lists, schema)], schema=schema)

        for whole in batches:
            for batch in slices(whole, 2):
                for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                    ids.append(doc_id)
                    held.append(out)
                    texts.append(b" ".join([*text.encode("utf-8", "replace").lower().split(), END]))
                    size += len(texts[-1]) + 64
                    if size >= BLOCK_BYTES:
                        yield block()
                        made, size, ids, held, texts = made + 1, 0, [], [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, ddl)


def texts_of(packed: bytes) -> list[bytes]:
    """The texts of a block, each with its end mark."""
    return [t + END for t in grow(packed).split(END)[:-1]]


def runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= RUN_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def windows(texts: list[bytes]) -> np.ndarray:
    """Per byte of the texts: the byte, and above it the bytes before it, nearest lowest."""
    framed = np.frombuffer(b"".join(END * ORDER + t for t in texts), np.uint8)
    out = framed[ORDER:].astype(np.uint64)
    for order in range(1, ORDER + 1):
        out |= framed[ORDER - order : -order].astype(np.uint64) << np.uint64(8 * order)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + ORDER) - ORDER
    keep = np.ones(len(out), bool)
    keep[(ends[:-1, None] + np.arange(ORDER)).ravel()] = False
    return out[keep]


def window_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket holds all bytes after a context; it is dealt by all but the nearest byte, so that keys lie close."""
    mixed = (keys >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def distinct_windows(texts: list[bytes], train: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows by bucket and value, how often they occur in training texts, and where each bucket starts."""
    found = []
    for first, last in runs(texts):
        part = texts[first:last]
        marks = np.repeat(train[first:last], np.fromiter(map(len, part), np.int64, len(part))).astype(np.uint64)
        both = (windows(part) << np.uint64(1)) | marks
        both.sort()
        keys = both >> np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found.append((keys[starts], np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts)))
    keys, counts = found[0] if len(found) == 1 else summed(*(np.concatenate(x) for x in zip(*found)))
    bucket = window_bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return keys[order], counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def numbered(texts: list[bytes]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct words in the order of their first places, and the end mark; per run, how many words each text has, and
    its words as numbers."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    found = []
    for first, last in runs(texts):
        part = texts[first:last]
        # In a block each word ends in a space.
        sizes = np.fromiter((t.count(b" ") for t in part), np.int64, len(part))
        found.append((sizes, np.fromiter(map(number.__getitem__, b"".join(part).split()), np.int32, int(sizes.sum()))))
    return [*number, END], found


def word_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words by bucket, and where each bucket starts."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ASKED))

    def run(batches):
        for batch in batches:
            for block, held, packed in zip(*(batch.column(n).to_pylist() for n in ("block", "held_out", "texts"))):
                texts, train = texts_of(packed), ~np.array(held, bool)
                keys, trained, at = distinct_windows(texts, train, buckets)
                words, numbers = numbered(texts)
                counts = np.zeros(len(words), np.int64)
                counts[-1] = train.sum()
                for (first, last), (sizes, n) in zip(runs(texts), numbers):
                    counts[:-1] += np.bincount(n[np.repeat(train[first:last], sizes)], minlength=len(words) - 1)
                order, word_at = word_buckets(words, buckets)
                words, counts = [words[i] for i in order.tolist()], counts[order]
                for first in range(0, buckets, 64):
                    rows = []
                    for b in range(first, min(first + 64, buckets)):
                        k, w = slice(at[b], at[b + 1]), slice(word_at[b], word_at[b + 1])
                        if k.start < k.stop or w.start < w.stop:
                            steps = np.diff(keys[k], prepend=np.uint64(0))
                            packs = (shrink_numbers(steps), shrink_numbers(trained[k]), shrink(b" ".join(words[w])))
                            rows.append((block, b, *packs, shrink_numbers(counts[w])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.mapInArrow(run, ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """Rows of five kinds: ``block, bucket, seen, out_of, counts`` answers a block, with 0 seen for windows not seen in
    training; ``pair, c`` is a window seen in training; ``block, pair`` one that was not, and ``pair, cost`` the cost of
    its first escape; ``total, distinct`` counts tokens."""
    schema = to_arrow_schema(StructType.fromDDL(ANSWERS))

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        keys = [np.cumsum(grow_numbers(x), dtype=np.uint64) for x in table.column("windows").to_pylist()]
        trained = [grow_numbers(x).astype(np.int64) for x in table.column("trained").to_pylist()]
        words = [grow(x).split(b" ") if x else [] for x in table.column("words").to_pylist()]
        total: dict[bytes, int] = {}
        for names, packed in zip(words, table.column("counts").to_pylist()):
            for word, c in zip(names, grow_numbers(packed).tolist()):
                total[word] = total.get(word, 0) + c
        pairs, c = summed(np.concatenate(keys), np.concatenate(trained))
        _, node = np.unique(pairs >> np.uint64(8), return_inverse=True)
        kinds = np.bincount(node, weights=c > 0)[node].astype(np.int64)
        out_of = np.bincount(node, weights=c)[node].astype(np.int64) + kinds
        places = [np.searchsorted(pairs, k) for k in keys]
        parts = [
            table_of(
                schema, len(blocks), block=table.column("block").combine_chunks(), bucket=table.column("bucket").combine_chunks(),
                seen=pa.array([shrink_numbers(c[p]) for p in places], pa.binary()),
                out_of=pa.array([shrink_numbers(out_of[p]) for p in places], pa.binary()),
                counts=pa.array([shrink_numbers(np.fromiter(map(total.__getitem__, w), np.int64, len(w))) for w in words], pa.binary()),
            ),
            table_of(schema, 1, total=pa.array([sum(total.values())]), distinct=pa.array([sum(n > 0 for n in total.values())])),
        ]
        seen = c > 0
        full = (pairs | LONGEST).view(np.int64)
        parts.append(table_of(schema, int(seen.sum()), pair=pa.array(full[seen]), c=pa.array(c[seen])))
        escape = np.log10(np.where(kinds > 0, kinds, 1) / np.where(kinds > 0, out_of, 1))
        parts.append(table_of(schema, int((~seen).sum()), pair=pa.array(full[~seen]), cost=pa.array(escape[~seen])))
        for block, p in zip(blocks, places):
            new = full[p[c[p] == 0]]
            parts.append(table_of(schema, len(new), block=pa.array(np.full(len(new), block, np.int64)), pair=pa.array(new)))
        return pa.Table.from_batches(parts)

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


def found_at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where; others are given the place 0."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)), at


def step_down(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """From ``pair, c`` at the next higher order and ``pair, cost`` of windows not found there: ``pair, c`` at ``order``,
    and ``pair, cost, found`` of these windows, with the cost of this order added."""
    schema = to_arrow_schema(StructType.fromDDL(LOWER))
    low, here, above = (np.uint64((1 << bits) - 1) for bits in (56, 8 * order + 8, 8 * order + 16))
    byte = np.uint64(8)

    def run(table: pa.Table) -> pa.Table:
        known = pc.is_valid(table.column("c"))
        longer, open_ = table.filter(known), table.filter(pc.invert(known))
        longer_keys = longer.column("pair").to_numpy().view(np.uint64) & low
        asked, cost = open_.column("pair").to_numpy(), open_.column("cost").to_numpy().copy()
        keys, c = longer_keys & here, longer.column("c").to_numpy()
        if len(keys):
            keys, c = summed(keys, c)
            nodes_, node = np.unique(keys >> byte, return_inverse=True)
            total, kinds = np.bincount(node, weights=c), np.bincount(node)
            # What the bytes seen after the longer contexts count here is excluded.
            outer, owner = np.unique(longer_keys >> byte, return_inverse=True)
            gone = np.bincount(owner, weights=c[np.searchsorted(keys, longer_keys & here)])
            gone_kinds = np.bincount(owner)
            windows_ = asked.view(np.uint64) & low
            is_known, n = found_at(nodes_, (windows_ & here) >> byte)
            has_outer, at = found_at(outer, (windows_ & above) >> byte)
            left_kinds = np.where(is_known, kinds[n] - np.where(has_outer, gone_kinds[at], 0), 0)
            left = np.where(is_known, total[n] - np.where(has_outer, gone[at], 0), 0) + left_kinds
            found, at = found_at(keys, windows_ & here)
            share = np.where(found, c[at], left_kinds)
            cost += np.log10(np.where(share > 0, share, 1) / np.where(share > 0, left, 1))
        else:
            found = np.zeros(len(asked), bool)
        return pa.Table.from_batches([
            table_of(schema, len(keys), pair=pa.array((keys | np.uint64(order << 56)).view(np.int64)), c=pa.array(c)),
            table_of(schema, len(asked), pair=pa.array(asked), cost=pa.array(cost), found=pa.array(found)),
        ])

    context = F.shiftright(_cut("pair", F.lit(order)), 8)
    return rows.groupBy(F.pmod(F.xxhash64(context), F.lit(buckets)).alias("b")).applyInArrow(run, LOWER)


def new_costs(answers: DataFrame, buckets: int) -> DataFrame:
    """``pair, cost`` of each window that was not seen in training."""
    rows, done = answers.where("block is null and pair is not null").select("pair", "c", "cost"), []
    for order in range(ORDER - 1, LEAST_DEALT - 1, -1):
        table = materialize(step_down(rows, order, buckets), f"ppm-order-{order}")
        done.append(table.where("found").select("pair", "cost"))
        rows = table.where("c is not null or not found").select("pair", "c", "cost")
    levels = [rows.where("c is not null").select("pair", "c")]
    for order in range(LEAST_DEALT - 1, -1, -1):
        cut = levels[-1].select(_cut("pair", F.lit(order)).alias("pair"), "c")
        levels.append(materialize(cut.groupBy("pair").agg(F.sum("c").alias("c")), f"ppm-order-{order}"))
    pairs = reduce(DataFrame.union, levels)
    contexts = materialize(nodes(pairs), "ppm-nodes")
    open_ = rows.where("c is null").select("pair", "cost", _cut("pair", F.lit(LEAST_DEALT)).alias("last"))
    rest = pair_costs(open_.select(F.col("last").alias("pair")).distinct(), pairs, contexts)
    rest = rest.select(F.col("pair").alias("last"), F.col("cost").alias("rest"))
    # The rest starts with the escape at the lowest dealt order, which is in the cost already.
    first = contexts.select("node", F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("first"))
    open_ = open_.join(rest, "last").withColumn("node", _node("last")).join(first, "node", "left")
    done.append(open_.select("pair", F.expr("cost + rest - coalesce(first, 0D)").alias("cost")))
    return materialize(reduce(DataFrame.union, done), "ppm-costs")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (smoothed unigrams) and ``score`` (PPM), both log10.  Texts with ``held_out`` don't train."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    blocks = materialize(read_blocks(docs, id_col, text_col, F.coalesce(held_out, F.lit(False))), "ppm-blocks")
    answers = materialize(answer(ask(blocks, buckets)), "ppm-answers")
    total, distinct = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    costs = new_costs(answers, buckets)
    none = F.lit(None)
    known = answers.where("seen is not null").select("block", "bucket", "seen", "out_of", "counts", none.cast("long").alias("pair"), none.cast("double").alias("cost"))
    new = answers.where("block is not null and pair is not null").select("block", "pair").join(costs, "pair")
    told = known.unionByName(new, allowMissingColumns=True)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left.column("texts")[0].as_py())
        rows = right.filter(pc.is_valid(right.column("seen"))).sort_by("bucket")
        # The windows and words of a bucket come in the order in which the block has asked for them.
        found, places = [], []
        for first, last in runs(texts):
            run = windows(texts[first:last])
            order = np.argsort(run)
            run = run[order]
            new = np.concatenate([[True], run[1:] != run[:-1]])
            places.append(np.empty(len(run), np.int32))
            places[-1][order] = np.cumsum(new) - 1
            found.append(run[new])
        keys = np.sort(np.concatenate(found))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        words, numbers = numbered(texts)
        seen, out_of, counts = (
            np.concatenate([grow_numbers(x) for x in rows.column(n).to_pylist()]).astype(np.int64) for n in ("seen", "out_of", "counts")
        )
        cost = np.empty(len(keys))
        cost[np.argsort(window_bucket(keys, buckets), kind="stable")] = np.log10(np.where(seen > 0, seen, 1) / np.where(seen > 0, out_of, 1))
        extra = right.filter(pc.is_valid(right.column("pair")))
        cost[np.searchsorted(keys, extra.column("pair").to_numpy().view(np.uint64) ^ LONGEST)] = extra.column("cost").to_numpy()
        by_bucket, _ = word_buckets(words, buckets)
        counts[by_bucket] = counts.copy()
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        sums = []
        for (first, last), run, at, (sizes, n) in zip(runs(texts), found, places, numbers):
            part = texts[first:last]
            value = np.add.reduceat(cost[np.searchsorted(keys, run)][at], np.cumsum([0, *map(len, part[:-1])]))
            n = np.insert(n, np.cumsum(sizes), len(words) - 1)
            starts = np.cumsum(sizes + 1) - sizes - 1
            n_known = np.add.reduceat((counts[n] > 0).astype(np.int64), starts)
            sums.append((sizes + 1, n_known, np.full(len(part), total), np.add.reduceat(base[n], starts), value))
        out = [left.column(n)[0].values for n in ("ids", "held_out")]
        return pa.table([*out, *(pa.array(np.concatenate(x)) for x in zip(*sums))], names=[f.split()[0] for f in schema.split(", ")])

    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add_up, schema)
    return scored.withColumnRenamed("id", id_col)
