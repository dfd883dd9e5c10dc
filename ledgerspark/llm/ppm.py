"""Code length of documents under prediction by partial matching (PPM).

The text is read as lower-case (A-Z) words, each followed by a space, and one end mark.  The longest match is a whole
word: one seen in training is predicted as such, by its count, and the escape is as likely as there are words seen
once (method X).  After an escape the word is spelled.  A byte is predicted from the up to ``ORDER`` bytes before it,
back to the space before its word: the longest context known from training comes first, and when it has not seen the
byte, an escape (method C: as likely as the number of different bytes seen) leads to the context one byte shorter,
where the bytes of the longer one are excluded.  After the empty context all bytes not yet seen are equally likely.
Words that could have been predicted whole are excluded from spelling: their spelled probabilities are added up once,
and what they take is given to the others.

As no context reaches beyond a word, a word costs the same wherever it stands, and the work follows distinct words:

1. Documents are read once, in blocks of bounded size.  A block keeps each text as numbers of the block's distinct
   words, and the distinct words with their counts in training texts.
2. Counts per word are summed over all blocks.  Every training word then adds its count to its (context, byte) pairs:
   the trie as a table, in which a key packs order, context and byte into 64 bits.
3. The distinct words of all blocks are cut into parts of bounded size.  A part asks once for each pair of its words; each
   pair is joined with the trie at all its orders and folded into one cost, and the part adds up its words.
4. Counts and costs go back to the blocks that hold the words, and each block adds up its documents.

All joins are on keys of which a block or part holds one; adaptive execution may split those of frequent words.
Nothing but a few totals of the training text comes to the driver.

Null and empty texts have the end mark alone.  Repeated rows are scored each for itself, a null id counts as the
empty text when folds are dealt.  Without training text all bytes are equally likely.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations


import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerspark.llm.base import materialize, slices, text_or_empty

ORDER = 6
#: Bytes that a word can hold, the space after it and the end mark.
ALPHABET = 256 - 6 + 2
BLOCK_BYTES = 8_000_000
WORDS_PER_TASK = 500_000
WORDS_PER_PART = 150_000
END = b"\n"
#: Least mass that known words are taken to leave over for others; against rounding.
LEAST_REST = 1e-9
LOW = (1 << 56) - 1

BLOCK_ROWS = (
    "block long, id {id}, held_out boolean, n_tokens long, "  # of a document
    "tokens binary, word binary, place int, n_train long"
)


def pair_keys(words: list[bytes], all_orders: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (context, byte) pairs of each word, at all orders or the longest alone, and the word of each."""
    framed = [b" " + w + b" " if w != END else b" " + END for w in words]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    owner = np.repeat(np.arange(len(framed)), sizes)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(within > 0)
    value, depth = data[at].copy(), within[at]
    keys, owners = [], []
    out = value.copy()
    if all_orders:
        keys.append(value.copy())
        owners.append(owner[at])
    for order in range(1, ORDER + 1):
        has = depth >= order
        value[has] |= data[at[has] - order] << np.uint64(8 * order)
        key = value[has] | np.uint64(order << 56)
        if all_orders:
            keys.append(key)
            owners.append(owner[at[has]])
        else:
            out[has] = key
    if all_orders:
        return np.concatenate(keys).view(np.int64), np.concatenate(owners)
    return out.view(np.int64), owner[at]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 as three runs of bytes, lowest first: high bytes are mostly zero and compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(3, -1).T
    return out.view("<u4").ravel().astype(np.int64)


class Block:
    """Documents read so far, as numbers of distinct words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, held_out: bool, text: str) -> None:
        tokens = text.encode("utf-8", "replace").lower().split()
        tokens.append(END)
        words = self.words
        for token in tokens:
            if token not in words:
                words[token] = len(words)
        self.docs.append((doc_id, held_out, np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))))
        self.size += len(text) + 64

    def columns(self, block: int, schema: pa.Schema) -> list[pa.RecordBatch]:
        n = len(self.words)
        train = np.zeros(n, np.int64)
        total = np.zeros(n, np.int64)
        for _, held_out, numbers in self.docs:
            counts = np.bincount(numbers, minlength=0)
            total[: len(counts)] += counts
            if not held_out:
                train[: len(counts)] += counts
        order = np.argsort(-total, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        names = list(self.words)
        words = [names[i] for i in order.tolist()]

        def batch(rows: int, **given) -> pa.RecordBatch:
            given = {"block": pa.array(np.full(rows, block, np.int64)), **given}
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

        return [
            batch(
                len(self.docs),
                id=pa.array([d[0] for d in self.docs], schema.field("id").type),
                held_out=pa.array([d[1] for d in self.docs], pa.bool_()),
                n_tokens=pa.array([len(d[2]) for d in self.docs], pa.int64()),
                tokens=pa.array([pack_numbers(place[d[2]]) for d in self.docs], pa.binary()),
            ),
            batch(n, word=pa.array(words, pa.binary()), place=pa.array(np.arange(n), pa.int32()), n_train=pa.array(train[order])),
        ]


def read_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(BLOCK_ROWS.format(id=kind)))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))

    def run(batches):
        made, block = 0, Block()
        base = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 2):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    block.add(*row)
                if block.size >= BLOCK_BYTES:
                    yield from block.columns(base + made, schema)
                    made, block = made + 1, Block()
        if block.docs:
            yield from block.columns(base + made, schema)

    return rows.mapInArrow(run, BLOCK_ROWS.format(id=kind))


def trie(counts: DataFrame, words: int) -> DataFrame:
    """``pair long, c long`` of all (context, byte) pairs at all orders, from ``word, c`` with ``words`` rows."""

    def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.add.reduceat(values, starts) if len(starts) else values

    def run(batches):
        held, waiting, rows = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            keys, owners = pair_keys(batch.column(0).to_pylist(), all_orders=True)
            waiting.append(summed(keys, batch.column(1).to_numpy()[owners]))
            rows += len(waiting[-1][0])
            if rows > 1_500_000:
                held = summed(*(np.concatenate(x) for x in zip(held, *waiting)))
                waiting, rows = [], 0
        held = summed(*(np.concatenate(x) for x in zip(held, *waiting)))
        for at in range(0, len(held[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]) for h in held], ["pair", "c"])

    tasks = max(1, -(-words // WORDS_PER_TASK))
    return counts.coalesce(tasks).mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def _order(key: str) -> Column:
    return F.shiftright(key, 56).cast("int")


def _cut(key: str, order: Column) -> Column:
    """The key at a lower order: the bytes nearest to the predicted one."""
    mask = F.pow(F.lit(2.0), 8 * (order + 1)).cast("long") - 1
    return F.col(key).bitwiseAND(F.lit(LOW)).bitwiseAND(mask).bitwiseOR(F.shiftleft(order.cast("long"), 56))


def _node(key: str) -> Column:
    """The key of the context: without the predicted byte, with the order."""
    low = F.shiftright(F.col(key).bitwiseAND(F.lit(LOW)), 8)
    return low.bitwiseOR(F.shiftleft(_order(key).cast("long"), 56))


def nodes(pairs: DataFrame) -> DataFrame:
    """Per context ``node``: total count, number of different bytes, and what these bytes count one order lower."""
    lower = pairs.select(F.col("pair").alias("below"), F.col("c").alias("c_below"))
    rows = pairs.withColumn("below", F.when(_order("pair") > 0, _cut("pair", _order("pair") - 1)))
    rows = rows.join(lower, "below", "left").withColumn("node", _node("pair"))
    return rows.groupBy("node").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.coalesce("c_below", F.lit(0))).alias("below")
    )


def pair_costs(asked: DataFrame, pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``pair, cost`` (log10) of each distinct asked pair, folded from the longest context down."""
    steps = asked.select("pair", F.explode(F.sequence(F.lit(0), _order("pair"))).alias("o"))
    steps = steps.withColumn("at", _cut("pair", F.col("o")))
    steps = steps.withColumn("node", _node("at"))
    rows = steps.join(pairs.select(F.col("pair").alias("at"), "c"), "at", "left").join(contexts, "node")
    chain_ = F.reverse(F.sort_array(F.collect_list(F.struct("o", "c", "total", "kinds", "below"))))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds"))

    def fold(s: Column, x: Column) -> Column:
        left, kinds = x["total"] - s["gone"], x["kinds"] - s["gone_kinds"]
        found = x["c"].isNotNull()
        gain = F.when(s["done"], 0.0).when(found, F.log10(x["c"] / (left + kinds))).when(kinds > 0, F.log10(kinds / (left + kinds))).otherwise(0.0)
        return F.struct(
            (s["cost"] + gain).alias("cost"), (s["done"] | found).alias("done"), x["below"].alias("gone"), x["kinds"].alias("gone_kinds")
        )

    folded = rows.groupBy("pair").agg(F.aggregate(chain_, start, fold).alias("s"))
    unseen = F.when(F.col("s.done"), 0.0).otherwise(-F.log10(F.greatest(F.lit(1), F.lit(ALPHABET) - F.col("s.gone_kinds"))))
    known = folded.select("pair", (F.col("s.cost") + unseen).alias("cost"))
    # Without any training text there is no context at all.
    return asked.join(known, "pair", "left").select("pair", F.coalesce("cost", F.lit(float(-np.log10(ALPHABET)))).alias("cost"))


def spelled_costs(counts: DataFrame, words: int, pairs: DataFrame) -> DataFrame:
    """A written table ``word, c, spelled``: log10 probability of each word when it is spelled."""

    def cut(batches):
        base, made, held, c = TaskContext.get().partitionId() << 32, 0, [], []

        def rows():
            part, asked = base + made, np.unique(pair_keys(held, all_orders=False)[0])
            for n, given in ((len(held), {"word": pa.array(held, pa.binary()), "c": pa.array(c, pa.int64())}), (len(asked), {"pair": pa.array(asked)})):
                given["part"] = pa.array(np.full(n, part, np.int64))
                yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        for batch in batches:
            held.extend(batch.column(0).to_pylist())
            c.extend(batch.column(1).to_pylist())
            if len(held) >= WORDS_PER_PART:
                yield from rows()
                made, held, c = made + 1, [], []
        if held:
            yield from rows()

    schema = to_arrow_schema(StructType.fromDDL("part long, word binary, c long, pair long"))
    parts = counts.select("word", "c").coalesce(max(1, -(-words // WORDS_PER_TASK)))
    parts = materialize(parts.mapInArrow(cut, "part long, word binary, c long, pair long"), "ppm-parts")
    asked = parts.where("pair is not null").select(F.col("part").alias("of"), "pair")
    costs = materialize(pair_costs(asked.select("pair").distinct(), pairs, materialize(nodes(pairs), "ppm-nodes")), "ppm-costs")
    answers = asked.join(costs, "pair").select("of", "pair", "cost")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        keys, owners = pair_keys(left.column("word").to_pylist(), all_orders=False)
        cost = right.column("cost").to_numpy()[np.searchsorted(right.column("pair").to_numpy(), keys)]
        spelled = np.bincount(owners, weights=cost, minlength=left.num_rows)
        return pa.table({"word": left.column("word"), "c": left.column("c"), "spelled": pa.array(spelled)})

    words_of = parts.where("word is not null").select("part", "word", "c")
    done = words_of.groupBy("part").cogroup(answers.groupBy("of")).applyInArrow(add_up, "word binary, c long, spelled double")
    return materialize(done, "ppm-words")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (smoothed unigrams) and ``score`` (PPM), both log10.  Texts with ``held_out`` don't train."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = materialize(read_blocks(docs, id_col, text_col, F.coalesce(held_out, F.lit(False))), "ppm-blocks")
    words = table.where("word is not null")
    counts = materialize(words.groupBy("word").agg(F.sum("n_train").alias("c")), "ppm-counts")
    seen = F.col("c") > 0
    total, distinct, singles, every = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(seen), F.count_if(F.col("c") == 1), F.count(F.lit(1))
    ).first()
    pairs = materialize(trie(counts.where(seen), distinct), "ppm-trie")
    spelled = spelled_costs(counts, every, pairs)
    mass = spelled.where(seen).agg(F.sum(F.pow(F.lit(10.0), "spelled"))).first()[0] or 0.0
    # A known word by its count; an unknown one by the escape and its share of what known words leave over.
    unknown = math.log10((singles + 1) / (total + singles + 1)) - math.log10(max(1.0 - mass, LEAST_REST))
    whole = F.when(seen, F.log10(F.col("c") / F.lit(float(total + singles + 1)))).otherwise(F.col("spelled") + F.lit(unknown))
    values = spelled.select("word", "c", whole.alias("value"))
    answers = words.select("block", "word", "place").join(values, "word").select("block", "place", "c", "value")
    texts = table.where("tokens is not null").select(F.col("block").alias("of"), "id", "held_out", "n_tokens", "tokens")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("place")
        c, value = right.column("c").to_numpy(), right.column("value").to_numpy()
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        known = c > 0
        sums = [(int(known[n].sum()), float(base[n].sum()), float(value[n].sum())) for n in map(unpack_numbers, left.column("tokens").to_pylist())]
        out = {name: left.column(name) for name in ("id", "held_out", "n_tokens")}
        out["n_known"] = pa.array([x[0] for x in sums], pa.int64())
        out["train_tokens"] = pa.array([total] * len(sums), pa.int64())
        out["base_score"] = pa.array([x[1] for x in sums], pa.float64())
        out["score"] = pa.array([x[2] for x in sums], pa.float64())
        return pa.table(out)

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = texts.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
    return scored.withColumnRenamed("id", id_col)
