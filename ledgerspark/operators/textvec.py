"""TF-IDF over character n-grams or words, and its truncated SVD.

Equal texts are merged first and carry their number of rows, so repeated descriptions are cut into terms once.  Texts are
dealt to tasks whole, and terms are counted there: what is shuffled are texts, not terms per text.  The
vocabulary is a written table, broadcast only when its size allows, and a second pass over the distinct texts joins
against it, so the full table of terms per text is never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import text
from ledgerspark.operators.ordering import with_label_rank
from ledgerspark.session import bound_batches
from ledgerspark.storage import HOT_KEYS, drop as _drop, fits_broadcast, forget_shuffles, lookup, materialize

CHAR, WORD = "char", "word"
BLOCK_TERMS = 4_096
#: Texts of a row group, and tiles of one term block that a task meets.
GROUP_ROWS = 1_024
CHUNK_TILES = 64
#: Bytes of products that a task holds before it adds them up.
PART_BYTES = 32 * 1024 * 1024
#: Characters of the texts of a task, whose terms are counted in its memory.
TASK_CHARS = 2_000_000


def padded_word(word: Column) -> Column:
    return F.concat(F.lit(" "), word, F.lit(" "))


def char_grams(padded: Column, low: int = K.CHAR_NGRAMS[0], high: int = K.CHAR_NGRAMS[1]) -> Column:
    """N-grams of a padded word: all windows of each size, up to the first size that covers all of it."""
    length = F.length(padded)
    sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), length)))
    return F.flatten(
        F.transform(
            sizes,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1)), lambda at: F.substring(padded, at, n)
            ),
        )
    )


def word_grams(words: Column, low: int = K.WORD_NGRAMS[0], high: int = K.WORD_NGRAMS[1]) -> Column:
    """Word n-grams of a token array, joined with blanks."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
        joined = F.transform(starts, lambda start: F.array_join(F.slice(words, start, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def distinct_texts(df: DataFrame, id_column: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Ids with their text's key, and a written table of the texts with ``n_rows`` and a ``number``: equal texts are worked on
    once."""
    rows = df.select(F.col(id_column).alias("id"), F.lower(text.description(column)).alias("t"))
    keyed = rows.withColumn("key", F.sha2(F.col("t").cast("binary"), 256))
    ids = keyed.select("id", "key")
    texts = keyed.groupBy("key").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n_rows"))
    return ids, materialize(texts.withColumn("number", F.monotonically_increasing_id()), "texts")


def dealt(texts: DataFrame) -> DataFrame:
    """The texts in tasks of bounded size by ``number``: grouping by number and anything else then shuffles nothing."""
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    return texts.repartition(max(1, -(-chars // TASK_CHARS)), "number")


def term_uses(texts: DataFrame, kind: str) -> DataFrame:
    """``(number, n_rows, term, n)``: the terms of every distinct text.

    A character gram comes once per distinct word of the text, with the uses of that word.
    """
    if kind == CHAR:
        found = F.regexp_extract_all("t", F.lit(K.NON_SPACE_RUN), F.lit(0))
        words = texts.select("number", "n_rows", F.explode(found).alias("word"))
        counted = words.groupBy("number", "n_rows", "word").agg(F.count(F.lit(1)).alias("n"))
        padded = counted.select("number", "n_rows", padded_word(F.col("word")).alias("padded"), "n")
        return padded.select("number", "n_rows", F.explode(char_grams(F.col("padded"))).alias("term"), "n")
    words = texts.select("number", "n_rows", text.tokens(F.col("t")).alias("words"))
    return words.select("number", "n_rows", F.explode(word_grams(F.col("words"))).alias("term"), F.lit(1).alias("n"))


def fit_vocabulary(
    df: DataFrame, kind: str, id_column: str = K.ID, column: str = "description", max_terms: int | None | str = "default"
) -> DataFrame:
    """The ``max_terms`` most used terms (ties by term) with position, text frequency and smooth idf.

    None keeps all terms; so does the default for words, while character n-grams have a bound.
    """
    if max_terms == "default":
        max_terms = K.MAX_TERMS if kind == CHAR else None
    _, texts = distinct_texts(df, id_column, column)
    n_texts = texts.agg(F.sum("n_rows")).first()[0] or 0
    per_text = term_uses(dealt(texts), kind).groupBy("number", "n_rows", "term").agg(F.sum("n").alias("tf"))
    stats = per_text.groupBy("term").agg(F.sum(F.col("tf") * F.col("n_rows")).alias("n_uses"), F.sum("n_rows").alias("n_texts"))
    kept = materialize(stats if max_terms is None else stats.orderBy(F.desc("n_uses"), "term").limit(max_terms), "terms")
    idf = F.log((F.lit(n_texts) + 1.0) / (F.col("n_texts") + 1.0)) + 1.0
    placed = with_label_rank(kept, ["term"], "index").join(kept, "term")
    vocabulary = materialize(placed.select("term", F.col("index").cast("int"), "n_uses", "n_texts", idf.alias("idf")), "vocabulary")
    _drop(texts)
    _drop(kept)
    forget_shuffles(df.sparkSession)
    return vocabulary


def weigher(vocabulary: DataFrame, kind: str, label: str = "index") -> Callable[[DataFrame], DataFrame]:
    """A function from texts to ``(number, entries, norm)``: weights of the known terms, by index or ``term``, and their length."""
    known = vocabulary.select("term", "index", "idf")
    small = fits_broadcast(known, known.count())

    def weighed(some: DataFrame) -> DataFrame:
        uses = term_uses(dealt(some), kind)
        if small:
            counts = uses.join(F.broadcast(known), "term").groupBy("number", label, "idf").agg(F.sum("n").alias("tf"))
        else:
            counts = uses.groupBy("number", "term").agg(F.sum("n").alias("tf")).join(known, "term")
        weights = counts.select("number", label, ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("weight"))
        entries = F.collect_list(F.struct(label, "weight")).alias("entries")
        return weights.groupBy("number").agg(entries, F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))

    return weighed


def tfidf_long(
    df: DataFrame, vocabulary: DataFrame, kind: str, id_column: str = K.ID, column: str = "description", label: str = "index"
) -> DataFrame:
    """``(id, index, weight)``: unit-length weights of the known terms of every text; with ``label`` "term" the terms themselves,
    so that nobody has to join them back.

    Terms outside the vocabulary go before anything is counted.  A text without known terms has no row.
    """
    ids, texts = distinct_texts(df, id_column, column)
    weighed = weigher(vocabulary, kind, label)

    # The weights of texts with very many rows (few, by definition) are written and joined apart, so that no task holds all rows
    # of one text; the others, which may be several times the input, are never written.
    total = texts.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") * F.lit(HOT_KEYS) > F.lit(total)
    numbered = lookup(ids, texts.select("key", "number", "n_rows"), ["key"], ["number", "n_rows"], spread_by="id", weight="n_rows")
    numbered = materialize(numbered.select("id", "number", hot.alias("hot")), "numbered")
    frequent = numbered.where("hot").join(materialize(weighed(texts.where(hot)), "weights"), "number")
    others = numbered.where("not hot").join(weighed(texts.where(~hot)), "number")
    long = frequent.unionByName(others).select(F.col("id").alias(id_column), "norm", F.inline("entries"))
    return long.select(id_column, label, (F.col("weight") / F.col("norm")).alias("weight"))


def tfidf(
    df: DataFrame, vocabulary: DataFrame, kind: str, id_column: str = K.ID, column: str = "description"
) -> DataFrame:
    """``(id, indices, weights)`` per text, in index order; the arrays are bounded by the vocabulary."""
    long = tfidf_long(df, vocabulary, kind, id_column, column)
    entries = long.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("entries"))
    return entries.select(id_column, F.col("entries.index").alias("indices"), F.col("entries.weight").alias("weights"))


def unit_vectors(
    df: DataFrame, vocabularies: dict[str, DataFrame], id_column: str = K.ID, column: str = "description"
) -> tuple[DataFrame, DataFrame, int]:
    """Written tables ``(id, unit)`` and ``(number, unit, n, indices, weights)`` over all vocabularies side by side, and the
    number of terms.

    A unit is the texts of an id, nearly always one; ids with equal texts share it, ``n`` of them.  Vectors are made per unit
    and never per id.  Units without known terms have no vector.
    """
    ids, texts = distinct_texts(df, id_column, column)
    numbered = lookup(ids, texts.select("key", "number", "n_rows"), ["key"], ["number"], spread_by="id", weight="n_rows")
    units = numbered.groupBy("id").agg(F.sort_array(F.collect_list("number")).alias("unit"))
    units = materialize(units.select(F.col("id").alias(id_column), "unit"), "units")
    offset, parts = 0, None
    for kind, vocabulary in vocabularies.items():
        scaled = F.transform("entries", lambda e: F.struct((e["index"] + offset).alias("index"), (e["weight"] / F.col("norm")).alias("weight")))
        part = weigher(vocabulary, kind)(texts).select("number", scaled.alias("entries"))
        parts = part if parts is None else parts.unionByName(part)
        offset += vocabulary.count()
    each = materialize(parts, "text-entries")
    counted = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    found = counted.select("unit", "n", F.explode("unit").alias("number")).join(each, "number")
    whole = found.groupBy("unit", "n").agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"))
    vectors = whole.select(
        F.monotonically_increasing_id().alias("number"), "unit", "n",
        F.col("entries.index").alias("indices"), F.col("entries.weight").alias("weights"),
    )
    vectors = materialize(vectors, "vectors")
    _drop(each)
    return units, vectors, offset


def of_ids(units: DataFrame, table: DataFrame, id_column: str, values: list[str]) -> DataFrame:
    """``values`` of each unit for all its ids; units without any are left out."""
    return lookup(units, table, ["unit"], values, spread_by=id_column, weight="n").where(F.col(values[0]).isNotNull()).drop("unit")


def text_vectors(
    df: DataFrame, vocabularies: dict[str, DataFrame], id_column: str = K.ID, column: str = "description"
) -> tuple[DataFrame, int]:
    """Written table ``(id, indices, weights)`` over all vocabularies side by side, and the number of terms."""
    units, vectors, n_terms = unit_vectors(df, vocabularies, id_column, column)
    return materialize(of_ids(units, vectors, id_column, ["indices", "weights"]), "vectors"), n_terms


# ---- truncated SVD -----------------------------------------------------------------------------------------
@dataclass
class Basis:
    """``rank`` orthonormal columns over all terms, as a written table of blocks of ``BLOCK_TERMS`` terms."""

    table: DataFrame  # block int, values binary: terms × rank doubles
    rank: int


TILE = "group long, block int, rows binary, cols binary, weights binary, ids array<long>"
IDS = -1  # the block number under which a row group keeps its ids


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, width)


def _vector_key() -> Column:
    """A digest of the whole vector; equal numbers have equal digits."""
    return F.sha2(F.concat_ws(";", F.array_join("indices", ","), F.array_join("weights", ",")).cast("binary"), 256)


def equal_rows(vectors: DataFrame) -> DataFrame:
    """The distinct vectors, written once: ``id`` (a number), ``key``, ``indices``, ``weights`` and ``n`` rows that hold it.

    A vector given with an ``n`` stands for as many rows."""
    n = F.col("n") if "n" in vectors.columns else F.lit(1).cast("long")
    keyed = vectors.select(_vector_key().alias("key"), "indices", "weights", n.alias("n"))
    merged = keyed.groupBy("key").agg(F.first("indices").alias("indices"), F.first("weights").alias("weights"), F.sum("n").alias("n"))
    return materialize(merged.withColumn("id", F.monotonically_increasing_id()), "svd-rows")


def tiles_of(vectors: DataFrame) -> DataFrame:
    """Tiles (see ``_tiles``) of the matrix with equal rows merged into one, times the root of their number: inner products
    of columns are those of the whole matrix."""
    rows = equal_rows(vectors)
    tiles = _tiles(rows.withColumn("weights", F.transform("weights", lambda w: w * F.sqrt("n"))))
    _drop(rows)
    return tiles


def _tiles(vectors: DataFrame) -> DataFrame:
    """The sparse matrix cut into row groups and term blocks: one row per non-empty tile, and one with a group's ids.

    A row group lies within one task, so nothing is shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), GROUP_ROWS):
                part = batch.iloc[start : start + GROUP_ROWS]
                out = [(group, IDS, b"", b"", b"", part["id"].to_numpy())]
                sizes = part["indices"].map(len).to_numpy()
                if sizes.sum():
                    rows = np.repeat(np.arange(len(part)), sizes)
                    terms = np.concatenate(part["indices"].to_numpy()).astype(np.int64)
                    weights = np.concatenate(part["weights"].to_numpy())
                    order = np.argsort(terms, kind="stable")
                    rows, terms, weights = rows[order], terms[order], weights[order]
                    blocks, first = np.unique(terms // BLOCK_TERMS, return_index=True)
                    for block, low, high in zip(blocks.tolist(), first, [*first[1:], len(terms)]):
                        cols = terms[low:high] - block * BLOCK_TERMS
                        packed = (rows[low:high].astype("<i4").tobytes(), cols.astype("<i4").tobytes(), weights[low:high].astype("<f8").tobytes())
                        out.append((group, block, *packed, np.zeros(0, np.int64)))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TILE.split(", ")])
                group += 1

    bound_batches(vectors.sparkSession)
    tiles = materialize(vectors.select("id", "indices", "weights").mapInPandas(cut, TILE), "svd-tiles")
    # Tiles of a frequent block are dealt into chunks, so that no task meets all of them.
    blocks = materialize(tiles.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "svd-blocks")
    counts = blocks.withColumn("chunks", F.ceil(F.col("n") / CHUNK_TILES).cast("int"))
    dealt = lookup(tiles, counts, ["block"], ["chunks"], spread_by="group", weight="n")
    out = materialize(dealt.withColumn("chunk", F.pmod(F.xxhash64("group"), F.col("chunks")).cast("int")), "svd-tiles")
    _drop(tiles)
    _drop(blocks)
    return out


def _entries(tile: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(tile["rows"], "<i4"), np.frombuffer(tile["cols"], "<i4"), np.frombuffer(tile["weights"], "<f8")


def _segment_sums(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Rows of ``values`` with equal keys added up: the distinct keys, and the sums."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct.astype("<i4").tobytes(), np.add.reduceat(values[order], first, axis=0).astype("<f8").tobytes()


PART = "key long, rows binary, values binary"


def _summed(parts: DataFrame, width: int) -> DataFrame:
    """Parts added up per key: first inside the task that made them, so that only its sums are shuffled, then as they arrive, one
    key after the other.  However many parts a key has, no task holds them together."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            keys, rows, values = (batch.column(name) for name in ("key", "rows", "values"))
            for i in range(batch.num_rows):
                yield keys[i].as_py(), np.frombuffer(rows[i].as_buffer(), "<i4"), _matrix(values[i].as_buffer(), width)

    def one(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        if len(found) == 1:
            return tuple(x.copy() for x in found[0])  # not a view of its batch
        rows, values = _segment_sums(*(np.concatenate(x) for x in zip(*found)))
        return np.frombuffer(rows, "<i4"), _matrix(values, width)

    def sent(key: int, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from _parts([(key, *(x.tobytes() for x in one(found)))]).to_batches()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0
        for key, rows, values in numbered(batches):
            held.setdefault(key, []).append((rows, values))
            size += rows.nbytes + values.nbytes
            if size > PART_BYTES:
                for k, found in held.items():
                    held[k] = [one(found)]
                size = sum(r.nbytes + v.nbytes for ((r, v),) in held.values())
                if size > PART_BYTES // 2:
                    for k, found in held.items():
                        yield from sent(k, found)
                    held.clear()
                    size = 0
        for k, found in held.items():
            yield from sent(k, found)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for key, rows, values in numbered(batches):
            if held and key != at:
                yield from sent(at, held)
                held, size = [], 0
            at = key
            held.append((rows, values))
            size += rows.nbytes + values.nbytes
            if size > PART_BYTES // 4 and len(held) > 1:
                held, size = [one(held)], 0
        if held:
            yield from sent(at, held)

    return parts.mapInArrow(within, PART).repartition("key").sortWithinPartitions("key").mapInArrow(across, PART)


def _parts(rows: list[tuple]) -> pa.Table:
    kinds = (("key", pa.int64()), ("rows", pa.binary()), ("values", pa.binary()))
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def images(tiles: DataFrame, basis: Basis) -> DataFrame:
    """``key`` (row group), ``rows``, ``values``: every text's coordinates in the basis; texts without terms are left out."""
    width = basis.rank

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _parts([])
        q, out = _matrix(right.column("values")[0].as_py(), width), []
        for tile in left.to_pylist():
            rows, cols, weights = _entries(tile)
            out.append((tile["group"], *_segment_sums(rows, q[cols] * weights[:, None])))
        return _parts(out)

    inner = tiles.where(F.col("block") != IDS)
    chunks = inner.groupBy("block").agg(F.max("chunks").alias("chunks"))
    sent = basis.table.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "values")
    both = inner.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(multiply, PART)
    return _summed(both, width)


def _back(tiles: DataFrame, image: DataFrame, width: int, n_terms: int) -> DataFrame:
    """The transposed matrix times the images, as a written table of term blocks."""

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _parts([])
        y = np.zeros((GROUP_ROWS, width))
        one = right.to_pylist()[0]
        y[np.frombuffer(one["rows"], "<i4")] = _matrix(one["values"], width)
        out = []
        for tile in left.to_pylist():
            rows, cols, weights = _entries(tile)
            out.append((tile["block"], *_segment_sums(cols, y[rows] * weights[:, None])))
        return _parts(out)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows, values in zip(batch["key"], batch["rows"], batch["values"]):
                whole = np.zeros((min(BLOCK_TERMS, n_terms - key * BLOCK_TERMS), width))
                whole[np.frombuffer(rows, "<i4")] = _matrix(values, width)
                yield pd.DataFrame({"block": [key], "values": [whole.tobytes()]})

    inner = tiles.where(F.col("block") != IDS).select("group", "block", "rows", "cols", "weights")
    both = inner.groupBy("group").cogroup(image.groupBy("key")).applyInArrow(multiply, PART)
    return materialize(_summed(both, width).mapInPandas(dense, "block int, values binary"), "svd-basis")


def _gram(parts: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns of a matrix that is given in parts: the only sums that reach the driver."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            for values in batch["values"]:
                part = _matrix(values, width)
                total += part.T @ part
        yield pd.DataFrame({"at": range(width * width), "x": total.ravel()})

    found = parts.select("values").mapInPandas(add_up, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(width * width)
    for r in found:
        gram[r["at"]] = r["x"]
    return gram.reshape(width, width)


def _times(table: DataFrame, width: int, factor: np.ndarray) -> DataFrame:
    """Every block times a small matrix."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"block": batch["block"], "values": [(_matrix(v, width) @ factor).tobytes() for v in batch["values"]]})

    return materialize(table.mapInPandas(multiply, "block int, values binary"), "svd-basis")


def orthonormal(table: DataFrame, width: int) -> Basis:
    """The same span with orthonormal columns, through the small Gram matrix; twice, as once loses half of the digits.

    Directions that are no more than rounding are dropped, so the rank may be smaller than ``width``.
    """
    given = table
    for least in (1e-14, 0.25):  # after the first round the Gram matrix is near the identity
        values, vectors = np.linalg.eigh(_gram(table, width))
        kept = values > least * max(values.max(initial=0.0), 1e-300)
        factor = vectors[:, kept] / np.sqrt(values[kept])
        before, table, width = table, _times(table, width, factor), int(kept.sum())
        if before is not given:
            _drop(before)
        if not width:
            break
    return Basis(table, width)


def fit_svd(vectors: DataFrame, n_terms: int, k: int, iterations: int = 5, oversample: int = 10, seed: int = K.SEED) -> Basis:
    """Right singular vectors of the uncentred matrix, by randomized subspace iteration.

    Equal rows are merged, so the work follows distinct texts.  The basis is a table of term blocks all along, and each goes when
    the next is written: images and blocks are joined and summed by shuffles, columns are made
    orthonormal through their Gram matrix.  The driver holds matrices of ``k`` + ``oversample`` rows and columns only.
    Signs are such that the entry of largest size in a column is positive (ties: the first term's).
    """
    spark = vectors.sparkSession
    tiles = tiles_of(vectors)
    width = min(k + oversample, n_terms)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                drawn = np.random.default_rng([seed, block]).standard_normal((min(BLOCK_TERMS, n_terms - block * BLOCK_TERMS), width))
                yield pd.DataFrame({"block": [block], "values": [drawn.tobytes()]})

    blocks = spark.range(-(-n_terms // BLOCK_TERMS)).mapInPandas(start, "block int, values binary")
    if not width:
        return Basis(materialize(blocks, "svd-basis"), 0)
    drawn = materialize(blocks, "svd-basis")
    basis = orthonormal(drawn, width)
    _drop(drawn)
    for _ in range(iterations + 1):
        turned = _back(tiles, images(tiles, basis), basis.rank, n_terms)
        before, basis = basis, orthonormal(turned, basis.rank)
        _drop(before.table)
        _drop(turned)
        forget_shuffles(spark)
        if not basis.rank:
            return basis
    values, rotation = np.linalg.eigh(gram_of(tiles, basis))
    rotation = rotation[:, np.argsort(values)[::-1][:k]]
    rotated = Basis(_times(basis.table, basis.rank, rotation), rotation.shape[1])
    out = Basis(_times(rotated.table, rotated.rank, np.diag(_signs(rotated))), rotated.rank)
    for table in (tiles, basis.table, rotated.table):
        _drop(table)
    forget_shuffles(spark)
    return out


def _signs(basis: Basis) -> np.ndarray:
    width = basis.rank

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, values in zip(batch["block"], batch["values"]):
                part = _matrix(values, width)
                at = np.abs(part).argmax(axis=0)
                top = part[at, np.arange(width)]
                yield pd.DataFrame({"col": range(width), "size": np.abs(top), "term": block * BLOCK_TERMS + at, "x": top})

    each = basis.table.mapInPandas(largest, "col int, size double, term long, x double")
    best = each.groupBy("col").agg(F.max_by("x", F.struct("size", -F.col("term"))).alias("x")).collect()
    signs = np.ones(width)
    for r in best:
        signs[r["col"]] = -1.0 if r["x"] < 0 else 1.0
    return signs


def gram_of(tiles: DataFrame, basis: Basis) -> np.ndarray:
    """Inner products of the coordinates over all texts; diagonal for singular vectors."""
    return _gram(images(tiles, basis), basis.rank)


def gram_of_basis(basis: Basis) -> np.ndarray:
    """Inner products of the basis columns; the identity up to rounding."""
    return _gram(basis.table, basis.rank)


def project(vectors: DataFrame, basis: Basis, id_column: str = K.ID, out: str = "text_svd") -> DataFrame:
    """Coordinates of every text in the basis, as ``array<double>``; zeros for texts without known terms."""
    width = basis.rank

    def unpack(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids")[0].as_py() if left.num_rows else []
        y = np.zeros((len(ids), width))
        for one in right.to_pylist():
            y[np.frombuffer(one["rows"], "<i4")] = _matrix(one["values"], width)
        return pa.table({"id": pa.array(ids, pa.int64()), "at": pa.array(list(y), pa.list_(pa.float64()))})

    if not width:
        return vectors.select(id_column, F.array().cast("array<double>").alias(out))
    known = equal_rows(vectors)
    tiles = _tiles(known)
    groups = tiles.where(F.col("block") == IDS).select("group", "ids").groupBy("group")
    rows = groups.cogroup(images(tiles, basis).groupBy("key")).applyInArrow(unpack, "id long, at array<double>")
    coordinates = materialize(rows.join(known.select("id", "key"), "id").select("key", F.col("at").alias(out)), "svd-coordinates")
    _drop(tiles)
    _drop(known)
    return vectors.select(id_column, _vector_key().alias("key")).join(coordinates, "key").select(F.col(id_column).cast("long").alias(id_column), out)
