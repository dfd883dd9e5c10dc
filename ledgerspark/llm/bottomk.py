"""Near duplicates by bottom-k sketches.

A document's set is that of its distinct word shingles, as 64-bit hashes.  One hash function orders all shingles;
the ``K`` smallest of a set are its sketch.  Steps:

1. Documents with equal sets (128-bit digest of the whole set) form a class; from here on classes are compared.
2. Inverted lists of retained values.  Values of one class alone are counted and dropped.  A pair that is similar
   enough shares many retained values, so by the prefix principle it shares one of the *rarest* values of both; only
   these make lists.  A passage that very many documents share makes none in documents with enough text of their own.
3. In each list all members are compared on their whole sets with one leader, the member whose retained values are
   the most frequent (in a family of edited copies, the text that was edited).  Lists are never expanded into pairs.
4. Components of the links found.  Members near their leader are then held against each other by the shingles that
   tell them from it, which give their exact overlap.  A family is dealt into blocks, and a task compares all members
   of two blocks as matrices and returns the links that join components, so no pair is a row (see ``_kin``).
5. Jaccard distance is a metric, so what is left are pairs of two members far from their leader.  They can only be
   linked when they differ from the leader in a shared way (see ``_differences``): they share a shingle that the leader
   lacks, which makes the lists of the next level, or one of them is shorter than the leader by more than the other one
   misses, which makes pairs that share a missing shingle.
6. When the lists left are short, and after ``LEVELS`` levels, their members are held against each other in the same
   way, by their whole sets: all open lists of one leader at once where these have few members, else list by list (see
   ``_expand``).

Links are confirmed on whole sets only; no list, partner or candidate is capped.  What the sketch can lose is a pair
whose sketches overlap far less than its sets: under ``MISS`` overlap out of ``K`` at the threshold, with a
probability of about 1e-13 a pair for 0.85 and 1e-9 for 0.8.

Null and empty texts have an empty set and are linked with nothing.  A text with fewer words than a shingle is one
shingle, its whole sequence.  Repeated rows are equal sets, so they are linked; null ids are left out.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark.llm.base import materialize, slices, text_or_empty
from ledgerspark.llm.components import connected_components
from ledgerspark.storage import fits_broadcast

K = 64
#: Least overlap of two full sketches that is followed up.
MISS = 28
LEVELS = 3
#: Jaccard distance from the leader beyond which two members meet in lists.
FAR = 0.7
#: Members of a family in a block.
BLOCK = 256
#: Shingles of so many members of two blocks are compared by matrices, rarer ones in place.
COMMON = 16
COLUMNS = 1_024
#: Shingles of a block whose members are compared on whole sets.
BLOCK_SHINGLES = 262_144
#: Lists count as short when they hold at most so many pairs per member.
SHORT = 100
KEPT_WORDS = 500_000


@lru_cache(maxsize=1)
def _hashes() -> dict[bytes, int]:
    return {}


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer (constants as published for splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed 64-bit numbers."""
    known = _hashes()
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    if len(known) > KEPT_WORDS:
        known.clear()
    for token in set(tokens):
        if token not in known:
            known[token] = xxhash.xxh3_64_intdigest(token)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out.view(np.int64))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, keep: int | None = None) -> DataFrame:
    """``id long, n long, digest binary, shingles array<long>``: the ``keep`` smallest shingles, or all."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
                held = [s[:keep] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held))),
                    ],
                    ["id", "n", "digest", "shingles"],
                )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, digest binary, shingles array<long>")


def _least_overlap(n: Column, percent: int, k: int, miss: int) -> Column:
    """The least overlap of two sketches for a set of ``n`` shingles and any partner."""
    share = F.ceil(n * percent / 100)
    lost = F.greatest(F.lit(0), F.floor(n * 100 / percent) - k)
    return F.when(n >= k, F.lit(miss)).otherwise(F.greatest(F.lit(1), share - lost)).cast("int")


def _lists(classes: DataFrame, percent: int, k: int, miss: int) -> tuple[DataFrame, DataFrame]:
    """Lists of level 1, ``key long, id long, weight long``, and ``id, weight`` of their members."""
    values = classes.select("id", "n", F.size("shingles").alias("size"), F.explode("shingles").alias("value"))
    shared = materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "bottomk-shared")
    held = (
        values.join(shared, "value")
        .groupBy("id", "n", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"), F.sum("df").alias("weight"))
    )
    # Values of one class alone are the rarest: they take the first places of the prefix and make no list.
    length = F.col("size") - _least_overlap(F.col("n"), percent, k, miss) + 1 - (F.col("size") - F.size("held"))
    members = materialize(
        held.where(length > 0).select("id", "weight", F.slice("held", F.lit(1), length).alias("held")), "bottomk-members"
    )
    return members.select(F.explode("held.value").alias("key"), "id", "weight"), members.select("id", "weight")


def _with_component(rows: DataFrame, column: str, components: DataFrame, out: str) -> DataFrame:
    names = components.select(F.col("id").alias("__v"), F.col("component").alias("__c"))
    joined = rows.join(names, F.col(column) == F.col("__v"), "left")
    return joined.withColumn(out, F.coalesce("__c", column)).drop("__v", "__c")


def _open_lists(lists: DataFrame, components: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """The lists whose members lie in two components or more, with each member's component ``comp``; and whether these
    lists are short: all their pairs together are at most ``SHORT`` times their members.  ``family`` is the leader whose
    far members a list holds."""
    tagged = materialize(_with_component(lists, "id", components, "comp"), f"{label}-tagged")
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = materialize(mixed.where("low < high").select("key", "n"), f"{label}-mixed")
    members, pairs = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("double(n) * (n - 1) / 2")), F.lit(0.0))).first()
    return materialize(tagged.join(mixed.select("key"), "key"), f"{label}-open"), pairs <= SHORT * members


def _linked(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_a + n_b - both)


def _leader_pairs(lists: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Each list's leader against its other members: distinct ``leader, member``."""
    weighed = lists if "weight" in lists.columns else lists.join(weights, "id")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("n"))
    leaders = materialize(leaders.where("n > 1").select("key", (-F.col("best.minus")).alias("leader")), f"{label}-leaders")
    pairs = lists.join(leaders, "key").where("id != leader").select("leader", F.col("id").alias("member")).distinct()
    return materialize(pairs, f"{label}-pairs")


def _of(sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The sets of the ids in one column of ``pairs``: where these are few, most sets need no shuffle."""
    return sets.join(pairs.select(F.col(column).alias("id")).distinct(), "id", "left_semi")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """``leader, member`` with set sizes, whether they are linked, ``far`` and ``near`` (both, in a margin as wide as a link).

    ``differs`` of near members are the shingles that one has and the other lacks, either way.  ``extra`` of far ones: an
    unlinked pair can only be reached by another one through enough shared extra shingles, so a member that shares
    little with the leader shows the first of its extra shingles only, one more than it can do without.
    """
    one = _of(sets, pairs, "leader").select(F.col("id").alias("leader"), F.col("n").alias("n_l"), F.col("shingles").alias("s_l"))
    two = _of(sets, pairs, "member").select(F.col("id").alias("member"), F.col("n").alias("n_m"), F.col("shingles").alias("s_m"))
    rows = pairs.join(two, "member").join(one, "leader")
    both = F.size(F.array_intersect("s_l", "s_m")).cast("long")
    rows = rows.withColumn("both", both).withColumn("linked", _linked(F.col("both"), F.col("n_l"), F.col("n_m"), percent))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n_m") * percent / 100).cast("int") - F.col("both").cast("int"))
    apart = 1 - F.col("both") / (F.col("n_l") + F.col("n_m") - F.col("both"))
    rows = rows.withColumn("far", apart > FAR).withColumn("near", apart <= FAR + 1 - percent / 100 + 1e-6)
    extra = F.array_sort(F.array_except("s_m", "s_l"))
    extra = F.slice(extra, F.lit(1), F.greatest(F.lit(0), F.size(extra) - needed + 1))
    differs = F.concat(F.array_except("s_m", "s_l"), F.array_except("s_l", "s_m"))
    rows = rows.withColumn("extra", F.when(F.col("far"), extra)).withColumn("differs", F.when(F.col("near"), differs))
    return materialize(rows.select("leader", "member", "n_l", "n_m", "both", "linked", "far", "near", "extra", "differs"), f"{label}-compared")


def _shared(owners: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """How many values each two of ``rows`` sets share, from the owner of each value."""
    order = np.argsort(values, kind="stable")
    owners = owners[order]
    _, first, counts = np.unique(values[order], return_index=True, return_counts=True)
    out = np.zeros((rows, rows), np.float32)
    rare = np.repeat(counts < COMMON, counts)
    which = np.repeat(np.arange(len(counts)), counts)
    for step in range(1, min(COMMON, int(counts.max(initial=0)))):
        at = np.flatnonzero(rare[step:] & (which[step:] == which[:-step]))
        out += np.bincount(owners[at] * rows + owners[at + step], minlength=rows * rows).reshape(rows, rows)
    out += out.T
    common = np.flatnonzero(counts >= COMMON)
    for start in range(0, len(common), COLUMNS):
        some = common[start : start + COLUMNS]
        held = np.zeros((rows, len(some)), np.float32)
        for column, k in enumerate(some.tolist()):
            held[owners[first[k] : first[k] + counts[k]], column] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _joining(hits: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Of the linked rows and columns those that join components which others before have not joined."""
    root, out = np.unique(comps, return_inverse=True)[1], []
    for i in np.flatnonzero(hits.any(axis=1)).tolist():
        others = np.flatnonzero(hits[i])
        roots, first = np.unique(root[others], return_index=True)
        for r, j in zip(roots.tolist(), others[first].tolist()):
            if r != root[i]:
                out.append((i, j))
                root[root == r] = root[i]
    return out


def _met_in_blocks(rows: DataFrame, percent: int, label: str) -> DataFrame:
    """Links ``a, b`` that join components of the members of each ``leader``, dealt into its ``blocks``.

    Two members share ``both`` of either, less ``n_l``, and one for each of their values in ``differs`` that is the same.
    """

    def compare(group: pa.Table) -> pa.Table:
        member, comp, n, both, block = (group.column(c).to_numpy() for c in ("member", "comp", "n_m", "both", "block"))
        lists = group.column("differs").combine_chunks()
        owners = np.repeat(np.arange(len(member)), lists.value_lengths().to_numpy(zero_copy_only=False))
        overlap = both[:, None] + both[None, :] - group.column("n_l")[0].as_py() + _shared(owners, lists.flatten().to_numpy(), len(member))
        hits = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
        hits &= comp[:, None] != comp[None, :]
        if group.column("one")[0].as_py() != group.column("two")[0].as_py():
            hits &= block[:, None] != block[None, :]
        links = _joining(hits, comp)
        ends = [pa.array(member[[link[side] for link in links]], pa.int64()) for side in (0, 1)] if links else [pa.array([], pa.int64())] * 2
        return pa.table(ends, ["a", "b"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    dealt = dealt.select("leader", "one", "two", "block", "member", "comp", "n_l", "n_m", "both", "differs")
    return materialize(dealt.groupBy("leader", "one", "two").applyInArrow(compare, "a long, b long"), label)


def _kin(compared: DataFrame, components: DataFrame, percent: int, label: str) -> DataFrame:
    """Links ``a, b`` that join the near members of one leader, as far as they are in different components.

    Let x and y share ``both_x`` and ``both_y`` of the leader's n shingles.  Then they share ``both_x + both_y - n`` and one
    for each shingle that tells both of them from the leader.  Members linked to the leader are in one component.
    """
    near = _with_component(compared.where("near"), "member", components, "comp")
    families = near.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    families = materialize(families.where("low < high").select("leader", blocks), f"{label}-families")

    return _met_in_blocks(near.join(families, "leader"), percent, f"{label}-kin")


def _differences(compared: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Pairs of far members that may be linked because both lack the same shingles of the leader.

    Let the leader have n shingles, x miss p of them and add u, and y be shorter than the leader by h.  Without shared
    extra shingles x and y can be linked only if ``t h >= t u + p - (1 - t) n`` for the threshold t, and if they miss
    a common shingle.  The right side is positive for an x that isn't linked to the leader.
    """
    t = percent / 100
    gap = t * (F.col("n_m") - F.col("both")) + (F.col("n_l") - F.col("both")) - (1 - t) * F.col("n_l")
    rows = compared.where("far").select("leader", "member", "linked", (t * (F.col("n_l") - F.col("n_m"))).alias("short"), gap.alias("gap"))
    bounds = rows.groupBy("leader").agg(F.max("short").alias("most"), F.min(F.when(~F.col("linked"), F.col("gap"))).alias("least"))
    bounds = materialize(bounds.where("most >= least - 1e-6"), f"{label}-bounds")  # most often empty
    near = rows.join(bounds, "leader").where("(not linked and gap <= most + 1e-6) or short >= least - 1e-6")
    one = sets.select(F.col("id").alias("leader"), F.col("shingles").alias("s_l"))
    two = sets.select(F.col("id").alias("member"), F.col("shingles").alias("s_m"))
    missing = F.explode(F.array_except("s_l", "s_m")).alias("shingle")
    lacks = materialize(near.join(two, "member").join(one, "leader").select("leader", "member", "linked", "short", "gap", missing), f"{label}-lacks")
    x = lacks.where("not linked").select("leader", "shingle", F.col("member").alias("x"), "gap")
    y = lacks.select("leader", "shingle", F.col("member").alias("y"), "short")
    found = x.join(y, ["leader", "shingle"]).where("short >= gap - 1e-6 and x != y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int, miss: int) -> DataFrame:
    """The linked ones of ``a, b``: the union's sketch first, whole sets for what it lets through."""
    side = classes.select("id", F.col("n"), F.col("shingles").alias("sketch"))
    a = side.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("k_a"))
    b = side.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("k_b"))
    rows = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("k_a", "k_b")), 1, k)
    agree = F.size(F.array_intersect(F.array_intersect("k_a", "k_b"), union))
    likely = (agree * k >= F.size(union) * miss) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    rows = materialize(rows.where(likely).select("a", "b", "n_a", "n_b"), "bottomk-likely")
    s_a = _of(sets, rows, "a").select(F.col("id").alias("a"), F.col("shingles").alias("s_a"))
    s_b = _of(sets, rows, "b").select(F.col("id").alias("b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return rows.join(s_a, "a").join(s_b, "b").where(_linked(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _expand(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join components of members of one list, from whole sets.

    Lists of one family share most of their members, so the open lists of a family with no more members than a block are
    one group; those of a larger family are groups of their own, lists of the same members one.  Pairs are met inside
    tasks and never rows.
    """
    lists = lists.withColumn("leader", F.xxhash64(F.lit("family"), "family"))
    members = materialize(lists.select("leader", "id", "comp").distinct(), "bottomk-held")
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(sizes.where(F.col("size") > BLOCK).select("leader"), "bottomk-large")
    whole = members.join(large, "leader", "left_anti")
    apart = materialize(lists.join(large, "leader", "left_semi").select("leader", "key", "id", "comp"), "bottomk-apart")
    digest = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"d{seed}") for seed in (1, 2)]
    alike = apart.groupBy("leader", "key").agg(*digest, F.count(F.lit(1)).alias("n")).groupBy("leader", "d1", "d2", "n")
    apart = apart.join(alike.agg(F.min("key").alias("key")).select("key"), "key").select(F.col("key").alias("leader"), "id", "comp")
    held = whole.unionByName(apart).join(_of(sets, members.withColumnRenamed("id", "member"), "member"), "id")
    held = materialize(held.select("leader", F.col("id").alias("member"), "comp", F.col("n").alias("n_m"), F.col("shingles").alias("differs")), "bottomk-open")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_m") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    none = F.lit(0).cast("long")
    rows = held.join(held.groupBy("leader").agg(blocks), "leader").select("*", none.alias("n_l"), none.alias("both"))
    return _met_in_blocks(rows, percent, "bottomk-rest")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    miss: int = MISS,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles long`` and ``component_id long``, the smallest id that links reach.

    Two documents are linked when ``100 * common >= percent * union`` shingles of ``words`` words.
    """
    sketches = materialize(shingle_sets(docs, id_col, text_col, words, k), "bottomk-sketches")
    classes = materialize(
        sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("shingles").alias("shingles")),
        "bottomk-classes",
    )
    lists, weights = _lists(classes, percent, k, miss)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # Ids of members, as long as they are small by count and size, go to the texts; beyond that both are shuffled.
    ids = materialize(weights.select("id"), "bottomk-ids")
    members = F.broadcast(ids) if fits_broadcast(ids, ids.count()) else ids
    sets = materialize(shingle_sets(chosen.join(members, "id", "left_semi"), "id", "text", words).dropDuplicates(["id"]), "bottomk-sets")

    edges, components = None, None
    for level in range(1, levels + 1):
        label = f"bottomk-{level}"
        compared = _compare(_leader_pairs(lists, weights, label), sets, percent, label)
        found = compared.where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
        missing = _confirm(_differences(compared, sets, percent, label), classes, sets, percent, k, miss)
        found = materialize(found.union(missing), f"{label}-edges")
        edges = found if edges is None else edges.union(found)
        components = materialize(connected_components(edges), f"{label}-components")
        kin = _kin(compared, components, percent, label)
        if not kin.isEmpty():
            edges = edges.union(kin)
            components = materialize(connected_components(edges), f"{label}-components")
        children = compared.where("far").select(F.explode("extra").alias("shingle"), "leader", F.col("member").alias("id"))
        children = children.select(F.xxhash64("leader", "shingle").alias("key"), "id", F.col("leader").alias("family")).distinct()
        lists, short = _open_lists(children, components, f"bottomk-{level + 1}")
        if short:
            break
    last = _expand(lists, sets, percent)
    if not last.isEmpty():
        components = materialize(connected_components(edges.union(last)), "bottomk-components")

    # Documents to classes by digest, then classes to components.
    of_class = classes.select("digest", F.col("id").alias("class"))
    rows = sketches.select("id", "n", "digest").join(of_class, "digest", "left")
    rows = _with_component(rows.withColumn("class", F.coalesce("class", "id")), "class", components, "component")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
