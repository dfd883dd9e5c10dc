"""Mixing sources to target weights: a token budget dealt down a tree, and seeded prefixes of its leaves.

The tree has the levels domain, language and source.  A node deals its budget to its children in proportion to their
weights, but no child gets more than it can supply (its documents' tokens times ``max_epochs``).  What a child leaves
over goes to its siblings, again by weight, before any of it goes further up: as a node never gets more than its
children supply together, the shortage of a leaf is met by its siblings, that of a whole node by the node's siblings.
Nodes without weight or tokens get nothing.

A leaf takes whole epochs while the budget lasts and in the last epoch the longest prefix of its documents, in an order
seeded by leaf budget's epoch number, whose tokens fit.  The prefix is found by counting tokens in ``BUCKETS`` ranges
of the order per leaf; only the range in which the budget ends is sorted.  The result is one cut per leaf, so the
documents are decided where they are, without a shuffle of texts.

Tokens are words.  Null and empty texts have none; they come along when they lie in the prefix.  Null levels are nodes
of their own.  Rows with equal ids have equal places in the order and come or go together.  Other columns are kept;
``domain``, ``n_tokens`` and ``copies`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.llm.base import SPACE_BYTES, materialize, text_or_empty

LEVELS = ("__l0", "__l1", "__l2")
BUCKETS = 4096
KEY_DIGITS = 15  # of hexadecimal: 60 bits
Weights = dict[str, float]


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch: 60 bits of a digest of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(KEY_DIGITS)), 16, 10).cast("long")


def _weight(column: str, weights: Weights) -> Column:
    given = F.lit(1.0)
    for name, value in weights.items():
        given = F.when(F.col(column) == name, F.lit(float(value))).otherwise(given)
    return given


def _deal(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """``budget`` of each node, from ``total`` (its parent's budget), ``supply`` and ``weight``."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    name = LEVELS[len(parents)]
    by_need = siblings.orderBy("need", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Children in the order in which growing shares fill them up; the full ones are a prefix of it.
    rows = nodes.withColumn("need", F.col("supply") / F.col("weight"))
    rows = rows.withColumn("filled", F.sum("supply").over(by_need)).withColumn(
        "open", F.sum("weight").over(siblings) - F.sum("weight").over(by_need)
    )
    rows = rows.withColumn("full", F.col("filled") + F.col("need") * F.col("open") <= F.col("total"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(siblings), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    rows = rows.withColumn("left", left).withColumn("share", share)
    budget = F.when(F.col("full"), F.col("supply").cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("share"))
    return rows.withColumn("budget", budget).drop("need", "filled", "open", "full", "left", "share")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: tuple[Weights, Weights, Weights]) -> DataFrame:
    """``budget`` (double) per leaf, from ``__l0, __l1, __l2, avail``; the whole budget is ``share`` of all tokens."""
    tree = leaves.where("avail > 0").withColumn("supply", F.col("avail") * max_epochs)
    for level, given in zip(LEVELS, weights):
        tree = tree.withColumn(f"w{level}", _weight(level, given)).where(F.col(f"w{level}") > 0)
    out = None
    for depth in range(3):
        keys = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.max(f"w{LEVELS[depth]}").alias("weight"), F.sum("avail").alias("avail"))
        if out is None:
            tokens = leaves.agg(F.sum("avail")).first()[0] or 0
            most = F.sum("supply").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("total", F.least(F.lit(tokens * share), most))
        else:
            above = out.select(*[F.col(k).alias(f"up{k}") for k in LEVELS[:depth]], F.col("budget").alias("total"))
            on = [F.col(k).eqNullSafe(F.col(f"up{k}")) for k in LEVELS[:depth]]
            nodes = nodes.join(above, on).drop(*[f"up{k}" for k in LEVELS[:depth]])
        out = _deal(nodes, keys[:-1])
    return out.select(*LEVELS, "avail", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    share: float = 0.5,
    max_epochs: int = 2,
    weights: tuple[Weights, Weights, Weights] = ({}, {}, {}),
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``domain``, ``n_tokens`` (long) and ``copies`` (long): in how many epochs a document is taken.

    ``weights`` are those of domains, languages and sources by name; unnamed ones weigh 1.
    """
    others = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    n_tokens = F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACE_BYTES}]+")).cast("long")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in others],
        domain.cast("string").alias("__l0"),
        F.col(lang_col).cast("string").alias("__l1"),
        F.col(source_col).cast("string").alias("__l2"),
        n_tokens.alias("__n"),
    )
    counted = materialize(rows.select(F.col(id_col).alias("__id"), *LEVELS, "__n"), "mixing-counts")
    leaves = materialize(counted.groupBy(*LEVELS).agg(F.sum("__n").alias("avail")), "mixing-leaves")
    dealt = budgets(leaves, share, max_epochs, weights)
    dealt = dealt.withColumn("whole", F.least(F.floor(F.col("budget") / F.col("avail")), F.lit(max_epochs)).cast("long"))
    dealt = dealt.withColumn("rest", F.floor(F.col("budget")).cast("long") - F.col("whole") * F.col("avail"))
    # Null levels become a name that no value has, so that leaves join by plain equality.
    leaf = F.to_json(F.struct(*LEVELS), {"ignoreNullFields": "false"})
    dealt = materialize(dealt.select(leaf.alias("__leaf"), "whole", "rest"), "mixing-budgets")

    def placed(frame: DataFrame, ident: str) -> DataFrame:
        frame = frame.withColumn("__leaf", leaf).join(dealt, "__leaf")
        frame = frame.withColumn("__place", place(seed, F.col("whole"), F.col(ident)))
        return frame.withColumn("__bucket", F.shiftright("__place", 4 * KEY_DIGITS - 12).cast("int"))

    ordered = placed(counted, "__id")
    sums = ordered.groupBy("__leaf", "__bucket").agg(F.sum("__n").alias("n"), F.max("rest").alias("rest"))
    upto = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest")
    ends = over.groupBy("__leaf").agg(F.min(F.struct("__bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends = materialize(ends.select("__leaf", F.col("end.__bucket").alias("end"), F.col("end.before").alias("before")), "mixing-ends")
    last = ordered.join(ends, "__leaf").where("__bucket = end")
    running = Window.partitionBy("__leaf").orderBy("__place", "__id")  # equal places count together
    fits = last.withColumn("run", F.col("before") + F.sum("__n").over(running)).where("run <= rest")
    cuts = fits.groupBy("__leaf").agg(F.max(F.struct("__place", "__id")).alias("cut"))
    cuts = materialize(ends.join(cuts, "__leaf", "left").select("__leaf", "end", "cut"), "mixing-cuts")

    decided = placed(rows, id_col).join(cuts, "__leaf", "left")
    here = F.struct(F.col("__place"), F.col(id_col).alias("__id"))
    inside = (F.col("__bucket") < F.col("end")) | ((F.col("__bucket") == F.col("end")) & F.coalesce(here <= F.col("cut"), F.lit(False)))
    taken = F.coalesce(inside, F.lit(False)) & (F.col("rest") > 0)
    return decided.select(
        *[F.col(f"`{c}`") for c in others],
        F.col("__l0").alias("domain"),
        F.col("__n").alias("n_tokens"),
        (F.col("whole") + taken.cast("long")).alias("copies"),
    ).where("copies > 0")
