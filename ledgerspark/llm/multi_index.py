"""Near duplicates among embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into two halves.  Each half has a codebook of its own, fitted on a bounded
sample; the product of the two codebooks is a grid of cells, and every vector lies in the cell of its nearest codeword
pair.  Steps:

1. Vectors that are equal and carry equal labels form a class; from here on classes are compared, and a class counts
   with its members.  Copies are never expanded into pairs.
2. For each vector the multi-sequence traversal walks the cells by growing squared distance, the sum over both halves:
   the two sorted lists of codeword distances are merged by a heap that holds the next step in each direction.  It
   stops at the first cell that is farther than the vector's own cell by more than the limit.
3. The limit is set so that the target recall is met by pairs that lie exactly at the threshold, the hardest there
   are: vectors of the sample are turned by the threshold angle in random directions, and the limit is the quantile
   of the excess at which either of the two would reach the other's cell.  Linked pairs inside the sample count too.
4. Cells are dealt into blocks of about ``BLOCK`` vectors, so that a cell with a third of all rows is many blocks.  A
   block sends to each visited cell those of its vectors that visit it, and meets each of the cell's blocks once.
5. In a pair of blocks the matrix of cosines, in double precision over the original vectors, decides.  A link is
   counted once, although both ends may visit each other.  What leaves the task is a count per vector and, as links,
   a spanning forest of the pair of blocks: at most one row per vector, never one per pair.
6. Counts are added up, forests are joined into components.

The traversal is approximate: ``recall`` is the share of pairs at the threshold that it is set to find, and nearer pairs
are found more often.  Links found are exact, none lies below the threshold.  Work inside a cell is quadratic in the
vectors that lie there, as every link of each is counted; it is spread over blocks.

Vectors that are null, zero or hold null or non-finite components, and rows whose label is null, link with nothing; they
stay in the result with no link and their own id.  All other vectors must have one length, else a ``ValueError`` is
raised.  Repeated ids are told apart as rows; a component takes the smallest id in it, null ids last.  An empty table
gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ledgerspark.llm.base import bound_batches, materialize
from ledgerspark.llm.components import connected_components
from ledgerspark.storage import lookup

#: Vectors that codebooks and the limit are fitted on, at most.
SAMPLE = 16_384
#: Vectors per cell and label that the grid is sized for, and codewords per half at most.
CELL = 256
CODEWORDS = 1_024
#: Vectors per block, about.
BLOCK = 1_024
#: Turned copies of each sample vector.
TURNS = 4


def squared(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all codewords."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ codewords.T) + (codewords * codewords).sum(1)[None, :]
    return np.maximum(d, 0)


def fit_codebook(x: np.ndarray, size: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from a random start; a codeword that loses all its vectors stays where it was."""
    codewords = x[np.random.default_rng(seed).choice(len(x), size, replace=False)]
    for _ in range(rounds):
        nearest = squared(x, codewords).argmin(1)
        sums = np.zeros_like(codewords)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=size)[:, None]
        codewords = np.where(counts > 0, sums / np.maximum(counts, 1), codewords)
    return codewords


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells by growing ``first[i] + second[j]``, as long as the sum is within ``limit``.

    A cell enters the heap once one of its two predecessors has been visited, the one along the second list.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


class Grid:
    """Two codebooks and the limit of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, limit: float = 0.0):
        self.first, self.second, self.limit = first, second, limit

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each vector's cell, and the other cells that its traversal visits, nearest first."""
        d1, d2 = self.distances(x)
        width = len(self.second)
        own = d1.argmin(1) * width + d2.argmin(1)
        # What a vector needs beyond its own cell, to reach the nearest other codeword of either half.
        d1 -= d1.min(1)[:, None]
        d2 -= d2.min(1)[:, None]
        others: list[list[int]] = []
        reaches = ((d1 <= self.limit).sum(1) > 1) | ((d2 <= self.limit).sum(1) > 1)
        for at in range(len(x)):
            visited = [i * width + j for i, j in multi_sequence(d1[at], d2[at], self.limit)] if reaches[at] else []
            others.append([c for c in visited if c != own[at]])
        return own, others


def fit_grid(sample: np.ndarray, labels: np.ndarray, size: int, cosine: float, recall: float, seed: int = 1) -> Grid:
    """Codebooks of ``size`` words on unit vectors, and the limit that reaches ``recall`` at the threshold."""
    half = max(1, sample.shape[1] // 2)
    first = fit_codebook(sample[:, :half], min(size, len(sample)), seed=seed)
    second = fit_codebook(sample[:, half:], min(size, len(sample)), seed=seed + 1)
    grid = Grid(first, second)
    random = np.random.default_rng(seed + 2)
    mates = [turned(sample, cosine, random) for _ in range(TURNS)]
    found = [excess(grid, sample, m) for m in mates]
    for start in range(0, len(sample), 2_048):  # linked pairs of the sample, in blocks
        part = sample[start : start + 2_048]
        linked = (part @ sample.T >= cosine) & (labels[start : start + 2_048, None] == labels[None, :])
        rows, cols = np.nonzero(linked)
        keep = rows + start < cols
        if keep.any():
            found.append(excess(grid, part[rows[keep]], sample[cols[keep]]))
    limits = [np.quantile(np.concatenate(found[:TURNS]), recall)] + [np.quantile(f, recall) for f in found[TURNS:]]
    grid.limit = float(max(limits)) * (1 + 1e-9) + 1e-12
    return grid


def turned(x: np.ndarray, cosine: float, random: np.random.Generator) -> np.ndarray:
    """Unit vectors at exactly this cosine to the given ones, in random directions."""
    side = random.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    norm = np.linalg.norm(side, axis=1)
    norm[norm == 0] = 1.0
    return cosine * x + (1 - cosine * cosine) ** 0.5 * side / norm[:, None]


def excess(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the other's cell is farther than the own one, for the end of each pair that has it easier."""

    def one_way(d: tuple[np.ndarray, np.ndarray], to: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = np.arange(len(d[0]))
        return sum(a[at, b.argmin(1)] - a.min(1) for a, b in zip(d, to))

    dx, dy = grid.distances(x), grid.distances(y)
    return np.minimum(one_way(dx, dy), one_way(dy, dx))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


# ---- packed vectors: one row holds those of a block ---------------------------------------------------------
PACK = "nos binary, sizes binary, x binary, visits binary, ends binary"


def pack(nos: np.ndarray, sizes: np.ndarray, x: np.ndarray, visits: list[np.ndarray]) -> dict[str, bytes]:
    flat = np.concatenate(visits) if visits else np.zeros(0)
    return {
        "nos": nos.astype("<i8").tobytes(),
        "sizes": sizes.astype("<i8").tobytes(),
        "x": np.ascontiguousarray(x, "<f8").tobytes(),
        "visits": flat.astype("<i4").tobytes(),
        "ends": np.cumsum([len(v) for v in visits]).astype("<i8").tobytes(),
    }


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    nos = np.frombuffer(row["nos"], "<i8")
    x = np.frombuffer(row["x"], "<f8").reshape(len(nos), -1)
    visits = np.split(np.frombuffer(row["visits"], "<i4"), np.frombuffer(row["ends"], "<i8")[:-1])
    return nos, np.frombuffer(row["sizes"], "<i8"), x, visits


def forest(linked: np.ndarray) -> np.ndarray:
    """For each of the rows and columns of a boolean matrix, rows first, the first member of its component.

    Minima run along rows and columns until nothing changes.
    """
    n_rows, n_cols = linked.shape
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return np.arange(n_rows + n_cols)
    cols = cols + n_rows
    root = np.arange(n_rows + n_cols)
    while True:
        before = root.copy()
        least = np.minimum(root[rows], root[cols])
        np.minimum.at(root, rows, least)
        np.minimum.at(root, cols, least)
        root = root[root]
        if (root == before).all():
            return root


LINKS = "no long, links long, root long"


def compare(probe: dict, target: dict, probe_cell: int, target_cell: int, same_block: bool, cosine: float) -> pd.DataFrame:
    """Links between two blocks: ``no, links, root`` of every vector with one.

    Two vectors that visit each other's cells would meet twice; then the one of the smaller cell number counts.
    """
    a_no, a_size, a, _ = unpack(probe)
    b_no, b_size, b, b_visits = unpack(target)
    linked = a @ b.T >= cosine
    if probe_cell == target_cell:
        if same_block:
            linked &= a_no[:, None] < b_no[None, :]
    elif target_cell < probe_cell:
        mutual = np.array([bool((v == probe_cell).any()) for v in b_visits])
        linked &= ~mutual[None, :]
    links = np.concatenate([linked @ b_size, a_size @ linked])
    nos = np.concatenate([a_no, b_no])
    some = links > 0
    roots = nos[forest(linked)]
    return pd.DataFrame({"no": nos[some], "links": links[some], "root": roots[some]})


# ---- the operator ------------------------------------------------------------------------------------------
def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.93,
    recall: float = 0.999,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    block: int = BLOCK,
    cell: int = CELL,
) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links long`` (other vectors linked directly) and ``component_id long`` (the
    smallest id reachable by links).  ``label_col`` None compares all with all."""
    spark = vectors.sparkSession
    bound_batches(spark)
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    infinite = F.lit(float("inf"))
    usable = (
        F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
        & F.exists("v", lambda x: x != 0)
        & F.col("label").isNotNull()
    )
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast(ArrayType(DoubleType())).alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    taking_part = rows.where("usable").select("id", "label", "v")
    classes = taking_part.groupBy("label", "v").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "multi-index-classes")

    totals = classes.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels"),
        F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"),
    ).first()
    alone = F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    if not totals["n"]:
        return rows.select(F.col("id").alias(id_col), *alone)
    if totals["least"] != totals["most"]:
        raise ValueError(f"vectors of {totals['least']} to {totals['most']} components")

    sample = classes.orderBy(F.xxhash64("no", F.lit(7)), "no").limit(SAMPLE).select("label", "v").toArrow()
    x = unit(np.stack(sample.column("v").to_numpy()).astype(np.float64))
    size = round((totals["n"] / max(1, totals["labels"]) / cell) ** 0.5)
    grid = fit_grid(x, np.array(sample.column("label").to_pylist()), min(max(size, 4), CODEWORDS), cosine, recall)

    points = materialize(classes.select("no", "label", "size", "v").mapInArrow(_locator(grid), POINTS), "multi-index-points")
    cells = points.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("members"))
    cells = materialize(cells.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")), "multi-index-cells")
    dealt = lookup(points, cells, ["label", "cell"], ["blocks"], spread_by="no", weight="members")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")).drop("blocks")
    packed = materialize(dealt.groupBy("label", "cell", "block").applyInPandas(_pack_block, f"label string, cell int, block int, {PACK}"), "multi-index-blocks")

    names = [c.split(" ")[0] for c in PACK.split(", ")]
    probes = packed.mapInPandas(_probes, f"label string, cell int, from_cell int, from_block int, {PACK}")
    probes = probes.select("label", "cell", "from_cell", "from_block", F.struct(*names).alias("probe"))
    # A block meets the blocks of its own cell from itself on, and all of any other cell; cells without vectors drop out.
    first = F.when(F.col("cell") == F.col("from_cell"), F.col("from_block")).otherwise(0)
    meets = probes.join(cells.select("label", "cell", "blocks"), ["label", "cell"])
    meets = meets.select("*", F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block")).drop("blocks")
    targets = packed.select("label", "cell", "block", F.struct(*names).alias("target"))
    pairs = meets.join(targets, ["label", "cell", "block"])
    found = pairs.select("cell", "block", "from_cell", "from_block", "probe", "target").mapInPandas(_comparer(cosine), LINKS)
    found = materialize(found, "multi-index-links")

    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("no != root").select(F.col("no").alias("a"), F.col("root").alias("b")))
    # A class: what its vectors are linked to, its own members less the vector itself, and the smallest id of its component.
    known = classes.join(links, "no", "left").join(component.withColumnRenamed("id", "no"), "no", "left")
    known = known.select("label", "v", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "no").alias("component"))
    known = materialize(known, "multi-index-known")
    least = materialize(known.groupBy("component").agg(F.min("least").alias("component_id")), "multi-index-least")
    known = materialize(
        known.join(least, "component").select("label", "v", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"),
        "multi-index-classes-known",
    )
    matched = rows.where("usable").join(known, ["label", "v"]).select(F.col("id").alias(id_col), "n_links", "component_id")
    return matched.unionByName(rows.where("not usable").select(F.col("id").alias(id_col), *alone))


POINTS = "no long, label string, size long, x binary, cell int, visits array<int>"


def _locator(grid: Grid):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False)))
            own, others = grid.locate(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("no"),
                    batch.column("label"),
                    batch.column("size"),
                    pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()),
                    pa.array(own, pa.int32()),
                    pa.array(others, pa.list_(pa.int32())),
                ],
                names=["no", "label", "size", "x", "cell", "visits"],
            )

    return locate


def _pack_block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("no")
    x = np.stack([np.frombuffer(r, "<f8") for r in frame["x"]])
    row = pack(frame["no"].to_numpy(), frame["size"].to_numpy(), x, [np.asarray(v) for v in frame["visits"]])
    return pd.DataFrame([{"label": frame["label"].iat[0], "cell": frame["cell"].iat[0], "block": frame["block"].iat[0], **row}])


def _probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.to_dict("records"):
            nos, sizes, x, visits = unpack(row)
            flat = np.concatenate(visits)
            owner = np.repeat(np.arange(len(nos)), [len(v) for v in visits])
            for target in [row["cell"], *np.unique(flat).tolist()]:
                at = np.arange(len(nos)) if target == row["cell"] else owner[flat == target]
                # The visits of the probing side are not needed any more.
                part = pack(nos[at], sizes[at], x[at], [np.zeros(0)] * len(at))
                yield pd.DataFrame([{"label": row["label"], "cell": target, "from_cell": row["cell"], "from_block": row["block"], **part}])


def _comparer(cosine: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                same = row["cell"] == row["from_cell"] and row["block"] == row["from_block"]
                yield compare(row["probe"], row["target"], row["from_cell"], row["cell"], same, cosine)

    return run
