"""Exact nearest neighbours by inner product: a block matrix join of int8 tiles.

Vectors are packed into blocks, one row per block: int8 components with a scale per vector, the float vectors, and
norms of the quantisation error.  Every query block meets every candidate block.  In a tile the integer products
are exact (float32 holds them up to a thousand dimensions; longer vectors are multiplied in parts), and
``|<x,y> - sx sy <qx,qy>| <= |ex| |y| + |sx qx| |ey|``
bounds the error.  A pair whose upper bound is below the k-th best lower bound of its query cannot be among the
nearest; the others are recomputed in double precision, component after component, and a heap keeps k per query.
Heaps are merged in two levels, first within runs of candidate blocks.

Queries are the stated set ``query`` (a SQL condition).  A row is never its own neighbour.  Null or zero vectors,
vectors with null or non-finite components and null ids take no part; all vectors must have one length.  Equal
scores go to the smaller id.  Repeated ids are told apart as rows only by their vectors: give unique ids.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerspark.llm.base import arrow_rows, materialize

BLOCK = 2048
PART = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id long, v array`` of the vectors that take part."""
    infinite = F.lit(float("inf"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        .where("id is not null and v is not null")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)))
        .where(F.exists("v", lambda x: x != 0))
    )


def pack(ids: np.ndarray, x: np.ndarray) -> dict:
    """A block: sorted by id, quantised, with the norms that the error bound needs."""
    order = np.argsort(ids, kind="stable")
    ids, given = ids[order], x[order]
    x = given.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # denormal maxima
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = q * scale[:, None]
    slack = 1 + 1e-9
    return {
        "ids": ids.astype("<i8").tobytes(),
        "x": given.tobytes(),
        "q": q.tobytes(),
        "scale": scale.tobytes(),
        "error": (np.linalg.norm(x - near, axis=1) * slack).tobytes(),
        "near": (np.linalg.norm(near, axis=1) * slack).tobytes(),
        "norm": (np.linalg.norm(x, axis=1) * slack).tobytes(),
    }


PACKED = "ids binary, x binary, q binary, scale binary, error binary, near binary, norm binary"


def unpack(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], "<i8")
    q = np.frombuffer(row["q"], np.int8).reshape(len(ids), -1)
    x = np.frombuffer(row["x"], f"<f{len(row['x']) // q.size}").reshape(q.shape)
    return {k: np.frombuffer(row[k], "<f8") for k in ("scale", "error", "near", "norm")} | {"ids": ids, "x": x, "q": q}


def blocks(rows: DataFrame, block: int, label: str) -> DataFrame:
    """A written table of rows packed into blocks: ``no long`` and the columns of ``PACKED``.

    Each task packs what it reads; few rows in many small partitions are read by fewer tasks.
    """

    def run(frames):
        ids, vectors = [], []
        for frame in frames:
            ids.extend(frame["id"])
            vectors.extend(frame["v"])
            while len(ids) >= block:
                yield pd.DataFrame([pack(np.array(ids[:block]), np.stack(vectors[:block]))])
                del ids[:block], vectors[:block]
        if ids:
            yield pd.DataFrame([pack(np.array(ids), np.stack(vectors))])

    packed = rows.coalesce(max(1, -(-rows.count() // block))).mapInPandas(run, PACKED)
    return materialize(packed.select(F.monotonically_increasing_id().alias("no"), "*"), label)


def nearest_in_tile(q: dict, c: dict, k: int) -> list[tuple[int, list[float], list[int]]]:
    """(query id, scores, ids) of the at most ``k`` nearest of the block for each query, nearest first."""
    product = np.zeros((len(q["ids"]), len(c["ids"])))
    for at in range(0, q["q"].shape[1], PART):
        product += q["q"][:, at : at + PART].astype(np.float32) @ c["q"][:, at : at + PART].astype(np.float32).T
    product *= q["scale"][:, None]
    product *= c["scale"][None, :]
    bound = np.outer(q["error"], c["norm"])
    bound += np.outer(q["near"], c["error"])
    bound += 1e-12 * np.outer(q["norm"], c["norm"])  # rounding of the products themselves
    own = q["ids"][:, None] == c["ids"][None, :]
    product[own] = -np.inf
    low = product - bound
    if low.shape[1] > k:
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        least = np.full(len(low), -np.inf)
    rows, cols = np.nonzero((product + bound >= least[:, None]) & ~own)
    score = np.zeros(len(rows))
    for d in range(q["x"].shape[1]):
        score += q["x"][rows, d].astype(np.float64) * c["x"][cols, d]
    out, ends = [], np.searchsorted(rows, np.arange(len(q["ids"]) + 1))
    for i, query in enumerate(q["ids"].tolist()):
        mine = slice(ends[i], ends[i + 1])
        best = heapq.nsmallest(k, zip((-score[mine]).tolist(), c["ids"][cols[mine]].tolist()))
        out.append((query, [-s for s, _ in best], [v for _, v in best]))
    return out


def numbered(packed: DataFrame) -> tuple[DataFrame, int]:
    """Blocks numbered from 0 without gaps; their count is that of rows divided by the block size."""
    numbers = sorted(r.no for r in packed.select("no").collect())
    places = packed.sparkSession.createDataFrame(list(zip(numbers, range(len(numbers)))), "no long, at int")
    return packed.join(places, "no"), len(numbers)


HEAPS = "query_id long, run int, scores array<double>, ids array<long>"


def merge_heaps(heaps: DataFrame, by: list[str], k: int) -> DataFrame:
    """One heap of ``k`` for each key, from the sorted heaps of its rows."""

    def run(frames):
        for frame in frames:
            out = []
            for lists in frame["lists"]:
                ranked = [[(-s, v) for s, v in zip(x["scores"], x["ids"])] for x in lists]
                best = list(islice(heapq.merge(*ranked), k))
                out.append(([-s for s, _ in best], [v for _, v in best]))
            yield frame[["query_id", "run"]].assign(scores=[s for s, _ in out], ids=[v for _, v in out])

    lists = heaps.groupBy(*by).agg(F.collect_list(F.struct("scores", "ids")).alias("lists"))
    return lists.select("query_id", "run" if "run" in by else F.lit(0).alias("run"), "lists").mapInPandas(run, HEAPS)


def nearest(
    vectors: DataFrame,
    query: str = "id % 20 = 0",
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: each query's ``k`` nearest, nearest first.

    ``query`` is a condition on ``id``.
    """
    rows = usable(vectors, id_col, vector_col)
    candidates, n_candidates = numbered(blocks(rows, block, "tiles-candidates"))
    queries, n_queries = numbered(blocks(rows.where(query), block, "tiles-queries"))
    run_length = max(1, round(n_candidates**0.5))

    def multiply(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                found = nearest_in_tile(unpack(row["q"]), unpack(row["c"]), k)
                out.extend((query_id, row["run"], scores, ids) for query_id, scores, ids in found)
            yield pd.DataFrame(out, columns=["query_id", "run", "scores", "ids"])

    # One key per tile: tiles are dealt evenly, and a block goes once to each tile that needs it.
    names = [c.split(" ")[0] for c in PACKED.split(", ")]
    every_query = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_queries - 1))))
    every_candidate = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_candidates - 1))))
    left = candidates.select(F.struct(*names).alias("c"), F.col("at").alias("c_at"), every_query.alias("q_at"))
    right = queries.select(F.struct(*names).alias("q"), F.col("at").alias("q_at"), every_candidate.alias("c_at"))
    tiles = left.join(right, ["c_at", "q_at"]).select("q", "c", F.expr(f"int(c_at div {run_length})").alias("run"))
    arrow_rows(vectors.sparkSession, 8)
    heaps = materialize(tiles.mapInPandas(multiply, HEAPS), "tiles-heaps")
    arrow_rows(vectors.sparkSession, 2000)
    merged = merge_heaps(merge_heaps(heaps, ["query_id", "run"], k), ["query_id"], k)
    ranked = merged.select("query_id", F.posexplode(F.arrays_zip("scores", "ids")).alias("at", "best"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("best.ids").alias("vec_id"), F.col("best.scores").alias("score")
    )
