"""Exact top-k by inner product as a Voronoi join.

Vectors become whole numbers, so scores are exact. A hash sample of at most
``PIVOTS`` vectors are pivots, and every vector belongs to the cell of its
nearest one. A cell's summary is its pivot, its radius and its count. Query cells
near each other ask as one block, with a centre and a radius of its own. For a data cell with pivot p and radius r
and a block of queries with centre c and radius s, any score q.x lies within

    c.p - slack and c.p + slack,  slack = |c| r + s |p| + s r.

Filling k places from the cells with the highest lower bounds gives each block a
score that its k-th best reaches at least; a cell whose upper bound is lower is
not needed. Data go only to the blocks that need their cell, in slices of
``SLICE`` rows, and each slice is solved alone; the best of all slices is the
answer. The bound holds for any vectors, with ties and repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

SCALE = 1024
K = 10
QUERY_STEP = 100
PIVOTS = 128
QUERY_BLOCK = 512
SLICE = 8192
SMALL_NEEDS = 1_000_000
#: Scores that cost as much as sending one row to a block.
SEND_COST = 500


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, floor(1024 x) of each component; rows with null or non-finite parts, or no id, go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0), np.int64)


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, p = points.astype(np.float64), pivots.astype(np.float64)
    cell = np.argmin((p * p).sum(1)[None, :] - 2 * (x @ p.T), 1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                cell, far = _nearest(_matrix(rows.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    return run


def needed_cells(centre: np.ndarray, spread: float, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """The data cells that may hold one of the k best of some query of a block. One of a query's own row is left out."""
    middle = pivots @ centre
    slack = np.linalg.norm(centre) * radius + spread * (np.linalg.norm(pivots, axis=1) + radius)
    margin = 1e-6 * (1 + np.abs(middle) + slack)
    low, high = middle - slack - margin, middle + slack + margin
    order = np.argsort(-low)
    filled = np.cumsum(count[order])
    enough = np.searchsorted(filled, k + 1)  # one more: a query is no candidate of its own
    floor = low[order[enough]] if enough < len(order) else -np.inf
    return np.flatnonzero((high >= floor) & (count > 0))


def _spread_out(points: np.ndarray, n: int) -> list[int]:
    """Places of n points, each the farthest from those before it."""
    chosen = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return chosen


def plan_blocks(asking: list[tuple[int, int, float]], pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int):
    """Which query cells ask together, and which data cells each such block needs.

    Many small blocks prune better, few large ones send each row less often. All
    numbers of blocks that are powers of two are weighed: a row sent costs as
    much as ``SEND_COST`` scores. ``asking`` has (cell, queries, largest distance);
    the work is over summaries only. Returns (data cell, block, slices), (block,
    parts) and (query cell, block).
    """
    if not asking:
        return [], [], []
    cells = np.array([c for c, _, _ in asking])
    asked, far = np.array([n for _, n, _ in asking]), np.array([f for _, _, f in asking])
    best, n = None, 1
    while True:
        n = min(n, len(cells))
        centres = _spread_out(pivots[cells], n)
        distance = np.linalg.norm(pivots[cells][:, None] - pivots[cells[centres]][None], axis=2)
        home = distance.argmin(1)
        cost, needs, parts = 0.0, [], []
        for block, centre in enumerate(centres):
            own = np.flatnonzero(home == block)
            if not len(own):
                continue
            spread = float((distance[own, block] + far[own]).max())
            wanted = needed_cells(pivots[cells[centre]], spread, pivots, radius, count, k)
            queries = int(asked[own].sum())
            sent = int(count[wanted].sum()) * (queries // QUERY_BLOCK + 1)
            cost += sent * SEND_COST + queries * float(count[wanted].sum())
            parts.append((block, queries // QUERY_BLOCK + 1))
            needs += [(int(c), block, int(count[c]) // SLICE + 1) for c in wanted.tolist()]
        if best is None or cost < best[0]:
            best = cost, needs, parts, list(zip(cells.tolist(), home.tolist()))
        if n == len(cells):
            return best[1:]
        n *= 2


def _solve(k: int):
    def run(key: tuple[pa.Scalar, ...], data: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if data.num_rows and queries.num_rows:
            ids, names = data["vec_id"].to_numpy(), queries["asker"].to_numpy()
            x, q = _matrix(data["v"].combine_chunks()), _matrix(queries["q"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            largest = max(int(np.abs(x).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1) * max(x.shape[1], 1)
            exact = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object
            xs = x.astype(exact)
            for a in range(0, len(q), 64):
                scores = q[a : a + 64].astype(exact) @ xs.T
                for row, name in zip(scores, names[a : a + 64].tolist()):
                    fit = np.flatnonzero(ids != name)
                    if len(fit) > k:  # all that reach the k-th best, so that ties can be settled by id
                        values = row[fit]
                        fit = fit[values >= np.partition(values, len(values) - k)[len(values) - k]] if exact is not object else fit
                    best = fit[np.lexsort((ids[fit], -row[fit]))][:k] if exact is not object else sorted(fit.tolist(), key=lambda i: (-row[i], ids[i]))[:k]
                    out["query_id"] += [name] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["score"] += [int(s) for s in row[best]]
        return pa.table([pa.array(out[c], pa.int64()) for c in out], names=list(out))

    return run


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_step``; a query's own
    id is no candidate. With fewer rows than k all are returned. Rows whose id
    repeats are candidates each; as queries their lines repeat no result: one
    of them asks. Vectors of another length than the first pivot's take no part. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = len(sample[0]["v"])
    centres = np.unique(np.array([r["v"] for r in sample if len(r["v"]) == width], np.int64), axis=0)
    cells = stored(vectors.where(F.size("v") == width).mapInArrow(_assign(centres), "vec_id long, v array<long>, cell int, far double"))
    summary = cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in summary:
        radius[r["cell"]], count[r["cell"]] = r["radius"], r["n"]
    asking = cells.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    per_cell = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"), F.max("far").alias("spread")).collect()
    needs, parts, homes = plan_blocks([(r["cell"], r["asked"], r["spread"]) for r in per_cell], centres.astype(np.float64), radius, count, k)
    if not needs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    homes = spark.createDataFrame(homes, "cell int, block int")
    needs = spark.createDataFrame(needs, "cell int, block int, slices long")
    parts = spark.createDataFrame(parts, "block int, parts long")
    spread = small_side(needs, SMALL_NEEDS)
    data = cells.join(spread, "cell").select("block", "cell", F.pmod(F.xxhash64("vec_id"), "slices").alias("slice"), "vec_id", "v")
    part = F.pmod(F.xxhash64("vec_id"), "parts")
    data = data.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    queries = asking.join(F.broadcast(homes), "cell").select("block", "vec_id", "v").join(F.broadcast(parts), "block").withColumn("part", part.cast("int"))
    targets = needs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1))).select("block", "cell", F.col("slice").cast("bigint").alias("slice"))
    queries = queries.join(F.broadcast(targets) if targets.limit(SMALL_NEEDS + 1).count() <= SMALL_NEEDS else targets, "block")
    keys = ["block", "part", "cell", "slice"]
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], F.col("vec_id").alias("asker"), F.col("v").alias("q"))
    found = data.groupBy(*keys).cogroup(queries.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, k: int = K, query_step: int = QUERY_STEP) -> pd.DataFrame:
    """All scores of all queries, for checks on small inputs."""
    whole = np.floor(np.asarray(vectors, np.float64) * SCALE).astype(np.int64)
    out = []
    for i, name in enumerate(ids):
        if name % query_step == 0:
            scored = sorted((-int(whole[i] @ whole[j]), other) for j, other in enumerate(ids) if other != name)
            out += [(name, r + 1, other, -s) for r, (s, other) in enumerate(scored[:k])]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
