"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size. Each document gets the whole part
of the rate as copies and the rest as a copy probability. Documents are paired:
the first of each pair hands words to the second, or takes them, at random and
without changing any expectation, until one of the two probabilities is 0 or 1;
the other goes on to the next pair. Words move one for one, so the words a
source gives are kept exactly, up to the one document left at the end.

Pairing runs inside buckets of a source; the one document that each bucket
leaves goes up a reduction tree of ``FAN_IN`` buckets per node.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

from .common import WORD_PATTERN, small_side

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BUCKET_ROWS = 20_000
FAN_IN = 64
#: Sources up to this number are broadcast; beyond it they are joined by shuffle.
SMALL_SOURCES = 100_000
_ROWS = "source string, bucket long, doc_id long, size long, units long, p double, copies long"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size and target for rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. A target
    stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above. All targets together equal all sizes.
    """
    spark = sizes.sparkSession
    sources = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = sources.count()
    # a global rank without one task for all: range partitions, numbered inside and shifted by the counts before them
    ordered = sources.select("*", F.col("source").isNull().alias("last")).repartitionByRange(max(1, n // 50_000), "last", "source").sortWithinPartitions("last", "source")
    inside = F.monotonically_increasing_id()
    ordered = cut_lineage(ordered.select("source", "source_size", F.shiftright(inside, 33).alias("part"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    offsets, before = [], 0
    for part, count in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += count
    shift = spark.createDataFrame(offsets, "part long, before long")
    turn = (F.col("place") + F.col("before")) % len(weights)
    weighted = cut_lineage(ordered.join(F.broadcast(shift), "part").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight")))
    total, weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level, above = (total / weight if total else 0.0), -1
    while total:
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        count, taken, left = weighted.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if count == above or not left:
            break
        level, above = (total - taken) / left, count
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")).alias("target"))


def _round(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pairs the fractional entries in order; returns the probabilities and the open entry, or -1."""
    p, held = p.copy(), -1
    for i in np.flatnonzero((p > 0) & (p < 1) & (sizes > 0)).tolist():
        if held < 0:
            held = i
            continue
        s, t = float(sizes[held]), float(sizes[i])
        up, down = min((1 - p[held]) * s, p[i] * t), min(p[held] * s, (1 - p[i]) * t)
        if draws[i] * (up + down) < down:  # the held one takes words
            filled = (1 - p[held]) * s <= p[i] * t
            p[held], p[i] = (1.0, p[i] - up / t) if filled else (p[held] + up / s, 0.0)
        else:
            emptied = p[held] * s <= (1 - p[i]) * t
            p[held], p[i] = (0.0, p[i] + down / t) if emptied else (p[held] - down / s, 1.0)
        ends = p[i] <= 0 or p[i] >= 1
        if ends and (p[held] <= 0 or p[held] >= 1):
            held = -1
        elif not ends:
            held = i
    return p, held


def _node(level: int, seed: int, last: bool):
    """Rounds one node of the tree; the open entry keeps copies null unless this is the root."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])  # long documents are settled by the short ones after them
        sizes, p = rows["size"].to_numpy() * rows["units"].to_numpy(), rows["p"].to_numpy()
        name = f"{seed}|{level}|{key[1].as_py()}|{key[0].as_py()!r}"
        draws = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode()))).random(len(p) + 1)
        p, held = _round(sizes, p, draws)
        if last and held >= 0:
            p[held], held = float(draws[-1] < p[held]), -1
        p = np.where(sizes > 0, p, 0.0)
        taken = np.rint(p).astype(np.int64)
        open_rows = np.arange(len(p)) == held
        return rows.set_column(5, "p", pa.array(p)).set_column(6, "copies", pa.array(taken, mask=open_rows))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    Size is the number of words; null or empty texts have size 0 and no copies.
    A null source is a source. Rows alike in id, source and size are rounded
    one by one. The draws depend on the rows and ``seed`` only, not on how they
    are partitioned. Extra columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    sizes = cut_lineage(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size")))
    targets = cut_lineage(source_targets(sizes, weights, most))
    counts = cut_lineage(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows")))
    known = cut_lineage(targets.join(counts, targets["source"].eqNullSafe(counts["source"])).select(targets["source"].alias("name"), "source_size", "target", (F.floor(F.col("rows") / BUCKET_ROWS) + 1).alias("buckets")))
    deepest = known.agg(F.max("buckets")).first()[0] or 1
    packed = small_side(known, SMALL_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(packed, sizes["source"].eqNullSafe(packed["name"])).select(
        "source", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("buckets")).alias("bucket"), "doc_id", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p")
    )
    carried = ["source_size", "target", "whole"]
    schema = f"{_ROWS}, source_size long, target double, whole long"
    level, settled = 0, None
    todo = rows.select("source", "bucket", "doc_id", "size", F.lit(1).cast("bigint").alias("units"), "p", F.lit(None).cast("bigint").alias("copies"), *carried)
    while True:
        last = deepest <= 1
        done = cut_lineage(todo.groupBy("source", "bucket").applyInArrow(_node(level, seed, last), schema))
        closed = done.where("copies is not null")
        settled = closed if settled is None else settled.unionByName(closed)
        if last:
            break
        todo = done.where("copies is null").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level, deepest = level + 1, -(-deepest // FAN_IN)
    return settled.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("copies")).otherwise(F.lit(0)).alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    wanted = mix(docs, id_col, text_col, source_col, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("alike")).where("total > 0")
    wanted = wanted.select(F.struct("doc_id", "source", "size").alias("_wanted"), "total", "alike")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    key = F.struct(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    met = packed.join(wanted, F.col("_key") == F.col("_wanted"))
    # rows alike in id, source and size share their total evenly
    place = F.row_number().over(Window.partitionBy("_wanted").orderBy(F.xxhash64("_row")))
    each = F.floor(F.col("total") / F.col("alike")) + (F.col("place") <= F.col("total") % F.col("alike")).cast("int")
    return met.withColumn("place", place).withColumn("each", each.cast("int")).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("each")))).select("_row.*")
