"""A Merkle manifest of a table: one tree per source, one tree over the sources, and a proof for each row.

A node has a tree, a place in its level and a digest. ``arity`` consecutive nodes
are a run. On every level each node computes the place of its sibling in slot
zero (for two: place XOR 1, else place minus slot) and is equijoined with it;
the slot-zero rows then hold their run and emit the parent. A join key has fewer
than ``arity`` rows, whatever the size of a source, and the join's partitioning
serves the grouping too, so a level costs one shuffle of its digests.

Places come from a range partitioning with a count per partition and tree, so no
source is sorted in one task. Proofs are made from the top down: a node hands its
path, the siblings to the left and right of each level above, to the members of
its run. The leaves' paths are used where they arise and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks of places (partitions plus trees) that may be broadcast; more are joined by a shuffle.
SMALL_BLOCKS = 100_000
#: The key of the tree over all sources.
TOP = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values one after another, each as byte count, colon and text, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 within each ``tree`` by ``order``, and ``size``, the rows of the tree.

    The rows are dealt by range, so equal keys should be told apart by a last
    column of ``order``. ``rows`` should be a stored table, as it is sampled first.
    """
    keys = ["tree", *order]
    laid = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    blocks = laid.groupBy("tree", "_part").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(blocks.select("tree", "_part", "_start", before.alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("size")))
    placed = laid.join(small_side(blocks, SMALL_BLOCKS), ["tree", "_part"])
    return placed.withColumn("place", F.col("_at") - F.col("_start") + F.col("_before")).drop("_at", "_part", "_start", "_before")


def sibling_zero(place: Column, arity: int) -> Column:
    """The place of the sibling in slot zero, for nodes in other slots."""
    return place.bitwiseXOR(F.lit(1)) if arity == 2 else place - F.pmod(place, F.lit(arity))


def parents(nodes: DataFrame, arity: int) -> DataFrame:
    """One row per run: tree, place and size on the level above, digest, and its ``members`` by slot.

    ``nodes`` has tree, place, size, digest and ``held``, a column that members keep.
    """
    slot = F.pmod(F.col("place"), F.lit(arity)).cast("int")
    member = F.struct(slot.alias("slot"), "digest", "held")
    first = nodes.where(slot == 0).select("tree", F.col("place").alias("zero"), "size", member.alias("head"))
    others = nodes.where(slot > 0).select("tree", sibling_zero(F.col("place"), arity).alias("zero"), member.alias("other"))
    met = first.join(others, ["tree", "zero"], "left").groupBy("tree", "zero").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.collect_list("other").alias("others"))
    runs = met.withColumn("members", F.concat(F.array("head"), F.sort_array("others")))
    place, size = F.floor(F.col("zero") / arity), F.ceil(F.col("size") / arity)
    digest = F.sha2(F.concat_ws("", F.transform("members", lambda m: m["digest"])), 256)
    return runs.select("tree", place.cast("bigint").alias("place"), size.cast("bigint").alias("size"), digest.alias("digest"), "members")


def grow(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame, int]:
    """The runs of each level from the leaves up, the top node of each tree (tree, level, digest, held), and the largest size.

    ``leaves`` has tree, place, size, digest and held; it is read twice.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, tops, nodes, left, level = [], None, leaves, largest, 0
    while True:
        top = nodes.where("size = 1").select("tree", F.lit(level).alias("level"), "digest")
        tops = top if tops is None else tops.unionByName(top)
        if left <= 1:
            return levels, tops, largest
        runs = stored(parents(nodes.where("size > 1"), arity))
        levels.append(runs)
        nodes = runs.select("tree", "place", "size", "digest", F.lit(None).cast("string").alias("held"))
        left, level = -(-left // arity), level + 1


_PATH = "array<struct<left:string,right:string>>"


def _digests(first: Column, count: Column) -> Column:
    return F.concat_ws("", F.transform(F.slice("members", first, count), lambda m: m["digest"]))


def descend(runs: DataFrame, paths: DataFrame, arity: int) -> DataFrame:
    """The members of the runs with their paths: tree, place, digest, held, path, subroot."""
    met = runs.drop("size", "digest").join(paths.select("tree", "place", "path", "subroot"), ["tree", "place"])
    each = met.select("*", F.explode("members").alias("member"))
    slot = F.col("member.slot")
    own = F.struct(_digests(F.lit(1), slot).alias("left"), _digests(slot + 2, F.greatest(F.size("members") - slot - 1, F.lit(0))).alias("right"))
    place = F.col("place") * arity + slot
    return each.select("tree", place.alias("place"), "member.digest", "member.held", F.concat(F.array(own), F.col("path")).alias("path"), "subroot")


def with_paths(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with their paths. ``tops`` has tree, level, path and subroot of each tree's top node."""

    def ends(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("place"), "path", "subroot")

    paths = ends(len(levels))
    for level in range(len(levels) - 1, 0, -1):
        paths = descend(levels[level], paths, arity).select("tree", "place", "path", "subroot").unionByName(ends(level))
    alone = leaves.where("size = 1").join(ends(0), ["tree", "place"]).select("tree", "place", "digest", "held", "path", "subroot")
    return descend(levels[0], paths, arity).unionByName(alone) if levels else alone


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def every_fifth(doc_id: Column) -> Column:
    """Ids whose decimal text has a CRC-32 that 5 divides; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, changed: Mapping[str, Column] | None = None, when: Column | None = None, arity: int = ARITY
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``changed`` gives columns a tampered value in the rows that ``when`` selects;
    ``folded_root`` is what the changed leaf and the original siblings give.

    Leaves ascend by id, null first, then by leaf, so rows alike are placed next
    to each other and each has a place of its own. A null source is a source of
    its own, before the empty one. A lone leaf is its subroot and a lone subroot
    the root; a leaf without any sibling has the digest of nothing as its proof.
    Null fields count as ``-``, empty ones as ``0:``. Extra columns are ignored
    and an empty table gives no rows.
    """
    spark = docs.sparkSession
    changed = dict(changed or {})
    columns = {name: F.col(f"`{name}`") for name in fields}
    leaf = leaf_digest(list(columns.values()))
    tampered = F.when(F.lit(False) if when is None else when, leaf_digest([changed.get(n, c) for n, c in columns.items()]))
    source = F.col(f"`{source_col}`")
    slim = stored(
        docs.select(
            tree_key(source).alias("tree"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), leaf.alias("digest"), tampered.alias("tampered"), F.rand(7).alias("tie")
        )
    )
    held = F.struct("doc_id", "tampered").alias("held")
    leaves = stored(numbered(slim, ["doc_id", "digest", "tie"]).select("tree", "place", "size", "digest", held))
    levels, tops, largest = grow(leaves, arity)
    if not largest:
        return spark.createDataFrame([], f"doc_id long, source string, leaf string, subroot string, root string, path {_PATH}, proof_sha256 string, folded_root string, verified boolean")
    tops = stored(tops)
    above = numbered(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    above = stored(above.select("tree", "place", "size", "digest", F.col("name").alias("held")))
    upper, top, _ = grow(above, arity)
    root = top.first()["digest"]
    top = top.select("tree", "level", F.array().cast(_PATH).alias("path"), F.col("digest").alias("subroot"))
    sources = with_paths(above, upper, top, arity).select(F.col("held").alias("tree"), "path", F.col("digest").alias("subroot"))
    rows = with_paths(leaves, levels, tops.select("tree", "level").join(stored(sources), "tree"), arity)
    result = rows.select(
        "held.doc_id", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path",
        proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("held.tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
