"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (``stat.freqItems``) names every digest that may hold more
than ``support`` of the rows, at most ``1 / support`` of them. Those candidates
are counted exactly, and their winners are broadcast, so rows of frequent texts
are settled where they are. All other digests go through an ordinary shuffle,
in which no group has more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

from .common import SPACE_CHARACTERS

#: Share of the rows from which a digest counts as frequent; also bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE_CHARACTERS, "")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.sha2(normalised(text), 256).alias("digest"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("length"),
    ]


def _winners(rows: DataFrame) -> DataFrame:
    """For each digest its size and best row: the longest, then the smallest id; rows without an id come last."""
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("order")))
    return rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), best.alias("best"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, length.

    Texts are equal when they agree without white space. Null texts are empty
    and so form one group. Of rows that also share the id, one is kept. Rows
    without an id take part; they win only over each other. Extra columns of
    ``docs`` are ignored, and an empty table gives an empty result.
    """
    rows = cut_lineage(docs.select(*_keys(docs, id_col, text_col)).groupBy("doc_id", "digest", "length").agg(F.count(F.lit(1)).alias("copies")))
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = cut_lineage(_winners(rows.join(F.broadcast(frequent), "digest", "left_semi")))
    heavy = rows.join(F.broadcast(verified), "digest")
    light = rows.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    light = light.join(_winners(light), "digest")
    wins = F.col("length").eqNullSafe(F.col("best.length")) & F.col("doc_id").eqNullSafe(-F.col("best.order"))
    settled = heavy.unionByName(light).withColumn("wins", wins)
    # of several rows with one id, the first copy stays; of several lengths, only the longest wins
    return settled.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        "doc_id", (-F.col("best.order")).alias("keep_id"), "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "digest", "length"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keys = ["doc_id", "digest", "length"]
    stays = exact_groups(docs, id_col, text_col, support).where("kept").select(F.struct(*keys).alias("_stays")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(*_keys(docs, id_col, text_col)).alias("_key"))
    met = packed.join(stays, F.col("_key") == F.col("_stays"), "left_semi")
    # repeated rows share a key: keep one of each
    first = met.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return first.select("_row.*")
