"""Integrity of all tables in one shuffle.

The keys that tables hold, the references between them and the digests recorded
elsewhere are stacked as tagged rows and grouped once by table and id. A group
shows whether a record is missing, doubled or changed. Counts and bounds combine
on the map side, so an id that a third of all records refers to is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Keys(NamedTuple):
    """Records of a table: their id, and a digest of what must not change (or None)."""

    table: str
    rows: DataFrame
    key: str
    digest: Column | None = None


class References(NamedTuple):
    """Ids that the records of one table name in another; nulls name nothing."""

    table: str
    rows: DataFrame
    key: str
    target: str
    ref: str


class Recorded(NamedTuple):
    """Digests of records as noted when they were written."""

    table: str
    rows: DataFrame
    key: str
    digest: Column


def _row(rows: DataFrame, table: str, key: Column, role: str, owner: Column | None = None, digest: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(table).alias("table"), key.cast("string").alias("id"), F.lit(role).alias("role"), none.alias("owner") if owner is None else owner.alias("owner"),
        (none if digest is None else digest.cast("string")).alias("digest"),
    )


def tagged(keys: Sequence[Keys] = (), references: Sequence[References] = (), recorded: Sequence[Recorded] = ()) -> DataFrame:
    """table, id, role (key, ref or note), owner and digest, of all tables."""
    stacked = [_row(k.rows, k.table, F.col(k.key), "key", digest=k.digest) for k in keys]
    for r in references:
        owner = F.concat_ws(":", F.lit(r.table), F.col(r.key).cast("string"))
        stacked.append(_row(r.rows.where(F.col(r.ref).isNotNull()), r.target, F.col(r.ref), "ref", owner=owner))
    stacked += [_row(n.rows, n.table, F.col(n.key), "note", digest=n.digest) for n in recorded]
    return reduce(DataFrame.unionByName, stacked)


def integrity(keys: Sequence[Keys], references: Sequence[References] = (), recorded: Sequence[Recorded] = ()) -> DataFrame:
    """What is wrong: table, id, violation, records, references and one record that refers to it.

    ``dangling``: referred to but not there. ``unnamed``: records without an id.
    ``double``: held more than once. ``changed``: copies that differ, or a record
    unlike its note. ``lost``: noted but not there. Empty when all is sound.
    """
    role = lambda name: F.col("role") == name
    held = tagged(keys, references, recorded).groupBy("table", "id").agg(
        F.count_if(role("key")).alias("records"), F.count_if(role("ref")).alias("references"), F.count_if(role("note")).alias("notes"),
        F.min("digest").alias("_least"), F.max("digest").alias("_most"), F.min("owner").alias("referred_by"),
    )
    there = F.col("records") > 0
    rules = {
        "unnamed": F.col("id").isNull() & there,
        "dangling": ~there & (F.col("references") > 0),
        "double": F.col("id").isNotNull() & (F.col("records") > 1),
        "changed": F.col("id").isNotNull() & there & (F.col("_least") != F.col("_most")),
        "lost": ~there & (F.col("notes") > 0),
    }
    broken = F.array_compact(F.array(*[F.when(where, F.lit(name)) for name, where in rules.items()]))
    return held.select("table", "id", F.explode(broken).alias("violation"), "records", "references", "referred_by")
