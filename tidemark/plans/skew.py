"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number of keys taken off the shuffle. It bounds what is broadcast, not the
#: result: every other key goes through the shuffled join.
HOT_KEYS = 1000


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    weight: str | None = None,
    how: str = "left",
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key.

    The heaviest keys (at most ``hot_keys`` rows of ``right``) are broadcast;
    their rows and the rows without a key are spread over all partitions, so
    that no task gets a whole hot key. ``weight`` names a column of ``right``
    with the number of left rows per key; without it the rows are counted.
    """
    keys = list(keys)
    payload = [name for name in right.columns if name not in keys and name in set(right.columns)]
    packed = right.select(*keys, F.struct(*[F.col(f"`{name}`") for name in payload]).alias("_found"))
    if weight is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        heavy = counts.orderBy(F.desc("_n"), *keys).limit(hot_keys).select(*keys)
        hot = packed.join(F.broadcast(heavy), keys, "left_semi")
    else:
        ranked = packed.orderBy(F.desc(F.col("_found")[weight]), *keys)
        hot = ranked.limit(hot_keys)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in left.columns]), F.lit(1 << 20)) + 1
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    routed = left.join(F.broadcast(hot.withColumnRenamed("_found", "_hot")), keys, "left").withColumn(
        "_slot", F.when(F.col("_hot").isNotNull() | no_key, spread).otherwise(F.lit(0))
    )
    joined = routed.join(packed.withColumn("_slot", F.lit(0).cast("bigint")), [*keys, "_slot"], "left")
    found = F.coalesce("_hot", "_found")
    if how in ("inner", "left_semi"):
        joined = joined.where(found.isNotNull())
    elif how == "left_anti":
        joined = joined.where(found.isNull())
    kept = [F.col(f"`{name}`") for name in left.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*kept)
    return joined.select(*kept, *[found[name].alias(name) for name in payload])
