"""Definitions and settings as they were valid at a request's time.

Look-ups are made once per distinct key and time, in buckets of time: inside a
bucket the last version before the time wins, and each bucket begins with the
version that the earlier ones end with. A window holds one bucket of one key, or
one row per bucket of a key, so a metric that a third of all requests ask for is
spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 64


def _bucket(column: str):
    return F.floor(F.unix_date(F.to_date(column)) / BUCKET_DAYS)


def as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, since: str, order: Sequence[str] = ()) -> DataFrame:
    """``requests`` with the columns of the version of ``key`` that is valid at time ``at``, or nulls.

    A version is valid from ``since`` until the next; of several that begin at
    once the last by ``order`` counts. Versions without a time are never valid,
    and requests without one find none.
    """
    payload = [c for c in versions.columns if c not in (key, since)]
    packed = F.struct(F.col(since).alias("_since"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *payload)
    held = versions.where(F.col(since).isNotNull()).groupBy(key, F.col(since).alias("_t")).agg(F.max(packed).alias("_v")).withColumn("_asks", F.lit(0))
    asked = requests.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_t")).distinct().withColumn("_asks", F.lit(1))
    rows = asked.unionByName(held, allowMissingColumns=True).withColumn("_b", _bucket("_t"))
    # what each bucket begins with
    ends = rows.groupBy(key, "_b").agg(F.max("_v").alias("_end"))
    along = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.last("_end", ignorenulls=True).over(along).alias("_begin"))
    inside = Window.partitionBy(key, "_b").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_asks = 1")
    met = found.join(begins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")), "left")
    answer = met.select(F.col(key).alias("_k"), F.col("_t").alias("_at"), F.coalesce("_last", "_begin").alias("_found"))
    joined = requests.join(answer, F.col(key).eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_at")), "left")
    return joined.select(*requests.columns, F.col("_found._since").alias(since), *[F.col(f"_found.{c}").alias(c) for c in payload])


def settings_as_of(requests: DataFrame, config: DataFrame, defaults: Mapping[str, float], at: str = "at") -> DataFrame:
    """``requests`` with one column per setting: the stored value valid at their time, else the default.

    ``config`` has name, value and since, one row per change of a setting; a null
    value goes back to the default.
    """
    times = requests.select(at).distinct()
    asked = times.withColumn("name", F.explode(F.array(*[F.lit(n) for n in defaults])))
    found = as_of(asked, config.select("name", F.col("value").cast("double").alias("value"), "since"), "name", at, "since")
    wide = found.groupBy(at).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in defaults])
    filled = wide.select(F.col(at).alias("_at"), *[F.coalesce(n, F.lit(float(v))).alias(n) for n, v in defaults.items()])
    joined = requests.join(filled, F.col(at).eqNullSafe(F.col("_at")), "left").drop("_at")
    return joined.fillna({n: float(v) for n, v in defaults.items()})
