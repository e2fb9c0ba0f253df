"""False-discovery control without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..session import cut_lineage


def _needed_rank(p: Column, n: Column, q: float) -> Column:
    """The smallest rank k with ``p <= k / n * q``, exact at the boundary."""
    guess = F.greatest(F.lit(1), F.ceil(p * n / F.lit(q)))
    return (
        F.when((guess > 1) & (p <= (guess - 1) / n * F.lit(q)), guess - 1)
        .when(p <= guess / n * F.lit(q), guess)
        .otherwise(guess + 1)
    )


def fdr_cutoff(tests: DataFrame, p: str = "p_value", q: float = 0.1, family: Sequence[str] = ()) -> DataFrame:
    """The largest p-value that Benjamini-Hochberg keeps at rate ``q``, per family.

    Tests are counted per distinct p-value, then per rank that value needs,
    then in blocks of about the square root of n ranks. A window therefore
    never holds more rows than that, even if most p-values are alike.
    """
    family = list(family)
    by_p = tests.groupBy(*family, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = by_p.groupBy(*family).agg(F.sum("_c").alias("_n"))
    if family:
        sized = lookup_join(by_p, sizes, family, weight="_n")
    else:
        # one row by construction; a p-value is never above the number of tests
        sized = by_p.join(F.broadcast(sizes), F.col("_p") <= F.col("_n"))
    needed = sized.withColumn("_need", _needed_rank(F.col("_p"), F.col("_n"), q))
    block = F.floor(F.col("_need") / F.ceil(F.sqrt("_n")))
    counts = needed.groupBy(*family, block.alias("_block"), "_need").agg(
        F.sum("_c").alias("_c"), F.max("_p").alias("_p")
    )
    # the same columns on both sides of the join, so that they read one exchange
    blocks = counts.groupBy(*family, "_block").agg(F.sum("_c").alias("_total"), F.max("_p").alias("_top"), F.max("_need").alias("_end"))
    ahead = Window.partitionBy(*family).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_total").over(ahead), F.lit(0))
    offsets = blocks.select(*family, "_block", "_top", "_end", offset.alias("_offset"))
    inside = Window.partitionBy(*family, "_block").orderBy("_need").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.join(offsets, [*family, "_block"]).withColumn("_cum", F.col("_offset") + F.sum("_c").over(inside))
    passed = running.where((F.col("_cum") >= F.col("_need")) & (F.col("_p") <= F.col("_top")) & (F.col("_need") <= F.col("_end")))
    return passed.groupBy(*family).agg(F.max("_p").alias("cutoff"))


def fdr_keep(tests: DataFrame, p: str = "p_value", q: float = 0.1, family: Sequence[str] = (), flag: str = "keep") -> DataFrame:
    """Add a boolean: the test survives Benjamini-Hochberg at rate ``q`` within its family.

    Equal p-values are kept or dropped together, so no tie-break is needed.
    The tests are aggregated rows and read several times, so they are written
    once: the facts behind them are scanned once.
    """
    tests = cut_lineage(tests)
    cutoff = fdr_cutoff(tests, p, q, family)
    if family:
        limited = lookup_join(tests, cutoff, list(family))
    else:
        # one row by construction
        limited = tests.join(F.broadcast(cutoff), F.col(p) <= F.col("cutoff"), "left")
    flagged = limited.withColumn(flag, F.coalesce(F.col(p) <= F.col("cutoff"), F.lit(False)))
    return flagged.select(*[F.col(f"`{name}`") for name in tests.columns], flag)
