"""Experiment plans that are fixed before any outcome is seen.

A plan names its windows and its control pages. The pages are rows of their own;
the plan keeps their number and an order-free digest. Plans are only appended:
an experiment that has one keeps it. An evaluation reads the pages of the plan
and nothing else, and refuses a set that no longer has the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_hash
from ..session import cut_lineage
from .ledger import rows_digest

WINDOWS = ("before_start", "before_end", "after_start", "after_end")


def page_digests(pages: DataFrame) -> DataFrame:
    """experiment_id, n_pages and digest of distinct pages."""
    distinct = pages.select("experiment_id", "page").distinct()
    return rows_digest(distinct, ["experiment_id"], row_hash(F.col("page"))).withColumnRenamed("rows", "n_pages")


def fix_plans(experiments: DataFrame, controls: DataFrame, plans: DataFrame | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """Plans and plan pages to append, for experiments that have no plan yet.

    ``experiments`` has experiment_id and the windows; ``controls`` their pages,
    chosen from what was known before the outcome. An experiment without pages
    gets a plan of none.
    """
    fresh = experiments if plans is None else experiments.join(plans.select("experiment_id").distinct(), "experiment_id", "left_anti")
    # the choice of pages reads all facts, and plans, their digests and every evaluation read the pages
    pages = cut_lineage(controls.join(fresh.select("experiment_id"), "experiment_id", "left_semi").select("experiment_id", "page").distinct())
    digests = page_digests(pages)
    rows = fresh.join(digests, "experiment_id", "left").select("experiment_id", *WINDOWS, F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("digest", F.lit("none")).alias("digest"), now.alias("fixed_at"))
    return rows, pages


def checked_pages(plans: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of sound plans with the plans' windows, and the plans with their status: fixed or changed."""
    actual = page_digests(pages).select("experiment_id", F.col("n_pages").alias("_n"), F.col("digest").alias("_digest"))
    same = (F.col("n_pages") == F.coalesce("_n", F.lit(0))) & (F.col("digest") == F.coalesce("_digest", F.lit("none")))
    judged = cut_lineage(plans.join(actual, "experiment_id", "left").withColumn("plan_status", F.when(same, "fixed").otherwise("changed")).drop("_n", "_digest"))
    sound = judged.where("plan_status = 'fixed'").select("experiment_id", *WINDOWS)
    return pages.select("experiment_id", "page").distinct().join(sound, "experiment_id"), judged


def evaluate_plans(plans: DataFrame, pages: DataFrame, facts: DataFrame, value: str = "impressions") -> DataFrame:
    """Per plan: status, and the totals of its control pages in both windows; a changed plan has none.

    ``facts`` has page, date and the value. Pages that appeared after planning do
    not enter, whatever they show.
    """
    held, judged = checked_pages(plans, pages)
    day = F.col("date")
    side = {"before_total": day.between(F.col("before_start"), F.col("before_end")), "after_total": day.between(F.col("after_start"), F.col("after_end"))}
    # the facts are reduced to days of pages before they meet the plans
    daily = facts.groupBy("page", "date").agg(F.sum(value).alias("_v"))
    sums = daily.join(held, "page").groupBy("experiment_id").agg(*[F.sum(F.when(where, F.col("_v"))).alias(n) for n, where in side.items()])
    return judged.join(sums, "experiment_id", "left").select("experiment_id", "plan_status", "n_pages", "before_total", "after_total")
