"""Change logs, publications and finished tasks to change rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import change_type, publication_type, task_type
from ..functions.dates import iso_date
from ..functions.numbers import or_null
from ..functions.text import row_hash
from ..functions.urls import page_key

# fixed values: header names of a change log, first present wins
COLUMNS = {
    "deployed": ("deployed_at", "deploy_date", "deployed", "live_date", "live_at", "released", "release_date"),
    "applied": ("applied_at", "applied", "apply_date", "applied_date"),
    "date": ("date", "timestamp", "when"),
    "pages": ("url(s)", "urls", "url", "pages", "page", "path", "paths"),
    "type": ("change_type", "type", "kind"),
    "title": ("title", "change", "summary", "description"),
    "task": ("task", "ticket", "id", "issue"),
}

_PAGE = r"`([^`]+)`|(https?://[^\s|,)]+)|(?:^|\s)(/[A-Za-z0-9._~%\-/]+)"


def pages_in(text: Column) -> Column:
    """Page keys named in a cell: in backquotes, as addresses, or as paths; wildcards are no pages."""
    found = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PAGE), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, "`", ""))
    )
    named = F.filter(found, lambda m: m.rlike("^(/|https?://)") & ~m.contains("*"))
    return F.array_distinct(F.transform(named, page_key))


def change_log(
    rows: DataFrame, file: str, date_means: str | None = None, default_type: str = "other", origin: str = "manual", deploy_status: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Change rows from a CSV change log (text columns with lower-case names).

    A lone date column must be declared as ``deployed`` or ``applied``. The
    reference of a row is its whole hash and its number among equal rows, so a
    log with rows appended keeps the references it had. ``carry`` names columns
    of the log to hand on.
    """
    at = {role: next((n for n in names if n in rows.columns), None) for role, names in COLUMNS.items()}
    if not (at["deployed"] or at["applied"] or at["date"]):
        raise ValueError("no date column found")
    if at["date"] and not at["deployed"] and not at["applied"] and date_means not in ("deployed", "applied"):
        raise ValueError(f'column "{at["date"]}" is ambiguous: say whether it means deployed or applied')
    cell = lambda role: F.col(f"`{at[role]}`") if at[role] else F.lit("")
    dated = lambda role: cell(role) if at[role] else (cell("date") if date_means == role else F.lit(None).cast("string"))
    first_word = lambda c: F.when(iso_date(c).isNotNull(), F.regexp_extract(F.trim(c), r"^(\S+)", 1))
    deployed, applied = first_word(dated("deployed")), first_word(dated("applied"))
    status = F.when(deployed.isNotNull(), "deployed").otherwise(
        F.lit(deploy_status) if deploy_status and deploy_status != "deployed" else F.when(applied.isNotNull() & F.lit(deploy_status is None), "pending").otherwise("unknown")
    )
    pages = pages_in(cell("pages"))
    label = F.concat_ws(" ", F.coalesce(or_null(cell("type")), F.lit("change")), F.array_join(pages, ", "))
    hashed = row_hash(*[F.col(f"`{n}`") for n in rows.columns])
    equal = Window.partitionBy("_hash").orderBy("_hash")
    return rows.withColumn("_hash", hashed).select(
        F.regexp_replace(F.coalesce(or_null(F.trim(cell("title"))), label), r"\*\*", "").alias("title"),
        F.lit(origin).alias("origin"),
        F.concat(F.lit(f"import:{file}#"), F.row_number().over(equal).cast("string"), F.lit(":"), "_hash").alias("origin_ref"),
        change_type(F.concat_ws(" ", cell("type"), cell("title")), default_type).alias("type"),
        F.when(status == "deployed", deployed.try_cast("timestamp")).alias("live_at"),
        F.when(deployed.isNotNull(), "deploy_log").otherwise("unknown").alias("timestamp_basis"),
        status.alias("deploy_status"),
        applied.try_cast("timestamp").alias("applied_at"),
        pages.alias("pages"),
        *[F.col(f"`{n}`") for n in carry],
    )


def publications(ledger: DataFrame, assets: DataFrame, events: DataFrame) -> DataFrame:
    """Published assets: ledger rows with their event and asset, plus events without a ledger row.

    Keys are task_id and asset_id. The live time is the first known of
    deployed_at, live_at, actual_publish_time and timestamp.
    """
    keys = ["task_id", "asset_id"]
    about = assets.select(*keys, "title", "channel", "asset_type")
    done = events.where("status = 'published'").groupBy(*keys).agg(
        F.max(F.struct("event_at", "publication_url", F.col("channel").alias("event_channel"))).alias("_e")
    ).select(*keys, "_e.*")
    published = ledger.where("status = 'published'")
    live = F.coalesce("deployed_at", "live_at")
    rows = published.drop("status").withColumnRenamed("channel", "_channel").join(done, keys, "left").join(about, keys, "left").select(
        *keys, "title", F.coalesce("_channel", "channel").alias("channel"), "asset_type",
        F.coalesce(live, "actual_publish_time", "written_at").alias("published_at"),
        F.when(live.isNotNull(), "deploy_log").otherwise("publish_ledger").alias("timestamp_basis"),
        F.when(F.col("publication_url") != "unknown", F.col("publication_url")).alias("publication_url"),
    )
    alone = done.join(published.select(*keys).distinct(), keys, "left_anti").join(about, keys, "left").select(
        *keys, "title", F.coalesce("event_channel", "channel").alias("channel"), "asset_type", F.col("event_at").alias("published_at"),
        F.lit("execution_result").alias("timestamp_basis"),
        F.when(F.col("publication_url") != "unknown", F.col("publication_url")).alias("publication_url"),
    )
    return rows.unionByName(alone)


def publication_changes(published: DataFrame, origin: str = "external") -> DataFrame:
    """Change rows of publications; without an address the scope is unknown."""
    url = F.col("publication_url")
    return published.select(
        F.concat_ws("/", "task_id", "asset_id").alias("origin_ref"), F.lit(origin).alias("origin"), F.coalesce("title", F.lit("published asset")).alias("title"),
        publication_type(F.concat_ws(" ", "asset_type", "channel")).alias("type"), F.col("published_at").alias("live_at"),
        F.when(F.col("published_at").isNull(), "unknown").otherwise(F.col("timestamp_basis")).alias("timestamp_basis"),
        F.when(url.isNotNull(), F.array(page_key(url))).otherwise(F.array().cast("array<string>")).alias("pages"),
    )


def task_changes(tasks: DataFrame, origin: str = "external") -> DataFrame:
    """Change rows of finished tasks; a creation time is only an unconfirmed stand-in for the live time."""
    done = tasks.where("phase = 'done' AND scope IN ('feature', 'quick')")
    return done.select(
        F.col("task_id").alias("origin_ref"), F.lit(origin).alias("origin"), "title", task_type(F.col("title")).alias("type"),
        F.coalesce("deployed_at", "created_at").alias("live_at"),
        F.when(F.col("deployed_at").isNotNull(), "deploy_log").when(F.col("created_at").isNotNull(), "task_created").otherwise("unknown").alias("timestamp_basis"),
        F.col("deployed_at").isNotNull().alias("confirmed"), F.array().cast("array<string>").alias("pages"),
    )
