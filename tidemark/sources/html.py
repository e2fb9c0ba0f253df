"""Stored pages and sitemaps to crawl rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# fixed values: what to read from a page
_PATTERNS = {
    "canonical": r"""(?i)<link[^>]+rel=["']canonical["'][^>]*href=["']([^"']+)""",
    "title": r"(?i)<title[^>]*>([\s\S]*?)</title>",
    "meta_description": r"""(?i)<meta[^>]+name=["']description["'][^>]*content=["']([^"']*)""",
    "robots": r"""(?i)<meta[^>]+name=["']robots["'][^>]*content=["']([^"']*)""",
}


def unescape(text: Column) -> Column:
    for entity, plain in (("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract(html: Column, field: str) -> Column:
    """Title, canonical, meta description or robots of a page; empty when absent."""
    return unescape(F.regexp_extract(html, _PATTERNS[field], 1))


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the four fields to a table of stored pages."""
    return pages.withColumns({name: extract(F.col(html), name) for name in _PATTERNS})


def sitemap_urls(sitemaps: DataFrame, text: str = "xml") -> DataFrame:
    """Distinct page addresses of stored sitemaps; entries that name other sitemaps are left out."""
    located = sitemaps.select(F.explode(F.regexp_extract_all(text, F.lit(r"<loc>([^<]+)</loc>"), F.lit(1))).alias("url"))
    return located.where(~F.col("url").rlike(r"\.xml(\?|$)")).distinct()


def with_sitemap(crawl: DataFrame, urls: DataFrame) -> DataFrame:
    """Add ``in_sitemap``."""
    listed = urls.select("url", F.lit(True).alias("in_sitemap")).distinct()
    return crawl.drop("in_sitemap").join(listed, "url", "left").fillna(False, ["in_sitemap"])


def absolute(target: Column, base: Column) -> Column:
    """A redirect target against the address that gave it: absolute, scheme-relative, rooted or relative to the folder."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(folder, F.lit("/"), target))
    )


def redirect_chains(fetched: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Follow redirects to the end: first status, last address, number of hops, and whether the chain was cut or loops.

    ``fetched`` has url, status and redirect_to; of several rows of a url the
    smallest status counts. Targets may be relative. Jumps double per round, so
    a chain of n hops takes log n joins; ``max_hops`` stops after so many single
    hops instead and flags what goes on as ``truncated``, as loops are too.
    """
    fetched = fetched.groupBy("url").agg(F.min(F.struct("status", F.coalesce("redirect_to", F.lit("")).alias("redirect_to"))).alias("_f")).select("url", "_f.*")
    redirects = fetched.where(F.col("status").between(300, 399) & (F.col("redirect_to") != ""))
    step = redirects.select(F.col("url").alias("_at"), absolute(F.col("redirect_to"), F.col("url")).alias("_to"))
    if max_hops is not None:
        chain = fetched.select("url", "status", F.col("url").alias("_end"), F.lit(0).cast("bigint").alias("_hops"))
        for _ in range(max_hops):
            on = chain.join(step, F.col("_end") == F.col("_at"), "left")
            chain = on.select("url", "status", F.coalesce("_to", "_end").alias("_end"), (F.col("_hops") + F.col("_to").isNotNull().cast("int")).alias("_hops"))
        chain = chain.join(step.select(F.col("_at").alias("_end"), F.lit(True).alias("_more")), "_end", "left")
    else:
        jumps = cut_lineage(step.select("_at", "_to", F.lit(1).cast("bigint").alias("_hops"), F.lit(True).alias("_more")))
        reach, most = 1, jumps.count()
        while reach <= 2 * most:  # one round more than needed shows what never ends
            further = jumps.select(F.col("_at").alias("_to"), F.col("_to").alias("_next"), F.col("_hops").alias("_added"))
            on = jumps.join(further, "_to", "left")
            jumps = cut_lineage(on.select("_at", F.coalesce("_next", "_to").alias("_to"), (F.col("_hops") + F.coalesce("_added", F.lit(0))).alias("_hops"), F.col("_next").isNotNull().alias("_more")))
            reach *= 2
            if jumps.where("_more").isEmpty():
                break
        chain = fetched.join(jumps.select(F.col("_at").alias("url"), F.col("_to").alias("_end"), "_hops", "_more"), "url", "left")
    hops = F.coalesce("_hops", F.lit(0)).cast("int")
    return chain.select("url", "status", F.when(hops > 0, F.col("_end")).otherwise("").alias("redirect_to"), hops.alias("redirect_hops"), F.coalesce("_more", F.lit(False)).alias("truncated"))
