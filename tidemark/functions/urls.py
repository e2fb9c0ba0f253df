"""Page keys and markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_key(url: Column) -> Column:
    """Path of a URL: no host, query, fragment or trailing slash; percent escapes decoded.

    Reserved characters stay escaped and ``+`` stays a plus sign. A malformed
    escape leaves the raw text.
    """
    # each step refers to the one before it once, which keeps plans small
    bare = F.regexp_replace(F.trim(url), r"^(?i:https?)://[^/?#\\]*", "")
    rooted = F.regexp_replace(F.regexp_extract(bare, r"^([^?#]*)", 1), "^/?", "/")
    key = F.regexp_replace(rooted, "(?<=.)/+$", "")
    kept = F.regexp_replace(key, r"%(?i:(3B|2F|3F|3A|40|26|3D|2B|24|2C|23))", r"%25$1")
    decoded = F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
    return F.when(url != "", F.coalesce(decoded, key))


def market(page: Column, prefixes: Sequence[str] = ()) -> Column:
    """Market of a page key.

    With configured prefixes: the longest one that is the page or a parent of
    it, else ``/``. Without: a two-letter (or ``xx-yy``) first path part, else ``/``.
    """
    path = F.coalesce(page, F.lit("/"))
    named = sorted({p for p in prefixes if p and p != "/"}, key=lambda p: (-len(p), p))
    if named:
        result = F.lit("/")
        for prefix in reversed(named):
            result = F.when((path == prefix) | path.startswith(prefix + "/"), F.lit(prefix)).otherwise(result)
        return result
    first = F.regexp_extract(path, r"^/((?i:[a-z]{2}(?:-[a-z]{2})?))(?:/|$)", 1)
    return F.concat(F.lit("/"), first)
