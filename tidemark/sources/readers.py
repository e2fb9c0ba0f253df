"""Export files to raw text rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def column_key(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quoted fields: trimmed text cells, lower-case names, blank rows dropped, short rows padded."""
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    )
    cells = raw.select(*[F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(column_key(n)) for n in raw.columns])
    return cells.where(F.concat(*[F.col(f"`{n}`") for n in cells.columns]) != "")


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header, one file per partition."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


#: where a response may keep its rows, in order of preference
ENVELOPES = ("$", "$.rows", "$.data", "$.data.rows", "$.results", "$.data.results")


def json_rows(documents: DataFrame, text: str, row_schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of saved JSON responses: the first envelope that holds a list.

    ``documents`` has one response per row, so files are parsed in parallel.
    """
    body = F.trim(F.col(text))
    found: Column = F.lit(None).cast("string")
    for path in reversed(ENVELOPES):
        value = body if path == "$" else F.get_json_object(body, path)
        found = F.when(value.startswith("["), value).otherwise(found)
    parsed = F.from_json(found, f"array<{row_schema}>")
    return documents.select(*keep, F.explode(parsed).alias("row")).select(*keep, "row.*")


def read_json_rows(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of JSON export files, each file one response."""
    files = spark.read.option("wholetext", True).text(path)
    return json_rows(files, "value", row_schema)
