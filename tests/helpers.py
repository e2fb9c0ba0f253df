"""Small in-line inputs for the measurement job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.comparison import Evidence



def now():
    return F.lit("2026-10-01 08:00:00").cast("timestamp")


WINDOWS = tuple(dt.date.fromisoformat(d) for d in ("2026-08-01", "2026-08-28", "2026-08-29", "2026-09-25"))


def days(start: str, count: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(count)]


def stamp(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def table(spark, schema, rows: list[dict]):
    names = schemas.column_names(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def pull(snapshot_id, source_id, kind, dates, dimensions, retrieved="2026-10-01 06:00:00", filters=None, **extra):
    return dict(
        snapshot_id=snapshot_id, source_id=source_id, kind=kind, adapter_version=1, retrieved_at=stamp(retrieved),
        period_start=min(dates), period_end=max(dates), dimensions=dimensions, filters=filters, warnings=[], headline_safe=True, **extra,
    )


def series_rows(snapshot_id, source_id, series, dates, values, segment=None):
    return [
        dict(snapshot_id=snapshot_id, source_id=source_id, kind="timeseries", date=d, series=series, value=None if v is None else float(v), segment=segment)
        for d, v in zip(dates, values)
    ]


def source(source_id, kind="timeseries", through="2026-09-25", **extra):
    return dict(
        source_id=source_id, kind=kind, status="configured", stale_after_hours=9999.0, timezone="UTC",
        data_through=dt.date.fromisoformat(through), last_success_at=stamp("2026-10-01 06:00:00"), **extra,
    )


def metric(metric_id, source_id, aggregation="sum", **extra):
    return dict(metric_id=metric_id, status="active", version=1, aggregation=aggregation, canonical_source=source_id, **extra)


def request(metric_id, request_id="r1", windows=WINDOWS, **extra):
    names = ("before_start", "before_end", "after_start", "after_end")
    return dict(request_id=request_id, metric_id=metric_id, design="before_after", control="auto", **dict(zip(names, windows)), **extra)


def evidence(spark, pulls, facts, metrics, sources, changes=()):
    return Evidence(
        snapshots=table(spark, schemas.SNAPSHOTS, list(pulls)),
        facts=table(spark, schemas.FACTS, list(facts)),
        metrics=table(spark, schemas.METRICS, list(metrics)),
        sources=table(spark, schemas.SOURCES, list(sources)),
        changes=table(spark, schemas.CHANGES, list(changes)),
    )


def requests(spark, *rows):
    return table(spark, schemas.REQUESTS, list(rows))
