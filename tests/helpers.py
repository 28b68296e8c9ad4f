from __future__ import annotations

from datetime import datetime, timedelta, timezone

from siftwall.schema import EVENT_SCHEMA, conform

START = datetime(2026, 3, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    """A UTC instant, to the microsecond."""
    return START + timedelta(microseconds=round(seconds * 1_000_000))


def events(spark, rows: list[dict]):
    """Event rows from partial dicts; ``t`` is seconds from START."""
    full = []
    for row in rows:
        row = dict(row)
        moment = at(row.pop("t")) if "t" in row else None
        base = {f.name: None for f in EVENT_SCHEMA.fields}
        base.update(
            ip="1.1.1.1",
            timestamp=moment,
            status=200,
            bytes_sent=0,
            classification="normal",
            count=0,
            log_source="access",
        )
        base.update(row)
        full.append(tuple(base[f.name] for f in EVENT_SCHEMA.fields))
    return conform(spark.createDataFrame(full, EVENT_SCHEMA), EVENT_SCHEMA)


def seconds(moment) -> float | None:
    if moment is None:
        return None
    return (moment.replace(tzinfo=timezone.utc) - START).total_seconds()
