"""Date buckets and date operands."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# How each bucket is labelled.
BUCKET_FORMATS = {
    "hour": "yyyy-MM-dd HH:00",
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM",
}

_ISO = re.compile(
    r"([+-]?\d{4,6})(?:-(\d{2})(?:-(\d{2})"
    r"(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?"
)


def bucket_start(c: Column, bucket: str) -> Column:
    """Start of the bucket a timestamp falls in; weeks start on Monday."""
    if bucket not in BUCKET_FORMATS:
        raise ValueError(f"unknown date bucket {bucket!r}")
    return F.date_trunc(bucket, c)


def bucket_label(start: Column, bucket: str) -> Column:
    return F.date_format(start, BUCKET_FORMATS[bucket])


def parse_iso(raw: str) -> datetime | None:
    """A date operand as a naive UTC datetime, or None when it is not an ISO date."""
    m = _ISO.fullmatch(raw.strip())
    if not m:
        return None
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    micros = int((fraction or "0").ljust(6, "0")[:6])
    text = f"{int(year):04d}-{month or '01'}-{day or '01'}T{hour or '00'}:{minute or '00'}:{second or '00'}"
    offset = "+00:00" if zone in (None, "Z") else zone if ":" in zone else f"{zone[:3]}:{zone[3:]}"
    try:
        value = datetime.fromisoformat(text + offset).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None
    return value.replace(tzinfo=None, microsecond=micros)
