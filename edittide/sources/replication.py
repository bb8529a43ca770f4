"""Which replication files a time range needs: pure planning, the network stays outside."""

from __future__ import annotations

import calendar
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edittide.config import ConfigError
from edittide.functions import columns as C

#: Names of sources and what they stand for.
GRANULARITIES = ("minute", "hour", "day")
ZONES = {"UTC": "UTC", "Nepal": "Asia/Kathmandu"}


def _minutes(span: timedelta) -> int:
    return int(span.total_seconds() / 60)


def change_sequences(start: datetime, end: datetime | None, granularity: str, seq_at: Callable[[datetime], int], time_of: Callable[[int], datetime], newest: int) -> range:
    """Sequence numbers of change files that cover [start, end), padded on both sides.

    Minute files get an hour before and after, hour files one before, hour and day files one after;
    all are held to the server's newest. An empty range raises ConfigError.
    """
    first = seq_at(start)
    behind = start - time_of(first)
    if behind > timedelta(0):
        if granularity == "minute":
            first += _minutes(behind) - 60
        elif granularity == "hour":
            first += int(behind.total_seconds() / 3600) - 1
    last = newest
    if end is not None:
        last = seq_at(end)
        last += _minutes(time_of(last) - end) + 60 if granularity == "minute" else 1
        last = min(last, newest)
    if first >= last:
        raise ConfigError("already up to date")
    return range(first, last + 1)


def changeset_sequence(at: datetime, newest: int, newest_at: datetime) -> int:
    """Changeset files come each minute, so a time maps to a number."""
    return min(newest, newest + _minutes(at - newest_at))


#: Minutes of changeset files that are read beyond a range on each side; the exact filter comes later.
CHANGESET_PAD = 60


def changeset_sequences(start: datetime, end: datetime | None, newest: int, newest_at: datetime, time_of: Callable[[int], datetime]) -> range:
    """Sequence numbers of changeset files that cover [start, end), CHANGESET_PAD more on both sides, held to the newest.

    The guess of one file a minute is corrected once by the time of the file it leads to. An empty range raises ConfigError.
    """

    def near(at: datetime) -> int:
        guess = changeset_sequence(at, newest, newest_at)
        return guess + _minutes(at - time_of(guess))

    first = near(start) - CHANGESET_PAD
    last = newest if end is None or end > newest_at else min(newest, near(end) + CHANGESET_PAD)
    if start >= newest_at or first >= last:
        raise ConfigError("already up to date")
    return range(first, last + 1)


def planned(spark: SparkSession, sequences: range, base: str, suffix: str = ".osc.gz") -> DataFrame:
    """(seq, url) of the files of a plan."""
    return spark.range(sequences.start, sequences.stop).select(F.col("id").alias("seq"), C.sequence_path(F.col("id"), base, suffix).alias("url"))


def extract_urls(catalogue: DataFrame, countries: Sequence[str]) -> DataFrame:
    """(id, update_url) of the asked extracts; an unknown one raises ConfigError.

    The catalogue holds one row per published extract; at most one row per asked name is collected.
    """
    asked = sorted({c.lower() for c in countries})
    found = catalogue.filter(F.lower("id").isin(*asked)).select("id", "update_url")
    if missing := set(asked) - {r["id"].lower() for r in found.select("id").distinct().collect()}:
        raise ConfigError(f"unknown country: {sorted(missing)}")
    return found


def source_urls(urls: Sequence[str], base: str) -> list[str]:
    """Addresses without repeats; minute, hour and day stand for the planet's own feeds. Others are kept."""
    return list(dict.fromkeys(f"{base}/replication/{u}" if u in GRANULARITIES else u for u in urls))


def to_zone(at: datetime, zone: str) -> datetime:
    return at.astimezone(ZoneInfo(ZONES.get(zone, zone)))


def preset(name: str, now: datetime, days: int | None = None, whole: bool = False) -> tuple[datetime, datetime]:
    """Half-open UTC range of a named preset as of `now`.

    The week and the year end at the start of their last day, as existing reports have them; `whole`
    includes that day.
    """
    now = now.astimezone(timezone.utc)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "last_hour":
        end = now.replace(minute=0, second=0, microsecond=0)
        return end - timedelta(hours=1), end
    if name == "last_day":
        return today - timedelta(days=1), today
    if name == "days":
        if not days or days < 1:
            raise ConfigError("days must be positive")
        return today - timedelta(days=days), today
    if name == "last_week":
        start = today - timedelta(days=today.weekday() + 7)
        return start, start + timedelta(days=7 if whole else 6)
    if name == "last_month":
        year, month = (today.year, today.month - 1) if today.month > 1 else (today.year - 1, 12)
        start = today.replace(year=year, month=month, day=1)
        return start, start + timedelta(days=calendar.monthrange(year, month)[1])
    if name == "last_year":
        start = today.replace(year=today.year - 1, month=1, day=1)
        return start, start.replace(year=today.year) if whole else start.replace(month=12, day=31)
    raise ConfigError(f"unknown preset {name}")
