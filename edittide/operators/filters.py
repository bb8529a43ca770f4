"""Row filters over elements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_range(df: DataFrame, start: datetime | str | None, end: datetime | str | None, ts: str = "ts") -> DataFrame:
    """Half-open [start, end) in UTC. The literal takes the column's type, so the filter reaches the Parquet scan."""
    kind = df.schema[ts].dataType

    def bound(t: datetime | str):
        t = datetime.fromisoformat(t) if isinstance(t, str) else t
        t = t.astimezone(timezone.utc) if t.tzinfo else t
        return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f") + ("+00:00" if isinstance(kind, T.TimestampType) else "")).cast(kind)

    if start is not None:
        df = df.filter(F.col(ts) >= bound(start))
    if end is not None:
        df = df.filter(F.col(ts) < bound(end))
    return df


def by_users(df: DataFrame, users: Sequence[str]) -> DataFrame:
    """Exact, case-sensitive names."""
    return df.filter(F.col("user").isin(*users))


def in_changesets(elements: DataFrame, changesets: DataFrame) -> DataFrame:
    """Elements of the given changesets; none if there is no changeset."""
    return elements.join(changesets.select(F.col("id").alias("changeset")), "changeset", "left_semi")


def selected(elements: DataFrame, changesets: DataFrame | None, users: Sequence[str], filtering: bool) -> DataFrame:
    """The filter that a run asks for: changesets if one of their filters is on, else names, else none."""
    if filtering:
        if changesets is None:
            raise ValueError("a changeset filter needs changesets")
        return in_changesets(elements, changesets)
    return by_users(elements, users) if users else elements
