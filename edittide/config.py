"""Options of a run, with their implications and guards."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from edittide.schema import KINDS


class ConfigError(ValueError):
    """An option or a combination of options is not allowed."""


@dataclass(frozen=True)
class StatsConfig:
    """What to read, filter, measure and write.

    The schema of every result follows from this object alone, never from the data.
    """

    start: datetime | None = None
    end: datetime | None = None
    hashtags: tuple[str, ...] = ()
    exact_lookup: bool = False
    field_mappers: bool = False
    users: tuple[str, ...] = ()
    boundary: str | None = None
    country: tuple[str, ...] = ()
    url: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    all_tags: bool = False
    key_value: bool = False
    length: tuple[str, ...] = ()
    changeset: bool = False
    tm_stats: bool = False
    summary: bool = False
    rows: int | None = None
    name: str = "stats"
    formats: tuple[str, ...] = ("csv",)
    charts: bool = False
    meta: bool = False
    force: bool = False
    update: bool = False
    preset: str | None = None
    read_from_metadata: str | None = None
    dedupe: bool = False

    def resolved(self) -> StatsConfig:
        """The same options with implied ones switched on; raises ConfigError for a forbidden mix."""
        c = self
        if c.key_value and not c.all_tags:
            c = replace(c, all_tags=True)
        if (c.tm_stats or c.boundary or c.field_mappers) and not c.hashtags:
            c = replace(c, changeset=True)
        if c.url:
            c = replace(c, url=tuple(dict.fromkeys(c.url)))
        if clash := {*c.tags, *c.length} & {*KINDS, "poi"}:
            raise ConfigError(f"a tag named like a base counter: {sorted(clash)}")
        if c.update and (c.start or c.preset or c.read_from_metadata):
            raise ConfigError("update takes its start from the earlier result")
        if c.preset and c.start:
            raise ConfigError("give a start or a preset, not both")
        if c.rows is not None and c.rows < 1:
            raise ConfigError("rows must be positive")
        if c.start and c.end:
            if c.start == c.end:
                raise ConfigError("start and end are equal")
            if c.country and c.end - c.start < timedelta(days=1):
                raise ConfigError("country sources need a range of a day at least")
            if c.hashtags and c.end - c.start > timedelta(days=1) and not c.force:
                raise ConfigError("hashtags over more than a day need force")
        return c

    @property
    def needs_changesets(self) -> bool:
        return bool(self.hashtags or self.changeset or self.field_mappers or self.boundary)


def utc(value: str) -> datetime:
    """`YYYY-MM-DD HH:MM:SS+ZZ:ZZ` (or without zone: UTC) as an aware UTC time."""
    t = datetime.fromisoformat(value)
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
