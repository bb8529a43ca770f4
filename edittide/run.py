"""A run: from options and inputs to statistics, and from these to files.

The plan follows from the options alone. Inputs are DataFrames, so landed Parquet, the readers of `sources` and tests all serve.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide import sinks
from edittide.config import ConfigError, StatsConfig
from edittide.functions import columns as C
from edittide.functions import geometry as G
from edittide.operators import changesets as CS
from edittide.operators import filters, incremental, stats, tm
from edittide.schema import COUNTERS
from edittide.sources import files, replication


@dataclass
class Inputs:
    """What a run reads: elements of all sources, changesets as read, boundaries of countries, contributions to projects, and earlier results."""

    elements: list[DataFrame]
    changesets: DataFrame | None = None
    countries: DataFrame | None = None
    contributions: DataFrame | None = None
    old_users: str | None = None
    old_days: str | None = None
    metadata: str | None = None
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


@dataclass
class Result:
    users: DataFrame
    days: DataFrame | None
    start: datetime
    end: datetime
    config: StatsConfig
    began: float


def user_schema(c: StatsConfig) -> T.StructType:
    """Columns of a users file that these options write."""
    text, number = T.StringType(), T.LongType()
    cols: dict[str, T.DataType] = {"rank": number, "uid": number, "name": text, "changesets": number, **dict.fromkeys(_counters(c), number), "map_changes": number}
    cols |= dict.fromkeys((["countries", "hashtags", "editors"] if c.needs_changesets else []) + (["tags_create", "tags_modify"] if c.all_tags else []), text)
    if c.tm_stats:
        cols |= {"tm_projects": text, "tm_mapping_level": text, "tasks_mapped": number, "tasks_validated": number, "tasks_total": number}
    return T.StructType([T.StructField(n, t) for n, t in {**cols, "start_date": text, "end_date": text}.items()])


def day_schema(c: StatsConfig) -> T.StructType:
    text, number = T.StringType(), T.LongType()
    cols = {"timestamp": text, **dict.fromkeys(["users", "changesets", *_counters(c), "map_changes"], number)}
    cols |= dict.fromkeys((["editors"] if c.needs_changesets else []) + (["tags_create", "tags_modify"] if c.all_tags else []), text)
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


def _counters(c: StatsConfig) -> list[str]:
    return [*COUNTERS, *(f"{t}_{a}" for t in ("poi", *c.tags) for a in ("create", "modify")), *(f"{t}_len_m" for t in c.length)]


def time_range(spark: SparkSession, c: StatsConfig, inputs: Inputs) -> tuple[datetime, datetime]:
    """Half-open range of a run: given, by preset, from the end of an earlier run, or up to now."""
    end = c.end or inputs.now
    if c.update:
        if not inputs.old_users:
            raise ConfigError("update needs an earlier result")
        row = files.stats_csv(spark, inputs.old_users, "end_date string").agg(F.max("end_date").alias("end_date")).first()
        if not row["end_date"]:
            raise ConfigError("the earlier result names no end")
        return _utc(row["end_date"]), end
    if c.read_from_metadata:
        return _utc(sinks.resume_point(inputs.metadata or "{}")), end
    if c.preset:
        name, _, days = c.preset.partition(":")
        return replication.preset(name, inputs.now, int(days) if days else None)
    if c.start is None:
        raise ConfigError("a run needs a start, a preset, metadata or an earlier result")
    return c.start, end


def _utc(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _maps(elements: DataFrame, by: str, c: StatsConfig) -> DataFrame:
    maps = stats.tag_maps(stats.tag_histogram(elements, by, key_value=c.key_value), by)
    return maps.select(by, *[C.count_json(F.col(f"tags_{a}")).alias(f"tags_{a}") for a in ("create", "modify")])


def calculate(spark: SparkSession, config: StatsConfig, inputs: Inputs, boundary: Column | None = None) -> Result:
    """Statistics per user, and per day if asked for, of one run; with `update` merged into the earlier result."""
    began = time.time()
    start, end = time_range(spark, config.resolved(), inputs)
    c = replace(config, start=None if config.update or config.preset or config.read_from_metadata else start, end=end).resolved()
    if start >= end:
        raise ConfigError("already up to date")
    if c.boundary and boundary is None:
        boundary = files.boundary(spark, c.boundary)
    e = inputs.elements[0]
    for other in inputs.elements[1:]:
        e = e.unionByName(other)
    if c.dedupe:
        e = e.dropDuplicates(["osm_type", "id", "version"])
    kept = flat = None
    if c.needs_changesets:
        if inputs.changesets is None:
            raise ConfigError("these options need changesets")
        flat = CS.flat(inputs.changesets).dropDuplicates(["id"])
        kept = CS.select_changesets(flat, c.hashtags, c.exact_lookup, c.field_mappers, c.users, boundary)
    if c.length:
        e = stats.way_lengths(e)
    e = filters.in_range(e, start, end)
    e = filters.selected(e, kept, c.users, filtering=bool(c.hashtags or c.field_mappers or boundary is not None or (c.users and kept is not None)))
    if kept is None:
        users = stats.user_stats(e, poi=True, tags=c.tags, lengths=c.length)
    else:
        users = stats.enriched(e, CS.describe(kept, inputs.countries), poi=True, tags=c.tags, lengths=c.length)
    if c.all_tags:
        users = users.join(_maps(e, "uid", c), "uid", "left")
    if c.tm_stats:
        if inputs.contributions is None:
            raise ConfigError("project statistics need contributions")
        users = tm.with_contributions(users, inputs.contributions)
    days = _days(e, kept, c) if c.summary else None
    if c.update:
        old = files.stats_csv(spark, inputs.old_users, user_schema(c)).drop("start_date", "end_date")
        users = incremental.merge(old, users, "uid")
        if days is not None and inputs.old_days:
            days = incremental.merge(files.stats_csv(spark, inputs.old_days, day_schema(c)), days, "timestamp", counts=("editors",))
    users = stats.ranked(users) if c.rows is None else stats.top_ranked(users, c.rows)
    return Result(users, days.orderBy("timestamp") if days is not None else None, start, end, c, began)


def _days(e: DataFrame, kept: DataFrame | None, c: StatsConfig) -> DataFrame:
    days = stats.day_summary(e, poi=True, tags=c.tags, lengths=c.length)
    if kept is not None:
        made = stats.day_editors(e, kept).groupBy(F.col("day").alias("timestamp"))
        days = days.join(made.agg(C.count_json(F.map_from_entries(F.collect_list(F.struct("editor", "n")))).alias("editors")), "timestamp", "left")
    if c.all_tags:
        days = days.join(_maps(stats.prepared(e), "day", c).withColumnRenamed("day", "timestamp"), "timestamp", "left")
    return days


def write(result: Result, folder: str, command: str = "") -> dict[str, str]:
    """Writes what the options ask for below `folder`, a path that Spark can write. Returns names and texts of the small files (summary, text
    grid, metadata), which the caller puts where they belong."""
    c, texts = result.config, {}
    start, end = (t.strftime("%Y-%m-%d %H:%M:%S+00:00") for t in (result.start, result.end))
    users = sinks.with_profile(result.users, start, end)
    for kind in c.formats:
        if kind == "csv":
            sinks.csv(users, f"{folder}/{c.name}.csv")
        elif kind == "json":
            sinks.json_lines(result.users, f"{folder}/{c.name}.json")
        elif kind == "text":
            texts[f"{c.name}.txt"] = sinks.text_grid(sinks.export_columns(result.users))
        else:
            raise ConfigError(f"format {kind} is not written")
    if result.days is not None:
        sinks.csv(result.days, f"{folder}/{c.name}_summary.csv")
        texts[f"{c.name}_summary.md"] = sinks.markdown(result.users, start, end, lists=("hashtags", "editors", "countries"), tags=c.tags, lengths=c.length)
    if c.meta:
        texts[f"{c.name}_metadata.json"] = sinks.metadata(command, ",".join(c.url), start, end)
    texts["elapsed"] = sinks.elapsed(time.time() - result.began)
    return texts
