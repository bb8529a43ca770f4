"""Contributions to mapping projects, joined to user statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edittide.functions import columns as C
from edittide.operators import stats

_COUNTS = ("tasks_mapped", "tasks_validated", "tasks_total")


def project_ids(users: DataFrame, column: str = "hashtags") -> DataFrame:
    """Distinct project numbers named by the users' hashtags: (project)."""
    return users.select(F.explode(C.project_ids(F.col(column))).alias("project")).distinct()


def of_users(contributions: DataFrame, users: DataFrame) -> DataFrame:
    return contributions.join(users.select("name"), "name", "left_semi")


def rollup(contributions: DataFrame) -> DataFrame:
    """Per name and project: first level, sums of tasks."""
    return contributions.groupBy("name", "tm_projects").agg(F.min("tm_mapping_level").alias("tm_mapping_level"), *[F.sum(c).alias(c) for c in _COUNTS])


def with_contributions(users: DataFrame, contributions: DataFrame, hashtags: str = "hashtags") -> DataFrame:
    """Users with their tasks over the projects that their hashtags name; 0 and NULL without any.

    Matching is by name, so users of one name share what that name has. Users are read twice, so they are kept as they are.
    """
    users = stats.kept(users)
    asked = users.select("name", F.explode(C.project_ids(F.col(hashtags))).alias("tm_projects")).distinct()
    per_name = asked.join(rollup(contributions), ["name", "tm_projects"], "left").groupBy("name")
    mine = per_name.agg(
        F.array_join(F.array_sort(F.collect_set("tm_projects")), ",").alias("tm_projects"),
        F.min("tm_mapping_level").alias("tm_mapping_level"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
    )
    out = users.join(mine, "name", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in _COUNTS})
