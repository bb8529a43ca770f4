"""Merging of an earlier result with a later one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.functions import columns as C

#: Text columns that hold comma lists or JSON count maps.
LISTS = ("countries", "hashtags", "editors")
MAPS = ("tags_create", "tags_modify")


def _numbers(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def merge(old: DataFrame, new: DataFrame, key: str, skip: Sequence[str] = ("rank",), counts: Sequence[str] = ()) -> DataFrame:
    """Full outer merge on `key`: numbers added, comma lists united, JSON counts added, other columns from the
    new side if it has them. A column that one side lacks counts as NULL there. Distinct counts are
    added too, so what both sides saw counts twice; `snapshot_merge` is exact. counts: further columns of JSON counts."""
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key and c not in skip]
    numbers = {*_numbers(old, (key, *skip)), *_numbers(new, (key, *skip))}
    a = old.select(key, *[F.col(c).alias(f"a_{c}") for c in names if c in old.columns])
    b = new.select(key, *[F.col(c).alias(f"b_{c}") for c in names if c in new.columns])
    both = a.join(b, key, "full_outer")

    def cell(c: str):
        x = F.col(f"a_{c}") if c in old.columns else F.lit(None).cast(new.schema[c].dataType)
        y = F.col(f"b_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        if c in numbers:
            return C.add_known(x, y)
        if c in LISTS and c not in counts:
            return C.joined_union(x, y)
        if c in MAPS or c in counts:
            return C.count_json(C.map_sum(C.counts_from_json(x), C.counts_from_json(y)))
        return F.coalesce(x, y) if c == "name" else F.coalesce(y, x)

    return both.select(key, *[cell(c).alias(c) for c in names])


def snapshot_merge(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct (key, changeset) pairs of several periods counted once each: exact distinct changesets."""
    pairs = parts[0].select(key, "changeset")
    for p in parts[1:]:
        pairs = pairs.unionByName(p.select(key, "changeset"))
    return pairs.distinct().groupBy(key).agg(F.count("changeset").alias("changesets"))
