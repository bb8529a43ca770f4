"""Per-user and per-day statistics over elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.functions import columns as C
from edittide.functions import geometry as G
from edittide.schema import ACTIONS, COUNTERS, KINDS


def prepared(elements: DataFrame) -> DataFrame:
    """Elements with their action and UTC day."""
    zoned = isinstance(elements.schema["ts"].dataType, T.TimestampType)
    return elements.withColumns({"action": C.action(F.col("version"), F.col("deleted")), "day": C.day(F.col("ts"), zoned)})


def _counters() -> list[Column]:
    return [F.count_if((F.col("osm_type") == k) & (F.col("action") == a)).alias(f"{k}_{a}") for k in KINDS for a in ACTIONS]


def _poi() -> list[Column]:
    poi = C.is_poi(F.col("osm_type"), F.col("tags"), F.col("action"))
    return [F.count_if(poi & (F.col("action") == a)).alias(f"poi_{a}") for a in ("create", "modify")]


def _tag_counts(tags: Sequence[str]) -> list[Column]:
    """NULL for a group without any tagged element that was not deleted."""
    seen = F.bool_or((F.size("tags") > 0) & (F.col("action") != "delete"))
    return [F.when(seen, F.count_if(C.has_tag(F.col("tags"), t) & (F.col("action") == a))).alias(f"{t}_{a}") for t in tags for a in ("create", "modify")]


def _lengths(tags: Sequence[str], length: str) -> list[Column]:
    """Sum of metres of new ways with the tag; each way is rounded half to even first."""
    new = (F.col("osm_type") == "ways") & (F.col("action") == "create")
    return [F.coalesce(F.sum(F.when(new & C.has_tag(F.col("tags"), t), F.bround(F.col(length)).cast("bigint"))), F.lit(0)).cast("bigint").alias(f"{t}_len_m") for t in tags]


def _measures(poi: bool, tags: Sequence[str], lengths: Sequence[str], length: str) -> list[Column]:
    return [*_counters(), *(_poi() if poi else ()), *_tag_counts(tags), *_lengths(lengths, length)]


def _names(poi: bool, tags: Sequence[str], lengths: Sequence[str]) -> list[str]:
    changed = [*(["poi"] if poi else []), *tags]
    return [*COUNTERS, *(f"{t}_{a}" for t in changed for a in ("create", "modify")), *(f"{t}_len_m" for t in lengths)]


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, for plans that read them twice and must see the same partitions: in the checkpoint folder if the session has one,
    else on the executors' disks."""
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named:
        df.sparkSession.sparkContext.setCheckpointDir(named)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.DISK_ONLY)


def by_changeset(elements: DataFrame, poi: bool = False, tags: Sequence[str] = (), lengths: Sequence[str] = (), length: str = "len") -> DataFrame:
    """Counters per (uid, changeset) and the name first seen there, of which `of_users` makes statistics per user.

    Partial sums run before the shuffle, so a uid with a third of all elements is dealt over its changesets. Names are part of the first key, since
    elements are then summed by hash; a text among the sums would have all of them sorted. Of names seen at the same time the first by letters counts.
    """
    measures, sums = _measures(poi, tags, lengths, length), _names(poi, tags, lengths)
    named = prepared(elements).groupBy("uid", "changeset", "user").agg(*measures, F.min("ts").alias("at"))
    return named.groupBy("uid", "changeset").agg(*[F.sum(n).alias(n) for n in sums], F.min(F.struct("at", "user")).alias("seen"))


def of_users(fine: DataFrame) -> DataFrame:
    """One row per uid of the rows of `by_changeset`: name first seen, distinct changesets, sums of the counters."""
    names = [c for c in fine.columns if c not in ("uid", "changeset", "seen")]
    out = fine.groupBy("uid").agg(F.min("seen")["user"].alias("name"), F.count("changeset").alias("changesets"), *[F.sum(n).alias(n) for n in names])
    return out.withColumn("map_changes", C.map_changes())


def user_stats(elements: DataFrame, poi: bool = False, tags: Sequence[str] = (), lengths: Sequence[str] = (), length: str = "len") -> DataFrame:
    """One row per uid: name first seen, distinct changesets, nine counters and their sum, and what else is asked for."""
    return of_users(by_changeset(elements, poi, tags, lengths, length))


def enriched(elements: DataFrame, described: DataFrame, poi: bool = False, tags: Sequence[str] = (), lengths: Sequence[str] = (), length: str = "len") -> DataFrame:
    """`user_stats` with the `user_sets` of the users' changesets. Elements are read once: both work on the counters per changeset, which are kept."""
    fine = kept(by_changeset(elements, poi, tags, lengths, length))
    return of_users(fine).join(user_sets(fine, described), "uid", "left")


def day_summary(elements: DataFrame, poi: bool = False, tags: Sequence[str] = (), lengths: Sequence[str] = (), length: str = "len") -> DataFrame:
    """One row per UTC day: distinct users and changesets, counters and their sum.

    A day may hold a third of all rows, so rows are first summed by (day, uid, changeset) with partial
    sums before the shuffle, and the two distinct counts work on that.
    """
    e = prepared(elements)
    measures, names = _measures(poi, tags, lengths, length), _names(poi, tags, lengths)
    fine = e.groupBy("day", "uid", "changeset").agg(*measures)
    out = fine.groupBy("day").agg(F.count_distinct("uid").alias("users"), F.count_distinct("changeset").alias("changesets"), *[F.sum(n).alias(n) for n in names])
    return out.withColumnRenamed("day", "timestamp").withColumn("map_changes", C.map_changes())


def ranked(df: DataFrame, by: str = "map_changes", tie: str = "uid") -> DataFrame:
    """Rank 1..n without ties, largest first, `tie` ascending among equals.

    No task sees all rows: a range sort, row numbers in each partition, and the number of rows in the partitions before.
    """
    order = F.desc(by), F.asc(tie)
    spread = kept(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    inside = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return inside.join(F.broadcast(sizes), "_p").withColumn("rank", (F.col("_n") + F.col("_b")).cast("bigint")).drop("_p", "_n", "_b")


def top_ranked(df: DataFrame, k: int, by: str = "map_changes", tie: str = "uid") -> DataFrame:
    """The k first rows of `ranked`, found before they are numbered."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.asc(tie))).cast("bigint"))


def tag_histogram(elements: DataFrame, by: str, key_value: bool = False) -> DataFrame:
    """Rows (by, action, tag, n): how often a key, and with `key_value` also key=value, was created or modified."""
    e = prepared(elements).filter(F.col("action") != "delete")
    entries = F.explode(F.map_entries("tags"))
    rows = e.select(by, "action", entries.alias("t"))
    label = F.explode(F.array(F.col("t.key"), F.concat_ws("=", F.col("t.key"), F.col("t.value")))) if key_value else F.col("t.key")
    return rows.select(by, "action", label.alias("tag")).groupBy(by, "action", "tag").agg(F.count("*").alias("n"))


def tag_maps(histogram: DataFrame, by: str) -> DataFrame:
    """The histogram as one row per group with maps tags_create and tags_modify."""
    pick = lambda a: F.map_from_entries(F.collect_list(F.when(F.col("action") == a, F.struct("tag", "n")))).alias(f"tags_{a}")
    return histogram.groupBy(by).agg(pick("create"), pick("modify"))


def way_lengths(elements: DataFrame, radius: float = G.EARTH_RADIUS) -> DataFrame:
    """Elements with `len`: metres of each new way whose nodes are all in its own file, else 0.

    Only new ways are shuffled: dealt by (file, node), joined with the nodes' last location in that file, and put together again by file, id
    and nodes, so ways that repeat are one there.
    """
    new = (F.col("osm_type") == "ways") & (F.col("version") == 1) & ~F.col("deleted") & (F.size("nds") > 1)
    new = F.coalesce(new, F.lit(False))
    key = ["source_file", "id", "_h"]
    nodes = elements.filter(F.col("osm_type") == "nodes").groupBy("source_file", F.col("id").alias("node")).agg(F.max_by(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct("version", "ts")).alias("at"))
    ways = elements.filter(new).withColumn("_h", F.xxhash64("nds"))
    refs = ways.select(*key, F.posexplode("nds").alias("pos", "node")).distinct()
    placed = refs.join(nodes, ["source_file", "node"], "left").groupBy(*key)
    whole = placed.agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("p"), F.bool_and(F.col("at.x").isNotNull() & F.col("at.y").isNotNull()).alias("whole"))
    lengths = whole.select(*key, F.when(F.col("whole"), G.path_length(F.transform("p", lambda v: v["at"]), radius)).otherwise(F.lit(0.0)).alias("len"))
    measured = ways.join(lengths, key, "left").withColumn("len", F.coalesce("len", F.lit(0.0))).drop("_h")
    return elements.filter(~new).withColumn("len", F.lit(0.0)).unionByName(measured)


def user_sets(elements: DataFrame, described: DataFrame) -> DataFrame:
    """Per uid the sorted distinct hashtags, editors and (if there) countries of its changesets, as comma lists.

    Works on distinct (uid, changeset) pairs, so the counters are not multiplied by the arrays.
    """
    names = [c for c in ("countries", "hashtags", "editors") if c in described.columns]
    described = described.select("id", *names)
    pairs = elements.select("uid", "changeset").distinct().join(described.withColumnRenamed("id", "changeset"), "changeset")

    def labelled(c: str) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(c).alias("kind"), v.alias("item")))

    items = pairs.select("uid", F.explode(F.concat(*[labelled(c) for c in names])).alias("v")).select("uid", "v.kind", "v.item").distinct()
    lists = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("item")))), ",").alias(c) for c in names]
    return items.groupBy("uid").agg(*lists)


def day_editors(elements: DataFrame, changesets: DataFrame) -> DataFrame:
    """Rows (day, editor, n): elements per day by their changeset's normalised editor.

    Elements are counted by (day, changeset) before the join.
    """
    counts = prepared(elements).groupBy("day", "changeset").agg(F.count("*").alias("c"))
    made = changesets.filter(F.col("created_by").isNotNull()).select(F.col("id").alias("changeset"), C.editor(F.col("created_by")).alias("editor"))
    return counts.join(made, "changeset").groupBy("day", "editor").agg(F.sum("c").alias("n"))
