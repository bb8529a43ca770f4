"""Reports over finished statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edittide.functions import columns as C
from edittide.schema import COUNTERS


def top(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k largest rows, ties by the second column."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def totals(users: DataFrame) -> DataFrame:
    """One row over all users: their number, changesets, changes, and elements by action."""
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return users.agg(
        F.count("*").alias("users"),
        summed("changesets").alias("changesets"),
        summed("map_changes").alias("map_changes"),
        *[summed(C.of_action(a)).alias(n) for a, n in (("create", "created"), ("modify", "modified"), ("delete", "deleted"))],
    )


def kind_totals(users: DataFrame) -> DataFrame:
    """One row with each of the nine counters over all users."""
    return users.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def by_action(users: DataFrame) -> DataFrame:
    """Users with their created, modified and deleted elements."""
    return users.withColumns({n: C.of_action(a) for a, n in (("create", "created"), ("modify", "modified"), ("delete", "deleted"))})


def items(df: DataFrame, column: str, blanks: bool = False) -> DataFrame:
    """One row per entry of a comma list, as column `item`; blank entries only if asked for."""
    out = df.withColumn("item", F.explode(F.split(F.col(column), ",")))
    return out if blanks else out.filter(F.trim("item") != "")


def users_per(users: DataFrame, column: str, k: int, blanks: bool = False, item: Column | None = None) -> DataFrame:
    """The k entries of a comma list that most distinct users have: (item, users)."""
    rows = items(users, column, blanks)
    if item is not None:
        rows = rows.withColumn("item", item)
    return top(rows.select("item", "name").distinct().groupBy("item").agg(F.count("*").alias("users")), k, "users", "item")


#: Parts that labels are dealt in before the largest are numbered.
PARTS = 64


def shares(df: DataFrame, k: int, label: str, value: str, rest: str = "Others") -> DataFrame:
    """The k largest labels, all others as one, with percentages of the whole: (label, value, percent).

    Labels compete in PARTS parts by hash; the losers of a part are one row at once, so the last window has a bounded number of rows.
    """
    order = F.desc(value), F.asc(label)
    parts = df.withColumn("_p", F.pmod(F.xxhash64(label), F.lit(PARTS)))
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    small = F.col("_n") > k
    few = parts.groupBy(F.when(small, F.lit(None)).otherwise(F.col(label)).alias(label), small.alias("_s")).agg(F.sum(value).alias(value))
    kept = few.withColumn("_n", F.row_number().over(Window.orderBy("_s", *order)))
    merged = kept.groupBy(F.when(~F.col("_s") & (F.col("_n") <= k), F.col(label)).otherwise(F.lit(rest)).alias(label)).agg(F.sum(value).alias(value))
    return merged.withColumn("percent", F.round(100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()), 6))


def trending(users: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent entries of a comma list, blanks left out: (item, n)."""
    return top(items(users, column).groupBy("item").agg(F.count("*").alias("n")), k, "n", "item")


def sum_maps(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """JSON count maps of all rows added up: (tag, n), the k largest if k is given."""
    rows = df.select(F.explode(C.counts_from_json(F.col(column))).alias("tag", "c"))
    out = rows.groupBy("tag").agg(F.sum("c").alias("n"))
    return out if k is None else top(out, k, "n", "tag")


def has_any(df: DataFrame, column: str) -> DataFrame:
    """One row: whether any cell of the column holds text."""
    return df.agg(F.coalesce(F.bool_or(F.coalesce(F.col(column).cast("string"), F.lit("")) != ""), F.lit(False)).alias("any"))
