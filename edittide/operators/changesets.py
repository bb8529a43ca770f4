"""Changeset metadata: which changesets count, and what they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edittide.functions import columns as C
from edittide.functions import geometry as G


def keep(comment: Column, created_by: Column, user: Column, hashtags: Sequence[str], exact: bool, field_mappers: bool, users: Sequence[str]) -> Column:
    """Whether a changeset counts. Asking for field editors sets the hashtags and users aside."""
    if field_mappers:
        return F.coalesce(C.from_field_editor(created_by), F.lit(False))
    out = F.lit(True)
    if hashtags:
        out = C.hashtag_in(comment, hashtags) if exact else C.comment_contains(comment, hashtags)
    if users:
        out = out & F.coalesce(user.isin(*users), F.lit(False))
    return out


def select_changesets(
    changesets: DataFrame,
    hashtags: Sequence[str] = (),
    exact: bool = False,
    field_mappers: bool = False,
    users: Sequence[str] = (),
    boundary: Column | None = None,
) -> DataFrame:
    """Changesets (id, user, comment, created_by, lon, lat) that pass the filters.

    `boundary`: an array of rings; a centroid must lie strictly inside, and one without a centroid is dropped.
    """
    df = changesets.filter(keep(F.col("comment"), F.col("created_by"), F.col("user"), hashtags, exact, field_mappers, users))
    if boundary is not None:
        df = df.filter(F.coalesce(G.point_in_rings(F.col("lon"), F.col("lat"), boundary, edges=False), F.lit(False)))
    return df


def flat(changesets: DataFrame) -> DataFrame:
    """Changesets as read (bounds and tags) with comment, created_by and the centroid as columns."""
    return changesets.select(
        "id",
        "user",
        "created_at",
        F.col("tags")["comment"].alias("comment"),
        F.col("tags")["created_by"].alias("created_by"),
        G.centroid(F.col("min_lon"), F.col("max_lon")).alias("lon"),
        G.centroid(F.col("min_lat"), F.col("max_lat")).alias("lat"),
    )


def with_countries(changesets: DataFrame, boundaries: DataFrame, cell: float = 10.0) -> DataFrame:
    """One row per changeset and boundary (name, rings) that its centroid touches, as column `country`.

    An equi-join on grid cells of `cell` degrees: each boundary is dealt to the cells that its box
    meets, each centroid to its one cell, so no side is broadcast whole and no cross product arises.
    Every boundary is matched once per centroid, since a centroid has one cell.
    """
    box = boundaries.withColumn("box", G.bounds(F.col("rings"))).filter(F.col("box.x0").isNotNull())
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    cells = box.select("name", "rings", "box", F.explode(span("box.x0", "box.x1")).alias("cx"), span("box.y0", "box.y1").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    points = changesets.withColumns({"cx": F.floor(F.col("lon") / cell).cast("int"), "cy": F.floor(F.col("lat") / cell).cast("int")})
    lon, lat = F.col("lon"), F.col("lat")
    near = points.join(cells, ["cx", "cy"]).filter(lon.between(F.col("box.x0"), F.col("box.x1")) & lat.between(F.col("box.y0"), F.col("box.y1")))
    return near.filter(G.point_in_rings(lon, lat, F.col("rings"), edges=True)).select(*changesets.columns, F.col("name").alias("country"))


def describe(changesets: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Per changeset: hashtags, editors (raw) and countries as arrays."""
    out = changesets.select("id", C.hashtags(F.col("comment")).alias("hashtags"), F.when(F.col("created_by").isNull(), F.array().cast("array<string>")).otherwise(F.array("created_by")).alias("editors"))
    if boundaries is None:
        return out
    found = with_countries(changesets.select("id", "lon", "lat"), boundaries).groupBy("id").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    return out.join(found, "id", "left").withColumn("countries", F.coalesce("countries", F.array().cast("array<string>")))
