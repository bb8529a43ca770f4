"""Readers of landed files. Gzip is decoded by Spark; a .gz file is one task, so land Parquet for what is read often."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.functions import geometry as G
from edittide.schema import CHANGESETS, ELEMENTS

_TAG = "array<struct<_k:string,_v:string>>"
_COMMON = f"_id:long,_version:int,_timestamp:timestamp,_uid:long,_user:string,_changeset:long,tag:{_TAG}"
_BLOCK = f"node array<struct<{_COMMON},_lat:double,_lon:double>>, way array<struct<{_COMMON},nd:array<struct<_ref:long>>>>, relation array<struct<{_COMMON}>>, _corrupt_record string"
#: Element names of a change file and the kinds they stand for.
_KINDS = (("node", "nodes"), ("way", "ways"), ("relation", "relations"))


def _tags(column: Column) -> Column:
    entries = F.transform(F.coalesce(column, F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"]))
    return F.map_from_entries(F.filter(entries, lambda t: t["_k"].isNotNull()))


def _xml(spark: SparkSession, paths: str | Sequence[str], row: str, schema: str, strict: bool) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if not strict:
        reader = reader.option("ignoreCorruptFiles", "true")
    return reader.schema(schema).load([paths] if isinstance(paths, str) else list(paths)).withColumn("source_file", F.col("_metadata.file_path"))


def change_files(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Elements of change files (.osc, .osc.gz) in the schema ELEMENTS.

    The block that an element lies in says whether it is deleted, so blocks are the rows that are read. Not strict:
    what cannot be read is left out; `unreadable` lists it.
    """
    parts = []
    for action in ("create", "modify", "delete"):
        blocks = _xml(spark, paths, action, _BLOCK, strict)
        # one array of all kinds, so that a block is parsed once
        e = blocks.select("source_file", F.explode(F.concat(*[F.coalesce(_alike(name, kind), F.array()) for name, kind in _KINDS])).alias("e"))
        cells = {f.name: F.col(f"e.{f.name}") for f in ELEMENTS.fields if f.name not in ("deleted", "tags", "source_file")}
        cells |= {"deleted": F.lit(action == "delete"), "tags": _tags(F.col("e.tag")), "source_file": F.col("source_file")}
        parts.append(e.select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in ELEMENTS.fields]))
    return reduce(DataFrame.unionByName, parts)


def _alike(name: str, kind: str) -> Column:
    """The elements of a kind as structs that are the same for all kinds."""

    def cells(e: Column) -> Column:
        at = [e["_lat"], e["_lon"]] if name == "node" else [F.lit(None).cast("double")] * 2
        nodes = F.transform(e["nd"], lambda n: n["_ref"]) if name == "way" else F.lit(None).cast("array<bigint>")
        own = {"id": "_id", "version": "_version", "ts": "_timestamp", "uid": "_uid", "user": "_user", "changeset": "_changeset", "tag": "tag"}
        return F.struct(F.lit(kind).alias("osm_type"), *[e[x].alias(n) for n, x in own.items()], at[0].alias("lat"), at[1].alias("lon"), nodes.alias("nds"))

    return F.transform(name, cells)


def unreadable(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source_file, record) of blocks that a lenient read leaves out."""
    out = None
    for action in ("create", "modify", "delete"):
        rows = _xml(spark, paths, action, _BLOCK, strict=False)
        # Spark refuses to read the corrupt record alone, so another column is looked at too.
        bad = rows.filter(F.col("_corrupt_record").isNotNull() & (F.coalesce(F.size("node"), F.lit(0)) >= -1)).select("source_file", F.col("_corrupt_record").alias("record"))
        out = bad if out is None else out.unionByName(bad)
    return out


def changeset_files(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Changesets of changeset files (.osm, .osm.gz) in the schema CHANGESETS; without bounds these are null."""
    schema = f"_id long, _user string, _created_at timestamp, _min_lon double, _min_lat double, _max_lon double, _max_lat double, tag {_TAG}, _corrupt_record string"
    rows = _xml(spark, paths, "changeset", schema, strict)
    return rows.select(*[(_tags(F.col("tag")) if f.name == "tags" else F.col(f"_{f.name}")).cast(f.dataType).alias(f.name) for f in CHANGESETS.fields])


def boundaries(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(name, rings) of a GeoJSON FeatureCollection of polygons and multipolygons; holes are kept."""
    text = spark.read.text(path, wholetext=True)
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    features = text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", polygon).when(F.col("f.geometry.type") == "MultiPolygon", multi)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return features.select(F.col("f.properties")[name].alias("name"), points.cast(G.RINGS_TYPE).alias("rings")).filter(F.col("rings").isNotNull())


def boundary(spark: SparkSession, text_or_path: str) -> Column:
    """Rings of one Feature, given as text or as the path of a file."""
    text = text_or_path
    if not text.lstrip().startswith("{"):
        rows = spark.read.text(text_or_path, wholetext=True).limit(2).collect()
        if len(rows) != 1:
            raise G.GeometryError("one file with one Feature is expected")
        text = rows[0]["value"]
    return G.rings_literal(G.read_feature(text))


def stats_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An earlier result in the columns of `schema`, matched by name in any order; dots of exported names (nodes.create) stand for underscores. A
    column that the file lacks is NULL, one that the schema lacks is left out; a cell that is no such value raises."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    known = {c.replace(".", "_"): c for c in rows.columns}
    cell = lambda f: F.col(f"`{known[f.name]}`") if f.name in known else F.lit(None)
    return rows.select(*[cell(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def table_csv(spark: SparkSession, path_or_url: str) -> DataFrame:
    """A finished table for the viewer, by path or address (a code host's page of a file counts as the file); types are inferred."""
    if "github.com" in path_or_url and "/blob/" in path_or_url:
        path_or_url = path_or_url.replace("github.com", "raw.githubusercontent.com").replace("/blob/", "/")
    return spark.read.csv(path_or_url, header=True, inferSchema=True, multiLine=True, escape='"')


def contributions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Landed project responses (one JSON file per project, named by its number) in the schema TM_CONTRIBUTIONS."""
    user = "struct<username:string,mappingLevel:string,mapped:long,validated:long,total:long>"
    rows = spark.read.schema(f"userContributions array<{user}>").json(paths if isinstance(paths, str) else list(paths), multiLine=True)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).alias("tm_projects"), F.explode("userContributions").alias("u"))
    return rows.select(
        F.col("u.username").alias("name"), "tm_projects", F.col("u.mappingLevel").alias("tm_mapping_level"), F.col("u.mapped").alias("tasks_mapped"), F.col("u.validated").alias("tasks_validated"), F.col("u.total").alias("tasks_total")
    )


def state_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, sequence) of landed replication state files."""
    from edittide.functions import columns as C

    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), C.state_timestamp(F.col("value")).alias("ts"), C.state_sequence(F.col("value")).alias("sequence"))
