"""Schemas of the engine's inputs."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))

ELEMENTS = T.StructType(
    [
        T.StructField("osm_type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("uid", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("changeset", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("nds", T.ArrayType(T.LongType())),
        T.StructField("source_file", T.StringType()),
    ]
)

CHANGESETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("min_lon", T.DoubleType()),
        T.StructField("min_lat", T.DoubleType()),
        T.StructField("max_lon", T.DoubleType()),
        T.StructField("max_lat", T.DoubleType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

BOUNDARIES = T.StructType([T.StructField("name", T.StringType()), T.StructField("rings", RINGS)])

TM_CONTRIBUTIONS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("tm_projects", T.StringType()),
        T.StructField("tm_mapping_level", T.StringType()),
        T.StructField("tasks_mapped", T.LongType()),
        T.StructField("tasks_validated", T.LongType()),
        T.StructField("tasks_total", T.LongType()),
    ]
)

#: Element kinds and actions, in output order.
KINDS = ("nodes", "ways", "relations")
ACTIONS = ("create", "modify", "delete")
COUNTERS = tuple(f"{k}_{a}" for k in KINDS for a in ACTIONS)
