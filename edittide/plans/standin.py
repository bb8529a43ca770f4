"""The engine's inputs, laid over the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """lineitem as elements; order and customer give changeset and user, part (only with `tags`) the tags."""
    line = table(spark, sf_dir, "lineitem")
    df = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.create_map().cast("map<string,string>")
    if tags:
        df = df.join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        some = F.create_map(F.lower("p_type"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
        none = F.when(F.col("p_size") % 3 != 0, some).otherwise(none)
    return df.select(
        F.when(F.col("l_returnflag") == "N", "nodes").when(F.col("l_returnflag") == "A", "ways").otherwise("relations").alias("osm_type"),
        F.col("l_linenumber").alias("version"),
        (F.col("l_linenumber") == 7).alias("deleted"),
        F.col("l_orderkey").alias("changeset"),
        F.col("l_shipdate").alias("ts"),
        F.col("o_custkey").alias("uid"),
        F.col("c_name").alias("user"),
        F.col("l_extendedprice").alias("len"),
        none.alias("tags"),
    )


def changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("id"),
            F.col("c_name").alias("user"),
            F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("#"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit(" #hotosm-project-"), (key % 50).cast("string")).alias("comment"),
            F.concat(F.lower("c_mktsegment"), F.lit(" 1."), (key % 9).cast("string")).alias("created_by"),
            ((key % 360) - 179.5).cast("double").alias("lon"),
            ((key % 170) - 84.5).cast("double").alias("lat"),
        )
    )


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box 72 degrees wide for each region."""
    x0 = F.col("r_regionkey") * 72.0 - 180.0
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(x0, -90.0), corner(x0 + 72.0, -90.0), corner(x0 + 72.0, 90.0), corner(x0, 90.0), corner(x0, -90.0))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.array(ring).alias("rings"))


def ways_and_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes and customers as ways through their orders; a fifth of the ways is modified, and an eleventh names a node that is nowhere."""
    nodes = changesets(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_name").alias("user"), F.col("c_custkey").alias("cust")), "user")
    file, none = F.concat(F.lit("f"), (F.col("cust") % 7).cast("string")).alias("source_file"), F.lit(None)
    points = nodes.select(F.lit("nodes").alias("osm_type"), "id", F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.col("created_at").alias("ts"), "lat", "lon", none.cast("array<bigint>").alias("nds"), file)
    key = F.col("c_custkey")
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("all"))
    ways = table(spark, sf_dir, "customer").join(made, key == F.col("o_custkey"), "left").withColumn("cust", key)
    missing = F.when(key % 11 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    lines = ways.select(F.lit("ways").alias("osm_type"), key.alias("id"), F.when(key % 5 == 0, 2).otherwise(1).alias("version"), F.lit(False).alias("deleted"), none.cast("timestamp_ntz").alias("ts"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.concat("all", missing).alias("nds"), file)
    return points.unionByName(lines)


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = F.when(F.col("c_acctbal") > 5000, "ADVANCED").otherwise("BEGINNER")
    done = F.count_if(F.col("o_orderstatus") == "F")
    return orders.groupBy(F.col("c_name").alias("name"), (F.col("o_orderkey") % 50).cast("string").alias("tm_projects"), level.alias("tm_mapping_level")).agg(
        F.count("*").alias("tasks_mapped"), done.alias("tasks_validated"), (F.count("*") + done).alias("tasks_total")
    )


#: The same views for DuckDB.
SQL = """
elements AS (
  SELECT CASE l_returnflag WHEN 'N' THEN 'nodes' WHEN 'A' THEN 'ways' ELSE 'relations' END AS osm_type,
         CASE WHEN l_linenumber = 7 THEN 'delete' WHEN l_linenumber = 1 THEN 'create' WHEN l_linenumber > 1 THEN 'modify' ELSE 'delete' END AS action,
         l_orderkey AS changeset, l_shipdate AS ts, strftime(l_shipdate, '%Y-%m-%d') AS day, o_custkey AS uid, c_name AS name,
         l_extendedprice AS len, lower(p_type) AS kind, p_brand AS brand, p_size AS psize, p_size % 3 <> 0 AS tagged
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
changesets AS (
  SELECT o_orderkey AS id, c_name AS name, o_orderdate AS created_at, o_custkey AS uid,
         '#' || replace(o_orderpriority, ' ', '_') AS tag1, '#hotosm-project-' || (o_orderkey % 50) AS tag2,
         '#' || replace(o_orderpriority, ' ', '_') || ' #hotosm-project-' || (o_orderkey % 50) AS comment,
         lower(c_mktsegment) || ' 1.' || (o_orderkey % 9) AS created_by, lower(c_mktsegment) AS editor,
         CAST((o_orderkey % 360) - 179.5 AS DOUBLE) AS lon, CAST((o_orderkey % 170) - 84.5 AS DOUBLE) AS lat
  FROM orders JOIN customer ON o_custkey = c_custkey),
boundaries AS (SELECT r_name AS country, r_regionkey * 72.0 - 180.0 AS x0, r_regionkey * 72.0 - 108.0 AS x1 FROM region),
contributions AS (
  SELECT c_name AS name, CAST(o_orderkey % 50 AS VARCHAR) AS tm_projects, CASE WHEN c_acctbal > 5000 THEN 'ADVANCED' ELSE 'BEGINNER' END AS tm_mapping_level,
         count(*) AS tasks_mapped, count(*) FILTER (o_orderstatus = 'F') AS tasks_validated, count(*) + count(*) FILTER (o_orderstatus = 'F') AS tasks_total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""
