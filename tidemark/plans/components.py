"""Connected components by rounds of neighbour minimum and pointer jumping."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` through a table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach; nodes without links are absent."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    # Written before it is turned round, so that both directions are of the same links.
    once = written(one.distinct())
    both = once.union(once.select("v", "u"))
    node = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(node.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("low"))
        # Read twice below; Spark runs its exchanges once.
        step = node.join(near, node.node == near.u, "left").select("node", F.least("component", F.coalesce("low", "component")).alias("now"), F.col("component").alias("was"))
        root = step.select(F.col("node").alias("root"), F.col("now").alias("further"))
        after = written(step.join(root, F.col("now") == F.col("root"), "left").select("node", F.least("now", F.coalesce("further", "now")).alias("component"), "was"))
        if after.where("component != was").isEmpty():
            return after.select("node", "component")
        node = after.select("node", "component")
