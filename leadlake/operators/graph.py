"""Cutting lineage, and connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local master without that setting gets one of its own, which is
    removed when Python ends; a cluster without it is an error."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and set_.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leadlake-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if set_.isEmpty():
        context.setCheckpointDir(named)
    return named or set_.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, which outlives executors. Spark removes the files when nothing
    refers to them, under ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Nodes are of any ordered type. Self-loops and null ends are ignored, repeated and reversed edges count once; no
    edge gives no row. The number of rounds grows with the logarithm of the longest path; every round is two
    aggregations and two joins on the node, so a hub with millions of neighbours is aggregated on the map side first.
    """
    u, v = F.col("u"), F.col("v")
    now = durable(edges.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
