"""Raster tables derived from the given tables by formulas that SQL can repeat (FIXTURES.md)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.functions.extent import extent

BLOCK = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene per supplier; even keys are geographic, odd ones projected."""
    k = F.col("s_suppkey")
    geo = k % 2 == 0
    step = F.when(geo, F.lit(0.25)).otherwise(F.lit(27829.873))
    gt0 = F.when(geo, -170 + (k * 37) % 300 + F.lit(0.1237)).otherwise(
        -19000000 + (k * 1234567) % 34000000 + F.lit(0.37))
    gt3 = F.when(geo, 70 - (k * 23) % 110 + F.lit(0.0731)).otherwise(
        15000000 - (k * 7654321) % 28000000 + F.lit(0.41))
    zero = F.lit(0.0)
    # The quotient keeps seq unique beyond 1009 suppliers.
    seq = (k * 31) % 1009 + F.floor(k / 1009) * 1009
    return table(spark, sf_dir, "supplier").select(
        k.alias("scene_id"),
        F.concat(F.lit("scenes/s"), (k % 7).cast("string"), F.lit("/scene_"),
                 F.lpad(k.cast("string"), 6, "0"), F.lit(".tif")).alias("path"),
        seq.alias("seq"),
        F.when(geo, 4326).otherwise(3857).alias("epsg"),
        (48 + (k % 3) * 8).cast("int").alias("width"),
        (40 + (k % 4) * 8).cast("int").alias("height"),
        F.when(k % 5 == 0, 3).otherwise(1).alias("bands"),
        F.array(gt0, step, zero, gt3, zero, -step).alias("gt"),
    )


def blocks(scene_table: DataFrame) -> DataFrame:
    """Blocks of 32x32 cells; cells beyond the scene's edge are padding with arbitrary values.

    The supplier file is a single split; its rows are spread before they fan out to cells.
    """
    parts = scene_table.sparkSession.sparkContext.defaultParallelism
    df = scene_table.select("scene_id", "width", "height", "bands").repartition(parts, "scene_id")

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), F.ceil(n / F.lit(BLOCK)).cast("int") - 1)

    df = df.withColumn("band", F.explode(F.sequence(F.lit(1), F.col("bands"))))
    df = df.withColumn("block_row", F.explode(upto(F.col("height"))))
    df = df.withColumn("block_col", F.explode(upto(F.col("width"))))
    k, x0, y0 = F.col("scene_id"), F.col("block_col") * BLOCK, F.col("block_row") * BLOCK
    # Beyond an INT, a number of the same sign that is equal modulo 4096 stands for the base.
    base = k * 131 + F.col("band") * 977
    df = df.withColumns({
        "base": F.when(base.between(-(1 << 30), 1 << 30), base).otherwise(
            base % 4096 + F.signum(base).cast("long") * (1 << 29)).cast("int"),
        "factor": F.when(k % 13 == 0, 16).otherwise(1),
        "xs": F.sequence(x0, x0 + (BLOCK - 1)), "ys": F.sequence(y0, y0 + (BLOCK - 1)),
    })
    # u = (k*131 + band*977 + px*17 + py*29 + px*py) % 4096, row by row.
    u = F.flatten(F.transform("ys", lambda py: F.transform(
        "xs", lambda px: (F.col("base") + py * 29 + px * (py + 17)) % 4096)))
    return df.withColumn("u", u).select(
        "scene_id", "band", "block_row", "block_col",
        F.lit(BLOCK).alias("bw"), F.lit(BLOCK).alias("bh"),
        F.transform("u", lambda v: F.when(v % 11 == 0, 0).otherwise(v * F.col("factor")))
        .alias("cells"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular grid of a user: one extent in 3857 per customer."""
    k = F.col("c_custkey")
    west, south = -19000000 + (k * 7919 % 38000) * 1000, -19000000 + (k * 104729 % 38000) * 1000
    sides = [west, west + 20000 * (1 + k % 40), south, south + 30000 * (1 + k % 23)]
    return table(spark, sf_dir, "customer").select(
        k.alias("region_id"), extent(*[s.cast("double") for s in sides]).alias("region"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local session without one uses its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def embedding_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("scene_id"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("bands"), F.col("vec_id").alias("seq"))


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-value vector as one 8x8 block of integer cells."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("scene_id"), F.lit(1).alias("band"),
        F.lit(0).alias("block_row"), F.lit(0).alias("block_col"),
        F.lit(8).alias("bw"), F.lit(8).alias("bh"),
        F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 2000).cast("int"))
        .alias("cells"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic points from customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (-180 + (k * 7919 % 36000) / F.lit(100.0)).alias("lon"),
        (-85 + (k * 104729 % 17000) / F.lit(100.0)).alias("lat"))
