"""Raster sources: scene listing, scene table, block table and its per-cell view (O-S1..O-S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilepyramid import schemas

SCENE_GLOB = "*/*.tif"


def list_scenes(spark: SparkSession, root: str) -> DataFrame:
    """Files at ``root/<sub>/<file>.tif`` (exactly two levels, case-sensitive suffix).

    Only metadata is scanned; ``seq`` is the rank by path.
    """
    files = (
        spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{SCENE_GLOB}")
        .select("path", "length", "modificationTime")
    )
    return with_path_seq(files)


def with_path_seq(files: DataFrame) -> DataFrame:
    """Add ``seq``, the dense 0-based rank by ``path``, without a single-partition window.

    Rows are range-sorted and their partition layout is pinned by a checkpoint; a rank is then
    the row's place in its partition plus the size of the partitions before it.  Only the
    per-partition counts, one row each, meet in one task.
    """
    spark = files.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured)
    placed = files.orderBy("path").select(
        "*",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
    ).checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row per sort partition: bounded by the shuffle partition count.
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("seq", F.col("first") + F.col("place"))
        .drop("part", "place", "first")
    )


def listed_scenes(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """``scenes`` whose ``path`` is in the listing, ordered by it: its ``seq`` replaces theirs.

    Paths match where the listed one ends with the scene's, after a separator; both sides are
    keyed by the last three parts (``root/<sub>/<file>.tif``), so the join is an equality.
    """
    tail = F.substring_index(F.col("path"), "/", -3)
    ranks = files.select(tail.alias("_tail"), F.col("seq").alias("_seq"))
    return (scenes.withColumn("_tail", tail).join(ranks, "_tail")
            .withColumn("seq", F.col("_seq")).select(*scenes.columns))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene metadata table with the enforced schema."""
    return schemas.conform(spark.read.parquet(path), schemas.SCENES)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Cell block table; extra georeference columns written by :func:`write_blocks` are kept."""
    df = spark.read.parquet(path)
    base = schemas.conform(df, schemas.BLOCKS).columns
    return df.select(*base, *[c for c in df.columns if c not in base])


def block_cells(blocks: DataFrame) -> DataFrame:
    """Per-cell view: scene_id, band, px, py, value."""
    cells = blocks.select(
        "scene_id", "band", "block_row", "block_col", "bw", "bh",
        F.posexplode("cells").alias("pos", "value"),
    )
    return cells.select(
        "scene_id", "band",
        (F.col("block_col") * F.col("bw") + F.col("pos") % F.col("bw")).alias("px"),
        (F.col("block_row") * F.col("bh") + F.floor(F.col("pos") / F.col("bw")).cast("int"))
        .alias("py"),
        "value",
    )
