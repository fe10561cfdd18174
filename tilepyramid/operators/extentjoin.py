"""Joins of any two sets of extents (O-J1, O-J2, O-P10), as equi-joins on the grid cells they touch.

Every extent has a level: the power of two that its longer side fits in. At its level it touches at
most two cells along an axis, so it is dealt to four cells at most, and to as many at each coarser level
that the other side has. Two extents meet at the coarser of their levels, in each cell that both touch;
the pair is reported in the one cell that holds the lower left corner of what they share. That is the
cell which, on each axis, is the first that one of the two touches, at a level that is one's own: a dealt
row carries these three marks, so that a pair is told by one bit test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.functions.extent import intersects

# Rows of each side of one cell that one task joins with each other: 25 million pairs.
PART_ROWS = 5_000
# Pairs that one task tests on average: partitions grow with the pairs.
TASK_PAIRS = 100_000_000
# Narrow rows that one task deals to cells on average.
SPREAD_ROWS = 100_000
# Marks of a dealt row: its own level, the first column and the first line that it touches.
OWN_LEVEL, FIRST_X, FIRST_Y = 4, 2, 1


def split_join(left: DataFrame, right: DataFrame, keys: list[str],
               part_rows: int = PART_ROWS) -> DataFrame:
    """Inner equi-join in which a key with more than ``part_rows`` squared pairs is cut into parts.

    Keys are counted with map-side combine. A key's ``right`` rows, which a task holds, are dealt among
    parts of about ``part_rows``, its ``left`` rows among as many as keep the pairs of a part within
    ``part_rows`` squared; each row is repeated for the parts of the other side. Work follows the pairs
    and not the bytes of the rows, so the number of partitions is left to neither size nor merging: it
    is ``spark.sql.shuffle.partitions``, or as many as keep a task at about ``TASK_PAIRS``.
    """
    n_left, n_right = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
                       for df, n in ((left, "_n_left"), (right, "_n_right")))
    held = F.least(F.col("_n_right"), F.lit(part_rows))
    counts = n_left.join(n_right, keys)
    pairs = counts.agg(F.sum(F.col("_n_left") * F.col("_n_right").cast("double"))).first()[0] or 0
    parts = counts.select(
        *keys,
        F.ceil(F.col("_n_left") * held / float(part_rows) ** 2).cast("int").alias("_left_parts"),
        F.ceil(F.col("_n_right") / part_rows).cast("int").alias("_right_parts"),
    ).filter((F.col("_left_parts") > 1) | (F.col("_right_parts") > 1))
    n = max(_shuffle_partitions(left), math.ceil(pairs / TASK_PAIRS))
    dealt = []
    for df, own, other in ((left, "left", "right"), (right, "right", "left")):
        own_parts, other_parts = (F.coalesce(f"_{side}_parts", F.lit(1)) for side in (own, other))
        rows = df.withColumn("_row", F.monotonically_increasing_id()).join(parts, keys, "left")
        rows = rows.withColumns({
            f"_{own}_part": F.pmod(F.hash("_row"), own_parts),
            f"_{other}_part": F.explode(F.sequence(F.lit(0), other_parts - 1)),
        }).drop("_row", "_left_parts", "_right_parts")
        dealt.append(rows.repartition(n, *keys, "_left_part", "_right_part").hint("merge"))
    return dealt[0].join(dealt[1], [*keys, "_left_part", "_right_part"]).drop(
        "_left_part", "_right_part")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def extent_join(left: DataFrame, right: DataFrame, left_box: str = "box",
                right_box: str = "other_box", part_rows: int = PART_ROWS) -> DataFrame:
    """All pairs of rows whose extents meet, touching included, with the columns of both.

    The sides must not share column names. A null extent meets nothing.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both sides have the columns {sorted(shared)}")
    left, right = left.filter(F.col(left_box).isNotNull()), right.filter(
        F.col(right_box).isNotNull())
    base, rows = _finest_level(left, left_box, right, right_box)
    left, right = _spread(left, rows), _spread(right, rows)
    left = left.withColumn("_left_level", _level(F.col(left_box), base))
    right = right.withColumn("_right_level", _level(F.col(right_box), base))
    # A level is an exponent of two between the finest one and that of the whole domain.
    left_levels, right_levels = (
        sorted(r[0] for r in df.select(level).distinct().collect())
        for df, level in ((left, "_left_level"), (right, "_right_level")))
    pairs = split_join(_dealt(left, left_box, "_left_level", right_levels, "_left_marks"),
                       _dealt(right, right_box, "_right_level", left_levels, "_right_marks"),
                       ["_level", "_x", "_y"], part_rows)
    first = F.col("_left_marks").bitwiseOR(F.col("_right_marks")) == OWN_LEVEL + FIRST_X + FIRST_Y
    return pairs.filter(first & intersects(F.col(left_box), F.col(right_box))).select(
        *[c for c in left.columns if c != "_left_level"],
        *[c for c in right.columns if c != "_right_level"])


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Rows of fixed width are spread before they fan out to cells and parts, so that one file of many
    extents is not one task's work; wider ones stay where they are."""
    if any(isinstance(f, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType))
           for f in _leaves(df.schema)):
        return df
    return df.repartition(max(_shuffle_partitions(df), math.ceil(rows / SPREAD_ROWS)))


def _leaves(kind: T.DataType) -> list[T.DataType]:
    if isinstance(kind, T.StructType):
        return [leaf for field in kind.fields for leaf in _leaves(field.dataType)]
    return [kind]


def _finest_level(left: DataFrame, left_box: str, right: DataFrame,
                  right_box: str) -> tuple[int, int]:
    """The level at which the domain has about as many cells as there are extents, and their number."""
    boxes = left.select(F.col(left_box).alias("b")).union(right.select(right_box))
    n, x0, x1, y0, y1 = boxes.agg(
        F.count(F.lit(1)), F.min("b.minx"), F.max("b.maxx"), F.min("b.miny"), F.max("b.maxy")).first()
    domain = max(x1 - x0, y1 - y0) if n else 0.0
    return math.ceil(math.log2(domain / math.sqrt(n))) if domain > 0 else 0, n


def _level(box: Column, base: int) -> Column:
    longer = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    own = F.when(longer > 0, F.ceil(F.log2(longer)).cast("int"))
    # The logarithm is rounded: the level is checked, and raised if the side does not fit.
    own = F.when(F.pow(F.lit(2.0), own) < longer, own + 1).otherwise(own)
    return F.greatest(F.lit(base), own)


def _dealt(df: DataFrame, box: str, level: str, others: list[int], marks: str) -> DataFrame:
    """Rows with each (``_level``, ``_x``, ``_y``) where they can meet a row of the other side, and their
    ``marks`` there."""
    met = F.array(*[F.lit(n) for n in others]).cast("array<int>")
    own = F.when(F.exists(met, lambda n: n <= F.col(level)), F.array(F.col(level))).otherwise(
        F.array().cast("array<int>"))
    df = df.withColumn("_level", F.explode(F.concat(own, F.filter(met, lambda n: n > F.col(level)))))
    side, b = F.pow(F.lit(2.0), F.col("_level")), F.col(box)
    mark = F.when(F.col("_level") == F.col(level), OWN_LEVEL).otherwise(0)
    for axis, first in (("x", FIRST_X), ("y", FIRST_Y)):
        low = F.floor(b[f"min{axis}"] / side)
        df = df.withColumn(f"_{axis}", F.explode(F.sequence(low, F.floor(b[f"max{axis}"] / side))))
        mark = mark + F.when(F.col(f"_{axis}") == low, first).otherwise(0)
    return df.withColumn(marks, mark).drop(level)
