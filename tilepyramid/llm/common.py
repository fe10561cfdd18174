"""Helpers shared by the pipeline operators: tables, the shared folder, ranks without hot tasks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, whatever folder they
    start in. On a cluster that is its shared or installed path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    That is ``spark.checkpoint.dir`` or the context's checkpoint folder. Only a purely local
    session may do without; it then uses its warehouse folder.
    """
    importable(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root


#: The folder of the innermost :func:`scratch` that is open.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables through the file system that it lies in."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder in the shared one for all that is stored inside, dropped at the end.

    Results are lazy and read what is stored: write them before the end, and elsewhere.
    """
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    outer = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(outer)
        drop_folder(spark, path)


def stored_path(spark: SparkSession, name: str) -> str:
    """A new folder for :func:`stored`; who asks for it may drop it before the others."""
    base = _scratch.get() or shared_dir(spark).rstrip("/")
    return f"{base}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that no later step runs it again.

    It stays there, as lazy results read it, unless :func:`scratch` is open.
    """
    spark = df.sparkSession
    path = path or stored_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task writes at least, where it is known beforehand how many there are at most.
TASK_ROWS = 100_000


def gathered(df: DataFrame, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """``df``, of ``rows`` rows at most, in as many tasks as they take, or as there are cores.

    What few rows are stored from has as many tasks as shuffles have partitions, and writes a file in
    each. A file costs far more than some rows; on a local disk an executor starts several processes
    for it, to set its permissions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, math.ceil(rows / per_task)))


#: Bytes in a batch of rows on its way to a Python task, where rows are long.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands its rows to Python tasks in batches of about ``BATCH_BYTES``.

    By default a batch has 64 MB, which an executor holds outside its heap, with what is made of it,
    once a task on either side; neither gives that back soon. A session that sets the bytes of a
    batch keeps its own. Results are lazy: store them inside.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None) is not None
    if not own:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(key)


def with_totals(df: DataFrame, keys: list[str], totals: list[Column], keep: str = "true",
                name: str = "totals", rows: int | None = None) -> DataFrame:
    """Rows of ``df``, at most ``rows``, with the aggregates ``totals`` of their group, of the groups
    that ``keep`` says; null keys go.

    Sums are formed in each task first. They are stored, so that the join back shuffles both of its
    sides and adaptive execution can cut the partition of a key that holds a third of all rows,
    which a window over the key could not. ``df`` is run twice: store it if it costs much.
    """
    sums = df.groupBy(*keys).agg(*totals).filter(keep)
    return df.join(stored(sums if rows is None else gathered(sums, rows), name), keys)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: executors read it without Python workers."""
    types = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [[] for _ in types]
    arrays = [pa.array(list(c), type=t.type) for c, t in zip(columns, types, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=types), schema)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return free("_" + name) if name.lower() in taken else name

    return tuple(free(n) for n in names)


def id_key(doc_id: Column) -> Column:
    """Hex key by which rows are put in a fixed, well-mixed order; null ids get the empty key."""
    return F.coalesce(F.md5(doc_id.cast("string")), F.lit(""))


def key_digits(rows: int, rows_per_part: int = 50_000) -> int:
    """Hex digits so that a group holding all rows is cut into parts of about ``rows_per_part``."""
    return max(0, math.ceil(math.log(max(rows, 1) / rows_per_part, 16)))


def ranked(df: DataFrame, groups: list[str], key: str, ties: list[Column], rank: str,
           rows: int, part_by: Column | None = None) -> DataFrame:
    """``df`` with the 0-based rank of each row within its group, by ``key`` and then ``ties``.

    ``key`` is a hex string (:func:`id_key`). Rows are numbered within (group, first digits of
    the key), and the counts of the parts before are added, so a group that holds a third of all
    rows is the work of many tasks. ``part_by`` gives other parts: not null, and never falling
    as the key rises. ``groups`` must not be null. ``rows`` is the number of rows; it sets the
    number of digits only, never the result. Rows equal in key and ties get the ranks in any
    order.
    """
    part = "_part"
    if part_by is None:
        digits = key_digits(rows)
        part_by = F.substring(key, 1, digits) if digits else F.lit("")
    df = df.withColumn(part, part_by)
    own = Window.partitionBy(*groups, part)
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(
        Window.unboundedPreceding, -1)
    before = df.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_n")).select(
        *groups, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (df.withColumn("_own", F.row_number().over(own.orderBy(key, *ties)) - 1)
            .join(before, [*groups, part])
            .withColumn(rank, F.col("_before") + F.col("_own"))
            .drop("_own", "_before", part))


def numbered(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``df`` with the 0-based place of each row in the total order ``order``.

    Rows are dealt by range into the session's number of shuffle partitions and numbered within
    each; the counts of the partitions before are added. What is dealt is stored, so that a lost
    task cannot change it. Rows equal in ``order`` are told apart by where they were read: they may
    be many, and get their places in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumn("_row", F.monotonically_increasing_id())
                   .repartitionByRange(parts, *order, "_row")
                   .withColumn("_part", F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)  # over one row per partition
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_row")) - 1
    return (dealt.withColumn("_own", own).join(F.broadcast(before), "_part")
            .withColumn(place, F.col("_before") + F.col("_own"))
            .drop("_part", "_row", "_own", "_before"))
