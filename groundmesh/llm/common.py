"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one (key, bucket) cell when rows are numbered: what one window group holds at most, about.
NUMBERING_CELL_ROWS = 2_000
#: Rows of whole texts that are worked on at a time; Spark bounds the bytes of an Arrow batch (64 MB).
TEXT_ROWS = 500
#: Cells of a key whose counts are added up in one task.
NUMBERING_RUN = 4096


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='groundmesh-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; the session's own setting is put back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it back: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/groundmesh/{tag}-{uuid.uuid4().hex}"
    with arrow_rows(spark, 2 * TEXT_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = path(file)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most TEXT_ROWS at a time: what a Python worker makes of whole texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(at, TEXT_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_within(df: DataFrame, keys: list[str], spread: Column, order: list[Column], total_rows: int, name: str) -> DataFrame:
    """Add ``name``: 0-based number of each row among the rows of its key, without gathering a key in one task.

    Rows of a key fall into buckets by the hash of ``spread``; they are numbered inside (key, bucket), and the
    bucket's offset (running sums over runs of bucket counts, and over the runs) is added. Numbers are gapless; equal rows
    get neighbouring numbers in no fixed order. Keys must not be null: the join then uses the window's own partitioning.
    """
    buckets = max(1, -(-total_rows // NUMBERING_CELL_ROWS)) * 4
    cell = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    by = [*keys, "_bucket"]
    numbered = cell.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    runs = [*keys, "_run"]
    before = lambda group, order: F.coalesce(F.sum("_rows").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cell.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_run", F.floor(F.col("_bucket") / NUMBERING_RUN))
    of_run = cells.groupBy(*runs).agg(F.sum("_rows").alias("_rows")).withColumn("_base", before(keys, "_run")).drop("_rows")
    offsets = cells.withColumn("_inside", before(runs, "_bucket")).join(of_run, runs).select(*by, (F.col("_base") + F.col("_inside")).alias("_offset"))
    return numbered.join(offsets, by).select(*df.columns, (F.col("_n") + F.col("_offset")).cast("long").alias(name))


def number_in_order(df: DataFrame, keys: list[str], cell: Column, order: list[Column], name: str, run: Column | None = None) -> DataFrame:
    """Add ``name``: 0-based place of each row among the rows of its key, by ``cell``, then by ``order`` inside the cell.

    As number_within, but cells keep the order: rows are numbered inside (key, cell), and the rows of the key's earlier
    cells are added, in two steps as there. Neither a key nor all cells are in one task. Cells are numbers, or ``run`` puts neighbouring ones together.
    """
    rows = df.withColumn("_cell", cell)
    by, runs = [*keys, "_cell"], [*keys, "_run"]
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    before = lambda group, order: F.coalesce(F.sum("_rows").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_run", F.floor(F.col("_cell") / NUMBERING_RUN) if run is None else run)
    of_run = cells.groupBy(*runs).agg(F.sum("_rows").alias("_rows")).withColumn("_base", before(keys, "_run")).drop("_rows")
    offsets = cells.withColumn("_inside", before(runs, "_cell")).join(of_run, runs).select(*by, (F.col("_base") + F.col("_inside")).alias("_offset"))
    return numbered.join(offsets, by).select(*df.columns, (F.col("_n") + F.col("_offset")).cast("long").alias(name))
