"""Shared helpers of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts. Batches hold whole texts, so that their number of rows bounds a Python worker's
#: memory; a text of a few MB still fits.
TEXT_BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name below sf_dir, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep the Arrow batches of this session at that many rows or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def light_batches(spark: SparkSession, bytes_: int = 8 << 20) -> None:
    """Keep the Arrow batches of this session at about that many bytes, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == "1b":
        spark.conf.set(key, str(bytes_))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column of that name that tells its rows apart, equal ones too, and is the same whenever it is read.

    Rows read from files are known by their file and place there; others are written to the shared folder with a number.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(name))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")
    files = sorted(r[0] for r in placed.select(f"{name}_file").distinct().collect())
    known = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"{name}_file string, {name}_base long")
    return placed.join(F.broadcast(known), f"{name}_file").withColumn(name, F.col(name) + F.col(f"{name}_base")).select(*docs.columns, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset a local session gets /tmp/checkpoints; on a cluster that is an error, as a machine's own folder
    can't be read by the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file:///tmp/checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/driftledger/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have an existing folder deleted when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there and lost executors cost no recomputation. The
    written rows go when the application ends."""
    return stored_in(new_folder(df.sparkSession, name), [df])


def stored_in(path: str, parts: Iterable[DataFrame], plain: str | None = None) -> DataFrame:
    """stored() in a given folder, of one DataFrame or of several with the same columns, each written before the next is made.
    plain: a column whose values hardly repeat, so that a dictionary would only add to it."""
    for k, df in enumerate(parts):
        spark, schema = df.sparkSession, df.schema
        df.write.options(**({f"parquet.enable.dictionary#{plain}": "false"} if plain else {})).mode("append").parquet(path)
        if not k:
            gone_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored_in() that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """In here, what a query shuffles goes from the executors' disks when that query ends, not when the driver's memory is
    collected; a DataFrame that is asked for twice is computed twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() after making sure that there is a folder for it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def arrow_mapper(
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow; make() is called once in each task and prepares what its batches share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return run


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    """The batch's texts as Python strings."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
