"""What the operators of this subpackage share: inputs, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch may hold before Spark starts the next one.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000

#: Separators of words in the contracts: \x20 and \x09-\x0D. bytes.split() splits at exactly these.
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: their bytes, not only their rows, are bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. One of our own only where it is unset, and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="mosaicflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_uri(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and no executor's loss repeats the work before it."""
    spark, uri = df.sparkSession, fresh_uri(df.sparkSession, kind)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def discard(df: DataFrame) -> None:
    """Delete the tables that df alone was written to; for steps of a loop that the next one has replaced."""
    spark = df.sparkSession
    for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(filesystem, path) for a folder named by URI or plain path, usable on driver and executors alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply kernel to each Arrow batch. With setup, kernel gets setup()'s value, made once a task, as second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows:
                yield kernel(batch, state) if setup else kernel(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of a batch, null as empty."""
    return [x or "" for x in column.to_pylist()]


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty, without building str objects."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
