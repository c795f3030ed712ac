"""Steps of a job as written tables in the folder that driver and executors share: lineage ends there, and no lost executor repeats what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .files import shared_folder


def written(df: DataFrame, kind: str) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/{kind}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the tables that df alone was read from: steps of a loop that the next one has replaced."""
    spark = df.sparkSession
    for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
