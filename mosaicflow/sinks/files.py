"""Files of sheets, written by the executors: each under a name of its own first, then moved to its place."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def resolved(folder: str) -> str:
    """folder as an absolute path, where it is a local one; URIs stay."""
    return folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. On one machine alone a temporary one does."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="mosaicflow-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(sheet_id, path, size) of the files written below folder/sheet_id; a task that runs again puts the same in their place.

    files may fail where it is read, as it does for rejected sheets; what was moved by then is whole. The result is the manifest, itself a table beside
    the folder, so reading it again writes no file again; a success marker is written last. A local folder is resolved to its absolute path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            paths, sizes = [], []
            for sheet, name, content in zip(*(batch.column(k).to_pylist() for k in ("sheet_id", "name", "content")), strict=True):
                path = f"{root}/{sheet}/{name}"
                folder_of = path.rpartition("/")[0]
                store.create_dir(folder_of, recursive=True)
                mine = f"{folder_of}/.{uuid.uuid4().hex}"
                with store.open_output_stream(mine, compression=None) as out:
                    out.write(content)
                store.move(mine, path)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("sheet_id"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["sheet_id", "path", "size"])

    folder = resolved(folder).rstrip("/")
    manifest = f"{folder}.manifest"
    schema = "sheet_id long, path string, size long"
    files.select("sheet_id", "name", "content").mapInArrow(run, schema).write.mode("overwrite").parquet(manifest)
    written = files.sparkSession.read.schema(schema).parquet(manifest)
    summary = written.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_SUCCESS") as out:
        out.write(f"{summary.files} {summary.bytes}\n".encode())
    return written


def write_prompts(prompts: DataFrame, folder: str) -> None:
    """Prompt payloads as JSON lines below folder/json and their texts below folder/text."""
    payload = prompts.select(F.to_json(F.struct("target", "mode", "prompt", "role", "seed", "generated_prompt"), {"ignoreNullFields": "false"}).alias("value"))
    payload.write.text(f"{folder}/json")
    prompts.select(F.col("generated_prompt").alias("value")).write.text(f"{folder}/text")


def scene_files(scenes: DataFrame) -> DataFrame:
    """FILES of scenes, of scene_id, name, base (PNG), preview (PNG or null) and collision (JSON or null): map pictures and data/collision-map.json."""
    rows = F.array(
        F.struct(F.concat(F.lit("assets/map/"), "name", F.lit("-base.png")).alias("name"), F.col("base").alias("content")),
        F.struct(F.concat(F.lit("assets/map/"), "name", F.lit("-layered-preview.png")).alias("name"), F.col("preview").alias("content")),
        F.struct(F.lit("data/collision-map.json").alias("name"), F.col("collision").cast("binary").alias("content")),
    )
    return scenes.select(F.col("scene_id").alias("sheet_id"), F.explode(rows).alias("f")).select("sheet_id", "f.*").where("content IS NOT NULL")
