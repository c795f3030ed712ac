"""Pictures as a Spark data source: loose PNG files and packs, read by bytes, and packs written with a commit.

    register(spark)
    spark.read.format("mosaic").option("glob", "*.png").schema("path string, width int").load(folder)
    files.write.format("mosaic").mode("append").save(folder)        # files: sheet_id, name, content

What is read follows from the columns that are asked for: pixels are decoded only for rgba, and width and height take a file's first bytes. Filters on
path, name, size and sheet_id are pushed down, so files that they exclude are never opened.

A pack is the contents of many files one after another, with an index beside it. Tasks write packs of their own into a folder of their job, and send
back names and sums alone. Committing moves that one folder into place and then adds the job's manifest, which is what readers go by; a job
that fails leaves nothing.
"""

from __future__ import annotations

import fnmatch
import json
import operator
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sinks.files import _filesystem
from . import png

#: Bytes of a partition that is read, of a pack that is written, of a batch, and what opening a file counts for.
SPLIT_BYTES, PACK_BYTES, BATCH_BYTES, OPEN_BYTES = 64 << 20, 64 << 20, 8 << 20, 64 << 10
#: What a PNG file's size is read from.
HEADER_BYTES = 24
#: What a file in a pack counts for at least, and how many index rows are read at once.
FILE_BYTES, INDEX_ROWS = 1 << 10, 8_192
SCHEMA = "path string, sheet_id long, name string, size long, width int, height int, rgba binary"
_TYPES = {"path": pa.string(), "sheet_id": pa.int64(), "name": pa.string(), "size": pa.int64(), "width": pa.int32(), "height": pa.int32(), "content": pa.binary(), "rgba": pa.binary()}
_INDEX = pa.schema([("sheet_id", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
_TESTS: dict[type[Filter], Callable] = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    IsNotNull: lambda x, _: True, In: lambda x, values: x in values, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains,
}


@dataclass
class Entry:
    """A loose file, or a pack with the offsets of what it holds in its index."""

    place: str
    size: int
    is_pack: bool = False
    files: int = 1


@dataclass
class Split(InputPartition):
    entries: list[Entry]


@dataclass
class Packed(WriterCommitMessage):
    """(pack, files, bytes) of what a task wrote."""

    packs: list[tuple[str, int, int]]


def header(start: bytes) -> tuple[int, int]:
    """Width and height from the first bytes of a PNG file."""
    if start[:8] != b"\x89PNG\r\n\x1a\n" or start[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return struct.unpack(">II", start[16:24])


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        if unknown := set(self.names) - set(_TYPES):
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.folder, self.glob = options["path"].rstrip("/"), options.get("glob", "*.png")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, type[Filter], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "name", "size", "sheet_id"):
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def fits(self, known: dict[str, object]) -> bool:
        """Whether all filters hold, so far as their columns are known."""
        return all(known[c] is not None and _TESTS[kind](known[c], value) for c, kind, value in self.tests if c in known)

    def needs(self, size: int) -> int:
        """Bytes of a file that the asked columns take."""
        return size if {"rgba", "content"} & set(self.names) else min(size, HEADER_BYTES) if {"width", "height"} & set(self.names) else 0

    def partitions(self) -> list[Split]:
        store, root = _filesystem(self.folder)
        out, held = [Split([])], 0
        for entry in sorted(_entries(store, root, self.glob), key=lambda e: e.place):
            if not entry.is_pack and not self.fits({"path": entry.place, "name": entry.place.rpartition("/")[2], "size": entry.size, "sheet_id": None}):
                continue
            if held >= self.split:
                out.append(Split([]))
                held = 0
            out[-1].entries.append(entry)
            # Of a pack, each file's index row and first bytes count, not only the pack's own.
            held += OPEN_BYTES + max(self.needs(entry.size), entry.files * FILE_BYTES if entry.is_pack else 0)
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for known, get in self._files(partition):
            if not self.fits(known):
                continue
            needed = self.needs(known["size"])
            content = get(needed) if needed else b""
            rows.append(self._row(known, content))
            held += needed + (len(rows[-1][-1]) if self.names[-1:] == ["rgba"] else 0)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, partition: Split) -> Iterator[tuple[dict[str, object], Callable[[int], bytes]]]:
        """What is known of each file without reading it, and what reads its first bytes."""
        store, _ = _filesystem(self.folder)
        for entry in partition.entries:
            if not entry.is_pack:

                def whole(n: int, place=entry.place) -> bytes:
                    with store.open_input_file(place) as source:
                        return source.read_at(n, 0)

                yield {"path": entry.place, "name": entry.place.rpartition("/")[2], "size": entry.size, "sheet_id": None}, whole
                continue
            with store.open_input_file(f"{entry.place}.index") as index, store.open_input_file(entry.place) as source:
                for batch in pq.ParquetFile(index).iter_batches(batch_size=INDEX_ROWS):
                    for r in batch.to_pylist():
                        known = {"path": f"{entry.place}#{r['sheet_id']}/{r['name']}", "name": r["name"], "size": r["size"], "sheet_id": r["sheet_id"]}
                        yield known, lambda n, at=r["offset"]: source.read_at(n, at)

    def _row(self, known: dict[str, object], content: bytes) -> list:
        size = header(content) if {"width", "height"} & set(self.names) else (None, None)
        made = known | {"width": size[0], "height": size[1], "content": content}
        return [png.decode(content).tobytes() if n == "rgba" else made[n] for n in self.names]

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[n]) for k, n in enumerate(self.names)], names=self.names)


def _entries(store, root: str, glob: str) -> Iterator[Entry]:
    """Packs that a manifest names, or else the loose files below a folder that fit a glob."""
    from pyarrow import fs

    manifests = store.get_file_info(fs.FileSelector(f"{root}/_manifest", allow_not_found=True))
    if manifests:
        for m in manifests:
            with store.open_input_file(m.path) as source:
                job = json.loads(source.read())
            for name, files, size in job["packs"]:
                yield Entry(f"{root}/{job['folder']}/{name}", size, is_pack=True, files=files)
        return
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and fnmatch.fnmatchcase(info.base_name, glob):
            yield Entry(info.path, info.size)


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("files need name and content")
        self.folder, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.pack_bytes = int(options.get("packbytes", PACK_BYTES))

    def _staging(self, root: str) -> str:
        return f"{root}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        store, root = _filesystem(self.folder)
        store.create_dir(self._staging(root), recursive=True)
        packs, rows, out, name, size = [], [], None, "", 0

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{self._staging(root)}/{name}.index") as index:
                pq.write_table(pa.Table.from_pylist(rows, _INDEX), index)
            packs.append((name, len(rows), size))

        for batch in iterator:
            sheets = batch.column("sheet_id").to_pylist() if "sheet_id" in batch.schema.names else [None] * batch.num_rows
            for sheet, file, content in zip(sheets, batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if out is None:
                    name, rows, size = f"{uuid.uuid4().hex}.pack", [], 0
                    out = store.open_output_stream(f"{self._staging(root)}/{name}", compression=None)
                content = content or b""
                out.write(content)
                rows.append({"sheet_id": sheet, "name": file, "offset": size, "size": len(content)})
                size += len(content)
                if size >= self.pack_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        return Packed(packs)

    def commit(self, messages: list[Packed | None]) -> None:
        from pyarrow import fs

        store, root = _filesystem(self.folder)
        packs = sorted(p for m in messages if m for p in m.packs)
        store.create_dir(self._staging(root), recursive=True)
        named = {n for p, *_ in packs for n in (p, f"{p}.index")}
        for info in store.get_file_info(fs.FileSelector(self._staging(root))):
            if info.base_name not in named:  # of a task's attempt that another one replaced
                store.delete_file(info.path)
        before = [] if not self.overwrite else [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name == "_manifest" or i.base_name.startswith("data-")]
        old = [(m.path, json.loads(store.open_input_file(m.path).read())["folder"]) for path in before if path.endswith("/_manifest") for m in store.get_file_info(fs.FileSelector(path))]
        store.move(self._staging(root), f"{root}/data-{self.job}")
        store.create_dir(f"{root}/_manifest", recursive=True)
        text = json.dumps({"folder": f"data-{self.job}", "files": sum(n for _, n, _ in packs), "bytes": sum(b for *_, b in packs), "packs": packs})
        with store.open_output_stream(f"{root}/.{self.job}", compression=None) as out:
            out.write(text.encode())
        store.move(f"{root}/.{self.job}", f"{root}/_manifest/{self.job}.json")
        for manifest, folder in old:
            store.delete_file(manifest)
            store.delete_dir(f"{root}/{folder}")

    def abort(self, messages: list[Packed | None]) -> None:
        from pyarrow import fs

        store, root = _filesystem(self.folder)
        if store.get_file_info(self._staging(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(root))


class Pictures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mosaic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pictures)
