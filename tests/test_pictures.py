import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicflow.sources import pictures, png


def picture(i):
    x = np.full((i % 5 + 1, i % 7 + 1, 4), i, np.uint8)
    x[0, 0] = (1, 2, 3, i)
    return x


@pytest.fixture
def mosaic(spark):
    pictures.register(spark)
    return spark


@pytest.fixture
def loose(tmp_path):
    for i in range(30):
        (tmp_path / str(i % 3)).mkdir(exist_ok=True)
        (tmp_path / str(i % 3) / f"p{i}.png").write_bytes(png.encode(picture(i)))
    (tmp_path / "0" / "other.txt").write_text("no picture")
    return tmp_path


def test_loose_files(mosaic, loose):
    got = mosaic.read.format("mosaic").load(str(loose))
    assert got.columns == ["path", "sheet_id", "name", "size", "width", "height", "rgba"]
    rows = {r.name: r for r in got.collect()}
    assert len(rows) == 30 and all((rows[f"p{i}.png"].width, rows[f"p{i}.png"].height, bytes(rows[f"p{i}.png"].rgba)) == (i % 7 + 1, i % 5 + 1, picture(i).tobytes()) for i in range(30))
    assert mosaic.read.format("mosaic").option("glob", "p1*.png").load(str(loose)).count() == 11


def test_pixels_are_read_only_where_asked_for(mosaic, loose):
    """A file whose pixels are broken can be counted and measured, but not decoded; one that isn't a picture at all can be listed."""
    data = (loose / "0" / "p0.png").read_bytes()
    (loose / "0" / "p0.png").write_bytes(data[:40] + b"\xff" * 20)
    (loose / "0" / "p99.png").write_bytes(b"nothing")
    read = mosaic.read.format("mosaic")
    assert read.schema("name string, size long").load(str(loose)).count() == 31
    sized = read.schema("name string, width int").load(str(loose)).where("name <> 'p99.png' AND startswith(name, 'p')")
    with pytest.raises(Exception, match="no PNG"):
        sized.collect()  # an inequality isn't pushed down
    assert read.schema("name string, width int").load(str(loose)).where("name IN ('p0.png', 'p1.png')").count() == 2
    with pytest.raises(Exception, match="Python worker"):
        read.schema("name string, rgba binary").load(str(loose)).where("name = 'p0.png'").collect()


def test_filters_are_pushed_down(mosaic, loose):
    df = mosaic.read.format("mosaic").load(str(loose)).where("name = 'p4.png' AND size > 10 AND width = 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "name#" not in plan.partition("BatchScan")[0].partition("Filter")[2]
    reader = pictures.Reader(mosaic.read.format("mosaic").load(str(loose)).schema, {"path": str(loose)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("name",), "p4.png"), GreaterThan(("width",), 1)])) == [GreaterThan(("width",), 1)]
    assert [e.place.rpartition("/")[2] for s in reader.partitions() for e in s.entries] == ["p4.png"]


def test_bytes_that_are_read(mosaic, loose, monkeypatch):
    """By columns: nothing of a file, its first bytes, or all of it."""
    monkeypatch.setattr(pictures, "OPEN_BYTES", 0)
    total = sum(p.stat().st_size for p in loose.rglob("*.png"))
    for columns, expected in (("path string", 0), ("width int", 30 * pictures.HEADER_BYTES), ("rgba binary", total)):
        reader, read = pictures.Reader(mosaic.createDataFrame([], columns).schema, {"path": str(loose)}), []
        files = pictures.Reader._files

        def counted(self, partition, read=read, files=files):
            for known, get in files(self, partition):
                yield known, lambda n, get=get: read.append(data := get(n)) or data

        monkeypatch.setattr(pictures.Reader, "_files", counted)
        rows = sum(b.num_rows for s in reader.partitions() for b in reader.read(s))
        monkeypatch.setattr(pictures.Reader, "_files", files)
        assert rows == 30 and sum(map(len, read)) == expected


def test_partitions_by_bytes(mosaic, loose):
    total = sum(p.stat().st_size for p in loose.rglob("*.png"))
    splits = lambda columns, n: len(pictures.Reader(mosaic.createDataFrame([], columns).schema, {"path": str(loose), "splitbytes": str(n)}).partitions())
    assert splits("rgba binary", 1 << 40) == 1 and splits("rgba binary", 1) == 30 and splits("rgba binary", 5 * pictures.OPEN_BYTES + total // 6) in (5, 6, 7)


def files(spark, n, parts=4):
    rows = [(i, f"f{i % 4}.png", bytearray(png.encode(picture(i)))) for i in range(n)]
    return spark.createDataFrame(rows, "sheet_id long, name string, content binary").repartition(parts, "sheet_id")


def test_packs(mosaic, tmp_path):
    """Written twice, read whole, by filter and by header, then written over."""
    folder = str(tmp_path / "out")
    files(mosaic, 40).write.format("mosaic").option("packBytes", 300).mode("append").save(folder)
    assert len(list(tmp_path.rglob("*.pack"))) > 4
    got = mosaic.read.format("mosaic").load(folder)
    assert {r.sheet_id: bytes(r.rgba) for r in got.collect()} == {i: picture(i).tobytes() for i in range(40)}
    assert got.where("sheet_id < 5 AND name = 'f1.png'").count() == 1
    files(mosaic, 7).write.format("mosaic").mode("append").save(folder)
    sizes = mosaic.read.format("mosaic").schema("sheet_id long, width int, size long").load(folder)
    assert sizes.count() == 47 and sizes.agg(F.sum("width")).first()[0] == sum(i % 7 + 1 for i in (*range(40), *range(7)))
    files(mosaic, 3).write.format("mosaic").mode("overwrite").save(folder)
    assert mosaic.read.format("mosaic").load(folder).count() == 3
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "out").iterdir()) == ["_manifest", "data"]


def test_failed_job_leaves_nothing(mosaic, tmp_path):
    folder = tmp_path / "out"
    files(mosaic, 5).write.format("mosaic").mode("append").save(str(folder))
    before = sorted(p.relative_to(folder) for p in folder.rglob("*"))
    bad = files(mosaic, 40).withColumn("name", F.when(F.col("sheet_id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("mosaic").mode("append").save(str(folder))
    assert sorted(p.relative_to(folder) for p in folder.rglob("*")) == before
    assert mosaic.read.format("mosaic").load(str(folder)).count() == 5


def test_attempts_that_were_replaced_are_removed(mosaic, tmp_path):
    """A task that ran twice: only what its message names is kept."""
    schema = files(mosaic, 1).schema
    writer = pictures.Writer(schema, {"path": str(tmp_path)}, False)
    batch = files(mosaic, 6).toArrow().to_batches()
    first, second = writer.write(iter(batch)), writer.write(iter(batch))
    writer.commit([second, None])
    assert len(list(tmp_path.rglob("*.pack"))) == 1 and first.packs[0][0] not in {p.name for p in tmp_path.rglob("*")}
    assert mosaic.read.format("mosaic").load(str(tmp_path)).count() == 6


def test_what_cannot_be_written_or_read(mosaic, tmp_path):
    with pytest.raises(Exception, match="name and content"):
        mosaic.range(3).write.format("mosaic").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="no such columns"):
        mosaic.read.format("mosaic").schema("colour string").load(str(tmp_path)).count()
    mosaic.createDataFrame([], "sheet_id long, name string, content binary").write.format("mosaic").mode("append").save(str(tmp_path / "e"))
    assert mosaic.read.format("mosaic").load(str(tmp_path / "e")).count() == 0


def test_headers_of_many_packed_files_are_many_splits(tmp_path):
    """Packs are few bytes to open, but a task reads the start of each file in them."""
    import json

    from pyspark.sql.types import IntegerType, StructField, StructType

    from mosaicflow.sources import pictures

    (tmp_path / "_manifest").mkdir()
    packs = [(f"{i}.pack", 40_000, 12_000_000) for i in range(10)]
    (tmp_path / "_manifest" / "a.json").write_text(json.dumps({"folder": "data-a", "packs": packs}))
    reader = pictures.Reader(StructType([StructField("width", IntegerType())]), {"path": str(tmp_path)})
    assert max(sum(e.files for e in s.entries) for s in reader.partitions()) <= 80_000
