"""Kernels over stacks of rasters of one size against the same one by one, and what bounds a task."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from mosaicflow.operators import animation, kernels
from mosaicflow.operators import frames as fr
from mosaicflow.plans import process as pr
from mosaicflow.plans import qc
from mosaicflow.sources import png
from mosaicflow.sources import rasters as ra

PALETTE = np.array([(255, 0, 255, 255), (180, 80, 180, 255), (40, 120, 40, 255), (250, 250, 40, 90), (10, 10, 10, 255), (0, 0, 0, 0)], np.uint8)


def stack(n: int = 20, side: int = 24) -> np.ndarray:
    rng = np.random.default_rng(7)
    coarse = PALETTE[rng.integers(0, len(PALETTE), (n, side // 3, side // 3))]
    return coarse.repeat(3, axis=1).repeat(3, axis=2)


def batch(pictures: list[np.ndarray]) -> pa.RecordBatch:
    rows = [(i, x.shape[1], x.shape[0], x.tobytes()) for i, x in enumerate(pictures)]
    return fr._batch(rows, ra.RASTERS)


def test_kernels_of_stacks():
    many = stack()
    assert (kernels.remove_background(many) == [kernels.remove_background(x) for x in many]).all()
    assert (kernels.clean_ring(many, 2) == [kernels.clean_ring(x, 2) for x in many]).all()
    assert (kernels.resize(many, 17, 31) == [kernels.resize(x, 17, 31) for x in many]).all()
    assert (kernels.centred(many, 40) == [kernels.centred(x, 40) for x in many]).all()
    mask = many[..., 3] > 100
    assert (kernels.border_regions(mask) == [kernels.border_regions(x) for x in mask]).all()
    owner, found = kernels.components_of(mask, 2)
    for i, x in enumerate(mask):
        alone = kernels.components(x, 2)
        assert all((a[owner == i] == b).all() and len(a[owner == i]) == len(b) for a, b in zip(found, alone, strict=True))


def test_pictures_of_stacks():
    many = stack()
    assert png.encode_all(many) == [png.encode(x) for x in many]
    assert animation.gifs(many.reshape(5, 4, 24, 24, 4), 150) == [animation.gif(list(x), 150) for x in many.reshape(5, 4, 24, 24, 4)]
    noise = np.random.default_rng(1).integers(0, 256, (2, 1, 40, 40, 4), dtype=np.uint8)
    few_and_many = np.concatenate([noise, np.full((1, 1, 40, 40, 4), 200, np.uint8)])
    assert animation.gifs(few_and_many) == [animation.gif(list(x)) for x in few_and_many]


def test_codes_of_pictures_are_found_at_once():
    """The codes are those of each picture alone, also where tables fill and are cleared and where colours are many; pictures go through in step, not one by one."""
    rng = np.random.default_rng(2)
    for n, size, colours in ((40, 576, 9), (20, 9000, 3), (30, 5000, 200), (3, 50, 4), (20, 1, 5), (20, 0, 1)):
        pictures = rng.integers(0, colours, (n, size)).astype(np.uint8)
        codes, counts = animation.codes_of(pictures)
        alone = [animation._codes(x.tobytes()) for x in pictures]
        assert counts.tolist() == [len(x) for x in alone] and codes.tolist() == [c for x in alone for c in x]
        assert [animation._unlzw(x) for x in animation._packed(codes, counts)] == [x.tobytes() for x in pictures]


def test_pictures_are_read_at_once(monkeypatch):
    """The words are those of each alone, runs and full tables included, however they are grouped; common ones are not read code by code."""
    rng = np.random.default_rng(5)
    pictures = [np.repeat(rng.integers(0, colours, n), run).astype(np.uint8).tobytes() for n, run, colours in ((60, 9, 4), (1, 1, 2), (1, 700, 2), (400, 1, 250), (6000, 1, 200), (1000, 9, 2), (0, 1, 2))]
    bodies = [animation._lzw(x) for x in pictures]
    assert animation.unlzw_all(bodies) == pictures and animation.unlzw_all([]) == []
    files = animation.gifs(stack().reshape(5, 4, 24, 24, 4))
    alone = [animation.read_gif(x) for x in files]
    monkeypatch.setattr(animation, "_unlzw", lambda data: 1 / 0)
    for pixels in (1, 3000, 1 << 18):
        monkeypatch.setattr(animation, "READ_PIXELS", pixels)
        assert all((np.stack(a) == np.stack(b)).all() and s == t for (a, s), (b, t) in zip(animation.read_gifs(files), alone, strict=True))


def test_one_by_one_is_left_to_few_pictures(monkeypatch):
    monkeypatch.setattr(animation, "_codes", lambda index: 1 / 0)
    assert len(animation.gifs(stack().reshape(5, 4, 24, 24, 4))) == 5


def test_a_task_holds_stacks_of_bounded_bytes():
    """Of one size each, whatever comes in a batch; a raster that is larger than the bound is alone."""
    pictures = [np.full((side, side, 4), i % 256, np.uint8) for i, side in enumerate([16] * 1200 + [8] * 30 + [600, 600] + [16] * 5)]
    seen = {}
    for own, found in ra.stacks(batch(pictures)):
        assert len(found) <= ra.STACK_ROWS and (found.nbytes <= ra.STACK_BYTES or len(found) == 1)
        seen |= dict(zip(own.column("sheet_id").to_pylist(), found, strict=True))
    assert len(seen) == len(pictures) and all((seen[i] == x).all() for i, x in enumerate(pictures))
    assert max(len(found) for _, found in ra.stacks(batch(pictures), 256 * 256)) <= ra.STACK_BYTES // (4 * 256 * 256)


def test_sheets_of_mixed_sizes_in_one_batch(spark):
    """Each gives what it gives alone, in its own order of files."""
    pictures = [x[: 24 - i % 3] for i, x in enumerate(stack(12))]
    ask = pr.Request("creature", "idle", "all", cell_size=12, trim_border=1, edge_clean_depth=1, component_mode="largest")
    rows = [(i, x.shape[1], x.shape[0], bytearray(x.tobytes())) for i, x in enumerate(pictures)]
    found = pr.process(spark.createDataFrame(rows, ra.RASTERS).coalesce(1), ask).collect()
    for row in rows:
        alone = pr.process(spark.createDataFrame([row], ra.RASTERS), ask).collect() if row[0] < 3 else None
        own = [r for r in found if r.sheet_id == row[0]]
        assert [r.name for r in own] == [*pr._makers(ask), pr.PROMPT_FILE]
        assert alone is None or own == alone


def test_more_parts_are_more_tasks(spark, sf_dir, monkeypatch):
    """And not longer ones: the number of sheets in a task doesn't grow."""
    n = qc.read(spark, sf_dir, "part").count()
    monkeypatch.setattr(qc, "TASK_SHEETS", n // 40)
    assert qc.sheets(spark, sf_dir).rdd.getNumPartitions() >= 40
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(ra.BATCH_BYTES)


def test_pixels_are_counted_where_they_are_made(spark, sf_dir):
    """Cells of a sheet are counted in its task: one shuffle of keys, none of pixels or of counts."""
    from mosaicflow.plans.queries import QUERIES

    for name in ("edge_clean_ring", "grid_split_cells", "chroma_key_counts"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == 1 and "p_partkey" in plan.partition("hashpartitioning(")[2].partition(")")[0], name


def plain_resize(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """kernels.resize() by its definition, in double precision."""
    alpha = x[..., 3:].astype(np.float64)
    value = np.concatenate([np.round(x[..., :3] * alpha / 255), alpha], axis=-1)
    value = np.clip(np.round(np.einsum("ow,nhwc->nhoc", kernels._weights(x.shape[2], width), value)), 0, 255)
    value = np.clip(np.round(np.einsum("oh,nhwc->nowc", kernels._weights(x.shape[1], height), value)), 0, 255)
    a = value[..., 3:]
    rgb = np.where(a > 0, np.clip(np.round(value[..., :3] * 255 / np.maximum(a, 1)), 0, 255), 0)
    return np.concatenate([rgb, a], axis=-1).astype(np.uint8)


def test_resampling_is_that_of_double_precision():
    """Halves included, which even steps and boards of two values give."""
    board = np.indices((40, 24)).sum(axis=0) % 2 * 255
    noise = np.random.default_rng(9).integers(0, 256, (5, 40, 24, 4), dtype=np.uint8)
    for x in (np.stack([board] * 4, axis=-1)[None].astype(np.uint8), noise, noise | np.uint8([0, 0, 0, 255]), np.full((2, 40, 24, 4), 127, np.uint8)):
        for width, height in ((12, 20), (6, 10), (48, 80), (37, 61), (1, 1), (5, 200)):
            assert (kernels.resize(x, width, height) == plain_resize(x, width, height)).all()


def peak(run) -> int:
    tracemalloc.start()
    run()
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found


def test_kernels_hold_few_times_their_stack():
    many = stack(200)
    kernels.resize(many[:1], 48, 48)
    assert peak(lambda: kernels.resize(many, 48, 48)) < 16 * 200 * 48 * 48 * 4


def test_clearing_takes_any_layout():
    many = stack(6)
    part = many[:, 3:20, 5:19]
    assert (kernels.clean_ring(part) == kernels.clean_ring(part.copy())).all() and (kernels.remove_background(part) == kernels.remove_background(part.copy())).all()
    assert (kernels.remove_background(part, 0, 0)[part[..., 3] > 0] == part[part[..., 3] > 0]).all()
    assert kernels.remove_background(many[:0]).shape == (0, 24, 24, 4)


def test_pixels_of_what_is_made_of_rasters(spark):
    """In the kernel's own pass, without a text of the bytes; rasters of nothing have no pixels."""
    many = stack(3)
    rows = [(i, 24, 24, bytearray(x.tobytes())) for i, x in enumerate(many)] + [(8, 0, 0, bytearray()), (9, 1, 1, None)]
    found = ra.pixels(spark.createDataFrame(rows, ra.RASTERS), kernels.remove_background)
    clean = kernels.remove_background(many)
    assert {tuple(r) for r in found.collect()} == {(i, x, y, *clean[i, y, x].tolist()) for i in range(3) for y in range(24) for x in range(24)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "hex(" not in plan


def test_no_pixels_are_shuffled_for_accepted_sheets(spark, sf_dir, request):
    """As where keys are too many to be broadcast."""
    from mosaicflow.plans.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    execution = QUERIES["accepted_sheets"](spark, sf_dir)._jdf.queryExecution()
    plan = execution.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = re.findall(r"\(\d+\) \w*Exchange\w*.*\n(?:Output.*\n)?Input \[\d+\]: (.*)", plan)
    assert shuffled and not any("rgba" in columns for columns in shuffled)


def test_sums_of_one_picture_take_no_other_file(spark):
    """Of any shape, and the bytes of other files stay in the JVM."""
    x = stack(1)[0][:17]
    v, u = np.mgrid[:17, :24]
    files = spark.createDataFrame([(1, "a.png", bytearray(png.encode(x))), (1, "b.png", bytearray(b"none")), (2, "c.json", None)], pr.FILES)
    found = pr.weighted_sums(files, "a.png")
    assert {tuple(r) for r in found.collect()} == {(1, "a.png", int((u + 2 * v + x.astype(int) @ (1, 3, 5, 7)).sum())), (1, "b.png", None), (2, "c.json", None)}
    assert "CASE WHEN (name" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_are_made_in_the_pass_that_takes_them(spark, sf_dir):
    """A task has one Python worker, and no sheet's pixels go through the JVM between two."""
    from mosaicflow.plans.queries import QUERIES

    for name in ("labelled_frames", "shared_scale_placement", "largest_component_topk", "component_table", "frame_qc_compat", "edge_touch_frames", "sheet_metadata", "flood_fill_pixels", "process_singles"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_sheets_made_where_they_are_taken_are_the_same(spark):
    """Keys of every kind, and rasters from a table as before."""
    rows = [(key, size) for key in (*range(35), 10**12) for size in (1, 8, 15, 50)]
    part = spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1)
    made = ra.made_of_parts(part)
    for run in (fr.component_table, fr.cut):
        assert run(made, qc.SMALL).collect() == run(made.rasters(), qc.SMALL).collect()


def test_nearness_is_that_of_the_distance():
    """For every colour's distance and any threshold, whole or not, negative ones too."""
    far = np.arange(3 * 255**2 + 1)
    for threshold in (-1, 0, 0.5, 1, 100, 99.999, 150, 150.1, 2**0.5, 441.6, 442, np.nextafter(150, 0), float("inf")):
        assert ((far < kernels.reach2(threshold)) == (np.sqrt(far.astype(np.float64)) < threshold)).all(), threshold
    pixels = np.random.default_rng(3).integers(0, 256, (9, 9, 4), dtype=np.uint8)
    assert (kernels.key_distance2(pixels) == ((pixels[..., :3].astype(int) - kernels.KEY) ** 2).sum(axis=-1)).all()
