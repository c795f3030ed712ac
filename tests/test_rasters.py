import json
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hn

from mosaicflow.operators import animation, kernels
from mosaicflow.operators import frames as fr
from mosaicflow.operators.frames import Params
from mosaicflow.plans import process as pr
from mosaicflow.sinks.files import write_files
from mosaicflow.sources import png
from mosaicflow.sources import rasters as ra

MASKS = hn.arrays(bool, hn.array_shapes(min_dims=2, max_dims=2, max_side=12))
PICTURES = hn.arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9), st.just(4)))


def flood(mask, diagonal):
    """Regions by plain search, in reading order: lists of (y, x)."""
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        queue, own = deque([(y, x)]), []
        seen.add((y, x))
        while queue:
            i, j = queue.popleft()
            own.append((i, j))
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    k = (i + di, j + dj)
                    if (diagonal or not (di and dj)) and 0 <= k[0] < mask.shape[0] and 0 <= k[1] < mask.shape[1] and mask[k] and k not in seen:
                        seen.add(k)
                        queue.append(k)
        out.append(own)
    return out


@settings(max_examples=150, deadline=None)
@given(MASKS)
def test_components(mask):
    got = kernels.components(mask)
    expected = sorted(flood(mask, False), key=lambda r: -len(r))
    assert got.area.tolist() == [len(r) for r in expected]
    assert got.first[:, ::-1].tolist() == [list(r[0]) for r in expected]
    for box, edge, region in zip(got.box.tolist(), got.touches_edge, expected, strict=True):
        y, x = zip(*region, strict=True)
        assert box == [min(x), min(y), max(x) + 1, max(y) + 1]
        assert edge == (min(x) == 0 or min(y) == 0 or max(x) + 1 == mask.shape[1] or max(y) + 1 == mask.shape[0])
    assert got.area.sum() == mask.sum()


@settings(max_examples=150, deadline=None)
@given(MASKS)
def test_border_regions(mask):
    h, w = mask.shape
    expected = np.zeros_like(mask)
    for region in flood(mask, True):
        if any(y in (0, h - 1) or x in (0, w - 1) for y, x in region):
            expected[tuple(zip(*region, strict=True))] = True
    assert (kernels.border_regions(mask) == expected).all()


@settings(max_examples=60, deadline=None)
@given(PICTURES)
def test_background_removal_is_idempotent(picture):
    once = kernels.remove_background(picture)
    assert (kernels.remove_background(once) == once).all()
    kept = once[..., 3] > 0
    assert (once[kept] == picture[kept]).all()


@settings(max_examples=60, deadline=None)
@given(PICTURES)
def test_png_round_trip(picture):
    assert (png.decode(png.encode(picture)) == picture).all()


def test_thresholds_are_strict_and_interior_survives():
    picture = np.full((9, 9, 4), (255, 0, 255, 255), np.uint8)
    picture[2:7, 2:7] = (40, 120, 40, 255)
    picture[4, 4] = (180, 80, 180, 255)  # between the thresholds, inside
    picture[0, 0] = (155, 0, 255, 255)  # at a distance of exactly 100, on the border
    picture[1, 1] = (180, 80, 180, 255)
    out = kernels.remove_background(picture)
    assert out[4, 4, 3] == 255 and out[1, 1, 3] == 0 and out[0, 0, 3] == 0
    assert kernels.remove_background(picture, threshold=0, edge_threshold=0)[..., 3].all()


def test_ring_and_trim():
    picture = np.full((12, 12, 4), 200, np.uint8)
    picture[0, 5] = (10, 39, 0, 255)
    picture[5, 5] = (0, 0, 0, 255)
    picture[6, 0] = (10, 40, 0, 255)
    out = kernels.clean_ring(picture, 3)
    assert out[0, 5, 3] == 0 and out[5, 5, 3] == 255 and out[6, 0, 3] == 255
    assert kernels.trim(picture, 4).shape == (4, 4, 4) and kernels.trim(picture, 6).shape == (12, 12, 4) and kernels.trim(picture, 0).shape == (12, 12, 4)


def test_resize_by_geometry():
    flat = np.full((10, 20, 4), (10, 200, 30, 255), np.uint8)
    assert (kernels.resize(flat, 7, 33) == (10, 200, 30, 255)).all()
    half = flat.copy()
    half[:, :10] = 0
    out = kernels.resize(half, 40, 10)
    box = kernels.visible_box(out)
    assert out.shape == (10, 40, 4) and abs(box[0] - 20) <= 6 and box[2] == 40
    assert (kernels.resize(flat, 20, 10) == flat).all()


def test_paste_clips_and_blends():
    canvas = np.zeros((4, 4, 4), np.uint8)
    kernels.paste(canvas, np.full((3, 3, 4), 100, np.uint8), -1, -1)
    assert (canvas[..., 3] == 100).sum() == 4
    blend = np.zeros((1, 1, 4), np.uint8)
    kernels.paste(blend, np.full((1, 1, 4), (200, 100, 0, 128), np.uint8), 0, 0, masked=True)
    assert blend[0, 0].tolist() == [100, 50, 0, 64]
    kernels.paste(blend, np.full((1, 1, 4), 9, np.uint8), 5, 5)


@settings(max_examples=20, deadline=None)
@given(hn.arrays(np.uint8, st.tuples(st.just(3), st.integers(1, 40), st.integers(1, 40), st.just(1)), elements=st.integers(0, 3)))
def test_gif_round_trip(values):
    """With something transparent; else the colour nearest to the transparent one is taken for it, as the test below has it."""
    values[0, 0, 0] = 0
    frames = [np.concatenate([v * 60, v * 10, v * 80, np.where(v > 0, 255, 0)], axis=-1).astype(np.uint8) for v in values]
    back, duration = animation.read_gif(animation.gif(frames, 150))
    assert duration == 150 and len(back) == 3
    for a, b in zip(frames, back, strict=True):
        assert (np.where(a[..., 3:] > 0, a, 0) == np.where(b[..., 3:] > 0, b, 0)).all()


def test_gif_of_many_colours():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, (80, 80, 4), dtype=np.uint8)
    noise[..., 3] = 255
    back, _ = animation.read_gif(animation.gif([noise, noise]))
    assert np.abs(back[0][..., :3].astype(int) - noise[..., :3]).mean() < 16
    with pytest.raises(ValueError):
        animation.gif([])


def test_gif_without_transparency_gives_up_the_nearest_colour():
    frame = np.zeros((2, 2, 4), np.uint8)
    frame[..., 3], frame[0, 0] = 255, (200, 0, 200, 255)
    (back,), _ = animation.read_gif(animation.gif([frame]))
    assert (back[..., 3] == 0).tolist() == [[True, False], [False, False]]


def test_palette_key_is_nearest_when_absent():
    palette = np.zeros((256, 3), np.uint8)
    palette[7], palette[9] = (250, 0, 250), (250, 0, 250)
    assert animation.nearest(palette) == 7
    index, moved = animation.key_first(np.array([[0, 7, 9]], np.uint8), palette)
    assert index.tolist() == [[7, 0, 9]] and moved[0].tolist() == [250, 0, 250]


def sheet(*cells, size=20):
    """A row of cells with one square each, as (x0, y0, x1, y1) boxes, or None."""
    picture = np.full((size, size * len(cells), 4), (255, 0, 255, 255), np.uint8)
    for i, boxes in enumerate(cells):
        for x0, y0, x1, y1 in boxes or ():
            picture[y0:y1, i * size + x0 : i * size + x1] = (30, 90, 200, 255)
    return picture


def frames_of(spark, picture, **params):
    p = Params(rows=1, trim_border=2, edge_clean_depth=0, **params)
    raster = spark.createDataFrame([(1, picture.shape[1], picture.shape[0], bytearray(picture.tobytes()))], ra.RASTERS)
    return fr.placed(fr.checked(fr.cut(raster, p), p), p).orderBy("grid_row", "grid_col").collect()


def test_edge_touch_modes(spark):
    picture = sheet([(2, 5, 9, 9)], [(11, 5, 18, 9)], [(5, 5, 9, 9)])
    assert [r.edge_touch for r in frames_of(spark, picture, cols=3)] == [True, False, False]
    assert [r.edge_touch for r in frames_of(spark, picture, cols=3, symmetric=True)] == [True, True, False]
    assert [r.edge_touch for r in frames_of(spark, picture, cols=3, edge_touch_margin=4)] == [True, True, True]


def test_empty_frame_and_area_limit(spark):
    picture = sheet(None, [(5, 5, 9, 9), (11, 11, 14, 14)])
    empty, full = frames_of(spark, picture, cols=2, component_mode="largest", shared_scale=True)
    assert empty.x0 is None and (empty.frame_width, empty.frame_height) == (16, 16) and not empty.edge_touch and empty.selected_area is None
    assert full.component_count == 2 and full.selected_area == 16 and (full.x0, full.y0, full.x1, full.y1) == (3, 3, 7, 7)
    assert (full.max_width, full.new_w) == (16, int(4 * min(128 / 16, 128 / 16) * 0.85))
    _, fallback = frames_of(spark, picture, cols=2, component_mode="largest", min_component_area=50)
    assert fallback.component_count == 0 and (fallback.x0, fallback.x1) == (3, 12)


def test_equal_areas_take_the_first(spark):
    (frame,) = frames_of(spark, sheet([(10, 4, 13, 7), (4, 4, 7, 7)]), cols=1, component_mode="largest")
    assert (frame.sel_x0, frame.sel_y0) == (2, 2)


def test_left_over_pixels_are_dropped(spark):
    picture = sheet([(3, 3, 6, 6)])[:, :20]
    rows = frames_of(spark, picture, cols=3)
    assert {(r.cell_width, r.cell_height) for r in rows} == {(6, 20)}


def test_two_sources_give_the_same_sheets(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = ra.part_pixels(part), ra.pixels(ra.part_rasters(part))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_image_sources(spark, tmp_path):
    picture = np.random.default_rng(0).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(picture))
    row = ra.read_images(spark, str(tmp_path)).first()
    assert (ra.array_of(row.width, row.height, row.rgba) == picture).all()
    other = ra.read_image_source(spark, str(tmp_path)).first()
    assert (ra.array_of(other.width, other.height, other.rgba) == picture).all()
    (tmp_path / "p.txt").write_text("é prompt\n", encoding="utf-8")
    assert ra.read_prompt(spark, str(tmp_path / "p.txt")) == "é prompt\n" and ra.read_prompt(spark, str(tmp_path / "none")) is None


def raster_frame(spark, picture):
    return spark.createDataFrame([(7, picture.shape[1], picture.shape[0], bytearray(picture.tobytes()))], ra.RASTERS)


def test_process_player_sheet(spark, tmp_path):
    row = np.concatenate([sheet([(6, 6, 14, 14)])] * 4, axis=1)
    picture = np.concatenate([row] * 4)
    ask = pr.Request("player", "player_sheet", "a hero", trim_border=0, edge_clean_depth=0, duration=90)
    assert ask.params.cell_size == 96
    out = write_files(pr.process(raster_frame(spark, picture), ask), str(tmp_path / "out"))
    names = {r.path.rsplit("/", 1)[1] for r in out.collect()}
    expected = {f"{d}-{i}.png" for d in ("down", "left", "right", "up") for i in (1, 2, 3, 4)} | {f"{d}-strip.png" for d in ("down", "left", "right", "up")} | {f"{d}.gif" for d in ("down", "left", "right", "up")}
    assert names == expected | {"raw-sheet.png", "raw-sheet-clean.png", "sheet-transparent.png", "pipeline-meta.json", "prompt-used.txt"}
    folder = tmp_path / "out" / "7"
    meta = json.loads((folder / "pipeline-meta.json").read_text())
    assert meta["rows"] == 4 and len(meta["frames"]) == 16 and meta["edge_touch_frames"] == [] and meta["directions"] == ["down", "left", "right", "up"]
    assert meta["frames"][5]["grid"] == [1, 1] and meta["frames"][5]["source_box"] == [20, 20, 40, 40] and meta["frames"][5]["crop_bbox"] == [6, 6, 14, 14]
    sheet_png = png.decode((folder / "sheet-transparent.png").read_bytes())
    assert sheet_png.shape == (384, 384, 4)
    frames, duration = animation.read_gif((folder / "down.gif").read_bytes())
    assert len(frames) == 4 and duration == 90
    assert (folder / "prompt-used.txt").read_text() == "a hero" and (tmp_path / "out" / "_SUCCESS").exists()


def test_lzw_and_palettes_of_any_size():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", bytes(20_000), rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 50_000, dtype=np.uint8).tobytes()):
        assert animation._unlzw(animation._lzw(data)) == data
    index, palette = animation.quantise(rng.integers(0, 256, (60, 60, 3), dtype=np.uint8))
    assert len(np.unique(index)) == 256
    few = rng.integers(0, 2, (9, 9, 3), dtype=np.uint8) * 200
    index, palette = animation.quantise(few)
    assert (palette[index] == few).all()


def test_written_paths_are_absolute_and_read_from_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    out = write_files(pr.process(raster_frame(spark, sheet([(6, 6, 12, 12)])), pr.Request("asset", "single")), "out")
    paths = [r.path for r in out.collect()]
    assert all(p.startswith(f"{tmp_path}/out/7/") for p in paths) and len(paths) == 3
    (tmp_path / "out" / "7" / "raw.png").unlink()
    assert out.count() == 3 and not (tmp_path / "out" / "7" / "raw.png").exists()


def test_process_single_and_rejection(spark):
    picture = sheet([(2, 5, 9, 9)])
    names = {r.name: r.content for r in pr.process(raster_frame(spark, picture), pr.Request("asset", "single")).collect()}
    assert set(names) == {"raw.png", "clean.png", "pipeline-meta.json"} and png.decode(bytes(names["clean.png"])).shape == (256, 256, 4)
    ask = pr.Request("asset", "single", rows=1, cols=1, label_prefix="prop", reject_edge_touch=True, trim_border=2, edge_clean_depth=0)
    with pytest.raises(Exception, match="touches its cell"):
        pr.process(raster_frame(spark, picture), ask).collect()
    kept = {r.name for r in pr.process(raster_frame(spark, sheet([(6, 6, 12, 12)])), ask).collect()}
    assert {"prop-1.png", "animation.gif", "sheet-transparent.png"} <= kept


def test_requests_are_checked():
    for bad in ({"target": "dragon", "mode": "idle"}, {"target": "asset", "mode": "idle", "rows": 2}, {"target": "asset", "mode": "idle", "rows": 0, "cols": 1}, {"target": "npc", "mode": "idle", "strict": True}):
        with pytest.raises(ValueError):
            pr.Request(**bad)
    assert not pr.Request("asset", "sheet").is_sheet and not pr.Request("asset", "nonsense").is_sheet and pr.Request("asset", "nonsense", rows=1, cols=2).labels == ["nonsense-1", "nonsense-2"]
    assert fr.PROP.align == "feet" and fr.PROP.min_component_area == 200


def test_stream(spark, tmp_path):
    from mosaicflow.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.png").write_bytes(png.encode(sheet([(6, 6, 12, 12)], [(7, 7, 12, 12)])))
    p = Params(rows=1, cols=2, trim_border=2, edge_clean_depth=0)
    for expected in (2, 4):
        query = ingest.write_frames(ingest.stream_frames(spark, str(source), p), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (source / "b.png").write_bytes(png.encode(sheet([(6, 6, 12, 12)], None)))
