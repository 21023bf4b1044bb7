import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.functions import boxes, images
from regionloom.operators import extract
from regionloom.sources import sinks


def png(pixels, kinds):
    """A PNG of 8-bit pixels, each line filtered in one of the given ways, byte by byte."""
    h, w, step = pixels.shape
    flat, raw = pixels.reshape(h, -1).astype(int), b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        line = [kind]
        for i in range(w * step):
            a = flat[y, i - step] if i >= step else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, i] - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        raw += bytes(int(v) for v in line)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pixels(h, w, step=3, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, step), dtype=np.uint8)


def test_every_filter_and_kind_of_png():
    for step in (1, 2, 3, 4):
        image = pixels(11, 7, step)
        got = images.read_png(png(image, [0, 1, 2, 3, 4]))
        assert (got.reshape(image.shape) == image).all()
    with pytest.raises(ValueError):
        images.read_png(b"GIF89a")


def test_masks_that_were_written_are_read():
    mask = [[False, True, False], [False, True, True]]
    got = images.load_mask(sinks.png_bytes(mask), (3, 2))
    assert (got == np.where(mask, 255, 0)).all() and images.mask_box(got) == (1, 0, 3, 2)
    assert images.mask_box(np.zeros((2, 3), np.uint8)) == (0, 0, 3, 2)
    for content, size in ((sinks.png_bytes(mask), (2, 3)), (None, (3, 2))):
        with pytest.raises(ValueError):
            images.load_mask(content, size)


def test_crops_are_those_of_the_column(spark):
    rng = np.random.default_rng(3)
    rows = [(*map(float, np.round(np.sort(rng.uniform(-5, 120, 2)), 2)), *map(float, np.round(np.sort(rng.uniform(-5, 90, 2)), 2)), int(w), int(h)) for w, h in rng.integers(1, 130, (200, 2))]
    rows = [(x1, y1, x2, y2, w, h) for x1, x2, y1, y2, w, h in rows]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = df.select("*", boxes.padded_crop(F.struct("x1", "y1", "x2", "y2"), F.col("w"), F.col("h")).alias("c")).collect()
    assert len(got) == 200
    for r in got:
        assert tuple(r.c) == images.crop_of((r.x1, r.y1, r.x2, r.y2), r.w, r.h)


def test_inputs_of_networks():
    assert (images.resize(pixels(9, 9), 9, 9) == pixels(9, 9)).all()
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (images.resize(flat, 13, 57) == 77).all()
    # halving a ramp keeps it a ramp, away from its ends
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 4, axis=0)
    assert (np.diff(images.resize(ramp, 50, 4)[0, 3:-3, 0].astype(int)) == 4).all()
    wide = pixels(20, 50)
    assert images.feature_input(wide, 10).shape == images.heatmap_input(wide, 10).shape == (3, 10, 10)
    want = images.resize(wide, 25, 10)[:, 8:18]  # 7.5 goes to the even place
    assert np.allclose(images.feature_input(wide, 10), np.moveaxis((want / 255 - images.MEAN) / images.STD, 2, 0), atol=1e-5)


def test_regions_reach_the_model(spark):
    image, mask = pixels(60, 80), np.zeros((60, 80), bool)
    mask[20:40, 10:50] = True
    content = png(image, [4])
    rows = [(1, content, "10,20,50,40", sinks.png_bytes(mask.tolist())), (2, content, "", sinks.png_bytes(mask.tolist()))]
    records = spark.createDataFrame(rows, "id long, content binary, bbox string, mask_content binary")
    left, top, right, bottom = images.crop_of((10, 20, 50, 40), 80, 60)
    part = image[top:bottom, left:right]
    black = np.where(mask[top:bottom, left:right, None], part, 0)
    sums = lambda batch: [[float(p.sum()), *map(float, p.shape[:2])] for p in batch]
    for options, want in (({}, [image, image]), ({"region": "bbox"}, [part, image]), ({"region": "mask"}, [black, black]), ({"region": "mask", "background": "keep"}, [part, part])):
        got = extract.extract_features(records, extract.of_regions(sums, **options), 3).orderBy("id").collect()
        assert [r.feature for r in got] == sums(want)
    with pytest.raises(ValueError):
        extract.of_regions(sums, region="circle")


def test_guards():
    extract.require_modules("numpy")
    with pytest.raises(SystemExit, match="no_such_library"):
        extract.require_modules("numpy", "no_such_library")
    assert [extract.device_of(), extract.device_of("auto", lambda: True), extract.device_of("cuda:1")] == ["cpu", "cuda", "cuda:1"]
    assert (images.masked(np.full((1, 2, 3), 200, np.uint8), np.array([[255, 51]], np.uint8))[0, :, 0] == [200, 40]).all()
