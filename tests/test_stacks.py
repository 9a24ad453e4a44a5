"""Rasters of several channels in blocks against whole arrays, with windows that cross the borders of blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks as B
from tilewright.operators import stacks as S


def image(seed: int, h: int, w: int, c: int = 2) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 200, (h, w, c)).astype(np.uint8)


def as_stacks(spark, images: dict, size: int):
    rows = [(k, a.shape[0], a.shape[1], a.shape[2], a.tobytes()) for k, a in images.items()]
    return S.image_stacks(spark.createDataFrame(rows, "img long, height int, width int, nChannels int, data binary"), size)


def whole(stacks, images: dict, channels: int) -> dict:
    out = {k: np.full((*a.shape[:2], channels), np.nan) for k, a in images.items()}
    for r in stacks.collect():
        a = np.frombuffer(r["data"], np.float32).reshape(r["h"], r["w"], r["channels"])
        out[r["img"]][r["row0"] : r["row0"] + r["h"], r["col0"] : r["col0"] + r["w"]] = a
    return out


def model():
    def score(x, at):
        # what a model says depends on its whole window, so a wrong or missing margin shows
        rank = np.nansum(x, axis=(1, 2))[:, None, None, :]
        return np.stack([np.nan_to_num(x[..., 0]) + rank[..., 0] % 7, x[..., 1] - rank[..., 1] % 11, np.full(x.shape[:3], (at.sum(axis=1) % 5)[:, None, None])], 3)

    return score


IMAGES = {1: (37, 53), 2: (20, 20), 3: (61, 18), 4: (5, 90)}


@pytest.mark.parametrize(("size", "window"), [(16, (10, 10)), (7, (10, 12)), (64, (9, 9)), (20, (20, 20))])
@pytest.mark.parametrize("centre", [False, True])
def test_windows_over_borders(spark, size, window, centre):
    images = {k: image(k, *s) for k, s in IMAGES.items()}
    h, w = window
    step = (h // 2, w // 2) if centre else (h - 4, w - 3)
    places = [(k, x, y) for k, a in images.items() for y in range(0, a.shape[0] - h + 1, step[0]) for x in range(0, a.shape[1] - w + 1, step[1])]
    windows = spark.createDataFrame(places, "img long, x1 long, y1 long")
    got = whole(S.score_windows(as_stacks(spark, images, size), windows, window, model, size, centre=centre, batch=3), images, 3)
    want = {k: np.full((*a.shape[:2], 3), np.nan) for k, a in images.items()}
    for k, x, y in places:
        said = model()(images[k][None, y : y + h, x : x + w].astype(np.float32), np.array([[y, x]]))[0]
        a, b = (h // 4, w // 4) if centre else (0, 0)
        part = said[a : a + h // 2, b : b + w // 2] if centre else said
        target = want[k][y + a : y + a + part.shape[0], x + b : x + b + part.shape[1]]
        np.fmax(target, part, out=target)
    for k in images:
        expect = want[k] if centre else np.maximum(want[k], 0)
        assert np.array_equal(got[k], expect.astype(np.float32), equal_nan=True)


def test_windows_outside_of_the_image(spark):
    images = {1: image(5, 12, 12)}
    stacks = as_stacks(spark, images, 8)
    places = spark.createDataFrame([(1, -3, -2), (1, 7, 9)], "img long, x1 long, y1 long")
    got = whole(S.score_windows(stacks, places, (6, 6), lambda: lambda x, at: np.nan_to_num(x) + 1, 8, outside=True), images, 2)[1]
    want = np.full((12, 12, 2), np.nan)
    want[:4, :3], want[9:, 7:] = images[1][:4, :3] + 1.0, images[1][9:, 7:] + 1.0
    assert np.array_equal(got, want, equal_nan=True)
    with pytest.raises(Exception, match="outside of the image"):
        S.score_windows(stacks, places, (6, 6), lambda: lambda x, at: x, 8).collect()
    with pytest.raises(ValueError, match="before merging"):
        S.score_windows(stacks, places, (6, 6), lambda: lambda x, at: x, 8, classes=True)
    assert S.score_windows(stacks, places.limit(0), (6, 6), lambda: lambda x, at: x, 8).count() == 0
    assert S.score_windows(stacks.limit(0), places.where("x1 > 0"), (6, 6), lambda: lambda x, at: x, 8).count() == 0


def test_no_row_for_a_pixel_is_shuffled(spark):
    """Of 40,000 pixels and their classes some dozens of arrays are exchanged."""
    images = {1: image(2, 200, 200)}
    sizes = spark.createDataFrame([(1, 200, 200)], "img long, h int, w int")
    found = S.predict_overlapping(as_stacks(spark, images, 64), sizes, 50, lambda: lambda x, at: x, size=64)
    assert len(found.collect()) == 16
    parts = S.with_margins(as_stacks(spark, images, 64), 49, 49, 64)
    # of 16 blocks: themselves, and what goes to the left, up, and across
    assert parts.count() == 16 + 12 + 12 + 9
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "HashAggregate" not in text


def test_classes_and_reports(spark):
    images = {1: image(3, 40, 40, 1), 2: image(4, 30, 50, 1)}
    one = as_stacks(spark, images, 16)
    labels = B.map_blocks(S.class_blocks(one, 99.0), lambda a: a)
    actual = {(r.img, r.row_no, r.col_no): r.v for r in B.to_pixels(labels).collect()}
    assert actual == {(k, y, x): int(a[y, x, 0] > 99) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])}
    cells = S.classes_of(np.array([[[1, 2, 2], [np.nan, 0, np.nan], [np.nan] * 3, [5, 5, 1]]], dtype=np.float32))
    assert cells.tolist() == [[1, 1, B.NONE, 0]]
    report = {r["class"]: r for r in S.report(S.class_blocks(one, 120.0), labels, 2).collect()}
    n = sum(int((a > 120).sum()) for a in images.values())
    m = sum(int((a > 99).sum()) for a in images.values())
    assert report[1].number_samples == m and abs(report[1].recall - n / m) < 1e-12 and report[1].precision == 1.0


def test_mosaic_crops_its_labels(spark):
    images = {1: image(6, 41, 33)}
    sizes = spark.createDataFrame([(1, 41, 33)], "img long, h int, w int")
    found = S.predict_stitched(as_stacks(spark, images, 10), sizes, 12, lambda: lambda x, at: x, 10)
    seen = sorted((r.row_no, r.col_no) for r in B.to_pixels(found).collect())
    # half-stride windows of 12: starts 0, 6, ..., the last one ends below the edge
    rows, cols = [r for r in range(0, 41 - 12, 6)], [c for c in range(0, 33 - 12, 6)]
    assert seen == [(r, c) for r in range(3, rows[-1] + 9) for c in range(3, cols[-1] + 9)]


def test_moments_with_large_offsets(spark):
    """The deviation of small numbers on a large offset, over blocks and images of unequal size."""
    base = {k: np.random.default_rng(k).normal(0, 1, s) for k, s in {1: (50, 40, 2), 2: (3, 90, 2)}.items()}
    arrays = {k: (a + 1e6).astype(np.float32) for k, a in base.items()}
    rows = [S._row(k, i // 16, j // 16, i, j, a[i : i + 16, j : j + 16]) for k, a in arrays.items() for i in range(0, a.shape[0], 16) for j in range(0, a.shape[1], 16)]
    stacks = spark.createDataFrame(rows, S.STACK).repartition(5)
    for r in S.channel_moments(stacks).collect():
        own = arrays[r.img][:, :, r.channel].astype(np.float64)
        assert r.n == own.size and abs(r.mean - own.mean()) < 1e-9 * 1e6 and abs((r.m2 / r.n) ** 0.5 - own.std()) < 1e-9
    got = whole(S.standardise(stacks), arrays, 2)
    for k, a in arrays.items():
        d = a.astype(np.float64)
        assert np.allclose(got[k], (d - d.mean(axis=(0, 1))) / (d.std(axis=(0, 1)) + 1e-9), atol=1e-4)
    assert abs(S.channel_means(stacks).where("channel = 0").first()["mean"] - np.mean([a[:, :, 0].astype(np.float64).mean() for a in arrays.values()])) < 1e-4
    moved = whole(S.centre_channels(stacks, [1e6, 1e6]), arrays, 2)
    assert np.allclose(moved[1], (arrays[1] - np.float32(1e6)) / 255, atol=1e-6)


def test_model_is_loaded_once_a_worker(spark):
    images = {1: image(9, 64, 64)}
    places = spark.createDataFrame([(1, x, y) for x in range(0, 57, 4) for y in range(0, 57, 4)], "img long, x1 long, y1 long")

    def load():
        import os
        import time

        stamp = float(os.getpid() % 100_000) * 100 + time.time() % 100

        return lambda x, at: np.full((*x.shape[:3], 1), stamp, dtype=np.float32)

    found = S.score_windows(as_stacks(spark, images, 8), places, (8, 8), load, 8)
    stamps = {v for r in found.collect() for v in np.unique(np.frombuffer(r["data"], np.float32)) if not np.isnan(v)}
    # 64 blocks, some loads: at most one for each Python worker of the session
    assert 1 <= len(stamps) <= 16
    # a profile of resources is left out where the session has none
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    gpus = ResourceProfileBuilder().require(TaskResourceRequests().resource("gpu", 1)).build
    plain = lambda: lambda x, at: x
    one, two = (whole(S.score_windows(as_stacks(spark, images, 8), places, (8, 8), plain, 8, profile=q), images, 2)[1] for q in (gpus, None))
    assert np.array_equal(one, two, equal_nan=True) and not np.isnan(one).any()


def test_stack_bands_of_unlike_blocks(spark):
    def block(img, i, j, a):
        return img, i, j, i * 4, j * 4, *a.shape, a.astype(np.int32).tobytes()

    full, short = np.arange(16).reshape(4, 4), np.arange(12).reshape(3, 4)
    one = spark.createDataFrame([block(1, 0, 0, full), block(1, 0, 1, full)], B.BLOCK)
    two = spark.createDataFrame([block(1, 0, 0, np.where(short == 5, B.NONE, short))], B.BLOCK)
    rows = S.stack_bands(one, two).collect()
    assert len(rows) == 1
    a = np.frombuffer(rows[0]["data"], np.float32).reshape(rows[0]["h"], rows[0]["w"], 2)
    assert a.shape == (3, 4, 2) and np.isnan(a[1, 1, 1]) and a[2, 3].tolist() == [11, 11]
    assert pa.types.is_binary(S._batch([]).schema.field("data").type)
    assert S.to_pixels(S.stack_bands(one, two)).where(F.col("class") == 1).count() == 11


@pytest.mark.parametrize("size", [8, 64])
def test_crops_and_resizing_over_blocks(spark, size):
    images = {1: image(1, 37, 53), 2: image(2, 21, 20), 3: image(3, 9, 80)}
    stacks = as_stacks(spark, images, size)
    places = spark.createDataFrame([(1, 5, 30), (2, 0, 0), (3, -3, 70)], "img long, row0 long, col0 long")
    got = {r.img: [] for r in places.collect()}
    found = whole(S.crop_stacks(stacks, places, 20, 20, size), {k: np.zeros((20, 20)) for k in images}, 2)
    for k, r, c in ((1, 5, 30), (2, 0, 0), (3, -3, 70)):
        want = np.full((20, 20, 2), np.nan)
        for y in range(20):
            for x in range(20):
                if 0 <= y + r < images[k].shape[0] and 0 <= x + c < images[k].shape[1]:
                    want[y, x] = images[k][y + r, x + c]
        assert np.array_equal(found[k], want, equal_nan=True)
    assert got.keys() == images.keys()
    sizes = spark.createDataFrame([(k, *a.shape[:2]) for k, a in images.items()], "img long, h long, w long")
    drawn = S.random_crops(stacks, sizes, 10, 15, 4, size=size)
    assert {r.img for r in drawn.collect()} == {1, 2}
    for new_h, new_w in ((13, 70), (60, 7)):
        found = whole(S.resize_stacks(stacks, sizes, new_h, new_w, size), {k: np.zeros((new_h, new_w)) for k in images}, 2)
        for k, a in images.items():
            taps = lambda old, new: np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            ys, xs = taps(a.shape[0], new_h), taps(a.shape[1], new_w)
            y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
            y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
            fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
            b = a.astype(float)
            want = (b[y0][:, x0] * (1 - fx) + b[y0][:, x1] * fx) * (1 - fy) + (b[y1][:, x0] * (1 - fx) + b[y1][:, x1] * fx) * fy
            assert np.allclose(found[k], want, atol=1e-4)


def test_outlines_of_objects(spark):
    """Instance masks and class masks of triangles and odd rings, drawn pixel by pixel in plain Python."""
    import random

    from tilewright.operators import raster

    r = random.Random(5)
    shapes = [(r.randrange(2), i, r.randrange(1, 4), r.randrange(6), [(r.uniform(-20, 60), r.uniform(-20, 60)) for _ in range(r.randrange(1, 6))]) for i in range(40)]
    shapes += [(0, 90, 1, 3, []), (0, 91, None, 3, [(1.0, 1.0)]), (1, 92, 2, None, [(0.5, 0.5), (-0.5, 2.5)])]
    d = spark.createDataFrame(shapes, "img long, id long, class int, order long, ring array<struct<x:double,y:double>>")

    def pixels(ring):
        out = set()
        for a, b in zip(ring, [*ring[1:], ring[0]]):
            n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1.0)
            for t in range(int(np.ceil(n)) + 1):
                s = min(1.0, t / n)
                x, y = (a[k] + s * (b[k] - a[k]) for k in (0, 1))
                away = lambda v: int(np.sign(v) * np.floor(abs(v) + 0.5))
                out.add((away(y), away(x)))
        return out

    for row in raster.instance_masks(d).collect():
        ring = next(s[4] for s in shapes if s[1] == row.id)
        if not ring:
            assert row.mask is None and row.x1 is None
            continue
        m = np.frombuffer(row.mask, np.uint8).reshape(row.h, row.w)
        assert {(y + row.row0, x + row.col0) for y, x in zip(*np.nonzero(m), strict=True)} == pixels(ring)
        assert (row.x1, row.y1, row.x2, row.y2) == (min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring))
    want = {}
    for img, _, c, order, ring in sorted((s for s in shapes if s[4] and s[2] is not None), key=lambda s: (-1 if s[3] is None else s[3], s[2])):
        want |= {(img, *p): c for p in pixels(ring)}
    for size, salt in ((16, 1), (32, 7)):
        got = {(q.img, q.row_no, q.col_no): q.v for q in B.to_pixels(raster.outline_blocks(d, size, salt)).collect()}
        assert got == want
    plain = {(q.img, q.row_no, q.col_no) for q in raster.draw_outlines(d.where("order is not null and class is not null and size(ring) > 1")).collect()}
    assert plain <= set(want)


MAPS = {
    "comb": ["#" * 29, *["#.#.#.#.#.#.#.#.#.#.#.#.#.#.#"] * 12],
    "spiral": [
        "###############", "#.............#", "#.###########.#", "#.#.........#.#", "#.#.#######.#.#", "#.#.#.....#.#.#", "#.#.#.###.#.#.#", "#.#.#.#.#.#.#.#", "#.#.#.#...#.#.#", "#.#.#.#####.#.#",
        "#.#.#.......#.#", "#.#.#########.#", "#.#...........#", "#.#############",
    ],
    "holes": ["#########", "#.##...##", "###.#.#.#", "#.###...#", "#########", ".#.#.#.#.", "#.#.#.#.#", "###...###", "#########"],
    "islands": ["#######", "#.....#", "#.###.#", "#.#.#.#", "#.###.#", "#.....#", "#######"],
}


def rings_of(cells):
    """Corner rings of a set of cells, inside on the right, right turns first, from the least edge on."""
    edges = {}
    for y, x in cells:
        for dy, dx, a, b in ((-1, 0, (x, y), (x + 1, y)), (0, 1, (x + 1, y), (x + 1, y + 1)), (1, 0, (x + 1, y + 1), (x, y + 1)), (0, -1, (x, y + 1), (x, y))):
            if (y + dy, x + dx) not in cells:
                edges.setdefault(a, []).append(b)
    left, out = {(a, b) for a, bs in edges.items() for b in bs}, set()
    while left:
        first = min(left, key=lambda e: (e[0][1], e[0][0], e[1][1], e[1][0]))
        ring, e = [], first
        while True:
            ring.append(e)
            left.discard(e)
            (ax, ay), (bx, by) = e
            turn = (bx - (by - ay), by + (bx - ax))
            to = turn if turn in edges[e[1]] else edges[e[1]][0]
            e = (e[1], to)
            if e == first:
                break
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in ring) / 2
        dirs = [(b[0] - a[0], b[1] - a[1]) for a, b in ring]
        out.add((area, tuple((k, *ring[k][0]) for k in range(len(ring)) if dirs[k] != dirs[k - 1])))
    return out


@pytest.mark.parametrize("size", [4, 64])
def test_rings_over_blocks(spark, size):
    from tilewright.operators import raster

    rows = [(k, y, x, 1) for k, m in enumerate(MAPS.values()) for y, line in enumerate(m) for x, c in enumerate(line) if c == "#"]
    blocks = B.to_blocks(spark.createDataFrame(rows, "img long, row_no long, col_no long, v int"), "v", size)
    parts = B.regions(blocks, False, size)
    found = raster.rings(B.outlines(blocks, parts), size).collect()
    by_ring = {}
    for r in found:
        by_ring.setdefault((r.img, r.component, r.ring), set()).add((r.signed_area, r.place, r.x, r.y))
    for k, m in enumerate(MAPS.values()):
        cells = {(y, x) for y, line in enumerate(m) for x, c in enumerate(line) if c == "#"}
        want, left = [], set(cells)
        while left:
            piece, todo = set(), [left.pop()]
            while todo:
                y, x = todo.pop()
                piece.add((y, x))
                for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            want += rings_of(piece)
        got = [(next(iter(v))[0], tuple(sorted((p, x, y) for _, p, x, y in v))) for (img, _, _), v in by_ring.items() if img == k]
        assert sorted(got) == sorted(want)
        assert sum(a for a, _ in got) == len(cells)
