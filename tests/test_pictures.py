"""Outlines, filters and maps of pictures against naive versions, and the tables made of them."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxmill.functions import outlines, rasters
from boxmill.functions.pixels import homography, hsv, in_range
from boxmill.functions.polygons import polygon_area, polygon_perimeter
from boxmill.operators import pictures, rules
from boxmill.plans.registry import QUERIES


def flood(mask, eight):
    """Labels by flooding, from 1 on, in the order of first pixels."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    v, u = a + dy, b + dx
                    if (eight or not dy or not dx) and 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not label[v, u]:
                        label[v, u] = n
                        todo.append((v, u))
    return label


def naive_filled(mask):
    return flood(np.pad(~mask, 1, constant_values=True), False)[1:-1, 1:-1] != 1


def shoelace(points):
    x, y = points.T
    return abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def masks(n, seed):
    rng = np.random.default_rng(seed)
    out = [np.zeros((3, 4), bool), np.ones((1, 1), bool), np.ones((5, 1), bool), np.ones((4, 6), bool), np.eye(6, dtype=bool), np.eye(6, dtype=bool)[::-1]]
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    out.append(ring)
    for k in range(n):
        coarse = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.uniform(0.2, 0.8)
        out.append(np.kron(coarse, np.ones((rng.integers(1, 5), rng.integers(1, 5)), bool)) if k % 2 else rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.uniform(0.2, 0.8))
    return out


def test_parts_against_flooding():
    for mask in masks(300, 1):
        values = np.random.default_rng(2).integers(0, 256, mask.shape)
        whole = naive_filled(mask)
        assert (outlines.filled(mask) == whole).all()
        label = flood(whole, True)
        found = outlines.parts(mask, values)
        assert len(found.area) == label.max()
        for k in range(label.max()):
            own = label == label.max() - k
            y, x = np.nonzero(own)
            assert (found.x[k], found.y[k], found.w[k], found.h[k]) == (x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1)
            assert found.mean[k] == pytest.approx(values[own].mean())
            points = outlines.border(whole, int(found.start[k]))
            assert shoelace(points) == found.area[k]
            # The corners of the border are pixels of the part, and lead around all of it.
            assert own[points[:, 1], points[:, 0]].all() and (points.min(0) == (x.min(), y.min())).all() and (points.max(0) == (x.max(), y.max())).all()


def test_border_of_a_square_has_its_corners():
    mask = np.zeros((20, 30), bool)
    mask[4:12, 5:25] = True
    assert sorted(map(tuple, outlines.largest_outline(mask))) == [(5, 4), (5, 11), (24, 4), (24, 11)]
    assert len(outlines.largest_outline(np.zeros((5, 5), bool))) == 0
    assert outlines.largest_outline(np.ones((1, 1), bool)).tolist() == [[0, 0]]


def line_distance(p, a, b):
    (dx, dy), (px, py) = b - a, p - a
    return abs(px * dy - py * dx) / np.hypot(dx, dy) if (dx, dy) != (0, 0) else np.hypot(px, py)


def test_simplified_outlines_stay_near():
    rng = np.random.default_rng(4)
    for _ in range(60):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 40))
        outline = np.unique(np.stack([500 + np.cos(angle) * rng.uniform(100, 300, 40), 500 + np.sin(angle) * rng.uniform(100, 300, 40)], 1).astype(int), axis=0)
        for epsilon in (1, 8, 40):
            corners = outlines.simplified(outline, epsilon)
            at = sorted(next(k for k, p in enumerate(outline) if (p == c).all()) for c in corners)
            assert len(at) == len(corners)
            for low, high in zip(at, [*at[1:], at[0] + len(outline)]):
                between = [outline[k % len(outline)] for k in range(low + 1, high)]
                # An end of the split that goes may add its own distance, for each of the two.
                assert all(line_distance(p, outline[low], outline[high % len(outline)]) <= 3 * epsilon for p in between)


@pytest.mark.parametrize("turn", [0.0, 0.3, -0.6])
def test_four_corners_of_a_turned_sheet(turn):
    v, u = np.mgrid[0:400, 0:500]
    x, y = u - 250, v - 200
    a, b = x * np.cos(turn) + y * np.sin(turn), -x * np.sin(turn) + y * np.cos(turn)
    mask = (np.abs(a) < 140) & (np.abs(b) < 90)
    mask[195:205, 245:255] = False
    corners = outlines.four_corners(outlines.largest_outline(mask))
    c, s = np.cos(turn), np.sin(turn)
    want = np.array([(250 + p * c - q * s, 200 + p * s + q * c) for p, q in ((-140, -90), (140, -90), (140, 90), (-140, 90))])
    assert np.abs(corners - want).max() < 4
    disc = x**2 + y**2 < 150**2
    assert len(outlines.four_corners(outlines.largest_outline(disc))) == 0
    assert len(outlines.four_corners(np.zeros((0, 2), int))) == 0


def naive_window(values, size, pick, none):
    half, (h, w) = size // 2, values.shape
    padded = np.pad(values, half, constant_values=none)
    return np.array([[pick(padded[y : y + size, x : x + size]) for x in range(w)] for y in range(h)], np.uint8)


def test_running_filters():
    rng = np.random.default_rng(5)
    for size in (1, 3, 5, 9, 31):
        for shape in ((1, 1), (7, 20), (23, 4)):
            values = rng.integers(0, 256, shape).astype(np.uint8)
            assert (rasters.eroded(values, size) == naive_window(values, size, np.min, 255)).all()
            assert (rasters.dilated(values, size) == naive_window(values, size, np.max, 0)).all()
    mask = np.full((60, 60), 255, np.uint8)
    mask[5:9, 5:9] = 0  # a speck
    mask[20:32, :] = 0  # a line
    clean = rasters.denoised(mask)
    assert clean[6, 6] == 255 and (clean[20:32] == 0).all() and (rasters.grown(clean, 5)[15:37] == 0).all() and rasters.grown(clean, 5)[14, 0] == 255


def naive_warp(picture, h, width, height, outside):
    back, out = np.linalg.inv(h), np.zeros((height, width, *picture.shape[2:]), picture.dtype)

    def at(y, x):
        return picture[y, x].astype(float) if 0 <= y < picture.shape[0] and 0 <= x < picture.shape[1] else np.full(picture.shape[2:], float(outside))

    for v in range(height):
        for u in range(width):
            x, y, w = back @ (u, v, 1)
            x, y = x / w, y / w
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            fx, fy = x - x0, y - y0
            out[v, u] = np.rint((at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy)
    return out


def test_warping(monkeypatch):
    rng = np.random.default_rng(6)
    h = homography(np.array([(0, 0), (20, 0), (20, 15), (0, 15)]), np.array([(2, 1), (22, 3), (19, 17), (-3, 14)]))
    monkeypatch.setattr(rasters, "BLOCK", 60)
    for shape in ((16, 21), (16, 21, 3)):
        picture = rng.integers(0, 256, shape).astype(np.uint8)
        for outside in (0, 255):
            assert np.abs(rasters.warped(picture, h, 25, 19, outside).astype(int) - naive_warp(picture, h, 25, 19, outside)).max() <= 1
    smooth = (np.add.outer(np.arange(60), np.arange(80)) + 20).astype(np.uint8)
    there = homography(np.array([(0, 0), (79, 0), (79, 59), (0, 59)]), np.array([(3, 2), (76, 4), (78, 57), (1, 55)]))
    again = rasters.warped(rasters.warped(smooth, there, 80, 60), np.linalg.inv(there), 80, 60)
    assert np.abs(again[8:-8, 8:-8].astype(int) - smooth[8:-8, 8:-8]).max() <= 2
    points = np.array([(0.0, 0), (79, 59)])
    assert np.allclose(rasters.moved_points(points, there), [(3, 2), (78, 57)])
    picture = rng.integers(0, 256, (9, 7)).astype(np.uint8)
    down = rasters.shifted_down(picture, 2)
    assert (down[2:] == picture[:-2]).all() and (down[:2] == 255).all() and (rasters.shifted_down(picture, -3)[:6] == picture[3:]).all()
    assert np.abs(rasters.shifted_down(picture, 0.5)[1:].astype(int) - (picture[1:].astype(int) + picture[:-1]) / 2).max() <= 0.5
    assert (rasters.painted(np.zeros((2, 2, 3), np.uint8), np.array([[0, 255], [9, 0]])) == [[[0, 255, 255], [0, 0, 0]], [[0, 0, 0], [0, 255, 255]]]).all()


@pytest.mark.parametrize("size, stride, whole", [(8, 8, True), (8, 5, False), (64, 44, False), (8, 5, True)])
def test_tiles_put_together(size, stride, whole):
    picture = np.random.default_rng(7).integers(0, 256, (21, 34, 3)).astype(np.uint8)
    found = list(rasters.tiles(picture, size, stride, 114, whole))
    height, width = (max(t[k] for t in found) + size for k in (1, 0))
    canvas = np.full((height, width, 3), 114, np.uint8)
    part = picture[:height, :width]
    canvas[: part.shape[0], : part.shape[1]] = part
    for x, y, tile in found:
        assert (tile == canvas[y : y + size, x : x + size]).all()
    if not whole or stride == size:
        assert height >= 21 and width >= 34


def sheet(h=120, w=160, specks=()):
    """A yellow sheet on black with dark specks; blue, green, red."""
    out = np.zeros((h, w, 3), np.uint8)
    out[20:100, 30:140] = (0, 220, 220)
    for y, x, s in specks:
        out[y : y + s, x : x + s] = (90, 60, 40)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if p is None else p.tobytes(), *((0, 0) if p is None else p.shape[:2]), "pad") for i, p in rows], "image_id long, content binary, height int, width int, tile_id string")


def test_traps_and_contour_rows(spark):
    picture = sheet(specks=[(40, 50, 12), (60, 90, 20), (30, 120, 3)])
    df = frame(spark, [(1, picture), (2, np.zeros((30, 30, 3), np.uint8)), (3, None)])
    got = {r.image_id: r.t for r in df.select("image_id", pictures.trap("content", "height", "width").alias("t")).collect()}
    assert [tuple(c) for c in got[1].corners] == [(30, 20), (139, 20), (139, 99), (30, 99)] and got[1].area == 109 * 79
    assert got[2].corners == [] and got[2].area == 0 and got[3].area is None
    shape = df.select("image_id", pictures.trap("content", "height", "width").alias("t")).where("image_id = 1").select(polygon_perimeter(F.col("t.corners")).alias("p"), polygon_area(F.col("t.corners")).alias("a"), pictures.simplified_polygon(F.col("t.outline"), F.lit(2.0)).alias("s")).first()
    assert (shape.p, shape.a) == (2 * (109 + 79), 109 * 79) and len(shape.s) == 4
    # Seen from outside, the dark around the sheet is one part that holds everything: within the sheet's window the specks are the contours.
    inner = picture[20:100, 30:140]
    rows = pictures.contours(frame(spark, [(1, inner), (2, np.full((9, 9, 3), (0, 220, 220), np.uint8)), (3, None)])).collect()
    assert sorted((r.image_id, r.x, r.y, r.w, r.h, r.contour_area, r.brightness) for r in rows) == [(1, 20, 20, 12, 12, 121.0, 90.0), (1, 60, 40, 20, 20, 361.0, 90.0), (1, 90, 10, 3, 3, 4.0, 90.0)]
    params = spark.createDataFrame([("SPECK", 100, 1000, 2.0, None, 50)], "prefix string, least int, most int, max_ratio double, max_box long, min_bright int")
    contours = pictures.contours(frame(spark, [(1, inner)]).drop("tile_id")).withColumn("prefix", F.lit("SPECK"))
    assert sorted((r.w, r.h) for r in rules.filtered(contours, params).collect()) == [(18, 18), (30, 30)]


def test_tile_rows(spark):
    picture = np.random.default_rng(8).integers(0, 256, (50, 70, 3)).astype(np.uint8)
    got = pictures.pixel_tiles(frame(spark, [(1, picture), (2, None)]).withColumnRenamed("tile_id", "note"), 32, 20, 114, False).orderBy("tile_id").collect()
    want = list(rasters.tiles(picture, 32, 20, 114, False))
    assert [(r.image_id, r.note, r.tile_id, r.tile_x, r.tile_y, bytes(r.tile)) for r in got] == [(1, "pad", k, x, y, t.tobytes()) for k, (x, y, t) in enumerate(want)]


def test_masks_of_a_group(spark, monkeypatch):
    rnd, rng = random.Random(9), np.random.default_rng(9)
    rows = [(g, (255 * (rng.random(200_000) < 0.9)).astype(np.uint8)) for g in ["a"] * 40 + ["b", None]] + [("a", np.zeros(5, np.uint8)), ("e", np.zeros(0, np.uint8))]
    rnd.shuffle(rows)
    want = {}
    for g, m in rows:
        want[g, len(m)] = want.get((g, len(m)), m) & m
    df = spark.createDataFrame([(g, m.tobytes()) for g, m in rows] + [("a", None)], "g string, content binary").repartition(6)
    for held in (1 << 26, 100_000):
        monkeypatch.setattr(pictures, "HELD", held)
        got = {(r.g, r.size): bytes(r.content) for r in pictures.joined_masks(df, "g").collect()}
        assert got == {k: v.tobytes() for k, v in want.items()}
    assert pictures.joined_masks(df.limit(0), "g").count() == 0


def test_grid_is_taken_out(spark):
    """A mask with a dark line, made for one sheet, laid over another one that is smaller, and painted."""
    mask = np.full((120, 160), 255, np.uint8)
    mask[60:64, 30:140] = 0
    points = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    source, target = points((30, 20), (139, 20), (139, 99), (30, 99)), points((10, 10), (64, 10), (64, 49), (10, 49))
    small = np.full((60, 80, 3), (0, 220, 220), np.uint8)
    rows = [(1, mask.tobytes(), source, target, small.tobytes(), 0.0), (2, mask.tobytes(), source, [], small.tobytes(), 0.0), (3, mask.tobytes(), source, target, small.tobytes(), 5.0), (4, mask.tobytes(), source, target, small.tobytes(), 900.0)]
    df = spark.createDataFrame(rows, "image_id long, mask binary, source array<struct<x: double, y: double>>, target array<struct<x: double, y: double>>, content binary, dy double")
    df = df.selectExpr("*", "120 AS mask_height", "160 AS mask_width", "60 AS height", "80 AS width")
    got = {r.image_id: r for r in pictures.aligned_masks(df, F.col("dy")).withColumn("done", pictures.without_grid("content", "aligned", "height", "width")).withColumn("back", pictures.turned("content", "height", "width")).collect()}
    one, three = (np.frombuffer(got[i].aligned, np.uint8).reshape(60, 80) for i in (1, 3))
    assert (one[30:31, 11:64] == 0).all() and (one[25, 11:64] == 255).all() and (three[35, 11:64] == 0).all() and (three[:5] == 255).all()
    assert got[2].aligned is None and bytes(got[2].done) == small.tobytes() and bytes(got[4].aligned) == bytes(got[1].aligned)
    done = np.frombuffer(got[1].done, np.uint8).reshape(60, 80, 3)
    assert (done[30, 20] == (0, 255, 255)).all() and (done[20, 20] == (0, 220, 220)).all()
    clean = pictures.cleaned_masks(df.selectExpr("mask AS content", "mask_height AS height", "mask_width AS width"), denoise=3, grow=2).first()
    assert (np.frombuffer(clean.content, np.uint8).reshape(120, 160)[58:66, 40:130] == 0).all()
    seen = spark.createDataFrame([(sheet().tobytes(),)], "content binary").select(pictures.yellow_mask("content", F.lit(120), F.lit(160)).alias("m")).first().m
    assert (np.frombuffer(seen, np.uint8).reshape(120, 160)[20:100, 30:140] == 255).all() and sum(seen) == 255 * 80 * 110


def test_painted_pictures_are_never_held_together(spark, monkeypatch):
    """Batches of painted pictures are bounded by bytes, whatever Spark hands over at once; contours need none of them handed on and are those of the pictures."""
    rnd = random.Random(4)
    rows = [(i, *(v for a in (rnd.randint(-10, 55), rnd.randint(-10, 25)) for v in (a, a + rnd.randint(0, 20)))) for i in range(40) for _ in range(i % 5 + 1)]
    boxes = spark.createDataFrame([(i, x1, y1, x2, y2) for i, x1, x2, y1, y2 in rows], "image_id long, x1 long, y1 long, x2 long, y2 long")
    monkeypatch.setattr(pictures, "PAINTED", 3 * 30 * 60 * 3)
    whole = pictures._corners_by_image(boxes).toArrow().combine_chunks().to_batches()
    sizes = [b.num_rows for b in pictures._drawn(60, 30)(iter(whole))]
    assert max(sizes) == 3 and sum(sizes) == 40
    drawn = pictures.painted_boxes(boxes, 60, 30)
    columns = ["image_id", "box_idx", "x", "y", "w", "h", "brightness", "contour_area"]
    want = sorted(tuple(r) for r in pictures.contours(drawn).select(*columns).collect())
    found = pictures.painted_contours(boxes, 60, 30)
    assert found.columns == columns and len(want) > 40 and sorted(tuple(r) for r in found.collect()) == want
    assert pictures.painted_contours(boxes.limit(0), 60, 30).count() == pictures.painted_boxes(boxes.limit(0), 60, 30).count() == 0


def boxes_run_together(boxes):
    """Bounding boxes (x, y, w, h) of the components of boxes whose closed rectangles meet."""
    met = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    left, found = [b for b in boxes if any(met(b, other) for other in boxes)], []
    while left:
        part, left = left[:1], left[1:]
        for box in part:
            part += [b for b in left if met(box, b)]
            left = [b for b in left if not met(box, b)]
        x1, y1, x2, y2 = (f(c) for f, c in zip((min, min, max, max), zip(*part)))
        found.append((x1, y1, x2 - x1, y2 - y1))
    return sorted(found)


#: Four bars around a gap with a box in it, a box that touches a corner, one that touches nothing.
RING = [(0, 0, 50, 10), (0, 40, 50, 50), (0, 10, 10, 40), (40, 10, 50, 40), (20, 20, 30, 30), (50, 50, 55, 55), (60, 0, 65, 5)]
RING_PARTS = [(0, 0, 55, 55), (20, 20, 10, 10), (60, 0, 5, 5)]


def test_a_part_in_the_gap_of_another_counts(spark):
    rows = [(image, *b) for image in (None, 7, 8) for b in RING] + [(9, None, 0, 5, 5)]
    boxes = spark.createDataFrame(rows, "image_id long, x1 long, y1 long, x2 long, y2 long")
    for tasks in (None, 3):
        assert sorted(tuple(r) for r in pictures.painted_parts(boxes, tasks).collect()) == [(image, *p) for image in (7, 8) for p in RING_PARTS]
    assert pictures.painted_parts(boxes.limit(0)).count() == 0


def test_painted_parts_of_a_table_with_a_ring(spark, tmp_path):
    """The query, whose SQL counts what another part encloses, on lines whose boxes make such a ring."""
    lines = [(28, 5, 69, 4), (28, 5, 42, 4), (7, 5, 170, 7), (1, 5, 92, 1), (0, 5, 268, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["painted_parts"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(5, 66, 65, 93, 99), (5, 101, 104, 20, 25)]


@pytest.mark.parametrize("size, most, pairs", [(12, 40, 1 << 20), (60, 40, 7), (400, 400, 50), (30, 3, 1 << 20)])
def test_boxes_together(monkeypatch, size, most, pairs):
    """Few and crowded boxes, also turned inside out, in blocks of some pairs; images that are painted and such that aren't."""
    monkeypatch.setattr(outlines, "PAIRS", pairs)
    rnd, rows, want = random.Random(size), [], []
    for image in range(30):
        least = -2 if image % 2 else 1
        own = [(x, y, x + rnd.randint(least, 9), y + rnd.randint(least, 9)) for x, y in ((rnd.randint(-5, size), rnd.randint(-5, size)) for _ in range(rnd.randint(1, most)))]
        rows += [(image, *b) for b in own]
        want += [(image, *p) for p in boxes_run_together(own)]
    image, *corners = np.array(rows).T
    at, *box = outlines.boxes_together(image, *corners)
    assert sorted(zip(image[at].tolist(), *(c.tolist() for c in box))) == want
    assert all(len(c) == 0 for c in outlines.boxes_together(image[:0], *(c[:0] for c in corners)))


def test_images_over_many_batches():
    """An image that goes on in the next batches, images that end with their batch: each is found once, and no more than one waits."""
    rnd = random.Random(3)
    rows = [(i, x, y, x + 8, y + 8) for i in range(40) for x, y in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(10 if i < 20 else rnd.randint(1, 35)))]
    want = sorted((i, *p) for i in range(40) for p in boxes_run_together([b[1:] for b in rows if b[0] == i]))
    table = pa.table([list(c) for c in zip(*rows)], ["image_id", "x1", "y1", "x2", "y2"])
    for size in (1, 10, 17, 10**4):
        read = []
        batches = (read.append(b.num_rows) or b for b in [table.to_batches()[0].slice(0, 0), *table.to_batches(size)])
        got = []
        for out in pictures._boxes_together(batches):
            got += list(zip(*out.to_pydict().values()))
            assert sum(read) - sum(r[0] <= out["image_id"][-1].as_py() for r in rows) <= size
        assert sorted(got) == want


def test_a_crowded_image_is_not_compared_pair_by_pair():
    """10^5 boxes of one small picture: painted, as their pairs would be some 10^9."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 450, 100_000), rng.integers(0, 300, 100_000)
    w, h = rng.integers(20, 60, (2, 100_000))
    began = time.time()
    at, *box = outlines.boxes_together(np.zeros(100_000, int), x, y, x + w, y + h)
    assert time.time() - began < 5 and [int(c[0]) for c in box] == [x.min(), y.min(), (x + w).max() - x.min(), (y + h).max() - y.min()] and len(at) == 1


def test_yellow_of_flat_and_of_noisy_pictures():
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    flat = np.kron(rng.integers(0, 2, (4, 5, 1)), np.ones((6, 8, 1))).astype(np.uint8) * np.array([0, 220, 230], np.uint8)
    for picture in (noise, flat, flat[:1, :1], flat[:0]):
        assert (pictures.yellow(picture) == in_range(hsv(picture), *pictures.YELLOW)).all()
