import math
import random

from pyspark.sql import functions as F

from boxmill.functions import boxes as B


def one(spark, values, **columns):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_label_round_trip(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(100, 6000), rnd.randint(100, 4000), rnd.random(), rnd.random(), rnd.random() / 4, rnd.random() / 4) for _ in range(300)]
    df = spark.createDataFrame(rows, "width int, height int, xc double, yc double, w double, h double")
    c = B.corners_from_label(B.label(), F.col("width"), F.col("height"))
    back = B.label_from_corners(c, F.col("width"), F.col("height"))
    for r in df.select("*", *[v.alias("b_" + k) for k, v in back._asdict().items()], *[v.alias(k) for k, v in c._asdict().items()]).collect():
        assert all(abs(r[k] - r["b_" + k]) < 1e-12 for k in ("xc", "yc", "w", "h"))
        assert abs(r.x1 - (r.xc - r.w / 2) * r.width) < 1e-9 and abs(r.y2 - (r.yc + r.h / 2) * r.height) < 1e-9


def test_whole_rectangles_are_cut_towards_zero(spark):
    got = one(spark, {"xc": 0.01, "yc": 0.5, "w": 0.055, "h": 0.1}, **B.rect_from_label(B.label(), F.lit(100), F.lit(55))._asdict())
    assert got == {"x": int(1.0 - 5 / 2), "y": int(27.5 - 5 / 2), "w": 5, "h": 5}
    assert one(spark, {"x": -7, "y": 3, "w": 5, "h": 5}, **B.scaled_rect(B.rect(), 1.5)._asdict()) == {"x": int(-7 + 2.5 - 3.5), "y": int(3 + 2.5 - 3.5), "w": 7, "h": 7}


def test_the_two_ways_to_clip_differ(spark):
    box = {"x1": -10, "y1": 5, "x2": 20, "y2": 30}
    clipped = B.rect_from_corners(B.clipped(B.corners(), F.lit(100), F.lit(25)))
    assert one(spark, box, **clipped._asdict()) == {"x": 0, "y": 5, "w": 20, "h": 20}
    other = B.clipped_rect(B.rect_from_corners(B.corners()), F.lit(100), F.lit(25))
    assert one(spark, box, **other._asdict()) == {"x": 0, "y": 5, "w": 30, "h": 20}
    for x, out in ((-30, True), (-29, False), (99, False), (100, True)):
        assert one(spark, {"x1": x, "y1": 0, "x2": x + 30, "y2": 5}, o=B.outside(B.corners(), F.lit(100), F.lit(25)))["o"] == out


def test_overlap_ratios(spark):
    rnd = random.Random(2)
    rows = [[rnd.randint(0, 20) for _ in range(8)] for _ in range(500)]
    rows = [(a, b, a + w, b + h, c, d, c + v, d + k) for a, b, w, h, c, d, v, k in rows]
    df = spark.createDataFrame(rows, "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    a, b = B.corners("a_"), B.corners("b_")
    got = df.select("*", B.iou(a, b).alias("iou"), B.containment(a, b).alias("inside"), B.intersection(a, b).alias("both")).collect()
    for r, row in zip(got, rows):
        cells = {(x, y) for x in range(row[0], row[2]) for y in range(row[1], row[3])}
        other = {(x, y) for x in range(row[4], row[6]) for y in range(row[5], row[7])}
        assert r.both == len(cells & other)
        assert math.isclose(r.iou, len(cells & other) / len(cells | other) if cells & other else 0.0)
        assert math.isclose(r.inside, len(cells & other) / len(cells) if cells else 0.0)


def test_two_paddings(spark):
    df = spark.createDataFrame([(n,) for n in (1, 640, 641, 1080, 1081, 6000)], "n int")
    got = [tuple(r) for r in df.select("n", B.padded_to_multiple(F.col("n"), 640).alias("a"), B.padded_to_stride(F.col("n"), 640, 440).alias("b")).collect()]
    assert got == [(1, 640, 640), (640, 640, 640), (641, 1280, 1080), (1080, 1280, 1080), (1081, 1280, 1520), (6000, 6400, 6360)]
