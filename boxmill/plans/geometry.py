"""Queries of box algebra and tiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.functions import boxes as B
from boxmill.operators import tiling
from boxmill.plans.fixture import HEIGHT, WIDTH, boxes, gt_boxes, pred_boxes, sql, tasks
from boxmill.plans.fixture import table as read
from boxmill.plans.registry import query

#: Labels of the gt boxes, as shares of the image, in both dialects.
_LABELS = f"""labels AS (
  SELECT image_id, box_idx, cls, (x1 + x2) / 2.0 / {WIDTH}.0::DOUBLE AS xc, (y1 + y2) / 2.0 / {HEIGHT}.0::DOUBLE AS yc,
    (x2 - x1) / {WIDTH}.0::DOUBLE AS w, (y2 - y1) / {HEIGHT}.0::DOUBLE AS h
  FROM (SELECT image_id, box_idx, cls, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM gt_boxes)
)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gt boxes as label boxes."""
    gt = gt_boxes(spark, sf_dir)
    b = B.label_from_corners(B.Corners(*(F.col(c).cast("double") for c in B.Corners._fields)), F.lit(float(WIDTH)), F.lit(float(HEIGHT)))
    return gt.select("image_id", "box_idx", "cls", b.xc.alias("xc"), b.yc.alias("yc"), b.w.alias("w"), b.h.alias("h"))


@query("corners_to_yolo", f"WITH {sql()}, {_LABELS} SELECT image_id, box_idx, cls, round(xc, 10) AS xc, round(yc, 10) AS yc, round(w, 10) AS w, round(h, 10) AS h FROM labels")
def corners_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).withColumns({c: F.round(c, 10) for c in ("xc", "yc", "w", "h")})


@query(
    "yolo_to_corners",
    f"""WITH {sql()}, {_LABELS}
SELECT image_id, box_idx, cls, round((xc - w / 2) * {WIDTH}, 6) AS x1, round((yc - h / 2) * {HEIGHT}, 6) AS y1, round((xc + w / 2) * {WIDTH}, 6) AS x2, round((yc + h / 2) * {HEIGHT}, 6) AS y2
FROM labels""",
)
def yolo_to_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.corners_from_label(B.label(), F.lit(WIDTH), F.lit(HEIGHT))
    return labels(spark, sf_dir).select("image_id", "box_idx", "cls", *[F.round(c, 6).alias(n) for n, c in b._asdict().items()])


@query(
    "yolo_to_rect",
    f"""WITH {sql()}, {_LABELS}, sized AS (SELECT *, CAST(trunc(w * {WIDTH}) AS INTEGER) AS rw, CAST(trunc(h * {HEIGHT}) AS INTEGER) AS rh FROM labels)
SELECT image_id, box_idx, cls, CAST(trunc(xc * {WIDTH} - rw / 2.0::DOUBLE) AS INTEGER) AS x, CAST(trunc(yc * {HEIGHT} - rh / 2.0::DOUBLE) AS INTEGER) AS y, rw AS w, rh AS h FROM sized""",
)
def yolo_to_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share whose product falls short of a whole pixel loses that pixel, as it is defined."""
    b = B.rect_from_label(B.label(), F.lit(WIDTH), F.lit(HEIGHT))
    return labels(spark, sf_dir).select("image_id", "box_idx", "cls", *[c.alias(n) for n, c in b._asdict().items()])


@query("rotate180", f"WITH {sql()}, {_LABELS} SELECT image_id, box_idx, cls, round(1 - xc, 10) AS xc, round(1 - yc, 10) AS yc, round(w, 10) AS w, round(h, 10) AS h FROM labels")
def rotate180(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.rotated_half_turn(B.label())
    return labels(spark, sf_dir).select("image_id", "box_idx", "cls", *[F.round(c, 10).alias(n) for n, c in b._asdict().items()])


#: Crops follow the image: origin and size from p_size.
_CROPS = "crops AS (SELECT p_partkey AS image_id, CAST(p_size AS BIGINT) * 10 AS dx, CAST(p_size AS BIGINT) * 5 AS dy, 1200 + CAST(p_size AS BIGINT) * 20 AS cw, 700 + CAST(p_size AS BIGINT) * 10 AS ch FROM part)"


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (size * 10).alias("dx"), (size * 5).alias("dy"), (size * 20 + 1200).alias("cw"), (size * 10 + 700).alias("ch"))


@query(
    "crop_clip_labels",
    f"""WITH {sql()}, {_CROPS}, moved AS (
  SELECT image_id, box_idx, cls, x1 - dx AS x1, y1 - dy AS y1, x2 - dx AS x2, y2 - dy AS y2, cw, ch FROM gt_boxes JOIN crops USING (image_id)
), cut AS (
  SELECT image_id, box_idx, cls, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, cw) AS x2, least(y2, ch) AS y2, cw, ch
  FROM moved WHERE NOT (x2 <= 0 OR y2 <= 0 OR x1 >= cw OR y1 >= ch)
)
SELECT image_id, box_idx, cls, round((x1 + x2) / 2.0::DOUBLE / cw, 9) AS xc, round((y1 + y2) / 2.0::DOUBLE / ch, 9) AS yc, round((x2 - x1)::DOUBLE / cw, 9) AS w, round((y2 - y1)::DOUBLE / ch, 9) AS h FROM cut""",
)
def crop_clip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gt_boxes(spark, sf_dir).join(_crops(spark, sf_dir), "image_id")
    cw, ch = F.col("cw"), F.col("ch")
    moved = B.shifted(B.corners(), F.col("dx"), F.col("dy"))
    rows = rows.where(~B.outside(moved, cw, ch))
    b = B.label_from_corners(B.Corners(*(c.cast("double") for c in B.clipped(moved, cw, ch))), cw, ch)
    return rows.select("image_id", "box_idx", "cls", *[F.round(c, 9).alias(n) for n, c in b._asdict().items()])


@query(
    "crop_clip_rectangles",
    f"""WITH {sql()}, {_CROPS}, moved AS (
  SELECT image_id, box_idx, cls, x1 - dx AS x, y1 - dy AS y, x2 - x1 AS w, y2 - y1 AS h, cw, ch FROM gt_boxes JOIN crops USING (image_id)
)
SELECT image_id, box_idx, cls, greatest(x, 0) AS x, greatest(y, 0) AS y, least(w, cw - greatest(x, 0)) AS w, least(h, ch - greatest(y, 0)) AS h
FROM moved WHERE NOT (x + w <= 0 OR y + h <= 0 OR x >= cw OR y >= ch)""",
)
def crop_clip_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gt_boxes(spark, sf_dir).join(_crops(spark, sf_dir), "image_id")
    cw, ch = F.col("cw"), F.col("ch")
    moved = B.shifted(B.corners(), F.col("dx"), F.col("dy"))
    b = B.clipped_rect(B.rect_from_corners(moved), cw, ch)
    return rows.where(~B.outside(moved, cw, ch)).select("image_id", "box_idx", "cls", *[c.alias(n) for n, c in b._asdict().items()])


@query(
    "scale_rect",
    f"""WITH {sql()}, r AS (SELECT image_id, box_idx, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM gt_boxes),
s AS (SELECT *, CAST(trunc(w * 1.5::DOUBLE) AS INTEGER) AS sw, CAST(trunc(h * 1.5::DOUBLE) AS INTEGER) AS sh FROM r)
SELECT image_id, box_idx, CAST(trunc(x + w / 2.0::DOUBLE - sw / 2.0::DOUBLE) AS INTEGER) AS x, CAST(trunc(y + h / 2.0::DOUBLE - sh / 2.0::DOUBLE) AS INTEGER) AS y, sw AS w, sh AS h FROM s""",
)
def scale_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.scaled_rect(B.rect_from_corners(B.corners()), 1.5)
    return gt_boxes(spark, sf_dir).select("image_id", "box_idx", *[c.alias(n) for n, c in b._asdict().items()])


@query(
    "box_features",
    f"""WITH {sql()} SELECT image_id, box_idx, w * h AS area, round(greatest(w, h)::DOUBLE / least(w, h), 9) AS squareness, round(abs(w::DOUBLE / h - 1), 9) AS deviation,
  round(sqrt((w * w + h * h)::DOUBLE), 6) AS diagonal, round(degrees(atan2(h::DOUBLE, w::DOUBLE)), 6) AS angle
FROM (SELECT image_id, box_idx, x2 - x1 AS w, y2 - y1 AS h FROM gt_boxes)""",
)
def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.corners()
    r = B.rect_from_corners(b)
    line = (b.x1, b.y1, b.x2, b.y2)
    return gt_boxes(spark, sf_dir).select(
        "image_id",
        "box_idx",
        B.area(b).alias("area"),
        F.round(B.squareness(r), 9).alias("squareness"),
        F.round(F.abs(r.w.cast("double") / r.h - 1), 9).alias("deviation"),
        F.round(B.line_length(*line), 6).alias("diagonal"),
        F.round(B.line_angle(*line), 6).alias("angle"),
    )


@query(
    "crop_windows",
    f"""WITH {sql()}, c AS (SELECT image_id, box_idx, greatest(0, CAST(floor(x1 / 1.5::DOUBLE) AS BIGINT)) AS x1, greatest(0, CAST(floor(y1 / 1.5::DOUBLE) AS BIGINT)) AS y1,
  least(1000, CAST(ceil(x2 / 1.5::DOUBLE) AS BIGINT)) AS x2, least(600, CAST(ceil(y2 / 1.5::DOUBLE) AS BIGINT)) AS y2 FROM pred_boxes)
SELECT * FROM c WHERE x2 > x1 AND y2 > y1""",
)
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-numbered windows around shrunken boxes on a small image; those without area go, and numbers keep their gaps."""
    small = B.Corners(*(c / 1.5 for c in B.corners()))
    b = B.crop_window(small, F.lit(1000).cast("long"), F.lit(600).cast("long"))
    return pred_boxes(spark, sf_dir).select("image_id", "box_idx", *[c.alias(n) for n, c in b._asdict().items()]).where("x2 > x1 AND y2 > y1")


_PAIRS = """inters AS (
  SELECT p.image_id, p.box_idx AS pred_idx, g.box_idx AS gt_idx, p.w * p.h AS area_p, g.w * g.h AS area_g,
    (least(p.x2, g.x2) - greatest(p.x1, g.x1)) * (least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter
  FROM preds p JOIN gts g ON p.image_id = g.image_id AND p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2
)"""
#: Written once and joined, so that no part of them is worked out for each pair.
_SIDES = "preds AS MATERIALIZED (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM pred_boxes), gts AS MATERIALIZED (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM gt_boxes)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.meeting_pairs(pred_boxes(spark, sf_dir), gt_boxes(spark, sf_dir), ["image_id"], tasks=tasks(spark, sf_dir))


@query("pairwise_iou", f"WITH {sql()}, {_SIDES}, {_PAIRS} SELECT image_id, pred_idx, gt_idx, round(inter::DOUBLE / (area_p + area_g - inter), 9) AS iou FROM inters")
def pairwise_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of all pairs of an image that overlap."""
    p, g = B.corners("a."), B.corners("b.")
    return _pairs(spark, sf_dir).select(F.col("a.image_id").alias("image_id"), F.col("a.box_idx").alias("pred_idx"), F.col("b.box_idx").alias("gt_idx"), F.round(B.iou(p, g), 9).alias("iou"))


@query(
    "containment_ratio",
    f"WITH {sql()}, {_SIDES}, {_PAIRS} SELECT image_id, pred_idx, gt_idx, round(inter::DOUBLE / area_p, 9) AS pred_in_gt, round(inter::DOUBLE / area_g, 9) AS gt_in_pred FROM inters",
)
def containment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = B.corners("a."), B.corners("b.")
    shares = [F.round(B.containment(p, g), 9).alias("pred_in_gt"), F.round(B.containment(g, p), 9).alias("gt_in_pred")]
    return _pairs(spark, sf_dir).select(F.col("a.image_id").alias("image_id"), F.col("a.box_idx").alias("pred_idx"), F.col("b.box_idx").alias("gt_idx"), *shares)


#: Image sizes that follow the part.
_IMAGES = "images AS (SELECT p_partkey AS image_id, 600 + CAST(p_size AS BIGINT) * 50 AS width, 500 + CAST(p_size AS BIGINT) * 30 AS height FROM part)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (size * 50 + 600).alias("width"), (size * 30 + 500).alias("height"))


def _windows_sql(stride: int, width: str = "width", height: str = "height") -> str:
    n = lambda c: f"CASE WHEN {c} >= 640 THEN ({c} - 640) // {stride} + 1 ELSE 0 END"
    return f"""SELECT image_id, r.row * nc + c.col AS tile_id, c.col * {stride} AS tile_x, r.row * {stride} AS tile_y
FROM (SELECT image_id, {n(width)} AS nc, {n(height)} AS nr FROM images), unnest(range(0, nr)) AS r(row), unnest(range(0, nc)) AS c(col)"""


@query("windows_test", f"WITH {_IMAGES} {_windows_sql(420)}")
def windows_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.windows(_images(spark, sf_dir))


@query("tiles_pad640", f"WITH {_IMAGES} {_windows_sql(440, '(ceil(width / 640.0) * 640)::BIGINT', '(ceil(height / 640.0) * 640)::BIGINT')}")
def tiles_pad640(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.windows(tiling.padded_to_tiles(_images(spark, sf_dir)), stride=tiling.STRIDE)


_TO_STRIDE = "(greatest(ceil(({0} - 640) / 440.0), 0) * 440 + 640)::BIGINT"


@query("tiles_padstride", f"WITH {_IMAGES} {_windows_sql(440, _TO_STRIDE.format('width'), _TO_STRIDE.format('height'))}")
def tiles_padstride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.windows(tiling.padded_to_strides(_images(spark, sf_dir)), stride=tiling.STRIDE)


_TILED = f"""tiles AS (SELECT c.col + r.row * 5 AS tile_id, c.col * 440 AS tx, r.row * 440 AS ty FROM range(0, 5) AS c(col), range(0, 3) AS r(row)
), tiled AS (
  SELECT g.*, tile_id, tx, ty FROM gt_boxes g, tiles
  WHERE greatest(0, least(x2, tx + 640) - greatest(x1, tx)) * greatest(0, least(y2, ty + 640) - greatest(y1, ty)) >= 0.8 * (x2 - x1) * (y2 - y1)
)"""


@query(
    "tile_labels",
    f"""WITH {sql()}, {_TILED}, cut AS (
  SELECT *, greatest(x1 - tx, 0) AS a1, greatest(y1 - ty, 0) AS b1, least(x2 - tx, 640) AS a2, least(y2 - ty, 640) AS b2 FROM tiled
)
SELECT image_id, tile_id, box_idx, cls, round((a1 + a2) / 1280.0::DOUBLE, 9) AS xc, round((b1 + b2) / 1280.0::DOUBLE, 9) AS yc, round((a2 - a1) / 640.0::DOUBLE, 9) AS w, round((b2 - b1) / 640.0::DOUBLE, 9) AS h FROM cut""",
)
def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = tiling.tile_labels(tiling.boxes_in_tiles(gt_boxes(spark, sf_dir), WIDTH, HEIGHT))
    return tiled.select("image_id", "tile_id", "box_idx", "cls", *[F.round(c, 9).alias(c) for c in ("xc", "yc", "w", "h")])


@query(
    "tile_background_ratio",
    f"""WITH {sql()}, {_TILED}, every AS (SELECT i.image_id, t.tile_id FROM (SELECT DISTINCT image_id FROM fx) i, tiles t
), counted AS (SELECT image_id, tile_id, count(box_idx) AS n FROM every LEFT JOIN tiled USING (image_id, tile_id) GROUP BY image_id, tile_id)
SELECT count(*) AS n_tiles, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS n_background, round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS background_ratio FROM counted""",
)
def tile_background_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles without a box stay in: they come from the tile grid, not from the boxes."""
    b = boxes(spark, sf_dir)
    images = b.select("image_id").distinct().withColumns({"width": F.lit(WIDTH).cast("long"), "height": F.lit(HEIGHT).cast("long")})
    every = tiling.windows(images, stride=tiling.STRIDE).select("image_id", "tile_id")
    held = tiling.boxes_in_tiles(gt_boxes(spark, sf_dir), WIDTH, HEIGHT).groupBy("image_id", "tile_id").agg(F.count("*").alias("n"))
    empty = F.col("n").isNull()
    counted = every.join(held, ["image_id", "tile_id"], "left")
    return counted.agg(F.count("*").alias("n_tiles"), F.count_if(empty).alias("n_background"), F.round(F.avg(empty.cast("double")), 9).alias("background_ratio"))
