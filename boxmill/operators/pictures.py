"""Tables of pictures (raw bytes, height x width x 3, blue-green-red) to tables of contours, tiles, masks and aligned pictures.

Table functions in Python give a row's many results one at a time; the union of masks is an aggregate in two levels. A picture has to fit a task, a group of them doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmill.functions import outlines, rasters
from boxmill.functions.pixels import homography, hsv, in_range

#: Hue, saturation and value of the traps' yellow, from and to.
YELLOW = ((20, 100, 100), (30, 255, 255))
#: Bytes of a mask that are joined as one row.
CHUNK = 1 << 16
#: Bytes that a task of the first level holds before it gives them on.
HELD = 1 << 26
#: Bytes of painted pictures that a task gives on at once.
PAINTED = 1 << 24


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, of) for name, of in types.items()])


_POINTS = T.ArrayType(_fields(x=T.IntegerType(), y=T.IntegerType()))
_CONTOUR = _fields(**dict.fromkeys(("box_idx", "x", "y", "w", "h"), T.IntegerType()), brightness=T.DoubleType(), contour_area=T.DoubleType())
_TILE = _fields(**dict.fromkeys(("tile_id", "tile_x", "tile_y"), T.IntegerType()), tile=T.BinaryType())


def _picture(content: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(height, width, 3)


def yellow(picture: np.ndarray) -> np.ndarray:
    """Whether each pixel is yellow. Pixels like the one before have its answer, so that flat areas cost little."""
    pixels = picture.reshape(-1, 3)
    new = pixels[1:] != pixels[:-1]
    starts = np.flatnonzero(new[:, 0] | new[:, 1] | new[:, 2]) + 1
    if 4 * len(starts) >= len(pixels):
        return in_range(hsv(picture), *YELLOW)
    starts = np.append(0, starts)
    found = in_range(hsv(pixels[starts]), *YELLOW)
    return np.repeat(found, np.diff(np.append(starts, len(pixels)))).reshape(picture.shape[:-1])


@F.pandas_udf(T.BinaryType())
def yellow_mask(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """A byte for each pixel: 255 where it is yellow, else 0. Null pictures have null masks."""
    one = lambda d, h, w: None if d is None else np.where(yellow(_picture(d, int(h), int(w))), 255, 0).astype(np.uint8).tobytes()
    return pd.Series([one(*r) for r in zip(content, height, width, strict=True)], dtype="object")


@F.pandas_udf(_fields(outline=_POINTS, area=T.DoubleType(), corners=_POINTS))
def trap(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The largest yellow part of a picture: its outline, area, and its four corners in order, or none if it hasn't four."""
    points = lambda a: [{"x": int(x), "y": int(y)} for x, y in a]
    rows = []
    for d, h, w in zip(content, height, width, strict=True):
        if d is None:
            rows.append((None, None, None))
            continue
        mask = yellow(_picture(d, int(h), int(w)))
        outline = outlines.largest_outline(mask)
        area = outlines.parts(mask).area
        rows.append((points(outline), float(area.max()) if len(area) else 0.0, points(outlines.four_corners(outline))))
    return pd.DataFrame(rows, columns=["outline", "area", "corners"])


@F.pandas_udf(_POINTS)
def simplified_polygon(polygon: pd.Series, epsilon: pd.Series) -> pd.Series:
    """The corners of a closed polygon after Douglas and Peucker, for arrays of (x, y)."""
    def one(points: np.ndarray | None, e: float) -> list[dict] | None:
        if points is None:
            return None
        found = outlines.simplified(np.array([(p["x"], p["y"]) for p in points]).reshape(-1, 2), e)
        return [{"x": int(x), "y": int(y)} for x, y in found]

    return pd.Series([one(p, e) for p, e in zip(polygon, epsilon, strict=True)], dtype="object")


def _parts(picture: np.ndarray) -> outlines.Parts:
    """The outermost parts of what is not yellow, with the brightness of their pixels."""
    return outlines.parts(~yellow(picture), np.maximum(np.maximum(picture[..., 0], picture[..., 1]), picture[..., 2]))


@F.udtf(returnType=_CONTOUR)
class ContourRows:
    """Rows for the outermost parts of what is not yellow in a picture, from the bottom up, as boxmill.operators.rules takes them."""

    def eval(self, content: bytes, height: int, width: int):
        if content is not None:
            found = _parts(_picture(content, height, width))
            for k in range(len(found.area)):
                yield k, int(found.x[k]), int(found.y[k]), int(found.w[k]), int(found.h[k]), float(found.mean[k]), float(found.area[k])


@F.udtf(returnType=_TILE)
class TileRows:
    """Rows for the tiles of a picture, by rows of tiles; the padding is `fill`."""

    def eval(self, content: bytes, height: int, width: int, size: int, stride: int, fill: int, whole: bool):
        if content is not None:
            for k, (x, y, tile) in enumerate(rasters.tiles(_picture(content, height, width), size, stride, fill, whole)):
                yield k, x, y, tile.tobytes()


def contours(pictures: DataFrame) -> DataFrame:
    """Adds box_idx, x, y, w, h, brightness and contour_area to pictures (content, height, width, ...): a row for each contour. Pictures without contours give none."""
    found = ContourRows(*[F.col(c).outer() for c in ("content", "height", "width")])
    return pictures.lateralJoin(found).drop("content")


def _corners_by_image(boxes: DataFrame) -> DataFrame:
    """(image_id, corners): the boxes of each image as an array."""
    rows = boxes.groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("corners"))
    # The boxes are few bytes, what is painted is not: as many tasks as the session has for a shuffle, and not as few as the boxes' size asks for. By a hash, since
    # Spark drops a repartition by the column that the rows are dealt out by already.
    return rows.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("image_id"))


def _painted(batch: pa.RecordBatch, height: int, width: int) -> Iterator[np.ndarray]:
    """The pictures of a batch of _corners_by_image(), one at a time."""
    lists = batch.column("corners")
    x1, y1, x2, y2 = (np.maximum(lists.values.field(c).to_numpy(zero_copy_only=False), 0).tolist() for c in ("x1", "y1", "x2", "y2"))
    cuts = lists.offsets.to_pylist()
    for first, last in zip(cuts, cuts[1:]):
        picture = np.full((height, width, 3), (0, 255, 255), np.uint8)
        for k in range(first, last):
            picture[y1[k] : y2[k], x1[k] : x2[k]] = 0
        yield picture


def _drawn(width: int, height: int):
    """The pictures of batches of _corners_by_image() as batches (image_id, content) of PAINTED bytes at most, or of one picture."""
    most = max(1, PAINTED // max(1, height * width * 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                yield pa.RecordBatch.from_arrays([some.column("image_id"), pa.array([p.tobytes() for p in _painted(some, height, width)], pa.binary())], ["image_id", "content"])

    return run


def painted_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, content, height, width): yellow pictures of that size with the boxes (image_id, x1, y1, x2, y2) painted dark; what lies outside is cut off."""
    rows = _corners_by_image(boxes)
    drawn = rows.mapInArrow(_drawn(width, height), T.StructType([rows.schema["image_id"], T.StructField("content", T.BinaryType())]))
    return drawn.select("image_id", "content", F.lit(height).alias("height"), F.lit(width).alias("width"))


def painted_contours(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """contours() of painted_boxes(), as (image_id, box_idx, x, y, w, h, brightness, contour_area): each picture is painted and searched in its task before the next one,
    so that no picture is handed on and a task holds one of them."""
    rows = _corners_by_image(boxes)
    names = [f.name for f in _CONTOUR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parts(p) for p in _painted(batch, height, width)]
            counts = np.array([len(f.area) for f in found], np.int64)
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            whole = [number, *(np.concatenate([getattr(f, c) for f in found]) for c in ("x", "y", "w", "h", "mean", "area"))]
            arrays = [pa.array(v, t) for v, t in zip(whole, [pa.int32()] * 5 + [pa.float64()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), *arrays], ["image_id", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["image_id"], *_CONTOUR]))


def _boxes_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """outlines.boxes_together() of boxes sorted by image; an image that goes on in the next batch waits for it."""
    def found(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(some).combine_chunks()
        ids, *corners = (rows.column(c).combine_chunks() for c in ("image_id", "x1", "y1", "x2", "y2"))
        values = ids.to_numpy(zero_copy_only=False)
        image = np.cumsum(np.append(0, values[1:] != values[:-1]))
        at, *box = outlines.boxes_together(image, *(c.to_numpy().astype(np.int64) for c in corners))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, box)], ["image_id", "x", "y", "w", "h"])

    held, before = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("image_id").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(values != values[-1])
        start = int(others[-1]) + 1 if len(others) else 0
        if start or (held and values[-1] != before):
            yield found([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        before = values[-1]
    if held:
        yield found(held)


def painted_parts(boxes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(image_id, x, y, w, h): the bounding boxes of what boxes (image_id, x1, y1, x2, y2; whole numbers) run together to when they are painted, corner to corner too.

    As painted_contours(), but worked out from the corners; a part that lies in another one's gap is a row of its own, and nothing is cut off. Boxes without an image or a corner don't count. A task
    holds a batch of boxes and those of one image. Images are dealt to `tasks` tasks where that is given, otherwise to as many as the session's settings say.
    """
    rows = boxes.select("image_id", "x1", "y1", "x2", "y2").dropna()
    rows = (rows.repartition(tasks, "image_id") if tasks else rows.repartition("image_id")).sortWithinPartitions("image_id")
    return rows.mapInArrow(_boxes_together, T.StructType([rows.schema["image_id"], *_fields(**dict.fromkeys(("x", "y", "w", "h"), T.LongType()))]))


def pixel_tiles(pictures: DataFrame, size: int = 640, stride: int = 440, fill: int = 114, whole: bool = True) -> DataFrame:
    """Adds tile_id, tile_x, tile_y and tile (raw bytes) to pictures (content, height, width, ...), whose content goes.

    whole pads to a multiple of `size`, else to where windows every `stride` cover everything.
    """
    found = TileRows(*[F.col(c).outer() for c in ("content", "height", "width")], *[F.lit(v) for v in (size, stride, fill, whole)])
    return pictures.lateralJoin(found).drop("content")


def cleaned_masks(masks: DataFrame, denoise: int = 9, grow: int = 0) -> DataFrame:
    """masks (content: a byte for each pixel, height, width, ...) without dark specks smaller than `denoise`, with lines thicker by `grow` pixels."""

    @F.pandas_udf(T.BinaryType())
    def clean(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def one(d: bytes | None, h: float, w: float) -> bytes | None:
            if d is None:
                return None
            mask = np.frombuffer(d, np.uint8).reshape(int(h), int(w))
            mask = rasters.denoised(mask, denoise) if denoise else mask
            return (rasters.grown(mask, grow) if grow else mask).tobytes()

        return pd.Series([one(*r) for r in zip(content, height, width, strict=True)], dtype="object")

    return masks.withColumn("content", clean("content", "height", "width"))


def _joined(keys: list[str], held: int):
    """AND of the content of rows with the same keys, for mapInArrow: of those that a task holds at once; with held = 0 of those that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}

        def rows(names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in seen], t) for i, t in enumerate(types[:-1])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in seen.values()], pa.binary())], names)

        names, types, size = None, None, 0
        for batch in batches:
            names, types = batch.schema.names, list(batch.schema.types)
            for key, content in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("content")):
                part = np.frombuffer(content.as_buffer(), np.uint8)
                if key in seen:
                    seen[key] &= part
                    continue
                if seen and size + len(part) > held:
                    yield rows(names, types)
                    seen.clear()
                    size = 0
                seen[key] = part.copy()
                size += len(part)
        if seen:
            yield rows(names, types)

    return run


def joined_masks(masks: DataFrame, group: str) -> DataFrame:
    """(group, size, content): the bitwise AND of all masks (group, content) of a group, so that what is dark in one of them is dark.

    Masks are cut into pieces; a task joins what it has of a piece, then the tasks' results meet by piece and are joined as they stream by. So neither a
    group nor a piece of it has to fit a task, whatever the number of masks. Masks of different sizes in a group give a row for each size. Null masks don't count.
    """
    size = F.octet_length("content")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("content"), i * CHUNK + 1, F.lit(CHUNK)))
    rows = masks.where("content IS NOT NULL").select(F.col(group).alias("group"), size.alias("size"), F.posexplode(pieces).alias("piece", "content"))
    keys = ["group", "size", "piece"]
    part = rows.select(*keys, "content").mapInArrow(_joined(keys, HELD), rows.select(*keys, "content").schema)
    # Sorted runs of a key follow each other, so one row is held at a time.
    whole = part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joined(keys, 0), part.schema)
    met = whole.groupBy("group", "size").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("pieces"))
    content = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    return met.select(F.col("group").alias(group), "size", content.alias("content"))


def aligned_masks(rows: DataFrame, vertical: Column | None = None, most: float = 500) -> DataFrame:
    """Adds `aligned` to rows (mask, mask_height, mask_width, height, width, source, target): the mask under the map that takes the four points of
    source to those of target, as large as the picture; then moved down by `vertical`, unless that is null or more than `most` rows. Null where a side hasn't four points."""

    @F.pandas_udf(T.BinaryType())
    def align(mask: pd.Series, mh: pd.Series, mw: pd.Series, h: pd.Series, w: pd.Series, source: pd.Series, target: pd.Series, dy: pd.Series) -> pd.Series:
        def one(d: bytes | None, mh: float, mw: float, h: float, w: float, a: np.ndarray | None, b: np.ndarray | None, dy: float | None) -> bytes | None:
            if d is None or a is None or b is None or len(a) != 4 or len(b) != 4:
                return None
            points = [np.array([(p["x"], p["y"]) for p in side], float) for side in (a, b)]
            out = rasters.warped(np.frombuffer(d, np.uint8).reshape(int(mh), int(mw)), homography(*points), int(w), int(h))
            return (out if dy is None or np.isnan(dy) or abs(dy) > most else rasters.shifted_down(out, dy)).tobytes()

        return pd.Series([one(*r) for r in zip(mask, mh, mw, h, w, source, target, dy, strict=True)], dtype="object")

    shift = F.lit(None).cast("double") if vertical is None else vertical.cast("double")
    return rows.withColumn("aligned", align("mask", "mask_height", "mask_width", "height", "width", "source", "target", shift))


@F.pandas_udf(T.BinaryType())
def without_grid(content: pd.Series, mask: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The picture with yellow where the mask is dark."""
    def one(d: bytes | None, m: bytes | None, h: float, w: float) -> bytes | None:
        if d is None or m is None:
            return d
        return rasters.painted(_picture(d, int(h), int(w)), np.frombuffer(m, np.uint8).reshape(int(h), int(w))).tobytes()

    return pd.Series([one(*r) for r in zip(content, mask, height, width, strict=True)], dtype="object")


@F.pandas_udf(T.BinaryType())
def turned(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The picture turned by 180 degrees."""
    return pd.Series([None if d is None else rasters.half_turned(_picture(d, int(h), int(w))).tobytes() for d, h, w in zip(content, height, width, strict=True)], dtype="object")
