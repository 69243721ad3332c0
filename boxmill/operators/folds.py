"""Greedy per-image operators: folds over the arrays of boxes of an image.

per_image() gathers an image's boxes in one row, the only shuffle there is; all that follows are expressions on that row, by higher-order
functions without Python workers. So several steps after each other cost no more shuffles than one. Boxes are told apart by
comparing edges before anything is computed. The work grows with the square of an image's boxes (tens, some thousands at most); for more there are
the same operators in boxmill.operators.crowded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.functions.boxes import Corners, area, containment, intersection, iou

BOX = ("x1", "y1", "x2", "y2")
#: Whether a prediction fits a box, from both boxes and both classes.
Fits = Callable[[Corners, Corners, Column, Column], Column]


def _corners(box: Column) -> Corners:
    return Corners(*(box[c] for c in BOX))


def _meet(a: Corners, b: Corners) -> Column:
    """Whether two boxes have area in common: what is cheap to tell, and false for most."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used in lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prediction() -> Column:
    """A row's prediction as an element that sorts by score, best first, and box_idx."""
    return F.struct((-F.col("score")).alias("rank"), "box_idx", "cls", *BOX, "score")


def labelled() -> Column:
    """A row's labelled box as an element that sorts by box_idx."""
    return F.struct("box_idx", "cls", *BOX)


def gathered(name: str, item: Column) -> Column:
    """An image's items in order; null ones are left out."""
    return F.array_sort(F.collect_list(item)).alias(name)


def per_image(pred: DataFrame | None = None, gt: DataFrame | None = None) -> DataFrame:
    """(image_id, pred, gt): a row for each image that has boxes on either side, with arrays of them, empty where it has none."""
    p = pred.select("image_id", prediction().alias("p")) if pred is not None else None
    g = gt.select("image_id", labelled().alias("g")) if gt is not None else None
    rows = p.unionByName(g, allowMissingColumns=True) if p is not None and g is not None else p if g is None else g
    return rows.groupBy("image_id").agg(*[gathered(name, F.col(c)) for name, c in (("pred", "p"), ("gt", "g")) if c in rows.columns])


def suppressed(boxes: Column, threshold: float) -> Column:
    """Non-maximum suppression across classes over an array of predictions: one goes if it overlaps a better kept one by IoU above the threshold."""
    def step(kept: Column, b: Column) -> Column:
        rival = F.exists(kept, lambda k: _meet(_corners(k), _corners(b)) & (iou(_corners(k), _corners(b)) > threshold))
        return F.when(rival, kept).otherwise(F.concat(kept, F.array(b)))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


def uncovered(boxes: Column, threshold: float) -> Column:
    """The predictions that have an area of which no other one, no worse in score, covers at least the threshold's share.

    Suppressed boxes still suppress, so two boxes of equal score may drop each other.
    """
    def covers(a: Column, b: Column) -> Column:
        return (b["box_idx"] != a["box_idx"]) & (b["score"] >= a["score"]) & _meet(_corners(a), _corners(b)) & (containment(_corners(a), _corners(b)) >= threshold)

    return F.filter(boxes, lambda a: (area(_corners(a)) != 0) & ~F.exists(boxes, lambda b: covers(a, b)))


def matched(pred: Column, gt: Column, fits: Fits) -> Column:
    """Greedy one-to-one matching: predictions in order each take the first free box of gt that fits. An array of (box_idx, gt_idx)."""
    def take(taken: Column, q: Column) -> Column:
        may = F.filter(gt, lambda h: fits(_corners(q), _corners(h), q["cls"], h["cls"]) & ~F.exists(taken, lambda t: t["gt_idx"] == h["box_idx"]))
        pair = lambda h: F.struct(q["box_idx"].alias("box_idx"), h["box_idx"].alias("gt_idx"))
        return F.concat(taken, F.transform(F.slice(may, 1, 1), pair))

    return F.aggregate(pred, F.from_json(F.lit("[]"), "array<struct<box_idx:bigint,gt_idx:bigint>>"), take)


def outcomes(images: DataFrame, fits: Fits, name: str = "outcome") -> DataFrame:
    """(image_id, cls, box_idx, outcome, place, score, x1, y1, x2, y2) from rows (image_id, pred, gt): TP and FP for predictions, with their place among the
    image's predictions of that outcome, FN for boxes of gt that stay free."""
    found = images.withColumn("hits", matched(F.col("pred"), F.col("gt"), fits))
    taken = lambda b, key: F.exists("hits", lambda t: t[key] == b["box_idx"])

    def rows(boxes: Column, outcome: str, scored: bool = True) -> Column:
        score = lambda b: b["score"] if scored else F.lit(None).cast("double")
        row = lambda b, i: F.struct(b["cls"].alias("cls"), b["box_idx"].alias("box_idx"), F.lit(outcome).alias(name), i.cast("long").alias("place"), score(b).alias("score"), *[b[c].alias(c) for c in BOX])
        return F.transform(boxes, row)

    tp, fp = F.filter("pred", lambda b: taken(b, "box_idx")), F.filter("pred", lambda b: ~taken(b, "box_idx"))
    fn = F.filter("gt", lambda b: ~taken(b, "gt_idx"))
    every = F.concat(rows(tp, "TP"), rows(fp, "FP"), rows(fn, "FN", scored=False))
    return found.select("image_id", F.explode(every).alias("b")).select("image_id", "b.*")


def suppress(pred: DataFrame, threshold: float) -> DataFrame:
    """suppressed() for rows (image_id, box_idx, cls, x1, y1, x2, y2, score); equal scores go by box_idx."""
    return _rows(per_image(pred).select("image_id", suppressed(F.col("pred"), threshold).alias("pred")))


def suppress_contained(pred: DataFrame, threshold: float) -> DataFrame:
    """uncovered() for rows (image_id, box_idx, cls, x1, y1, x2, y2, score). Boxes without area go."""
    return _rows(per_image(pred).select("image_id", uncovered(F.col("pred"), threshold).alias("pred")))


def _rows(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.explode("pred").alias("b")).select("image_id", *[f"b.{c}" for c in ("box_idx", "cls", *BOX, "score")])


def match(pred: DataFrame, gt: DataFrame, fits: Fits, name: str = "outcome") -> DataFrame:
    """(image_id, cls, box_idx, outcome): TP and FP for predictions, with the prediction's class, FN for boxes of gt that stay free, with their own."""
    return outcomes(per_image(pred, gt), fits, name).select("image_id", "cls", "box_idx", name)


def fits_model(overlap: float, cover: float) -> Fits:
    """Same class, and IoU or either containment high enough, all above 0: the rule for a model's predictions."""
    return lambda a, b, of_a, of_b: (of_a == of_b) & _meet(a, b) & ((iou(a, b) >= overlap) | (containment(a, b) >= cover) | (containment(b, a) >= cover))


def fits_rules(cover: float) -> Fits:
    """Enough of the prediction inside the box, more than nothing, whatever the classes: the rule for boxes made by colour rules."""
    return lambda a, b, of_a, of_b: _meet(a, b) & (containment(a, b) >= cover)


def remove_overlaps(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of two overlapping boxes of an image the smaller goes, of equal ones the later; touching isn't overlapping.

    The first box left meets all after it: a smaller one goes, and a larger one makes the first go and ends its
    turn. So who stays depends on the order, by box_idx. Input: (image_id, box_idx, x1, y1, x2, y2), and so the output;
    with other keys than image_id, boxes meet that are equal in these.
    """
    keys = keys or ["image_id"]
    return without_overlaps(boxes, keys).select(*keys, F.explode("kept").alias("b")).select(*keys, "b.box_idx", *[f"b.{c}" for c in BOX])


def without_overlaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, kept): the number of an image's boxes, and an array of those that remove_overlaps() keeps."""
    item = F.struct("box_idx", *BOX)
    images = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    empty = F.slice("boxes", 1, 0)

    def hits(head: Column, b: Column) -> Column:
        return _meet(_corners(head), _corners(b)) & (intersection(_corners(head), _corners(b)) > 0)

    def beaten(acc: Column, head: Column, tail: Column) -> Column:
        """What a head that overlaps something leaves: from the first larger box on all stays, before it what doesn't overlap."""
        larger = F.transform(tail, lambda b: hits(head, b) & (area(_corners(b)) > area(_corners(head))))
        rest = lambda end: F.filter(tail, lambda b, i: ((end > 0) & (i + 1 >= end)) | ~hits(head, b))
        return _bound(F.array_position(larger, True), lambda end: F.struct(rest(end).alias("left"), F.when(end > 0, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(head))).alias("kept")))

    def turn(acc: Column, _: Column) -> Column:
        def met(x: Column) -> Column:
            head, tail = x["head"], x["tail"]
            alone = F.struct(tail.alias("left"), F.concat(acc["kept"], F.array(head)).alias("kept"))
            return F.when(F.exists(tail, lambda b: hits(head, b)), beaten(acc, head, tail)).otherwise(alone)

        first = F.struct(F.get(acc["left"], F.lit(0)).alias("head"), F.slice(acc["left"], 2, F.greatest(F.size(acc["left"]), F.lit(1))).alias("tail"))
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(_bound(first, met))

    start = F.struct(F.col("boxes").alias("left"), empty.alias("kept"))
    done = F.aggregate("boxes", start, turn)
    return images.select(*keys, F.size("boxes").cast("long").alias("n"), done["kept"].alias("kept"))
