"""The ordered folds against plain loops."""

import random
import time

import pytest

from boxmill.operators import folds

PRED = "image_id long, box_idx long, cls long, x1 long, y1 long, x2 long, y2 long, score double"
GT = "image_id long, box_idx long, cls long, x1 long, y1 long, x2 long, y2 long"


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b):
    return inter(a, b) / (area(a) + area(b) - inter(a, b)) if inter(a, b) else 0.0


def cover(a, b):
    return inter(a, b) / area(a) if area(a) else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    make = lambda: (lambda x, y: (x, y, x + rnd.randint(0, 30), y + rnd.randint(1, 30)))(rnd.randint(-5, 80), rnd.randint(-5, 60))
    pred = {i: [(k, rnd.randrange(3), make(), rnd.randint(0, 9) / 10) for k in range(1, rnd.randint(1, 25))] for i in range(40)}
    gt = {i: [(k, rnd.randrange(3), make()) for k in range(1, rnd.randint(1, 25))] for i in range(5, 45)}
    p = spark.createDataFrame([(i, k, c, *b, s) for i, bs in pred.items() for k, c, b, s in bs], PRED)
    g = spark.createDataFrame([(i, k, c, *b) for i, bs in gt.items() for k, c, b in bs], GT)
    return pred, gt, p, g


def by_score(boxes):
    return sorted(boxes, key=lambda b: (-b[3], b[0]))


def keys(df):
    return sorted((r.image_id, r.box_idx) for r in df.collect())


def test_suppress(data):
    pred, _, p, _ = data
    want = []
    for i, boxes in pred.items():
        kept = []
        for b in by_score(boxes):
            if all(iou(k[2], b[2]) <= 0.4 for k in kept):
                kept.append(b)
        want += [(i, b[0]) for b in kept]
    assert keys(folds.suppress(p, 0.4)) == sorted(want)


def test_suppress_contained(data):
    pred, _, p, _ = data
    want = [(i, a[0]) for i, boxes in pred.items() for a in boxes if area(a[2]) and not any(b is not a and b[3] >= a[3] and cover(a[2], b[2]) >= 0.5 for b in boxes)]
    assert any(not area(b[2]) for boxes in pred.values() for b in boxes)
    assert keys(folds.suppress_contained(p, 0.5)) == sorted(want)


def test_boxes_without_area_go_alone_or_best(spark):
    rows = [(1, 1, 0, 5, 5, 5, 9, 0.9), (2, 1, 0, 5, 5, 5, 9, 0.9), (2, 2, 0, 0, 0, 9, 9, 0.1)]
    assert keys(folds.suppress_contained(spark.createDataFrame(rows, PRED), 0.5)) == [(2, 2)]


@pytest.mark.parametrize("rule", ["model", "rules"])
def test_match(data, rule):
    pred, gt, p, g = data
    fits = {
        "model": lambda q, h: q[1] == h[1] and (iou(q[2], h[2]) >= 0.5 or cover(q[2], h[2]) >= 0.9 or cover(h[2], q[2]) >= 0.9),
        "rules": lambda q, h: cover(q[2], h[2]) >= 0.5,
    }[rule]
    want = []
    for i in pred.keys() | gt.keys():
        free = list(gt.get(i, []))
        for q in by_score(pred.get(i, [])):
            hit = next((h for h in free if fits(q, h)), None)
            if hit:
                free.remove(hit)
            want.append((i, q[0], q[1], "TP" if hit else "FP"))
        want += [(i, h[0], h[1], "FN") for h in free]
    condition = folds.fits_model(0.5, 0.9) if rule == "model" else folds.fits_rules(0.5)
    got = sorted((r.image_id, r.box_idx, r.cls, r.outcome) for r in folds.match(p, g, condition).collect())
    assert got == sorted(want)


def test_remove_overlaps(data):
    _, gt, _, g = data
    want = []
    for i, boxes in gt.items():
        left = sorted(boxes)
        while left:
            head, rest, alive = left[0], [], True
            for b in left[1:]:
                if not alive or not inter(head[2], b[2]):
                    rest.append(b)
                elif area(head[2]) >= area(b[2]):
                    continue
                else:
                    alive = False
                    rest.append(b)
            if alive:
                want.append((i, head[0]))
            left = rest
    assert keys(folds.remove_overlaps(g)) == sorted(want)


def test_order_decides_who_stays(spark):
    chain = {"A": (0, 0, 10, 10), "B": (8, 0, 17, 10), "C": (15, 0, 23, 10)}
    kept = lambda order: [order[r.box_idx] for r in folds.remove_overlaps(spark.createDataFrame([(1, k, 0, *chain[n]) for k, n in enumerate(order)], GT)).orderBy("box_idx").collect()]
    assert kept("CBA") == ["A"] and sorted(kept("ABC")) == ["A", "C"]


def test_a_crowd_that_overlaps_little_is_walked_in_seconds(spark):
    """Boxes of which few meet: what a turn leaves isn't put together box by box."""
    boxes = spark.range(1500).selectExpr("1L AS image_id", "id AS box_idx", "id * 10 AS x1", "0L AS y1", "id * 10 + IF(id % 100 = 0, 15, 10) AS x2", "10L AS y2")
    began = time.time()
    kept = {r.box_idx for r in folds.remove_overlaps(boxes).collect()}
    assert kept == {i for i in range(1500) if i % 100 != 1} and time.time() - began < 15
