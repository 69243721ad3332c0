import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmill.functions import pixels
from boxmill.operators import metrics, scoring, tiling
from boxmill.operators.catalogue import pair_check
from boxmill.sources import readers, writers
from boxmill.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a/one.txt": "0 0.5 0.5 0.1 0.2\n3 0.25 0.5 0.1 0.1\n", "a/two.txt": "", "b/three.txt": "1 0.1 0.1 0.1 0.1", "b/one.jpg": "x", "top.txt": "1"}.items():
        path = tmp_path / "labels" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "labels")


def test_manifest_has_empty_files(spark, tree):
    files = readers.manifest(spark, tree, count_lines=True)
    got = sorted((r.folder, r.stem, r.extension, r.n_lines) for r in files.collect())
    assert got == [("a", "one", "txt", 2), ("a", "two", "txt", 0), ("b", "one", "jpg", 1), ("b", "three", "txt", 1), ("labels", "top", "txt", 1)]
    images = readers.images_in(files)
    assert sorted((r.stem, r.missing) for r in pair_check(images, files.where("extension = 'txt'"), "stem").collect()) == [("three", "left"), ("top", "left"), ("two", "left")]
    assert [(r.stem, r.length) for r in readers.flat_listing(spark, tree).collect()] == [("top", 1)]
    assert readers.manifest(spark, tree, recursive=False).count() == 1 and readers.flat_listing(spark, tree + "/a").count() == 2
    assert readers.lines_by_prefix(spark, tree + "/a", "o").collect() == [(1, 2)] and readers.lines_by_prefix(spark, tree + "/a", "").collect() == [(2, 2)]


def test_labels_strict_and_tolerant(spark, tree, tmp_path):
    rows = readers.label_lines(spark, tree + "/a").orderBy("line_no").collect()
    assert [(r.stem, r.line_no, r.cls, r.xc) for r in rows] == [("one", 1, 0, 0.5), ("one", 2, 3, 0.25)]
    (tmp_path / "bad.txt").write_text("0 0.5 0.5 0.1\n\n1 0.5 x 0.1 0.1\n2 0.5 0.5 0.1 0.1\n")
    assert [r.cls for r in readers.label_lines(spark, str(tmp_path / "bad.txt"), strict=False).collect()] == [2]
    with pytest.raises(Exception, match="not a label"):
        readers.label_lines(spark, str(tmp_path / "bad.txt")).collect()


def test_dumps_and_runs(spark, tmp_path):
    (tmp_path / "t.txt").write_text("(1, 2, 3, 4)\n(-5, 6, 7, 8)\n")
    assert [(r.line_no, r.x, r.h) for r in readers.tuple_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == [(1, 1, 4), (2, -5, 8)]
    (tmp_path / "r.txt").write_text("[[1,2,3,4],[5,6,7,8]]\n[]\n[[9,9,9,9]]")
    assert [(r.line_no, r.rect_idx, r.x) for r in readers.rectangle_dump(spark, str(tmp_path / "r.txt")).orderBy("line_no", "rect_idx").collect()] == [(1, 0, 1), (1, 1, 5), (3, 0, 9)]
    (tmp_path / "v.txt").write_text("[1.5, 2]\n[3]")
    assert sorted(r.value for r in readers.value_dump(spark, str(tmp_path / "v.txt")).collect()) == [1.5, 2.0, 3.0]
    count = {"TP": 3, "FP": 1, "FN": 0, "precision": 0.75, "recall": 1.0}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "train10eval3.json").write_text(json.dumps({"summary": count, "per_class": {"0": count, "3": count}}, indent=1))
    assert sorted((r.train, r.eval, -1 if r.cls is None else r.cls, r.tp, r.precision) for r in readers.metrics_files(spark, str(tmp_path / "m")).collect()) == [(10, 3, c, 3, 0.75) for c in (-1, 0, 3)]
    (tmp_path / "y.yaml").write_text("task: detect\nname: a: b\n# x\nempty:\n")
    assert {r.key: r.value for r in readers.flat_yaml(spark, str(tmp_path / "y.yaml")).collect()} == {"task": "detect", "name": "a: b", "empty": ""}
    (tmp_path / "s.json").write_text(json.dumps({"gnats": {"a_1": 3, "a_2": None}}))
    assert sorted((r.cls, r.stem, r.n_lines or -1) for r in readers.templates(spark, str(tmp_path / "s.json")).collect()) == [("gnats", "a_1", 3), ("gnats", "a_2", -1)]
    result = [{"filename": "f.jpg", "true_positives": {"boxes": [], "classes": []}, "false_positives": {"boxes": [[1, 2, 3, 4]], "classes": [1], "scores": [0.5]}, "false_negatives": {"boxes": [], "classes": []}}]
    (tmp_path / "res.json").write_text(json.dumps(result, indent=1))
    assert [(r.filename, r.box_index, r.cls, r.score, r.y2) for r in readers.false_positives(spark, str(tmp_path / "res.json")).collect()] == [("f.jpg", 0, 1, 0.5, 4.0)]
    (tmp_path / "run7").mkdir()
    from boxmill.sources.schemas import CURVE

    (tmp_path / "run7" / "results.csv").write_text(", ".join(CURVE) + "\n" + ", ".join(["1"] + ["0.5"] * 14) + "\n")
    assert [(r.run, r.epoch, r.map50_95) for r in readers.curves(spark, str(tmp_path / "run7" / "results.csv")).collect()] == [("run7", 1, 0.5)]


def exif(text):
    own = struct.pack("<HHHII", 1, 0x9003, 2, 20, 44) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + b"\0" * 4 + own
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff + text.encode() + b"\0"


def test_exif(spark):
    df = spark.createDataFrame([(1, bytearray(exif("2021:06:09 10:11:12"))), (2, bytearray(b"no")), (3, None), (4, bytearray(exif("0000:00:00 00:00:00")))], "n int, content binary")
    got = {r.n: r.t for r in readers.exif_times(df).select("n", F.col("taken").cast("string").alias("t")).collect()}
    assert got == {1: "2021-06-09 10:11:12", 2: None, 3: None, 4: None}


def test_writers(spark, tmp_path):
    labels = spark.createDataFrame([(1, 2, 0, 0.5, 0.25, 0.1, 0.125), (1, 1, 3, 0.1, 0.2, 0.3, 0.4)], "image_id long, box_idx long, cls int, xc double, yc double, w double, h double")
    files = writers.label_files(labels, spark.createDataFrame([(1,), (2,)], "image_id long"))
    writers.write_files(files, str(tmp_path / "out"))
    assert (tmp_path / "out" / "1.txt").read_text() == "3 0.100000 0.200000 0.300000 0.400000\n0 0.500000 0.250000 0.100000 0.125000\n"
    assert (tmp_path / "out" / "2.txt").read_text() == ""
    assert spark.range(1).select(writers.tuple_line(*(F.lit(i) for i in (1, -2, 3, 4)))).first()[0] == "(1, -2, 3, 4)"
    rects = spark.createDataFrame([(1, 2, 5, 6, 7, 8), (1, 1, 1, 2, 3, 4)], "image_id int, box_idx int, x int, y int, w int, h int")
    assert [tuple(r) for r in writers.rectangle_dump(rects).collect()] == [(1, "[[1,2,3,4],[5,6,7,8]]")]
    outcomes = spark.createDataFrame([(0, "TP"), (0, "FP"), (3, "FN")], "cls long, outcome string")
    made = json.loads(writers.metrics_json(metrics.scored(metrics.counts(outcomes, "cls", total=-1))).first().value)
    assert made["summary"] == {"TP": 1, "FP": 1, "FN": 1, "precision": 0.5, "recall": 0.5} and set(made["per_class"]) == {"0", "3"}
    writers.append_csv(spark.range(2), str(tmp_path / "c"))
    writers.append_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c")).count() == 5
    (tmp_path / "src").write_text("x")
    plan = spark.createDataFrame([(str(tmp_path / "src"), str(tmp_path / "d" / "dst")), (str(tmp_path / "no"), str(tmp_path / "d" / "no"))], "src string, dst string")
    assert [r.copied for r in writers.copy_files(plan).orderBy("src").collect()] == [False, True] and (tmp_path / "d" / "dst").read_text() == "x"


def test_scorer_and_windows(spark):
    tiles = tiling.windows(spark.createDataFrame([(1, 1100, 700), (2, 600, 700)], "image_id long, width long, height long")).withColumn("content", F.lit(b"ab"))
    assert [(r.tile_id, r.tile_x, r.tile_y) for r in tiles.orderBy("tile_id").collect()] == [(0, 0, 0), (1, 420, 0)]
    found = scoring.predict_tiles(tiles, lambda: lambda data: [(0, 0, len(data), 5, 1, 0.9), (0, 0, 1, 1, 0, 0.3)], 0.3).orderBy("x1").collect()
    assert [(r.image_id, r.box_idx, r.x1, r.x2, r.score) for r in found] == [(1, 1, 0.0, 2.0, 0.9), (1, (1 << 32) + 1, 420.0, 422.0, 0.9)]


def test_pixels(spark):
    yellow, blue = [0, 220, 255], [255, 0, 0]
    image = np.array([[yellow, blue], [yellow, yellow]], np.uint8)
    assert pixels.in_range(pixels.hsv(image), (20, 100, 100), (30, 255, 255)).tolist() == [[True, False], [True, True]]
    df = spark.createDataFrame([(bytearray(image.tobytes()), 2, 2)], "content binary, height int, width int")
    assert df.select(pixels.yellow_share("content", "height", "width")).first()[0] == 0.75
    assert bytes(df.select(pixels.crop("content", "height", "width", F.lit(1), F.lit(0), F.lit(9), F.lit(1))).first()[0]) == bytes(blue)
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(pixels.homography(square, square * 2 + 1) @ [5, 5, 1], [11, 11, 1])
    assert pixels.ordered_corners(square[[2, 0, 3, 1]]).tolist() == square.tolist()
    grey = spark.createDataFrame([(bytearray([0, 99]), bytearray([1, 1]), 2, 1), (bytearray([0, 0]), bytearray([1, 1]), 2, 1), (None, None, 2, 1)], "grey binary, outline binary, height int, width int")
    assert [r.u for r in grey.select(pixels.is_upright("grey", "outline", "height", "width").alias("u")).collect()] == [True, None, None]
    assert pixels.upright(np.array([[0], [99]]), np.ones((2, 1), bool)) is True and pixels.upright(np.array([[0], [0]]), np.ones((2, 1), bool)) is None


def test_stream_reads_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("0 0.5 0.5 0.1 0.1\nbad\n")
    run = lambda: ingest.to_table(ingest.label_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (source / "b.txt").write_text("1 0.5 0.5 0.1 0.1\n2 0.5 0.5 0.1 0.1")
    run()
    run()
    assert sorted((r.stem, r.line_no, r.cls) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1, 0), ("b", 1, 1), ("b", 2, 2)]


def test_result_tables(spark, tmp_path):
    (tmp_path / "final.csv").write_text("prefix,TP,FP,FN,precision,recall\n\n\nA,3,1,2,0.75,0.6\nB,0,0,1,,0.0\n")
    got = readers.final_metrics(spark, str(tmp_path / "final.csv")).orderBy("prefix").collect()
    assert [tuple(r) for r in got] == [("A", 3, 1, 2, 0.75, 0.6), ("B", 0, 0, 1, None, 0.0)]
    (tmp_path / "filters.csv").write_text(",A_p,A_FP,A_TP,B_p,B_FP,B_TP\nbase,0.5,1,1,0.9,1,9\nlarger,0.6,,,,,\n")
    got = readers.filter_ablation(spark, str(tmp_path / "filters.csv"), ("A", "B")).orderBy("variant", "species").collect()
    assert [tuple(r) for r in got] == [("base", "A", 0.5, 1, 1), ("base", "B", 0.9, 1, 9), ("larger", "A", 0.6, None, None)]
    (tmp_path / "masks.csv").write_text("mask,alignment,shift,FP A,FP B,TP A,TP B\nm,no,no,1,2,3,4\nm,yes,no,5,6,7,8\n")
    got = readers.mask_ablation(spark, str(tmp_path / "masks.csv"), ("A", "B")).orderBy("fp").collect()
    assert [tuple(r) for r in got] == [("m", "no", "no", "A", 1, 3), ("m", "no", "no", "B", 2, 4), ("m", "yes", "no", "A", 5, 7), ("m", "yes", "no", "B", 6, 8)]


def test_lines_of_a_file_in_pieces(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\n".join(f"[{i}, {i + 0.5}]" for i in range(5000)) + "\n")
    (tmp_path / "e.txt").write_text("[7]\n\n[8]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path))
        lines = sorted((r.path[-5:], r.line_no, r.line) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines == [("d.txt", i + 1, f"[{i}, {i + 0.5}]") for i in range(5000)] + [("e.txt", 1, "[7]"), ("e.txt", 2, ""), ("e.txt", 3, "[8]")]


def test_arrays_and_pictures(spark, tmp_path):
    import zlib

    rows = spark.createDataFrame([("c", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.5]), ("e", [0], [])], "image_id string, shape array<int>, data array<double>")
    writers.write_files(writers.array_files(rows), str(tmp_path / "arrays"), ".npy")
    assert np.array_equal(np.load(tmp_path / "arrays" / "c.npy"), [[1, 2, 3], [4, 5, 6.5]])
    assert sorted((r.path[-5:], r.shape, r.data) for r in readers.arrays(spark, str(tmp_path / "arrays")).collect()) == [("c.npy", [2, 3], [1, 2, 3, 4, 5, 6.5]), ("e.npy", [0], [])]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels_ = b"\0" + bytes([255, 0, 0, 0, 255, 0]) + b"\0" + bytes([0, 0, 255, 10, 10, 10])  # red, green; blue, grey
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels_)) + chunk(b"IEND", b""))
    (tmp_path / "p" / "b.png").write_bytes(b"no picture")
    (r,) = readers.pictures(spark, str(tmp_path / "p")).collect()
    assert (r.height, r.width, list(r.content)) == (2, 2, [0, 0, 255, 0, 255, 0, 255, 0, 0, 10, 10, 10])
    assert list(readers.pictures(spark, str(tmp_path / "p"), grey=True).first().content) == [76, 150, 29, 10]


def test_results_splits_and_new_versions(spark, tmp_path):
    from boxmill.operators import folds

    box = "image_id long, box_idx long, cls long, x1 long, y1 long, x2 long, y2 long"
    pred = spark.createDataFrame([(1, 1, 0, 0, 0, 10, 10, 0.9), (1, 2, 1, 50, 50, 60, 60, 0.8), (2, 1, 0, 0, 0, 5, 5, 0.7)], box + ", score double")
    gt = spark.createDataFrame([(1, 1, 0, 0, 0, 10, 10), (3, 1, 2, 1, 1, 2, 2)], box)
    lines = writers.results_json(folds.outcomes(folds.per_image(pred, gt), folds.fits_model(0.5, 0.9)))
    got = {d["filename"]: d for d in map(json.loads, (r.value for r in lines.collect()))}
    assert got["1.jpg"] == {"filename": "1.jpg", "true_positives": {"boxes": [[0, 0, 10, 10]], "classes": [0]}, "false_positives": {"boxes": [[50, 50, 60, 60]], "classes": [1], "scores": [0.8]}, "false_negatives": {"boxes": [], "classes": []}}
    assert got["3.jpg"]["false_negatives"] == {"boxes": [[1, 1, 2, 2]], "classes": [2]} and len(got) == 3
    split = spark.createDataFrame([("gnats", "b", 2), ("gnats", "a", None), ("flies", "c", 0)], "cls string, stem string, n_lines int")
    assert json.loads(writers.split_json(split).first().value) == {"flies": {"c": 0}, "gnats": {"a": None, "b": 2}}
    labels = spark.createDataFrame([(1, 1, 0, 0.5, 0.5, 0.1, 0.1), (1, 2, 3, 0.25, 0.5, 0.1, 0.1), (2, 1, 0, 0.5, 0.5, 0.1, 0.1)], "image_id long, box_idx long, cls long, xc double, yc double, w double, h double")
    names = spark.createDataFrame([(1,), (2,)], "image_id long")
    version = writers.without_lines(labels, names, spark.createDataFrame([(1, 1), (2, 1), (2, 9)], "image_id long, box_idx long"))
    writers.write_files(version, str(tmp_path / "v2"))
    assert (tmp_path / "v2" / "1.txt").read_text() == "3 0.250000 0.500000 0.100000 0.100000\n" and (tmp_path / "v2" / "2.txt").read_text() == ""
    writers.write_csv(split, str(tmp_path / "csv"))
    writers.write_csv(split, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_one_folder_of_a_hundred_thousand_files_and_a_deep_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "NAMES", 7_000)
    flat, deep = tmp_path / "flat", tmp_path / "deep"
    flat.mkdir()
    for k in range(100_000):
        (flat / f"{k}.txt").touch()
    here = deep
    for k in range(6):
        for j in range(3):
            (here / f"side {j}").mkdir(parents=True)
            (here / f"side {j}" / f"é{k}.txt").write_text("x" * k)
        here = here / "side 1"
    os.symlink(deep, here / "loop")
    found = readers.manifest(spark, str(flat))
    assert found.count() == 100_000 and found.select("stem").distinct().count() == 100_000
    got = readers.manifest(spark, str(deep)).collect()
    assert sorted((r.stem, r.length) for r in got) == sorted((f"é{k}", k) for k in range(6) for _ in range(3))
    assert readers.manifest(spark, str(deep), recursive=False).count() == 0


def test_sets_are_read_by_folder(spark, tmp_path):
    rows = [(split, f"class {c}", f"{k}", f"/p/{split}/{c}/{k}.jpg") for split in ("train", "val") for c in range(3) for k in range(40 if c else 90)]
    writers.write_sets(spark.createDataFrame(rows, "split string, cls string, stem string, path string"), f"{tmp_path}/sets", per_file=30)
    found = readers.set_files(spark, f"{tmp_path}/sets", split="val", cls="class 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "split" in filters and "cls" in filters and "DataFilters: []" in plan
    assert sorted(r.stem for r in found.collect()) == sorted(r[2] for r in rows if r[:2] == ("val", "class 0"))
    assert readers.set_files(spark, f"{tmp_path}/sets").count() == len(rows)
