"""Boxes on masks by integral images, and masks decoded through the image layer."""

import numpy as np
from pyspark.sql import functions as F

from stratalens.functions import images as I
from stratalens.operators import analysis
from stratalens.params import Params, ResizeMethod
from stratalens.sources import masks as M


def test_boxes_against_plain(spark):
    draw = np.random.default_rng(1)
    held = {k: draw.random(s) for k, s in enumerate([(5, 7), (1, 1), (12, 3)])}
    rows = [(k, *m.shape, m.ravel().tolist()) for k, m in held.items()]
    masks = spark.createDataFrame(rows, "image_id long, height int, width int, data array<double>")
    boxes = [(n, int(draw.integers(0, 5)) if n % 3 else 0, *(int(v) for v in draw.integers(-2, 14, 4))) for n in range(300)]  # a third has one image
    df = spark.createDataFrame(boxes, "box_id long, image_id long, top int, bottom int, left int, right int")
    got = {r["box_id"]: r["ratio"] for r in analysis.foreground_ratio(df, masks).collect()}
    for n, image, t, b, l, r in boxes:
        m = held.get(image, np.zeros((0, 0)))[max(t, 0) : max(b, 0), max(l, 0) : max(r, 0)]
        assert np.isclose(got[n], (1 - m).mean() if m.size else 0.0, atol=1e-12)
    assert analysis.foreground_ratio(df.limit(0), masks).count() == 0 and analysis.foreground_ratio(df, masks.limit(0)).where("ratio <> 0").count() == 0


def test_cells_become_arrays(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 2, 0), (1, 0, 1, 1)], "image_id long, y int, x long, m int")
    (row,) = analysis.mask_arrays(cells).collect()
    assert (row["height"], row["width"], row["data"]) == (2, 3, [0.0, 1.0, 1.0, 1.0, 1.0, 0.0])


def test_no_join_of_cells_and_boxes(spark):
    import io
    from contextlib import redirect_stdout

    masks = spark.createDataFrame([(1, 1, 1, [0.0])], "image_id long, height int, width int, data array<double>")
    df = spark.createDataFrame([(1, 1, 0, 1, 0, 1)], "box_id long, image_id long, top int, bottom int, left int, right int")
    with redirect_stdout(io.StringIO()) as text:
        analysis.foreground_ratio(df, masks).explain("formatted")
    assert "Generate" not in text.getvalue() and "NestedLoop" not in text.getvalue()


def test_masks_are_decoded(spark, tmp_path):
    for name, value in (("1.png", 255), ("2_mask.png", 0), ("2.png", 255), ("9.png", 0)):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / name).write_bytes(I.png(np.full((4, 6), value / 255)))
    files = spark.createDataFrame([(1, "a", "/x/a/1.png"), (2, "a", "/x/a/2.jpg"), (3, "a", "/x/a/3.png"), (4, "b", "/x/b/1.png")], "image_id long, class_name string, path string")
    names = files.select("image_id", M.candidate_names(F.col("path")).alias("n")).orderBy("image_id").first()["n"]
    assert names == ["1.png", "1_mask.png", "1_mask.png", "1.png"]
    p = Params(image_resize_method=ResizeMethod.NONE)
    got = {r["image_id"]: (r["height"], r["width"], set(r["data"])) for r in M.load_masks(spark, files, str(tmp_path), p).collect()}
    assert got == {1: (4, 6, {1.0}), 2: (4, 6, {0.0})}
