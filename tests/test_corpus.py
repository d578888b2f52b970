import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import images as im
from stratalens.operators import corpus, factors, learn, learners, prototypes, sampling
from stratalens.params import Params
from stratalens.plans import dag
from stratalens.sources import images


def labelled(spark, counts):
    return spark.createDataFrame([(i * 1000 + j, i) for i, n in enumerate(counts) for j in range(n)], "image_id long, label int")


@pytest.mark.parametrize("size,want", [(0.5, [50, 100]), (0.01, [1, 2]), (0.99, [99, 198]), (3, [3, 3])])
def test_training_counts(spark, size, want):
    out = corpus.choose_training(labelled(spark, [100, 200]), "label", "image_id", size).where("is_train").groupBy("label").count().orderBy("label").collect()
    assert [r["count"] for r in out] == want


def test_training_size_must_not_be_negative(spark):
    with pytest.raises(ValueError):
        corpus.choose_training(labelled(spark, [2]), "label", "image_id", -1)


@pytest.mark.parametrize("shuffle", [False, True])
def test_balance(spark, shuffle):
    out = corpus.balance(labelled(spark, [2, 3]), "label", "image_id", shuffle)
    assert sorted(r["count"] for r in out.groupBy("label").count().collect()) == [2, 2]
    if not shuffle:
        assert [r[0] for r in out.orderBy("image_id").collect()] == [0, 1, 1000, 1001]


def test_split_needs_like_classes(spark):
    a, b = (spark.createDataFrame([(1, c)], "image_id long, class_name string") for c in "ab")
    with pytest.raises(ValueError):
        corpus.join_split(a, b)


def test_image_corpus_to_classifier(spark, tmp_path):
    rng = np.random.default_rng(0)
    for c, base in (("a", 0.2), ("b", 0.7)):
        (tmp_path / "x" / c).mkdir(parents=True)
        for k in range(4):
            (tmp_path / "x" / c / f"{c}{k}.png").write_bytes(im.png(np.clip(base + 0.1 * rng.random((20, 24)), 0, 1)))
        (tmp_path / "x" / c / ".hidden").write_text("1")
    found = images.read_corpus(spark, f"{tmp_path}/x")
    assert [tuple(r) for r in found.orderBy("image_id").select("image_id", "label").collect()] == [(k, k // 4) for k in range(8)]
    grey = images.load_grey(spark, found, f"{tmp_path}/x", Params(image_resize_length=16)).collect()
    assert {(r["height"], r["width"]) for r in grey} == {(16, 19)}
    rows = spark.createDataFrame([(r["image_id"], 0 if r["image_id"] < 4 else 1, [float(np.mean(r["data"])), float(np.std(r["data"]))]) for r in grey], "image_id long, label int, features array<double>")
    out = learn.train_and_test(rows, "logreg")
    assert out["training_score"] == 1.0 and out["score"] == 1.0
    images.write_svmlight(rows, f"{tmp_path}/svm")
    assert spark.read.text(f"{tmp_path}/svm").where("value like '1.0 1:%' or value like '2.0 1:%'").count() == 8
    images.store_experiment(f"{tmp_path}/exp", Params(), rows=rows)
    p, tables, _ = images.load_experiment(spark, f"{tmp_path}/exp")
    assert p == Params() and tables["rows"].count() == 8


def test_table_learners(spark):
    """Moments, directions and covariance of a table against numpy."""
    x = np.random.default_rng(5).normal(size=(300, 6)) * np.arange(1, 7)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    n, mean, std = learners.moments(rows)
    assert n == x.size and np.isclose(mean, x.mean()) and np.isclose(std, x.std())
    bank, centre = factors.pca(rows, 3)
    v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    assert np.allclose(centre, x.mean(axis=0)) and np.allclose(np.abs(bank), np.abs(v), atol=1e-6) and (bank[np.arange(3), np.abs(bank).argmax(axis=1)] > 0).all()
    assert learners.imprint(rows, 4).shape == (4, 6)
    with pytest.raises(ValueError):
        learners.k_means(rows.limit(2), 3)


def test_meta_features():
    x = np.random.default_rng(6).random((30, 2, 4, 4))
    meta = prototypes.meta_features(x)
    assert meta.shape == (30, 12) and np.allclose(meta[:, 0], x[:, 0].mean(axis=(1, 2))) and np.allclose(meta[:, 9], x[:, 1].max(axis=(1, 2)))


def explained(df):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return text.getvalue()


def test_ranges_do_without_whole_windows(spark, monkeypatch):
    """Ranks, folds and sums run within parts of a class; no window takes a class or a table."""
    rows = labelled(spark, [50, 70])
    few = corpus.balance(rows, "label", "image_id", True)
    assert "WindowGroupLimit" in explained(few)  # small classes: each task passes on no more than it must
    monkeypatch.setattr(corpus, "FEW_ROWS", 0)
    many = corpus.balance(rows, "label", "image_id", True)
    assert sorted(many.collect()) == sorted(few.collect())
    for df in (many, corpus.choose_training(rows, "label", "image_id", 0.5), corpus.folds(rows, "label", "image_id")):
        text = explained(df)
        assert "_part" in text and "SinglePartition" not in text


def test_ordered_rows_of_a_hot_group(spark, monkeypatch):
    """Differences, sums and groups carried across the ranges of a group that holds most rows."""
    from stratalens.operators import analysis, sequences

    monkeypatch.setattr(analysis, "RANGES", 8)
    draw = np.random.default_rng(4)
    rows = [(0 if k % 3 else int(draw.integers(1, 9)), int(v), float(draw.integers(0, 100)), "x") for k, v in enumerate(draw.permutation(500))] + [(None, 900, 1.0, "x"), (None, 901, 3.0, "x")]
    df = spark.createDataFrame(rows, "g int, at long, v double, part string")
    by = {}
    for g, at, v, _ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append((at, v))
    got = {(r["g"], r["at"]): r["difference"] for r in sequences.differences(df, "g", "at", "v").collect() if r["g"] is not None}
    assert got == {(g, b[0]): b[1] - a[1] for g, x in by.items() if g is not None for a, b in zip(x, x[1:])}
    got = {(r["g"], r["at"]): r["total"] for r in sequences.running_total(df, "g", "at", "v").collect() if r["g"] is not None}
    assert got == {(g, at): sum(v for _, v in x[: k + 1]) for g, x in by.items() if g is not None for k, (at, _) in enumerate(x)}
    got = {(r["g"], r["part"]): r["values"] for r in sequences.groups(df.drop("part"), "g", "at", "v", 7).collect() if r["g"] is not None}
    assert got == {(g, k // 7): [v for _, v in x[k : k + 7]] for g, x in by.items() if g is not None for k in range(0, len(x), 7)}
    assert sequences.running_total(df.limit(0), "g", "at", "v").count() == 0


def test_radial_spectrum_by_hand(spark):
    """A 4 x 4 spectrum: radii about the middle are 0.7 (4 cells), 1.6 (8) and 2.1 (4); the first and the last go."""
    from stratalens.functions import images as I

    x = np.random.default_rng(1).random((4, 4))
    power = np.abs(np.fft.fftshift(np.fft.fft2(x))) ** 2
    ring = power.sum() - power[1:3, 1:3].sum() - power[[0, 0, 3, 3], [0, 3, 0, 3]].sum()
    freq, total, n = I.radial_spectrum(x)
    assert freq.tolist() == [0.0] and np.allclose(total, [ring]) and n.tolist() == [8]


def test_one_row_classes(spark):
    with pytest.raises(ValueError):
        corpus.choose_training(labelled(spark, [1, 2]), "label", "image_id", 0.5)


def test_files_without_a_class(spark):
    with pytest.raises(ValueError):
        corpus.scan(spark.createDataFrame([("a", None)], "path string, class_name string"), "class_name", "path")


def test_text_tables(spark, tmp_path):
    from stratalens.sources import tables as S

    (tmp_path / "m.txt").write_text("1 b 2.5\nx 4\n")
    got = [[f["number"] if f["number"] is not None else f["text"] for f in r["fields"]] for r in S.mixed_text(spark, f"{tmp_path}/m.txt").collect()]
    assert sorted(got, key=len) == [["x", 4.0], [1.0, "b", 2.5]]
    (tmp_path / "b.txt").write_text("z 1\na 2\nz 3\n")
    bars = S.bar_data(spark, f"{tmp_path}/b.txt")
    from stratalens.operators import analysis

    rows = [tuple(r) for r in analysis.bars([bars]).orderBy("place").select("name", "y_mean").collect()]
    assert rows == [("z", 2.0), ("a", 2.0)]
    with pytest.raises(ValueError):
        analysis.bars([bars, bars.where("name = 'z'")])
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for encoding, want in (("csv", "1 x"), ("text", '{"a":1,"b":"x"}')):
        S.store_as(df, f"{tmp_path}/{encoding}", encoding)
        assert [r[0] for r in spark.read.text(f"{tmp_path}/{encoding}").collect()] == [want]
    with pytest.raises(ValueError):
        S.store_as(df, f"{tmp_path}/p", "pickle")


def test_orientation_lines():
    from stratalens.functions.kernels import orientation_line

    for k in range(8):
        x = orientation_line(k)
        assert x.shape == (11, 11) and x[5, 5] == 1 and x.sum() == 11
    with pytest.raises(ValueError):
        orientation_line(8)


def test_draw(spark):
    ids = spark.range(5).withColumnRenamed("id", "image_id")
    for n in (1, 3, 5, 16):
        out = sampling.draw(ids, "image_id", n, {0: (10, 10), 1: (4, 4)}, 5, 1).collect()
        assert len(out) == n and all(r["scale"] == 0 and 0 <= r["y0"] <= 5 and 0 <= r["x0"] <= 5 for r in out)
    with pytest.raises(ValueError):
        sampling.draw(ids, "image_id", 1, {0: (4, 4)}, 5, 1)


def test_graph(spark):
    g = dag.Graph()
    one = spark.createDataFrame([("1",)], "v string")
    g.register("n2_1", ("n1",), lambda a: a.select(F.concat("v", F.lit(",2_1")).alias("v")))
    g.register("n2_2", ("n1",), lambda a: a.select(F.concat("v", F.lit(",2_2")).alias("v")))
    g.register("n3", ("n2_1", "n2_2"), lambda a, b: a.crossJoin(b.withColumnRenamed("v", "w")).select(F.concat_ws(";", "v", "w").alias("v")))
    out = g.build("n3", {"n1": one}, save_all=False)
    assert set(out) == {"n3"} and out["n3"].first()[0] == "1,2_1;1,2_2"
    with pytest.raises(dag.DependencyError):
        g.build("n3", {})
    with pytest.raises(TypeError):
        g.register("x", ("n1",), lambda: None)
    assert dag.is_below(dag.from_id("i"), dag.from_name("c2")) and dag.top().id == "c2"


def test_masks(spark):
    from stratalens.sources.masks import match_masks

    files = spark.createDataFrame([(1, "a", "/x/a/1.jpg"), (2, "a", "/x/a/2.jpg"), (3, "b", "/x/b/3.jpg")], "image_id long, class_name string, path string")
    masks = spark.createDataFrame([("/m/a/1.png",), ("/m/1.png",), ("/m/2.png",)], "path string")
    assert {r[0]: r[1] for r in match_masks(files, masks).collect()} == {1: "/m/a/1.png", 2: "/m/2.png", 3: None}


def test_numeric_text(spark, tmp_path):
    from stratalens.sources.tables import numeric_text

    (tmp_path / "t.txt").write_text("1 2.5\n\n  3\t4\n")
    assert [tuple(r) for r in numeric_text(spark, f"{tmp_path}/t.txt", 2).orderBy("c0").collect()] == [(1.0, 2.5), (3.0, 4.0)]
    with pytest.raises(Exception, match="columns"):
        numeric_text(spark, f"{tmp_path}/t.txt", 1).collect()
