import json

import numpy as np
import pytest

from stratalens import cli
from pyspark.sql import functions as F

from stratalens.api import Experiment, ExperimentError, histogram_builder
from stratalens.functions import images as im
from stratalens.operators import packed
from stratalens.params import Params

SMALL = Params(image_resize_length=40, s1_kwidth=5, c1_kwidth=5, c1_sampling=2, s2_kwidth=[3], num_scales=2)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(0)
    for c, axis in (("across", 0), ("along", 1)):
        (base / c).mkdir()
        for k in range(4):
            wave = np.sin(np.arange(48) / (1.5 + 0.1 * k))
            x = 0.5 + 0.3 * (wave[:, None] if axis else wave[None, :]) + 0.05 * rng.random((48, 48))
            (base / c / f"{k}.png").write_bytes(im.png(x))
    return str(base)


def test_session(spark, root, tmp_path):
    e = Experiment(spark, SMALL)
    with pytest.raises(ExperimentError):
        e.make_prototypes(3)
    e.set_corpus(root)
    with pytest.raises(ExperimentError):
        e.compute_activation("c2")
    e.make_prototypes(4)
    assert e.banks[0].shape == (4, 4, 3, 3) and np.allclose((e.banks[0] ** 2).sum(axis=(1, 2, 3)), 1, atol=1e-5)
    with pytest.raises(ExperimentError):
        e.set_params(s1_kwidth=7)
    e.compute_activation("c2")
    rows = e.features().collect()
    assert len(rows) == 8 and {len(r["features"]) for r in rows} == {4}
    out = e.evaluate(learner="logreg")
    assert out["training_score"] >= 0.75 and e.predictions().count() == 4
    with pytest.raises(ValueError):
        e.set_prototypes([np.zeros((2, 4, 5, 5))])
    with pytest.raises(ExperimentError):
        e.set_corpus(root)
    e.store(f"{tmp_path}/exp")
    again = Experiment.load(spark, f"{tmp_path}/exp")
    assert again.params == e.params and again.layers == ("c2",) and np.allclose(again.banks[0], e.banks[0])
    assert again.evaluation_results() == e.evaluation_results() and again.predictions().count() == 4
    assert sorted(map(tuple, again.features().collect())) == sorted(map(tuple, rows))
    # what can be looked at
    assert [p.split("/")[-2:] for p in e.image_paths()] == [[c, f"{k}.png"] for c in ("across", "along") for k in range(4)]
    assert e.num_prototypes() == 4 and e.num_kernel_widths() == 1 and e.evaluation_layers() == ("c2",)
    assert e.training_set().where("is_train").count() == 4
    at = e.imprint_location(2)
    cells = {(r["band"], r["y"], r["x"]): r["v"] for r in e.activity(at["image_id"], "c1").where(f"scale = {at['scale']}").collect()}
    patch = np.array([[[cells[b, at["y0"] + y, at["x0"] + x] for x in range(3)] for y in range(3)] for b in range(4)])
    assert np.allclose(patch / np.sqrt((patch**2).sum()), e.prototype(2), atol=1e-5)
    assert e.image_patch(2).size > 0 and 0 < e.best_match(0, 1)["v"] <= 1
    e.save_prototypes(f"{tmp_path}/p.npz")
    other = Experiment(spark, SMALL).set_prototypes(f"{tmp_path}/p.npz")
    assert np.allclose(other.banks[0], e.banks[0]) and e.kernel_cells(e.banks[0]).count() == 4 * 4 * 9
    with pytest.raises(ValueError):
        other.set_prototypes([2 * e.banks[0]])
    assert set(e.times) == {"prototypes", "activation", "evaluation"}
    hist = e.evaluate(learner="logreg", feature_builder=histogram_builder(5))
    assert 0 <= hist["score"] <= 1


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Images of four shapes in two classes."""
    base, rng = tmp_path_factory.mktemp("mixed"), np.random.default_rng(1)
    for c in ("p", "q"):
        (base / c).mkdir()
        for k, (h, w) in enumerate(((40, 60), (60, 40), (50, 50), (44, 90))):
            (base / c / f"{k}.png").write_bytes(im.png(rng.random((h, w))))
    return str(base)


@pytest.mark.parametrize("n", [2, 5, 12])
def test_prototypes_of_images_of_unlike_shape(spark, mixed, n):
    params = Params.from_dict(SMALL.to_dict() | {"s2_kwidth": [3, 5]})
    e = Experiment(spark, params, seed=n).set_corpus(mixed).make_prototypes(n)
    assert [b.shape for b in e.banks] == [(n, 4, 3, 3), (n, 4, 5, 5)]
    places = e.places.toPandas()
    assert len(places) == 2 * n and set(places.groupby("kwidth").patch_id.apply(lambda x: tuple(sorted(x)))).__len__() == 1
    grey = {r["image_id"]: np.array(r["data"], np.float32).reshape(r["height"], r["width"]) for r in e.grey.collect()}
    assert len({x.shape for x in grey.values()}) > 2
    for i in range(n):
        at = e.imprint_location(i)
        c1 = dict((s, x) for s, _, x in packed.layers_of(grey[at["image_id"]], params, e.s1_bank, None, {"c1"})["c1"])[at["scale"]]
        patch = c1[:, at["y0"] : at["y0"] + 3, at["x0"] : at["x0"] + 3]
        assert np.allclose(patch / np.sqrt((patch**2).sum()), e.prototype(i), atol=1e-5)


def test_weighted_learners(spark, mixed):
    e = Experiment(spark, SMALL).set_corpus(mixed)
    masks = e.grey.select("image_id", F.posexplode("data").alias("i", "v"), "width").select("image_id", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).alias("x"), (F.col("i") % F.col("width") > 20).cast("int").alias("m"))
    e.make_prototypes(3, "omwkmeans", masks=masks, base_weight=0.1)
    assert e.banks[0].shape == (3, 4, 3, 3)
    e.make_prototypes(3, "MFWKmeans", regression_samples=6)
    assert e.banks[0].shape == (3, 4, 3, 3)
    with pytest.raises(ValueError):
        Experiment(spark, Params.from_dict(SMALL.to_dict() | {"s2_kwidth": [3, 5]})).set_images(e.corpus, e.grey).make_prototypes(3, "omwkmeans", masks=masks)
    with pytest.raises(ValueError):
        e.make_prototypes(3, "omwkmeans")


def test_image_too_small(spark):
    grey = spark.createDataFrame([(7, 4, 4, [0.5] * 16)], "image_id long, height int, width int, data array<float>")
    with pytest.raises(Exception, match="image 7"):
        packed.build(grey, SMALL, Experiment(spark, SMALL).s1_bank, None, ("c1",)).collect()


def test_images_must_be_whole(spark):
    grey = spark.createDataFrame([(7, 4, 4, [0.5] * 15)], "image_id long, height int, width int, data array<float>")
    e = Experiment(spark, SMALL).set_images(grey.select("image_id"), grey)
    with pytest.raises(Exception, match="height x width"):
        e.grey.collect()


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.raises(Exception):
        Experiment(spark, SMALL).set_corpus(str(tmp_path))


def test_command_line(spark, root, capsys):
    params = [x for k, v in SMALL.to_dict().items() if k in ("image_resize_length", "s1_kwidth", "c1_kwidth", "c1_sampling", "s2_kwidth", "num_scales") for x in ("-P", f"{k}={json.dumps(v)}")]
    assert cli.main(["-c", root, "-n", "3", "-E", "-L", "logreg", *params]) == 0
    assert set(json.loads(capsys.readouterr().out.strip().splitlines()[-1])) == {"training_score", "score"}
