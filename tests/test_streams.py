"""Centroids that follow a stream, through crashes and restarts; layers made as images arrive or from stored ones."""

import numpy as np
import pytest

from stratalens.operators import packed
from stratalens.params import Params
from stratalens.functions import kernels
from stratalens.streaming import centroids

SCHEMA = "id long, features array<double>, weight double"
START = np.array([[0.0, 0.0], [10.0, 10.0]])


def feed(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")


def test_a_batch_counts_once(spark, tmp_path):
    followed = centroids.FollowedCentroids(spark, f"{tmp_path}/state", START)
    batches = [[(0, [1.0, 1.0], 1.0), (1, [11.0, 9.0], 1.0)], [(2, [3.0, 1.0], 2.0)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that comes again
            followed.update(spark.createDataFrame(rows, SCHEMA), number)
    number, model = centroids.FollowedCentroids(spark, f"{tmp_path}/state", START).state()
    assert number == 1 and model.counts.tolist() == [3, 1] and np.allclose(model.centres, [[7 / 3, 1.0], [11.0, 9.0]])


def test_the_query_dies_and_starts_again(spark, tmp_path):
    """Once before a batch's state is written and once after, before the stream commits it."""
    source, state, checkpoint = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/checkpoint"
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(k % 2 * 10, 1, 2).tolist(), 1.0) for k in range(60)]

    class Dying(centroids.FollowedCentroids):
        when = None

        def update(self, batch, number):
            if self.when == ("before", number):
                raise RuntimeError("dies")
            super().update(batch, number)
            if self.when == ("after", number):
                raise RuntimeError("dies")

    def run(when):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        followed = Dying(spark, state, START)
        followed.when = when
        centroids.follow(stream, followed, checkpoint).awaitTermination()

    for k in range(3):
        feed(spark, source, k, rows[20 * k : 20 * k + 20])
    for when in (("before", 1), ("after", 1), ("after", 2)):
        with pytest.raises(Exception, match="dies"):
            run(when)
    run(None)
    number, model = centroids.FollowedCentroids(spark, state, START).state()
    assert number == 2 and model.counts.sum() == 60
    feed(spark, source, 3, [(99, [0.0, 0.0], 5.0)])
    run(None)
    _, model = centroids.FollowedCentroids(spark, state, START).state()
    assert model.counts.sum() == 65
    x = np.array([r[1] for r in rows])
    near = ((x[:, None] - START) ** 2).sum(axis=2).argmin(axis=1)
    want = [np.concatenate([x[near == k], np.zeros((5 if k == 0 else 0, 2))]).mean(axis=0) for k in (0, 1)]
    assert np.allclose(model.centres, want)


def test_layers_from_any_stored_one(spark):
    p = Params(s1_kwidth=5, c1_kwidth=3, c1_sampling=2, s2_kwidth=[2, 3], num_scales=2, retina_enabled=True, retina_kwidth=3)
    bank = kernels.gabor_bank(5, 4)
    banks = [kernels.random_bank(3, (4, k, k), seed=k) for k in (2, 3)]
    draw = np.random.default_rng(3)
    grey = spark.createDataFrame([(k, 30, 34, draw.random(30 * 34).astype(np.float32).tolist()) for k in range(4)], "image_id long, height int, width int, data array<float>")
    every = packed.build(grey, p, bank, banks, packed.ORDER, "double").persist()
    flat = lambda df: {(r["image_id"], r["layer"], r["scale"], r["kwidth"]): np.array(r["data"]) for r in df.collect()}
    want = flat(every)
    for layer in packed.ORDER:
        above = packed.ORDER[packed.ORDER.index(layer) :]
        got = flat(packed.climb(every.where(f"layer = '{layer}'"), p, bank, banks, above, "double"))
        assert set(got) == {k for k in want if k[1] in above}
        assert all(np.allclose(got[k], want[k], atol=1e-5) for k in got)
    made = packed.graph(p, bank, banks, "double").build("c2", {"c1": every.where("layer = 'c1'")})
    assert set(made) == {"c1", "s2", "c2"} and all(np.allclose(v, want[k], atol=1e-9) for k, v in flat(made["c2"]).items())
    with pytest.raises(LookupError):
        packed.climb(every.where("layer = 'c1'"), p, bank, banks, ("s1",))
    small = spark.createDataFrame([(7, "c1", 1, 0, [4, 1, 1], [0.5] * 4)], packed.MAPS)
    with pytest.raises(Exception, match="image 7, c1, scale 1"):
        packed.climb(small, p, bank, banks).collect()


def test_models_by_name(spark):
    """A caller's own model: a layer of its own on top of another model's."""
    from pyspark.sql import functions as F

    from stratalens.api import Experiment, ExperimentError
    from stratalens.plans import models

    p = Params(s1_kwidth=3, c1_kwidth=3, c1_sampling=1, s2_kwidth=[2], num_scales=1)
    grey = spark.createDataFrame([(k, 8, 8, [float((k + i) % 5) / 5 for i in range(64)]) for k in range(3)], "image_id long, height int, width int, data array<float>")

    def doubled(params, bank, banks):
        graph = packed.graph(params, bank, banks)
        graph.register("twice", ("c1",), lambda maps: maps.withColumn("data", F.transform("data", lambda v: v * 2)))
        return graph

    e = Experiment(spark, p).set_images(grey.select("image_id"), grey).set_model(doubled)
    twice, c1 = ({r["image_id"]: r["data"] for r in e.build_layer(x).collect()} for x in ("twice", "c1"))
    assert all(np.allclose(twice[k], 2 * np.array(c1[k])) for k in range(3))
    with pytest.raises(LookupError):
        e.set_model("nonsense")
    models.register("Doubled", doubled)
    assert models.resolve("doubled") is doubled
    with pytest.raises(ValueError):
        models.register("ml", doubled)
    # C2 of a session that holds C1 is made from it
    e.set_prototypes([np.ones((2, 4, 2, 2)) / 4])
    direct = {r["image_id"]: r["features"] for r in e.compute_activation("c2").features().collect()}
    e.compute_activation("c1")
    e.compute_activation("c2")
    again = {r["image_id"]: r["features"] for r in e.features().collect()}
    assert all(np.allclose(direct[k], again[k], atol=1e-6) for k in range(3))
    with pytest.raises(ExperimentError):
        e.set_model("ml")
