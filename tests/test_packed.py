import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import geometry, images, kernels
from stratalens.operators import filters, packed
from stratalens.params import Params, ResizeMethod, Response


def naive(x, bank, op, stride, bias, beta):
    n, _, k, _ = bank.shape
    oh, ow = (x.shape[1] - k + 1) // stride, (x.shape[2] - k + 1) // stride
    out = np.zeros((n, oh, ow))
    for i in range(n):
        for y in range(oh):
            for z in range(ow):
                w = x[:, y * stride : y * stride + k, z * stride : z * stride + k]
                dot, energy = (w * bank[i]).sum(), (w * w).sum()
                norm = dot / np.sqrt(max(energy, bias))
                out[i, y, z] = {Response.DOT: dot, Response.NORM_DOT: norm, Response.RBF: np.exp(-beta * ((w - bank[i]) ** 2).sum()), Response.NORM_RBF: np.exp(-2 * beta * (1 - norm))}[op]
    return out


@pytest.mark.parametrize("op", list(Response))
@pytest.mark.parametrize("stride", [1, 2, 3])
def test_responses(op, stride):
    rng = np.random.default_rng(1)
    x, bank = rng.random((2, 11, 9)), kernels.random_bank(3, (2, 3, 3), 2)
    assert np.allclose(packed.respond(x, bank, op, stride, 0.1, 2.0), naive(x, bank, op, stride, 0.1, 2.0))


def test_engines_agree(spark):
    x = np.random.default_rng(5).random((1, 8, 8))
    bank = kernels.gabor_bank(3, 4).reshape(4, 1, 3, 3)
    rows = spark.createDataFrame([(1, x.ravel().tolist())], "image_id long, data array<double>")
    cells = filters.unpack(rows, F.col("data"), 1, 8, 8, F.col("image_id"))
    for op, long in ((Response.DOT, filters.dot), (Response.NORM_DOT, filters.norm_dot)):
        got = long(cells, kernels.frame(spark, bank), 3, 8, 8).toPandas()
        want = packed.respond(x, bank, op, 1, 0.01)
        assert all(abs(want[r.band, r.y, r.x] - r.v) < 1e-9 for r in got.itertuples())
        assert len(got) == want.size
    got = filters.local_max(cells, 3, 8, 8, 2).toPandas()
    want = packed.pool(x, 3, 2)
    assert len(got) == want.size and all(want[r.band, r.y, r.x] == r.v for r in got.itertuples())
    got = filters.contrast_enhance(cells, 3, 8, 8).toPandas()
    want = packed.contrast(x[0], 3, 1.0)
    assert all(abs(want[r.y, r.x] - r.v) < 1e-9 for r in got.itertuples())


def test_no_shuffle_after_unpack(spark):
    rows = spark.range(10).select(F.col("id").alias("image_id"), F.array_repeat(F.lit(0.5), 64).alias("data"))
    cells = filters.unpack(rows, F.col("data"), 1, 8, 8, F.col("image_id"))
    out = filters.global_max(filters.local_max(filters.dot(cells, kernels.frame(spark, kernels.gabor_bank(3, 4).reshape(4, 3, 3)), 3, 8, 8), 3, 6, 6))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shapes():
    """The default model's sides at 220 pixels."""
    p = Params()
    levels = images.pyramid(np.zeros((220, 220), np.float32), 9, 1 / p.scale_factor)
    assert [len(x) for x in levels] == [220, 185, 156, 131, 110, 92, 77, 65, 55]
    bank = kernels.gabor_bank(11, 1, 1)
    made = packed.layers_of(np.random.default_rng(0).random((220, 220)).astype(np.float32), p, bank, [kernels.random_bank(2, (1, 7, 7), 0)], {"s1", "c1", "s2", "c2"})
    assert [x.shape[1] for _, _, x in made["s1"]] == [210, 175, 146, 121, 100, 82, 67, 55, 45]
    assert [x.shape[1] for _, _, x in made["c1"]] == [40, 33, 27, 22, 18, 14, 11, 9, 7]
    assert [x.shape[1] for _, _, x in made["s2"]] == [34, 27, 21, 16, 12, 8, 5, 3, 1]
    assert geometry.minimum_side(p) == 55 and geometry.scales_supported(p, 220) == 9


@pytest.mark.parametrize("method,length,ratio,size", [(ResizeMethod.SHORT_EDGE, 256, 1.0, (256, 512)), (ResizeMethod.LONG_EDGE, 256, 1.0, (128, 256)), (ResizeMethod.WIDTH, 256, 1.0, (256, 512)), (ResizeMethod.HEIGHT, 256, 1.0, (128, 256)), (ResizeMethod.SCALE_AND_CROP, 256, 0.5, (256, 512)), (ResizeMethod.SCALE_AND_CROP, 100, 1.0, (100, 100)), (ResizeMethod.SCALE_AND_CROP, 256, 0.25, (256, 1024))])
def test_resize_sizes(method, length, ratio, size):
    p = Params(image_resize_method=method, image_resize_length=length, image_resize_aspect_ratio=ratio)
    x = np.full((200, 100), 0.25, np.float32)
    assert images.target_size(p, 200, 100) == size[::-1]
    assert np.allclose(images.prepare(x, p), 0.25, atol=1e-5)


def test_too_small():
    with pytest.raises(packed.InputSizeError):
        packed.windows(np.zeros((1, 5, 5)), 6, 1)


def test_params():
    assert Params(s2_kwidth=7).s2_kwidth == [7]
    for bad in ({"s1_kwidth": 0}, {"scale_factor": 0.5}, {"retina_bias": -1}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            Params.from_dict(bad)
    assert Params.from_dict(Params().to_dict()) == Params()
