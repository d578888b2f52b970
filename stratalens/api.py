"""A session of one experiment: corpus, prototypes, activation, evaluation, in that order.

Each call checks that what it needs is there. Parameters and corpus are fixed once a layer has been computed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, kernels
from .operators import analysis, corpus, learn, learners, packed, prototypes, sampling
from .params import Params
from .plans import dag, models
from .sources import images
from .sources.scratch import written

FeatureBuilder = Callable[[DataFrame, tuple[str, ...]], DataFrame]
#: Imprinted prototypes that rate patches by their use to a classifier.
REGRESSION_SAMPLES = 250


class ExperimentError(RuntimeError):
    """A step was asked for before those that it needs, or after those that fix it."""


def histogram_builder(bins: int = 10, low: float = 0.0, high: float = 1.0) -> FeatureBuilder:
    """Features that count the values of each band in bins, over all scales and places."""

    def build(maps: DataFrame, layers: tuple[str, ...]) -> DataFrame:
        cells = maps.where(F.col("layer").isin(*layers)).select("image_id", "layer", "kwidth", "shape", F.posexplode("data").alias("i", "v"))
        band = F.concat_ws(":", "layer", "kwidth", F.floor(F.col("i") / (F.col("shape")[1] * F.col("shape")[2])).cast("string"))
        return analysis.histogram_vectors(cells.select("image_id", band.alias("band"), "v"), bins, low, high)

    return build


class Experiment:
    def __init__(self, spark: SparkSession, params: Params | None = None, seed: int = 0, verbose: bool = False):
        self.spark, self.params, self.seed, self.verbose = spark, params or Params(), seed, verbose
        self.corpus: DataFrame | None = None
        self.grey: DataFrame | None = None
        self.banks: list[np.ndarray] | None = None
        self.places: DataFrame | None = None
        self.maps: DataFrame | None = None
        self.layers: tuple[str, ...] = ()
        self.evaluations: list[dict] = []
        self.model: models.Model = models.resolve("ml")
        self.times: dict[str, float] = {}

    def _need(self, what: str) -> None:
        if getattr(self, what) is None:
            raise ExperimentError(f"{what} must be set first")

    def _timed(self, what: str, began: float) -> None:
        self.times[what] = time.monotonic() - began
        if self.verbose:
            print(f"{what}: {self.times[what]:.3f} s")

    def set_params(self, **values) -> None:
        if self.maps is not None or self.banks is not None:
            raise ExperimentError("parameters are fixed once layers have been computed")
        self.params = Params.from_dict(self.params.to_dict() | values)

    @property
    def s1_bank(self) -> np.ndarray:
        p = self.params
        return kernels.gabor_bank(p.s1_kwidth, p.s1_num_orientations, p.s1_num_phases, p.s1_shift_orientations)

    # corpus

    def _new_corpus(self) -> None:
        if self.corpus is not None:
            raise ExperimentError("the corpus has been set")

    def set_corpus(self, root: str, classes: list[str] | None = None, balance: bool = False) -> Experiment:
        """Classes are the folders of root, sorted, or those given, in order."""
        self._new_corpus()
        found = images.read_corpus(self.spark, root, classes)
        if found.isEmpty():
            raise ValueError(f"no images in folders of {root}")
        self.corpus = corpus.balance(found, "label", "image_id") if balance else found
        self.grey = images.load_grey(self.spark, self.corpus, root, self.params)
        return self

    def set_corpus_split(self, train: str, test: str) -> Experiment:
        """Train rows come first."""
        self._new_corpus()
        a, b = (images.read_corpus(self.spark, x) for x in (train, test))
        shift = a.count()
        both = corpus.join_split(a, b.withColumn("image_id", F.col("image_id") + shift))
        self.corpus = both
        parts = [images.load_grey(self.spark, both.where(F.col("is_train") == own), x, self.params) for x, own in ((train, True), (test, False))]
        self.grey = parts[0].unionByName(parts[1])
        return self

    def set_images(self, rows: DataFrame, grey: DataFrame) -> Experiment:
        """rows: image_id, label; grey: image_id, height, width, data, of height * width numbers each."""
        self._new_corpus()
        size = F.size("data") == F.col("height") * F.col("width")
        fits = F.assert_true(size & ~F.exists("data", lambda v: v.isNull() | F.isnan(v)), F.lit("an image isn't height x width numbers"))
        self.corpus, self.grey = rows, grey.where(F.isnull(fits))
        return self

    def _training(self) -> DataFrame:
        if "is_train" not in self.corpus.columns:
            self.corpus = corpus.choose_training(self.corpus, "label", "image_id", 0.5)
        return self.corpus.where("is_train")

    # prototypes

    def draw_patches(self, count: int) -> DataFrame:
        """(patch_id, kwidth, image_id, scale, y0, x0, data): count patches of each width of the training images' C1 maps."""
        self._need("corpus")
        return written(sampling.patches_of(self.grey, self._training().select("image_id"), count, self.params, self.s1_bank, self.seed), "patches")

    def make_prototypes(self, n: int, algorithm="imprint", samples: int | None = None, masks: DataFrame | None = None, base_weight: float = 0.0, regression_samples: int = REGRESSION_SAMPLES, **options) -> Experiment:
        """n prototypes of each width, learned from patches of the training images' C1 maps. Only images with a
        drawn place are computed: samples of them (10 n if it learns). Learners read the table of patches; a caller's own function gets it as an array.

        Weighted learners take patches' weights from masks (image_id, and y, x, m or height, width, data; 0 is foreground), or from the
        use that a classifier makes of like prototypes; they learn one width only."""
        self._need("corpus")
        if n <= 0:
            raise ValueError("a number of prototypes is needed")
        began = time.monotonic()
        name = algorithm.lower() if isinstance(algorithm, str) else ""
        weighted = prototypes.WEIGHTED.get(name)
        if weighted:
            algorithm, options = "kmeans", options | {"weight": F.col("w")}
        prototypes.resolve(algorithm)
        if weighted and len(self.params.s2_kwidth) > 1:
            raise ValueError("weighted learners make prototypes of one width")
        drawn = self.draw_patches(samples or (n if name in ("imprint", "shuffle") else 10 * n))
        banks = []
        for k in self.params.s2_kwidth:
            rows = drawn.where(F.col("kwidth") == k).select(F.col("patch_id").alias("id"), F.col("data").cast("array<double>").alias("features"))
            if weighted:
                rows = written(self._weighted(weighted, rows, drawn, masks, base_weight, regression_samples), "weighted")
            banks.append(prototypes.learned(algorithm, n, rows, (self.params.s1_num_orientations, k, k), **options))
        self.banks, self.places = banks, drawn.drop("data")
        self._timed("prototypes", began)
        return self

    def _weighted(self, kind: str, rows: DataFrame, drawn: DataFrame, masks: DataFrame | None, base: float, regression_samples: int) -> DataFrame:
        if kind == "mask":
            if masks is None:
                raise ValueError("masks are needed")
            box = geometry.receptive_field(self.params, F.col("scale"), F.col("y0"), F.col("x0"), self.params.s2_kwidth[0])
            boxes = drawn.select(F.col("patch_id").alias("box_id"), "image_id", *(v.alias(k) for k, v in box.items()))
            arrays = masks if "data" in masks.columns else analysis.mask_arrays(masks)
            return prototypes.mask_weights(rows, analysis.foreground_ratio(boxes, arrays), base)
        return prototypes.use_weights(rows, *self._rated(regression_samples))

    def _rated(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Imprinted prototypes, and the coefficients that a classifier of their activation gives them."""
        other = Experiment(self.spark, self.params, self.seed + 1)
        other.corpus, other.grey = self.corpus, self.grey
        other.make_prototypes(n).compute_activation("c2")
        return other.banks[0], learn.coefficients(other.evaluate(learner="svm")["model"])

    def set_prototypes(self, banks: list[np.ndarray] | str) -> Experiment:
        """Arrays for each width, or a file of them (numpy's npz, arrays in order of name)."""
        if isinstance(banks, str):
            with np.load(banks) as held:
                banks = [held[k] for k in sorted(held.files)]
        bands = self.params.s1_num_orientations
        if len(banks) != len(self.params.s2_kwidth):
            raise ValueError(f"{len(self.params.s2_kwidth)} arrays of prototypes are needed")
        for bank, k in zip(banks, self.params.s2_kwidth):
            if bank.ndim != 4 or bank.shape[1:] != (bands, k, k) or np.isnan(bank).any():
                raise ValueError(f"prototypes must be (n, {bands}, {k}, {k}) numbers")
            if not np.allclose((bank**2).sum(axis=(1, 2, 3)), 1, atol=1e-3):
                raise ValueError("prototypes must have norm 1")
        self.banks, self.places = list(banks), None
        return self

    def save_prototypes(self, path: str) -> None:
        self._need("banks")
        np.savez(path, **{f"bank{i:03d}": b for i, b in enumerate(self.banks)})

    # activation

    def set_model(self, model: str | models.Model) -> Experiment:
        """The model, by name or as a function, that build_layer() takes layers from."""
        if self.maps is not None:
            raise ExperimentError("the model is fixed once layers have been computed")
        self.model = models.resolve(model)
        return self

    def build_layer(self, layer: str, state: dict[str, DataFrame] | None = None) -> DataFrame:
        """A layer's maps, from a state of stored layers by their ids, or from the corpus's images."""
        if not state:
            self._need("corpus")
            shape = F.array(F.lit(1), F.col("height"), F.col("width")).cast("array<int>")
            state = {"i": self.grey.select("image_id", F.lit("image").alias("layer"), F.lit(0).alias("scale"), F.lit(0).alias("kwidth"), shape.alias("shape"), "data")}
        return self.model(self.params, self.s1_bank, self.banks).build(layer, state)[layer]

    def compute_activation(self, *layers: str) -> Experiment:
        """Computes the layers once, and keeps them as a table. Where a layer at or below all of them has been computed
        before, they are made from the highest such one instead of from the images."""
        self._need("corpus")
        layers = layers or ("c2",)
        if {"s2", "c2"} & set(layers):
            self._need("banks")
        began = time.monotonic()
        stored = [x for x in self.layers if x in packed.ORDER and all(packed.ORDER.index(x) <= packed.ORDER.index(w) for w in layers)]
        if self.maps is not None and stored:
            below = max(stored, key=packed.ORDER.index)
            made = packed.climb(self.maps.where(F.col("layer") == below), self.params, self.s1_bank, self.banks, layers)
        else:
            made = packed.build(self.grey, self.params, self.s1_bank, self.banks, layers)
        self.layers, self.maps = layers, written(made, "maps")
        self._timed("activation", began)
        return self

    def features(self, *layers: str, builder: FeatureBuilder = packed.features) -> DataFrame:
        self._need("maps")
        return builder(self.maps, self.resolve_layers(*layers))

    def resolve_layers(self, *layers: str) -> tuple[str, ...]:
        """The layers asked for, by id or name, else those computed; only computed ones have features."""
        known = {x.name.lower(): x.id for x in dag.LAYERS} | {x.id: x.id for x in dag.LAYERS} | {x.name.lower(): x.name.lower() for x in dag.LAYERS if x.name.lower() in packed.ORDER}
        out = tuple(x.lower() if x.lower() in packed.ORDER else known.get(x.lower(), x) for x in layers) or self.layers
        if missing := set(out) - set(self.layers):
            raise ExperimentError(f"layers that have not been computed: {sorted(missing)}")
        return out

    def image_features(self, grey: DataFrame, *layers: str) -> DataFrame:
        """Features of images outside the corpus."""
        layers = layers or ("c2",)
        return packed.features(packed.build(grey, self.params, self.s1_bank, self.banks, layers), layers)

    def activity(self, image_id: int, layer: str) -> DataFrame:
        """(scale, kwidth, band, y, x, v) of one image's layer, from the table if it was computed, else now."""
        self._need("corpus")
        have = self.maps is not None and layer in self.layers
        maps = self.maps if have else packed.build(self.grey.where(F.col("image_id") == image_id), self.params, self.s1_bank, self.banks, (layer,))
        cells = maps.where((F.col("image_id") == image_id) & (F.col("layer") == layer)).select("scale", "kwidth", "shape", F.posexplode("data").alias("i", "v"))
        h, w = F.col("shape")[1], F.col("shape")[2]
        div = lambda a, b: F.floor(a / b).cast("int")
        return cells.select("scale", "kwidth", div(F.col("i"), h * w).alias("band"), (div(F.col("i"), w) % h).alias("y"), (F.col("i") % w).cast("int").alias("x"), "v")

    # evaluation

    def _rows(self, *layers: str, builder: FeatureBuilder = packed.features) -> DataFrame:
        return self.features(*layers, builder=builder).join(self.corpus, "image_id")

    def evaluate(self, *layers: str, learner="svm", score_func="accuracy", train_size: float = 0.5, feature_builder: FeatureBuilder = packed.features) -> dict:
        """Splits by the images that prototypes were learned from or the corpus's own split, else by class."""
        began = time.monotonic()
        out = learn.train_and_test(self._rows(*layers, builder=feature_builder), learner, score_func, train_size)
        self.evaluations.append(out | {"layers": self.resolve_layers(*layers), "score_func": score_func if isinstance(score_func, str) else getattr(score_func, "__name__", "score")})
        self._timed("evaluation", began)
        return out

    def cross_validate(self, *layers: str, learner="svm", folds: int = 10) -> list[float]:
        return learn.cross_validate(self._rows(*layers), learner, folds)

    def _evaluation(self, k: int) -> dict:
        if not self.evaluations:
            raise ExperimentError("evaluate first")
        return self.evaluations[k]

    def predictions(self, evaluation: int = -1, training: bool = False) -> DataFrame:
        rows = self._evaluation(evaluation)["predictions"]
        return rows.where(F.col("is_train") == training).select("image_id", "label", "prediction")

    def evaluation_layers(self, evaluation: int = -1) -> tuple[str, ...]:
        return tuple(self._evaluation(evaluation)["layers"])

    def evaluation_results(self, evaluation: int = -1) -> dict:
        return {k: self._evaluation(evaluation)[k] for k in ("score_func", "training_score", "score")}

    # looking at it

    def image_paths(self) -> list[str]:
        self._need("corpus")
        return [r["path"] for r in self.corpus.select("image_id", "path").orderBy("image_id").toLocalIterator()]

    def training_set(self) -> DataFrame:
        """(image_id, is_train): the corpus's split, that of the prototypes, else that of the last evaluation."""
        self._need("corpus")
        if "is_train" in self.corpus.columns:
            return self.corpus.select("image_id", "is_train")
        if not self.evaluations:
            raise ExperimentError("no training set has been chosen")
        return self.evaluations[-1]["predictions"].select("image_id", "is_train")

    def num_prototypes(self, kwidth: int = 0) -> int:
        self._need("banks")
        return len(self.banks[kwidth])

    def num_kernel_widths(self) -> int:
        return len(self.params.s2_kwidth)

    def prototype(self, k: int, kwidth: int = 0) -> np.ndarray:
        self._need("banks")
        return self.banks[kwidth][k]

    def kernel_cells(self, bank: np.ndarray) -> DataFrame:
        """(kernel, band, ky, kx, w) of a bank, as data for plots."""
        return kernels.frame(self.spark, bank)

    def imprint_location(self, k: int, kwidth: int = 0) -> dict:
        """image_id, scale, y0 and x0 of an imprinted prototype."""
        if self.places is None:
            raise ExperimentError("prototypes were not drawn from images")
        here = self.places.where(F.col("kwidth") == self.params.s2_kwidth[kwidth])
        at = learners.digest_order(here, "patch_id").limit(k + 1).collect()[k]  # the prototypes
        return {c: at[c] for c in ("image_id", "scale", "y0", "x0")}

    def receptive_field(self, scale: int, y: int, x: int, kwidth: int = 0) -> dict:
        box = geometry.receptive_field(self.params, F.lit(scale), F.lit(y), F.lit(x), self.params.s2_kwidth[kwidth])
        return self.spark.range(1).select(*(v.alias(k) for k, v in box.items())).first().asDict()

    def image_patch(self, k: int, kwidth: int = 0) -> np.ndarray:
        """The part of the image that an imprinted prototype was cut from."""
        at = self.imprint_location(k, kwidth)
        box = self.receptive_field(at["scale"], at["y0"], at["x0"], kwidth)
        r = self.grey.where(F.col("image_id") == at["image_id"]).first()
        return np.array(r["data"], np.float32).reshape(r["height"], r["width"])[box["top"] : box["bottom"], box["left"] : box["right"]]

    def best_match(self, image_id: int, k: int, kwidth: int = 0) -> dict:
        """Where a prototype matches an image best: scale, y, x and v of S2, and the box in the image, for an overlay."""
        self._need("banks")
        cells = self.activity(image_id, "s2").where((F.col("kwidth") == kwidth) & (F.col("band") == k)).withColumn("image_id", F.lit(image_id))
        at = analysis.best_match(cells).first()
        return {c: at[c] for c in ("scale", "y", "x", "v")} | self.receptive_field(at["scale"], at["y"], at["x"], kwidth)

    # stores

    def store(self, path: str) -> None:
        """Tables, prototypes, places, layers and evaluations; load() brings them back."""
        self._need("corpus")
        tables = {"corpus": self.corpus, "grey": self.grey} | {k: v for k, v in {"maps": self.maps, "places": self.places}.items() if v is not None}
        for i, bank in enumerate(self.banks or []):
            tables[f"kernels{i}"] = kernels.frame(self.spark, bank)
        for i, e in enumerate(self.evaluations):
            rows = e["predictions"]
            tables[f"predictions{i}"] = rows.select([c for c in ("image_id", "label", "is_train", "prediction", "margins") if c in rows.columns])
        more = {"seed": self.seed, "layers": self.layers, "evaluations": [{k: e[k] for k in ("layers", "score_func", "training_score", "score")} for e in self.evaluations]}
        images.store_experiment(path, self.params, json.dumps(more), **tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Experiment:
        params, tables, more = images.load_experiment(spark, path)
        more = json.loads(more or "{}")
        e = cls(spark, params, more.get("seed", 0))
        e.corpus, e.grey, e.maps, e.places = (tables.get(k) for k in ("corpus", "grey", "maps", "places"))
        e.layers = tuple(more.get("layers", ()))
        banks = [kernels.array(tables[k]) for k in sorted((t for t in tables if t.startswith("kernels")), key=lambda t: int(t[7:]))]
        e.banks = banks or None
        e.evaluations = [x | {"layers": tuple(x["layers"]), "predictions": tables[f"predictions{i}"]} for i, x in enumerate(more.get("evaluations", []))]
        return e
