"""Command line: corpus, prototypes, layer, evaluation."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import REGRESSION_SAMPLES, Experiment, histogram_builder
from .operators import learn, packed, prototypes
from .params import Params
from .sources import images


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalens", description=__doc__)
    p.add_argument("-c", "--corpus", help="folder with a folder of images for each class")
    p.add_argument("-C", "--classes", nargs="+", help="classes, in order")
    p.add_argument("--split", nargs=2, metavar=("TRAIN", "TEST"), help="corpora for training and testing")
    p.add_argument("-b", "--balance", action="store_true")
    p.add_argument("--param-file", help="JSON parameters")
    p.add_argument("-P", "--param", action="append", default=[], metavar="NAME=JSON")
    p.add_argument("-n", "--num-prototypes", type=int, default=10)
    p.add_argument("-p", "--prototypes", default="imprint", choices=sorted([*prototypes.ALGORITHMS, *prototypes.WEIGHTED]))
    p.add_argument("--prototype-file", help="prototypes as numpy arrays, instead of learning them")
    p.add_argument("--masks", help="Parquet table of masks: image_id, y, x, m (0: foreground)")
    p.add_argument("--base-weight", type=float, default=0.0)
    p.add_argument("--regr-samples", type=int, default=REGRESSION_SAMPLES)
    p.add_argument("--low", type=float, default=0.0, help="of uniform prototypes")
    p.add_argument("--high", type=float, default=1.0)
    p.add_argument("-H", "--histogram", type=int, metavar="BINS", help="count features in bins instead of using their values")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--timing", action="store_true", help="print the seconds of each step")
    p.add_argument("--samples", type=int)
    p.add_argument("-l", "--layer", nargs="+", default=["c2"])
    p.add_argument("-E", "--evaluate", action="store_true")
    p.add_argument("-x", "--cross-validate", action="store_true")
    p.add_argument("-f", "--folds", type=int, default=10)
    p.add_argument("-t", "--train-size", type=float, default=0.5)
    p.add_argument("-S", "--score", default="accuracy", choices=learn.SCORES)
    p.add_argument("-L", "--learner", default="svm", choices=sorted(learn.LEARNERS))
    p.add_argument("--predictions", action="store_true")
    p.add_argument("--svmlight", help="write features in libsvm format")
    p.add_argument("-o", "--output", help="store the experiment")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    values = json.load(open(a.param_file)) if a.param_file else {}
    values |= {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.param)}
    if not a.corpus and not a.split:
        parser().error("a corpus is needed")
    spark = SparkSession.builder.getOrCreate()
    e = Experiment(spark, Params.from_dict(values), verbose=a.verbose)
    e = e.set_corpus_split(*a.split) if a.split else e.set_corpus(a.corpus, a.classes, a.balance)
    if a.prototype_file:
        e.set_prototypes(a.prototype_file)
    elif {"s2", "c2"} & set(a.layer):
        more = {"low": a.low, "high": a.high} if a.prototypes == "uniform" else {}
        masks = spark.read.parquet(a.masks) if a.masks else None
        e.make_prototypes(a.num_prototypes, a.prototypes, a.samples, masks, a.base_weight, a.regr_samples, **more)
    e.compute_activation(*a.layer)
    builder = histogram_builder(a.histogram) if a.histogram else packed.features
    if a.evaluate and a.cross_validate:
        print(json.dumps({"scores": e.cross_validate(learner=a.learner, folds=a.folds)}))
    elif a.evaluate:
        out = e.evaluate(learner=a.learner, score_func=a.score, train_size=a.train_size, feature_builder=builder)
        print(json.dumps({"training_score": out["training_score"], "score": out["score"]}))
        if a.predictions:
            for training in (True, False):
                for r in e.predictions(training=training).orderBy("image_id").toLocalIterator():
                    print("train" if training else "test", r["image_id"], r["label"], r["prediction"])
    if a.timing:
        for what, seconds in e.times.items():
            print(f"{what}: {seconds:.3f} s")
    if a.svmlight:
        images.write_svmlight(e.features().join(e.corpus, "image_id"), a.svmlight)
    if a.output:
        e.store(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
