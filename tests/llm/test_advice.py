"""Cases that the review found to be decided less than wholly."""

import random
import string

import numpy as np
import pytest

import corpus_pipeline
from stratalens.llm import line_dedup, secrets


def test_op6_long_random_runs(spark):
    draw = random.Random(6)
    words = ["quick", "brown", "jumps", "over", "lazy", "river", "stone", "under", "green", "table"]
    prose = ["".join(draw.choice(words) for _ in range(5)) for _ in range(6000)]
    alphabet = string.ascii_letters + string.digits + "+/"
    runs = [(n, "".join(draw.choice(alphabet) for _ in range(n))) for n in (20, 64, 256, 600, 1000, 4000) for _ in range(20)]
    rows = [(k, " ".join(prose[k * 50 : k * 50 + 50])) for k in range(120)] + [(1000 + k, r) for k, (_, r) in enumerate(runs)]
    found = {r["doc_id"]: len(r["random"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in {n for n, _ in runs}:
        assert sum(found[1000 + k] for k, (m, _) in enumerate(runs) if m == n) >= 17
    assert sum(found[k] for k in range(120)) == 0


@pytest.mark.parametrize("shared, union", [(4, 5), (5, 6), (8, 10), (9, 11), (16, 20), (24, 30), (80, 100)])
def test_op3_bands_of_short_lines(shared, union):
    h = np.random.default_rng(3).integers(0, 1 << 63, (4000, union), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cut = union - (union - shared) // 2
    sets = h[:, :cut], np.concatenate([h[:, :shared], h[:, cut:]], axis=1)
    (a, x), (b, y) = (line_dedup.signatures(np.ascontiguousarray(s).reshape(-1), np.arange(4001) * s.shape[1]) for s in sets)
    met = (a == b).any(axis=1) & (np.bitwise_count(x ^ y) <= line_dedup.BANDS * line_dedup.ROWS - line_dedup.NEAR)
    assert met.mean() > 0.97


def test_op3_short_lines(spark):
    draw = random.Random(3)
    lines = ["".join(draw.choice(string.ascii_lowercase) for _ in range(9)) for _ in range(300)]
    rows = [(2 * k + i, x + "." * i) for k, x in enumerate(lines) for i in (0, 1)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_dropped_lines"] == 0 for r in got if r["doc_id"] % 2 == 0)
    assert sum(r["n_dropped_lines"] for r in got) >= 294


def test_pipeline_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, "12 34", None), (3, None, None), (4, "\u4e2d", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a clean text", None), (4, "\u4e2d", None)]
