"""The hidden Markov model against plain counts, a plain forward recursion and a plain Baum-Welch round."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import hidden_markov as M
from stratalens.llm import textbatch as T
from stratalens.llm.queries import QUERIES
from stratalens.llm.store import Store

SCHEMA = "doc_id long, text string, score string, slice string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]  # None is the end


def hashed(word):
    data = np.frombuffer((word or "").encode(), np.uint8)
    return np.int64(M.END_WORD) if word is None else T.span_hashes(data, [0], [len(data)]).view(np.int64)[0]


def class_of(word):
    return int(M.classes(np.array([hashed(word)]))[0])


def forward(model, classes):
    now, total = model.start.copy(), 0.0
    for c in classes:
        now = now * model.emit[c]
        total += math.log10(now.sum())
        now = now / now.sum() @ model.step
    return total


def random_model(classes, seed=0):
    draw = np.random.default_rng(seed)
    emit = draw.uniform(0.01, 1, (classes, M.STATES))
    odds = lambda *size: M._normal(draw.uniform(0.1, 1, size))
    return M.Model(odds(M.STATES), odds(M.STATES, M.STATES), emit / emit.sum(axis=0), odds(M.STATES))


LENGTHS = [1, 2, 31, 32, 33, 64, 65, 1, 200, 5000]


def test_exact_likelihood():
    model, draw = random_model(50), np.random.default_rng(1)
    n = np.array(LENGTHS)
    seq = draw.integers(0, 50, n.sum())
    got = M.Blocks(seq, n).likelihood(model)
    want = [forward(model, s) for s in np.split(seq, np.cumsum(n)[:-1])]
    assert np.allclose(got, want, rtol=1e-10)


def test_expected_counts():
    """Against forward and backward recursions token by token."""
    model, draw = random_model(20, 2), np.random.default_rng(3)
    n = np.array([1, 2, 31, 32, 33, 70])
    seq = draw.integers(0, 20, n.sum())
    start, steps, emit = np.zeros(M.STATES), np.zeros((M.STATES, M.STATES)), np.zeros((20, M.STATES))
    first = np.array([True, False, True, True, False, True])
    for s, own in zip(np.split(seq, np.cumsum(n)[:-1]), first):
        a, b = np.zeros((len(s), M.STATES)), np.ones((len(s), M.STATES))
        for t in range(len(s)):
            a[t] = ((model.start if own else model.share) if t == 0 else a[t - 1] @ model.step) * model.emit[s[t]]
            a[t] /= a[t].sum()
        for t in range(len(s) - 2, -1, -1):
            b[t] = model.step @ (b[t + 1] * model.emit[s[t + 1]])
            b[t] /= b[t].sum()
        gamma = M._normal(a * b)
        start += gamma[0] * own
        np.add.at(emit, s, gamma)
        for t in range(len(s) - 1):
            xi = a[t][:, None] * model.step * (model.emit[s[t + 1]] * b[t + 1])[None]
            steps += xi / xi.sum()
    for x, y in zip(M.expect(model, seq, n, first), (start, steps, emit)):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-4)


def corpus():
    draw = random.Random(4)
    themes = [[f"{t}{k}" for k in range(40)] for t in ("Ax", "by", "cz", "dü")]
    rows = []
    for k in range(400):
        theme = themes[k % 4]
        rows.append((k, " ".join(draw.choice(theme) for _ in range(draw.randrange(1, 60))), "x", "y"))
    rows += [(None, "Ax1 by1", "x", "y"), (500, None, "x", "y"), (501, "", "x", "y"), (502, " \t\n", "x", "y"), (503, "word " * 70_000, "x", "y"), (504, "unseen words here", "x", "y")]
    return rows + [rows[5], rows[5]]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_against_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = M.score(docs, out, rounds=3).collect()
    slices, words = M.prepared(docs, out, Store(spark, "again"))
    sizes, kinds = M.class_sizes(words)
    model = M.train(slices, sizes, 3)
    count = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    by_class, kinds_of = Counter(), Counter()
    for w, c in count.items():
        by_class[class_of(w)] += c
        kinds_of[class_of(w)] += 1
    assert dict(by_class) == {k: int(v) for k, v in enumerate(sizes) if v} and dict(kinds_of) == {k: int(v) for k, v in enumerate(kinds) if v}
    want = []
    for d, t, *_ in rows:
        s = tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in s)
        within = sum(math.log10((count[w] + 1) / (by_class[class_of(w)] + kinds_of[class_of(w)] + 1)) for w in s)
        want.append((d, held(d), len(s), sum(count[w] > 0 for w in s), total, base, forward(model, [class_of(w) for w in s]) + within))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_pieces():
    import pyarrow as pa

    texts = pa.table({"n": [3, 600, 256, 1], "learns": [True, True, False, True]})
    seq, n, first = M._pieces(np.arange(860), texts)
    assert n.tolist() == [3, 256, 256, 88, 1] and first.tolist() == [True, True, False, False, True]
    assert seq.tolist() == [*range(603), 859]


def test_learns(spark):
    """Texts of one theme each: the states find the themes, so held-out texts are likelier than by counts alone."""
    rows = spark.createDataFrame(corpus()[:400], SCHEMA)
    got = [r for r in M.score(rows, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


def test_probabilities_sum_to_one():
    model = random_model(3, 5)
    total = sum(10 ** forward(model, s) for s in np.ndindex(3, 3, 3))
    assert total == pytest.approx(1)


def test_empty_and_untrained(spark):
    none = M.score(spark.createDataFrame([], SCHEMA), F.lit(False))
    assert none.count() == 0
    (row,) = M.score(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), F.lit(True)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_query(spark):
    got = QUERIES["op11_hidden_markov"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
