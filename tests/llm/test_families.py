"""Large families, the forest's recall, and methods against plain implementations."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import byte_cnn, minhash_dedup, secrets
from stratalens.llm.store import Store

SCHEMA = "doc_id long, text string"


def shingles(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(sets, num, den):
    """The smallest id of each id's component, by all pairs."""
    ids, root = sorted(sets), {k: k for k in sets}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in ids}


def templated(n, words=60, seed=0):
    """Texts of one template with some words of their own: pairs of similarity about 0.85, above it and below it."""
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 4, 9])):
            w[draw.randrange(words)] = f"x{draw.randrange(30)}"
        out.append((k, " ".join(w)))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("whole", [2, 16])
def test_op1_one_family_in_tiles(spark, monkeypatch, whole):
    monkeypatch.setattr(minhash_dedup, "TILE", 32)
    monkeypatch.setattr(minhash_dedup, "WHOLE", whole)
    rows = templated(400)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), n=3, num=85, den=100).collect()}
    assert got == components({k: shingles(t, 3) for k, t in rows}, 85, 100)
    assert len(set(got.values())) > 5


def test_confirmed_work_is_linear_when_a_family_is_one(spark, monkeypatch):
    """A family of 20,000 whose members are alike: each text is sent once, the first to every tile."""
    n, sent = 20_000, []
    true = minhash_dedup._compared

    def counted(tiled, *more):
        sent.append(tiled.count())
        return true(tiled, *more)

    monkeypatch.setattr(minhash_dedup, "_compared", counted)
    base = " ".join(f"w{k}" for k in range(30))
    ids = spark.range(n).withColumnRenamed("id", "n")
    sets = ids.select(F.col("n").alias("id"), F.concat(F.lit(base + " y"), (F.col("n") % 7).cast("string")).cast("binary").alias("payload")).orderBy(F.rand(1))
    member = ids.select(F.col("n").alias("id"), F.lit(0).cast("long").alias("family"), F.lit(n).cast("long").alias("size"))
    store = Store(spark, "linear")
    links = minhash_dedup.confirmed(sets, member, 8, 10, minhash_dedup.word_sets(5), store, "confirmed")
    assert sum(sent) <= n + n // minhash_dedup.TILE + 1
    root = minhash_dedup.families(minhash_dedup.components(links, store, "links"))
    assert root.where("family = 0").count() == n


def test_op1_forest_recall_in_crowded_regions(spark):
    """Pairs of similarity 0.85 to 0.9 in families so alike (0.5 to 0.8) that regions of three shared values hold more than 64 rows."""
    draw, pairs, rows = random.Random(3), [], []
    base = [f"w{k}" for k in range(150)]
    for k in range(400):
        w = list(base)
        for at in draw.sample(range(0, 150, 3), draw.choice([6, 9, 12])):
            w[at] = f"own{k}x{at}"
        twin = list(w)
        for at in draw.sample(range(0, 150, 3), 3):
            twin[at] = f"twin{k}x{at}"
        a, b = shingles(" ".join(w), 3), shingles(" ".join(twin), 3)
        if 0.85 <= len(a & b) / len(a | b) < 0.9:
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(twin))]
    assert len(pairs) > 100
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), n=3, num=85, den=100).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert got == components({k: shingles(t, 3) for k, t in rows}, 85, 100)


def test_op9_forward_pass_by_hand(spark):
    """Windows, filters, pooling and softmax byte by byte."""
    draw = np.random.default_rng(9)
    m = byte_cnn.FILTERS * len(byte_cnn.WIDTHS)
    net = byte_cnn.Model(["a", "b", "c"], draw.normal(size=(65536, m)).astype(np.float32), draw.normal(size=(65536, m)).astype(np.float32), draw.normal(size=m).astype(np.float32), draw.normal(size=(m, 3)).astype(np.float32), draw.normal(size=3).astype(np.float32))
    texts = ["x", "word", "z" * 256, "ab " * 90, "é" * 300, "q" * 255 + "end", "12 34", "", None]
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in byte_cnn.predict(spark.createDataFrame([(t,) for t in texts], "text string"), net).collect()}
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            assert got[text] == ("und", 0.0)
            continue
        data = text.encode()
        total = np.zeros(3)
        for at in range(0, len(data), byte_cnn.WINDOW):
            end, best = min(at + byte_cnn.WINDOW, len(data)), np.full(m, -np.inf)
            byte = lambda i: data[i] if i < len(data) else 0
            for i in range(at, at + byte_cnn.WINDOW):
                # a window sees as many bytes after it as its widest filter reaches; beyond the text all are 0
                b = [byte(i + k) for k in range(4)]
                best = np.maximum(best, net.first[b[0] * 256 + b[1]] + net.second[b[2] * 256 + b[3]])
            z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
            total += (end - at) * (z - z.max() - math.log(np.exp(z - z.max()).sum()))
        mean = total / len(data)
        odds = np.exp(mean - mean.max())
        assert got[text][0] == "abc"[int(mean.argmax())] and got[text][1] == pytest.approx(odds.max() / odds.sum(), rel=1e-4)


def plain_p(run):
    """The battery of tests on one run, by its formulas."""
    body = run.rstrip("=")
    digits, upper, lower = string.digits, string.ascii_uppercase, string.ascii_lowercase
    only = lambda a: all(c in a for c in body)
    alphabet = digits + "abcdef" if only(digits + "abcdef") else digits + "ABCDEF" if only(digits + "ABCDEF") else upper + "234567" if only(upper + "234567") else upper + lower + digits if only(upper + lower + digits) else upper + lower + digits + ("-_" if set(body) & set("-_") else "+/")
    k, n = len(alphabet), max(len(body), 2)
    chi = (k / n * sum(body.count(c) ** 2 for c in alphabet) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
    classes = 1.0
    if k >= 62:
        groups = [set(upper), set(lower), set(digits + "+/_=-")]
        seen = [(sum(c in g for c in body), n * sum(c in g for c in alphabet) / k) for g in groups]
        classes = math.exp(-sum((o - e) ** 2 / e for o, e in seen) / 2)
    x = [float(alphabet.find(c) + 1) for c in body]
    high = [2 * v > k + 1 for v in x]
    both = 2 * sum(high) * (n - sum(high))
    spread = both * (both - n) / (n * n * (n - 1))
    runs = (1 + sum(a != b for a, b in zip(high, high[1:])) - both / n - 1) / math.sqrt(spread) if spread > 0 else 12.0
    mean = sum(x) / n
    around = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / around * math.sqrt(n) if around > 0 else 12.0
    tail = lambda z: 2 / (1 + math.exp(1.5976 * min(abs(z), 12) + 0.070566 * min(abs(z), 12) ** 3))
    return max(min(4 * min(tail(chi), classes, tail(runs), tail(serial)), 1.0), 1e-100)


def test_op6_p_values(spark):
    """Against the formulas one run at a time; on random runs a p-value below 0.05 is about as rare as it says."""
    draw = random.Random(6)
    alphabets = [string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    made = ["".join(draw.choice(a) for _ in range(draw.randrange(20, 120))) for a in alphabets for _ in range(150)]
    odd = ["a" * 40, "ab" * 30, "A" * 20 + "a" * 20, "0123456789abcdef" * 3, "thisisonelongwordofplainenglishtext", "x" * 21 + "==", "/usr/local/lib/python/site-packages"]
    got = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(made + odd)], "i long, x string").select("i", secrets.randomness(F.col("x")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([plain_p(x) for x in made + odd], rel=1e-6)
    assert sum(p < 0.05 for p in got[: len(made)]) <= 0.08 * len(made) and sum(p < 0.05 for p in got[len(made) :]) >= 6
