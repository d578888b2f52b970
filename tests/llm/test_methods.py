"""The methods themselves: planted licences, planted rule accuracies, quotas of shards, held-out URLs, many matches, rows of the pipeline."""

import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from stratalens.llm import byte_cnn, licences, minhash_dedup, quality, secrets, source_mix, url_filter
from stratalens.llm.store import Store


def test_op8_planted_licences(spark):
    texts = dict(reversed(licences._texts()))
    unlike = []
    for i, t in texts.items():
        words = t.split()
        wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        unlike += [(i, t), (i, "Copyright (c) 2021 Some One\n\n" + t), (i, t.upper().replace('"', "“")), (i, t.replace("license", "licence").replace("\n", "\r\n# "))]
        if i in ("MIT", "ISC", "BSD-3-Clause", "Zlib", "Unlicense"):
            unlike.append((i, wrapped))
        unlike += [(None, t + " and one more term"), (None, " ".join(t.split()[:-1]))]
    rows = [(k, t) for k, (_, t) in enumerate(unlike)]
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == [i for i, _ in unlike]


def test_op7_estimate_finds_planted_accuracies():
    draw = np.random.default_rng(7)
    n, m = 60_000, len(quality.RULES)
    good = draw.random(n) < 0.8
    bad_if_good, bad_if_bad = np.linspace(0.02, 0.1, m), np.linspace(0.5, 0.8, m)
    bad = draw.random((n, m)) < np.where(good[:, None], bad_if_good, bad_if_bad)
    votes = np.where(draw.random((n, m)) < 0.3, 0, np.where(bad, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    start, lean = quality.estimate(patterns, counts.astype(float))
    assert abs(1 / (1 + np.exp(-start)) - 0.8) < 0.01
    assert np.abs(lean[:, 0] - np.log(bad_if_good / bad_if_bad)).max() < 0.25
    assert np.abs(lean[:, 2] - np.log((1 - bad_if_good) / (1 - bad_if_bad))).max() < 0.15 and (lean[:, 1] == 0).all()
    odds = start + sum(np.where(votes[:, k] < 0, lean[k, 0], np.where(votes[:, k] > 0, lean[k, 2], 0)) for k in range(m))
    assert ((odds > 0) == good).mean() > 0.97


def test_op7_posterior_of_votes(spark):
    """Kept is the sum of the weights that the votes of a row have."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice(string.ascii_lowercase) for _ in range(draw.randint(3, 8)))
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(150)]
    rows += [(200 + k, " ".join("#|" if draw.random() < 0.5 else "!!" for _ in range(60)) + " " + word()) for k in range(30)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 200) for r in judged)
    names = [f"vote_{r}" for r in quality.RULES]
    patterns = Counter(tuple(r[n] for n in names) for r in judged)
    start, lean = quality.estimate(np.array(sorted(patterns)), np.array([patterns[p] for p in sorted(patterns)], float))
    for r in judged:
        odds = start + sum(lean[k, r[n] + 1] for k, n in enumerate(names))
        assert abs(r["quality"] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_op4_tree_and_shards(spark):
    quota = {0: 700, 1: 90, 2: 0, 3: 1}
    rows = spark.createDataFrame(list(quota.items()), "ordinal int, n long").where("n > 0")
    got = [source_mix.shard_quotas(rows, Store(spark, "test"), 3).collect() for _ in range(2)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    per = Counter()
    for r in got[0]:
        per[("source", r["ordinal"])] += r["n"]
        per[("shard", r["shard"])] += r["n"]
    assert {k: n for (kind, k), n in per.items() if kind == "source"} == {k: n for k, n in quota.items() if n}
    sizes = [per[("shard", k)] for k in range(8)]
    assert sum(sizes) == 791 and max(sizes) - min(sizes) <= 1
    # a hypergeometric share of the large source in each shard of about 99 tickets
    large = [r["n"] for r in got[0] if r["ordinal"] == 0]
    assert all(75 <= n <= 99 for n in large) and len(set(large)) > 1


def test_op4_clashing_columns_and_disjoint_places(spark):
    rows = [(k, f"word{k} " * (k % 7 + 1), "ab"[k % 2], "t", 1.0, None, "x", 5) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, partial double, cut int, _block string, copy int")
    got = source_mix.mix(docs).collect()
    assert Counter(tuple(r[:8]) for r in got) == Counter(rows)
    copies = [(c["shard"], c["place"]) for r in got for c in r["copies"]]
    assert len(set(copies)) == len(copies) > 500
    dealt = source_mix.shards(source_mix.mix(docs))
    assert dealt.columns == docs.columns and Counter(map(tuple, dealt.collect())) == Counter({tuple(r[:8]): len(r["copies"]) for r in got if r["copies"]})


def test_op5_held_out(spark):
    """Sites that are blocked as a whole and paths with many digits, told on URLs that the trees haven't seen."""
    draw = random.Random(5)
    rows = []
    for k in range(1500):
        site, digits = draw.randrange(30), draw.random() < 0.4
        path = "".join(draw.choice(string.digits if digits else string.ascii_lowercase) for _ in range(12))
        rows.append((k, f"https://s{site}.example{site % 3}.net/{path}", site < 6 or digits))
    labelled = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    assert url_filter.held_out_auc(labelled.limit(0), [], labelled=labelled) > 0.95
    # labels drawn by chance: suffix statistics hold nothing of a URL's own label
    noise = labelled.withColumn("blocked", labelled.page_id * 7919 % 101 < 50)
    assert url_filter.held_out_auc(noise.limit(0), [], labelled=noise) < 0.62


def test_op5_odd_urls(spark):
    urls = [None, "", "://", "http://", "no scheme", "HTTP://EXAMPLE.com/en/7?x#y", "http://a.net/de/", "http://" + "x" * 50_000, "http://[::1]:80/é?ü=1&&", "http://example.com/en/7", "http://example.com/en/7"]
    rows = spark.createDataFrame([(k, u, "h", 1.0, 2) for k, u in enumerate(urls)], "page_id long, url string, host string, top double, site int")
    got = {r["page_id"]: r for r in url_filter.judge(rows, [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow")]).collect()}
    assert len(got) == len(urls) and [got[k]["host"] for k in (0, 1, 2, 4, 5)] == ["", "", "", "", "example.com"]
    assert [got[k]["verdict"] for k in (5, 6, 9, 10)] == ["allow"] * 4 and all(r["verdict"] in ("allow", "block") for r in got.values())


def test_op6_many_matches(spark):
    text = " ".join(f"token=abcdefgh{k:06d}" for k in range(30_000))
    began = time.time()
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert [tuple(s) for s in row["base"]] == want and time.time() - began < 60


def test_op6_precision_and_recall(spark):
    """Keys planted into prose with long words, paths and identifiers."""
    draw = random.Random(66)
    words = [w for w in "the quick brown fox jumps over lazy dogs while seven wizards quietly mix boxes of liquid".split()]
    alphabet = string.ascii_letters + string.digits
    prose = lambda: " ".join(draw.choice(words) for _ in range(30))
    odd = lambda: draw.choice(["_".join(draw.choice(words) for _ in range(5)), "/".join(["usr", "local", "share"] + [draw.choice(words) for _ in range(3)]), "".join(draw.choice(words).title() for _ in range(6)), "=" * 30, "ab" * 15, "2020-01-01-" * 3 + "0"])
    rows, secret = [], {}
    for k in range(600):
        middle = "".join(draw.choice(alphabet) for _ in range(draw.choice([24, 32, 40, 64]))) if k % 3 == 0 else odd()
        secret[k] = k % 3 == 0
        rows.append((k, f"{prose()} {middle} {prose()}"))
    found = {r["doc_id"]: len(r["random"]) > 0 for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(found[k] and secret[k] for k in found)
    assert hits / sum(secret.values()) >= 0.9 and hits / max(sum(found.values()), 1) >= 0.9


KIND = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int, rest string, copy int, n_dropped_lines string, decided int, stays int, word string"
CLEAN = "one clear sentence about rivers and stones that nobody else in this corpus has written down before"
OTHER = "a wholly unrelated text on music theory with chords scales and rhythms for patient students of harmony"


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "bpe"], ids=lambda s: s[0])
def test_pipeline_rows(spark, stage):
    """Nulls, repeated ids and rows, empty texts, an empty table and clashing columns, in each stage that keeps columns."""
    extra = ("p", 3, "r", 4, "d", 5, 6, "w")
    texts = [(1, CLEAN), (2, CLEAN), (2, OTHER), (None, None), (None, "text without an id"), (3, ""), (4, None), (5, OTHER + "\nmore"), (5, OTHER + "\nmore"), (6, "12 34")]
    docs = spark.createDataFrame([(d, t, "en" if t else None, None if d == 3 else "s", len(t or "")) + extra for d, t in texts], KIND)
    name, run = stage
    assert run(spark, docs.limit(0), "").collect() == []
    got = run(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(tuple(r)[5:] == extra for r in rows)
    have = Counter((r["doc_id"], r["text"]) for r in rows)
    if name == "near_dedup":
        want = Counter(texts)
        want[(2, CLEAN)] = 0
        want[(5, OTHER + "\nmore")] = 0
        assert have == +want
    elif name == "language_id":
        assert have == Counter((d, t) for d, t in texts if t and re.search("[a-z]", t))
    elif name == "line_dedup":
        assert have[(1, CLEAN)] == 1 and (2, CLEAN) not in have and have[(None, None)] == 1 and have[(3, "")] == 1 and have[(5, "more")] == 2
    else:
        assert set(have) <= set(texts) and max(have.values()) <= 4


def test_unique_of_repeated_ids(spark):
    """An unrelated text that shares its id with a copy of another document stays."""
    rows = [(1, CLEAN), (2, CLEAN + " end"), (2, OTHER), (3, OTHER), (4, CLEAN), (4, CLEAN)]
    got = minhash_dedup.unique(spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10).collect()
    assert sorted(map(tuple, got)) == [(1, CLEAN), (2, OTHER)]


def test_op9_learns_from_whole_texts():
    """The sign of the language stands at the texts' ends only."""
    draw = random.Random(9)
    noise = lambda n: "".join(draw.choice("xyz ") for _ in range(n))
    texts = [noise(3000) + ("aeiou " if k % 2 else "bcdfg ") * 150 for k in range(60)]
    model = byte_cnn.train(texts, ["v" if k % 2 else "c" for k in range(60)])
    windows, _, _ = byte_cnn.cut(*byte_cnn.T.utf8(byte_cnn.pa.array(["aeiou " * 40, "bcdfg " * 40])))
    assert [model.languages[k] for k in model.log_probabilities(windows).argmax(axis=1)] == ["v", "c"]
