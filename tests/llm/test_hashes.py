"""Hashes of spans: no two unlike texts meet by construction."""

import numpy as np
import pytest

from stratalens.llm import line_dedup, minhash_dedup, quality
from stratalens.llm import textbatch as T


def complementary(n):
    """Two Thue-Morse words, on which every polynomial modulo a power of two meets once n is large."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


X, Y = complementary(1024)


@pytest.mark.parametrize("n", [8, 256, 1024, 4096, 1 << 17])
def test_span_hashes_of_complementary_words(n):
    x, y = (np.frombuffer(w.encode(), np.uint8) for w in complementary(n))
    h = [int(T.span_hashes(w, [0], [n])[0]) for w in (x, y)]
    assert h[0] != h[1]


def test_span_hashes_follow_bytes_alone():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 99, 5000).astype(np.uint8)
    start = draw.integers(0, 4000, 3000)
    end = start + draw.choice([0, 1, 2, 3, 7, 8, 9, 16, 255, 256, 257, 1000], 3000)
    h, other = T.span_hashes(data, start, end), T.span_hashes(data, start, end, 7)
    seen = {}
    for s, e, x, y in zip(start, end, h, other):
        assert seen.setdefault(data[s:e].tobytes(), (x, y)) == (x, y)
    assert len({v[0] for v in seen.values()}) == len(seen) and not {v[0] for v in seen.values()} & {v[1] for v in seen.values()}


def test_op1_unlike_words(spark):
    docs = spark.createDataFrame([(1, f"{X} k1 k2 k3"), (2, f"{Y} k1 k2 k3")], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, n=3, num=85, den=100).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] and r["n_shingles"] == 2 for r in got)


def test_op7_unlike_lines_and_words(spark):
    five = " ".join("pqrs")
    docs = spark.createDataFrame([(1, f"{X}\n{Y}"), (2, f"{X}\n{X}"), (3, f"{X} {five} {Y} {five}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(docs).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0)}


def test_op3_unlike_lines(spark):
    docs = spark.createDataFrame([(1, f"{X}\nfirst"), (2, f"{Y}\nsecond"), (3, X)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped_lines"] for r in line_dedup.dedup(docs).collect()}
    assert got[1] == 0 and got[3] == 1


def test_op3_lines_of_one_hash(spark, monkeypatch):
    """Unlike lines that share the first hash are kept apart by the second."""
    true = T.span_hashes

    def blind(data, start, end, seed=0):
        h = true(data, start, end, seed)
        return h if seed else np.where(np.isin(data[np.asarray(start)], np.frombuffer(b"uv", np.uint8)), np.uint64(5), h)

    # the functions that workers run are pickled by reference, so the partition function is called here
    monkeypatch.setattr(T, "span_hashes", blind)
    import pyarrow as pa

    texts = pa.array(["u one line of text\nv another line of text\nsame"])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), texts], names=["doc_id", "th", "text"])
    (out,) = line_dedup._occurrences(iter([batch]))
    assert out["line"].to_pylist()[:2] == [5, 5] and len(set(out["check"].to_pylist())) == 3
