"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import byte_bpe, byte_cnn, embedding_dedup, fill_middle, hidden_markov, licences, line_dedup, minhash_dedup, quality, secrets, source_mix, url_filter
from stratalens.llm.queries import RULES, tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, bands int, id int, kept string, u int, family int, line string, notices int, host string, score string, vec_id int, label int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, " \n\t"), (1, "a b c d e f g h"), (5, "A B c d e f g h"), (None, "x y z u v w"), (None, "x y z u v w"), (6, LONG), (7, LONG + " end"), (8, "é中 <|endoftext|>\n\n"), (9, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if d is None or d == 9 else "en", None if d is None else "s", None, *["x", 1, 1, "x", 1, 1, "x", 1, "x", "x", 1, 1]) for d, t in TEXTS]
    return spark.createDataFrame(rows, KIND)


RUNS = {
    "near": lambda d: minhash_dedup.near_duplicates(d),
    "lines": lambda d: line_dedup.dedup(d),
    "mix": lambda d: source_mix.mix(d),
    "secrets": lambda d: secrets.scan(d),
    "quality": lambda d: quality.judge(d),
    "licences": lambda d: licences.scan(d),
    "language": lambda d: byte_cnn.predict(d, byte_cnn.fit(d, F.lit(True))),
    "bpe": lambda d: byte_bpe.encode(d, tokenizer_path(), digests=True),
    "bpe_stage": lambda d: corpus_pipeline.encode(d.sparkSession, d, ""),
    "markov": lambda d: hidden_markov.score(d, F.lit(False), rounds=1),
    "middle": lambda d: fill_middle.transform(d),
    "url": lambda d: url_filter.judge(d.withColumn("url", F.col("text")), RULES, page_id="doc_id"),
}


@pytest.mark.parametrize("name", RUNS)
def test_rows_stay_whole(docs, name):
    assert RUNS[name](docs).count() == len(TEXTS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, name):
    assert RUNS[name](docs.limit(0)).collect() == []


def test_near_values(docs):
    rows = minhash_dedup.near_duplicates(docs, 3, 85, 100).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[5]["component_id"] == 1 and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["kept"] and by[4]["n_shingles"] == 0 and by[9]["n_shingles"] == 1
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True, True]


def test_line_values(docs):
    by = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert by[2] is None and by[3] == "" and by[5] == "" and by[4] == " \n\t" and by[1] == "a b c d e f g h" and by[7] == ""


def test_quality_values(docs):
    by = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[9]["kept"] and by[6]["n_words"] == 60_000


def test_language_values(docs):
    by = {r["doc_id"]: r for r in byte_cnn.predict(docs, byte_cnn.fit(docs, F.lit(True))).collect()}
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 4, 6)] == ["en", "und", "und", "und", "en"] and by[2]["score"] == 0
    assert byte_cnn.fit(docs, F.lit(False)) is None
    assert {r["lang_pred"] for r in byte_cnn.predict(docs, None).collect()} == {"und"}


def test_mix_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["copies"]) for r in source_mix.mix(rows).collect()] == [(0, 0.0, [])] * 2


def test_markov_values(docs):
    by = {r["doc_id"]: r for r in hidden_markov.score(docs, F.col("doc_id") == 9, rounds=1).collect()}
    assert [by[k]["n_tokens"] for k in (2, 3, 4, 9)] == [1, 1, 1, 2] and by[6]["n_tokens"] == 60_001 and by[9]["held_out"] and not by[None]["held_out"]
    assert by[1]["score"] == by[5]["score"] and by[9]["n_known"] == 1


def test_rules_of_equal_length(spark):
    rules = [("b.com/", "block"), ("com/en", "allow"), ("com/e/", "block")]
    rows = spark.createDataFrame([(1, "http://b.com/en/1"), (2, "http://a.com/en"), (3, "http://b.com/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(rows, rules).collect()}
    assert got == {1: ("com/en", "allow"), 2: ("com/en", "allow"), 3: ("b.com/", "block")}


def test_very_long_vectors(spark):
    long = [float(i % 7 - 3) for i in range(50_000)]
    rows = spark.createDataFrame([(1, long, 1), (2, [2 * v for v in long], 1), (3, long[::-1], 1)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(rows).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (0, 3)


def test_vectors(spark):
    x, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [(1, x, 1), (2, [2.0, 0.0, 0.0], 1), (3, x, 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, nan, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, x, None), (1, x, 1), (None, x, 1), (9, [1.0, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[None] == (3, 1, False)
    assert all(by[k] == (0, k, True) for k in range(3, 10))
    far = [(1, [1e200, 0.0], 1, 5), (2, [1e200, 0.0], 1, 5), (3, [1e-200, 0.0], 1, 5), (4, [3e-320, 3e-322], 1, 5), (5, [1e308, 1e308], 1, 5)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int, id int").withColumn("copies", F.lit("x"))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
