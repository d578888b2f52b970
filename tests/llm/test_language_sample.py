"""The sample that the language network learns from, and what the driver keeps of it."""

from pyspark.sql import functions as F

from stratalens.llm import byte_cnn


def test_sample_and_memory(spark, monkeypatch):
    rows = [(k % 90, f"text {k % 70} of words", "ab"[k % 2]) for k in range(300)] + [(1, None, "a"), (2, "12", "a"), (3, "words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen, freed = [], []
    monkeypatch.setattr(byte_cnn, "train", lambda texts, labels: seen.append((texts, labels)))
    monkeypatch.setattr(byte_cnn.T, "release", lambda: freed.append(len(seen)))
    byte_cnn.fit(docs, F.lit(True), sample=1000)
    kept = docs.where("text is not null and lang is not null and text <> '12'").select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("k"), "text", "lang")
    whole = sorted(map(tuple, kept.collect()))
    assert list(zip(*seen[0])) == [r[1:] for r in whole] and freed == [1]  # memory goes back after training
    byte_cnn.fit(docs.where("doc_id = 5"), F.lit(True), sample=2)
    assert len(seen[1][0]) == 2
    byte_cnn.fit(docs.limit(0), F.lit(True))
    assert seen[2] == ([], [])
