"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_cnn, embedding_dedup, fill_middle, hidden_markov, licences, line_dedup, minhash_dedup, quality, secrets, source_mix, turns, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), n=3, num=85, den=100)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE links AS (
    SELECT a.vec_id AS u, b.vec_id AS v
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reach AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings
    UNION
    SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT low.u AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, low.u = component_id AS kept
FROM low LEFT JOIN n ON n.u = low.u"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", F.col("n_dropped_lines").cast("long").alias("n_dropped_lines"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.sizes(_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["shard"], c["place"])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), shards.alias("copies"))


#: The rules of the URL filter.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = byte_cnn.fit(docs, ~held_out)
    return byte_cnn.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS units FROM d),
c AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(h1, h2)], '') AS prefix, array_to_string(units[least(h1, h2) + 1:greatest(h1, h2)], '') AS middle, array_to_string(units[greatest(h1, h2) + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM f"""


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "turn", "role", "text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    said = said.withColumn("h", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))
    once = F.struct((F.col("h") % 12).alias("batch"), "role")
    again = F.struct(((F.col("h") + 5) % 12).alias("batch"), F.lit("user").alias("role"))
    arrivals = said.withColumn("a", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once)))).select("conv_id", "turn", "a.role", "text", "a.batch")
    found = turns.reassemble(arrivals, batches=12, idle=2)
    payload = F.when(F.col("event") == "close", F.array_join("pending", ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return found.select("event", F.sha2(payload, 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_url_filter": op5_url_filter,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_licences": op8_licences,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_fill_middle": op12_fill_middle,
    "op13_turns": op13_turns,
}
ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op8_licences": licences.oracle(), "op12_fill_middle": OP12_SQL}
