"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Sources, by code point with null last, weigh WEIGHTS in turn and share
SHARE times all sizes; a target stops at CAP times its source's size and the excess is
shared again by weight (solved in closed form: sources ordered by cap over weight).

Each source's documents fall by hash into BLOCKS blocks. A source is passed over
floor(target / size) times; a last, partial pass takes its permuted blocks until the
target, and cuts the block at which it is reached by the hash order of its documents. The blocks
taken are a source's quota. A splitting tree halves the quotas down to the output
shards: the left child gets a uniformly drawn half of its parent's blocks, so the shares of
the sources are a multivariate hypergeometric draw, and add up exactly. Each shard gets disjoint runs of each source's permuted blocks and is shuffled locally by a hash.

All draws are hashes of the seed, so reruns agree. A null text, or one without words, has
size 0; a null source is a source. Rows that are equal in all of id, source and text are
taken alike. An empty table has an empty mix. Columns named size, source_size, target
and copies are replaced; others are kept, whatever their names. Windows run over the blocks of one source, a
fixed number, over one of PARTS hashed parts of the cut block's documents, and in the tree over one of PARTS
hashed parts of a node's tickets, of which there are at most 2 * BLOCKS for each source, however many documents there are.
The table of blocks (a row for each source and block) is counted, and broadcast up to
BROADCAST_ROWS rows; beyond, it is joined by shuffle, with equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store, tasks

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BLOCKS, LEVELS, SEED, PARTS = 1024, 6, 17, 4096
BROADCAST_ROWS, RUNS = 200_000, 16


def n_words(text: str) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D] in the whole text; a null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """The rows' columns as one, row, so that none clashes, and their size, hash, source and block."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    h = F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(source), F.col(text))
    # a null source is a key of its own: no other key is empty
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return docs.select(F.struct(*kept).alias("row"), n_words(text).alias("size"), h.alias("_h"), src.alias("_src"), F.pmod(h, F.lit(BLOCKS)).cast("int").alias("_block"))


def targets(blocks: DataFrame) -> DataFrame:
    """(_src, source_size, target, ordinal) from sizes by source and block."""
    per = blocks.groupBy("_src").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("_src") == "", "_src")
    per = per.withColumn("ordinal", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.col("ordinal") % len(WEIGHTS) + 1))
    per = per.withColumn("cap", CAP * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    per = per.withColumn("level", level)
    # sources before the first whose cap is above the level are at their caps
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "ordinal"))).over(everything)
    return per.select("_src", "ordinal", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _part(h: Column) -> Column:
    """One of PARTS ranges of a hash, in order."""
    return F.shiftright(h, 64 - (PARTS - 1).bit_length()).cast("int")


def shard_quotas(quota: DataFrame, store: Store, levels: int = LEVELS) -> DataFrame:
    """(ordinal, shard, n): the splitting tree over (ordinal, n), n blocks of each source.

    A node holds a ticket for each block of its quotas. Its left child gets half of them, those of the
    smallest hashes: a uniform choice, so each source's share is multivariate hypergeometric. A ticket's turn in its
    node is its turn in a hashed part of the node, after the tickets of the parts before."""
    tree = quota.select("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("ticket")).withColumn("node", F.lit(0))
    for level in range(levels):
        h = F.xxhash64(F.lit(SEED), F.lit(level), "node", "ordinal", "ticket")
        tree = store.save(tree.withColumn("h", h).withColumn("part", _part(F.col("h"))), f"tree{level}")
        node = Window.partitionBy("node")
        parts = tree.groupBy("node", "part").agg(F.count("*").alias("n"))
        half = F.floor((F.sum("n").over(node) + F.col("node") % 2) / 2)
        before = F.sum("n").over(node.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        parts = parts.select("node", "part", (half - before).alias("left"))
        turn = F.row_number().over(Window.partitionBy("node", "part").orderBy("h", "ordinal", "ticket"))
        tree = tree.join(parts, ["node", "part"]).select("ordinal", "ticket", (2 * F.col("node") + F.when(turn > F.col("left"), 1).otherwise(0)).alias("node"))
    return store.save(tree.groupBy("ordinal", F.col("node").alias("shard")).agg(F.count("*").alias("n")), "quotas")


def plan(rows: DataFrame, store: Store, levels: int = LEVELS) -> DataFrame:
    """(_src, _block, source_size, target, taken, partial, cut): for each block, the (pass, shard) pairs
    it is taken in; of the pass `partial`, only documents whose hash is at most `cut`."""
    blocks = store.save(rows.groupBy("_src", "_block").agg(F.sum("size").alias("words")), "blocks")
    sources = store.save(targets(blocks).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
    each = blocks.join(sources, "_src").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    each = each.withColumn("order", F.xxhash64(F.lit(SEED + 1), "_src", "_block", "pass"))
    run = Window.partitionBy("_src", "pass").orderBy("order", "_block").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("upto", F.sum("words").over(run))
    last = F.col("pass") == F.col("passes")
    each = each.where(~last | ((F.col("rest") > 0) & (F.col("upto") - F.col("words") < F.col("rest"))))
    each = each.withColumn("open", F.when(last & (F.col("upto") > F.col("rest")), F.col("rest") - (F.col("upto") - F.col("words"))))
    each = each.withColumn("index", F.row_number().over(Window.partitionBy("_src").orderBy("pass", "order", "_block")).cast("long"))
    each = store.save(each, "each")

    quotas = shard_quotas(each.groupBy("ordinal").agg(F.count("*").alias("n")), store, levels)
    upto = F.sum("n").over(Window.partitionBy("ordinal").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = quotas.withColumn("upto", upto).select("ordinal", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("index"))
    each = each.join(runs, ["ordinal", "index"])

    reached = each.where("open is not null").select("_src", "_block", "open")
    inside = store.save(rows.join(F.broadcast(reached) if sources.count() <= BROADCAST_ROWS else reached, ["_src", "_block"]).withColumn("part", _part(F.col("_h"))), "inside")
    parts = inside.groupBy("_src", "_block", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.sum("words").over(Window.partitionBy("_src", "_block").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("_src", "_block", "part").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0))
    inside = inside.join(parts.drop("words"), ["_src", "_block", "part"]).withColumn("upto", upto)
    cut = inside.where(F.col("upto") - F.col("size") / 2 <= F.col("open")).groupBy("_src", "_block").agg(F.max("_h").alias("cut"))
    taken = each.groupBy("_src", "_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("taken"), F.max(F.when(F.col("open").isNotNull(), F.col("pass"))).alias("partial"))
    whole = blocks.select("_src", "_block").join(sources.select("_src", "source_size", "target"), "_src")
    return store.save(whole.join(taken, ["_src", "_block"], "left").join(cut, ["_src", "_block"], "left"), "plan")


def _decided(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    # a row for each source and block: broadcast only when counted and few
    side = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    out = rows.join(side, ["_src", "_block"])
    mine = F.filter(F.coalesce("taken", F.array().cast("array<struct<pass:int,shard:int>>")), lambda t: F.col("partial").isNull() | (t["pass"] != F.col("partial")) | F.coalesce(F.col("_h") <= F.col("cut"), F.lit(False)))
    return out.withColumn("copies", F.transform(mine, lambda t: F.struct(t["shard"].alias("shard"), F.xxhash64(F.lit(SEED + 2), "_h", t["pass"], t["shard"]).alias("place"))))


def mix(docs: DataFrame, levels: int = LEVELS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows with size, source_size, target and copies: the (shard, place) pairs at which the mix
    takes the row, none to two. Ordered by place, a shard is shuffled."""
    store = Store(docs.sparkSession, "mix")
    keyed = _keyed(docs, doc_id, text, source)
    narrow = store.save(keyed.select("_src", "_block", "_h", "size"), "rows")
    return _decided(keyed, plan(narrow, store, levels)).select("row.*", "size", "source_size", "target", "copies")


def sizes(docs: DataFrame, levels: int = LEVELS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """As mix(), without other columns than the id; reads the texts once."""
    store = Store(docs.sparkSession, "mix")
    keyed = _keyed(docs.select(doc_id, text, source), doc_id, text, source)
    narrow = store.save(keyed.select(F.col(f"row.{doc_id}").alias("doc_id"), "_src", "_block", "_h", "size"), "rows")
    return _decided(narrow, plan(narrow, store, levels)).select("doc_id", "size", "source_size", "target", "copies")


def shards(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), one for each copy, dealt out by shard and shuffled within: a shard lies in RUNS runs of its order, or in
    more where the session has many partitions, each in one partition. The columns that mix() adds go."""
    rows = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    each = mixed.select(F.struct(*rows).alias("row"), F.explode("copies").alias("copy"))
    runs = max(RUNS, 8 * tasks(mixed.sparkSession) >> LEVELS)
    run = F.shiftright("copy.place", 64 - (runs - 1).bit_length())
    return each.repartition(tasks(mixed.sparkSession), "copy.shard", run).sortWithinPartitions("copy.shard", "copy.place").select("row.*")
