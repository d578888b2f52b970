"""Tables written between steps, in the folder that all machines share.

A written table cuts lineage and outlives the executors that made it."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="stratalens-")


class Store:
    """A folder of Parquet tables below spark.checkpoint.dir, which is emptied by whoever set it.

    Where that is unset, a temporary folder, but only if everything runs on this machine; a cluster needs the setting."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            base = _local()
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        # Spark removes the shuffle files of a finished plan when the driver collects its garbage, which may be long after
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a repartition whose keys are even: the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


BITS, PARTS = 1 << 24, 2


def bits(keys: DataFrame, column: str) -> bytes:
    """PARTS sets of BITS bits (4 MB, whatever the number of keys) that hold the lowest 24 bits of each long key, and the next 24.

    They only spare rows a shuffle before an exact join: a key that isn't there may still be found set."""
    position = F.explode(F.array(*(F.pmod(F.shiftright(column, 24 * k), F.lit(BITS)) + k * BITS for k in range(PARTS))))
    per = 8 * 4096
    places = keys.select(position.alias("position"))
    parts = places.select((F.col("position") / per).cast("int").alias("part"), (F.col("position") % per).cast("long").alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    out = bytearray(PARTS * BITS // 8)
    for row in parts.collect():  # at most PARTS * BITS / 32,768 rows of 4 KB
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = row["map"]
    return bytes(out)


def holds(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set; held has the bytes of bits(), or of its first set."""
    there = np.ones(len(keys), dtype=bool)
    for k in range(8 * len(held) // BITS):
        at = np.mod(keys >> (24 * k), BITS)
        there &= (held[k * BITS // 8 + (at >> 3)] >> (at & 7)) & 1 == 1
    return there
