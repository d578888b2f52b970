"""Centroids that follow a stream, with their state in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.learners import MiniBatch

STATE = "cluster int, centre array<double>, count double"


class FollowedCentroids:
    """Weighted mini-batch k-means over a stream (id, features, and weight if there); use update as a foreachBatch function.

    After each batch the centroids and their counts are written, under the batch's number, beside those before: a folder that
    is moved in place whole. A batch that comes again, because the query or its driver stopped before it was committed,
    finds its number and counts once. A batch is reduced to sums by cluster; nothing of the stream's size is held."""

    def __init__(self, spark: SparkSession, folder: str, start: np.ndarray, keep: int = 3):
        self.spark, self.folder, self.start, self.keep = spark, folder.rstrip("/"), np.array(start, float), keep

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def batches(self) -> list[int]:
        """Numbers of the states there are, in order."""
        path, files = self._files()
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch="))

    def state(self) -> tuple[int, MiniBatch]:
        """The number of the last batch counted (-1: none) and the centroids after it."""
        done = self.batches()
        if not done:
            return -1, MiniBatch(self.start)
        rows = sorted(self.spark.read.schema(STATE).parquet(f"{self.folder}/batch={done[-1]}").collect(), key=lambda r: r["cluster"])  # the centroids
        return done[-1], MiniBatch(np.array([r["centre"] for r in rows]), np.array([r["count"] for r in rows]))

    def update(self, batch: DataFrame, number: int) -> None:
        last, model = self.state()
        if number <= last:
            return
        model.update(batch, F.col("weight") if "weight" in batch.columns else None)
        rows = [(k, c.tolist(), float(n)) for k, (c, n) in enumerate(zip(model.centres, model.counts))]
        path, files = self._files()
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        temporary = f"{self.folder}/_new-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(temporary)
        if not files.rename(new(temporary), new(f"{self.folder}/batch={number}")):
            raise OSError(f"the state of batch {number} can't be written")
        for old in self.batches()[: -self.keep]:
            files.delete(new(f"{self.folder}/batch={old}"), True)


def follow(stream: DataFrame, followed: FollowedCentroids, checkpoint: str) -> StreamingQuery:
    """The query that feeds a stream's batches to centroids, each counted once."""
    return stream.writeStream.foreachBatch(followed.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
