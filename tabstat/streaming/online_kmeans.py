"""Online k-means over a stream: every micro-batch moves running means of the centres."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabstat.operators.kmeans import assign


class OnlineKMeans:
    """Centres with the number of points seen by each. With ``state`` (a shared folder) they survive the driver.

    Every epoch's centres are a table of their own; a restart goes on from the last.
    """

    def __init__(self, centres: np.ndarray, columns: Sequence[str], state: str | None = None):
        self.centres, self.columns, self.state = np.array(centres, float), list(columns), state
        self.seen, self.epoch = np.zeros(len(self.centres)), -1

    def _folder(self, spark: SparkSession, name: str = ""):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}" if name else self.state)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def restore(self, spark: SparkSession) -> None:
        """Takes up the last whole epoch in the state folder, if there is one."""
        path, files = self._folder(spark)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        whole = [int(n[6:]) for n in names if n.startswith("epoch=") and files.exists(self._folder(spark, f"{n}/_SUCCESS")[0])]
        if whole and max(whole) > self.epoch:
            self.epoch = max(whole)
            for r in spark.read.schema("cluster int, seen double, centre array<double>").parquet(f"{self.state}/epoch={self.epoch}").collect():
                self.seen[r.cluster], self.centres[r.cluster] = r.seen, r.centre

    def update(self, batch: DataFrame, epoch: int) -> None:
        """Moves the centres by one micro-batch; an epoch that is replayed counts once."""
        spark = batch.sparkSession
        if self.state:
            self.restore(spark)
        if epoch <= self.epoch:
            return
        sums = assign(batch.dropna(subset=self.columns), self.columns, self.centres).groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in self.columns))
        for r in sums.collect():
            total = self.seen[r.cluster] + r.n
            self.centres[r.cluster] = (self.centres[r.cluster] * self.seen[r.cluster] + np.array([r[c] for c in self.columns])) / total
            self.seen[r.cluster] = total
        if self.state:
            rows = [(i, float(n), [float(x) for x in c]) for i, (n, c) in enumerate(zip(self.seen, self.centres, strict=True))]
            spark.createDataFrame(rows, "cluster int, seen double, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/epoch={epoch}")
            old, files = self._folder(spark, f"epoch={self.epoch - 1}")
            files.delete(old, True)
        self.epoch = epoch

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follows a stream; the centres are kept beside its checkpoint."""
        self.state = self.state or f"{checkpoint.rstrip('/')}-centres"
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
