"""Operators that keep state over streams: moments, weights of splits, and equivalence classes.

Moments and weights are streaming aggregations, whose state is Spark's own: in output mode update or complete they go on from a
checkpoint. Classes need more than a key's state, since one line may join any number of classes; they are a table that each
micro-batch brings up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import splits, statistics
from strandlake.plans.tables import components, remove, written


def stream_moments(values: DataFrame, x: str, *by: str) -> DataFrame:
    """The running count, mean, variance and so on of each group, as statistics.online() gives them."""
    return statistics.online(values, x, *by)


def stream_split_weights(register: DataFrame) -> DataFrame:
    """The running weights of splits (mask, weight)."""
    return splits.merge(register)


class ClassStream:
    """Equivalence classes of a stream of members (line, element), kept in a folder that driver and executors share.

    The state is a table (element, first_line, class) for each micro-batch. A batch meets the state at its own elements; what
    it joins is found among its lines and the classes that they touch, however large the state, which is then
    relabelled by a join. A batch that is run again after a failure begins at the table before it and overwrites its own; tables
    of batches long past are removed.
    """

    SCHEMA = "element string, first_line long, class long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        done = [x.getPath() for x in files.listStatus(at) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch-")) for p in done)

    def classes(self, before: int | None = None) -> DataFrame:
        """element, first_line, class after the last batch (before batch `before`)."""
        held = [v for v in self._versions() if before is None or v < before]
        if not held:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/batch-{held[-1]}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Brings the table up to date with a batch (line, element)."""
        state = self.classes(before=batch_id)
        new = written(batch.select(F.col("line").cast("long").alias("line"), "element").where("line is not null and element is not null").distinct(), "class-batch")
        firsts = new.groupBy("element").agg(F.min("line").alias("__first"))
        known = state.join(firsts.select("element"), "element", "left_semi").select("element", "class")
        ends = new.join(firsts, "element").select(F.col("line").alias("a"), F.col("__first").alias("b"))
        ends = ends.unionByName(new.join(known, "element").select(F.col("line").alias("a"), F.col("class").alias("b")))
        moved = components(ends).select(F.col("id").alias("class"), F.col("component").alias("__to"))
        both = state.join(firsts, "element", "full").select("element", F.least("first_line", "__first").alias("first_line"), F.coalesce("class", "__first").alias("class"))
        out = both.join(moved, "class", "left").select("element", "first_line", F.coalesce("__to", "class").alias("class"))
        out.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        remove(new)
        for v in self._versions()[:-3]:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{v}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, members: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The query that keeps the table up to date with a stream of members; trigger as writeStream.trigger takes it."""
        return members.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
