"""Tables written to the folder that driver and executors share, which cut lineage, and connected components built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder, but only if all executors are in this machine's JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("strandlake.own.shared", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="strandlake-")
            spark.conf.set("strandlake.own.shared", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def remove(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing lazy depends on it."""
    path = getattr(df, "_strandlake_path", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of new_path() once nothing lazy depends on it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _checksum(df: DataFrame) -> tuple:
    """Row count and an order-free checksum of a table."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """(id, component) for every id of edges (a, b), longs, between different ids: the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond"): all work
    stays distributed, a round shuffles at most the edges, and each round's edges are a written table. The many edges of one
    id meet its smallest neighbour in `salts` tasks. Edges from an id to itself or with a null end are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = _checksum(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        far = both.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        large = far.join(low, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.union(small_low.select("u", F.col("m").alias("v"))).distinct(), "components")
        state = _checksum(after)
        remove(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
