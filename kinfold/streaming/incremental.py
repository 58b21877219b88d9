"""Linking as queries arrive: stream-static blocking, decisions batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, decide, features
from ..sources.store import cut, written


def linked(spark: SparkSession, folder: str) -> DataFrame | None:
    """Links of all batches so far, or None."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(path) and any(x.getPath().getName().startswith("batch=") for x in files.listStatus(path))
    return spark.read.parquet(folder).select("entity_id", "target_id", "p", F.col("batch").cast("long").alias("batch")) if there else None


def link_stream(stream: DataFrame, targets: DataFrame, folder: str, checkpoint: str, *, k: int | None = 40, theta: float = 0.6) -> StreamingQuery:
    """Links of newly arrived entities, in ``folder`` by batch; a target that was linked before stays linked to its first query.

    Targets are normalised once. A batch overwrites its own part of the folder and looks only at those of
    smaller numbers, so that one which is run again after a failure leaves the same links.
    """
    known = written(blocking.normalize(targets))

    def step(batch: DataFrame, number: int) -> None:
        queries = cut(blocking.normalize(batch))
        pairs = blocking.candidates(queries, known, k=k)
        scored = features.attach(pairs, queries, known).select("entity_id", "target_id", features.simple_score().alias("p"))
        links = decide.flat(scored, theta)
        before = linked(batch.sparkSession, folder)
        if before is not None:
            taken = before.filter(F.col("batch") < number)
            links = links.join(taken.select("target_id").distinct(), "target_id", "left_anti")
        decide.exclusive_global(links).select("entity_id", "target_id", "p").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
