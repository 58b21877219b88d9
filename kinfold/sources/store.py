"""Intermediate tables: materialised in the folder that the cluster shares, broadcast only below a size in bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes of rows, as :func:`bytes_of` counts them, up to which a table is broadcast.
BROADCAST_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that the session names in ``spark.checkpoint.dir``.

    A local master may go without the setting and gets a temporary folder; on a cluster, where such a
    folder would be lost with its machine, its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    # What was shuffled to make it is needed no more; Spark deletes it once the driver's garbage is collected.
    # The executed plan of df refers to it, so that df must go first.
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: readers take the columns that they need. ``options`` are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(table: DataFrame) -> None:
    """Delete the files of a table that :func:`written` has made, which are not read any more."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to as many partitions as shuffles have, evenly, before work that costs far more than its bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _width(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, StringType | BinaryType | ArrayType):
            each = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _width(x, inner).cast("long"))
        else:
            each = F.size(c) * (16 + 8 * len(inner.fields) if isinstance(inner, StructType) else 8)
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """About the bytes of a table's rows, by its values' lengths, in one pass."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows have at most ``limit`` bytes, else as it is.

    ``df`` should be cheap to read: a materialised table or a small aggregate.
    """
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as no column of ``df`` has."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
