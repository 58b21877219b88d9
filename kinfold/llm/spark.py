"""Session helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import cut, fresh, small, unwritten, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, gone: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` less the rows whose ``columns`` equal those of that name in ``gone``, nulls included.

    ``gone`` is materialised, and broadcast if it is small; the columns of ``docs`` may have any names.
    """
    names = dict(zip(columns, fresh(docs, *columns), strict=True))
    keys = cut(gone.select([F.col(c).alias(n) for c, n in names.items()]).distinct())
    same = [value.eqNullSafe(F.col(names[c])) for c, value in columns.items()]
    return docs.join(small(keys), same, "left_anti")
