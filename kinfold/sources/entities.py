"""Entity tables: readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY = StructType([StructField(n, StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
NULLS = ("N/A", "n/a", "null", "NULL", "None")


def read_entities(spark: SparkSession, path: str, *, quote: str = "", nulls: tuple[str, ...] = NULLS, limit: int | None = None) -> DataFrame:
    """A tab-separated entity table: extra fields are cut, null tokens become null; ``quote`` is off unless given.

    ``limit`` reads that many rows only, for a look at a large file.
    """
    rows = spark.read.schema(ENTITY).csv(path, sep="\t", header=True, mode="PERMISSIVE", quote=quote)
    rows = rows if limit is None else rows.limit(limit)
    return rows.select([F.when(~F.col(c).isin(*nulls), F.col(c)).alias(c) for c in ENTITY.names])


def is_tab_separated(spark: SparkSession, path: str) -> bool:
    """False for a file whose header has commas and no tabs."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and ("\t" in first[0][0] or "," not in first[0][0])


def parse_links(lists: DataFrame, entity: str = "source1_entity_id", targets: str = "matched_entity_ids") -> DataFrame:
    """A row for each (entity_id, target_id) of comma-joined lists; blank lists have none."""
    items = F.filter(F.transform(F.split(F.coalesce(F.col(targets), F.lit("")), ","), F.trim), lambda x: x != "")
    return lists.select(F.col(entity).alias("entity_id"), F.explode(F.array_distinct(items)).alias("target_id"))


def lists(entities: DataFrame, links: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Each entity's sorted target ids, comma-joined; entities without links keep an empty list."""
    joined = links.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(name))
    return entities.select("entity_id").join(joined, "entity_id", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_lists(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def ids(rows: DataFrame) -> DataFrame:
    """The first column, trimmed, without nulls and blanks, each value once."""
    first = F.trim(F.col(rows.columns[0]))
    return rows.select(first.alias("entity_id")).filter(F.col("entity_id") != "").distinct()


def first_column(df: DataFrame, *names: str, other: Column | None = None) -> Column:
    """The first of the columns that the table has."""
    found = next((F.col(n) for n in names if n in df.columns), other)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} is a column")
    return found


def write_matches(rows: DataFrame, path: str) -> None:
    """One tab-separated file with a header, in the order of the entities; the ids of a row are sorted already."""
    rows.coalesce(1).sortWithinPartitions(rows.columns[0]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_probabilities(links: DataFrame, path: str) -> None:
    """Each entity's ids, comma-joined, and their scores in the same order, joined by |."""
    by = links.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "p"))).alias("x"))
    ids_, p = F.array_join(F.col("x.target_id"), ","), F.array_join(F.transform("x.p", lambda v: v.cast("string")), "|")
    by.select(F.col("entity_id").alias("source1_entity_id"), ids_.alias("matched_entity_ids"), p.alias("probs")).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """A row (entity_id, target_id, p) for each id of :func:`write_probabilities`; ids without a score have 0."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="source1_entity_id string, matched_entity_ids string, probs string")
    zipped = F.arrays_zip(F.split("matched_entity_ids", ",").alias("i"), F.split("probs", r"\|").alias("p"))
    pairs = rows.select(F.col("source1_entity_id").alias("entity_id"), F.explode(zipped).alias("x"))
    return pairs.select("entity_id", F.col("x.i").alias("target_id"), F.coalesce(F.col("x.p").try_cast("double"), F.lit(0.0)).alias("p")).filter(F.col("target_id") != "")


def write_shards(rows: DataFrame, path: str, shards: int, key: str = "entity_id") -> list[int]:
    """Parquet in a folder for each shard, with a marker when it is whole; shards that have one are passed over.

    Returns the shards written. Each is appended in one job; an interrupted one is written anew.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("shard", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = {k for k in range(shards) if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}/_SUCCESS"))}
    for k in set(range(shards)) - done:
        marked.filter(F.col("shard") == k).drop("shard").write.mode("overwrite").parquet(f"{path}/shard={k}")
    return sorted(set(range(shards)) - done)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards as one table."""
    return spark.read.parquet(path).drop("shard")


def write_report(report: DataFrame, path: str) -> None:
    """Rows of a report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def file_profile(spark: SparkSession, path: str, columns: int = 4, hash_bytes: int = 1 << 30) -> DataFrame:
    """Bytes, SHA-256, lines and malformed lines (not ``columns`` tab-separated fields) of each file.

    Lines are counted in a scan that splits large files. A digest needs its file whole in one task, so
    files of more than ``hash_bytes`` bytes have none.
    """
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", "length")
    sums = files.filter(F.col("length") <= hash_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), (F.size(F.split("value", "\t")) != columns).alias("bad"))
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("malformed"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    out = sizes.withColumn("path", plain(F.col("path"))).join(sums.withColumn("path", plain(F.col("path"))), "path", "left")
    return out.join(counts.withColumn("path", plain(F.col("path"))), "path", "left").fillna(0, ["lines", "malformed"])
