"""Mixing sources to target weights by systematic sampling, on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .spark import cut, small

#: Rows of one size in one source are dealt to parts of about so many, so that no task ranks them all.
PART_ROWS = 100_000


def size(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Words to take of each source: ``sizes`` (source, source_size) with a column ``target``.

    Sources are weighted in code point order, null last, ``weights`` repeating. The targets add up
    to ``share`` of all words; each stops at ``most`` times its source's size, and the excess goes
    to the others by weight. Since weight * level is the target of all that are not stopped, the
    level follows from sums over the sources in the order in which they stop. There is a row for
    each source, so this is the small side; if all would stop, all do.
    """
    everything = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1)
    stops = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    rest = stops.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    weighted = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return weighted.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same in each run with ``seed``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def dealt(doc_id: Column, text: Column) -> Column:
    """A number that a row's id and text determine, by which it is dealt to a part."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    Within a source each document is expected ``target / source_size`` times. The documents are
    laid out by size, doc_id breaking ties, the expected copies are summed up along that order from
    the source's random offset, and a document is taken once for each integer that its step
    crosses. As neighbours have like sizes, the words taken stay near the target, and no document
    is taken more than ``ceil(most)`` times.

    The order's prefix sums come in two levels: counts of (source, size, part) are summed by
    source, and rows are ranked inside such a part only. A size that more rows of a source have than
    ``PART_ROWS`` has several parts, dealt by id and text, so a hot source or size is spread out.
    Null texts have size 0; a null source is a source; a null doc_id is ranked first; repeated rows
    are ranked one after the other, so the mix as a whole is the same in each run. An empty table
    gives an empty result. Other columns are dropped. Documents of size 0 are ranked as others but
    take 0 words.
    """

    def same(left: str, right: str, *names: str) -> Column:
        return F.expr(" AND ".join(f"{left}.{n} <=> {right}.{n}" for n in names))

    rows = cut(docs.select("doc_id", "source", size(F.col("text")).alias("size"), dealt(F.col("doc_id"), F.col("text")).alias("deal")))
    # Groups of more rows than a part holds; there are few of them, whatever the input.
    many = rows.groupBy("source", "size").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("n")).filter("n > 1")
    rows = rows.alias("r").join(small(cut(many)).alias("m"), same("r", "m", "source", "size"), "left")
    rows = rows.select("r.doc_id", "r.source", "r.size", F.pmod("deal", F.coalesce("n", F.lit(1))).alias("part"))
    parts = cut(rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    # Sums over sizes first: a source has far fewer sizes than documents.
    by_size = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("smaller"))
    inside = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "size", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("lower"))

    marks = (
        parts.alias("p")
        .join(by_size.alias("s"), same("p", "s", "source", "size"))
        .join(sources.alias("t"), same("p", "t", "source"))
        .select("p.source", "p.size", "p.part", (F.col("smaller") + F.col("lower")).alias("ahead"), "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.col("doc_id").asc_nulls_first()))
    ranked = rows.withColumn("rank", rank)
    joined = ranked.alias("d").join(marks.alias("m"), same("d", "m", "source", "size", "part"))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("ahead") + F.col("rank")
    copies = (F.floor(F.col("u") + at * F.col("step")) - F.floor(F.col("u") + (at - 1) * F.col("step"))).cast("long")
    return (
        joined.select("d.doc_id", "d.source", "d.size", "source_size", "target", "ahead", "rank")
        .withColumn("step", step)
        .withColumn("u", offset(F.col("source"), seed))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


#: The rows of op3 in DuckDB: the same order and offsets, with ranks taken in one pass.
SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS deal FROM documents
), parted AS (
  SELECT *, deal % ceil(count(*) OVER (PARTITION BY source, size) / 100000.0::DOUBLE)::BIGINT AS part FROM rows_
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight,
    2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM sizes
), levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM weighted
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target
  FROM (SELECT *, max(CASE WHEN own <= ratio THEN own END) OVER () AS level FROM levels)
), ranked AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS step,
    ('0x' || substr(md5('7:' || coalesce(r.source, '')), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.part, r.doc_id ASC NULLS FIRST) AS place
  FROM parted r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(u + place * step) - floor(u + (place - 1) * step))::BIGINT * size)::BIGINT AS taken FROM ranked
"""
