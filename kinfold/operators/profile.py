"""Profiles of links, names and keys: distributions, changes between matched names, structure of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import phonetic, text as T


def most_common(values: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` values that are there most often, equals in their own order."""
    return values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def ordered_quantiles(values: DataFrame, column: str, shares: list[float], nearest: bool = False) -> DataFrame:
    """(share, value): the value at place int(n * share) from 0 of the sorted ones, or the one nearest to (n - 1) * share.

    Equal values are counted first, so that only distinct ones are put in order.
    """
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(F.lit(0)).orderBy("value")
    sums = counts.select("value", F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    rows = sums.select("value", "upto", "n", F.explode(F.array(*[F.lit(x) for x in shares])).alias("share"))
    place = F.round((F.col("n") - 1) * F.col("share")) if nearest else F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)
    return rows.filter(F.col("upto") > place).groupBy("share").agg(F.min("value").alias("value"))


def by_source(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Links of each entity in the second and third source, entities without any included."""
    of = lambda s: F.count_if(F.col("target_id").startswith(s))
    n = links.groupBy("entity_id").agg(of("S2").alias("s2"), of("S3").alias("s3"))
    return entities.select("entity_id").join(n, "entity_id", "left").fillna(0, ["s2", "s3"])


def source_breakdown(entities: DataFrame, links: DataFrame) -> DataFrame:
    """How many entities are linked to no, the second, the third or both sources."""
    kind = F.when((F.col("s2") > 0) & (F.col("s3") > 0), "both").when(F.col("s2") > 0, "s2_only").when(F.col("s3") > 0, "s3_only").otherwise("singleton")
    return by_source(entities, links).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("entities"))


def joint_counts(entities: DataFrame, links: DataFrame) -> DataFrame:
    return by_source(entities, links).groupBy("s2", "s3").agg(F.count(F.lit(1)).alias("entities"))


def truth_profile(entities: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """Size and soundness of a table of links: repeated pairs, ids that no table has, shared targets."""
    q, t = entities.select("entity_id"), targets.select(F.col("entity_id").alias("target_id"))
    one = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    base = links.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("target_id").alias("targets"), F.countDistinct("entity_id", "target_id").alias("pairs"))
    shared = links.groupBy("target_id").agg(F.countDistinct("entity_id").alias("n")).filter("n > 1")
    return (
        base.withColumn("repeated", F.col("links") - F.col("pairs")).drop("pairs")
        .crossJoin(one(links.join(q, "entity_id", "left_anti"), "unknown_entities"))
        .crossJoin(one(links.join(t, "target_id", "left_anti"), "unknown_targets"))
        .crossJoin(one(shared, "shared_targets"))
    )


def linked(links: DataFrame, queries: DataFrame, targets: DataFrame, *columns: str) -> DataFrame:
    """Links with both sides' columns as q_* and t_*."""
    q = queries.select("entity_id", *[F.col(c).alias(f"q_{c}") for c in columns])
    t = targets.select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return links.select("entity_id", "target_id").join(q, "entity_id").join(t, "target_id")


def _rate(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)


def match_statistics(pairs: DataFrame) -> DataFrame:
    """Agreement and blanks of linked pairs (raw q_*, t_* names, addresses and countries)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    same = lambda c: F.col(f"q_{c}") == F.col(f"t_{c}")
    low = lambda c: F.lower(f"q_{c}") == F.lower(f"t_{c}")
    n, a = "business_name", "business_address"
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), _rate(same("country")).alias("same_country"), _rate(same(n)).alias("same_name"), _rate(low(n)).alias("same_name_lower"),
        _rate(same(a)).alias("same_address"), _rate(low(a)).alias("same_address_lower"), _rate(blank(f"q_{n}")).alias("blank_q_name"), _rate(blank(f"t_{n}")).alias("blank_t_name"),
        _rate(blank(f"q_{a}")).alias("blank_q_address"), _rate(blank(f"t_{a}")).alias("blank_t_address"),
    )


def token_changes(pairs: DataFrame) -> DataFrame:
    """(kind, word, n): words of the query's clean name that the target's lacks (dropped), and the other way round (added)."""
    q, t = (F.array_distinct(T.words(F.col(f"{s}_clean_name"))) for s in "qt")
    kinds = F.array(F.struct(F.lit("dropped").alias("kind"), F.array_except(q, t).alias("w")), F.struct(F.lit("added").alias("kind"), F.array_except(t, q).alias("w")))
    rows = pairs.select(F.explode(kinds).alias("x")).select("x.kind", F.explode("x.w").alias("word"))
    return rows.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))


def corruption(pairs: DataFrame) -> DataFrame:
    """How clean names of linked pairs differ in length, and how many have the same words, in another order."""
    q, t = (T.words(F.col(f"{s}_clean_name")) for s in "qt")
    bag = F.array_sort(F.array_distinct(q)) == F.array_sort(F.array_distinct(t))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.size(q) - F.size(t)), 6).alias("words_diff"), F.round(F.avg(F.length("q_clean_name") - F.length("t_clean_name")), 6).alias("length_diff"),
        _rate(bag).alias("same_words"), _rate(bag & (q != t)).alias("reordered"),
    )


def postal_agreement(pairs: DataFrame) -> DataFrame:
    """Linked pairs by country: how many have postal codes on both sides, and how many of these agree."""
    q, t = F.col("q_postal_code"), F.col("t_postal_code")
    both = (q != "") & (t != "")
    return pairs.groupBy(F.col("q_country").alias("country")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(both).alias("both"), F.count_if(both & (q == t)).alias("equal"))


def sibling_pairs(links: DataFrame, source: str = "S2") -> DataFrame:
    """Pairs a < b of one entity's targets in a source."""
    of = links.filter(F.col("target_id").startswith(source))
    a, b = (of.select("entity_id", F.col("target_id").alias(x)) for x in "ab")
    return a.join(b, "entity_id").filter("a < b")


def name_precision(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of a channel, entities that have any, and how many pairs are true."""
    marked = pairs.select("entity_id", "target_id").join(truth.withColumn("t", F.lit(1)), ["entity_id", "target_id"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("entity_id").alias("entities"), F.count("t").alias("true_pairs"),
        F.round(F.try_divide(F.count("t"), F.count(F.lit(1))), 6).alias("precision"))


def scripts(entities: DataFrame) -> DataFrame:
    """Names by country: how many aren't ASCII, in an Indic script, or accented; French forms and streets."""
    flags = T.script_profile(F.col("business_name")) | {f"french_{k}": v for k, v in T.french_profile(F.col("business_name"), F.col("business_address")).items()}
    return entities.groupBy("country").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(k) for k, v in flags.items()])


def phonetic_collisions(entities: DataFrame) -> DataFrame:
    """How many distinct names and phonetic keys there are, and the largest group of each."""
    names = entities.filter(F.col("clean_name") != "").select("clean_name")
    keys = {"name": F.col("clean_name"), "soundex": F.soundex("clean_name"), "metaphone": phonetic.metaphone("clean_name"), "nysiis": phonetic.nysiis("clean_name")}
    rows = names.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])).alias("x")).select("x.*")
    groups = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most"))
