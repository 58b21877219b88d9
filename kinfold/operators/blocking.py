"""Candidate generation: a registry of equi-join channels, pooling and a budget for each query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.store import spread
from . import grams as G

#: Most queries that a search holds in one task, and parts that it makes of fewer for the sake of more machines.
PART, PARTS = 1 << 15, 24


def normalize(entities: DataFrame, postal_source: str = "raw") -> DataFrame:
    """Entities with all keys that channels join on; neither they nor the country are ever null."""
    name, address, country = F.col("business_name"), F.col("business_address"), F.trim(F.coalesce("country", F.lit("")))
    out = entities.withColumn("country", country).withColumns({
        "clean_name": T.clean(name),
        "sorted_name": T.sorted_name(name),
        "std_address": T.std_address(address),
        "sorted_addr": T.sorted_address(address),
        "postal_code": T.postal_code(address, F.col("country"), postal_source),
        "adv_name": T.advanced_name(name),
    })
    out = out.withColumns({
        "stripped_name": T.without_words(F.col("clean_name")),
        "deleet_name": T.deleet(F.col("clean_name")),
        "spaceless_name": T.spaceless(F.col("clean_name")),
        "house_no": T.house_number(F.col("std_address")),
        "first_word": T.word_at(F.col("clean_name"), 0),
        "addr_p3": T.slice_words(F.col("std_address"), 1, 3),
        "unit_p3": T.slice_words(T.without_unit(F.col("std_address")), 1, 3),
        "street_prefix": T.slice_words(F.col("std_address"), 2, 2),
        "addr_sig": T.address_signature(F.col("std_address")),
        "prefix2": T.slice_words(F.col("sorted_name"), 1, 2),
        "latin_name": T.transliterate(F.col("clean_name")),
        "name_pair": T.two_longest(T.words(F.col("clean_name")), 4, (), digits=False),
        "addr_pair": T.two_longest(T.words(F.col("std_address")), 5, T.PAIR_STOPS, digits=False),
    })
    return out.withColumns({
        "brand_token": T.brand_token(F.col("stripped_name")),
        "name_bigram": T.name_bigram(F.col("stripped_name")),
        "sorted_deleet": T.sort_words(T.without_words(F.col("deleet_name"))),
        "latin_sorted": T.sort_words(T.without_words(F.col("latin_name"))),
        "first_word3": F.coalesce(F.get(F.filter(T.words(F.col("clean_name")), lambda x: F.length(x) >= 3), F.lit(0)), F.lit("")),
    })


@dataclass(frozen=True)
class Channel:
    """An equi-join on ``keys`` and, unless ``country`` is off, the country.

    ``least`` are the keys' shortest lengths, ``most`` the largest frequency among targets (0: any),
    ``pattern`` what the first key has to match.
    """

    name: str
    keys: tuple[str, ...]
    prio: float
    least: tuple[int, ...] = (1,)
    most: int = 0
    pattern: str = ""
    country: bool = True

    @property
    def on(self) -> list[str]:
        return [*(("country",) if self.country else ()), *self.keys]

    def usable(self) -> Column:
        ok = reduce(Column.__and__, [F.length(k) >= n for k, n in zip(self.keys, self.least, strict=True)])
        return ok & F.col(self.keys[0]).rlike(self.pattern) if self.pattern else ok


CHANNELS = (
    Channel("exact_name", ("clean_name",), 1.0),
    Channel("sorted_name", ("sorted_name",), 0.95),
    Channel("std_address", ("std_address",), 0.9, (10,)),
    Channel("sorted_addr", ("sorted_addr",), 0.88, (15,)),
    Channel("rare_bigram", ("name_bigram",), 0.75, (1,), 500),
    Channel("street_prefix3", ("addr_p3",), 0.7, (8,), 0, "[0-9]"),
    Channel("rare_brand", ("brand_token",), 0.6, (1,), 300),
)
MORE_CHANNELS = (
    Channel("spaceless", ("spaceless_name",), 0.95, (6,)),
    Channel("sorted_deleet", ("sorted_deleet",), 0.93),
    Channel("house_first_word", ("house_no", "first_word"), 0.82, (2, 4)),
    Channel("postal_first_word", ("postal_code", "first_word"), 0.8, (5, 4)),
    Channel("house_street", ("house_no", "street_prefix"), 0.78, (2, 6)),
    Channel("addr_sig", ("addr_sig",), 0.72, (1,), 200),
    Channel("adv_name", ("adv_name",), 0.7, (5,), 150),
    Channel("rare_house", ("house_no",), 0.65, (3,), 10),
    Channel("prefix2", ("prefix2",), 0.6, (4,)),
    Channel("unit_prefix3", ("unit_p3",), 0.7, (8,), 0, "[0-9]"),
    Channel("latin_exact", ("latin_name",), 0.95),
    Channel("latin_sorted", ("latin_sorted",), 0.85),
    Channel("postal_anywhere", ("postal_code", "first_word3"), 0.8, (5, 3), country=False),
    Channel("name_pair", ("name_pair",), 0.74),
    Channel("addr_pair", ("addr_pair",), 0.73),
)
#: Channels that only look at names in an Indic script.
INDIC_ONLY = ("latin_exact", "latin_sorted")


def rare_keys(targets: DataFrame, channel: Channel) -> DataFrame:
    """Keys of a channel that at most ``most`` targets of a country have."""
    return targets.filter(channel.usable()).groupBy(channel.on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= channel.most).drop("n")


def pairs(queries: DataFrame, targets: DataFrame, channel: Channel) -> DataFrame:
    """Distinct (entity_id, target_id, prio) of one channel. Spark picks the join and splits a hot key."""
    ok = channel.usable()
    if channel.name in INDIC_ONLY:
        ok = ok & F.col("clean_name").rlike(T.INDIC_LETTER)
    q = queries.filter(ok).select("entity_id", *channel.on)
    t = targets.filter(ok).select(F.col("entity_id").alias("target_id"), *channel.on)
    if channel.most:
        t = t.join(rare_keys(targets, channel), channel.on, "left_semi")
    found = q.join(t, channel.on).select("entity_id", "target_id")
    # An entity has one value of each key, so that a join by them makes each pair once.
    return found.withColumn("prio", F.lit(channel.prio))


def pool(found: list[DataFrame]) -> DataFrame:
    """One row for each pair: its best priority and in how many channels it was found."""
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("entity_id", "target_id").agg(F.max("prio").alias("max_prio"), F.count(F.lit(1)).cast("int").alias("n_channels"))


def pool_pools(pools: list[DataFrame]) -> DataFrame:
    """Pools as one: a pair's best priority, and its channels added up."""
    every = reduce(DataFrame.unionByName, pools)
    return every.groupBy("entity_id", "target_id").agg(F.max("max_prio").alias("max_prio"), F.sum("n_channels").cast("int").alias("n_channels"))


def ranked_pool(found: list[DataFrame]) -> DataFrame:
    """One row for each pair of tables in order of merit: the least place of a table that has it."""
    every = [x.select("entity_id", "target_id", F.lit(k).alias("place")) for k, x in enumerate(found, 1)]
    return reduce(DataFrame.unionByName, every).groupBy("entity_id", "target_id").agg(F.min("place").alias("place"))


def three_pass(queries: DataFrame, targets: DataFrame, k: int = 30, postal: bool = True) -> DataFrame:
    """Exact names, sorted names, then postal code and first word: each pair with the first pass that finds it."""
    passes = [CHANNELS[0], CHANNELS[1], *([Channel("postal_first_word", ("postal_code", "first_word"), 0.8, (1, 3))] if postal else [])]
    names = ("exact_clean", "token_sorted", "postal_first_word")
    first = top_k(ranked_pool([pairs(queries, targets, c) for c in passes]), k, F.asc("place"))
    return first.select("entity_id", "target_id", F.element_at(F.array(*map(F.lit, names)), F.col("place")).alias("provenance"))


def pair_space(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """How many pairs there are within a country: a product of counts, no join of rows."""
    q = queries.groupBy("country").agg(F.count(F.lit(1)).alias("n_queries"))
    t = targets.groupBy("country").agg(F.count(F.lit(1)).alias("n_targets"))
    both = q.join(t, "country", "full").fillna(0, ["n_queries", "n_targets"])
    return both.select("country", "n_queries", "n_targets", (F.col("n_queries") * F.col("n_targets")).alias("n_pairs"))


def top_k(candidates: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """At most ``k`` candidates of each query, or all of them; ties by target id."""
    if k is None:
        return candidates
    order = order or (F.desc("max_prio"), F.desc("n_channels"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(*order, F.asc("target_id")))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def candidates(queries: DataFrame, targets: DataFrame, channels: tuple[Channel, ...] = CHANNELS, k: int | None = 40) -> DataFrame:
    return top_k(pool([pairs(queries, targets, c) for c in channels]), k)


def token_index(queries: DataFrame, targets: DataFrame, key: str = "clean_name", most: int | None = 2000, k: int | None = 25) -> DataFrame:
    """Targets ranked by how many rare words of at least 4 letters they share with a query; without ``most``, by all words."""

    def exploded(df: DataFrame, name: str) -> DataFrame:
        tokens = F.array_distinct(F.filter(T.words(F.col(key)), lambda x: F.length(x) >= 4))
        return df.select(F.col("entity_id").alias(name), "country", F.explode(tokens).alias("word"))

    t = exploded(targets, "target_id")
    if most is not None:
        rare = t.groupBy("country", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).drop("n")
        t = t.join(rare, ["country", "word"], "left_semi")
    shared = exploded(queries, "entity_id").join(t, ["country", "word"]).groupBy("entity_id", "target_id").agg(F.count(F.lit(1)).alias("shared"))
    return top_k(shared, k, F.desc("shared"))


@dataclass(frozen=True)
class Grams:
    """An index of targets by n-grams: ``idf`` (shard, gram, hash, idf) and ``names`` (id, shard, text), which can be stored."""

    idf: DataFrame
    names: DataFrame


def _named(df: DataFrame, key: str, by_country: bool) -> DataFrame:
    """Each entity's words with a blank on both sides; null has none."""
    words = T.words(F.coalesce(F.col(key), F.lit("")))
    text = F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise("")
    return df.select(F.col("entity_id").alias("id"), (F.col("country") if by_country else F.lit("")).alias("shard"), text.alias("text"))


def gram_index(
    targets: DataFrame, key: str = "clean_name", *, sizes: tuple[int, ...] = (3, 4), min_df: int = 2, max_df: float | None = 0.05,
    max_features: int | None = None, by_country: bool = True,
) -> Grams:
    """The n-grams of the targets' blank-padded words, of each country or of all, with their idf.

    Grams of fewer than ``min_df`` targets or more than the share ``max_df`` are left out, and of the rest
    all but the ``max_features`` commonest (ties by gram). None leaves a bound out. The share bounds postings.
    """
    names = _named(targets, key, by_country)
    rows = names.withColumns({"part": F.lit(0), "side": F.lit(1), "shard_hash": F.xxhash64("shard")})
    counts = spread(rows, "id").sortWithinPartitions("id").mapInArrow(G.counted(sizes), "shard string, gram string, hash long, df long, all long")
    total = names.groupBy("shard").agg(F.count(F.lit(1)).alias("total"))
    df = counts.groupBy("shard", "gram").agg(F.first("hash").alias("hash"), F.sum("df").alias("df"), F.sum("all").alias("all")).join(total, "shard").filter(F.col("df") >= min_df)
    if max_df is not None:
        df = df.filter(F.col("df") <= F.greatest(max_df * F.col("total"), F.lit(float(min_df))))
    if max_features is not None:
        common = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("all"), "gram"))
        df = df.withColumn("place", common).filter(F.col("place") <= max_features)
    return Grams(df.select("shard", "gram", "hash", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), names)


def gram_search(
    queries: DataFrame, index: Grams, key: str = "clean_name", *, sizes: tuple[int, ...] = (3, 4), k: int | None = 60, min_score: float = 0.12, by_country: bool = True,
) -> DataFrame:
    """Cosine of queries and indexed targets, the ``k`` best of each query (None: all).

    Weights are logarithmic counts times idf, of length 1. Queries are dealt to parts, and each part gets all
    targets' names: it inverts a block of them at a time and adds up its queries' scores there, so that what is
    shuffled grows with the targets times the parts, not with the pairs. The grams' idf is broadcast, 16 bytes each.
    """
    session = queries.sparkSession
    idf = index.idf.select("hash", "idf").toArrow()
    held = session.sparkContext.broadcast((idf.column("hash").to_numpy().view("uint64"), idf.column("idf").to_numpy()))
    q, n = _named(queries, key, by_country), queries.count()
    # At least the first number of parts by their memory; up to the second for the sake of more machines.
    parts = max(1, -(-n // PART), min(PARTS, int(session.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)))
    q = q.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "side": F.lit(0)})
    t = index.names.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "side": F.lit(1)})
    both = q.unionByName(t).select("part", "side", "id", F.xxhash64("shard").alias("shard_hash"), "text")
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "side", "id")
    return dealt.mapInArrow(G.searched(held, sizes, k, min_score), "entity_id string, target_id string, score double")


def tfidf(queries: DataFrame, targets: DataFrame, key: str = "clean_name", *, by_country: bool = True, k: int | None = 60, min_score: float = 0.12, **options) -> DataFrame:
    """Targets of each query by the cosine of their n-grams."""
    return gram_search(queries, gram_index(targets, key, by_country=by_country, **options), key, k=k, min_score=min_score, by_country=by_country)


def thin_queries(queries: DataFrame, found: DataFrame, fewer: int = 20) -> DataFrame:
    """Queries with fewer candidates than that; 1 leaves those without any."""
    n = found.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewer).select("entity_id")
    return queries.join(n, "entity_id", "left_anti")


def recovered(queries: DataFrame, found: DataFrame, index: Grams, fewer: int = 20, share: float = 0.75, **options) -> DataFrame:
    """The pool with what the n-gram index has for thin queries, at ``share`` of the cosine as priority."""
    more = gram_search(thin_queries(queries, found, fewer), index, **options)
    extra = more.select("entity_id", "target_id", F.round(share * F.col("score"), 6).alias("max_prio"), F.lit(1).alias("n_channels"))
    return pool_pools([found.select("entity_id", "target_id", "max_prio", "n_channels"), extra])
