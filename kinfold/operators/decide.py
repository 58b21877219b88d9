"""Decisions on scored pairs (entity_id, target_id, p): which links are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ranked_order() -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy(F.desc("p"), F.asc("target_id"))


def source() -> Column:
    return F.substring("target_id", 1, 2)


def flat(scored: DataFrame, theta: float) -> DataFrame:
    return scored.filter(F.col("p") >= theta)


def by_label(scored: DataFrame, label: Column, thetas: dict[str, float], other: float) -> DataFrame:
    """A threshold for each label, such as country or target source."""
    theta = F.lit(other)
    for name, value in thetas.items():
        theta = F.when(label == name, F.lit(value)).otherwise(theta)
    return scored.filter(F.col("p") >= theta)


def margin_gate(scored: DataFrame, high: float, low: float, gap: float) -> DataFrame:
    """Above ``high``, or the best one above ``low`` that leads the runner-up by ``gap`` or is alone."""
    ranked = scored.withColumns({"rank": F.row_number().over(ranked_order()), "next": F.lead("p").over(ranked_order())})
    return ranked.filter((F.col("p") >= high) | ((F.col("rank") == 1) & (F.col("p") >= low) & (F.col("next").isNull() | (F.col("p") - F.col("next") >= gap)))).drop("rank", "next")


def cap_per_source(scored: DataFrame, theta: float, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("entity_id", source()).orderBy(F.desc("p"), F.asc("target_id")))
    return scored.filter(F.col("p") >= theta).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def with_fallback(scored: DataFrame, theta: float, most: int, low: float, gap: float) -> DataFrame:
    """Capped matches above ``theta``; a query without any takes its best one above ``low`` if it leads by ``gap``."""
    ranked = scored.withColumns({
        "rank": F.row_number().over(ranked_order()), "next": F.coalesce(F.lead("p").over(ranked_order()), F.lit(0.0)), "best": F.max("p").over(Window.partitionBy("entity_id")),
        "place": F.row_number().over(Window.partitionBy("entity_id", source()).orderBy(F.desc("p"), F.asc("target_id"))),
    })
    usual = (F.col("p") >= theta) & (F.col("place") <= most)
    last = (F.col("best") < theta) & (F.col("rank") == 1) & (F.col("p") >= low) & (F.col("p") - F.col("next") >= gap)
    return ranked.filter(usual | last).drop("rank", "next", "best", "place")


def tiered(scored: DataFrame, first: float, later: float, most: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(ranked_order()))
    return ranked.filter((F.col("rank") <= most) & (F.col("p") >= F.when(F.col("rank") == 1, first).otherwise(later))).drop("rank")


def cross_source(scored: DataFrame, best: float, extra: float, most: int) -> DataFrame:
    """The best of each source above ``best``, others above ``extra``."""
    place = F.row_number().over(Window.partitionBy("entity_id", source()).orderBy(F.desc("p"), F.asc("target_id")))
    kept = scored.withColumn("place", place).filter(F.col("p") >= F.when(F.col("place") == 1, best).otherwise(extra)).drop("place")
    return kept.withColumn("rank", F.row_number().over(ranked_order())).filter(F.col("rank") <= most).drop("rank")


def relative(scored: DataFrame, theta: float, share: float, least: float) -> DataFrame:
    best = F.max("p").over(Window.partitionBy("entity_id"))
    return scored.withColumn("best", best).filter((F.col("best") >= least) & (F.col("p") >= theta) & (F.col("p") >= share * F.col("best"))).drop("best")


def exclusive_global(links: DataFrame) -> DataFrame:
    """Each target goes to the query that scores it best, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("p"), F.asc("entity_id")))
    return links.withColumn("rank", rank).filter("rank = 1").drop("rank")


def exclusive_tiered(locked: DataFrame, links: DataFrame) -> DataFrame:
    """Locked links stay as they are; others get what those leave, each target once."""
    return locked.unionByName(exclusive_global(links.join(locked.select("target_id").distinct(), "target_id", "left_anti")).select(locked.columns))


def boost_singletons(base: DataFrame, more: DataFrame) -> DataFrame:
    """Base links, and others' links for queries that base leaves empty."""
    return base.unionByName(more.join(base.select("entity_id").distinct(), "entity_id", "left_anti").select(base.columns))


def extend_single(base: DataFrame, scored: DataFrame, theta: float) -> DataFrame:
    """Queries with one link get their next best above ``theta``."""
    one = base.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("entity_id")
    rest = scored.filter(F.col("p") >= theta).join(base.select("entity_id", "target_id"), ["entity_id", "target_id"], "left_anti").join(one, "entity_id", "left_semi")
    return base.unionByName(rest.withColumn("rank", F.row_number().over(ranked_order())).filter("rank = 1").select(base.columns))


def prune(base: DataFrame, other: DataFrame, pair: float, entity: float) -> DataFrame:
    """Base links that the other model confirms, as a pair or by its best score for the query."""
    second = base.join(other.select("entity_id", "target_id", F.col("p").alias("p2")), ["entity_id", "target_id"], "left")
    best = F.max("p2").over(Window.partitionBy("entity_id"))
    return second.withColumn("best2", best).filter((F.col("p2") >= pair) | (F.col("best2") >= entity)).drop("p2", "best2")


def bypass(queries: DataFrame, targets: DataFrame, key: str = "addr_sig", most: int = 30, scope: str = "global") -> DataFrame:
    """Links by an equal key that few targets have, with a score of 1; targets are counted in all or, by ``scope``, in each country."""
    on = [key] if scope == "global" else [key, "country"]
    rare = targets.filter(F.col(key) != "").groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select(on)
    t = targets.select(F.col("entity_id").alias("target_id"), key, "country").join(rare, on, "left_semi")
    return queries.select("entity_id", key, "country").join(t, [key, "country"]).select("entity_id", "target_id", F.lit(1.0).alias("p")).distinct()


def capped_by_label(scored: DataFrame, thetas: dict[str, float], other: float, most: int) -> DataFrame:
    """A threshold for each target source, and at most ``most`` of each."""
    return cap_per_source(by_label(scored, source(), thetas, other), 0.0, most)


def margin_gate_capped(scored: DataFrame, high: float, low: float, gap: float, most: int) -> DataFrame:
    """The margin gate, then at most ``most`` of each source."""
    return cap_per_source(margin_gate(scored, high, low, gap), 0.0, most)


def bypass_or_fallback(scored: DataFrame, sure: DataFrame, theta: float, low: float, gap: float) -> DataFrame:
    """Sure links, and scored ones above ``theta``; a query without any of both takes its best one above ``low``.

    That one must lead the runner-up, which counts as 0 if there is none, by ``gap``. A pair that is
    both has the score of the sure link.
    """
    names = ["entity_id", "target_id", "p"]
    usual = flat(scored, theta).select(names).join(sure.select("entity_id", "target_id"), ["entity_id", "target_id"], "left_anti")
    found = sure.select(names).unionByName(usual)
    ranked = scored.withColumns({"rank": F.row_number().over(ranked_order()), "next": F.coalesce(F.lead("p").over(ranked_order()), F.lit(0.0))})
    last = ranked.filter((F.col("rank") == 1) & (F.col("p") >= low) & (F.col("p") - F.col("next") >= gap)).select(names)
    return found.unionByName(last.join(found.select("entity_id").distinct(), "entity_id", "left_anti").select(names))


def without_bypass(scored: DataFrame, theta: float, most: int, low: float, gap: float) -> DataFrame:
    """Scores of 1 or more, which stand for sure links, go; the rest is decided with the capped fallback.

    A query's only candidate needs no gap.
    """
    rest = scored.filter(F.col("p") < 1)
    by = Window.partitionBy("entity_id")
    ranked = rest.withColumns({
        "rank": F.row_number().over(ranked_order()),
        "next": F.lead("p").over(ranked_order()),
        "best": F.max("p").over(by),
        "place": F.row_number().over(Window.partitionBy("entity_id", source()).orderBy(F.desc("p"), F.asc("target_id"))),
    })
    usual = (F.col("p") >= theta) & (F.col("place") <= most)
    last = (F.col("best") < theta) & (F.col("rank") == 1) & (F.col("p") >= low) & (F.col("next").isNull() | (F.col("p") - F.col("next") >= gap))
    return ranked.filter(usual | last).drop("rank", "next", "best", "place")


def specific(sure: DataFrame, most: int) -> DataFrame:
    """Sure links whose target at most ``most`` queries have."""
    n = sure.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("target_id")
    return sure.join(n, "target_id", "left_semi")


def boost_with_bypass(base: DataFrame, scored: DataFrame, sure: DataFrame, theta: float, most: int) -> DataFrame:
    """Base links; queries that base leaves empty get scored links above ``theta`` and specific sure ones."""
    names = ["entity_id", "target_id", "p"]
    more = flat(scored, theta).select(names).unionByName(specific(sure, most).select(names))
    best = more.groupBy("entity_id", "target_id").agg(F.max("p").alias("p"))
    return boost_singletons(base.select(names), best)


def rethreshold(scored: DataFrame, theta: float, most: int, per_source: int) -> DataFrame:
    """Scores from ``theta`` to below 1, the best of each pair; a query's ``most`` best, of which ``per_source`` of a source."""
    best = scored.filter((F.col("p") >= theta) & (F.col("p") < 1)).groupBy("entity_id", "target_id").agg(F.max("p").alias("p"))
    top = best.withColumn("rank", F.row_number().over(ranked_order())).filter(F.col("rank") <= most).drop("rank")
    return cap_per_source(top, theta, per_source)


def relaxed_third(scored: DataFrame, theta: float, sure: float, relaxed: float) -> DataFrame:
    """Above ``theta``; a third-source target above ``relaxed`` if a second-source one of its query is above ``sure``."""
    second = F.max(F.when(source() == "S2", F.col("p"))).over(Window.partitionBy("entity_id"))
    rows = scored.withColumn("second", second)
    return rows.filter((F.col("p") >= theta) | ((source() == "S3") & (F.col("p") >= relaxed) & (F.col("second") >= sure))).drop("second")
