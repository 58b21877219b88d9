"""Metrics and contracts over links, candidates and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def f_half(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity; an entity without true links scores 1 if none is predicted, else 0."""
    return F.when((true == 0) & (predicted == 0), 1.0).when((true == 0) | (predicted == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (0.25 * true + predicted))


def per_entity(entities: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """tp, n_pred, n_true and f05 of every entity, those without any link included."""
    both = links.select("entity_id", "target_id", F.lit(1).alias("p")).join(truth.select("entity_id", "target_id", F.lit(1).alias("t")), ["entity_id", "target_id"], "full")
    n = both.groupBy("entity_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    out = entities.select("entity_id", *[c for c in ("country",) if c in entities.columns]).join(n, "entity_id", "left").fillna(0, ["n_pred", "n_true", "tp"])
    return out.withColumn("f05", F.round(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6))


def match_bin(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").otherwise("7+")


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, singleton accuracy, and precision and recall over entities with true links."""
    alone, some = F.col("n_true") == 0, F.col("n_true") > 0
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.coalesce(F.avg(F.when(alone, (F.col("n_pred") == 0).cast("double"))), F.lit(1.0)), 6).alias("singleton_accuracy"),
        F.round(F.avg(F.when(some, precision)), 6).alias("precision"), F.round(F.avg(F.when(some, F.col("tp") / F.col("n_true"))), 6).alias("recall"),
    )


def slices(scores: DataFrame) -> DataFrame:
    """Macro F0.5 over all, by country and by number of true links, in one pass."""
    rows = scores.withColumn("match_bin", match_bin(F.col("n_true")))
    sets = rows.groupingSets([[], ["country"], ["match_bin"]], "country", "match_bin")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def theta_grid(entities: DataFrame, truth: DataFrame, scored: DataFrame, thetas: list[float]) -> DataFrame:
    """Macro F0.5 at each threshold: counts by entity and threshold in one aggregation."""
    marked = scored.join(truth.withColumn("t", F.lit(1)), ["entity_id", "target_id"], "left")
    at = F.explode(F.filter(F.array(*[F.lit(x) for x in thetas]), lambda x: x <= F.col("p"))).alias("theta")
    hits = marked.select("entity_id", "t", at).groupBy("entity_id", "theta").agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("tp"))
    true = truth.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = entities.select("entity_id").join(true, "entity_id", "left").select("entity_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.array(*[F.lit(x) for x in thetas])).alias("theta"))
    rows = base.join(hits, ["entity_id", "theta"], "left").fillna(0, ["n_pred", "tp"])
    return rows.groupBy("theta").agg(F.round(F.avg(F.round(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6)), 6).alias("macro_f05"))


def _third(n: str, of: str) -> Column:
    return F.round(F.try_divide(F.col(n), F.col(of)), 6)


def link_report(truth: DataFrame, links: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 over links, and the recall of each target source, in one join."""
    both = links.select("entity_id", "target_id", F.lit(1).alias("p")).join(truth.select("entity_id", "target_id", F.lit(1).alias("t")), ["entity_id", "target_id"], "full")
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    of = lambda s: F.col("target_id").startswith(s)
    n = both.agg(
        F.count_if(hit).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"),
        *[x for s in ("S2", "S3") for x in (F.count_if(hit & of(s)).alias(f"tp_{s}"), F.count(F.when(of(s), F.col("t"))).alias(f"n_{s}"))],
    )
    return n.select(
        "tp", "n_pred", "n_true", _third("tp", "n_pred").alias("precision"), _third("tp", "n_true").alias("recall"),
        F.round(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6).alias("f05"), _third("tp_S2", "n_S2").alias("recall_s2"), _third("tp_S3", "n_S3").alias("recall_s3"),
    )


def blocking_report(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Link recall and covered entities by (slice, label): all, target source, country, how many sources an entity is linked to.

    ``pairs`` are the candidates of the entities in the slice (of its source, for a source), ``alone_mean`` is
    how many candidates entities without links have on average.
    """
    left = truth.join(candidates.select("entity_id", "target_id", F.lit(1).alias("c")), ["entity_id", "target_id"], "left")
    kinds = truth.groupBy("entity_id").agg(F.countDistinct(F.substring("target_id", 1, 2)).alias("k"), F.min(F.substring("target_id", 1, 2)).alias("s"))
    kind = F.when(F.col("k") > 1, "both").otherwise(F.concat(F.col("s"), F.lit("_only")))
    rows = left.join(kinds.select("entity_id", kind.alias("kind")), "entity_id").join(entities.select("entity_id", "country"), "entity_id")
    labels = {"all": F.lit("all"), "country": F.col("country"), "relationship": F.col("kind"), "source": F.substring("target_id", 1, 2)}
    sliced = rows.select("entity_id", "c", F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("label")) for k, v in labels.items()])).alias("x"))
    return sliced.groupBy("x.slice", "x.label").agg(
        F.count(F.lit(1)).alias("links"), F.count("c").alias("found"), F.round(F.count("c") / F.count(F.lit(1)), 6).alias("link_recall"),
        F.countDistinct("entity_id").alias("entities"), F.countDistinct(F.when(F.col("c") == 1, F.col("entity_id"))).alias("covered"),
    )


def alone_volume(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of entities without links: how many entities, how many candidates, their mean."""
    alone = entities.select("entity_id").join(truth.select("entity_id").distinct(), "entity_id", "left_anti")
    n = alone.join(candidates.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left").fillna(0, ["n"])
    return n.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.avg("n"), 6).alias("mean"))


def coverage(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many linked entities have all, some or none of their targets among the candidates."""
    rows = per_entity(entities, truth, candidates.join(truth, ["entity_id", "target_id"], "left_semi")).filter("n_true > 0")
    found = F.when(F.col("tp") == F.col("n_true"), "full").when(F.col("tp") > 0, "partial").otherwise("none")
    return rows.groupBy(found.alias("coverage")).agg(F.count(F.lit(1)).alias("entities"))


def decomposition(entities: DataFrame, truth: DataFrame, candidates: DataFrame, links: DataFrame) -> DataFrame:
    """What the links' macro F0.5 lacks to 1: as much as perfect decisions on the candidates lack, and the rest."""
    found = candidates.join(truth, ["entity_id", "target_id"], "left_semi")
    score = lambda x: per_entity(entities, truth, x).agg(F.avg(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f"))
    both = score(found).select(F.col("f").alias("ceiling")).crossJoin(score(links).select(F.col("f").alias("score")))
    return both.select(
        F.round("ceiling", 6).alias("ceiling"), F.round("score", 6).alias("score"), F.round(1 - F.col("score"), 6).alias("gap"),
        F.round(1 - F.col("ceiling"), 6).alias("retrieval_loss"), F.round(F.col("ceiling") - F.col("score"), 6).alias("scorer_loss"),
    )


def ladder(missed: DataFrame) -> DataFrame:
    """The first step that each missed link reaches, and how many reach it: of attached, measured pairs (q_*, t_*, m)."""
    sort, jw, sets, part = (F.col(f"m.name_{x}") for x in ("token_sort", "jw", "token_set", "partial"))
    step = (
        F.when(F.col("q_clean_name") == F.col("t_clean_name"), "exact name")
        .when(F.col("q_sorted_name") == F.col("t_sorted_name"), "sorted name")
        .when(sort >= 0.95, "token sort from 0.95")
        .when(sort >= 0.85, "token sort from 0.85")
        .when(jw >= 0.92, "Jaro-Winkler from 0.92")
        .when(sets >= 0.9, "token set from 0.9")
        .when(part >= 0.9, "partial from 0.9")
        .when(jw >= 0.8, "Jaro-Winkler from 0.8")
        .when(sort >= 0.7, "token sort from 0.7")
        .otherwise("low")
    )
    return missed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("links"))


def reduction(entities: DataFrame, targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which share of all pairs the candidates spare."""
    one = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    n = one(entities, "n_queries").crossJoin(one(targets, "n_targets")).crossJoin(one(candidates, "pairs"))
    return n.select("*", F.round(1 - F.try_divide("pairs", F.col("n_queries") * F.col("n_targets")), 9).alias("reduction"))


def volume(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distribution of candidates for each entity, those without any included."""
    n = entities.select("entity_id").join(candidates.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left").fillna(0, ["n"])
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95, 0.99)]))
    return n.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), q.alias("q")).select(
        "entities", "pairs", "mean", "most", *[F.round(F.col("q")[k], 6).alias(x) for k, x in enumerate(("p25", "p50", "p75", "p95", "p99"))])


def auc_ap(labelled: DataFrame, ranges: int = 4096) -> DataFrame:
    """ROC-AUC and average precision of (p, label), exact, over distinct scores.

    Their counts are summed up in ranges of scores first, so that no task sorts more than one of these
    or, for the sums over them, ``ranges`` rows.
    """
    by = labelled.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    by = by.withColumn("range", F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * (ranges - 1)))
    sums = by.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    up, down = (Window.partitionBy(F.lit(0)).orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in ("range", F.desc("range")))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("range", zero("neg", up).alias("below"), zero("pos", down).alias("tp"), zero(F.col("pos") + F.col("neg"), down).alias("all"))
    inner = Window.partitionBy("range")
    lower, upper = inner.orderBy("p"), inner.orderBy(F.desc("p"))
    rows = by.join(F.broadcast(sums), "range").select(
        "pos", "neg", (F.col("below") + F.sum("neg").over(lower) - F.col("neg")).alias("below"),
        (F.col("tp") + F.sum("pos").over(upper)).alias("tp"), (F.col("all") + F.sum(F.col("pos") + F.col("neg")).over(upper)).alias("all"),
    )
    return rows.agg(
        F.round(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"),
        F.round(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("all")), F.sum("pos")), 6).alias("ap"))


def contract(entities: DataFrame, prefix: str) -> DataFrame:
    """Violations of the entity contract, in one aggregation."""
    i = F.col("entity_id")
    return entities.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(i.isNull() | (i == "")).alias("missing_ids"), (F.count(i) - F.countDistinct(i)).alias("repeated_ids"), F.count_if(~i.startswith(prefix)).alias("wrong_prefix"),
        F.count_if(F.col("business_name").isNull()).alias("null_names"), F.count_if(F.col("country").isNull()).alias("null_countries"), F.count_if(F.col("business_address").isNull()).alias("null_addresses"))


def required(entities: DataFrame, prefix: str) -> None:
    """Raises unless the table has the contract's columns, rows, unique ids with the prefix, names and countries."""
    lacking = {"entity_id", "business_name", "business_address", "country"} - set(entities.columns)
    if lacking:
        raise ValueError(f"missing columns: {', '.join(sorted(lacking))}")
    n = contract(entities, prefix).first().asDict()
    if not n["rows"]:
        raise ValueError("the table is empty")
    broken = {k: v for k, v in n.items() if v and k not in ("rows", "null_addresses")}
    if broken:
        raise ValueError(f"broken contract: {broken}")


#: Findings that don't make a result invalid.
WARNINGS = ("outside_candidates",)


def findings(required: DataFrame, lists: DataFrame, candidates: DataFrame | None = None, targets: DataFrame | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """Findings on a result table (source1_entity_id, ``column``): how many entities or ids each concerns, and whether it is an error."""
    e = F.col("source1_entity_id")
    items = lists.select(e.alias("entity_id"), F.split(F.coalesce(F.col(column), F.lit("")), ",").alias("ids")).withColumn("ids", F.filter("ids", lambda x: x != ""))
    one = items.select("entity_id", F.explode("ids").alias("target_id"))
    once = one.select("target_id").distinct()
    own, other = F.col("target_id").startswith("S1-"), F.col("target_id").rlike("^S[23]-")
    known = required.select(F.col("entity_id").alias("source1_entity_id"))
    checks = {
        "repeated_entity": lists.groupBy(e).count().filter("count > 1"),
        "repeated_target": items.filter(F.size(F.array_distinct("ids")) < F.size("ids")).select("entity_id").distinct(),
        "self_match": once.filter(own),
        "bad_prefix": once.filter(~own & ~other),
        "missing_entity": known.join(lists, "source1_entity_id", "left_anti"),
        "extra_entity": lists.select("source1_entity_id").distinct().join(known, "source1_entity_id", "left_anti"),
    }
    if targets is not None:
        checks["unknown_target"] = once.filter(other).join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti")
    if candidates is not None:
        checks["outside_candidates"] = one.join(candidates, ["entity_id", "target_id"], "left_anti").select("entity_id").distinct()
    parts = [rows.agg(F.lit(name).alias("finding"), F.lit("warning" if name in WARNINGS else "error").alias("level"), F.count(F.lit(1)).alias("n")) for name, rows in checks.items()]
    return reduce(DataFrame.unionAll, parts)


def validate(spark: SparkSession, path: str, required: DataFrame, candidates: DataFrame | None = None, targets: DataFrame | None = None, column: str = "matched_entity_ids") -> tuple[list[str], list[str]]:
    """Errors and warnings on a result file: its header, rows without a tab, and all that :func:`findings` counts."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first:
        return [f"{path} is empty"], []
    header = first[0][0]
    if "\t" not in header and "," in header:
        return [f"{path} is separated by commas, not by tabs"], []
    if [c.strip().lower() for c in header.split("\t")] != ["source1_entity_id", column]:
        return [f"{path} has the header {header!r}"], []
    rows = lines.filter(F.col("value") != header)
    bare = rows.filter(~F.contains("value", F.lit("\t")) & (F.trim("value") != "")).count()
    errors = [f"rows without a tab: {bare}"] if bare else []
    split = rows.filter(F.contains("value", F.lit("\t"))).select(F.substring_index("value", "\t", 1).alias("source1_entity_id"), F.regexp_replace("value", "^[^\t]*\t", "").alias(column))
    found = findings(required, split, candidates, targets, column).filter("n > 0").orderBy("finding").collect()
    errors += [f"{r.finding}: {r.n}" for r in found if r.level == "error"]
    return errors, [f"{r.finding}: {r.n}" for r in found if r.level == "warning"]


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """How a key compresses a table and how large its groups are."""
    groups = entities.filter(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    high = F.percentile("n", F.array(F.lit(0.95), F.lit(0.99)))
    out = groups.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("ratio"), F.count_if(F.col("n") > 1).alias("shared_keys"),
        F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 50).alias("over_50"), high.alias("q"),
    )
    return out.withColumns({"p95": F.round(F.col("q")[0], 6), "p99": F.round(F.col("q")[1], 6)}).drop("q")
