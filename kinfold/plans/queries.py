"""The registered linkage queries over the entity view of the documents table.

What all of them share is stored once: normalised entities, true links, the pool's best candidates with both
sides' keys, and their scores. Channels read the stored keys that they join on, and decisions read scores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import similarity as S, text as T
from ..operators import blocking as B, decide as D, evaluate as E, features as X, models as M, profile as P
from ..sources import entities as N, store, views as V
from .sql import NORM

Query = Callable[[SparkSession, str], DataFrame]
CHANNELS = (*B.CHANNELS, *B.MORE_CHANNELS)
GRID = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
#: Trees and folds of the registered models, and bounds on grams of the registered searches.
TREES, FOLDS = 20, 5


def everyone(spark: SparkSession, d: str) -> DataFrame:
    return V.stored(spark, d, "entities", lambda: B.normalize(store.spread(V.document_entities(spark, d))))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = everyone(spark, d)
    return rows.filter(F.col("entity_id").startswith("S1-")), rows.filter(~F.col("entity_id").startswith("S1-"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return V.stored(spark, d, "truth", lambda: V.document_truth(spark, d))


def fresh_top(spark: SparkSession, d: str) -> DataFrame:
    return B.candidates(*sides(spark, d))


def top(spark: SparkSession, d: str) -> DataFrame:
    return V.stored(spark, d, "top", lambda: fresh_top(spark, d))


def attached(spark: SparkSession, d: str) -> DataFrame:
    return V.stored(spark, d, "attached", lambda: store.spread(X.attach(top(spark, d), *sides(spark, d)), "entity_id", "target_id"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    kept = ("entity_id", "target_id", F.col("q_country").alias("country"), "max_prio", "n_channels", X.simple_score().alias("p"))
    return V.stored(spark, d, "scored", lambda: attached(spark, d).select(*kept))


def links(spark: SparkSession, d: str) -> DataFrame:
    return D.flat(scored(spark, d), 0.6).select("entity_id", "target_id", "p")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return E.per_entity(sides(spark, d)[0], truth(spark, d), links(spark, d))


def sure(spark: SparkSession, d: str) -> DataFrame:
    return D.bypass(*sides(spark, d))


def _per_pair(**columns: Callable[[], Column]) -> Query:
    return lambda s, d: attached(s, d).select("entity_id", "target_id", *[F.round(c().cast("double"), 6).alias(n) for n, c in columns.items()])


def _set(columns: Callable[[], dict[str, Column]]) -> Query:
    return lambda s, d: attached(s, d).select("entity_id", "target_id", *[F.round(c, 6).alias(n) for n, c in columns().items()])


def _kept(rule: Callable[[], Column]) -> Query:
    return lambda s, d: attached(s, d).filter(rule()).select("entity_id", "target_id")


def _decided(rule: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: rule(scored(s, d)).select("entity_id", "target_id", "p")


def _with_sure(rule: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda s, d: rule(scored(s, d).select("entity_id", "target_id", "p"), sure(s, d)).select("entity_id", "target_id", "p")


def _n() -> tuple[Column, Column]:
    return F.col("q_clean_name"), F.col("t_clean_name")


def _a() -> tuple[Column, Column]:
    return F.col("q_std_address"), F.col("t_std_address")


def _jw() -> Column:
    return S.jaro_winkler(*_n())


def _shared(k: str) -> Column:
    q, t = (F.array_distinct(T.words(F.col(f"{s}_{k}"))) for s in "qt")
    return F.size(F.array_intersect(q, t))


def _long_overlap() -> Column:
    q, t = (F.size(F.array_distinct(T.words(F.col(f"{s}_sorted_addr")))) for s in "qt")
    return (q >= 3) & (t >= 3) & (S.overlap(F.col("q_sorted_addr"), F.col("t_sorted_addr")) >= 0.8)


def _heuristic() -> Column:
    f = X.native()
    return X.heuristic(_jw(), f["name_tok_jac"], f["pin_match"], f["pin_contradiction"], f["hno_contradiction"])


def _norm_queries() -> dict[str, Query]:
    some: dict[str, Callable[[], dict[str, Column]]] = {
        "norm_unaccented": lambda: {"v": T.unaccented("clean_name")},
        "norm_ascii_folded": lambda: {"v": T.ascii_folded("clean_name")},
        "norm_accents": lambda: {"v": T.fold_accents(F.col("business_name"))},
        "norm_numeric_tokens": lambda: {"v": T.numeric_tokens(F.col("business_address"))},
        "norm_core_tokens": lambda: {"v": T.core_tokens(F.col("business_name"))},
        "norm_street_words": lambda: {"words": T.street_words(F.col("std_address")), "digits": T.street_words(F.col("std_address"), True)},
        "norm_latin_long_vowels": lambda: {"v": T.transliterate(F.col("clean_name"), True)},
        "norm_extended_suffixes": lambda: {"v": T.without_words(F.col("clean_name"), T.MORE_SUFFIXES)},
        "norm_postal_of_std": lambda: {"v": T.postal_code(F.col("business_address"), F.col("country"), "std")},
    }
    out = {f"norm_{k}": lambda s, d, k=k: everyone(s, d).select("entity_id", k) for k in NORM}
    out |= {n: lambda s, d, c=c: everyone(s, d).select("entity_id", *[v.alias(k) for k, v in c().items()]) for n, c in some.items()}
    out["norm_domains"] = lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.without_domains(F.col("url")).alias("v"))
    return out


def _channel(name: str) -> B.Channel:
    return next(c for c in CHANNELS if c.name == name)


def _entities(s: SparkSession, d: str) -> DataFrame:
    return everyone(s, d).select("entity_id", "business_name", "business_address", "country")


def _blocking_queries() -> dict[str, Query]:
    each = lambda s, d, channels: [B.pairs(*sides(s, d), c) for c in channels]
    return {f"ch_{c.name}": lambda s, d, c=c: B.pairs(*sides(s, d), c) for c in CHANNELS} | {
        "pool_candidates": lambda s, d: B.pool(each(s, d, B.CHANNELS)),
        "topk_candidates": fresh_top,
        "candidates_13_channels": lambda s, d: B.candidates(*sides(s, d), CHANNELS, 80),
        "pool_of_pools": lambda s, d: B.pool_pools([B.pool(each(s, d, c)) for c in (B.CHANNELS, B.MORE_CHANNELS)]),
        "three_pass": lambda s, d: B.three_pass(*sides(s, d)),
        "union_distinct": lambda s, d: B.pairs(*sides(s, d), B.CHANNELS[1]).union(B.pairs(*sides(s, d), _channel("prefix2"))).select("entity_id", "target_id").distinct(),
        "pair_space": lambda s, d: B.pair_space(*sides(s, d)),
        "candidate_lists": lambda s, d: N.lists(sides(s, d)[0], top(s, d)),
        "rare_bigrams": lambda s, d: B.rare_keys(sides(s, d)[1], _channel("rare_bigram")),
        "rare_brands": lambda s, d: B.rare_keys(sides(s, d)[1], _channel("rare_brand")),
        "missed_anti": lambda s, d: truth(s, d).join(top(s, d), ["entity_id", "target_id"], "left_anti"),
        "label_pairs": _labels,
        "token_index": lambda s, d: B.token_index(*sides(s, d)),
        "reduction_ratio": lambda s, d: E.reduction(*sides(s, d), top(s, d)),
        "head_entities": lambda s, d: _entities(s, d).orderBy("entity_id").limit(50),
        "slice_entities": lambda s, d: _entities(s, d).select("entity_id", "country").orderBy("entity_id").offset(200).limit(100),
        "tfidf_topk": lambda s, d: B.tfidf(*sides(s, d)),
        "tfidf_anywhere": lambda s, d: B.tfidf(*sides(s, d), by_country=False, max_df=0.03, min_df=3, max_features=150_000),
        "tfidf_recovery": _recovery,
    }


def _labels(s: SparkSession, d: str, *more: str) -> DataFrame:
    marked = top(s, d).join(truth(s, d).withColumn("t", F.lit(1)), ["entity_id", "target_id"], "left")
    return marked.select("entity_id", "target_id", *more, F.when(F.col("t") == 1, 1).otherwise(0).alias("label"))


def _recovery(s: SparkSession, d: str) -> DataFrame:
    """The stored index of grams, asked for queries with fewer than 20 candidates."""
    q, t = sides(s, d)
    index = B.gram_index(t, min_df=5, max_features=50_000)
    kept = B.Grams(V.stored(s, d, "idf", lambda: index.idf), V.stored(s, d, "names", lambda: index.names))
    return B.recovered(q, top(s, d), kept)


def _feature_queries() -> dict[str, Query]:
    f = X.native
    return {
        "ngram_jaccard": _per_pair(c2=lambda: S.gram_jaccard(*_n(), 2), c3=lambda: S.gram_jaccard(*_n(), 3), c4=lambda: S.gram_jaccard(*_n(), 4)),
        "token_jaccard": _per_pair(name_tok_jac=lambda: S.word_jaccard(*_n()), addr_tok_jac=lambda: S.word_jaccard(*_a())),
        "overlap_coef": _per_pair(ovlp=lambda: S.overlap(*_n())),
        "jaccard_options": _per_pair(
            empty_is_one=lambda: S.gram_jaccard(F.col("q_first_word"), F.col("t_first_word"), 9, both_empty=1.0),
            whole=lambda: S.gram_jaccard(F.col("q_first_word"), F.col("t_first_word"), 9, whole=True),
        ),
        "contradictions": lambda s, d: attached(s, d).select("entity_id", "target_id", f()["pin_contradiction"].cast("int").alias("pin"), f()["hno_contradiction"].cast("int").alias("hno")),
        "prefix_length_feats": _per_pair(p3=lambda: S.same_prefix(*_n(), 3), p5=lambda: S.same_prefix(*_n(), 5), diff=lambda: f()["name_len_diff"], ratio=lambda: S.length_ratio(*_n())),
        "features_44_native": _set(X.native),
        "features_first_native": _set(X.first_native),
        "features_second_native": _set(X.second_native),
        "features_boosted_native": _set(X.boosted_native),
        "features_44": lambda s, d: X.features(top(s, d), *sides(s, d)),
        "features_first": lambda s, d: X.features_first(top(s, d), *sides(s, d)),
        "features_second": lambda s, d: X.features_second(top(s, d), *sides(s, d)),
        "features_targeted": lambda s, d: X.features_targeted(top(s, d), *sides(s, d)),
        "levenshtein_pairs": lambda s, d: attached(s, d).select("entity_id", "target_id", F.levenshtein(*_n()).alias("d")),
        "jaro_winkler_pairs": _per_pair(jw=_jw),
        "alignment_ratios": lambda s, d: X.measured(attached(s, d), {"name": ("ratio", "token_sort", "token_set", "partial")}).select("entity_id", "target_id", "m.*"),
        "heuristic_score": _per_pair(score=_heuristic),
        "rank_score": _per_pair(score=lambda: X.rank_score(_jw())),
        "sigmoid_scores": _per_pair(p=lambda: S.sigmoid(F.col("max_prio") + 0.15 * (F.col("n_channels") - 1) - 1)),
        "address_overlap_pairs": _kept(_long_overlap),
        "shared_tokens_pairs": lambda s, d: attached(s, d).select("entity_id", "target_id", _shared("sorted_addr").alias("address_words"), _shared("clean_name").alias("name_words")).filter("address_words >= 2 OR name_words >= 1"),
        "spaceless_containment": _kept(lambda: f()["spaceless_subset"] == 1),
        "candidate_places": lambda s, d: X.in_query(scored(s, d), "p").select("entity_id", "target_id", "candidate_rank", "n_candidates"),
        "score_correlation": lambda s, d: scored(s, d).agg(F.round(F.corr("p", "max_prio"), 6).alias("p_prio"), F.round(F.corr("p", "n_channels"), 6).alias("p_channels")),
    }


def _decision_queries() -> dict[str, Query]:
    three = ["entity_id", "target_id", "p"]
    plain = lambda x: x.select(three)
    blended = lambda x: x.select("entity_id", "target_id", F.round(M.blend(0.5, "p", "max_prio"), 6).alias("p"))
    return {
        "flat_threshold": _decided(lambda x: D.flat(x, 0.6)),
        "threshold_by_country": _decided(lambda x: D.by_label(x, F.col("country"), {"US": 0.6, "France": 0.5}, 0.55)),
        "threshold_by_source": _decided(lambda x: D.by_label(x, D.source(), {"S2": 0.6}, 0.5)),
        "margin_gate": _decided(lambda x: D.margin_gate(x, 0.7, 0.3, 0.1)),
        "margin_gate_capped": _decided(lambda x: D.margin_gate_capped(x, 0.7, 0.3, 0.1, 1)),
        "cap_per_source": _decided(lambda x: D.cap_per_source(x, 0.4, 2)),
        "one_per_source": _decided(lambda x: D.cap_per_source(x, 0.4, 1)),
        "source_thresholds_capped": _decided(lambda x: D.capped_by_label(x, {"S2": 0.45}, 0.35, 2)),
        "fallback": _decided(lambda x: D.with_fallback(x, 0.65, 3, 0.3, 0.08)),
        "bypass_or_fallback": _with_sure(lambda x, y: D.bypass_or_fallback(x, y, 0.55, 0.3, 0.1)),
        "without_bypass": _with_sure(lambda x, y: D.without_bypass(x.unionByName(y), 0.6, 3, 0.3, 0.1)),
        "specific_bypass": lambda s, d: D.specific(sure(s, d), 5).select(three),
        "boost_with_bypass": _with_sure(lambda x, y: D.boost_with_bypass(D.flat(x, 0.7), x, y, 0.5, 5)),
        "rethreshold": _with_sure(lambda x, y: D.rethreshold(x.unionByName(y), 0.35, 6, 3)),
        "relaxed_third": _decided(lambda x: D.relaxed_third(x, 0.5, 0.6, 0.3)),
        "tiered": _decided(lambda x: D.tiered(x, 0.45, 0.55, 6)),
        "cross_source": _decided(lambda x: D.cross_source(x, 0.5, 0.68, 6)),
        "relative_ratio": _decided(lambda x: D.relative(x, 0.35, 0.7, 0.4)),
        "exclusive_global": _decided(lambda x: D.exclusive_global(D.flat(x, 0.4))),
        "exclusive_locked": _decided(lambda x: D.exclusive_tiered(D.flat(x, 0.8), D.flat(x, 0.4))),
        "singleton_boost": _decided(lambda x: D.boost_singletons(D.flat(x, 0.6), D.flat(x, 0.4))),
        "extend_single": _decided(lambda x: D.extend_single(plain(D.flat(x, 0.6)), x, 0.3)),
        "prune": _decided(lambda x: D.prune(plain(D.flat(x, 0.4)), blended(x), 0.7, 0.9)),
        "bypass": sure,
    }


def _found(s: SparkSession, d: str) -> DataFrame:
    return truth(s, d).join(top(s, d).select("entity_id", "target_id"), ["entity_id", "target_id"], "left_semi")


def _oracle(s: SparkSession, d: str) -> DataFrame:
    rows = E.per_entity(sides(s, d)[0], truth(s, d), _found(s, d))
    exact = E.f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return rows.agg(F.round(F.avg(exact), 6).alias("oracle_f05"), F.count_if((F.col("n_true") > 0) & (F.col("tp") == 0)).alias("blackouts"))


def _link_counts(s: SparkSession, d: str) -> DataFrame:
    n = truth(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return sides(s, d)[0].select("entity_id", "country").join(n, "entity_id", "left").fillna(0, ["n"])


def _volumes(s: SparkSession, d: str) -> DataFrame:
    n = top(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return sides(s, d)[0].select("entity_id").join(n, "entity_id", "left").fillna(0, ["n"])


def _overlap(s: SparkSession, d: str) -> DataFrame:
    q, t = (x.withColumn("number", F.substring("entity_id", 4, 20)) for x in sides(s, d))
    keys = (("names", ("sorted_name", "country")), ("tuples", ("sorted_name", "std_address", "country")), ("ids", ("number",)))
    out = t.agg(F.count(F.lit(1)).alias("rows"))
    for n, k in keys:
        out = out.crossJoin(t.join(q.select(*k).distinct(), list(k), "left_semi").agg(F.count(F.lit(1)).alias(n)))
    return out


def _linked(*columns: str) -> Query:
    return lambda s, d: P.linked(truth(s, d), *sides(s, d), *columns)


def _of(profile: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda s, d: profile(_linked(*columns)(s, d))


def _ladder(s: SparkSession, d: str) -> DataFrame:
    missed = truth(s, d).join(top(s, d), ["entity_id", "target_id"], "left_anti")
    return E.ladder(X.measured(X.attach(missed, *sides(s, d)), {"name": ("jw", "token_sort", "token_set", "partial")}))


def _strata(s: SparkSession, d: str) -> DataFrame:
    rows = _link_counts(s, d).select("entity_id", "country", E.match_bin(F.col("n")).alias("match_bin"))
    return M.stratified(rows, ["country", "match_bin"], 20)


def _auc(s: SparkSession, d: str) -> DataFrame:
    marked = scored(s, d).join(truth(s, d).withColumn("t", F.lit(1)), ["entity_id", "target_id"], "left")
    return E.auc_ap(marked.select("p", F.when(F.col("t") == 1, 1).otherwise(0).alias("label")))


def _findings(s: SparkSession, d: str) -> DataFrame:
    """Findings on a result with faults of several kinds put in."""
    q, t = sides(s, d)
    known = q.filter(~(F.floor(F.substring("entity_id", 4, 20).cast("long") / 3) % 10).isin(3, 4))
    faults = s.createDataFrame([("S1-999999999", "S2-999999999,X-1")], "source1_entity_id string, matched_entity_ids string")
    result = N.lists(known, links(s, d)).unionByName(faults)
    return E.findings(q, result, top(s, d), t)


def _folder(s: SparkSession) -> str:
    import uuid

    return f"{store.shared_folder(s)}/{uuid.uuid4().hex}"


def _entities_again(s: SparkSession, d: str) -> DataFrame:
    """Entities written as a tab-separated file and read again."""
    path = _folder(s)
    _entities(s, d).write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return N.read_entities(s, path)


def _links_again(s: SparkSession, d: str) -> DataFrame:
    """Links written as lists of ids and scores, and read again."""
    path = _folder(s)
    N.write_probabilities(links(s, d), path)
    return N.read_probabilities(s, path)


def _shards_again(s: SparkSession, d: str) -> DataFrame:
    """Links written in shards, of which the second call finds all whole, and read again."""
    path = _folder(s)
    rows = D.flat(scored(s, d), 0.4).select("entity_id", "target_id", "p")
    N.write_shards(rows, path, 4)
    if N.write_shards(rows, path, 4):
        raise ValueError("whole shards were written again")
    return N.read_shards(s, path)


def _fold_deviation(s: SparkSession, d: str) -> DataFrame:
    by = scores(s, d).groupBy(M.fold(5).alias("fold")).agg(F.avg("f05").alias("f"))
    return by.agg(F.round(F.avg("f"), 6).alias("mean"), F.round(F.stddev_pop("f"), 6).alias("deviation"))


def _report_queries() -> dict[str, Query]:
    q = lambda s, d: sides(s, d)[0]
    raw = ("business_name", "business_address", "country")
    parts = lambda s, d: V.part_entities(s, d).withColumnRenamed("business_name", "name")
    return {
        "per_entity_f05": scores,
        "macro_f05": lambda s, d: E.macro(scores(s, d)),
        "worst_entities": lambda s, d: scores(s, d).select("entity_id", "f05").orderBy("f05", "entity_id").limit(20),
        "slices_grouping_sets": lambda s, d: E.slices(scores(s, d)),
        "fold_deviation": _fold_deviation,
        "link_report": lambda s, d: E.link_report(truth(s, d), links(s, d)),
        "theta_grid": lambda s, d: E.theta_grid(q(s, d), truth(s, d), scored(s, d), GRID),
        "blend_grid": lambda s, d: M.mixture_grid(q(s, d), truth(s, d), scored(s, d), ["p", "max_prio"], 10, GRID),
        "blocking_report": lambda s, d: E.blocking_report(q(s, d), truth(s, d), top(s, d)),
        "volume_percentiles": lambda s, d: E.volume(q(s, d), top(s, d)),
        "volume_of_singletons": lambda s, d: E.alone_volume(q(s, d), truth(s, d), top(s, d)),
        "volume_quantiles_truncated": lambda s, d: P.ordered_quantiles(_volumes(s, d), "n", [0.25, 0.5, 0.9, 0.99]),
        "volume_quantiles_nearest": lambda s, d: P.ordered_quantiles(_volumes(s, d), "n", [0.25, 0.5, 0.95], nearest=True),
        "coverage": lambda s, d: E.coverage(q(s, d), truth(s, d), top(s, d)),
        "error_decomposition": lambda s, d: E.decomposition(q(s, d), truth(s, d), top(s, d), links(s, d)),
        "missed_ladder": _ladder,
        "collision_profile": lambda s, d: E.collisions(everyone(s, d), "sorted_name"),
        "part_collisions": lambda s, d: E.collisions(parts(s, d), "name"),
        "most_common_names": lambda s, d: P.most_common(parts(s, d), "name", 10),
        "match_histogram": lambda s, d: _link_counts(s, d).groupBy("n").agg(F.count(F.lit(1)).alias("entities")),
        "source_breakdown": lambda s, d: P.source_breakdown(q(s, d), truth(s, d)),
        "joint_counts": lambda s, d: P.joint_counts(q(s, d), truth(s, d)),
        "truth_profile": lambda s, d: P.truth_profile(*sides(s, d), truth(s, d)),
        "match_statistics": _of(P.match_statistics, *raw),
        "token_changes": _of(P.token_changes, "clean_name"),
        "corruption_profile": _of(P.corruption, "clean_name"),
        "postal_agreement": _of(P.postal_agreement, "country", "postal_code"),
        "sibling_pairs": lambda s, d: P.sibling_pairs(truth(s, d)),
        "name_precision": lambda s, d: P.name_precision(B.pairs(*sides(s, d), B.CHANNELS[1]), truth(s, d)),
        "script_profile": lambda s, d: P.scripts(everyone(s, d)),
        "phonetic_collisions": lambda s, d: P.phonetic_collisions(everyone(s, d)),
        "overlap_audit": _overlap,
        "stratified_sample": _strata,
        "query_split": lambda s, d: M.split(q(s, d))[0].agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n")).unionAll(M.split(q(s, d))[1].agg(F.lit("rest"), F.count(F.lit(1)))),
        "fraction_sample": lambda s, d: M.sampled(q(s, d), 0.25).select("entity_id"),
        "schema_contract": lambda s, d: E.contract(V.document_entities(s, d), "S1-"),
        "validator_findings": _findings,
        "auc_ap": _auc,
        "oracle_at_k": _oracle,
        "round_trip_entities": _entities_again,
        "round_trip_links": _links_again,
        "round_trip_shards": _shards_again,
    }


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The 44 features of all candidates, with labels, stored together: models read them many times, and join nothing."""
    return V.stored(spark, d, "labelled", lambda: X.features(_labels(spark, d, "max_prio", "n_channels"), *sides(spark, d)))


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("entity_id", "target_id", "label", "weight")]


def _fitted(make: Callable[[list[str], DataFrame], object]) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        rows = labelled(s, d)
        return M.score(make(feature_names(rows), rows).fit(rows), rows).select("entity_id", "target_id", "label", "p")

    return query


def _weighted(s: SparkSession, d: str) -> DataFrame:
    rows = M.weights(M.negatives(labelled(s, d)))
    model = M.logistic(feature_names(rows), rows.count(), weight="weight")
    return M.score(model.fit(rows), rows).select("entity_id", "target_id", "label", "weight", "p")


def _ranker(s: SparkSession, d: str) -> DataFrame:
    """A pairwise ranker on differences of a query's pairs; its margin is a score by the sigmoid."""
    rows = labelled(s, d)
    names = feature_names(rows)
    pairs = M.both_ways(store.written(M.ranked_pairs(rows, names)), names)
    return M.score(M.logistic(names, pairs.count()).fit(pairs), rows).select("entity_id", "target_id", "label", "p")


def _stacked(s: SparkSession, d: str) -> DataFrame:
    """Two models' scores by folds, and a model of them. All read narrow stored rows: a pair's features as one array, its fold."""
    rows = labelled(s, d)
    names = feature_names(rows)
    rows = store.written(rows.select("entity_id", "target_id", "label", M.fold(FOLDS).alias("fold"), F.array(*[F.col(c).cast("double") for c in names]).alias("x")))
    n = rows.count()
    lines = M.logistic_without(rows, list(range(FOLDS)), n)
    vectors = rows.withColumn("v", array_to_vector("x"))
    trees = M.side_by_side(M.boosted(["v"], TREES), [vectors.filter(F.col("fold") != k) for k in range(FOLDS)])
    scored = [M.score(m, vectors.filter(F.col("fold") == k), "p_gbt") for k, m in enumerate(trees)]
    two = F.array(M.logistic_score(lines, F.col("fold")), F.col("p_gbt"))
    both = store.written(reduce(DataFrame.unionByName, scored).select("entity_id", "target_id", "label", F.lit(-1).alias("fold"), two.alias("x")))
    last = M.logistic_without(both, [0], n)
    return both.select("entity_id", "target_id", "label", M.logistic_score(last, F.lit(0)).alias("p"))


def _importances(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d)
    names = feature_names(rows)
    model = M.boosted(names, TREES).fit(rows)
    path = _folder(s)
    M.save(model, path)
    return s.createDataFrame(sorted(M.importances(M.load(path), names).items()), "feature string, importance double")


def _model_queries() -> dict[str, Query]:
    return {
        "logreg_scores": _fitted(lambda names, rows: M.logistic(names, rows.count())),
        "gbt_scores": _fitted(lambda names, rows: M.boosted(names, TREES)),
        "weighted_scores": _weighted,
        "ranker_scores": _ranker,
        "stacked_scores": _stacked,
        "feature_importances": _importances,
    }


def queries() -> dict[str, Query]:
    return _norm_queries() | _blocking_queries() | _feature_queries() | _decision_queries() | _report_queries() | _model_queries()
