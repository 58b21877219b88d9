"""Pairwise features: projections of native expressions, and one Arrow UDF for alignment measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as S, text as T
from ..sources.store import spread

KEYS = ("clean_name", "stripped_name", "sorted_name", "spaceless_name", "std_address", "sorted_addr", "postal_code", "house_no", "first_word", "country")
#: Measures of names, addresses and sorted names that the feature sets use.
MEASURES = {"name": ("jw", "token_sort", "token_set", "partial"), "addr": ("jw", "token_sort", "token_set"), "sorted": ("token_sort",)}


def attach(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both sides' keys as q_* and t_*."""
    q = queries.select("entity_id", *[F.col(k).alias(f"q_{k}") for k in KEYS])
    t = targets.select(F.col("entity_id").alias("target_id"), *[F.col(k).alias(f"t_{k}") for k in KEYS])
    return pairs.join(q, "entity_id").join(t, "target_id")


def _same(k: str) -> Column:
    return ((F.col(f"q_{k}") == F.col(f"t_{k}")) & (F.col(f"q_{k}") != "")).cast("double")


def _differ(k: str) -> Column:
    q, t = F.col(f"q_{k}"), F.col(f"t_{k}")
    return ((q != t) & (q != "") & (t != "")).cast("double")


def _count(c: Column) -> Column:
    return F.size(T.words(c))


def _ratio(a: Column, b: Column, none: float) -> Column:
    return F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), F.lit(none))


def _names() -> tuple[Column, Column]:
    return F.col("q_clean_name"), F.col("t_clean_name")


def _addresses() -> tuple[Column, Column]:
    return F.col("q_std_address"), F.col("t_std_address")


def _spaceless_subset() -> Column:
    q, t = F.col("q_spaceless_name"), F.col("t_spaceless_name")
    return ((q != "") & (t != "") & (F.contains(q, t) | F.contains(t, q))).cast("double")


def native() -> dict[str, Column]:
    """Features of the set of 44 that need no alignment."""
    (n, m), (a, b) = _names(), _addresses()
    country, codes = F.lower("q_country"), (F.col("q_postal_code"), F.col("t_postal_code"))
    return {
        "exact_clean_name": _same("clean_name"),
        "exact_sorted_name": _same("sorted_name"),
        "exact_stripped_name": _same("stripped_name"),
        "exact_spaceless": _same("spaceless_name"),
        "spaceless_subset": _spaceless_subset(),
        "exact_clean_addr": _same("std_address"),
        "exact_sorted_addr": _same("sorted_addr"),
        "hno_match": _same("house_no"),
        "pin_match": _same("postal_code"),
        "fw_match": _same("first_word"),
        "name_char2_jac": S.gram_jaccard(n, m, 2),
        "name_char3_jac": S.gram_jaccard(n, m, 3),
        "name_char4_jac": S.gram_jaccard(n, m, 4),
        "name_tok_jac": S.word_jaccard(n, m),
        "name_tok_ovlp": S.overlap(n, m),
        "addr_char3_jac": S.gram_jaccard(a, b, 3),
        "addr_tok_jac": S.word_jaccard(a, b),
        "addr_null_tgt": (b == "").cast("double"),
        "name_len_diff": F.abs(F.length(n) - F.length(m)).cast("double"),
        "name_len_ratio": S.length_ratio(n, m),
        "addr_len_diff": F.abs(F.length(a) - F.length(b)).cast("double"),
        "name_wc_diff": F.abs(_count(n) - _count(m)).cast("double"),
        "name_wc_ratio": _ratio(_count(n), _count(m), 1.0),
        "name_prefix3": S.same_prefix(n, m, 3),
        "name_prefix5": S.same_prefix(n, m, 5),
        "hno_contradiction": _differ("house_no"),
        "pin_contradiction": _differ("postal_code"),
        "pin_prefix3": S.same_prefix(*codes, 3),
        "pin_both_present": ((codes[0] != "") & (codes[1] != "")).cast("double"),
        "is_source3": F.col("target_id").startswith("S3").cast("double"),
        "india_flag": country.like("%india%").cast("double"),
        "france_flag": country.isin("france", "fr").cast("double"),
    }


def measured(rows: DataFrame, wanted: dict[str, tuple[str, ...]] = MEASURES) -> DataFrame:
    """Attached pairs with a column ``m`` of alignment measures, such as m.name_jw: one call for all of them."""
    keys = {"name": "clean_name", "addr": "std_address", "sorted": "sorted_name"}
    columns = [F.col(f"{side}_{keys[k]}") for k in wanted for side in "qt"]
    rows = spread(rows, "entity_id", "target_id")
    return rows.withColumn("m", S.aligned(wanted)(*columns))


def _bare(rows: DataFrame) -> DataFrame:
    return rows.drop("m", *[f"{s}_{k}" for s in "qt" for k in KEYS])


def features(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The set of 44 features of candidate pairs (with max_prio, n_channels)."""
    rows = measured(attach(pairs, queries, targets)).withColumns(native())
    rows = rows.withColumns({
        "name_jw": F.col("m.name_jw"),
        "name_tok_sort": F.col("m.name_token_sort"),
        "name_tok_set": F.col("m.name_token_set"),
        "name_partial": F.col("m.name_partial"),
        "addr_jw": F.col("m.addr_jw"),
        "addr_tok_sort": F.col("m.addr_token_sort"),
        "addr_tok_set": F.col("m.addr_token_set"),
    })
    rows = rows.withColumns({
        "name_x_addr": F.col("name_jw") * F.col("addr_tok_sort"),
        "name_x_pin": F.col("name_jw") * F.col("pin_match"),
        "sorted_x_addr": F.col("m.sorted_token_sort") * F.col("addr_tok_sort"),
    })
    return _bare(rows)


def first_native() -> dict[str, Column]:
    """Features of the first set (of 24) that need no alignment."""
    a, b = _addresses()
    x, y = (F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"))) for c in (a, b))
    p, q = (F.coalesce(F.get(F.regexp_extract_all(c, F.lit("([0-9]+)")), F.lit(0)), F.lit("")) for c in (a, b))
    both, address = (p != "") & (q != ""), (a != "") & (b != "")
    n, m = _names()
    ratio = F.when((F.length(n) == 0) & (F.length(m) == 0), 0.0).otherwise(S.length_ratio(n, m))
    return {
        "exact_clean_name": _same("clean_name"),
        "exact_stripped_name": _same("stripped_name"),
        "exact_sorted_name": _same("sorted_name"),
        "name_len_diff": F.abs(F.length(n) - F.length(m)).cast("double"),
        "name_len_ratio": ratio,
        "exact_clean_address": _same("std_address"),
        "addr_is_null_target": (b == "").cast("double"),
        "addr_token_jaccard": F.when(address, S.word_jaccard(a, b)).otherwise(0.0),
        "addr_token_overlap": F.when(address, S.overlap(a, b)).otherwise(0.0),
        "numeric_token_jaccard": F.when(both, S.jaccard(x, y)).otherwise(0.0),
        "house_number_match": (both & (p == q)).cast("double"),
        "contradiction_house_no": (both & (p != q)).cast("double"),
        "postal_code_match": _same("postal_code"),
        "postal_both_present": ((F.col("q_postal_code") != "") & (F.col("t_postal_code") != "")).cast("double"),
        "contradiction_postal": _differ("postal_code"),
        "is_source3": F.col("target_id").startswith("S3-").cast("double"),
    }


def _first(rows: DataFrame) -> DataFrame:
    n, m = _names()
    a, b = _addresses()
    equal = lambda c: F.when(n == m, 1.0).otherwise(F.col(c))
    jw = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.col("m.addr_jw"))
    rows = rows.withColumns(first_native()).withColumns({
        "name_jaro_winkler": equal("m.name_jw"),
        "name_token_sort": equal("m.name_token_sort"),
        "name_token_set": equal("m.name_token_set"),
        "addr_jaro_winkler": jw,
        "channel_max_priority": F.col("max_prio"),
        "channel_count": F.col("n_channels").cast("double"),
    })
    return rows.withColumns({"name_x_addr": F.col("name_jaro_winkler") * F.col("addr_token_jaccard"), "name_x_postal": F.col("name_jaro_winkler") * F.col("postal_code_match")})


def features_first(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The first set of features: 24 with the two of the pool."""
    wanted = {"name": ("jw", "token_sort", "token_set"), "addr": ("jw",)}
    return _bare(_first(measured(attach(pairs, queries, targets), wanted)).drop("max_prio", "n_channels"))


def second_native() -> dict[str, Column]:
    """What the second set adds, as far as it needs no alignment and no other pairs."""
    (n, m), (a, b) = _names(), _addresses()
    lone = lambda c: F.coalesce(F.try_divide(F.size(F.filter(T.words(c), lambda w: F.length(w) == 1)), _count(c)), F.lit(0.0))
    digits = F.length(b) - F.length(F.regexp_replace(b, "[0-9]", ""))
    return {
        "name_char2_jaccard": S.gram_jaccard(n, m, 2),
        "name_char3_jaccard": S.gram_jaccard(n, m, 3),
        "name_prefix3_match": S.same_prefix(n, m, 3),
        "name_prefix5_match": S.same_prefix(n, m, 5),
        "name_abbrev_ratio_q": lone(n),
        "name_abbrev_ratio_t": lone(m),
        "name_word_count_diff": F.abs(_count(n) - _count(m)).cast("double"),
        "name_word_count_ratio": _ratio(_count(n), _count(m), 1.0),
        "addr_char3_jaccard": S.gram_jaccard(a, b, 3),
        "addr_word_count_diff": F.abs(_count(a) - _count(b)).cast("double"),
        "addr_numeric_density_t": F.coalesce(F.try_divide(digits, F.length(b)), F.lit(0.0)),
        "city_token_overlap": S.city_jaccard(a, b),
        "pincode_prefix_match": S.same_prefix(F.col("q_postal_code"), F.col("t_postal_code"), 3),
        "india_flag": F.lower("q_country").like("%india%").cast("double"),
    }


def in_query(rows: DataFrame, score: str) -> DataFrame:
    """The place of each pair among its query's, ties by target id, and how many there are."""
    by = Window.partitionBy("entity_id")
    place = F.row_number().over(by.orderBy(F.desc(score), "target_id"))
    return rows.withColumns({"candidate_rank": place.cast("double"), "n_candidates": F.count(F.lit(1)).over(by).cast("double")})


def features_second(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The second set: the first one and 17 more."""
    wanted = {"name": ("jw", "token_sort", "token_set"), "addr": ("jw",)}
    rows = _first(measured(attach(pairs, queries, targets), wanted)).withColumns(second_native())
    rows = rows.withColumn("name_x_addr_x_postal", F.col("name_x_addr") * F.col("postal_code_match"))
    return _bare(in_query(rows, "name_x_addr").drop("max_prio", "n_channels"))


def targeted() -> dict[str, Column]:
    """Four features for pairs without an address, of a table that has the first set."""
    none = F.col("addr_is_null_target")
    return {"name_only_score": F.col("name_token_set") * none, "addr_available_score": F.col("name_x_addr") * (1 - none)}


def boosted_native() -> dict[str, Column]:
    """House numbers, streets, digits, initials and bigrams of a pair."""
    (n, m), (a, b) = _names(), _addresses()
    digit = lambda w: w.rlike("^[0-9]+$")
    streets = S.jaccard(*(F.array_distinct(F.filter(T.words(c), lambda w: ~digit(w))) for c in (a, b)), 1.0)
    numbers = S.jaccard(*(F.array_distinct(F.filter(T.words(c), digit)) for c in (n, m)), 1.0)
    return {
        "house_number_diff": S.house_distance(a, b),
        "street_token_overlap": streets,
        "name_digit_overlap": numbers,
        "name_initials_match": S.initials_jaccard(n, m),
        "name_bigram_jaccard": S.gram_jaccard(n, m, 2),
        "addr_bigram_jaccard": S.gram_jaccard(a, b, 2),
    }


def features_targeted(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The boosted set: eight features, four of them the targeted ones with their bigrams."""
    wanted = {"name": ("jw", "token_sort", "token_set"), "addr": ("jw",)}
    rows = _first(measured(attach(pairs, queries, targets), wanted))
    (n, m) = _names()
    some = boosted_native() | {"name_char3_jaccard": S.gram_jaccard(n, m, 3)}
    return rows.withColumns(some | targeted()).select("entity_id", "target_id", *some, "name_only_score", "addr_available_score")


def heuristic(jw: Column, jac: Column, pin: Column, pin_differs: Column, house_differs: Column) -> Column:
    return F.col("max_prio") + 0.15 * (F.col("n_channels") - 1) + 0.5 * jw + 0.3 * jac + 0.2 * pin - 0.4 * pin_differs - 0.25 * house_differs


def rank_score(jw: Column) -> Column:
    return F.col("max_prio") + 0.15 * (F.col("n_channels") - 1) + 0.5 * jw


def simple_score() -> Column:
    """A native similarity of attached pairs between 0 and 1, for decisions that need no model."""
    n, m = _names()
    return F.round(0.5 * S.gram_jaccard(n, m, 3) + 0.3 * S.word_jaccard(n, m) + 0.2 * S.word_jaccard(*_addresses()), 6)
