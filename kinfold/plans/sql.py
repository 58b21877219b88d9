"""DuckDB SQL for the registered linkage queries, built from common table expressions."""

from __future__ import annotations

from ..functions import text as T
from ..operators.blocking import CHANNELS, INDIC_ONLY, MORE_CHANNELS, Channel
from ..sources import views as V

B = r"[ \t\n\r]+"
#: Columns of the normalised table that have a query of their own.
NORM = (
    "clean_name", "stripped_name", "sorted_name", "std_address", "sorted_addr", "postal_code", "deleet_name", "sorted_deleet", "spaceless_name", "house_no", "first_word", "brand_token",
    "name_bigram", "addr_p3", "street_prefix", "addr_sig", "adv_name", "prefix2", "unit_p3", "latin_name", "latin_sorted", "name_pair", "addr_pair", "first_word3",
)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{B}', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def join(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, '{by}'), '')"


def plain(x: str) -> str:
    return squeeze(f"regexp_replace(lower(coalesce({x}, '')), '{T.NO_WORD}', ' ', 'g')")


def clean(x: str) -> str:
    return squeeze(f"regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '{T.NO_WORD}', ' ', 'g')")


def spread(x: str) -> str:
    return f"(' ' || replace({x}, ' ', '  ') || ' ')"


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def without(x: str, items) -> str:
    return squeeze(f"regexp_replace({spread(x)}, ' (?:{'|'.join(i.replace(' ', '  ') for i in items)}) ', ' ', 'g')")


def std(x: str) -> str:
    out = spread(plain(x))
    for word, to in T.ABBREVIATIONS:
        out = f"replace({out}, ' {word.replace(' ', '  ')} ', ' {to} ')"
    return join(rf"list_transform({words(squeeze(out))}, lambda w: regexp_replace(w, '^0+([0-9]+)$', '\1'))")


def first(tokens: str, pattern: str) -> str:
    return f"coalesce(list_filter({tokens}, lambda w: regexp_matches(w, '{pattern}'))[1], '')"


def deleet(x: str) -> str:
    for digit, letter in T.LEET:
        for _ in range(2):
            x = rf"regexp_replace({x}, '([a-z]){digit}([a-z])', '\1{letter}\2', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '(^| )0([a-z])', '\1o\2', 'g'), '([a-z])0( |$)', '\1o\2', 'g')"


def advanced(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    for pattern, to in T.ADVANCED:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return join(f"list_filter({words(x)}, lambda w: w NOT IN ({quoted(T.ADVANCED_STOPS)}))", "")


def latin(x: str, long_vowels: bool = False) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.latin(long_vowels).items()) + "}"
    out = x
    for letters, to in () if long_vowels else T.CLUSTERS:
        out = f"replace({out}, '{letters}', '{to}')"
    return join(f"list_transform(string_split({out}, ''), lambda c: coalesce({table}[c], c))", "")


def two_longest(tokens: str, least: int, stops=(), digits: bool = True) -> str:
    rule = f"length(w) >= {least}" + (f" AND w NOT IN ({quoted(stops)})" if stops else "") + ("" if digits else " AND NOT regexp_matches(w, '^[0-9]+$')")
    kept = f"list_filter({tokens}, lambda w: {rule})"
    ranked = f"list_sort(list_transform({kept}, lambda x, i: {{'n': -length(x), 'i': i, 'x': x}}))[1:2]"
    return f"CASE WHEN len({kept}) >= 2 THEN {join(f'list_sort(list_transform({ranked}, lambda s: s.x))')} ELSE '' END"


def _one_of(items, k: str) -> str:
    return f"[{quoted(items)}][({k}) % {len(items)} + 1]"


def _digits(k: int) -> str:
    return f"('0x' || substr(d, {k}, 6))::BIGINT"


ID = "'S' || (doc_id % 3 + 1) || '-' || doc_id"
_COUNTRY = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.COUNTRIES) + " ELSE upper(lang) END"
_W = [f"coalesce(w[{k}], '')" for k in range(8)]
_BRAND = _one_of(V.BRANDS, f"7 * length({_W[1]}) + length({_W[2]})")
_NAME = f"CASE WHEN doc_id % 4 < 3 THEN concat_ws(' ', {_BRAND}, {_W[1]}, {_W[2]}) ELSE concat_ws(' ', {_W[2]}, {_W[1]}, {_BRAND}) END || {_one_of(V.SUFFIXES, 'doc_id')}"

#: The view of entities, their normal forms (m), queries (q), targets (t) and true links.
BASE = rf"""
WITH w0 AS (
  SELECT doc_id, {_COUNTRY} AS country, md5(coalesce(text, '')) AS d, list_transform(list_sort(list_transform(list_distinct(
    {words(f"regexp_replace(lower(coalesce(text, '')), '{V.NO_LETTER}', ' ', 'g')")}), lambda x: {{'n': -length(x), 'x': x}}))[1:12], lambda s: s.x) AS w FROM documents
), w1 AS (
  SELECT *, {_NAME} AS name0, CASE WHEN country = 'India' THEN 100000 + {_digits(7)} % 90000 ELSE 10000 + {_digits(7)} % 9000 END AS postal FROM w0
), w2 AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN replace(name0, 'o', '0') ELSE name0 END AS name1 FROM w1
), e AS (
  SELECT {ID} AS entity_id, CASE WHEN country = 'India' THEN translate(name1, '{V.LATIN}', '{V.DEVANAGARI}') ELSE name1 END AS business_name, country,
    CASE WHEN doc_id % 11 > 0 THEN {_one_of(V.UNITS, "doc_id // 4")} || concat_ws(' ', lpad(({_digits(1)} % 400)::VARCHAR, 4, '0'), {_W[5]}, {_W[6]}, {_one_of(V.STREETS, "doc_id")}) || ', ' || {_W[7]} || ' ' || postal END AS business_address FROM w2
), n1 AS (
  SELECT * REPLACE (trim(coalesce(country, '')) AS country), {clean("business_name")} AS clean_name, {std("business_address")} AS std_address, {words(plain("business_address"))} AS raw_words, {advanced("business_name")} AS adv0 FROM e
), n2 AS (
  SELECT *, {without("clean_name", T.LEGAL_SUFFIXES)} AS stripped_name, {deleet("clean_name")} AS deleet_name, {words("std_address")} AS aw, {words("clean_name")} AS nw,
    CASE WHEN regexp_matches(clean_name, '{T.INDIC_LETTER}') THEN {latin("clean_name")} ELSE clean_name END AS latin_name FROM n1
), n3 AS (SELECT *, {words("stripped_name")} AS sw FROM n2
), n AS (
  SELECT entity_id, business_name, business_address, country, clean_name, stripped_name, std_address, deleet_name, latin_name,
    {join(f"list_sort({words("CASE WHEN stripped_name <> '' THEN stripped_name ELSE clean_name END")})")} AS sorted_name,
    {join(f"list_sort(list_filter(aw, lambda w: length(w) >= 3 AND w NOT IN ({quoted(T.ADDRESS_STOPS)})))")} AS sorted_addr,
    CASE WHEN lower(country) = 'india' THEN {first("raw_words", "^[1-9][0-9]{5}$")} WHEN lower(country) IN ('us', 'usa') THEN {first("raw_words", "^[0-9]{5}$")}
      WHEN lower(country) = 'france' THEN {first("raw_words", "^(0[1-9]|[1-8][0-9]|9[0-8])[0-9]{3}$")} ELSE {first("raw_words", "^[0-9]{5,6}$")} END AS postal_code,
    CASE WHEN length(adv0) >= 4 THEN adv0 ELSE '' END AS adv_name, replace(clean_name, ' ', '') AS spaceless_name, {first("aw", "^[0-9]{1,6}[a-z]?$")} AS house_no, coalesce(nw[1], '') AS first_word,
    CASE WHEN length(sw[1]) >= 4 AND sw[1] NOT IN ({quoted(T.GENERIC_BRANDS)}) THEN sw[1] ELSE '' END AS brand_token, {join("aw[1:3]")} AS addr_p3, {join("aw[2:3]")} AS street_prefix,
    {join(f"{words(without('std_address', ('door no', 'hn', 'h no', 'hno', 'flat no', 'plot no')))}[1:3]")} AS unit_p3,
    {two_longest("aw", 4, T.SIGNATURE_STOPS)} AS addr_sig, {two_longest("nw", 4, (), False)} AS name_pair, {two_longest("aw", 5, T.PAIR_STOPS, False)} AS addr_pair,
    CASE WHEN len(list_filter(sw, lambda w: length(w) >= 3)) >= 2 THEN {join("list_sort(list_filter(sw, lambda w: length(w) >= 3)[1:2])")} ELSE '' END AS name_bigram,
    coalesce(list_filter(nw, lambda w: length(w) >= 3)[1], '') AS first_word3,
    {join(f"list_sort({words(without('deleet_name', T.LEGAL_SUFFIXES))})")} AS sorted_deleet, {join(f"list_sort({words(without('latin_name', T.LEGAL_SUFFIXES))})")} AS latin_sorted FROM n3
), m AS MATERIALIZED (SELECT *, {join(f"{words('sorted_name')}[1:2]")} AS prefix2 FROM n),
q AS (SELECT * FROM m WHERE entity_id LIKE 'S1-%'), t AS (SELECT * FROM m WHERE entity_id NOT LIKE 'S1-%'),
held AS (SELECT DISTINCT {ID} AS id, lang, line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= {V.SHARED_LINE}),
truth AS MATERIALIZED (SELECT DISTINCT a.id AS entity_id, b.id AS target_id FROM held a JOIN held b USING (lang, line) WHERE a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%')
"""


def channel(c: Channel) -> str:
    ok = " AND ".join(f"length({{s}}.{k}) >= {n}" for k, n in zip(c.keys, c.least, strict=True))
    ok += f" AND regexp_matches({{s}}.{c.keys[0]}, '{c.pattern}')" if c.pattern else ""
    ok += f" AND regexp_matches({{s}}.clean_name, '{T.INDIC_LETTER}')" if c.name in INDIC_ONLY else ""
    on = " AND ".join(f"q.{k} = t.{k}" for k in c.on)
    keys = ", ".join(c.on)
    rare = f" AND ({', '.join(f't.{k}' for k in c.on)}) IN (SELECT ({keys}) FROM t WHERE {ok.format(s='t')} GROUP BY {keys} HAVING count(*) <= {c.most})" if c.most else ""
    return f"SELECT DISTINCT q.entity_id, t.entity_id AS target_id, {c.prio}::DOUBLE AS prio FROM q JOIN t ON {on} WHERE {ok.format(s='q')} AND {ok.format(s='t')}{rare}"


def pooled(channels=CHANNELS, name: str = "pool") -> str:
    every = " UNION ALL ".join(f"({channel(c)})" for c in channels)
    return f"{name} AS (SELECT entity_id, target_id, max(prio) AS max_prio, count(*)::INTEGER AS n_channels FROM ({every}) GROUP BY ALL)"


def grams(x: str, k: int) -> str:
    return f"(CASE WHEN length({x}) >= {k} THEN list_distinct(list_transform(range(1, length({x}) - {k} + 2), lambda i: substr({x}, i, {k}))) ELSE []::VARCHAR[] END)"


def jaccard(a: str, b: str, empty: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN {empty}::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


def distinct_words(x: str) -> str:
    return f"list_distinct({words(x)})"


def gram_jaccard(a: str, b: str, k: int) -> str:
    return jaccard(grams(a, k), grams(b, k), "0")


def word_jaccard(a: str, b: str, empty: str = "1") -> str:
    return jaccard(distinct_words(a), distinct_words(b), empty)


def overlap(a: str, b: str) -> str:
    x, y = distinct_words(a), distinct_words(b)
    return f"(CASE WHEN least(len({x}), len({y})) = 0 THEN 0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END)"


def prefix(a: str, b: str, k: int) -> str:
    return f"(length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k}))::INTEGER::DOUBLE"


def ratio(a: str, b: str, none: int = 1) -> str:
    return f"(CASE WHEN greatest({a}, {b}) = 0 THEN {none}::DOUBLE ELSE least({a}, {b})::DOUBLE / greatest({a}, {b}) END)"


def same(k: str) -> str:
    return f"(q_{k} = t_{k} AND q_{k} <> '')::INTEGER::DOUBLE"


def differ(k: str) -> str:
    return f"(q_{k} <> t_{k} AND q_{k} <> '' AND t_{k} <> '')::INTEGER::DOUBLE"


#: Letters outside ASCII of the view's names, and unused ASCII characters that stand for them one by one, since the engine's edit distances count bytes.
LETTERS = "éèêëàâäáîïíìôöóòùûüúçñßœæÿ" + V.DEVANAGARI
SINGLES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^`{|}~"[: len(LETTERS)]


def single(x: str) -> str:
    return f"translate({x}, '{LETTERS}', '{SINGLES}')"


KEYS = ("clean_name", "stripped_name", "sorted_name", "spaceless_name", "std_address", "sorted_addr", "postal_code", "house_no", "first_word", "country")
_SIDES = ", ".join(f"{s}.{k} AS {n}_{k}" for s, n in (("a", "q"), ("b", "t")) for k in KEYS)
N, M, A, C = "q_clean_name", "t_clean_name", "q_std_address", "t_std_address"
JW = f"jaro_winkler_similarity({single(N)}, {single(M)})"
TOP = "top AS MATERIALIZED (SELECT entity_id, target_id, max_prio, n_channels FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY max_prio DESC, n_channels DESC, target_id) AS r FROM pool) WHERE r <= 40)"
CANDIDATES = f"{BASE}, {pooled()}, {TOP}"
PAIRS = f"{CANDIDATES}, pairs AS MATERIALIZED (SELECT p.*, {_SIDES} FROM top p JOIN q a ON p.entity_id = a.entity_id JOIN t b ON p.target_id = b.entity_id)"
SIMPLE = f"round(0.5::DOUBLE * {gram_jaccard(N, M, 3)} + 0.3::DOUBLE * {word_jaccard(N, M)} + 0.2::DOUBLE * {word_jaccard(A, C)}, 6)"
SCORED = f"{PAIRS}, s AS MATERIALIZED (SELECT entity_id, target_id, q_country AS country, max_prio, n_channels, {SIMPLE} AS p FROM pairs)"
EXACT = "(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1::DOUBLE WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END)"
F05 = f"round({EXACT}, 6)"


def counted(links: str, name: str) -> str:
    """Counts of each query's links, true links and both."""
    return f"""{name} AS (SELECT q.entity_id, q.country, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM q
  LEFT JOIN (SELECT entity_id, count(*) AS n_pred, count(truth.target_id) AS tp FROM {links} l LEFT JOIN truth USING (entity_id, target_id) GROUP BY entity_id) x USING (entity_id)
  LEFT JOIN (SELECT entity_id, count(*) AS n_true FROM truth GROUP BY entity_id) y USING (entity_id))"""


PER = f"links AS (SELECT entity_id, target_id FROM s WHERE p >= 0.6), {counted('links', 'per')}, sc AS (SELECT *, {F05} AS f05 FROM per)"
BIN = "CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true <= 3 THEN '2-3' WHEN n_true <= 6 THEN '4-6' ELSE '7+' END"
R = "row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, target_id)"
RS = "row_number() OVER (PARTITION BY entity_id, substr(target_id, 1, 2) ORDER BY p DESC, target_id)"
NEXT = "lead(p) OVER (PARTITION BY entity_id ORDER BY p DESC, target_id)"
OUT = "SELECT entity_id, target_id, p FROM"
RANKED = f"(SELECT *, {R} AS r, {RS} AS rs, {NEXT} AS nx, max(p) OVER (PARTITION BY entity_id) AS best FROM s)"
CAP = lambda x, k: f"(SELECT *, {RS} AS rs2 FROM {x}) WHERE rs2 <= {k}"
SURE = "rare AS (SELECT addr_sig FROM t WHERE addr_sig <> '' GROUP BY 1 HAVING count(*) <= 30), sure AS (SELECT DISTINCT q.entity_id, t.entity_id AS target_id, 1::DOUBLE AS p FROM q JOIN t ON q.country = t.country AND q.addr_sig = t.addr_sig WHERE t.addr_sig IN (SELECT addr_sig FROM rare))"
SOURCES = "src AS (SELECT q.entity_id, count(CASE WHEN target_id LIKE 'S2%' THEN 1 END) AS s2, count(CASE WHEN target_id LIKE 'S3%' THEN 1 END) AS s3 FROM q LEFT JOIN truth USING (entity_id) GROUP BY 1)"
LINKED = f"{BASE}, lp AS (SELECT l.entity_id, l.target_id, {', '.join(f'{s}.{k} AS {n}_{k}' for s, n in (('a', 'q'), ('b', 't')) for k in ('business_name', 'business_address', 'country', 'clean_name', 'postal_code'))} FROM truth l JOIN q a ON l.entity_id = a.entity_id JOIN t b ON l.target_id = b.entity_id)"


def digit_words(x: str, digits: bool) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: {'' if digits else 'NOT '}regexp_matches(w, '^[0-9]+$')))"


def city(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: length(w) > 3 AND NOT regexp_matches(w, '^[0-9]+$')))"


def initials(x: str) -> str:
    return f"list_distinct(list_transform({words(x)}, lambda w: left(w, 1)))"


def house(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_matches(w, '^[0-9]+$'))[1]::HUGEINT"


def numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '[0-9]+')"


_BOTH = f"(len({numbers(A)}) > 0 AND len({numbers(C)}) > 0)"
_ADDRESS = f"({A} <> '' AND {C} <> '')"
_NULL_SAFE = lambda x: f"(CASE WHEN len({x(N)}) = 0 OR len({x(M)}) = 0 THEN 0::DOUBLE ELSE {jaccard(x(N), x(M), '0')} END)"
NATIVE = {
    "exact_clean_name": same("clean_name"), "exact_sorted_name": same("sorted_name"), "exact_stripped_name": same("stripped_name"), "exact_spaceless": same("spaceless_name"),
    "spaceless_subset": "(q_spaceless_name <> '' AND t_spaceless_name <> '' AND (contains(q_spaceless_name, t_spaceless_name) OR contains(t_spaceless_name, q_spaceless_name)))::INTEGER::DOUBLE",
    "exact_clean_addr": same("std_address"), "exact_sorted_addr": same("sorted_addr"), "hno_match": same("house_no"), "pin_match": same("postal_code"), "fw_match": same("first_word"),
    "name_char2_jac": gram_jaccard(N, M, 2), "name_char3_jac": gram_jaccard(N, M, 3), "name_char4_jac": gram_jaccard(N, M, 4), "name_tok_jac": word_jaccard(N, M), "name_tok_ovlp": overlap(N, M),
    "addr_char3_jac": gram_jaccard(A, C, 3), "addr_tok_jac": word_jaccard(A, C), "addr_null_tgt": f"({C} = '')::INTEGER::DOUBLE",
    "name_len_diff": f"abs(length({N}) - length({M}))::DOUBLE", "name_len_ratio": ratio(f"length({N})", f"length({M})"), "addr_len_diff": f"abs(length({A}) - length({C}))::DOUBLE",
    "name_wc_diff": f"abs(len({words(N)}) - len({words(M)}))::DOUBLE", "name_wc_ratio": ratio(f"len({words(N)})", f"len({words(M)})"),
    "name_prefix3": prefix(N, M, 3), "name_prefix5": prefix(N, M, 5), "hno_contradiction": differ("house_no"), "pin_contradiction": differ("postal_code"),
    "pin_prefix3": prefix("q_postal_code", "t_postal_code", 3), "pin_both_present": "(q_postal_code <> '' AND t_postal_code <> '')::INTEGER::DOUBLE",
    "is_source3": "starts_with(target_id, 'S3')::INTEGER::DOUBLE", "india_flag": "(lower(q_country) LIKE '%india%')::INTEGER::DOUBLE", "france_flag": "(lower(q_country) IN ('france', 'fr'))::INTEGER::DOUBLE",
}
FIRST = {
    "exact_clean_name": same("clean_name"), "exact_stripped_name": same("stripped_name"), "exact_sorted_name": same("sorted_name"),
    "name_len_diff": NATIVE["name_len_diff"], "name_len_ratio": ratio(f"length({N})", f"length({M})", 0), "exact_clean_address": same("std_address"), "addr_is_null_target": NATIVE["addr_null_tgt"],
    "addr_token_jaccard": f"(CASE WHEN {_ADDRESS} THEN {word_jaccard(A, C)} ELSE 0 END)", "addr_token_overlap": f"(CASE WHEN {_ADDRESS} THEN {overlap(A, C)} ELSE 0 END)",
    "numeric_token_jaccard": f"(CASE WHEN {_BOTH} THEN {jaccard(f'list_distinct({numbers(A)})', f'list_distinct({numbers(C)})', '0')} ELSE 0 END)",
    "house_number_match": f"({_BOTH} AND {numbers(A)}[1] = {numbers(C)}[1])::INTEGER::DOUBLE", "contradiction_house_no": f"({_BOTH} AND {numbers(A)}[1] <> {numbers(C)}[1])::INTEGER::DOUBLE",
    "postal_code_match": same("postal_code"), "postal_both_present": NATIVE["pin_both_present"], "contradiction_postal": differ("postal_code"), "is_source3": "starts_with(target_id, 'S3-')::INTEGER::DOUBLE",
}
_LONE = lambda x: f"coalesce(len(list_filter({words(x)}, lambda w: length(w) = 1))::DOUBLE / nullif(len({words(x)}), 0), 0)"
SECOND = {
    "name_char2_jaccard": gram_jaccard(N, M, 2), "name_char3_jaccard": gram_jaccard(N, M, 3), "name_prefix3_match": prefix(N, M, 3), "name_prefix5_match": prefix(N, M, 5),
    "name_abbrev_ratio_q": _LONE(N), "name_abbrev_ratio_t": _LONE(M), "name_word_count_diff": NATIVE["name_wc_diff"], "name_word_count_ratio": NATIVE["name_wc_ratio"],
    "addr_char3_jaccard": gram_jaccard(A, C, 3), "addr_word_count_diff": f"abs(len({words(A)}) - len({words(C)}))::DOUBLE",
    "addr_numeric_density_t": f"coalesce((length({C}) - length(regexp_replace({C}, '[0-9]', '', 'g')))::DOUBLE / nullif(length({C}), 0), 0)",
    "city_token_overlap": jaccard(city(A), city(C), "1"), "pincode_prefix_match": prefix("q_postal_code", "t_postal_code", 3), "india_flag": NATIVE["india_flag"],
}
BOOSTED = {
    "house_number_diff": f"(CASE WHEN {house(A)} IS NULL OR {house(C)} IS NULL THEN 0.5::DOUBLE ELSE least(abs({house(A)} - {house(C)}), 999)::DOUBLE / 999 END)",
    "street_token_overlap": jaccard(digit_words(A, False), digit_words(C, False), "1"), "name_digit_overlap": jaccard(digit_words(N, True), digit_words(M, True), "1"),
    "name_initials_match": _NULL_SAFE(initials), "name_bigram_jaccard": gram_jaccard(N, M, 2), "addr_bigram_jaccard": gram_jaccard(A, C, 2),
}


def projected(columns: dict[str, str]) -> str:
    return f"{PAIRS} SELECT entity_id, target_id, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in columns.items()) + " FROM pairs"


def _norms() -> dict[str, str]:
    wide = f"regexp_replace(regexp_replace(lower(url), '\\.(com|org|net|in|co|us|gov|io)($|[^a-z0-9])', ' \\2', 'g'), '(^|[^a-z0-9])(www|https?)($|[^a-z0-9])', '\\1 \\3', 'g')"
    core = f"list_filter({words('clean_name')}, lambda w: length(w) >= 3 AND w NOT IN ({quoted(T.CORE_STOPS)}))"
    runs = f"list_transform(list_sort(list_transform(list_distinct({numbers('business_address')}), lambda x: {{'n': length(x), 'x': x}})), lambda s: s.x)"
    kept = lambda x, n: join(f"list_filter({words(x)}, lambda w: {n}regexp_matches(w, '^[0-9]+$'))")
    return {f"norm_{k}": f"{BASE} SELECT entity_id, {k} FROM m" for k in NORM} | {
        "norm_unaccented": f"{BASE} SELECT entity_id, strip_accents(clean_name) AS v FROM m",
        "norm_ascii_folded": f"{BASE} SELECT entity_id, regexp_replace(strip_accents(clean_name), '[^\\x00-\\x7F]', '', 'g') AS v FROM m",
        "norm_accents": f"{BASE} SELECT entity_id, translate(lower(business_name), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}') AS v FROM m",
        "norm_numeric_tokens": f"{BASE} SELECT entity_id, CASE WHEN business_address IS NULL THEN '' ELSE {join(runs, ',')} END AS v FROM m",
        "norm_core_tokens": f"{BASE} SELECT entity_id, {join(core)} AS v FROM m",
        "norm_street_words": f"{BASE} SELECT entity_id, {kept('std_address', 'NOT ')} AS words, {kept('std_address', '')} AS digits FROM m",
        "norm_domains": f"SELECT page_id, {squeeze(wide)} AS v FROM pages",
        "norm_latin_long_vowels": f"{BASE} SELECT entity_id, CASE WHEN regexp_matches(clean_name, '{T.INDIC_LETTER}') THEN {latin('clean_name', True)} ELSE clean_name END AS v FROM m",
        "norm_extended_suffixes": f"{BASE} SELECT entity_id, {without('clean_name', T.MORE_SUFFIXES)} AS v FROM m",
        "norm_postal_of_std": f"""{BASE} SELECT entity_id, CASE WHEN lower(country) = 'india' THEN {first("string_split(std_address, ' ')", "^[1-9][0-9]{5}$")} WHEN lower(country) IN ('us', 'usa') THEN {first("string_split(std_address, ' ')", "^[0-9]{5}$")}
  WHEN lower(country) = 'france' THEN {first("string_split(std_address, ' ')", "^(0[1-9]|[1-8][0-9]|9[0-8])[0-9]{3}$")} ELSE {first("string_split(std_address, ' ')", "^[0-9]{5,6}$")} END AS v FROM m""",
    }


def _blocking() -> dict[str, str]:
    three = ", ".join(f"p{k} AS ({channel(c)})" for k, c in enumerate((CHANNELS[0], CHANNELS[1], Channel("p", ("postal_code", "first_word"), 0.8, (1, 3))), 1))
    words4 = f"list_distinct(list_filter({words('clean_name')}, lambda w: length(w) >= 4))"
    token = f"tt AS (SELECT entity_id AS target_id, country, unnest({words4}) AS word FROM t), qt AS (SELECT entity_id, country, unnest({words4}) AS word FROM q)"
    tokens = f"{BASE}, {token}, ok AS (SELECT country, word FROM tt GROUP BY ALL HAVING count(*) <= 2000), sh AS (SELECT entity_id, target_id, count(*) AS shared FROM qt JOIN tt USING (country, word) JOIN ok USING (country, word) GROUP BY ALL)"
    return {f"ch_{c.name}": f"{BASE} {channel(c)}" for c in (*CHANNELS, *MORE_CHANNELS)} | {
        "pool_candidates": f"{BASE}, {pooled()} SELECT * FROM pool",
        "topk_candidates": f"{CANDIDATES} SELECT * FROM top",
        "candidates_13_channels": f"{BASE}, {pooled((*CHANNELS, *MORE_CHANNELS))} SELECT entity_id, target_id, max_prio, n_channels FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY max_prio DESC, n_channels DESC, target_id) AS r FROM pool) WHERE r <= 80",
        "pool_of_pools": f"{BASE}, {pooled()}, {pooled(MORE_CHANNELS, 'more')} SELECT entity_id, target_id, max(max_prio) AS max_prio, sum(n_channels)::INTEGER AS n_channels FROM (SELECT * FROM pool UNION ALL SELECT * FROM more) GROUP BY ALL",
        "three_pass": f"{BASE}, {three}, x AS (SELECT entity_id, target_id, min(place) AS place FROM (SELECT *, 1 AS place FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3) GROUP BY ALL) SELECT entity_id, target_id, ['exact_clean', 'token_sorted', 'postal_first_word'][place] AS provenance FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY place, target_id) AS r FROM x) WHERE r <= 30",
        "union_distinct": f"{BASE} SELECT entity_id, target_id FROM ({channel(CHANNELS[1])}) UNION SELECT entity_id, target_id FROM ({channel(MORE_CHANNELS[8])})",
        "pair_space": f"{BASE} SELECT coalesce(a.country, b.country) AS country, coalesce(n_queries, 0) AS n_queries, coalesce(n_targets, 0) AS n_targets, coalesce(n_queries, 0) * coalesce(n_targets, 0) AS n_pairs FROM (SELECT country, count(*) AS n_queries FROM q GROUP BY 1) a FULL JOIN (SELECT country, count(*) AS n_targets FROM t GROUP BY 1) b ON a.country = b.country",
        "candidate_lists": f"{CANDIDATES} SELECT q.entity_id AS source1_entity_id, coalesce(x.ids, '') AS matched_entity_ids FROM q LEFT JOIN (SELECT entity_id, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM top GROUP BY 1) x ON q.entity_id = x.entity_id",
        "rare_bigrams": f"{BASE} SELECT country, name_bigram FROM t WHERE length(name_bigram) >= 1 GROUP BY ALL HAVING count(*) <= 500",
        "rare_brands": f"{BASE} SELECT country, brand_token FROM t WHERE length(brand_token) >= 1 GROUP BY ALL HAVING count(*) <= 300",
        "missed_anti": f"{CANDIDATES} SELECT entity_id, target_id FROM truth ANTI JOIN top USING (entity_id, target_id)",
        "label_pairs": f"{CANDIDATES} SELECT top.entity_id, top.target_id, (truth.entity_id IS NOT NULL)::INTEGER AS label FROM top LEFT JOIN truth USING (entity_id, target_id)",
        "token_index": f"{tokens} SELECT entity_id, target_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared DESC, target_id) AS r FROM sh) WHERE r <= 25",
        "reduction_ratio": f"{CANDIDATES} SELECT *, round(1 - pairs::DOUBLE / (n_queries * n_targets), 9) AS reduction FROM (SELECT (SELECT count(*) FROM q) AS n_queries, (SELECT count(*) FROM t) AS n_targets, (SELECT count(*) FROM top) AS pairs)",
        "head_entities": f"{BASE} SELECT entity_id, business_name, business_address, country FROM e ORDER BY entity_id LIMIT 50",
        "slice_entities": f"{BASE} SELECT entity_id, country FROM e ORDER BY entity_id LIMIT 100 OFFSET 200",
        "tfidf_topk": _tfidf("country", 0.12, 60), "tfidf_anywhere": _tfidf("''", 0.12, 60, 0.03, 3),
    }


def _tfidf(shard: str, least: float, k: int, most: float = 0.05, fewest: int = 2) -> str:
    padded = f"list_transform({words('clean_name')}, lambda w: ' ' || w || ' ')"
    cut = lambda n: f"flatten(list_transform({padded}, lambda w: list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))))"
    tf = lambda side, name: f"SELECT entity_id AS {name}, shard, gram, count(*) AS tf FROM (SELECT entity_id, {shard} AS shard, unnest(list_concat({cut(3)}, {cut(4)})) AS gram FROM {side}) GROUP BY ALL"
    weighted = lambda tf_, name: f"SELECT {name}, shard, gram, w / sqrt(sum(w * w) OVER (PARTITION BY {name})) AS w FROM (SELECT x.*, (1 + ln(tf)) * idf AS w FROM {tf_} x JOIN idf USING (shard, gram))"
    return f"""{BASE}, qf AS ({tf("q", "entity_id")}), tf AS ({tf("t", "target_id")}), totals AS (SELECT {shard} AS shard, count(*) AS total FROM t GROUP BY 1),
idf AS (SELECT shard, gram, ln((1 + total) / (1 + df)) + 1 AS idf FROM (SELECT shard, gram, count(*)::DOUBLE AS df FROM tf GROUP BY ALL) JOIN totals USING (shard) WHERE df >= {fewest} AND df <= greatest({most}::DOUBLE * total, {fewest})),
qw AS ({weighted("qf", "entity_id")}), tw AS ({weighted("tf", "target_id")}),
sc AS (SELECT entity_id, target_id, round(sum(qw.w * tw.w), 6) AS score FROM qw JOIN tw USING (shard, gram) GROUP BY ALL)
SELECT entity_id, target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, target_id) AS r FROM sc WHERE score >= {least}) WHERE r <= {k}"""


def _features() -> dict[str, str]:
    heuristic = f"max_prio + 0.15::DOUBLE * (n_channels - 1) + 0.5::DOUBLE * {JW} + 0.3::DOUBLE * {word_jaccard(N, M)} + 0.2::DOUBLE * {same('postal_code')} - 0.4::DOUBLE * {differ('postal_code')} - 0.25::DOUBLE * {differ('house_no')}"
    address = lambda x: distinct_words(x)
    both = f"len(list_intersect({address('q_sorted_addr')}, {address('t_sorted_addr')}))"
    shared = f"len(list_intersect({distinct_words(N)}, {distinct_words(M)}))"
    loose = f"(CASE WHEN length({N}) + length({M}) = 0 THEN 1 ELSE {gram_jaccard(N, M, 3)} END)"
    return {
        "ngram_jaccard": projected({"c2": gram_jaccard(N, M, 2), "c3": gram_jaccard(N, M, 3), "c4": gram_jaccard(N, M, 4)}),
        "token_jaccard": projected({"name_tok_jac": word_jaccard(N, M), "addr_tok_jac": word_jaccard(A, C)}),
        "overlap_coef": projected({"ovlp": overlap(N, M)}),
        "jaccard_options": projected({"empty_is_one": gram_jaccard("q_first_word", "t_first_word", 9).replace("THEN 0::DOUBLE", "THEN 1::DOUBLE"), "whole": jaccard(*(f"(CASE WHEN length({x}) >= 9 THEN {grams(x, 9)} ELSE [{x}] END)" for x in ("q_first_word", "t_first_word")), "0")}),
        "contradictions": f"{PAIRS} SELECT entity_id, target_id, {differ('postal_code')}::INTEGER AS pin, {differ('house_no')}::INTEGER AS hno FROM pairs",
        "prefix_length_feats": projected({"p3": prefix(N, M, 3), "p5": prefix(N, M, 5), "diff": NATIVE["name_len_diff"], "ratio": NATIVE["name_len_ratio"]}),
        "features_44_native": projected(NATIVE), "features_first_native": projected(FIRST), "features_second_native": projected(SECOND), "features_boosted_native": projected(BOOSTED),
        "levenshtein_pairs": f"{PAIRS} SELECT entity_id, target_id, levenshtein({single(N)}, {single(M)})::INTEGER AS d FROM pairs",
        "jaro_winkler_pairs": projected({"jw": JW}),
        "heuristic_score": projected({"score": heuristic}),
        "rank_score": projected({"score": f"max_prio + 0.15::DOUBLE * (n_channels - 1) + 0.5::DOUBLE * {JW}"}),
        "sigmoid_scores": projected({"p": f"1 / (1 + exp(-(max_prio + 0.15::DOUBLE * (n_channels - 1) - 1)))"}),
        "address_overlap_pairs": f"{PAIRS} SELECT entity_id, target_id FROM pairs WHERE len({address('q_sorted_addr')}) >= 3 AND len({address('t_sorted_addr')}) >= 3 AND {both}::DOUBLE / least(len({address('q_sorted_addr')}), len({address('t_sorted_addr')})) >= 0.8::DOUBLE",
        "shared_tokens_pairs": f"{PAIRS} SELECT entity_id, target_id, {both}::INTEGER AS address_words, {shared}::INTEGER AS name_words FROM pairs WHERE {both} >= 2 OR {shared} >= 1",
        "spaceless_containment": f"{PAIRS} SELECT entity_id, target_id FROM pairs WHERE {NATIVE['spaceless_subset']} = 1",
        "candidate_places": f"{SCORED} SELECT entity_id, target_id, row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, target_id)::DOUBLE AS candidate_rank, (count(*) OVER (PARTITION BY entity_id))::DOUBLE AS n_candidates FROM s",
        "score_correlation": f"{SCORED} SELECT round(corr(p, max_prio), 6) AS p_prio, round(corr(p, n_channels), 6) AS p_channels FROM s",
    }


def _decisions() -> dict[str, str]:
    margin = f"{RANKED} WHERE p >= 0.7 OR (r = 1 AND p >= 0.3 AND (nx IS NULL OR p - nx >= 0.1))"
    found = "found AS (SELECT entity_id, target_id, p FROM sure UNION ALL SELECT entity_id, target_id, p FROM s ANTI JOIN sure USING (entity_id, target_id) WHERE p >= 0.55)"
    mixed = "x AS (SELECT entity_id, target_id, p FROM s UNION ALL SELECT * FROM sure)"
    rx = RANKED.replace("FROM s)", "FROM (SELECT * FROM x WHERE p < 1))")
    best = "bp AS (SELECT entity_id, target_id, max(p) AS p FROM x WHERE p >= 0.35 AND p < 1 GROUP BY ALL)"
    special = "sp AS (SELECT * FROM sure WHERE target_id IN (SELECT target_id FROM sure GROUP BY 1 HAVING count(*) <= 5))"
    mp = "max(CASE WHEN target_id LIKE 'S2%' THEN p END) OVER (PARTITION BY entity_id)"
    return {
        "flat_threshold": f"{SCORED} {OUT} s WHERE p >= 0.6",
        "threshold_by_country": f"{SCORED} {OUT} s WHERE p >= CASE country WHEN 'US' THEN 0.6 WHEN 'France' THEN 0.5 ELSE 0.55 END",
        "threshold_by_source": f"{SCORED} {OUT} s WHERE p >= CASE substr(target_id, 1, 2) WHEN 'S2' THEN 0.6 ELSE 0.5 END",
        "margin_gate": f"{SCORED} {OUT} {margin}",
        "margin_gate_capped": f"{SCORED} {OUT} {CAP(f'(SELECT entity_id, target_id, p FROM {margin})', 1)}",
        "cap_per_source": f"{SCORED} {OUT} {CAP('(SELECT * FROM s WHERE p >= 0.4)', 2)}",
        "one_per_source": f"{SCORED} {OUT} {CAP('(SELECT * FROM s WHERE p >= 0.4)', 1)}",
        "source_thresholds_capped": f"{SCORED} {OUT} {CAP('''(SELECT * FROM s WHERE p >= CASE substr(target_id, 1, 2) WHEN 'S2' THEN 0.45 ELSE 0.35 END)''', 2)}",
        "fallback": f"{SCORED} {OUT} (SELECT * REPLACE (coalesce(nx, 0) AS nx) FROM {RANKED}) WHERE (p >= 0.65 AND rs <= 3) OR (best < 0.65 AND r = 1 AND p >= 0.3 AND p - nx >= 0.08)",
        "bypass_or_fallback": f"{SCORED}, {SURE}, {found} {OUT} found UNION ALL {OUT} {RANKED} WHERE r = 1 AND p >= 0.3 AND p - coalesce(nx, 0) >= 0.1 AND entity_id NOT IN (SELECT entity_id FROM found)",
        "without_bypass": f"{SCORED}, {SURE}, {mixed} {OUT} {rx} WHERE (p >= 0.6 AND rs <= 3) OR (best < 0.6 AND r = 1 AND p >= 0.3 AND (nx IS NULL OR p - nx >= 0.1))",
        "specific_bypass": f"{SCORED}, {SURE}, {special} {OUT} sp",
        "boost_with_bypass": f"{SCORED}, {SURE}, {special}, b AS (SELECT entity_id, target_id, p FROM s WHERE p >= 0.7), x AS (SELECT entity_id, target_id, p FROM s WHERE p >= 0.5 UNION ALL SELECT entity_id, target_id, p FROM sp) {OUT} b UNION ALL SELECT entity_id, target_id, max(p) AS p FROM x WHERE entity_id NOT IN (SELECT entity_id FROM b) GROUP BY ALL",
        "rethreshold": f"{SCORED}, {SURE}, {mixed}, {best} {OUT} {CAP(f'(SELECT * FROM (SELECT *, {R} AS r FROM bp) WHERE r <= 6)', 3)}",
        "relaxed_third": f"{SCORED} {OUT} (SELECT *, {mp} AS second FROM s) WHERE p >= 0.5 OR (target_id LIKE 'S3%' AND p >= 0.3 AND second >= 0.6)",
        "tiered": f"{SCORED} {OUT} {RANKED} WHERE r <= 6 AND p >= CASE WHEN r = 1 THEN 0.45 ELSE 0.55 END",
        "cross_source": f"{SCORED} {OUT} (SELECT *, {R} AS r2 FROM (SELECT entity_id, target_id, p FROM {RANKED} WHERE p >= CASE WHEN rs = 1 THEN 0.5 ELSE 0.68 END)) WHERE r2 <= 6",
        "relative_ratio": f"{SCORED} {OUT} {RANKED} WHERE best >= 0.4 AND p >= 0.35 AND p >= 0.7::DOUBLE * best",
        "exclusive_global": f"{SCORED} {OUT} (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, entity_id) AS r FROM s WHERE p >= 0.4) WHERE r = 1",
        "exclusive_locked": f"{SCORED}, k AS (SELECT * FROM s WHERE p >= 0.8) {OUT} k UNION ALL {OUT} (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, entity_id) AS r FROM s WHERE p >= 0.4 AND target_id NOT IN (SELECT target_id FROM k)) WHERE r = 1",
        "singleton_boost": f"{SCORED} {OUT} s WHERE p >= 0.6 UNION ALL {OUT} s WHERE p >= 0.4 AND entity_id NOT IN (SELECT entity_id FROM s WHERE p >= 0.6)",
        "extend_single": f"{SCORED}, b AS (SELECT entity_id, target_id, p FROM s WHERE p >= 0.6), o AS (SELECT entity_id FROM b GROUP BY 1 HAVING count(*) = 1) {OUT} b UNION ALL {OUT} (SELECT *, {R} AS r FROM s ANTI JOIN b USING (entity_id, target_id) WHERE p >= 0.3 AND entity_id IN (SELECT entity_id FROM o)) WHERE r = 1",
        "prune": f"{SCORED}, o AS (SELECT entity_id, target_id, round(0.5::DOUBLE * p + 0.5::DOUBLE * max_prio, 6) AS p2 FROM s), x AS (SELECT s.*, p2, max(p2) OVER (PARTITION BY s.entity_id) AS best2 FROM s JOIN o USING (entity_id, target_id) WHERE s.p >= 0.4) {OUT} x WHERE p2 >= 0.7 OR best2 >= 0.9",
        "bypass": f"{BASE}, {SURE} {OUT} sure",
    }


def _reports() -> dict[str, str]:
    found = "found AS (SELECT truth.* FROM truth SEMI JOIN top USING (entity_id, target_id))"
    kinds = "kinds AS (SELECT entity_id, CASE WHEN count(DISTINCT substr(target_id, 1, 2)) > 1 THEN 'both' ELSE min(substr(target_id, 1, 2)) || '_only' END AS kind FROM truth GROUP BY 1)"
    rows = "rows_ AS (SELECT truth.*, (top.entity_id IS NOT NULL)::INTEGER AS c, kind, q.country FROM truth LEFT JOIN top USING (entity_id, target_id) JOIN kinds USING (entity_id) JOIN q USING (entity_id))"
    sliced = " UNION ALL ".join(f"SELECT '{k}' AS slice, {v} AS label, entity_id, c FROM rows_" for k, v in (("all", "'all'"), ("country", "country"), ("relationship", "kind"), ("source", "substr(target_id, 1, 2)")))
    volume = "v AS (SELECT q.entity_id, count(top.target_id) AS n FROM q LEFT JOIN top ON q.entity_id = top.entity_id GROUP BY 1)"
    grid = "g AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS theta)"
    digest = "('0x' || substr(md5('2026:' || entity_id), 1, 8))::BIGINT"
    rate = lambda x: f"round(avg(coalesce({x}, false)::INTEGER), 6)"
    blank = lambda c: rate(f"coalesce({c}, '') = ''")
    parts = "SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name AS name FROM part"
    cuts = lambda table, c, x: f"SELECT {x}::DOUBLE AS share, (SELECT list_sort(list({c}))[least(floor(count(*) * {x}::DOUBLE), count(*) - 1)::INTEGER + 1] FROM {table}) AS value"
    near = lambda table, c, x: f"SELECT {x}::DOUBLE AS share, (SELECT list_sort(list({c}))[round((count(*) - 1) * {x}::DOUBLE)::INTEGER + 1] FROM {table}) AS value"
    w = lambda c: distinct_words(c)
    except_ = lambda a, b: f"list_filter({w(a)}, lambda x: NOT list_contains({w(b)}, x))"
    missing = lambda x: f"SELECT count(DISTINCT entity_id) FROM ({x})"
    collide = lambda src, key: f"g AS (SELECT {key} AS k, count(*) AS n FROM ({src}) WHERE {key} <> '' GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS keys, round(sum(n)::DOUBLE / count(*), 6) AS ratio, count(CASE WHEN n > 1 THEN 1 END) AS shared_keys, max(n) AS most, round(avg(n), 6) AS mean, count(CASE WHEN n > 50 THEN 1 END) AS over_50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM g"
    checks = {
        "repeated_entity": ("error", "SELECT 0"),
        "repeated_target": ("error", "SELECT 0"),
        "self_match": ("error", "SELECT 0"),
        "bad_prefix": ("error", "SELECT count(DISTINCT target_id) FROM out_ WHERE NOT regexp_matches(target_id, '^S[123]-')"),
        "missing_entity": ("error", "SELECT count(*) FROM q WHERE entity_id NOT IN (SELECT entity_id FROM rows_)"),
        "extra_entity": ("error", "SELECT count(DISTINCT entity_id) FROM rows_ WHERE entity_id NOT IN (SELECT entity_id FROM q)"),
        "unknown_target": ("error", "SELECT count(DISTINCT target_id) FROM out_ WHERE regexp_matches(target_id, '^S[23]-') AND target_id NOT IN (SELECT entity_id FROM t)"),
        "outside_candidates": ("warning", missing("SELECT * FROM out_ ANTI JOIN top USING (entity_id, target_id)")),
    }
    # A result with faults: entities 3 and 4 of each ten are lacking, one list has ids that no table has, links below 0.3 come from outside.
    faulty = "rows_ AS (SELECT entity_id FROM q WHERE (substr(entity_id, 4)::BIGINT // 3) % 10 NOT IN (3, 4) UNION ALL SELECT 'S1-999999999'), out_ AS (SELECT entity_id, target_id FROM s WHERE p >= 0.6 AND entity_id IN (SELECT entity_id FROM rows_) UNION ALL SELECT 'S1-999999999', unnest(['S2-999999999', 'X-1']))"
    return {
        "per_entity_f05": f"{SCORED}, {PER} SELECT entity_id, country, n_pred, n_true, tp, f05 FROM sc",
        "macro_f05": f"{SCORED}, {PER} SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, round(coalesce(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INTEGER END), 1.0), 6) AS singleton_accuracy, round(avg(CASE WHEN n_true > 0 THEN CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END END), 6) AS precision, round(avg(CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true END), 6) AS recall FROM sc",
        "worst_entities": f"{SCORED}, {PER} SELECT entity_id, f05 FROM sc ORDER BY f05, entity_id LIMIT 20",
        "slices_grouping_sets": f"{SCORED}, {PER}, b AS (SELECT *, {BIN} AS match_bin FROM sc) SELECT country, match_bin, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM b GROUP BY GROUPING SETS ((), (country), (match_bin))",
        "fold_deviation": f"{SCORED}, {PER}, f AS (SELECT {digest} % 5 AS fold, avg(f05) AS f FROM sc GROUP BY 1) SELECT round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS deviation FROM f",
        "link_report": f"{SCORED}, {PER}, c AS (SELECT (SELECT count(*) FROM links SEMI JOIN truth USING (entity_id, target_id)) AS tp, (SELECT count(*) FROM links) AS n_pred, (SELECT count(*) FROM truth) AS n_true) SELECT *, round(tp::DOUBLE / n_pred, 6) AS precision, round(tp::DOUBLE / n_true, 6) AS recall, {F05} AS f05, "
        + ", ".join(f"round((SELECT count(*) FROM links SEMI JOIN truth USING (entity_id, target_id) WHERE target_id LIKE '{s}%')::DOUBLE / (SELECT count(*) FROM truth WHERE target_id LIKE '{s}%'), 6) AS recall_{s.lower()}" for s in ("S2", "S3")) + " FROM c",
        "theta_grid": f"{SCORED}, {grid}, x AS (SELECT theta, q.entity_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM g CROSS JOIN q LEFT JOIN (SELECT entity_id, count(*) AS n_true FROM truth GROUP BY 1) a USING (entity_id) LEFT JOIN (SELECT theta, s.entity_id, count(*) AS n_pred, count(truth.target_id) AS tp FROM g JOIN s ON s.p >= theta LEFT JOIN truth USING (entity_id, target_id) GROUP BY ALL) b USING (theta, entity_id)) SELECT theta, round(avg({F05}), 6) AS macro_f05 FROM x GROUP BY theta",
        "blocking_report": f"{CANDIDATES}, {kinds}, {rows} SELECT slice, label, count(*) AS links, sum(c)::BIGINT AS found, round(avg(c), 6) AS link_recall, count(DISTINCT entity_id) AS entities, count(DISTINCT CASE WHEN c = 1 THEN entity_id END) AS covered FROM ({sliced}) GROUP BY ALL",
        "volume_percentiles": f"{CANDIDATES}, {volume} SELECT count(*) AS entities, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean, max(n) AS most, " + ", ".join(f"round(quantile_cont(n, {x}), 6) AS p{int(x * 100)}" for x in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM v",
        "volume_of_singletons": f"{CANDIDATES}, {volume}, a AS (SELECT * FROM v WHERE entity_id NOT IN (SELECT entity_id FROM truth)) SELECT count(*) AS entities, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean FROM a",
        "volume_quantiles_truncated": f"{CANDIDATES}, {volume} " + " UNION ALL ".join(cuts("v", "n", x) for x in (0.25, 0.5, 0.9, 0.99)),
        "volume_quantiles_nearest": f"{CANDIDATES}, {volume} " + " UNION ALL ".join(near("v", "n", x) for x in (0.25, 0.5, 0.95)),
        "coverage": f"{CANDIDATES}, {found}, {counted('found', 'per')} SELECT CASE WHEN tp = n_true THEN 'full' WHEN tp > 0 THEN 'partial' ELSE 'none' END AS coverage, count(*) AS entities FROM per WHERE n_true > 0 GROUP BY 1",
        "error_decomposition": f"{SCORED}, links AS (SELECT entity_id, target_id FROM s WHERE p >= 0.6), {found}, {counted('found', 'c')}, {counted('links', 'l')}, x AS (SELECT (SELECT avg({EXACT}) FROM c) AS ceiling, (SELECT avg({EXACT}) FROM l) AS score) SELECT round(ceiling, 6) AS ceiling, round(score, 6) AS score, round(1 - score, 6) AS gap, round(1 - ceiling, 6) AS retrieval_loss, round(ceiling - score, 6) AS scorer_loss FROM x",
        "collision_profile": f"{BASE}, {collide('SELECT * FROM m', 'sorted_name')}",
        "part_collisions": f"WITH {collide(parts, 'name')}",
        "most_common_names": f"SELECT name, count(*) AS n FROM ({parts}) GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
        "match_histogram": f"{BASE}, h AS (SELECT q.entity_id, count(truth.target_id) AS n FROM q LEFT JOIN truth ON q.entity_id = truth.entity_id GROUP BY 1) SELECT n, count(*) AS entities FROM h GROUP BY n",
        "source_breakdown": f"{BASE}, {SOURCES} SELECT CASE WHEN s2 > 0 AND s3 > 0 THEN 'both' WHEN s2 > 0 THEN 's2_only' WHEN s3 > 0 THEN 's3_only' ELSE 'singleton' END AS kind, count(*) AS entities FROM src GROUP BY 1",
        "joint_counts": f"{BASE}, {SOURCES} SELECT s2, s3, count(*) AS entities FROM src GROUP BY ALL",
        "truth_profile": f"{BASE} SELECT count(*) AS links, count(DISTINCT entity_id) AS entities, count(DISTINCT target_id) AS targets, count(*) - count(DISTINCT (entity_id, target_id)) AS repeated, (SELECT count(*) FROM truth WHERE entity_id NOT IN (SELECT entity_id FROM q)) AS unknown_entities, (SELECT count(*) FROM truth WHERE target_id NOT IN (SELECT entity_id FROM t)) AS unknown_targets, (SELECT count(*) FROM (SELECT target_id FROM truth GROUP BY 1 HAVING count(*) > 1)) AS shared_targets FROM truth",
        "match_statistics": f"{LINKED} SELECT count(*) AS pairs, {rate('q_country = t_country')} AS same_country, {rate('q_business_name = t_business_name')} AS same_name, {rate('lower(q_business_name) = lower(t_business_name)')} AS same_name_lower, {rate('q_business_address = t_business_address')} AS same_address, {rate('lower(q_business_address) = lower(t_business_address)')} AS same_address_lower, {blank('q_business_name')} AS blank_q_name, {blank('t_business_name')} AS blank_t_name, {blank('q_business_address')} AS blank_q_address, {blank('t_business_address')} AS blank_t_address FROM lp",
        "token_changes": f"{LINKED} SELECT kind, word, count(*) AS n FROM (SELECT 'dropped' AS kind, unnest({except_('q_clean_name', 't_clean_name')}) AS word FROM lp UNION ALL SELECT 'added', unnest({except_('t_clean_name', 'q_clean_name')}) FROM lp) GROUP BY ALL",
        "corruption_profile": f"{LINKED}, x AS (SELECT *, {words('q_clean_name')} AS a, {words('t_clean_name')} AS b FROM lp) SELECT count(*) AS pairs, round(avg(len(a) - len(b)), 6) AS words_diff, round(avg(length(q_clean_name) - length(t_clean_name)), 6) AS length_diff, {rate('list_sort(list_distinct(a)) = list_sort(list_distinct(b))')} AS same_words, {rate('list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AND a <> b')} AS reordered FROM x",
        "postal_agreement": f"{LINKED} SELECT q_country AS country, count(*) AS pairs, count(CASE WHEN q_postal_code <> '' AND t_postal_code <> '' THEN 1 END) AS both, count(CASE WHEN q_postal_code <> '' AND q_postal_code = t_postal_code THEN 1 END) AS equal FROM lp GROUP BY 1",
        "sibling_pairs": f"{BASE} SELECT x.entity_id, x.target_id AS a, y.target_id AS b FROM truth x JOIN truth y ON x.entity_id = y.entity_id AND x.target_id < y.target_id WHERE x.target_id LIKE 'S2%' AND y.target_id LIKE 'S2%'",
        "name_precision": f"{BASE}, x AS ({channel(CHANNELS[1])}) SELECT count(*) AS pairs, count(DISTINCT x.entity_id) AS entities, count(truth.entity_id) AS true_pairs, round(count(truth.entity_id)::DOUBLE / count(*), 6) AS precision FROM x LEFT JOIN truth USING (entity_id, target_id)",
        "script_profile": f"{BASE} SELECT country, count(*) AS rows, count(CASE WHEN regexp_matches(business_name, '[^\\x00-\\x7F]') THEN 1 END) AS non_ascii, count(CASE WHEN regexp_matches(business_name, '{T.INDIC_LETTER}') THEN 1 END) AS indic, count(CASE WHEN regexp_matches(business_name, '[À-ɏ]') THEN 1 END) AS accented, count(CASE WHEN regexp_matches(business_name, '[{T.FRENCH_ACCENTS}{T.FRENCH_ACCENTS.upper()}]') THEN 1 END) AS french_accented, count(CASE WHEN regexp_matches(' ' || lower(business_name) || ' ', ' ({'|'.join(T.FRENCH_FORMS)}) ') THEN 1 END) AS french_legal_form, count(CASE WHEN regexp_matches(lower(coalesce(business_address, '')), '{'|'.join(T.FRENCH_STREETS)}') THEN 1 END) AS french_street_word FROM m GROUP BY 1",
        "overlap_audit": f"{BASE} SELECT (SELECT count(*) FROM t WHERE (sorted_name, country) IN (SELECT (sorted_name, country) FROM q)) AS names, (SELECT count(*) FROM t WHERE (sorted_name, std_address, country) IN (SELECT (sorted_name, std_address, country) FROM q)) AS tuples, (SELECT count(*) FROM t WHERE substr(entity_id, 4) IN (SELECT substr(entity_id, 4) FROM q)) AS ids, (SELECT count(*) FROM t) AS rows",
        "stratified_sample": f"{BASE}, s AS (SELECT q.entity_id, country, {BIN} AS match_bin FROM q LEFT JOIN (SELECT entity_id, count(*) AS c FROM truth GROUP BY 1) x USING (entity_id), LATERAL (SELECT coalesce(c, 0) AS n_true)) SELECT entity_id, country, match_bin FROM (SELECT *, row_number() OVER (PARTITION BY country, match_bin ORDER BY md5('2026:' || entity_id), entity_id) AS r FROM s) WHERE r <= 20",
        "query_split": f"{BASE} SELECT CASE WHEN {digest} % 10000 < 7000 THEN 'train' ELSE 'rest' END AS part, count(*) AS n FROM q GROUP BY 1",
        "fraction_sample": f"{BASE} SELECT entity_id FROM q WHERE {digest} % 1000000 < 250000",
        "schema_contract": f"{BASE} SELECT count(*) AS rows, count(CASE WHEN entity_id IS NULL OR entity_id = '' THEN 1 END) AS missing_ids, count(entity_id) - count(DISTINCT entity_id) AS repeated_ids, count(CASE WHEN NOT starts_with(entity_id, 'S1-') THEN 1 END) AS wrong_prefix, count(CASE WHEN business_name IS NULL THEN 1 END) AS null_names, count(CASE WHEN country IS NULL THEN 1 END) AS null_countries, count(CASE WHEN business_address IS NULL THEN 1 END) AS null_addresses FROM e",
        "validator_findings": f"{SCORED}, {faulty} " + " UNION ALL ".join(f"SELECT '{k}' AS finding, '{level}' AS level, ({x})::BIGINT AS n" for k, (level, x) in checks.items()),
        "auc_ap": f"{SCORED}, l AS (SELECT s.p, (truth.entity_id IS NOT NULL)::INTEGER AS y FROM s LEFT JOIN truth USING (entity_id, target_id)), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY p), c AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tps, sum(pos + neg) OVER (ORDER BY p DESC) AS alls FROM g) SELECT round(sum(pos * (below + neg::DOUBLE / 2)) / (sum(pos) * sum(neg)), 6) AS auc, round(sum(pos * tps::DOUBLE / alls) / sum(pos), 6) AS ap FROM c",
        "oracle_at_k": f"{CANDIDATES}, {found}, {counted('found', 'per')} SELECT round(avg({EXACT}), 6) AS oracle_f05, count(CASE WHEN n_true > 0 AND tp = 0 THEN 1 END) AS blackouts FROM per",
        "round_trip_entities": f"{BASE} SELECT entity_id, nullif(regexp_replace(business_name, '^ +| +$', '', 'g'), '') AS business_name, business_address, country FROM e",
        "round_trip_links": f"{SCORED} {OUT} s WHERE p >= 0.6",
        "round_trip_shards": f"{SCORED} {OUT} s WHERE p >= 0.4",
    }


def oracle_sql() -> dict[str, str]:
    return _norms() | _blocking() | _features() | _decisions() | _reports()
