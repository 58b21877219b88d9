"""Normalisation of names and addresses as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Word lists that linkage results depend on.
LEGAL_SUFFIXES = ("private limited", "pvt ltd", "pvt limited", "private ltd", "limited", "ltd", "pvt", "llc", "inc", "incorporated", "corporation", "corp", "llp", "co", "company", "gmbh", "sarl", "sa", "sas", "plc")
MORE_SUFFIXES = (*LEGAL_SUFFIXES, "center", "services", "service", "partners", "group", "holdings")
ABBREVIATIONS = (
    ("st", "street"), ("ave", "avenue"), ("rd", "road"), ("dr", "drive"), ("blvd", "boulevard"), ("ln", "lane"),
    ("delaware", "de"), ("indiana", "in"), ("new york", "ny"), ("utah", "ut"), ("virginia", "va"), ("maine", "me"), ("california", "ca"), ("texas", "tx"), ("florida", "fl"), ("ohio", "oh"),
    ("delhi", "dl"), ("west bengal", "wb"), ("karnataka", "ka"), ("maharashtra", "mh"), ("gujarat", "gj"), ("tamil nadu", "tn"),
)
GENERIC_BRANDS = (
    "center", "services", "service", "enterprises", "enterprise", "solutions", "group", "holdings", "holding", "associates", "consultancy", "consulting",
    "management", "industries", "industry", "international", "global", "national", "united", "american", "india", "delhi", "mumbai", "texas", "california",
    "medical", "health", "care", "clinic", "hospital", "pharma", "pharmacy", "dental", "dentistry", "realty", "properties", "estate", "construction",
    "builders", "technologies", "technology", "tech", "systems", "corp", "inc",
)
ADDRESS_STOPS = ("floor", "unit", "suite", "null", "none", "na", "and", "the")
SIGNATURE_STOPS = (
    "village", "h", "no", "road", "rd", "street", "st", "ave", "avenue", "dr", "drive", "up", "uttar", "pradesh", "near", "floor", "opp", "plot", "sector", "nagar", "colony",
    "main", "behind", "unit", "city", "lane", "new", "france", "rue", "boulevard", "bd", "chemin", "place", "route", "impasse", "india", "us", "the", "of", "and", "at", "by",
    "in", "to", "for", "on", "de", "du", "la", "le", "les", "des", "et", "suite", "ste", "apt", "po", "box",
)
ADVANCED_STOPS = ("llc", "inc", "corp", "corporation", "ltd", "limited", "pvt", "private", "services", "co", "company", "group", "partners", "associates", "sarl", "sas", "sasu", "eurl", "center", "centre")
CORE_STOPS = ("and", "the", "of", "in", "at", "for", "on", "a", "an", "&", "services", "service", "enterprises", "enterprise", "solutions", "international", "group", "holdings", "holding", "associates")
DOMAINS = ("com", "org", "net", "in", "co", "us", "fr", "biz", "info")
TRADE_NAMES = ("formerly", "dba", "d.b.a.", "t/a", "doing business as", ">>")
TRADE_TAILS = ("formerly", "dba", "t/a", "doing business as")
PAIR_STOPS = ("street", "road", "avenue", "drive", "lane", "floor", "suite", "building", "tower", "block", "sector", "phase", "nagar", "india", "france", "united", "states")
FRENCH_FORMS = ("sarl", "sa", "sas", "sci", "snc", "eurl", "association", "ste", "societe")
FRENCH_STREETS = ("rue", "avenue", "boulevard", "chemin", "place", "allée", "route", "cedex")
FRENCH_ACCENTS = "éèêëàâäôöîïùûüç"
# Latin for letters of Indic scripts, by their place in a script's block of 128 code points.
INDIC = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n",
    0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au", 0x4D: "",
}
SOUTHERN = {0x02: "m", 0x0E: "e", 0x0F: "ee", 0x12: "o", 0x13: "oo", 0x46: "e", 0x47: "ee", 0x4A: "o", 0x4B: "oo"}
#: First code point, what differs from the table, and which places a script lacks.
SCRIPTS = (
    (0x0900, {}, ()),
    (0x0980, {}, (0x01, 0x02, 0x03, 0x33, 0x35, 0x43)),
    (0x0B80, SOUTHERN | {0x29: "n", 0x31: "r", 0x34: "zh"}, (0x01, 0x02, 0x03, 0x16, 0x17, 0x18, 0x1B, 0x1C, 0x1D, 0x20, 0x21, 0x22, 0x25, 0x26, 0x27, 0x2B, 0x2C, 0x2D, 0x36, 0x37, 0x38, 0x39, 0x43)),
    (0x0C00, SOUTHERN, (0x01, 0x03, 0x43)),
    (0x0C80, SOUTHERN, (0x01, 0x03, 0x43)),
    (0x0D00, SOUTHERN | {0x31: "r", 0x34: "zh"}, (0x01, 0x03, 0x43)),
)
#: Letters of two code points, which go first.
CLUSTERS = (("\u09a1\u09bc", "r"), ("\u09a2\u09bc", "rh"), ("\u09af\u09bc", "y"))
#: Another spelling of Devanagari, with long vowels doubled and digits.
LONG_VOWELS = {0x08: "ii", 0x0A: "uu", 0x3E: "aa", 0x40: "ii", 0x42: "uu", 0x02: "m"} | {0x66 + k: str(k) for k in range(10)}
ACCENTS = ("éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc")
LEET = (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"))

NO_WORD = r"[^\p{L}\p{M}\p{N}_ \t\n\r]"
BLANKS = r"[ \t\n\r]+"
INDIC_LETTER = "[ऀ-ൿ]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def clean(c: Column) -> Column:
    """Lower case, & as and, other punctuation as a blank; combining marks stay with their letters; null is empty."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), NO_WORD, " "))


def plain(c: Column) -> Column:
    """Lower case with punctuation as a blank."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NO_WORD, " "))


def _spread(c: Column) -> Column:
    # Two blanks between words, so that neighbouring words each have their own to match.
    return F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))


def _spread_word(word: str) -> str:
    return word.replace(" ", "  ")


def without_words(c: Column, words: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """A clean string without the words, which may be several in a row, wherever they stand."""
    return squeeze(F.regexp_replace(_spread(c), f" (?:{'|'.join(map(_spread_word, words))}) ", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def sort_words(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def sorted_name(name: Column) -> Column:
    stripped = without_words(clean(name))
    return sort_words(F.when(stripped != "", stripped).otherwise(clean(name)))


def std_address(c: Column) -> Column:
    """Street and state words in their standard form, numbers without leading zeros."""
    out = _spread(plain(c))
    for word, to in ABBREVIATIONS:
        out = F.replace(out, F.lit(f" {_spread_word(word)} "), F.lit(f" {to} "))
    return F.array_join(F.transform(words(squeeze(out)), lambda x: F.regexp_replace(x, "^0+([0-9]+)$", "$1")), " ")


def sorted_address(c: Column) -> Column:
    kept = F.filter(words(std_address(c)), lambda x: (F.length(x) >= 3) & ~x.isin(*ADDRESS_STOPS))
    return F.array_join(F.array_sort(kept), " ")


def _first(tokens: Column, pattern: str) -> Column:
    return F.coalesce(F.get(F.filter(tokens, lambda x: x.rlike(pattern)), F.lit(0)), F.lit(""))


def postal_code(address: Column, country: Column, source: str = "raw") -> Column:
    """First word of the address that is a postal code of the country.

    ``source`` "raw" reads the address as it is; "std" its standard form, whose numbers have lost leading zeros.
    """
    tokens, place = words(plain(address) if source == "raw" else std_address(address)), F.lower(country)
    return (
        F.when(place == "india", _first(tokens, "^[1-9][0-9]{5}$"))
        .when(place.isin("us", "usa"), _first(tokens, "^[0-9]{5}$"))
        .when(place == "france", _first(tokens, "^(0[1-9]|[1-8][0-9]|9[0-8])[0-9]{3}$"))
        .otherwise(_first(tokens, "^[0-9]{5,6}$"))
    )


def fold_accents(c: Column) -> Column:
    """A few accented letters without their accents, others as they are."""
    return F.translate(F.lower(c), *ACCENTS)


@pandas_udf(StringType())
def ascii_folded(c: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII only: other letters go."""
    return c.fillna("").map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@pandas_udf(StringType())
def unaccented(c: pd.Series) -> pd.Series:
    """Canonical decomposition without nonspacing marks: letters of all scripts stay."""
    return c.fillna("").map(lambda x: "".join(y for y in unicodedata.normalize("NFD", x) if unicodedata.category(y) != "Mn"))


def without_domains(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"\.(com|org|net|in|co|us|gov|io)($|[^a-z0-9])", " $2"), r"(^|[^a-z0-9])(www|https?)($|[^a-z0-9])", "$1 $3"))


def deleet(c: Column) -> Column:
    """Digits that stand for letters, between letters or as a zero at a word's end."""
    out = c
    for digit, letter in LEET:
        for _ in range(2):
            out = F.regexp_replace(out, f"([a-z]){digit}([a-z])", f"$1{letter}$2")
    return F.regexp_replace(F.regexp_replace(out, "(^| )0([a-z])", "$1o$2"), "([a-z])0( |$)", "$1o$2")


def spaceless(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def house_number(std: Column) -> Column:
    return _first(words(std), "^[0-9]{1,6}[a-z]?$")


def word_at(c: Column, k: int) -> Column:
    return F.coalesce(F.get(words(c), F.lit(k)), F.lit(""))


def brand_token(stripped_name: Column) -> Column:
    """First word of a name without legal words, if it is long and not a generic one."""
    first = word_at(stripped_name, 0)
    return F.when((F.length(first) >= 4) & ~first.isin(*GENERIC_BRANDS), first).otherwise("")


def name_bigram(stripped: Column) -> Column:
    two = F.slice(F.filter(words(stripped), lambda x: F.length(x) >= 3), 1, 2)
    return F.when(F.size(two) == 2, F.array_join(F.array_sort(two), " ")).otherwise("")


def slice_words(c: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(words(c), start, n), " ")


def two_longest(tokens: Column, least: int, stops: tuple[str, ...] = (), digits: bool = True) -> Column:
    """The two longest words that aren't stop words, the earlier of equals, in order; empty if there aren't two."""
    kept = F.filter(tokens, lambda x: (F.length(x) >= least) & ~x.isin(*stops, "") & (F.lit(digits) | ~x.rlike("^[0-9]+$")))
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    two = F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda s: s["x"])), " ")
    return F.when(F.size(kept) >= 2, two).otherwise("")


def address_signature(std: Column) -> Column:
    return two_longest(words(std), 4, SIGNATURE_STOPS)


def _either(items: tuple[str, ...]) -> str:
    return "|".join(x.replace(".", r"\.") for x in items)


#: Patterns that go from an advanced name, and what stands for them.
ADVANCED = (
    (rf"\.({_either(DOMAINS)})", ""),
    (rf"^({_either(TRADE_NAMES)})\s+", ""),
    (rf"\s+({_either(TRADE_TAILS)})\s+.*", ""),
    (r"\(id:?\s*[0-9]+\)", ""),
    (r"[^a-z0-9\s]", " "),
    (r"\s+", " "),
)


def advanced_name(name: Column) -> Column:
    """Letters and digits of a name without domains, trade-name phrases, bracketed ids and legal words."""
    s = F.lower(F.coalesce(name, F.lit("")))
    for pattern, to in ADVANCED:
        s = F.regexp_replace(s, pattern, to)
    joined = F.array_join(F.filter(words(s), lambda x: ~x.isin(*ADVANCED_STOPS)), "")
    return F.when(F.length(joined) >= 4, joined).otherwise("")


def numeric_tokens(c: Column) -> Column:
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)")))
    return F.array_join(F.transform(F.array_sort(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"]), ",")


def core_tokens(c: Column) -> Column:
    return F.array_join(F.filter(words(clean(c)), lambda x: (F.length(x) >= 3) & ~x.isin(*CORE_STOPS)), " ")


def without_unit(c: Column) -> Column:
    return squeeze(F.regexp_replace(_spread(c), " (?:door  no|hn|h  no|hno|flat  no|plot  no) ", " "))


def street_words(c: Column, digits: bool = False) -> Column:
    return F.array_join(F.filter(words(c), lambda x: x.rlike("^[0-9]+$") if digits else ~x.rlike("^[0-9]+$")), " ")


def script_profile(c: Column) -> dict[str, Column]:
    return {"non_ascii": c.rlike(r"[^\x00-\x7F]"), "indic": c.rlike(INDIC_LETTER), "accented": c.rlike(r"[À-ɏ]")}


def latin(long_vowels: bool = False) -> dict[str, str]:
    """Latin for each letter: six scripts, or Devanagari alone with long vowels and digits."""
    if long_vowels:
        return {chr(0x0900 + k): v for k, v in (INDIC | LONG_VOWELS).items()}
    return {chr(base + k): v for base, other, lacks in SCRIPTS for k, v in (INDIC | other).items() if k not in lacks}


def transliterate(c: Column, long_vowels: bool = False) -> Column:
    """Indic letters as Latin ones, the longest first; other texts pass untouched."""
    table = F.create_map(*[F.lit(x) for pair in latin(long_vowels).items() for x in pair])
    out = c
    for letters, to in () if long_vowels else CLUSTERS:
        out = F.replace(out, F.lit(letters), F.lit(to))
    spelled = F.array_join(F.transform(F.split(out, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.when(c.rlike(INDIC_LETTER), spelled).otherwise(c)


def french_profile(name: Column, address: Column) -> dict[str, Column]:
    """Whether a name has an accent or a French legal form, and an address a French street word."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    place = F.lower(F.coalesce(address, F.lit("")))
    return {
        "accented": F.coalesce(name.rlike(f"[{FRENCH_ACCENTS}{FRENCH_ACCENTS.upper()}]"), F.lit(False)),
        "legal_form": low.rlike(f" ({'|'.join(FRENCH_FORMS)}) "),
        "street_word": place.rlike("|".join(FRENCH_STREETS)),
    }
