"""Entity tables made from driver tables; what all queries share is stored once for each application and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import written

# Fixed values of the view: what is put around the words of a document to make names and addresses of them.
COUNTRIES = (("en", "US"), ("fr", "France"), ("es", "India"))
BRANDS = (
    "apex", "bravo", "cedar", "delta", "ember", "falcon", "granite", "harbor", "indigo", "jasper",
    "kestrel", "lumen", "meridian", "nimbus", "orchid", "pioneer", "quartz", "ridge", "summit", "tundra",
)
SUFFIXES = ("", "", " Ltd", " Pvt. Ltd.", " Inc.")
STREETS = ("St", "Street", "Rd", "Road")
UNITS = ("", "Flat No ")
LATIN, DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "अबचदएफगहइजकलमनओपखरसतउवशघयझ"
NO_LETTER = r"[^\p{L}\p{M}\p{N}]+"
#: Documents that share a line of so many characters, in one language, are taken to be one entity.
SHARED_LINE = 100

_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over ``sf_dir``: made and written to the shared folder at its first use, read from there later."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = written(make())
    return _stored[key]


def forget() -> None:
    """Stored tables are made anew at their next use, as they must be when the driver tables change."""
    _stored.clear()


def _digits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 6), 16, 10).cast("long")


def entity_id(doc_id: Column) -> Column:
    return F.concat(F.lit("S"), (doc_id % 3 + 1).cast("string"), F.lit("-"), doc_id.cast("string"))


def _one_of(items: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made from whole documents, one each; a document's number says to which of three sources it belongs.

    The twelve longest words of the whole text (the first in order of equals) give the words of name and
    address, a digest of the text gives house number and postal code, so that copies agree in them.
    A brand follows from the lengths of the two longest words. Legal suffixes, word order, zeros for o and street words vary with the number; some addresses are null,
    and names of one country are in Devanagari letters.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), NO_LETTER, " "), " "), lambda x: x != ""))
    # In order of length and letters as strings, which are compared faster than pairs are.
    ranked = F.sort_array(F.transform(words, lambda x: F.concat(F.lpad((99_999_999 - F.length(x)).cast("string"), 8, "0"), x)))
    country = F.upper("lang")
    for lang, name in COUNTRIES:
        country = F.when(F.col("lang") == lang, name).otherwise(country)
    rows = docs.select("doc_id", country.alias("country"), F.md5(text.cast("binary")).alias("d"), F.transform(F.slice(ranked, 1, 12), lambda x: F.substring(x, 9, 100_000_000)).alias("w"))

    def word(k: int) -> Column:
        return F.coalesce(F.get("w", F.lit(k - 1)), F.lit(""))

    id_ = F.col("doc_id")
    brand = _one_of(BRANDS, 7 * F.length(word(1)) + F.length(word(2)))
    name = F.when(id_ % 4 < 3, F.concat_ws(" ", brand, word(1), word(2))).otherwise(F.concat_ws(" ", word(2), word(1), brand))
    name = F.concat(name, _one_of(SUFFIXES, id_))
    name = F.when(id_ % 7 == 0, F.replace(name, F.lit("o"), F.lit("0"))).otherwise(name)
    name = F.when(F.col("country") == "India", F.translate(name, LATIN, DEVANAGARI)).otherwise(name)
    house = F.lpad((_digits(F.col("d"), 1) % 400).cast("string"), 4, "0")
    postal = F.when(F.col("country") == "India", 100_000 + _digits(F.col("d"), 7) % 90_000).otherwise(10_000 + _digits(F.col("d"), 7) % 9_000).cast("string")
    street = F.concat_ws(" ", house, word(5), word(6), _one_of(STREETS, id_))
    address = F.concat(_one_of(UNITS, F.floor(id_ / 4)), street, F.lit(", "), word(7), F.lit(" "), postal)
    return rows.select(entity_id(id_).alias("entity_id"), name.alias("business_name"), F.when(id_ % 11 > 0, address).alias("business_address"), "country")


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between a first-source document and others of its language that share a long line with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= SHARED_LINE)
    held = lines.select(entity_id(F.col("doc_id")).alias("id"), "lang", F.md5(F.col("line").cast("binary")).alias("line")).distinct()
    q = held.filter(F.col("id").startswith("S1-")).select(F.col("id").alias("entity_id"), "lang", "line")
    t = held.filter(~F.col("id").startswith("S1-")).select(F.col("id").alias("target_id"), "lang", "line")
    return q.join(t, ["lang", "line"]).select("entity_id", "target_id").distinct()


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts as entities, whose few names make large groups."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(entity_id(F.col("p_partkey")).alias("entity_id"), F.col("p_name").alias("business_name"), F.col("p_type").alias("business_address"), F.col("p_brand").alias("country"))
