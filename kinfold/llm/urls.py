"""URL filters: dated list entries as validity intervals, joined as of each capture's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .spark import cut, fresh, small

SCHEME = r"^[a-z][a-z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower-case host without user, port or closing dot; empty if there is none."""
    found = F.regexp_extract(F.lower(url), SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"\.+$", "")


def path(url: Column) -> Column:
    """Path without query and fragment, without closing slashes."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries (list, kind, key, action, day).

    An ``add`` opens an interval at its day, the next entry of that list, kind and key ends it; of
    entries of one day, ``remove`` wins. Entries with a null anywhere are ignored. kind: ``domain``
    (a host and all below it), ``prefix`` (host and path, whole segments) or ``url`` (host, path).
    """
    known = entries.select("list", "kind", F.col("key"), "action", F.col("day").cast("timestamp").alias("from")).dropna()
    daily = known.groupBy("list", "kind", "key", "from").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "key").orderBy("from")
    until = F.coalesce(F.lead("from").over(order), F.lit("9999-12-31").cast("timestamp"))
    return daily.withColumn("until", until).filter("action = 'add'").select("list", "kind", "key", "from", "until")


def keys(url: Column) -> Column:
    """Array of (kind, key) under which a URL can be listed."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = F.split(path(url), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host(url), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key")))
    whole = F.array(F.struct(F.lit("url").alias("kind"), F.concat(host(url), path(url)).alias("key")))
    return F.array_distinct(F.concat(domains, prefixes, whole))


#: Days of a bucket of time; a key's intervals meet the captures of their own buckets only.
BUCKET_DAYS = 32


def _bucket(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (86_400 * BUCKET_DAYS))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with url, fetched_at) and host, lists (sorted names of those that list it at that time), blocked.

    A capture's verdict depends on url and time alone, so keys are made once for each distinct pair.
    The join is by key and bucket of time, so that a long history at a host with many captures makes
    no more rows than its entries of a few weeks do; intervals are dealt to the buckets between the
    first and the last capture. They are broadcast if they are small, else Spark splits a hot key.

    Null or unparsable URLs and null times are listed nowhere; repeated captures each get their row; an
    empty list blocks nothing, an empty table gives an empty result. Columns of ``captures`` that have one
    of the three new names are replaced.
    """
    asked = captures.select("url", "fetched_at").dropna().distinct().filter(host(F.col("url")) != "")
    span = captures.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi"))
    inside = intervals(entries).crossJoin(F.broadcast(span)).filter("from <= hi AND until > lo")
    days = F.sequence(_bucket(F.greatest("from", "lo")), _bucket(F.least("until", "hi")))
    active = cut(inside.select("list", "kind", "key", "from", "until", F.explode(days).alias("bucket")))
    url, time, names = fresh(captures, "url", "time", "lists")
    hit = (
        asked.select("url", "fetched_at", _bucket(F.col("fetched_at")).alias("bucket"), F.explode(keys(F.col("url"))).alias("k"))
        .select("url", "fetched_at", "bucket", "k.kind", "k.key")
        .join(small(active), ["kind", "key", "bucket"])
        .filter("fetched_at >= from AND fetched_at < until")
        .groupBy(F.col("url").alias(url), F.col("fetched_at").alias(time))
        .agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias(names))
    )
    rows = captures.join(hit, (F.col("url") == F.col(url)) & (F.col("fetched_at") == F.col(time)), "left")
    kept = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in ("host", "lists", "blocked")]
    return rows.select(*kept, F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce(names, F.lit("")).alias("lists"), F.col(names).isNotNull().alias("blocked"))


# Names of the example lists, and how many dated entries each host, site section and page gets.
LISTS = ("legal", "malware", "optout", "pharma", "phishing", "spam", "tracker", "violence")
PER_HOST, PER_SECTION, PER_PAGE = 24, 4, 1


def _digit(digest: Column, at: int, n: int = 1) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("int")


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries (list, kind, key, action, day) made up from the hosts, first path segments and URLs of ``pages``.

    A digest of a key and a number gives an entry's list, action and day in 2024; keys whose own
    digest begins with 0 to 4 have entries. The pages have no lists of their own.
    """
    urls = pages.select("url").filter(host(F.col("url")) != "").distinct()
    at, first = host(F.col("url")), F.split(path(F.col("url")), "/")
    section = F.concat(host(F.col("url")), F.lit("/"), F.coalesce(F.get(first, F.lit(1)), F.lit("")))
    some = [(F.lit("domain"), at, PER_HOST), (F.lit("prefix"), F.regexp_replace(section, "/$", ""), PER_SECTION), (F.lit("url"), F.concat(at, path(F.col("url"))), PER_PAGE)]
    keyed = urls.select(F.explode(F.array(*[F.struct(k.alias("kind"), x.alias("key"), F.lit(n).alias("n")) for k, x, n in some])).alias("x")).select("x.*").distinct()
    listed = keyed.filter(F.substring(F.md5(F.concat_ws(":", "kind", "key").cast("binary")), 1, 1) < "5")
    numbered = listed.select("kind", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    digest = F.md5(F.concat_ws(":", "kind", "key", F.col("k").cast("string")).cast("binary"))
    return numbered.withColumn("d", digest).select(
        F.element_at(F.array(*map(F.lit, LISTS)), _digit(F.col("d"), 1) % len(LISTS) + 1).alias("list"), "kind", "key",
        F.when(_digit(F.col("d"), 2) < 8, "add").otherwise("remove").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), _digit(F.col("d"), 3, 4) % 366).cast("string").alias("day"),
    )


def captured(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; a page's day in 2024 follows from its id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


_HOST = rf"coalesce(regexp_replace(regexp_extract(lower(url), '{SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '')"
_PATH = "coalesce(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '')"

SQL = rf"""
WITH captures AS (
  SELECT page_id, url, ('2024-01-01'::DATE + (((page_id * 37) % 366 + 366) % 366)::INTEGER)::TIMESTAMP AS fetched_at, {_HOST} AS host, {_PATH} AS path FROM pages
), keyed AS (
  SELECT DISTINCT kind, key, n FROM (
    SELECT 'domain' AS kind, host AS key, {PER_HOST} AS n FROM captures WHERE host <> ''
    UNION ALL SELECT 'prefix', regexp_replace(host || '/' || coalesce(string_split(path, '/')[2], ''), '/$', ''), {PER_SECTION} FROM captures WHERE host <> ''
    UNION ALL SELECT 'url', host || path, {PER_PAGE} FROM captures WHERE host <> '')
), entries AS (
  SELECT [{", ".join(f"'{x}'" for x in LISTS)}][(('0x' || d[1:1])::INTEGER % {len(LISTS)} + 1)::INTEGER] AS list, kind, key, CASE WHEN ('0x' || d[2:2])::INTEGER < 8 THEN 'add' ELSE 'remove' END AS action,
    ('2024-01-01'::DATE + ('0x' || d[3:6])::INTEGER % 366)::TIMESTAMP AS day
  FROM (SELECT kind, key, md5(kind || ':' || key || ':' || unnest(range(1, n + 1))) AS d FROM keyed WHERE md5(kind || ':' || key) < '5')
), daily AS (SELECT list, kind, key, day AS starts, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(starts, 1, '9999-12-31'::TIMESTAMP) OVER (PARTITION BY list, kind, key ORDER BY starts) AS ends FROM daily),
hits AS (
  SELECT c.page_id, c.url, s.list FROM captures c JOIN spans s ON s.action = 'add' AND c.fetched_at >= s.starts AND c.fetched_at < s.ends AND c.host <> '' AND CASE s.kind
    WHEN 'domain' THEN c.host = s.key OR ends_with(c.host, '.' || s.key)
    WHEN 'prefix' THEN starts_with(c.host || c.path || '/', s.key || '/')
    ELSE c.host || c.path = s.key END
), lists AS (SELECT page_id, url, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(l.lists, '') AS lists, l.lists IS NOT NULL AS blocked
FROM captures c LEFT JOIN lists l ON c.page_id IS NOT DISTINCT FROM l.page_id AND c.url IS NOT DISTINCT FROM l.url
"""
