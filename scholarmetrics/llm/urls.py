"""URL filters by a temporal list join (operator 2; native DataFrame operations only).

A list is a log of dated entries (key, listed_at, action, category): ``add`` puts a key on
the list, ``remove`` takes it off. Consecutive entries of a key become validity intervals
[valid_from, valid_to). A key is a domain (it covers its subdomains) or a domain with a
path prefix. Every capture is evaluated against the entries active at its fetch time: its
URL's candidate keys (all parent domains, all path prefixes) are joined to the intervals by
key and time, and the most specific active entry decides.

Only narrow rows (candidate key, url, time) take part in the as-of join; pages keep their
wide columns out of it and get the verdicts of blocked captures by (url, fetch time). A
host with a third of all captures is a skewed equi-join against few intervals, which AQE
splits; neither side is broadcast unless its size says so.

Defined results: a capture without a host or a fetch time is not blocked; an entry without
key or date is ignored; of entries of one key and time, ``remove`` prevails; repeated
entries count once; repeated captures keep their rows; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN_END = 2**62  # valid_to of an entry that nothing ended


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def candidate_keys(url: Column) -> Column:
    """Keys that can list a URL: its host and parent domains of two labels and more, and its path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    domains = F.when(
        F.size(labels) > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                    lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array(host))
    paths = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
                    lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def validity(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of a log of dated entries (times as longs)."""
    log = (
        entries.filter(F.col("key").isNotNull() & F.col("listed_at").isNotNull())
        .select("key", F.col("listed_at").cast("long").alias("listed_at"), "action", "category").distinct()
    )
    # one state per key and time: remove prevails, then the first category by name
    state = log.groupBy("key", "listed_at").agg(
        F.max(F.col("action") == "remove").alias("removed"), F.min("category").alias("category"))
    w = Window.partitionBy("key").orderBy("listed_at")
    spans = state.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(w), F.lit(OPEN_END)))
    return spans.filter(~F.col("removed")).select("key", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, fetched_at, matched_key, category, valid_from) of the blocked captures of (url, fetched_at)."""
    narrow = captures.select("url", F.col("fetched_at").cast("long").alias("fetched_at")).distinct()
    keys = narrow.select("url", "fetched_at", F.explode(candidate_keys(F.col("url"))).alias("key"))
    v = validity(entries)
    active = keys.join(v, "key").filter((F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to")))
    most = F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("key"), "category", "valid_from"))
    return active.groupBy("url", "fetched_at").agg(most.alias("m")).select(
        "url", "fetched_at", F.col("m.key").alias("matched_key"), F.col("m.category").alias("category"),
        F.col("m.valid_from").alias("valid_from"))


def evaluate(pages: DataFrame, fetched_at: Column, entries: DataFrame) -> DataFrame:
    """(_row: struct of all columns; fetched_at; blocked; matched_key; category; valid_from) per page row."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), fetched_at.cast("long").alias("_at"))
    found = verdicts(rows.select(F.col("_row.url").alias("url"), F.col("_at").alias("fetched_at")), entries)
    j = rows.join(found, (F.col("_row.url") == F.col("url")) & (F.col("_at") == F.col("fetched_at")), "left")
    return j.select("_row", F.col("_at").alias("fetched_at"), F.col("matched_key").isNotNull().alias("blocked"), "matched_key",
                    "category", "valid_from")


def url_filter(pages: DataFrame, fetched_at: Column, entries: DataFrame) -> DataFrame:
    """``pages`` without those whose URL was listed when it was fetched."""
    return evaluate(pages, fetched_at, entries).filter(~F.col("blocked")).select("_row.*")


# -- the query: capture times and a dated list derived from the pages -----------------

# The first capture (2024-01-01 UTC), seconds between captures, listed names.
FIRST_CAPTURE, STEP = 1704067200, 60
LISTED = "casino|pills|spam|adult|bets|ads"


def capture_time(page_id: Column) -> Column:
    return F.lit(FIRST_CAPTURE) + page_id * STEP


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: hosts with a listed name are added after a quarter of
    their captures, removed after three quarters, and added again at their last one; the
    ``/en`` branch of blogs is added half way."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), "page_id").filter("host <> ''").groupBy("host").agg(
        F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
    at = lambda n, d: capture_time(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * n / d).cast("long"))
    entry = lambda key, when, action, category: F.struct(
        key.alias("key"), when.alias("listed_at"), F.lit(action).alias("action"), category.alias("category"))
    host, name = F.col("host"), F.regexp_extract("host", f"({LISTED})", 1)
    named = F.array(entry(host, at(1, 4), "add", name), entry(host, at(3, 4), "remove", name), entry(host, at(1, 1), "add", name))
    branch = F.array(entry(F.concat(host, F.lit("/en")), at(1, 2), "add", F.lit("branch")))
    none = F.array().cast("array<struct<key:string,listed_at:bigint,action:string,category:string>>")
    all_ = F.concat(F.when(name != "", named).otherwise(none), F.when(host.startswith("blog."), branch).otherwise(none))
    return hosts.select(F.explode(all_).alias("e")).select("e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(pages, capture_time(F.col("page_id")), derived_list(pages))
    return found.select("_row.page_id", "_row.url", "fetched_at", "blocked", "matched_key", "category", "valid_from")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + page_id * 60 AS fetched_at,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), h AS (
  SELECT host, min(page_id) AS lo, max(page_id) AS hi, regexp_extract(host, '(casino|pills|spam|adult|bets|ads)', 1) AS name
  FROM p WHERE host <> '' GROUP BY host
), e AS (
  SELECT host AS key, 1704067200 + 60 * (lo + (hi - lo) // 4) AS listed_at, FALSE AS removed, name AS category FROM h WHERE name <> ''
  UNION SELECT host, 1704067200 + 60 * (lo + (hi - lo) * 3 // 4), TRUE, name FROM h WHERE name <> ''
  UNION SELECT host, 1704067200 + 60 * hi, FALSE, name FROM h WHERE name <> ''
  UNION SELECT host || '/en', 1704067200 + 60 * (lo + (hi - lo) // 2), FALSE, 'branch' FROM h WHERE host LIKE 'blog.%'
), s AS (
  SELECT key, listed_at, bool_or(removed) AS removed, min(category) AS category FROM e GROUP BY key, listed_at
), v AS (
  SELECT key, category, removed, listed_at AS valid_from, coalesce(lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at), 4611686018427387904) AS valid_to FROM s
), k AS (
  SELECT DISTINCT url, fetched_at, host AS key FROM p WHERE host <> ''
  UNION SELECT url, fetched_at, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM (SELECT url, fetched_at, host, unnest(range(1, len(string_split(host, '.')))) AS i FROM p WHERE host <> '')
  UNION SELECT url, fetched_at, host || '/' || array_to_string(list_slice(parts, 1, i), '/')
  FROM (SELECT url, fetched_at, host, parts, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE host <> '')
), m AS (
  SELECT k.url, k.fetched_at, v.key AS matched_key, v.category, v.valid_from,
    row_number() OVER (PARTITION BY k.url, k.fetched_at ORDER BY length(v.key) DESC, v.key DESC) AS r
  FROM k JOIN v ON k.key = v.key AND NOT v.removed AND k.fetched_at >= v.valid_from AND k.fetched_at < v.valid_to
)
SELECT p.page_id, p.url, p.fetched_at, m.matched_key IS NOT NULL AS blocked, m.matched_key, m.category, m.valid_from
FROM p LEFT JOIN m ON p.url = m.url AND p.fetched_at = m.fetched_at AND m.r = 1
"""
