"""URL filters by a temporal list join; DataFrame functions only.

List entries (kind, pattern, category, action add or remove, listed_at) become validity intervals: an entry holds until the
next one of the same pattern and category. A capture's URL gives its keys (the URL itself, its host, its domains of every
number of labels, its host with every prefix of path segments); an as-of join finds the intervals that hold at its fetch time.
A host is what follows the last @ before the path, without port or dots at its end; an address (dotted numbers, brackets) has no domains.

Captures are aggregated by (id, url, time) first. Only the two sides' keys are joined, by equality and interval, so that a hot
host is split by adaptive execution; Spark broadcasts the intervals only where their measured size is under its threshold.

Defined results: a null URL, a null time or a URL that isn't one matches nothing and is not blocked; entries with a null field
are not used; of entries of one pattern, category and time an add wins; rows that repeat come out as often; empty tables give
empty results, and an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
#: Hosts that are addresses, and so have no domains: dotted numbers, and what brackets hold.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
KINDS = ("url", "host", "domain", "path")


def url_keys(url: Column) -> Column:
    """array<struct<kind, pattern>> of a URL, without repeats."""
    part = lambda i: F.regexp_extract(url, URL, i)
    scheme, host, port, path, query = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"\.+$", ""), part(3), F.regexp_replace(part(4), "/+$", ""), part(5)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    whole = F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, query)
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    labels, segments = F.split(host, r"\."), F.split(F.when(path.startswith("/"), F.substr(path, F.lit(2))), "/")
    domains = F.when(host.rlike(ADDRESS), none).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, -i, i), "."))))
    named = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: F.element_at(segments, i) != "")
    paths = F.transform(named, lambda i: key("path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))))
    keys = F.concat(F.array(key("url", whole), key("host", host)), domains, F.coalesce(paths, none))
    return F.when(host != "", F.array_distinct(F.filter(keys, lambda k: k["pattern"] != "")))


def validity(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to (null: still valid)."""
    used = entries.select("kind", "pattern", "category", "action", F.col("listed_at").cast("timestamp").alias("at"))
    used = used.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")).dropna().groupBy("kind", "pattern", "category", "at").agg(F.min("action").alias("action"))
    by = Window.partitionBy("kind", "pattern", "category").orderBy("at")
    return used.select("kind", "pattern", "category", F.col("at").alias("valid_from"), F.lead("at").over(by).alias("valid_to"), "action").where(F.col("action") == "add").drop("action")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, url, fetched_at, blocked, n_active, categories (sorted, comma-joined), matched (the patterns, likewise)."""
    rows = captures.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    rows = rows.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    keyed = rows.withColumn("key", F.explode_outer(url_keys(F.col("url")))).select("page_id", "url", "fetched_at", "copies", F.col("key.kind").alias("kind"), F.col("key.pattern").alias("pattern"))
    v = validity(entries)
    on = (keyed.kind == v.kind) & (keyed.pattern == v.pattern) & (keyed.fetched_at >= v.valid_from) & (v.valid_to.isNull() | (keyed.fetched_at < v.valid_to))
    hit = F.when(v.category.isNotNull(), F.concat_ws(":", v.kind, v.pattern))
    found = keyed.join(v, on, "left").groupBy(keyed.page_id, keyed.url, keyed.fetched_at, keyed.copies).agg(
        F.count(v.category).alias("n_active"), F.array_join(F.array_sort(F.collect_set(v.category)), ",").alias("categories"), F.array_join(F.array_sort(F.collect_set(hit)), ",").alias("matched"))
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return one.select("page_id", "url", "fetched_at", (F.col("n_active") > 0).alias("blocked"), "n_active", "categories", "matched")


ENTRY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "pattern", "category", "action")] + [T.StructField("listed_at", T.TimestampType())])


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch time: the query takes a day of two years by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).cast("timestamp").alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list for the query: three in ten, by a hash, of the pages' hosts, of their domains of two and more labels, of their prefixes of up to two path segments and of their URLs without port or query are listed, dropped and listed again on days that follow from it."""
    names = pages.select(F.explode(url_keys(F.col("url"))).alias("k")).select("k.*").distinct()
    labels, steps = F.size(F.split("pattern", r"\.")), F.size(F.split("pattern", "/"))
    # a URL's pattern has the scheme's two slashes before the host's
    wanted = (F.col("kind") == "host") | ((F.col("kind") == "domain") & (labels >= 2)) | ((F.col("kind") == "path") & (steps <= 3)) | ((F.col("kind") == "url") & ~F.col("pattern").contains("?"))
    category = F.when(F.col("kind") == "host", "spam").when(F.col("kind") == "domain", "malware").when(F.col("kind") == "path", "adult").otherwise("phishing")
    patterns = names.where(wanted).withColumn("category", category)
    h = F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "pattern")), 1, 6), 16, 10).cast("long")
    listed = patterns.withColumn("h", h).where(F.col("h") % 10 < 3)
    day = lambda x: F.date_add(F.lit("2024-01-01").cast("date"), x.cast("int")).cast("timestamp")
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("h") % 300).alias("listed_at")),
        F.struct(F.lit("remove").alias("action"), day(F.col("h") % 300 + 60 + F.col("h") % 97).alias("listed_at")),
        F.struct(F.lit("add").alias("action"), day(F.col("h") % 300 + 300 + F.col("h") % 89).alias("listed_at")),
    )
    return listed.withColumn("e", F.explode(events)).select("kind", "pattern", "category", "e.action", "e.listed_at")


SQL = r"""
WITH parts AS (
    SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS TIMESTAMP) AS fetched_at,
           lower(regexp_extract(url, '{u}', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '{u}', 2)), '\.+$', '') AS host, regexp_extract(url, '{u}', 3) AS port,
           regexp_replace(regexp_extract(url, '{u}', 4), '/+$', '') AS path, regexp_extract(url, '{u}', 5) AS query
    FROM pages),
cut AS (SELECT *, string_split(host, '.') AS labels, string_split(substr(path, 2), '/') AS segments FROM parts WHERE host <> ''),
keys AS (
    SELECT page_id, url, fetched_at, 'url' AS kind, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || path || query AS pattern FROM cut UNION
    SELECT page_id, url, fetched_at, 'host', host FROM cut UNION
    SELECT page_id, url, fetched_at, 'domain', array_to_string(list_slice(labels, -i, -1), '.') FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM cut WHERE NOT regexp_matches(host, '{a}')) UNION
    SELECT page_id, url, fetched_at, 'path', host || '/' || array_to_string(list_slice(segments, 1, i), '/') FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM cut WHERE starts_with(path, '/')) WHERE segments[i] <> ''),
hashed AS (
    SELECT kind, pattern, CASE kind WHEN 'host' THEN 'spam' WHEN 'domain' THEN 'malware' WHEN 'path' THEN 'adult' ELSE 'phishing' END AS category, CAST('0x' || substr(md5(kind || ':' || pattern), 1, 6) AS INTEGER) AS h
    FROM (SELECT DISTINCT kind, pattern FROM keys)
    WHERE kind = 'host' OR (kind = 'domain' AND contains(pattern, '.')) OR (kind = 'path' AND len(string_split(pattern, '/')) <= 3) OR (kind = 'url' AND NOT contains(pattern, '?'))),
entries AS (
    SELECT kind, pattern, category, 'add' AS action, DATE '2024-01-01' + CAST(h % 300 AS INTEGER) AS listed FROM hashed WHERE h % 10 < 3 UNION
    SELECT kind, pattern, category, 'remove', DATE '2024-01-01' + CAST(h % 300 + 60 + h % 97 AS INTEGER) FROM hashed WHERE h % 10 < 3 UNION
    SELECT kind, pattern, category, 'add', DATE '2024-01-01' + CAST(h % 300 + 300 + h % 89 AS INTEGER) FROM hashed WHERE h % 10 < 3),
spans AS (SELECT *, lead(listed) OVER (PARTITION BY kind, pattern, category ORDER BY listed) AS until FROM (SELECT kind, pattern, category, listed, min(action) AS action FROM entries GROUP BY ALL)),
hits AS (SELECT k.page_id, s.kind, s.pattern, s.category FROM keys k JOIN spans s ON k.kind = s.kind AND k.pattern = s.pattern AND s.action = 'add' AND k.fetched_at >= s.listed AND (s.until IS NULL OR k.fetched_at < s.until)),
sums AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, array_to_string(list_sort(list(DISTINCT kind || ':' || pattern)), ',') AS matched FROM hits GROUP BY 1)
SELECT p.page_id, p.url, p.fetched_at, coalesce(n, 0) > 0 AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(categories, '') AS categories, coalesce(matched, '') AS matched
FROM parts p LEFT JOIN sums USING (page_id)
""".replace("{u}", URL).replace("{a}", ADDRESS)
