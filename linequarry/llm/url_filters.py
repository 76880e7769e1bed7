"""URL filters: an as-of join of captures with dated list entries.

A list is a log of entries (list, pattern, action add or remove, at). intervals() turns the
log into disjoint validity intervals, one row per pattern with its intervals in an array, so
the join below gives at most one row per capture and pattern, whatever the list's history.
A pattern is a domain (which covers its subdomains) or a host with a path prefix of whole
segments. Each distinct (url, fetched_at) is turned into the keys that could match it: its host's
domains and path prefixes, as far as the list has patterns of so many labels or segments, so
that a very long url has no more keys than a short one. Those are joined with the patterns by equality, the
list being broadcast only if Spark finds it small, and of each pattern only the interval
with valid_from <= fetched_at < valid_to counts. Verdicts go back to the captures by
(url, fetched_at); only captures that matched anything take part in that join.

Of several active entries the longest pattern decides, then block before allow, then the
first list by name.

Defined cases: a null or hostless url has host '' and verdict none; a null fetched_at
matches nothing. Entries repeated at one instant count once, a remove after an add at the
same instant wins. Removing what isn't listed does nothing. Repeated captures each get the
verdict. An IPv6 host keeps its brackets, and an address has no domains above it. Empty lists and
empty tables work. Extra columns pass through judged() whatever their names, but for those that it
adds (host, verdict, list, pattern, valid_from, valid_to, n_active): these it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linequarry.llm.common import table

#: The dated list of the query.
ENTRIES = [
    ("spam", "spam-farm.example.org", "block", "add", "2024-02-01"),
    ("spam", "spam-farm.example.org", "block", "remove", "2024-06-15"),
    ("spam", "spam-farm.example.org", "block", "add", "2024-09-01"),
    ("spam", "tionsh.example.net", "block", "add", "2024-03-10"),
    ("spam", "tionsh.example.net", "block", "remove", "2024-08-20"),
    ("spam", "thther.example.org", "block", "add", "2023-11-05"),
    ("adult", "blog.tionble.example.com", "block", "add", "2024-05-01"),
    ("adult", "ththtion.example.net/es", "block", "add", "2024-01-20"),
    ("adult", "ththtion.example.net/es", "block", "remove", "2024-10-01"),
    ("trusted", "blog.tionsh.example.net", "allow", "add", "2024-04-01"),
    ("trusted", "m.thther.example.org", "allow", "add", "2024-07-01"),
    ("trusted", "m.thther.example.org", "allow", "remove", "2024-12-01"),
]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rows: list[tuple] = ENTRIES) -> DataFrame:
    return spark.createDataFrame(rows, "list string, pattern string, effect string, action string, at string").withColumn("at", F.to_timestamp("at"))


def intervals(log: DataFrame) -> DataFrame:
    """pattern and valid: its intervals in time order, of all lists (list, effect, valid_from, valid_to; null: still active)."""
    one = ["list", "pattern", "effect"]
    # What holds from an instant on is the last action at it, a remove if there are both.
    at = log.where("pattern IS NOT NULL AND at IS NOT NULL").groupBy(*one, "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy(*one).orderBy("at")
    turns = at.withColumn("before", F.lag("action").over(w)).where("action <> coalesce(before, 'remove')")
    spans = turns.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'")
    return spans.groupBy(F.lower("pattern").alias("pattern")).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("valid_from"), "valid_to", "list", "effect"))).alias("valid"))


def extent(patterns: DataFrame) -> tuple[int, int]:
    """The most labels of a pattern's host and the most segments of its path."""
    host = F.split("pattern", "/")[0]
    r = patterns.agg(F.max(F.size(F.split(host, r"\."))), F.max(F.size(F.split("pattern", "/")) - 1)).head()
    return r[0] or 0, r[1] or 0


def keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """The patterns that could match: the domains above the host, and the host with prefixes of its path, up to so many labels and segments."""
    names, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    address = host.rlike(r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$")
    above = F.transform(F.sequence(F.greatest(F.size(names) - labels + 1, F.lit(1)), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    prefix = lambda i: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    some = F.least(F.size(parts), F.lit(segments))
    prefixes = F.when(some > 0, F.transform(F.sequence(F.lit(1), F.greatest(some, F.lit(1))), prefix)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(address, F.array(host)).otherwise(above), prefixes))


def judged(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (url, fetched_at) with host, verdict (block, allow, none), list, pattern, valid_from, valid_to and n_active."""
    names = [c for c in captures.columns if c not in ("host", "verdict", "list", "pattern", "valid_from", "valid_to", "n_active")]
    listed = intervals(log)
    # A capture is one column here, so that no name of its own can meet ours.
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("url").alias("at_url"), F.col("fetched_at").alias("at_time"))
    asked = captures.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    asked = asked.select("url", "fetched_at", F.explode(keys(host_of(F.col("url")), path_of(F.col("url")), *extent(listed))).alias("key")).where("key <> '' AND key <> '/'")
    active = F.filter("valid", lambda v: (v["valid_from"] <= F.col("fetched_at")) & (v["valid_to"].isNull() | (F.col("fetched_at") < v["valid_to"])))
    hits = asked.join(listed, F.col("key") == F.col("pattern")).select("url", "fetched_at", "pattern", F.explode(active).alias("v"))
    rank = F.struct((-F.char_length("pattern")).alias("shorter"), (F.col("v.effect") != "block").alias("allows"), F.col("v.list").alias("list"), "pattern", "v")
    best = hits.groupBy("url", "fetched_at").agg(F.count("*").alias("n"), F.min(rank).alias("b"))
    out = rows.join(best, (F.col("at_url") == F.col("url")) & (F.col("at_time") == F.col("fetched_at")), "left")
    b = lambda c: F.col(f"b.v.{c}").alias(c)
    own = [F.col("row")[c].alias(c) for c in names]
    return out.select(*own, F.coalesce(host_of(F.col("at_url")), F.lit("")).alias("host"), F.coalesce("b.v.effect", F.lit("none")).alias("verdict"), b("list"), F.col("b.pattern").alias("pattern"), b("valid_from"), b("valid_to"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time: the id's place in a year stands in for it."""
    fetched = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.pmod("page_id", F.lit(366)) * 86400)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return judged(pages, entries(spark))


ORACLE_SQL = r"""
WITH log(list, pattern, effect, action, moment) AS (VALUES %s),
turns AS (
  SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, pattern, effect ORDER BY moment) AS before
  FROM (SELECT list, pattern, effect, max(action) AS action, moment FROM log GROUP BY ALL)),
spans AS (
  SELECT list, pattern, effect, action, moment AS valid_from,
         lead(moment) OVER (PARTITION BY list, pattern, effect ORDER BY moment) AS valid_to
  FROM turns WHERE action <> before),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id %% 366 AS INTEGER)) AS fetched_at,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)', 1)), '') AS host,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)), '') AS path
  FROM pages),
hits AS (
  SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(pattern) DESC, effect = 'allow', list) AS nth,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN spans s
    ON s.action = 'add' AND s.valid_from <= c.fetched_at AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
   AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
        OR (contains(s.pattern, '/') AND starts_with(rtrim(c.host || c.path, '/') || '/', s.pattern || '/'))))
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(h.effect, 'none') AS verdict, h.list, h.pattern,
       h.valid_from, h.valid_to, coalesce(h.n, 0) AS n_active
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.nth = 1
""" % ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
