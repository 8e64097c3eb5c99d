"""URL filters by a temporal list join.

Lists change over time: an entry (a domain, a host, or a host with its first path segment) is added to a list
and removed from it on given dates.  These events become validity intervals, and every capture is judged
against the entries that were active when it was fetched.  A capture meets each list that ever held one of its
patterns once, and a window over interval starts and fetch times finds the last interval of that entry which began
by then, however many issues the list had.  Patterns of many captures are dealt to several windows, each with the
pattern's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.store import settle

#: Scheme, optional user, host in group 1.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Captures of a pattern in a window.
DEALT = 500
#: The first path segment in group 1.
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case, without a last dot; an empty string where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def patterns_of(url: Column) -> Column:
    """What a list may hold against this URL: the host, each parent domain of two labels or more, and host/first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    segment = F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))
    paths = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(host), parents, paths)))


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals of list entries: list, verdict, pattern, valid_from, valid_to (exclusive; null: still valid).

    events: list string, verdict string ('block' or 'allow'), pattern string, at long (seconds), active boolean.
    Of events of one list, verdict, pattern and time, one that adds wins.  Events that change nothing do not cut an
    interval.  Events with a null in any of these are ignored.  One pattern of one list has as many rows here
    as it changed, which the number of list issues bounds.
    """
    key = ["list", "verdict", "pattern"]
    last = events.dropna(subset=[*key, "at", "active"]).groupBy(*key, "at").agg(F.max("active").alias("active"))
    order = Window.partitionBy(*key).orderBy("at")
    changed = last.withColumn("_was", F.coalesce(F.lag("active").over(order), F.lit(False))).filter(F.col("active") != F.col("_was"))
    return changed.withColumn("valid_to", F.lead("at").over(order)).filter("active").select(*key, F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """Each capture with the entry that decides on it: blocked, list, pattern, valid_from, valid_to.

    captures: capture_id long, url string, fetched_at long; other columns are dropped, repeated rows stay apart.
    Of all active entries the one with the longest pattern decides; at equal length an 'allow' wins, then the
    smaller list name, then the earlier start.  A capture without a matching entry, without a URL or host, or
    without a fetch time is not blocked and has nulls.
    """
    rows = settle(captures.select("capture_id", "url", "fetched_at"), "captures", numbered="_row")
    tries = rows.filter(F.col("fetched_at").isNotNull()).select("_row", "fetched_at", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    entry = ["pattern", "list", "verdict"]
    crowd = tries.groupBy("pattern").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
    # a row for each list that holds a pattern of the captures
    lists = settle(valid.select(*entry).distinct().join(crowd, "pattern"), "entries")
    key = [*entry, "part"]
    asked = tries.join(lists, "pattern").select(*entry, F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int").alias("part"), F.col("fetched_at").alias("at"), F.lit(1).alias("side"), "_row", F.lit(None).cast("struct<valid_from: bigint, valid_to: bigint>").alias("span"))
    spans = valid.join(lists, entry).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    known = spans.select(*key, F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("_row"), F.struct(F.col("valid_from").cast("long").alias("valid_from"), F.col("valid_to").cast("long").alias("valid_to")).alias("span"))
    upto = Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = asked.unionByName(known).withColumn("span", F.last("span", ignorenulls=True).over(upto)).filter("side = 1 and span is not null and (span.valid_to is null or at < span.valid_to)")
    rank = F.struct((-F.length("pattern")).alias("short"), (F.col("verdict") != "allow").alias("blocks"), F.col("list").alias("list"), F.col("span.valid_from").alias("valid_from"), F.col("span.valid_to").alias("valid_to"), F.col("pattern").alias("pattern"))
    found = last.select("_row", rank.alias("first"))
    best = found.groupBy("_row").agg(F.min("first").alias("best"))
    return rows.join(best, "_row", "left").select(
        "capture_id", "url", "fetched_at",
        F.coalesce(F.col("best.blocks"), F.lit(False)).alias("blocked"),
        F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("valid_from"), F.col("best.valid_to").alias("valid_to"),
    )


# The tables have neither lists nor fetch times; the query derives both by a fixed rule, in SQL that Spark and DuckDB share.

DAY = 86400
FIRST = 1704067200


def fetch_times(pages: DataFrame) -> DataFrame:
    """Captures of the pages, spread over 360 days by page_id."""
    at = F.lit(FIRST) + F.pmod(F.col("page_id") * 7919, F.lit(360 * DAY))
    return pages.select(F.col("page_id").alias("capture_id"), "url", at.cast("long").alias("fetched_at"))


def sample_events(pages: DataFrame) -> DataFrame:
    """List issues for the pages' hosts, by the MD5 of the host: most hosts are never listed, some are for a while, some return; one list holds a domain, one allows some paths."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h <> ''").groupBy("h").agg(F.lit(1).alias("one"))
    draw = F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("long")
    hosts = hosts.select("h", draw.alias("d"))
    first = F.lit(FIRST) + F.pmod(F.col("d"), F.lit(300)) * DAY

    def event(frame: DataFrame, name: str, verdict: str, pattern: Column, at: Column, active: bool) -> DataFrame:
        return frame.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), pattern.alias("pattern"), at.cast("long").alias("at"), F.lit(active).alias("active"))

    some, back, paths = hosts.filter("d % 3 = 0"), hosts.filter("d % 6 = 0"), hosts.filter("d % 2 = 0")
    domain = hosts.filter("h like '%.example.org'").select(F.lit("example.org").alias("h")).groupBy("h").agg(F.lit(1).alias("one"))
    parts = [
        event(some, "spam", "block", F.col("h"), first, True),
        event(some, "spam", "block", F.col("h"), first + 40 * DAY, False),
        event(back, "spam", "block", F.col("h"), first + 90 * DAY, True),
        event(paths, "editors", "allow", F.concat("h", F.lit("/en")), first + 10 * DAY, True),
        event(domain, "region", "block", F.col("h"), F.lit(FIRST + 100 * DAY), True),
        event(domain, "region", "block", F.col("h"), F.lit(FIRST + 160 * DAY), False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORACLE = f"""
WITH host AS (
  SELECT page_id AS capture_id, url, (page_id * 7919) % {360 * DAY} + {FIRST} AS fetched_at,
    coalesce(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', ''), '') AS h,
    coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS seg, row_number() OVER () AS rn
  FROM pages),
hosts AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 4) AS BIGINT) AS d FROM host WHERE h <> ''),
valid AS (
  SELECT 'spam' AS list, true AS blocks, h AS pattern, {FIRST} + d % 300 * {DAY} AS valid_from, {FIRST} + d % 300 * {DAY} + {40 * DAY} AS valid_to FROM hosts WHERE d % 3 = 0
  UNION ALL SELECT 'spam', true, h, {FIRST} + d % 300 * {DAY} + {90 * DAY}, NULL FROM hosts WHERE d % 6 = 0
  UNION ALL SELECT 'editors', false, h || '/en', {FIRST} + d % 300 * {DAY} + {10 * DAY}, NULL FROM hosts WHERE d % 2 = 0
  UNION ALL SELECT DISTINCT 'region', true, 'example.org', {FIRST + 100 * DAY}, {FIRST + 160 * DAY} FROM hosts WHERE h LIKE '%.example.org'),
tries AS (
  SELECT DISTINCT rn, fetched_at, unnest(list_concat([h], list_transform(range(1, greatest(len(string_split(h, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(h, '.')[k:], '.')),
    CASE WHEN seg <> '' THEN [h || '/' || seg] ELSE [] END)) AS pattern
  FROM host WHERE h <> ''),
best AS (
  SELECT rn, v.*, row_number() OVER (PARTITION BY rn ORDER BY length(v.pattern) DESC, blocks, list, valid_from) AS k
  FROM tries t JOIN valid v ON v.pattern = t.pattern AND v.valid_from <= t.fetched_at AND (v.valid_to IS NULL OR t.fetched_at < v.valid_to))
SELECT capture_id, url, CAST(fetched_at AS BIGINT) AS fetched_at, coalesce(blocks, false) AS blocked, list, best.pattern, CAST(valid_from AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to
FROM host LEFT JOIN best ON host.rn = best.rn AND k = 1
"""
