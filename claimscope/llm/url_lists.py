"""Operator 7: URL filters as a temporal list join, in DataFrame expressions only.

List entries are dated changes (a pattern is added to or removed from a list).  Per list and pattern they become
validity intervals [from, to).  A capture is expanded to the patterns that could cover it (its host and the domains
above it, and host with each leading part of the path), joined to the intervals by pattern, and kept where the
interval holds its fetch day.  The longest pattern decides; of equal ones the allow list does.

Scale: the changes of one pattern are first reduced to one a day, so that a window over them is bounded by the
calendar; the captures' join is on the pattern alone, and AQE splits a hot one, as both sides are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and all domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def prefixes(host: Column, path: Column) -> Column:
    """host/first, host/first/second, ... of the path's non-empty segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ends = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def validity(entries: DataFrame) -> DataFrame:
    """``list``, ``pattern``, ``valid_from``, ``valid_to`` (null: still valid) from ``list``, ``pattern``, ``action``
    (add or remove) and ``day``.

    Of several changes on one day an addition counts.  A removal without an addition before it has no effect.
    Entries with a null in any of the four are ignored.
    """
    known = entries.select("list", F.lower("pattern").alias("pattern"), "action", "day").dropna()
    daily = known.groupBy("list", "pattern", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("added"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("added", 1, 0).over(order)).where("added <> was")
    spans = changes.withColumn("valid_to", F.lead("day").over(order)).where("added = 1")
    return spans.select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def active_rules(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each distinct (page_id, url, fetched): ``host``, ``n_active`` (entries active at the fetch that
    cover the URL), ``list`` and ``pattern`` of the deciding one, ``blocked``.

    A URL that is null or has no host, or a null ``fetched``, is covered by nothing and not blocked.
    """
    spans = written(validity(entries), "validity")
    src = captures.select("page_id", "url", "fetched").distinct().withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    patterns = F.when(F.col("host") != "", F.concat(domains(F.col("host")), prefixes(F.col("host"), F.lower(path_of(F.col("url"))))))
    asked = src.select("*", F.explode_outer(F.array_distinct(patterns)).alias("asked"))
    hit = (F.col("asked") == F.col("pattern")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    both = asked.join(spans, hit, "left")
    rank = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), (F.col("list") == ALLOW).alias("allows"), "pattern", "list"))
    out = both.groupBy("page_id", "url", "fetched", "host").agg(F.count("pattern").alias("n_active"), F.max(rank).alias("best"))
    return out.select("page_id", "url", "fetched", "host", "n_active", "best.list", "best.pattern", F.coalesce(F.col("best.list") == BLOCK, F.lit(False)).alias("blocked"))


def _number(text: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 7), 16, 10).cast("bigint")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day in 2023 or 2024 that follows from the page's id (the table has no fetch time)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (_number(F.col("page_id").cast("string"), "t") % 730).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts, domains and first path parts of ``pages``: added, at times removed and added
    again, on days that follow from the pattern."""
    host, path = host_of(F.col("url")), F.lower(path_of(F.col("url")))
    names = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    above = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    first = F.element_at(F.concat(prefixes(F.col("host"), F.col("path")), F.array(F.lit(""))), 1)
    p = names.select(F.explode(F.array("host", above, first)).alias("pattern")).where("pattern <> ''").distinct()
    n = _number(F.col("pattern"), "n")
    p = p.withColumns({"n": n, "list": F.when(_number(F.col("pattern"), "l") % 3 == 0, ALLOW).otherwise(BLOCK), "d1": (_number(F.col("pattern"), "a") % 400).cast("int"), "d2": (_number(F.col("pattern"), "b") % 200 + 1).cast("int")}).where("n % 4 < 3")
    first_day = F.lit("2023-01-01").cast("date")
    row = lambda action, day: F.struct(F.lit(action).alias("action"), F.date_add(first_day, day).alias("day"))
    rows = F.when(F.col("n") % 4 == 0, F.array(row("add", F.col("d1")))).when(F.col("n") % 4 == 1, F.array(row("add", F.col("d1")), row("remove", F.col("d1") + F.col("d2"))))
    rows = rows.otherwise(F.array(row("add", F.col("d1")), row("remove", F.col("d1") + F.col("d2")), row("add", F.col("d1") + F.col("d2") * 2)))
    return p.select("list", "pattern", F.inline(rows))


def op7_url_lists(spark, sf_dir: str) -> DataFrame:
    """page_id, url, fetched, host, n_active, list, pattern and blocked of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = active_rules(dated_captures(pages), derived_entries(pages))
    return out.withColumn("fetched", F.col("fetched").cast("string"))


_N = "('0x' || substr(md5('{1}' || {0}), 1, 7))::BIGINT"
OP7_SQL = f"""
WITH caps AS (SELECT DISTINCT page_id, url, (DATE '2023-01-01' + ({_N.format("page_id::VARCHAR", "t")} % 730)::INTEGER)::DATE AS fetched FROM pages),
  parts AS (SELECT *, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS segs FROM caps),
  asked AS (SELECT page_id, url, fetched, host, CASE WHEN host <> '' THEN list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(list_slice(segs, 1, i), '/')))) END AS patterns FROM parts),
  names AS (SELECT DISTINCT unnest([host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1), CASE WHEN len(segs) > 0 THEN host || '/' || segs[1] END]) AS pattern FROM parts WHERE host <> ''),
  picked AS (SELECT pattern, {_N.format("pattern", "n")} % 4 AS n, CASE WHEN {_N.format("pattern", "l")} % 3 = 0 THEN 'allow' ELSE 'block' END AS list,
    {_N.format("pattern", "a")} % 400 AS d1, {_N.format("pattern", "b")} % 200 + 1 AS d2 FROM names WHERE pattern <> ''),
  spans AS (SELECT list, pattern, DATE '2023-01-01' + d1::INTEGER AS f, CASE WHEN n > 0 THEN DATE '2023-01-01' + (d1 + d2)::INTEGER END AS t FROM picked WHERE n < 3
    UNION ALL SELECT list, pattern, DATE '2023-01-01' + (d1 + d2 * 2)::INTEGER, NULL FROM picked WHERE n = 2),
  wanted AS (SELECT * EXCLUDE (patterns), unnest(patterns) AS asked FROM asked),
  hits AS (SELECT w.page_id, w.url, w.fetched, s.list, s.pattern FROM wanted w JOIN spans s ON w.asked = s.pattern AND w.fetched >= s.f AND (s.t IS NULL OR w.fetched < s.t)),
  best AS (SELECT page_id, url, fetched, count(*) AS n_active, arg_max({{'list': list, 'pattern': pattern}}, {{'a': length(pattern), 'b': list = 'allow', 'c': pattern}}) AS m FROM hits GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched::VARCHAR AS fetched, p.host, coalesce(b.n_active, 0) AS n_active, b.m.list AS list, b.m.pattern AS pattern, coalesce(b.m.list = 'block', false) AS blocked
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url AND p.fetched = b.fetched
"""
