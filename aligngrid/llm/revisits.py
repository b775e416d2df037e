"""WARC: resolution of not-modified revisits by an as-of join to the latest earlier full response.

Captures of one canonical url are cut into blocks of time. Inside a block a window finds the latest full response before
each capture; the last full response of each block is carried to the blocks after it by a window over blocks, not over
captures. So a url with a third of all captures is dealt over its blocks, and only numbers take part: headers
and payloads are joined afterwards, by the number of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm.common import table

#: Header fields that a 304 answer may replace, and query parameters that name no resource.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid|sessionid)(?:=|$)"
#: Seconds of a block of captures.
BLOCK = 6 * 3600


def canonical_url(url: Column) -> Column:
    """A key for urls of one resource: no scheme, `www.`, default port, fragment, tracking parameters or trailing slash.

    Host in lower case, parameters sorted. Null stays null; a text without `://` is its own key.
    """
    parts = lambda i: F.regexp_extract(url, r"(?s)^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.regexp_replace(F.lower(parts(1)), r":(?:80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(parts(2), r"/index\.html?$", "/"), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(parts(3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query)).otherwise(url)


def latest_full(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """(record_id, earlier_id) for rows (key, at bigint seconds, record_id, full boolean): the last full one before each.

    Earlier means a lower (at, record_id). Rows without a key or a time have none.
    """
    rows = captures.where("key is not null and at is not null").withColumn("block", F.floor(F.col("at") / block))
    this = F.when(F.col("full"), F.col("record_id"))
    before = Window.partitionBy("key", "block").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("key", "block", "record_id", F.last(this, ignorenulls=True).over(before).alias("inside"))
    ends = rows.groupBy("key", "block").agg(F.max(F.when(F.col("full"), F.struct("at", "record_id"))).alias("end"))
    over = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "block", F.last("end.record_id", ignorenulls=True).over(over).alias("carried"))
    return inside.join(carried, ["key", "block"]).select("record_id", F.coalesce("inside", "carried").alias("earlier_id"))


def _named(headers: Column) -> Column:
    """Entries of a header map by lower-case name; of names that differ in case only, the first in sorted order."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.array_sort(F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(
        F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e)))))


def merged_headers(stored: Column, answer: Column, permitted: list[str] = PERMITTED) -> Column:
    """Header map of the stored response with the permitted fields of the not-modified answer; lower-case, sorted names."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    new = F.filter(F.coalesce(_named(answer), none), lambda e: e["key"].isin(permitted))
    old = F.filter(F.coalesce(_named(stored), none), lambda e: ~F.exists(new, lambda n: n["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(old, new)))


def _field(headers: Column, name: str) -> Column:
    return F.get(F.filter(_named(headers), lambda e: e["key"] == name), F.lit(0))["value"]


def resolved(records: DataFrame, *, permitted: list[str] = PERMITTED, block: int = BLOCK) -> DataFrame:
    """The revisits of `records` with what they stand for.

    records: record_id bigint, url string, at bigint (seconds), kind (`response` or `revisit`), status int, headers
    map<string,string>, payload string; further columns are ignored. A full response is a `response` of status 200.

    Result: record_id, canonical, earlier_id, outcome, headers, payload. outcome is `missing` (no earlier full response),
    `resolved` (the validators agree: the etag where both have one, by weak comparison, else last-modified),
    `changed` (they differ) or `unchecked` (no validator on both sides). Headers and payload are merged for `resolved` and
    `unchecked`, else they are the revisit's own headers and null. Repeated rows of one record_id count once (the first
    by url, time and kind); records without a url, time or number are `missing`; an empty table gives an empty result.
    """
    once = records.select("record_id", "url", "at", "kind", "status", "headers", "payload")
    order = F.struct("url", "at", "kind", "status")
    unique = once.where("record_id is not null").groupBy("record_id").agg(F.min_by(
        F.struct("url", "at", "kind", "status", "headers", "payload"), order).alias("r"),
        F.first(F.lit(1))).select("record_id", "r.*")
    rows = unique.union(once.where("record_id is null"))
    rows = rows.withColumn("canonical", canonical_url(F.col("url")))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    near = latest_full(rows.select(F.col("canonical").alias("key"), "at", "record_id", F.coalesce(full, F.lit(False)).alias(
        "full")).where("record_id is not null"), block)
    again = rows.where("kind = 'revisit'").join(near, "record_id", "left").drop("payload")
    stored = rows.where(full & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("earlier_id"), F.col("headers").alias("stored"), "payload")
    both = again.join(stored, "earlier_id", "left")
    tag = lambda h: F.regexp_replace(_field(F.col(h), "etag"), "^W/", "")
    modified = lambda h: _field(F.col(h), "last-modified")
    same = F.coalesce(tag("headers") == tag("stored"), modified("headers") == modified("stored"))
    both = both.withColumn("outcome", F.when(F.col("earlier_id").isNull(), "missing").when(same.isNull(), "unchecked").when(
        same, "resolved").otherwise("changed"))
    good = F.col("outcome").isin("resolved", "unchecked")
    return both.select("record_id", "canonical", "earlier_id", "outcome", F.when(good, merged_headers(
        F.col("stored"), F.col("headers"), permitted)).otherwise(merged_headers(F.col("headers"), F.lit(None).cast(
            "map<string,string>"), permitted)).alias("headers"), F.when(good, F.col("payload")).alias("payload"))


def captures(pages: DataFrame) -> DataFrame:
    """Records made from pages: a full response of each, and two later revisits of it by other spellings of its url.

    The times and tags are functions of the page number: some revisits come before any response, some carry another tag, some none.
    """
    p = F.col("page_id")
    start = F.lit(1_700_000_000) + (p * 7919) % 4_000_000
    base = F.regexp_replace("url", r"[?#].*$", "")
    tag = lambda text: F.concat(F.lit('"'), F.md5(text), F.lit('"'))
    html = F.coalesce("html", F.lit(""))
    stamp = lambda t: F.concat(F.lit("t"), t.cast("string"))
    response = pages.select(
        (p * 4).alias("record_id"), "url", start.alias("at"), F.lit("response").alias("kind"),
        F.when(p % 11 == 0, 404).otherwise(200).alias("status"), F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(html).cast("string"),
            F.lit("ETag"), F.when(p % 5 == 0, F.lit(None)).otherwise(tag(html)), F.lit("Last-Modified"),
            F.when(p % 10 == 0, F.lit(None)).otherwise(stamp(start)), F.lit("Date"), stamp(start)).alias("headers"),
        F.col("html").alias("payload"))
    first, second = start + 3600 * (1 + p % 5), start - 1800 + 90_000 * (p % 4)
    again = pages.select(
        (p * 4 + 1).alias("record_id"), F.concat(base, F.lit("/?utm_source=feed#top")).alias("url"), first.alias("at"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(
            F.lit("etag"), F.when(p % 7 == 0, tag(F.lit("new"))).otherwise(F.concat(F.lit("W/"), tag(html))),
            F.lit("Last-Modified"), stamp(start), F.lit("date"), stamp(first), F.lit("Cache-Control"), F.lit("max-age=60"),
            F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    late = pages.select(
        (p * 4 + 2).alias("record_id"), F.regexp_replace(base, "^https?://", "https://www.").alias("url"),
        second.alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(
            F.lit("Date"), stamp(second), F.lit("Set-Cookie"), F.lit("a=1")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return response.union(again).union(late)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every revisit of a page stands for; headers as `name: value` lines, the payload by its digest and length."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = resolved(captures(pages))
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical", "earlier_id", "outcome", lines.alias("headers"),
                      F.md5("payload").alias("payload_md5"), F.length("payload").cast("long").alias("payload_chars"))


ORACLE = {"op9_revisits": r"""
WITH base AS (SELECT page_id AS p, url, coalesce(html, '') AS html, html AS payload,
  1700000000 + (page_id * 7919) % 4000000 AS s, regexp_replace(url, '[?#].*$', '') AS b FROM pages),
recs AS (
  SELECT p * 4 AS record_id, url, s AS ts, 'response' AS kind, CASE WHEN p % 11 = 0 THEN 404 ELSE 200 END AS status,
    CASE WHEN p % 5 <> 0 THEN '"' || md5(html) || '"' END AS etag, CASE WHEN p % 10 <> 0 THEN 't' || s END AS modified,
    payload FROM base
  UNION ALL SELECT p * 4 + 1, b || '/?utm_source=feed#top', s + 3600 * (1 + p % 5), 'revisit', 304,
    CASE WHEN p % 7 = 0 THEN '"' || md5('new') || '"' ELSE 'W/"' || md5(html) || '"' END, 't' || s, NULL FROM base
  UNION ALL SELECT p * 4 + 2, regexp_replace(b, '^https?://', 'https://www.'), s - 1800 + 90000 * (p % 4), 'revisit', 304,
    NULL, NULL, NULL FROM base),
cut AS (SELECT *, regexp_extract(url, '^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS h,
  regexp_extract(url, '^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS pa,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS q FROM recs),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(h), ':(?:80|443)?$', ''), '^www\.', '') ||
  regexp_replace(regexp_replace(pa, '/index\.html?$', '/'), '/+$', '') ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM cut),
linked AS (SELECT r.record_id, r.canonical, r.ts, r.etag, r.modified, f.record_id AS earlier_id, f.etag AS s_etag,
    f.modified AS s_modified, f.ts AS s_ts, f.payload,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS nth
  FROM keyed r LEFT JOIN keyed f ON f.canonical = r.canonical AND f.kind = 'response' AND f.status = 200
    AND (f.ts < r.ts OR (f.ts = r.ts AND f.record_id < r.record_id)) WHERE r.kind = 'revisit'),
told AS (SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', ''), modified = s_modified) AS same
  FROM linked WHERE nth = 1),
out AS (SELECT *, CASE WHEN earlier_id IS NULL THEN 'missing' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'resolved'
  ELSE 'changed' END AS outcome FROM told)
SELECT record_id, canonical, earlier_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN concat_ws(chr(10),
      CASE WHEN record_id % 4 = 1 THEN 'cache-control: max-age=60' END,
      'content-length: ' || length(coalesce(payload, '')), 'content-type: text/html', 'date: t' || ts,
      'etag: ' || CASE WHEN record_id % 4 = 1 THEN etag ELSE s_etag END,
      'last-modified: ' || CASE WHEN record_id % 4 = 1 THEN modified ELSE s_modified END)
    WHEN record_id % 4 = 1 THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: 0', 'date: t' || ts,
      'etag: ' || etag, 'last-modified: ' || modified)
    ELSE concat_ws(chr(10), 'date: t' || ts, 'set-cookie: a=1') END AS headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN md5(payload) END AS payload_md5,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN length(payload) END AS payload_chars
FROM out"""}

QUERIES = {"op9_revisits": op9_revisits}
