"""Resolution of not-modified revisits in web archives.

A revisit record (a 304 answer) has no body.  Each is joined, as of its time, to
the latest earlier full response of the same canonical URL.  If its validators
agree with that response (entity tag by weak comparison, else last-modified),
the response's body is its body, and its headers are the response's, replaced
by those that a 304 answer may update.

The as-of join keeps hot URLs apart: time is cut into stretches of about
``ROWS_PER_STRETCH`` records, wherever in time they lie (ranges that Spark samples); inside (url, stretch) a window carries the latest
response forward, the last response of each stretch is carried into the
following ones by a window over stretch summaries, so no task holds all records
of a URL.  Only validators and headers travel through it; bodies are joined
afterwards by record id, for resolved revisits alone.

Edge cases: a response at the very time of a revisit is not earlier; of
responses at one time the greatest record id counts; a null URL matches
nothing; a null time is reported as ``missing``; a revisit without validators
is ``unverified`` and gets no body; repeated rows are resolved each; records of one
time are never cut apart; long bodies and header values are kept whole; of the table only
the named columns are read, so others may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

ROWS_PER_STRETCH = 1_000_000
# fixed values: header fields that a 304 answer may update
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# fixed values: query parameters that do not name content
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.`` and ``m.`` hosts, default ports, fragments, tracking parameters and
    a trailing slash do not tell pages apart; host letters are lowered."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^(www\.|m\.)", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def verdict(etag: Column, modified: Column, old_id: Column, old_etag: Column, old_modified: Column) -> Column:
    """The entity tag decides if the revisit has one, else last-modified."""
    return (F.when(old_id.isNull(), "missing")
            .when(etag.isNotNull(), F.when(weak(etag) == weak(old_etag), "resolved").otherwise("mismatch"))
            .when(modified.isNotNull(),
                  F.when(modified == old_modified, "resolved").otherwise("mismatch"))
            .otherwise("unverified"))


def merge_headers(old: Column, new: Column) -> Column:
    """The response's header map with the permitted ones of the revisit."""
    allowed = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def as_of(records: DataFrame, rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """Revisits with the validators and headers (struct ``old``) of the latest
    earlier response; null where there is none."""
    stretches = max(1, -(-records.count() // rows_per_stretch))
    old = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    full = F.col("kind") == "response"
    rows = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    rows = rows.where("url is not null and ts is not null")
    if stretches > 1:  # ranges of times with about as many rows each; equal times stay together
        dealt = rows.repartitionByRange(stretches, "ts").withColumn("stretch", F.spark_partition_id())
        rows = stored(dealt, "stretches")
    else:
        rows = rows.withColumn("stretch", F.lit(0))
    # a revisit sorts before the responses of its time, so these are not earlier
    order = [F.col("ts"), full.cast("int"), F.col("record_id")]
    near = Window.partitionBy("url", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("near", F.last(F.when(full, old), ignorenulls=True).over(near)).where(~full)
    # per (url, stretch), also those without a response, the last response in it
    last = F.when(full, F.struct("ts", "record_id"))
    marks = rows.groupBy("url", "stretch").agg(F.max_by(F.when(full, old), last).alias("end"))
    far = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url", "stretch", F.last("end", ignorenulls=True).over(far).alias("far"))
    joined = here.join(carried, ["url", "stretch"], "left")
    return joined.select("record_id", "url", "ts", "etag", "last_modified", "headers",
                         F.coalesce("near", "far").alias("old"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, ts, response_id, status, headers, body.

    ``records``: record_id, url (canonical), ts, kind ('response' or 'revisit'),
    etag, last_modified, headers (map of lower-case names), body.
    """
    found = as_of(records).select(
        "record_id", "url", "ts", F.col("old.record_id").alias("response_id"),
        verdict(F.col("etag"), F.col("last_modified"), F.col("old.record_id"), F.col("old.etag"),
                F.col("old.last_modified")).alias("status"),
        F.col("headers").alias("own"), F.col("old.headers").alias("theirs"))
    good = F.col("status") == "resolved"
    found = found.select("record_id", "url", "ts", "response_id", "status",
                         F.when(good, merge_headers(F.col("theirs"), F.col("own"))).otherwise(F.col("own"))
                         .alias("headers"))
    lost = records.where("kind = 'revisit' and (url is null or ts is null)").select(
        "record_id", "url", "ts", F.lit(None).cast("long").alias("response_id"),
        F.lit("missing").alias("status"), "headers", F.lit(None).cast("string").alias("body"))
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "body")
    good_ones = found.where(good).join(bodies.dropDuplicates(["response_id"]), "response_id", "left")
    others = found.where(~good).withColumn("body", F.lit(None).cast("string"))
    return good_ones.select(*others.columns).unionByName(others).unionByName(lost)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records of each page: its full response at time page_id, and a later
    not-modified answer, some of which carry a weak, a changed or no entity tag."""
    p = F.col("page_id").cast("long")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    modified = F.concat(F.lit("day "), F.floor(p / 7).cast("string"))
    base = pages.select(p.alias("page_id"), canonical_url(F.col("url")).alias("url"), tag.alias("tag"),
                        modified.alias("modified"), F.col("html").alias("body"))
    n = F.col("page_id")
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    responses = base.select(
        (n * 2).alias("record_id"), "url", n.alias("ts"), F.lit("response").alias("kind"),
        F.col("tag").alias("etag"), F.col("modified").alias("last_modified"),
        F.create_map(F.lit("etag"), F.col("tag"), F.lit("date"), text("t", n.cast("string")),
                     F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")
                     ).alias("headers"), "body")
    etag = (F.when(n % 8 == 1, text("W/", F.col("tag"))).when(n % 8 == 2, F.lit('"changed"'))
            .when((n % 8 == 3) | (n % 8 == 4), F.lit(None)).otherwise(F.col("tag")))
    seen = F.when(n % 8 == 4, F.lit(None)).otherwise(F.col("modified"))
    later = n + n % 5 * 40 + 1
    revisits = base.select(
        (n * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"),
        etag.alias("etag"), seen.alias("last_modified"),
        F.create_map(F.lit("date"), text("t", later.cast("string")), F.lit("cache-control"),
                     text("max-age=", (n % 100).cast("string")), F.lit("content-type"), F.lit("text/plain"),
                     F.lit("server"), F.lit("s")).alias("headers"), F.lit(None).cast("string").alias("body"))
    return responses.unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return out.select("record_id", "url", "ts", "response_id", "status",
                      F.array_join(F.array_sort(lines), "; ").alias("headers"),
                      F.octet_length("body").cast("long").alias("body_bytes"),
                      F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


ORACLE = r"""
WITH raw AS (
  SELECT page_id AS n, html,
         regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages
), cut AS (
  SELECT n, html,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(www\.|m\.)', ''), ':(80|443)$', '') AS host,
         regexp_replace(u, '^[^/?]*', '') AS rest FROM raw
), named AS (
  SELECT n, html, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS base,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1),
           '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS q FROM cut
), pg AS (
  SELECT n, html, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url,
         '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (n // 7) AS modified FROM named
), resp AS (
  SELECT n * 2 AS rid, url, n AS ts, tag, modified, html FROM pg
), rev AS (
  SELECT n, n * 2 + 1 AS record_id, url, n + n % 5 * 40 + 1 AS ts,
         CASE n % 8 WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"changed"' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE tag END AS etag,
         CASE n % 8 WHEN 4 THEN NULL ELSE modified END AS modified
  FROM pg
), hit AS (
  SELECT v.n, v.record_id, v.url, v.ts, v.etag, v.modified, r.rid, r.ts AS rts, r.tag, r.modified AS rmod, r.html
  FROM rev v ASOF LEFT JOIN resp r ON v.url = r.url AND v.ts > r.ts
), judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = tag THEN 'resolved' ELSE 'mismatch' END
                 WHEN modified IS NOT NULL THEN CASE WHEN modified = rmod THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unverified' END AS status
  FROM hit
)
SELECT record_id, url, ts, rid AS response_id, status,
       CASE WHEN status = 'resolved'
            THEN 'cache-control: max-age=' || (n % 100) || '; content-type: text/html; date: t' || ts || '; etag: ' || tag
            ELSE 'cache-control: max-age=' || (n % 100) || '; content-type: text/plain; date: t' || ts || '; server: s' END AS headers,
       CASE WHEN status = 'resolved' THEN strlen(html) END AS body_bytes,
       CASE WHEN status = 'resolved' THEN sha256(html) END AS body_sha256
FROM judged
"""
