"""Resolution of not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Captures are cut into chunks of about equal size in the order of URL and time, so a URL with very many captures spans many
chunks. Within a chunk a window finds the latest earlier response; the last response of each chunk is carried on to the
URL's later chunks by a window over chunks. No task needs a URL's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

# Query parameters that don't change the page, and headers that a 304 response may not change.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

CAPTURE = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.`, `m.` or a default port; no scheme, fragment, tracking parameter or last slash."""
    out = F.regexp_replace(F.trim(url), r"#.*$", "")
    out = F.regexp_replace(out, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(out, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(out, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(out, r"\?(.*)$", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), rf"&({'|'.join(TRACKING)})=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit of captures (columns of CAPTURE; kind `response` or `revisit`, ts in seconds).

    response_id: the full response of the same canonical URL with the latest ts before the revisit's, ties to the
    larger record_id; null if there is none. status: `no_earlier_response`; `resolved` if the validators agree (both
    ETags, weakly compared, if both have one; else both Last-Modified; else both digests); `validator_mismatch` if they
    don't; `unvalidated` if no validator is on both sides. headers: for resolved revisits the response's headers, with
    those of the revisit put over them but for KEPT_HEADERS, as sorted `name: value` lines with names in lower case,
    ties of names to the larger value. Records with a null URL, ts or record_id match nothing; null header arrays are empty. Repeated
    revisit rows each give a row; repeated responses are one. Extra columns, whatever their names, are ignored; an empty
    table gives one.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("curl"), "ts", "kind", "etag", "last_modified", "digest",
        F.array_sort(F.transform(F.coalesce("headers", F.array()), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))).alias("headers"),
    )
    # a null URL matches nothing; such rows are spread by their own ids
    rows = rows.withColumn("_key", F.coalesce("curl", F.concat(F.lit(" "), F.coalesce("record_id", F.lit(0)).cast("string"))))
    # captures of one URL and time stay in one chunk; kept, as the ranges are drawn from samples
    rows = durable(rows.repartitionByRange("_key", "ts").withColumn("chunk", F.spark_partition_id()))
    full = F.when(
        (F.col("kind") == "response") & F.col("curl").isNotNull() & F.col("ts").isNotNull(),
        F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"),
    )
    within = Window.partitionBy("_key", "chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(full).over(within))
    chunks = rows.groupBy("_key", "chunk").agg(F.max(full).alias("last"))
    carried = chunks.withColumn("far", F.max("last").over(Window.partitionBy("_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("_key", "chunk", "far")
    revisits = rows.where("kind = 'revisit'").join(carried.where("far is not null"), ["_key", "chunk"], "left")
    found = revisits.withColumn("hit", F.coalesce("near", "far"))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    agree = (
        F.when(both(F.col("etag"), F.col("hit.etag")), weak(F.col("etag")) == weak(F.col("hit.etag")))
        .when(both(F.col("last_modified"), F.col("hit.last_modified")), F.col("last_modified") == F.col("hit.last_modified"))
        .when(both(F.col("digest"), F.col("hit.digest")), F.col("digest") == F.col("hit.digest"))
    )
    status = F.when(F.col("hit").isNull(), "no_earlier_response").when(agree, "resolved").when(~agree, "validator_mismatch").otherwise("unvalidated")
    kept = F.array(*[F.lit(h) for h in KEPT_HEADERS])
    over = F.filter("headers", lambda h: ~F.array_contains(kept, h["name"]))
    names = F.transform(over, lambda h: h["name"])
    merged = F.concat(F.filter(F.col("hit.headers"), lambda h: ~F.array_contains(names, h["name"])), over)
    one_each = F.filter(F.array_sort(F.transform(merged, lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))), lambda h: h["value"].isNotNull())
    lines = F.array_join(F.transform(F.map_entries(F.map_from_entries(F.transform(F.array_distinct(F.transform(one_each, lambda h: h["name"])), lambda n: F.struct(n, F.array_max(F.transform(F.filter(one_each, lambda h: h["name"] == n), lambda h: h["value"])))))), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.withColumn("status", status).select(
        F.col("record_id").alias("revisit_id"), "curl", "ts", F.col("hit.record_id").alias("response_id"), F.col("hit.ts").alias("response_ts"), "status",
        F.when(F.col("status") == "resolved", lines).alias("headers"), F.when(F.col("status") == "resolved", F.col("hit.digest")).alias("payload_digest"),
    )


# --- Captures of the pages table ---------------------------------------------------------------------------------------
# The table holds no revisits. Each page gives one full response and one later revisit by another spelling of its URL,
# in which one of seven has another ETag, one of eleven has none, and one of thirteen comes before its response.
START = 1_700_000_000


def page_captures(pages: DataFrame) -> DataFrame:
    """Responses and revisits made from pages (page_id, url, html), by the rule above. Null html counts as empty."""
    id_ = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    base = pages.select(id_.alias("id"), F.col("url"), digest.alias("digest"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("size"))
    base = base.withColumn("tag", F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))).withColumn("at", F.lit(START) + F.col("id") * 60)
    base = base.withColumn("modified", F.concat(F.lit("t"), (F.col("at") - 3600).cast("string")))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    response = base.select(
        (F.col("id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("modified").alias("last_modified"), "digest",
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.col("size")), header("ETag", F.col("tag")), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    tag = F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).when(F.col("id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    later = F.when(F.col("id") % 13 == 0, F.col("at") - 1).otherwise(F.col("at") + 86400 * (1 + F.col("id") % 5))
    revisit = base.select(
        (F.col("id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.col("modified").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.array(header("Content-Length", F.lit("0")), header("Cache-Control", F.lit("max-age=600")), header("Date", F.concat(F.lit("t"), later.cast("string")))).alias("headers"),
    )
    return response.unionByName(revisit)


def page_revisits_sql() -> str:
    """resolve(page_captures(pages)) in DuckDB's SQL."""
    params = "|".join(TRACKING)
    return rf"""
WITH base AS (SELECT page_id AS id, url, md5(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS size, {START} + page_id * 60 AS at_ FROM pages),
b1 AS (SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, 't' || CAST(at_ - 3600 AS VARCHAR) AS modified, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM base),
b2 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  regexp_replace(regexp_replace('&' || regexp_extract(rest, '\?(.*)$', 1), '&({params})=[^&]*', '', 'g'), '^&+', '') AS query FROM b1),
b AS (SELECT *, host || path || CASE WHEN query != '' THEN '?' || query ELSE '' END AS curl FROM b2),
rev AS (SELECT id, id * 2 + 1 AS revisit_id, curl, CASE WHEN id % 13 = 0 THEN at_ - 1 ELSE at_ + 86400 * (1 + id % 5) END AS ts,
  CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN '"other"' ELSE tag END AS etag, modified AS last_modified FROM b),
hit AS (SELECT r.*, p.id * 2 AS response_id, p.at_ AS response_ts, p.tag AS p_tag, p.modified AS p_modified, p.digest AS p_digest, p.size AS p_size
  FROM rev r LEFT JOIN b p ON p.curl = r.curl AND p.at_ < r.ts
  QUALIFY row_number() OVER (PARTITION BY r.revisit_id ORDER BY p.at_ DESC NULLS LAST, p.id DESC) = 1),
said AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier_response'
  WHEN etag IS NOT NULL THEN CASE WHEN etag = p_tag THEN 'resolved' ELSE 'validator_mismatch' END
  WHEN last_modified = p_modified THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM hit)
SELECT revisit_id, curl, ts, response_id, response_ts, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || p_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || CAST(ts AS VARCHAR) || chr(10) || 'etag: ' || p_tag END AS headers,
  CASE WHEN status = 'resolved' THEN p_digest END AS payload_digest
FROM said"""
