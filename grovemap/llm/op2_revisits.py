"""Resolution of not-modified revisits in web archives.

A revisit record says that a server answered 304. It is joined as of its time
to the latest earlier full response for the same canonical URL; its validators
must agree with the response's, and its headers update the stored ones as HTTP
caching rules permit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemap.llm.common import cut, table

#: Query parameters that don't identify a page.
TRACKING = r"(utm_[^=]*|ref|fbclid|gclid|sessionid)"
#: Time that one task of a URL covers.
SPAN_SECONDS = 30 * 86400
#: Headers of a 304 that never replace stored ones: those that describe the message's body or the connection.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, `www.`, default port, tracking parameters and final slash; the host in lower case, the other parameters in order. Null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}="))), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the 304 in their place; names in lower case, of equal names the last counts."""
    def low(m: Column) -> Column:
        all_ = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.reverse(F.transform(all_, lambda e: e["key"]))
        return F.filter(all_, lambda e, i: i == F.size(all_) - F.array_position(names, e["key"]))

    permitted = F.filter(low(fresh), lambda e: ~e["key"].isin(NOT_MERGED))
    taken = F.transform(permitted, lambda e: e["key"])
    both = F.concat(F.filter(low(stored), lambda e: ~F.array_contains(taken, e["key"])), permitted)
    return F.array_join(F.array_sort(F.transform(both, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """(record_id, canonical, outcome, response_id, payload_digest, headers) for each revisit of records(record_id, url, ts, kind, etag, last_modified, payload_digest, headers).

    kind is 'response' (a full one) or 'revisit'; ts a number; headers a map.
    outcome is 'resolved'; 'etag_differs' or 'date_differs' where the revisit's
    validator (the entity tag by weak comparison, else the date) isn't the
    response's; 'no_validator'; or 'no_response'. Only resolved revisits have
    payload_digest and headers. Responses at the revisit's own time aren't
    earlier; of several at one time the greatest record_id counts. A null URL
    or time never finds a response. Null headers are none. Repeated revisits
    give repeated rows, URLs of any length are read to their end, an empty
    table gives no row; other kinds and columns are ignored.

    Only narrow rows are shuffled, payloads stay where they are. Time is cut into
    spans: within one, a running maximum finds the latest response; the last
    one of earlier spans comes from a window that sees a row for each span. So
    a URL of very many captures is spread over as many tasks as it has spans.
    """
    every = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "payload_digest", "headers")
    placed = F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", F.map_entries("headers").alias("headers")))
    every = cut(every.withColumn("span", F.floor(F.col("ts") / span_seconds)).withColumn("full", full), "captures")
    # revisits without a place take no part in the windows, where they would all be in one task
    rows, lost = every.filter(placed), every.filter((F.col("kind") == "revisit") & ~placed)
    last = rows.filter("full IS NOT NULL").groupBy("canonical", "span").agg(F.max("full").alias("last"))
    # spans with a revisit need the last response of those before, so that both kinds of span stand in the window
    spans = rows.filter("kind = 'revisit'").select("canonical", "span").distinct().join(last, ["canonical", "span"], "full")
    before = spans.select("canonical", "span", F.max("last").over(Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = Window.partitionBy("canonical", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("full").over(inside)).filter("kind = 'revisit'").drop("full")
    found = near.join(before, ["canonical", "span"], "left").withColumn("r", F.coalesce("near", "before"))
    missing = F.col("r").isNull()
    outcome = (
        F.when(missing, "no_response")
        .when(F.col("etag").isNotNull(), F.when(_opaque(F.col("etag")).eqNullSafe(_opaque(F.col("r.etag"))), "resolved").otherwise("etag_differs"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified").eqNullSafe(F.col("r.last_modified")), "resolved").otherwise("date_differs"))
        .otherwise("no_validator")
    )
    out = found.withColumn("outcome", outcome)
    sure = F.col("outcome") == "resolved"
    known = out.select("record_id", "canonical", "outcome", F.when(~missing, F.col("r.record_id")).alias("response_id"), F.when(sure, F.col("r.payload_digest")).alias("payload_digest"), F.when(sure, merged_headers(F.map_from_entries("r.headers"), F.col("headers"))).alias("headers"))
    none = F.lit(None)
    return known.unionByName(lost.select("record_id", "canonical", F.lit("no_response").alias("outcome"), *[none.cast(kind).alias(c) for c, kind in known.dtypes[3:]]))


def records(pages: DataFrame) -> DataFrame:
    """Archive records of the pages table: for each page a full response at its id's hour, and a later revisit in another spelling of the URL. A digit of the page's hash says which validators the revisit has."""
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", digest.alias("digest"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("size"), F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("long").alias("h"))
    tag, day = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')), F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("url"), (F.col("page_id") * 3600).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), day.alias("last_modified"), F.col("digest").alias("payload_digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string"))).alias("headers"),
    )
    case = F.col("h") % 6
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"), (F.col("page_id") * 3600 + F.col("h") * 60).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(case <= 1, tag).when(case == 2, F.concat(F.lit("W/"), tag)).when(case == 3, F.lit('"other"')).alias("etag"), F.when(case <= 4, day).alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("content-length"), F.lit("0"), F.lit("X-Cache"), F.concat(F.lit("hit "), F.col("h").cast("string"))).alias("headers"),
    )
    return base.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(records(table(spark, sf_dir, "pages")))


SQL = rf"""
WITH b AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, ''))::VARCHAR AS size, ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::BIGINT AS h,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^[^?]*'), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x != '' AND NOT regexp_matches(x, '^{TRACKING}='))), '&') AS q FROM b),
c AS (SELECT *, host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical, '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || (page_id % 97) AS day, h % 6 AS k FROM s),
f AS (SELECT canonical, page_id * 2 AS response_id, page_id * 3600 AS ts, tag, day, digest, size, page_id % 3 AS srv FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, canonical, page_id * 3600 + h * 60 AS ts, h, CASE WHEN k <= 2 THEN tag WHEN k = 3 THEN '"other"' END AS etag, CASE WHEN k <= 4 THEN day END AS lm FROM c),
j AS (SELECT v.*, f.response_id, f.tag, f.day, f.digest, f.size, f.srv FROM v ASOF LEFT JOIN f ON v.canonical = f.canonical AND v.ts > f.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NOT NULL THEN CASE WHEN etag = tag THEN 'resolved' ELSE 'etag_differs' END WHEN lm IS NOT NULL THEN CASE WHEN lm = day THEN 'resolved' ELSE 'date_differs' END ELSE 'no_validator' END AS outcome FROM j)
SELECT record_id, canonical, outcome, response_id, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
    CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'server: s' || srv || chr(10) || 'x-cache: hit ' || h END AS headers FROM o
"""
