"""WARC: resolve not-modified revisits.

A crawl that asks with validators may get "304 Not Modified" and stores a revisit record without a body. It is resolved
by an as-of join: by canonical URL, to the latest earlier full response. The revisit's validators have to agree with
that response's; then its headers are brought up to date with those of the revisit that a 304 may change, and the body is
the response's.

The join carries only record ids, times, validators and headers, never bodies. It runs per URL and day with a carry
table between days, so a URL that holds a third of all records is spread over as many tasks as it was crawled on days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.ordered import carry_forward
from feedloom.operators.stages import written

# Header fields that a 304 does not change (they describe the stored body or one connection), and query
# parameters that do not identify a resource.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?"
_TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path that identify a resource: no scheme, user, default port, ``www.``, fragment, closing slash or tracking
    parameter; the host lowered and other parameters sorted. Text that is no URL stays as it is, without outer blanks."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, _URL, 2))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, _URL, 3), "/+$", "")
    query = F.filter(F.split(F.substring(F.regexp_extract(u, _URL, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    return F.when(~u.rlike(_URL), u).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _strong(tag: Column) -> Column:
    """A validator for the weak comparison: without W/ and outer blanks."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _named(headers: Column) -> Column:
    """Header fields with lowered names; fields without a name are dropped."""
    low = F.transform(F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), F.coalesce(h["value"], F.lit("")).alias("value")))
    return F.filter(low, lambda h: h["name"].isNotNull() & (h["name"] != ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisit records with what they stand for.

    ``records``: record_id, url, fetched_at (timestamp), kind ('response' or 'revisit'), etag, last_modified, headers
    (array of name and value); other columns are ignored. Result, one row per revisit: record_id, canonical_url,
    outcome, refers_to, headers.

    outcome: ``resolved``; ``mismatch`` if the validators differ (refers_to names the response, nothing is merged);
    ``unvalidated`` if the two have no validator in common; ``missing`` without an earlier response. An etag decides if both
    have one, otherwise the time of last modification. Earlier means by time, then by record id; records without url, time
    or id neither are found nor serve as a reference. Repeated records are kept. Only ``resolved`` merges headers.
    """
    point = F.struct(
        F.col("record_id").alias("id"), _strong(F.col("etag")).alias("etag"), F.trim("last_modified").alias("modified"), _named(F.col("headers")).alias("headers")
    )
    own = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "fetched_at", "kind", "etag", "last_modified", "headers")
    whole = F.col("canonical_url").isNotNull() & F.col("fetched_at").isNotNull() & F.col("record_id").isNotNull()
    timed = own.where(whole).select(
        "canonical_url", "record_id", "fetched_at", "kind", point.alias("_me"), F.when(F.col("kind") == "response", point).alias("_full")
    )
    timed = written(timed)
    day = F.unix_date(F.to_date("fetched_at"))
    found = carry_forward(timed, ["canonical_url"], ["fetched_at", "record_id", "kind"], {"_ref": F.col("_full")}, day).where("kind = 'revisit'")
    ref, me = F.col("_ref"), F.col("_me")
    tags = ref["etag"].isNotNull() & me["etag"].isNotNull()
    times = ref["modified"].isNotNull() & me["modified"].isNotNull()
    outcome = (
        F.when(ref.isNull(), "missing")
        .when(tags, F.when(ref["etag"] == me["etag"], "resolved").otherwise("mismatch"))
        .when(times, F.when(ref["modified"] == me["modified"], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    news = F.filter(me["headers"], lambda h: ~h["name"].isin(NOT_MERGED))
    names = F.transform(news, lambda h: h["name"])
    merged = F.concat(F.filter(ref["headers"], lambda h: ~F.array_contains(names, h["name"])), news)
    done = found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", ref["id"].alias("refers_to"), F.when(F.col("outcome") == "resolved", merged).otherwise(me["headers"]).alias("headers")
    )
    broken = own.where((F.col("kind") == "revisit") & ~whole)
    none = broken.select("record_id", "canonical_url", F.lit("missing").alias("outcome"), F.lit(None).cast(timed.schema["record_id"].dataType).alias("refers_to"), _named(F.col("headers")).alias("headers"))
    return done.unionByName(none)


CAPTURES = 4


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``: four captures of each page over some days, in varying spellings of its address.

    The first is a full response, unless page_id is a multiple of 11; later ones are revisits, unless the page changed
    ((page_id + capture) a multiple of 5). Some revisits carry a weak tag, another tag, only a time, or no validator.
    """
    k, p = F.col("capture"), F.col("page_id")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_u"), F.md5(F.coalesce("html", F.lit(""))).alias("_md5"), F.explode(F.array(*[F.lit(i) for i in range(CAPTURES)])).alias("capture"))
    full = F.when(k == 0, p % 11 != 0).otherwise((p + k) % 5 == 0)
    base = F.regexp_replace("_u", "#.*$", "")
    url = F.when(k == 1, F.concat("_u", F.lit("#part"))).when(k == 2, F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("utm_source=mail"))).otherwise(F.col("_u"))
    tag = F.concat(F.lit('"'), F.substring("_md5", 1, 12), F.when((p + k) % 5 == 0, k.cast("string")).otherwise(""), F.lit('"'))
    day = (p % 28 + 1).cast("string")
    modified = F.concat(F.lit("day "), day)
    etag = F.when(full, tag).when(p % 7 == 0, '"other"').when(p % 7 == 1, F.concat(F.lit("W/"), tag)).when(p % 7 == 2, F.lit(None).cast("string")).when(p % 7 == 3, F.lit(None).cast("string")).otherwise(tag)
    last = F.when((p % 7 == 3) & ~full, F.lit(None).cast("string")).otherwise(modified)
    fetched = F.timestamp_seconds(F.lit(1_700_000_000) + (k * 86_400 + p % 5_000 * 17).cast("long"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    shared = [field("Date", F.concat(F.lit("fetch "), k.cast("string"))), field("Cache-Control", F.concat(F.lit("max-age="), (k * 60).cast("string")))]
    headers = F.when(full, F.array(*shared, field("Content-Type", F.lit("text/html")), field("Content-Length", F.lit("100")), field("X-Served", F.lit("full")))).otherwise(
        F.array(*shared, field("Content-Length", F.lit("0")), field("Connection", F.lit("close")), field("x-served", F.concat(F.lit("again "), k.cast("string"))))
    )
    return rows.select(
        (p * CAPTURES + k).alias("record_id"), url.alias("url"), fetched.alias("fetched_at"), F.when(full, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"), last.alias("last_modified"), headers.alias("headers"),
    )


def op5_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    line = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.select("record_id", "canonical_url", "outcome", "refers_to", F.array_join(F.array_sort(line), "\n").alias("headers"))


_LIST = ", ".join(f"'{n}'" for n in NOT_MERGED)
OP5_SQL = f"""
WITH cap AS (SELECT page_id AS p, k, coalesce(url, '') AS u, regexp_replace(coalesce(url, ''), '#.*$', '') AS base, md5(coalesce(html, '')) AS h,
                    CASE WHEN k = 0 THEN page_id % 11 <> 0 ELSE (page_id + k) % 5 = 0 END AS is_full
             FROM pages, (SELECT CAST(unnest(range({CAPTURES})) AS INT) AS k)),
rec AS (SELECT p * {CAPTURES} + k AS record_id, is_full, 1700000000 + k * 86400 + p % 5000 * 17 AS t,
   CASE k WHEN 1 THEN u || '#part' WHEN 2 THEN base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'utm_source=mail' ELSE u END AS url,
   CASE WHEN is_full THEN tag WHEN p % 7 = 0 THEN '"other"' WHEN p % 7 = 1 THEN 'W/' || tag WHEN p % 7 IN (2, 3) THEN NULL ELSE tag END AS etag,
   CASE WHEN p % 7 = 3 AND NOT is_full THEN NULL ELSE 'day ' || (p % 28 + 1) END AS modified,
   CASE WHEN is_full
     THEN [{{'n': 'date', 'v': 'fetch ' || k}}, {{'n': 'cache-control', 'v': 'max-age=' || (k * 60)}}, {{'n': 'content-type', 'v': 'text/html'}}, {{'n': 'content-length', 'v': '100'}}, {{'n': 'x-served', 'v': 'full'}}]
     ELSE [{{'n': 'date', 'v': 'fetch ' || k}}, {{'n': 'cache-control', 'v': 'max-age=' || (k * 60)}}, {{'n': 'content-length', 'v': '0'}}, {{'n': 'connection', 'v': 'close'}}, {{'n': 'x-served', 'v': 'again ' || k}}] END AS headers
  FROM (SELECT *, '"' || substr(h, 1, 12) || CASE WHEN (p + k) % 5 = 0 THEN CAST(k AS VARCHAR) ELSE '' END || '"' AS tag FROM cap)),
parts AS (SELECT *, trim(url) AS tu, regexp_matches(trim(url), '{_URL}') AS ok,
   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '{_URL}', 2)), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\\.', '') AS host,
   regexp_replace(regexp_extract(trim(url), '{_URL}', 3), '/+$', '') AS path,
   list_sort(list_filter(string_split(substr(regexp_extract(trim(url), '{_URL}', 4), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}'))) AS args FROM rec),
canon AS (SELECT *, CASE WHEN ok THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END ELSE tu END AS canonical_url FROM parts),
ref AS (SELECT *, last_value(CASE WHEN is_full THEN {{'id': record_id, 'etag': etag, 'modified': modified, 'headers': headers}} END IGNORE NULLS)
                  OVER (PARTITION BY canonical_url ORDER BY t, record_id ROWS UNBOUNDED PRECEDING) AS r FROM canon),
judged AS (SELECT *, CASE WHEN r IS NULL THEN 'missing'
     WHEN r.etag IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN r.etag = regexp_replace(etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
     WHEN r.modified IS NOT NULL AND modified IS NOT NULL THEN CASE WHEN r.modified = modified THEN 'resolved' ELSE 'mismatch' END
     ELSE 'unvalidated' END AS outcome,
   list_filter(headers, lambda x: x.n NOT IN ({_LIST})) AS news FROM ref WHERE NOT is_full)
SELECT record_id, canonical_url, outcome, r.id AS refers_to,
  array_to_string(list_sort(list_transform(CASE WHEN outcome = 'resolved'
      THEN list_concat(list_filter(r.headers, lambda x: NOT list_contains(list_transform(news, lambda y: y.n), x.n)), news) ELSE headers END,
    lambda x: x.n || ': ' || x.v)), chr(10)) AS headers
FROM judged
"""
