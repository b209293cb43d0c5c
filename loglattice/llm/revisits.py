"""Resolves not-modified revisits of a crawl to the response that they repeat.

A revisit takes the body of the latest earlier full response of the same
canonical URL. Its validators are checked against that response, and the
headers that a 304 may update replace the stored ones.

The as-of join works on distinct (URL, time) points. A URL with very many
points is cut into blocks of time at approximate quantiles: each block looks
for its latest response by itself, and what earlier blocks ended with is
carried over. Bodies never move; headers are joined to the matches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: The headers that a not-modified answer may update (RFC 9110, 15.4.5, and what RFC 9111, 3.2 adds).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit's origin, not a page.
TRACKING = r"^(utm_[a-z_]*|gclid|fbclid|msclkid|dclid|mc_eid|igshid)(=|$)"
#: Points of one URL beyond which it is cut into blocks, and blocks that it is cut into.
HOT_POINTS = 20_000
HOT_BLOCKS = 256
#: URLs that are cut into blocks at most; with so many rows that more had ``HOT_POINTS``, the limit rises.
HOT_URLS = 1 << 12


def canonical_url(url: Column) -> Column:
    """host/path?query with lower-case host; without scheme, user, ``www.``, default port, fragment, last slash and tracking parameters; the others in order.

    Null for a null or blank URL.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^.*@", ""), r"(:80|:443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.trim(url) != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(path == "", "/").otherwise(path), query))


def _header(name: str) -> Column:
    return F.try_element_at(F.col("headers"), F.lit(name))


def _validator(name: str) -> Column:
    """Weak comparison: a weak and a strong tag with the same text are equal."""
    return F.regexp_replace(F.trim(_header(name)), r"^W/", "")


def _carried(points: DataFrame, hot_points: int, blocks: int, work: Workspace) -> DataFrame:
    """(key, ts, found): the latest full response before each point. ``points`` is a written table."""
    counts = points.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # no more than this many keys can have more points, so what is broadcast is bounded
    limit = max(hot_points, points.count() // HOT_URLS)
    hot = F.broadcast(counts.where(F.col("n") > limit).select("key"))
    cuts = F.percentile_approx("ts", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(1000))
    hot = F.broadcast(work.put(points.join(hot, "key").groupBy("key").agg(cuts.alias("cuts"))))
    placed = points.join(hot, "key", "left").withColumn("block", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("ts"))), F.lit(0)))
    placed = placed.withColumn("block", F.when(F.col("cuts").isNull(), 0).otherwise(F.col("block"))).drop("cuts")
    order = Window.partitionBy("key", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("found", F.last("response", ignorenulls=True).over(order))
    ends = placed.where(F.col("response").isNotNull()).groupBy("key", "block").agg(F.max_by("response", "ts").alias("end"))
    # at most ``blocks`` rows of a URL meet here, and only of hot ones
    ends = ends.join(hot.select("key"), "key", "left_semi")
    starts = ends.select("key", F.col("block").alias("from"), "end").join(placed.join(hot.select("key"), "key", "left_semi").select("key", "block").distinct(), "key").where("from < block")
    starts = starts.groupBy("key", "block").agg(F.max_by("end", "from").alias("start"))
    return own.join(starts, ["key", "block"], "left").where("asked").select("key", "ts", F.coalesce("found", "start").alias("found"))


def resolve_revisits(records: DataFrame, hot_points: int = HOT_POINTS, blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for every revisit of ``records`` (record_id, url, ts, kind, status, headers, payload_digest).

    ``kind`` is ``response`` or ``revisit``, ``ts`` a long, ``headers`` a map
    with lower-case names, ``payload_digest`` of the stored body. Full
    responses have kind ``response`` and a status of 200 to 299 but 206, a
    partial one. Returns record_id, canonical_url, ts, response_id, outcome,
    payload_digest and the merged headers. Outcomes:

    * ``resolved``: a validator that the revisit has agrees (its ETag, else
      its Last-Modified, else its payload digest);
    * ``mismatch``: it disagrees; response_id names what was compared, headers and digest stay the revisit's own;
    * ``unverified``: the revisit has none that the response has too; merged all the same;
    * ``unanchored``: no full response is earlier, or URL or time is null.

    Of responses at one time the largest record_id counts; of those that share
    a record_id too, one with the largest digest and headers. A response at
    the revisit's own time is not earlier. A full response without a
    record_id can't be named and is none. Repeated revisits give repeated
    rows. Null headers are none. Other columns are left aside; an empty table gives
    no row.
    """
    base = records.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload_digest")
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & (F.col("status") != 206)
    revisits = base.where("kind = 'revisit'").drop("kind", "status")
    work = Workspace(records.sparkSession)
    points = base.where((full | (F.col("kind") == "revisit")) & F.col("key").isNotNull() & F.col("ts").isNotNull()).groupBy("key", "ts").agg(F.max(F.when(full, F.col("record_id"))).alias("response"), F.bool_or(F.col("kind") == "revisit").alias("asked"))
    points = work.put(points)
    found = _carried(points, hot_points, blocks, work).where(F.col("found").isNotNull())
    # rows without a URL, a time or a match have no key to join by; they would all meet in one task
    located = F.col("key").isNotNull() & F.col("ts").isNotNull()
    matched = revisits.where(located).join(found, ["key", "ts"], "left")
    nowhere = revisits.where(~located).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    # a record_id may clash with another URL's, so responses are known by both; of equal ones the largest is taken
    entries = F.array_sort(F.map_entries("headers"))
    stored = base.where(full & F.col("record_id").isNotNull() & located).groupBy("key", F.col("record_id").alias("found")).agg(F.max(F.struct("payload_digest", entries.alias("entries"))).alias("s"))
    stored = stored.select("key", "found", F.map_from_entries("s.entries").alias("headers"), F.col("s.payload_digest").alias("stored_digest"))
    stored = stored.select("key", "found", F.col("headers").alias("stored_headers"), "stored_digest", _validator("etag").alias("stored_etag"), _header("last-modified").alias("stored_modified"))
    anchored = matched.where("found is not null").join(stored, ["key", "found"])
    matched = anchored.unionByName(matched.where("found is null"), allowMissingColumns=True).unionByName(nowhere, allowMissingColumns=True)
    matched = matched.withColumn("etag", _validator("etag")).withColumn("modified", _header("last-modified"))

    compared = F.coalesce(F.col("etag") == F.col("stored_etag"), F.col("modified") == F.col("stored_modified"), F.col("payload_digest") == F.col("stored_digest"))
    outcome = F.when(F.col("found").isNull(), "unanchored").when(compared, "resolved").when(~compared, "mismatch").otherwise("unverified")
    updates = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored_headers", lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    takes = F.col("outcome").isin("resolved", "unverified")
    return matched.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical_url"), "ts", F.col("found").alias("response_id"), "outcome",
        F.when(takes, F.col("stored_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(takes, merged).otherwise(F.col("headers")).alias("headers"),
    )


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl made from ``pages``: each page is a response, and is asked for again some time before or after.

    Records of page n: response 2 n at time 10 n, and revisit 2 n + 1 between
    95 before and 205 after. A tenth of the revisits has no ETag but a
    Last-Modified, a tenth only a digest, a tenth nothing to check.
    """
    n = F.col("page_id").cast("long")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), F.floor(n / 100).cast("string"))
    pages = pages.select(n.alias("n"), "url", digest.alias("digest"), etag.alias("etag"), modified.alias("modified"), F.pmod(n, F.lit(10)).alias("case"))
    response = F.struct(
        (F.col("n") * 2).alias("record_id"), "url", (F.col("n") * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), "etag", F.lit("last-modified"), "modified", F.lit("date"), F.concat(F.lit("t"), (F.col("n") * 10).cast("string"))).alias("headers"),
        F.col("digest").alias("payload_digest"),
    )
    later = F.col("n") * 10 + 5 + F.pmod(F.col("n"), F.lit(7)) * 50 - 100
    tags = (
        F.when(F.col("case") == 0, F.create_map(F.lit("last-modified"), "modified"))
        .when(F.col("case").isin(1, 2), F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "etag")))
    )
    revisit = F.struct(
        (F.col("n") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(tags, F.create_map(F.lit("date"), F.concat(F.lit("t"), later.cast("string")), F.lit("content-type"), F.lit("none"), F.lit("cache-control"), F.lit("max-age=60"))).alias("headers"),
        F.when(F.col("case") == 1, F.col("digest")).alias("payload_digest"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")
