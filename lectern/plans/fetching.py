"""Queries on a round over landed bodies, with their oracles.

The pages are what landed. By their id some answers are faulty and some were stored otherwise before; each row of `pages` is a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import fetching
from lectern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
STORED_AT, NOW = "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"
DOMAINS = ["example.com", "example.org"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _case(of: str, cases: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for k, c in cases.items():
        out = F.when(F.expr(of) == k, c).otherwise(out)
    return out


def _round(spark: SparkSession, d: str) -> tuple[fetching.Round, DataFrame]:
    """The round, and the log of versions before it."""
    pages = table(spark, d, "pages")
    key, html = F.col("page_id").cast("string"), F.col("html")
    sources = pages.select(key.alias("source_id"), F.lit("Publisher").alias("publisher"), "url")
    publishers = spark.range(1).select(F.lit("Publisher").alias("publisher"), F.array(*[F.lit(x) for x in DOMAINS]).alias("domains"))
    # what the sites answer: markup alone differs, an empty page, another text, a challenge, or the page as it was
    body = _case("page_id % 6", {
        2: F.concat(html, F.lit("<!-- again -->")), 3: F.concat(F.lit("<html><body><h1>Revised</h1><p>"), "url", F.lit("</p></body></html>")),
        4: F.lit("<html><body></body></html>"), 5: F.concat(html, F.when(F.col("page_id") % 4 == 1, "<p id=_cf_chl_opt>").otherwise("")),
    }, html)
    secure = F.regexp_replace("url", "^http:", "https:")
    final = F.when(F.col("page_id") % 11 == 0, F.col("url")).otherwise(secure)
    cut = F.when(F.col("page_id") % 9 == 7, 1).otherwise(0)
    headers = F.create_map(F.lit("content-type"), F.lit("Text/HTML; charset=utf-8"), F.lit("content-length"), (F.octet_length(body) + cut).cast("string"))
    landed = pages.select(key.alias("source_id"), "url", final.alias("final_url"), F.when(F.col("page_id") % 13 == 0, 404).otherwise(200).alias("status"), headers.alias("headers"), body.cast("binary").alias("content"))
    # what is stored: nothing for a fifth, something that is no page for a seventh, else the page
    held = pages.where("page_id % 5 <> 0").select(key.alias("document_id"), F.sha2(html.cast("binary"), 256).alias("sha256"), html.cast("binary").alias("content"), F.when(F.col("page_id") % 7 == 1, "application/pdf").otherwise("text/html").alias("content_type"))
    none = F.lit(None).cast("string")
    log = held.select("document_id", "sha256", "content_type", none.alias("etag"), none.alias("last_modified"), F.lit(STORED_AT).alias("fetched_at"), F.lit(STORED_AT).alias("last_checked_at"))
    bodies = fetching.on_publisher(fetching.received(landed), sources, publishers)
    return fetching.observe(fetching.picked(sources, bodies), (landed,), log, held.select("document_id", "sha256", "content"), NOW), log


_ON = "regexp_matches(url, '^https?://([^/?#:]*[.])?example[.](com|org)([/?#:]|$)')"
_BODY = """CASE page_id % 6 WHEN 2 THEN html || '<!-- again -->' WHEN 3 THEN '<html><body><h1>Revised</h1><p>' || url || '</p></body></html>' WHEN 4 THEN '<html><body></body></html>'
  WHEN 5 THEN html || CASE WHEN page_id % 4 = 1 THEN '<p id=_cf_chl_opt>' ELSE '' END ELSE html END"""
_TOLD = f"""p AS (SELECT page_id, url, {_BODY} AS body, sha256(html) AS was, page_id % 5 = 0 AS fresh, page_id % 7 = 1 AS pdf FROM pages),
e AS (SELECT *, sha256(body) AS sha, CASE WHEN page_id % 11 = 0 AND url LIKE 'http:%' THEN 'redirected to non-https URL ' || url WHEN page_id % 13 = 0 THEN 'HTTP 404'
  WHEN page_id % 9 = 7 THEN 'truncated: got ' || octet_length(encode(body)) || ' of ' || (octet_length(encode(body)) + 1) || ' bytes' WHEN contains(body, '_cf_chl_opt') THEN 'Cloudflare challenge page'
  WHEN NOT {_ON} THEN 'redirected off the publisher''s domains: ' || regexp_extract(url, '^https?://([^/?#:]*)', 1) END AS error FROM p),
t AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN fresh THEN 'new' WHEN sha = was THEN 'unchanged' WHEN pdf THEN 'failed'
  WHEN page_id % 6 = 2 THEN 'unchanged' WHEN page_id % 6 = 4 THEN 'failed' ELSE 'changed' END AS status FROM e),
r AS (SELECT page_id::VARCHAR AS source_id, status, CASE WHEN error IS NOT NULL THEN error WHEN status = 'new' OR sha = was THEN left(sha, 12)
  WHEN status = 'unchanged' THEN left(was, 12) || ' (markup-only change ' || left(sha, 12) || ' ignored)' WHEN pdf THEN 'got text/html where ' || left(was, 12) || ' is application/pdf; a block page? current version kept'
  WHEN status = 'failed' THEN left(sha, 12) || ' has no body sections where ' || left(was, 12) || ' has; a block page? current version kept' ELSE left(was, 12) || ' -> ' || left(sha, 12) END AS detail,
  CASE WHEN status IN ('new', 'changed') THEN sha WHEN NOT fresh THEN was END AS sha256, was, fresh, pdf, url FROM t)"""


@query(f"WITH {_TOLD} SELECT source_id, status, detail, sha256 FROM r")
def fetch_round(spark: SparkSession, d: str) -> DataFrame:
    """What each source's answer makes of its versions, and why it is refused."""
    return _round(spark, d)[0].results


@query(
    f"""WITH {_TOLD} SELECT source_id || '@' || left(was, 12) AS id, source_id AS document_id, was AS sha256, CASE WHEN pdf THEN 'application/pdf' ELSE 'text/html' END AS content_type, '{STORED_AT}' AS fetched_at,
  CASE WHEN status = 'unchanged' THEN '{NOW}' ELSE '{STORED_AT}' END AS last_checked_at FROM r WHERE NOT fresh
UNION ALL SELECT source_id || '@' || left(sha256, 12), source_id, sha256, 'text/html', '{NOW}', '{NOW}' FROM r WHERE status IN ('new', 'changed')"""
)
def fetch_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions after the round, folded from the log with what the round appends."""
    found, log = _round(spark, d)
    return fetching.versions_of(log.unionByName(found.seen)).drop("etag", "last_modified")


@query(
    f"WITH {_TOLD} SELECT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'failed') AS n_failed FROM r GROUP BY 1"
)
def fetch_counts(spark: SparkSession, d: str) -> DataFrame:
    """The round's report by host."""
    hosts = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.regexp_extract("url", "^https?://([^/?#:]*)", 1).alias("host"))
    return fetching.counts(_round(spark, d)[0].results.join(hosts, "source_id"), "host")
