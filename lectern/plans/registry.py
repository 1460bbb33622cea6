"""Queries on extraction, trust, quality and registry rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import extraction, trust, validate
from lectern.plans.retrieval import _COMPARABLE
from lectern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_CMP_Q, _CMP_T = _COMPARABLE.format(x="quote"), _COMPARABLE.format(x="text")


@query(
    f"""
WITH r AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN substr(text, 5, 60) WHEN 1 THEN upper(substr(text, 5, 60)) WHEN 2 THEN '' WHEN 3 THEN substr(text, 1, 1200) ELSE replace(substr(text, 3, 200), ' ', '  ') END AS quote,
  CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE lang END AS summary, CASE doc_id % 5 WHEN 0 THEN 'must' WHEN 1 THEN 'should' WHEN 2 THEN 'may' WHEN 3 THEN 'must' ELSE NULL END AS modality,
  CASE WHEN doc_id % 7 = 0 THEN ['en', 'fr', 'de', 'es'] WHEN doc_id % 7 = 1 THEN [lang, 'xx'] ELSE [lang, lang] END AS topics, CASE WHEN doc_id % 19 = 0 THEN ['other'] ELSE [source] END AS applies_to,
  CASE doc_id % 23 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02' WHEN 2 THEN '0000' ELSE NULL END AS eff, source FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN trim(quote) = '' THEN 'quote missing' WHEN length(quote) > 1000 THEN 'quote too long' WHEN NOT contains({_CMP_T}, {_CMP_Q}) THEN 'quote not verbatim'
  WHEN trim(summary) = '' THEN 'summary missing' WHEN NOT coalesce(modality IN ('must', 'should', 'may'), false) THEN 'unknown modality'
  WHEN NOT (len(list_distinct(topics)) BETWEEN 1 AND 3 AND len(list_filter(topics, lambda x: x NOT IN ('en', 'fr', 'de', 'es'))) = 0) THEN 'topics'
  WHEN len(list_filter(applies_to, lambda x: x <> source)) > 0 THEN 'applies_to' WHEN eff IN ('2024-02-30', '0000') THEN 'effective_from' END AS reason FROM r"""
)
def validate_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: F.col("doc_id") % n
    quote = (
        F.when(k(6) == 0, F.substring("text", 5, 60)).when(k(6) == 1, F.upper(F.substring("text", 5, 60))).when(k(6) == 2, "")
        .when(k(6) == 3, F.substring("text", 1, 1200)).otherwise(F.replace(F.substring("text", 3, 200), F.lit(" "), F.lit("  ")))
    )
    every = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    docs = table(spark, d, "documents").where("text is not null").withColumns(
        {
            "quote": quote, "summary": F.when(k(17) == 0, " ").otherwise(F.col("lang")),
            "modality": F.when(k(5) == 0, "must").when(k(5) == 1, "should").when(k(5) == 2, "may").when(k(5) == 3, "must"),
            "topics": F.when(k(7) == 0, every).when(k(7) == 1, F.array("lang", F.lit("xx"))).otherwise(F.array("lang", "lang")),
            "applies_to": F.when(k(19) == 0, F.array(F.lit("other"))).otherwise(F.array("source")),
            "eff": F.when(k(23) == 0, "2024-02-30").when(k(23) == 1, "2024-02").when(k(23) == 2, "0000"),
            "comparable": T.comparable("text"),
        }
    )
    reason = extraction.reject_reason(
        F.col("quote"), F.col("comparable"), F.col("summary"), F.col("modality"), F.col("topics"), F.col("applies_to"), F.col("eff"),
        ["must", "should", "may"], ["en", "fr", "de", "es"], F.array("source"),
    )
    return docs.select("doc_id", reason.alias("reason"))


@query(
    """
WITH m AS (SELECT doc_id, source, sha256('Language: ' || lang || chr(10) || 'Source: ' || source || chr(10) || 'Headings: -' || chr(10) || '<section>' || chr(10) || text || chr(10) || '</section>') AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT h FROM m JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id))
SELECT source, count(*) FILTER (c.h IS NOT NULL) AS hits, count(*) FILTER (c.h IS NULL) AS misses FROM m LEFT JOIN c ON m.h = c.h GROUP BY source"""
)
def extraction_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").withColumn("headings", F.array().cast("array<string>"))
    text = extraction.message({"Language": "lang", "Source": "source"}, "headings", "text")
    sections = docs.select("doc_id", "source", T.sha(text).alias("message_sha256"))
    memo = sections.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("message_sha256").distinct().withColumn("output", F.lit("{}"))
    found = extraction.cached(sections, memo, ["message_sha256"])
    return found.groupBy("source").agg(F.count_if(F.col("output").isNotNull()).alias("hits"), F.count_if(F.col("output").isNull()).alias("misses"))


_HOSTS = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(
    f"""
WITH p AS (SELECT page_id, url, {_HOSTS} AS h, CASE page_id % 4 WHEN 0 THEN 'Parliament' WHEN 1 THEN 'Blog' WHEN 2 THEN 'Agency' ELSE 'Nobody' END AS publisher, page_id % 3 = 0 AS binding, page_id % 5 = 0 AS vetted, page_id % 11 = 0 AS disputed FROM pages),
q AS (SELECT *, CASE publisher WHEN 'Parliament' THEN h = 'example.org' OR ends_with(h, '.example.org') OR ends_with(h, '.example.net') WHEN 'Blog' THEN ends_with(h, '.example.net') WHEN 'Agency' THEN ends_with(h, '.example.com') ELSE false END AS ok, publisher IN ('Parliament', 'Agency') AS official FROM p),
b AS (SELECT *, CASE WHEN NOT ok THEN 1 WHEN official AND binding THEN 3 ELSE 2 END AS base FROM q)
SELECT page_id, CASE WHEN disputed THEN 'disputed' ELSE ['disputed', 'unverified', 'secondary', 'official'][least(base + vetted::INTEGER, 3) + 1] END AS level FROM b"""
)
def trust_levels(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame(
        [("Parliament", ["example.org", "example.net"], True), ("Blog", ["example.net"], False), ("Agency", ["example.com"], True)],
        "publisher string, domains array<string>, official boolean",
    )
    k = lambda n: F.col("page_id") % n
    name = F.when(k(4) == 0, "Parliament").when(k(4) == 1, "Blog").when(k(4) == 2, "Agency").otherwise("Nobody")
    rows = trust.provenance(table(spark, d, "pages").select("page_id", "url", name.alias("publisher")), registry)
    return rows.select("page_id", trust.level(F.col("on_domain"), F.col("official"), k(3) == 0, k(5) == 0, k(11) == 0).alias("level"))


@query(
    "SELECT user_id, event_type AS reviewer, arg_max(CASE WHEN value >= 50 THEN 'vetted' ELSE 'disputed' END, (ts, event_id)) AS verdict FROM events GROUP BY 1, 2"
)
def latest_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("reviewer"), "ts", "event_id", F.when(F.col("value") >= 50, "vetted").otherwise("disputed").alias("verdict"))
    return trust.latest_verdicts(rows, "user_id", "reviewer", "verdict", ["ts", "event_id"])


@query(
    """
WITH s AS (SELECT source, count(*) AS sections FROM documents GROUP BY 1), t AS (SELECT source, count(DISTINCT doc_id) AS covered, count(*) AS statements, sum(quality)::BIGINT AS verified FROM documents JOIN labels USING (doc_id) GROUP BY 1),
q AS (SELECT source, CASE WHEN source LIKE 'src1%' THEN 'official' ELSE 'secondary' END AS level, sections, coalesce(covered, 0) AS covered, coalesce(statements, 0) AS statements, coalesce(verified, 0) AS verified FROM s LEFT JOIN t USING (source))
SELECT level, source, sum(sections)::BIGINT AS sections, sum(covered)::BIGINT AS covered, sum(statements)::BIGINT AS statements, sum(verified)::BIGINT AS verified, sum(CASE WHEN level = 'official' THEN verified ELSE 0 END)::BIGINT AS evidence FROM q GROUP BY ROLLUP (level, source)"""
)
def quality_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    statements = docs.join(table(spark, d, "labels"), "doc_id").withColumn("chunk_id", F.col("doc_id"))
    kind = F.when(F.col("source").startswith("src1"), "official").otherwise("secondary")
    rows = docs.select("source").distinct().withColumn("level", kind)
    out = trust.quality(rows, docs, statements, "source", F.col("quality") == 1, F.col("level") == "official")
    names = ["sections", "covered", "statements", "verified", "evidence"]
    return out.rollup("level", "source").agg(*[F.sum(n).alias(n) for n in names])


@query(
    """
WITH r AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'Article ' || (doc_id % 200) ELSE 'art. ' || (doc_id % 200) || ' (a)' END AS ref FROM documents),
k AS (SELECT *, regexp_extract_all(lower(ref), '([0-9]+|\\b[a-z]\\b)') AS key FROM r),
u AS (SELECT source, key, min(doc_id) AS original_section FROM k WHERE lang = 'en' AND len(key) > 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT doc_id, original_section FROM k LEFT JOIN u USING (source, key) WHERE lang <> 'en'"""
)
def translation_link(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("doc_id") % 200).cast("string")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Article "), k)).otherwise(F.concat(F.lit("art. "), k, F.lit(" (a)")))
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", ref.alias("ref"))
    linked = extraction.link_translations(rows.where("lang <> 'en'"), rows.where("lang = 'en'"), "source", "ref", "doc_id")
    return linked.select("doc_id", "original_section")


@query(
    """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-13') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-31') WHEN 5 THEN '0000-01' ELSE strftime(o_orderdate, '%y') END AS value FROM orders)
SELECT o_orderkey, value, regexp_full_match(value, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?') AND NOT starts_with(value, '0000') AND try_cast(substr(value || '-01-01', 1, 10) AS DATE) IS NOT NULL AS valid FROM v"""
)
def partial_date_valid(spark: SparkSession, d: str) -> DataFrame:
    k, f = F.col("o_orderkey") % 7, lambda p: F.date_format("o_orderdate", p)
    value = (
        F.when(k == 0, f("yyyy")).when(k == 1, f("yyyy-MM")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("yyyy-'13'"))
        .when(k == 4, f("yyyy-MM-'31'")).when(k == 5, "0000-01").otherwise(f("yy"))
    )
    rows = table(spark, d, "orders").select("o_orderkey", value.alias("value"))
    return rows.withColumn("valid", T.partial_date_valid("value"))


@query(
    """
WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'Doc_' || doc_id WHEN doc_id % 10 = 3 THEN 'doc_' || doc_id WHEN doc_id % 10 = 7 THEN 'doc' || doc_id || chr(10) ELSE 'doc-' || (doc_id // 2) END AS id, source AS publisher, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'http://x.example' ELSE 'https://x.example/' || doc_id END AS url,
  CASE WHEN doc_id % 9 = 0 THEN 'eng' WHEN doc_id % 9 = 4 THEN lang || chr(10) ELSE lang END AS language, CASE WHEN doc_id % 8 = 0 THEN 'poem' ELSE 'act' END AS doc_type, CASE WHEN doc_id % 6 = 0 THEN []::VARCHAR[] WHEN doc_id % 6 = 1 THEN ['a', 'a'] WHEN doc_id % 6 = 2 THEN ['z'] ELSE ['a', 'b'] END AS tags FROM documents)
SELECT 'source.title' AS rule, id AS entity, 'title is missing' AS message FROM s WHERE trim(title) = ''
UNION ALL SELECT 'source.id', id, 'the id is no slug' FROM s WHERE NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*')
UNION ALL SELECT 'source.language_code', id, 'the language isn''t two letters' FROM s WHERE NOT regexp_full_match(language, '[a-z]{2}')
UNION ALL SELECT 'source.known_type', id, 'the doc_type is unknown' FROM s WHERE doc_type <> 'act'
UNION ALL SELECT 'source.https', id, 'the url isn''t an absolute https one' FROM s WHERE NOT starts_with(url, 'https://')
UNION ALL SELECT 'source.tags', id, 'there are no tags' FROM s WHERE len(tags) = 0
UNION ALL SELECT 'source.known_tags', id, 'tags are unknown' FROM s WHERE list_contains(tags, 'z')
UNION ALL SELECT 'source.tags_once', id, 'tags repeat' FROM s WHERE len(list_distinct(tags)) < len(tags)
UNION ALL SELECT 'source.unique', id, 'is listed more than once' FROM s GROUP BY id HAVING count(*) > 1"""
)
def registry_violations(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: F.col("doc_id") % n
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = table(spark, d, "documents").select(
        F.when(k(10) == 0, F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"))).when(k(10) == 3, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
        .when(k(10) == 7, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("doc-"), F.expr("cast(doc_id div 2 as string)"))).alias("id"),
        F.col("source").alias("publisher"), F.when(k(13) == 0, " ").otherwise("t").alias("title"),
        F.when(k(4) == 0, "http://x.example").otherwise(F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))).alias("url"),
        F.when(k(9) == 0, "eng").when(k(9) == 4, F.concat("lang", F.lit("\n"))).otherwise(F.col("lang")).alias("language"), F.when(k(8) == 0, "poem").otherwise("act").alias("doc_type"),
        F.when(k(6) == 0, words()).when(k(6) == 1, words("a", "a")).when(k(6) == 2, words("z")).otherwise(words("a", "b")).alias("tags"),
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("translation_of"),
    )
    return validate.sources(rows, ["act"], ["a", "b"], scoped=False)
