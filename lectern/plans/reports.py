"""Queries on reports, reviews, fetches and samples, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, search, topics, trust, versions
from lectern.session import table
from lectern.sources import markup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INTEGER AS place FROM events GROUP BY event_type")
def modality_distribution(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))  # one row a modality


@query("SELECT user_id, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY avg(value), user_id LIMIT 15")
def lowest_sources(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 15 groups of three or more with the lowest means."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n")).where("n >= 3").orderBy("m", "user_id").limit(15)
    return rows.select("user_id", F.round("m", 6).alias("mean_value"), "n")


@query(
    """
WITH q AS (SELECT b.item_id, d.doc_id, d.text, b.text AS quote, instr(d.text, b.text) AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT item_id, doc_id, sha256(substr(text, greatest(pos - 1500, 1), greatest(pos, 1) - greatest(pos - 1500, 1) + length(quote) + 1500)) AS sha256 FROM q"""
)
def judge_windows(spark: SparkSession, d: str) -> DataFrame:
    """What a judge gets to read: the text around each quote."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    texts = table(spark, d, "documents").select("doc_id", "text")
    held = search.containing(texts, "doc_id", "text", quotes).distinct()
    rows = texts.join(held, "doc_id").join(quotes, "quote_id").withColumnRenamed("quote_id", "item_id")
    return rows.select("item_id", "doc_id", T.sha(audit.window_around("text", "quote")).alias("sha256"))


_CURRENT = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT e.event_id, CASE WHEN e.event_id <> c.event_id THEN 'earlier' END AS which FROM events e JOIN ({_CURRENT}) c USING (user_id)")
def review_overview(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with a mark on those of an earlier version."""
    ev = table(spark, d, "events").select("user_id", "event_id", "ts")
    now = versions.current(ev, "user_id", "ts", "ts", "event_id").select("user_id", F.col("event_id").alias("current_id"))
    return ev.join(now, "user_id").select("event_id", F.when(F.col("event_id") != F.col("current_id"), "earlier").alias("which"))


@query(f"SELECT user_id, count(*) AS stale FROM events e JOIN ({_CURRENT}) c USING (user_id) WHERE e.event_id <> c.event_id GROUP BY user_id")
def stale_statements(spark: SparkSession, d: str) -> DataFrame:
    return review_overview(spark, d).where("which = 'earlier'").join(table(spark, d, "events").select("event_id", "user_id"), "event_id").groupBy("user_id").agg(F.count("*").alias("stale"))


@query(
    "SELECT page_id, CASE WHEN contains(html, 'track(7') THEN 'tracker' WHEN contains(html, '<form') THEN 'form' END AS challenge, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages"
)
def challenge_pages(spark: SparkSession, d: str) -> DataFrame:
    marks = {"<form": "form", "track(7": "tracker"}  # the last one counts first
    return table(spark, d, "pages").select("page_id", markup.challenge("html", marks).alias("challenge"), T.host("url").alias("host"))


@query(
    "SELECT source, count(*) AS sections, count(*) FILTER (q IS NOT NULL) AS cached, count(*) FILTER (q IS NULL) AS called, coalesce(sum(CASE WHEN q = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS rejected FROM (SELECT d.source, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source"
)
def extract_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return rows.groupBy("source").agg(
        F.count("*").alias("sections"), F.count_if(q.isNotNull()).alias("cached"), F.count_if(q.isNull()).alias("called"), F.count_if(q == 0).alias("rejected")
    )


@query(
    "SELECT p_partkey, p_brand, CASE WHEN p_type LIKE '%1' THEN true WHEN p_type LIKE '%2' THEN false ELSE true END AS binding FROM part WHERE contains(p_brand, '2') ORDER BY p_partkey LIMIT 15"
)
def similar_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to suggest for one that isn't there: a list of 15 by rule."""
    rows = topics.similar_refs(table(spark, d, "part"), "p_brand", "brand 2", "p_partkey")
    return rows.select("p_partkey", "p_brand", F.when(F.col("p_type").like("%1"), True).when(F.col("p_type").like("%2"), False).otherwise(True).alias("binding"))


@query(
    """
SELECT o_orderpriority, count(*) AS statements, count(DISTINCT key) AS distinct_quotes FROM (SELECT o_orderpriority, trim(regexp_replace(lower(o_orderpriority || '/' || (o_custkey % 50)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS key FROM orders) GROUP BY 1"""
)
def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    quote = F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 50).cast("string"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("statements"), F.count_distinct(T.dedupe_key(quote)).alias("distinct_quotes"))


@query(
    "SELECT doc_id, CASE WHEN length(text) > 700 THEN substr(text, 1, 700) || ' …' ELSE text END AS excerpt, regexp_replace(substr(text, 1, 60), '[0-9]+', '#', 'g') AS shape FROM documents"
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"), T.shape(F.substring("text", 1, 60)).alias("shape"))


@query(
    "SELECT a.o_custkey, abs(a.n - b.n) <= greatest(1, round_even(greatest(a.n, b.n) * 0.25, 0)) AS close FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b USING (o_custkey)"
)
def close_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    a = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("a"))
    b = orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("b"))
    return a.join(b, "o_custkey").select("o_custkey", audit.close_counts(F.col("a"), F.col("b")).alias("close"))


@query(
    "SELECT user_id, CASE WHEN bool_or(v = 'disputed') THEN 'disputed' WHEN bool_or(v = 'vetted') THEN 'official' ELSE 'secondary' END AS level FROM (SELECT user_id, event_type, arg_max(CASE WHEN value < 3 THEN 'disputed' WHEN value > 30 THEN 'vetted' ELSE 'none' END, (ts, event_id)) AS v FROM events GROUP BY 1, 2) GROUP BY 1"
)
def trust_from_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Latest verdicts of each reviewer move a source's level: any dispute sinks it, vetting is one step."""
    verdict = F.when(F.col("value") < 3, "disputed").when(F.col("value") > 30, "vetted").otherwise("none")
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("reviewer"), "ts", "event_id", verdict.alias("verdict"))
    last = trust.latest_verdicts(rows, "user_id", "reviewer", "verdict", ["ts", "event_id"])
    per = last.groupBy("user_id").agg(F.bool_or(F.col("verdict") == "vetted").alias("vetted"), F.bool_or(F.col("verdict") == "disputed").alias("disputed"))
    yes, no = F.lit(True), F.lit(False)
    return per.select("user_id", trust.level(yes, no, yes, F.col("vetted"), F.col("disputed")).alias("level"))
