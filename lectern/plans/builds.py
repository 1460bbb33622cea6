"""Queries on whole runs: a comparison of two builds and an extraction with its memo, with their oracles."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import comparison, extraction_run, search
from lectern.plans.retrieval import _EMBED
from lectern.session import materialize, shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_BUILDS = f"""
WITH a AS (SELECT conv_id, conv_id * 100000 + turn AS id, text, role AS modality, [role, substr(text, 1, 1)] AS topics FROM conversations WHERE text IS NOT NULL),
b AS (SELECT conv_id, id, CASE WHEN id % 4 = 1 THEN substr(text, 1, 60) ELSE text END AS text, CASE WHEN id % 5 = 2 THEN 'system' ELSE modality END AS modality, topics FROM a WHERE id % 3 <> 2),
{_EMBED.format(t="a", k="id")}, {_EMBED.format(t="b", k="id")},
cs AS (SELECT a.conv_id, p.id AS l, q.id AS r, sum(p.x * q.x) AS cos FROM e_a p JOIN a ON a.id = p.id JOIN b ON b.conv_id = a.conv_id JOIN e_b q ON q.id = b.id AND q.dim = p.dim GROUP BY 1, 2, 3),
full_pairs AS (SELECT a.conv_id, a.id AS l, b.id AS r, coalesce(cos, 0) AS cos FROM a JOIN b USING (conv_id) LEFT JOIN cs ON cs.l = a.id AND cs.r = b.id),
fo AS (SELECT conv_id, avg(m) AS f FROM (SELECT conv_id, l, max(cos) AS m FROM full_pairs GROUP BY 1, 2) GROUP BY 1), ba AS (SELECT conv_id, avg(m) AS g FROM (SELECT conv_id, r, max(cos) AS m FROM full_pairs GROUP BY 1, 2) GROUP BY 1),
bare AS (SELECT conv_id, sum((id NOT IN (SELECT id FROM e_a))::INTEGER) AS n FROM a GROUP BY 1), bare_b AS (SELECT conv_id, sum((id NOT IN (SELECT id FROM e_b))::INTEGER) AS n FROM b GROUP BY 1),
ta AS (SELECT conv_id, count(*) AS n, list_distinct(list(text)) AS q, list_distinct(flatten(list(topics))) AS t FROM a GROUP BY 1), tb AS (SELECT conv_id, count(*) AS n, list_distinct(list(text)) AS q, list_distinct(flatten(list(topics))) AS t FROM b GROUP BY 1),
mo AS (SELECT conv_id, sum(greatest(x.n - coalesce(y.n, 0), 0)) AS lost FROM (SELECT conv_id, modality, count(*) AS n FROM a GROUP BY 1, 2) x LEFT JOIN (SELECT conv_id, modality, count(*) AS n FROM b GROUP BY 1, 2) y USING (conv_id, modality) GROUP BY 1),
jac AS (SELECT ta.conv_id, ta.n AS n_base, tb.n AS n_rerun, len(list_intersect(ta.q, tb.q))::DOUBLE / len(list_distinct(list_concat(ta.q, tb.q))) AS quotes, len(list_intersect(ta.t, tb.t))::DOUBLE / len(list_distinct(list_concat(ta.t, tb.t))) AS topics,
  1 - lost / greatest(ta.n, 1) AS modalities, CASE WHEN bare.n = 0 AND bare_b.n = 0 THEN (f + g) / 2 ELSE 0 END AS summary FROM ta JOIN tb USING (conv_id) JOIN mo USING (conv_id) JOIN fo USING (conv_id) JOIN ba USING (conv_id) JOIN bare USING (conv_id) JOIN bare_b USING (conv_id))"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sections and their turns as statements; the second reading lacks a third of them and cuts a quarter short."""
    said = table(spark, d, "conversations").where("text is not null")
    base = said.select(F.col("conv_id").alias("chunk_id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("quote"), F.col("role").alias("modality"), F.array("role", F.substring("text", 1, 1)).alias("topics"))
    quote = F.when(F.col("id") % 4 == 1, F.substring("quote", 1, 60)).otherwise(F.col("quote"))
    rerun = base.where("id % 3 <> 2").withColumns({"quote": quote, "modality": F.when(F.col("id") % 5 == 2, "system").otherwise(F.col("modality"))})
    base, rerun = materialize(base, "base"), materialize(rerun, "rerun")
    sides = [rows.join(search.hash_vectors(rows, "id", "quote"), "id", "left") for rows in (base, rerun)]
    sections = base.select(F.concat(F.lit("d"), (F.col("chunk_id") % 7).cast("string")).alias("document"), F.col("chunk_id").cast("string").alias("ref"), F.lit("same").alias("sha256"), "chunk_id", F.lit(0).alias("ord")).distinct()
    return comparison.extraction(comparison.met_sections(sections, sections, rerun), *sides)


@query(_BUILDS + " SELECT conv_id, n_base, n_rerun, round(quotes, 9) AS quotes, round(topics, 9) AS topics, round(modalities, 9) AS modalities, round(summary, 6) AS summary FROM jac")
def build_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = _compared(spark, d)
    return rows.select(F.col("section").alias("conv_id"), "n_base", "n_rerun", *[F.round(c, 9).alias(c) for c in ("quotes", "topics", "modalities")], F.round("summary", 6).alias("summary"))


@query(
    _BUILDS
    + """ SELECT count(*) AS sections, sum(n_base)::BIGINT AS statements_base, sum(n_rerun)::BIGINT AS statements_rerun, round(avg((n_base = n_rerun)::INTEGER), 6) AS share_equal,
  round(avg((abs(n_base - n_rerun) <= greatest(1, round_even(greatest(n_base, n_rerun) * 0.25, 0)))::INTEGER), 6) AS share_close, round(avg(quotes), 6) AS mean_quotes, round(quantile_cont(quotes, 0.5), 6) AS median_quotes,
  round(avg(topics), 6) AS mean_topics, round(avg(modalities), 6) AS mean_modalities, round(avg(summary), 6) AS mean_summary FROM jac"""
)
def build_comparison_report(spark: SparkSession, d: str) -> DataFrame:
    out = comparison.report(_compared(spark, d))
    whole = ("sections", "statements_base", "statements_rerun")
    return out.select(*whole, *[F.round(c, 6).alias(c) for c in out.columns if c not in whole])


@query(_BUILDS + " SELECT conv_id, round(summary, 6) AS summary, round(quotes, 9) AS quotes FROM jac ORDER BY round(summary, 6), round(quotes, 9), 'd' || (conv_id % 7), conv_id::VARCHAR LIMIT 15")
def build_comparison_worst(spark: SparkSession, d: str) -> DataFrame:
    """A report of the 15 sections that agree least."""
    rows = _compared(spark, d).withColumns({"summary": F.round("summary", 6), "quotes": F.round("quotes", 9)})
    return comparison.worst(rows, 15).select(F.col("section").alias("conv_id"), "summary", "quotes")


def _reader(system: str, message: str) -> str:
    """A deterministic stand-in for a model: the first sentence as a statement, once with a modality that isn't known."""
    body = message.split("<section>\n", 1)[1].rsplit("\n</section>", 1)[0]
    if len(body) % 7 == 0:
        raise RuntimeError("no answer")
    first = body.split(".", 1)[0]
    record = {"verbatim_quote": first, "summary": "it says so", "modality": "must", "topics": ["recalls"], "applies_to": ["food"]}
    return "```json\n" + json.dumps({"statements": [record, {**record, "modality": "perhaps"}]}) + "\n```"


@query(
    """
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), '.')[1] AS f FROM documents),
o AS (SELECT doc_id, length(text) % 7 = 0 AS failed, trim(f) <> '' AND length(f) <= 1000 AS fine FROM s)
SELECT doc_id, NOT failed AS cached, CASE WHEN failed THEN 0 WHEN fine THEN 1 ELSE 0 END::BIGINT AS n_kept, CASE WHEN failed THEN 0 WHEN fine THEN 1 ELSE 2 END::BIGINT AS n_rejected,
  CASE WHEN failed THEN 'failed: kept' WHEN fine THEN 'stored' ELSE 'rejected: cleared' END AS outcome FROM o"""
)
def extraction_second_run(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a section, read twice: the second run finds all answers in the memo and asks anew where it failed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("section"), F.lit("s. 1").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("message", F.concat(F.lit("Source: "), F.col("section").cast("string"), F.lit("\n<section>\n"), "text", F.lit("\n</section>")))
    path = f"{shared_dir(spark)}/lectern/memo-{uuid.uuid4().hex}"
    for _ in range(2):
        out, _kept = extraction_run.run(docs, path, _reader, "Read.", "v1", "stand-in", ["must"], ["recalls"], F.array(F.lit("food")))
    return out.select(F.col("section").alias("doc_id"), "cached", "n_kept", "n_rejected", "outcome")
