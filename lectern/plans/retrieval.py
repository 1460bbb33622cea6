"""Queries on ranking, fusion, listings and evaluation, with their oracles.

The questions are the benchmark's texts, a registry of fixed size; every one of them is asked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, index, search, topics
from lectern.operators import quotes as quotes_in
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


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+')) AS term FROM documents"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_BM25 = f"""
tok AS ({_TOKENS}), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT d.doc_id, coalesce(n, 0) AS dl FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id)),
stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len),
ph AS (SELECT DISTINCT item_id AS query_id, phrase, lower(strip_accents(phrase)) AS wanted, length(phrase) >= 4 AS pre
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS phrase FROM benchmark) WHERE length(phrase) > 1 AND phrase NOT IN ({_STOP})),
ex AS (SELECT query_id, phrase, term FROM (SELECT DISTINCT term FROM post) v JOIN ph ON CASE WHEN pre THEN starts_with(term, wanted) ELSE term = wanted END),
hit AS (SELECT query_id, phrase, doc_id, sum(tf)::DOUBLE AS tf FROM post JOIN ex USING (term) GROUP BY 1, 2, 3),
spr AS (SELECT query_id, phrase, CASE WHEN ln((n - k + 0.5) / (k + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - k + 0.5) / (k + 0.5)) END AS idf, avgdl FROM (SELECT query_id, phrase, count(*) AS k FROM hit GROUP BY 1, 2), stat),
bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY phrase) AS score FROM hit JOIN spr USING (query_id, phrase) JOIN len USING (doc_id) GROUP BY 1, 2),
kw AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""


@query(f"SELECT term, doc_id, count(*) AS tf FROM ({_TOKENS}) GROUP BY 1, 2")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id", "text").select("term", "doc_id", F.col("tf_text").alias("tf"))


def keyword_list(spark: SparkSession, d: str, cut: int) -> DataFrame:
    held = index.of(spark, d, table(spark, d, "documents"), "doc_id", "text")
    return search.counts_topk(questions(spark, d), held.counts, "doc_id", cut, 6)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM kw WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return keyword_list(spark, d, 10).select("query_id", "doc_id", "score", "rank")


_EMBED = """
b_{t} AS (SELECT {k} AS id, ('0x' || right(sha256(w), 2))::INTEGER % 64 AS dim, count(*)::DOUBLE AS c FROM (SELECT {k}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {t}) GROUP BY 1, 2),
e_{t} AS (SELECT id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM b_{t})"""


@query(f"WITH {_EMBED.format(t='documents', k='doc_id')} SELECT id AS doc_id, dim, round(x, 9) AS x FROM e_documents")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = search.hash_vectors(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("v").alias("dim", "x"))
    return rows.where("x > 0").withColumn("x", F.round("x", 9))


@query(
    """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def knn_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50, against all others."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search.vector_topk(asked, rows, "vec_id", 10, 6, others=True).select("query_id", "vec_id", "score", "rank")


_HYBRID = f"""{_BM25}, {_EMBED.format(t="documents", k="doc_id")}, {_EMBED.format(t="benchmark", k="item_id")},
cs AS (SELECT q.id AS query_id, v.id AS doc_id, round(sum(q.x * v.x ORDER BY q.dim), 6) AS score FROM e_benchmark q JOIN e_documents v USING (dim) GROUP BY 1, 2),
vc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs),
fu AS (SELECT query_id, doc_id, sum(t ORDER BY o) AS score FROM (SELECT query_id, doc_id, 0 AS o, 0.5::DOUBLE / (10 + rank) AS t FROM kw WHERE rank <= 200 UNION ALL SELECT query_id, doc_id, 1, 3.0::DOUBLE / (10 + rank) FROM vc WHERE rank <= 200) GROUP BY 1, 2),
rk AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    keyword = keyword_list(spark, d, search.KEPT)
    asked = search.hash_vectors(questions(spark, d), "query_id", "query").withColumnRenamed("v", "q")
    held = index.of(spark, d, table(spark, d, "documents"), "doc_id", "text")
    near = search.vector_topk(asked, held.vectors, "doc_id", search.KEPT, 6, positive=True)
    out = search.fuse({"section_keyword": keyword, "section_vector": near}, "doc_id")
    return out.withColumn("score", F.round("score", 9))


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM rk WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(fused(spark, d), "doc_id", 10).select("query_id", "doc_id", "score", "rank")

@query(SQL["hybrid_rrf"])
def delta_index_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The rows of hybrid_rrf from an index that was built on other rows and has followed them since.

    Of the rows before, every seventh document was not there yet, every fifth had another text, and each
    had a twin that is gone now.
    """
    docs = table(spark, d, "documents").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("an older text, "), F.reverse(F.coalesce("text", F.lit(""))))).otherwise(F.col("text"))
    twins = docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    held = index.Index(spark, f"{shared_dir(spark)}/lectern/delta-{uuid.uuid4().hex}", "doc_id", "text")
    for rows in (docs.where("doc_id % 7 <> 3").withColumn("text", text).unionByName(twins.where("doc_id % 4 = 0")), docs):
        held.follow(rows)
        held.part("words"), held.part("vectors")
    keyword = search.counts_topk(questions(spark, d), held.counts, "doc_id", search.KEPT, 6)
    asked = search.hash_vectors(questions(spark, d), "query_id", "query").withColumnRenamed("v", "q")
    near = search.vector_topk(asked, held.vectors, "doc_id", search.KEPT, 6, positive=True)
    out = search.fuse({"section_keyword": keyword, "section_vector": near}, "doc_id")
    return search.ranked(out.withColumn("score", F.round("score", 9)), "doc_id", 10).select("query_id", "doc_id", "score", "rank")


_SCOPES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
_SCOPED = "text || CASE item_id % 3 WHEN 0 THEN ' in French' WHEN 1 THEN ' in English or German' ELSE '' END"


def _bm25_sql(p: str, source: str, key: str) -> str:
    """The keyword ranking of `source` (key, text) for the questions of qq, in tables that end in _p."""
    dropped = ", ".join(f"'{w.lower()}'" for w in _SCOPES.values())
    return f"""
tok_{p} AS (SELECT {key}, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}),
post_{p} AS (SELECT term, {key}, count(*) AS tf FROM tok_{p} GROUP BY 1, 2),
len_{p} AS (SELECT d.{key}, coalesce(n, 0) AS dl FROM (SELECT DISTINCT {key} FROM {source}) d LEFT JOIN (SELECT {key}, count(*) AS n FROM tok_{p} GROUP BY 1) USING ({key})),
stat_{p} AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len_{p}),
ph_{p} AS (SELECT DISTINCT item_id AS query_id, phrase, lower(strip_accents(phrase)) AS wanted, length(phrase) >= 4 AS pre
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS phrase FROM qq) WHERE length(phrase) > 1 AND phrase NOT IN ({_STOP}, {dropped})),
ex_{p} AS (SELECT query_id, phrase, term FROM (SELECT DISTINCT term FROM post_{p}) v JOIN ph_{p} ON CASE WHEN pre THEN starts_with(term, wanted) ELSE term = wanted END),
hit_{p} AS (SELECT query_id, phrase, {key}, sum(tf)::DOUBLE AS tf FROM post_{p} JOIN ex_{p} USING (term) GROUP BY 1, 2, 3),
spr_{p} AS (SELECT query_id, phrase, CASE WHEN ln((n - k + 0.5) / (k + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - k + 0.5) / (k + 0.5)) END AS idf, avgdl FROM (SELECT query_id, phrase, count(*) AS k FROM hit_{p} GROUP BY 1, 2), stat_{p}),
bm_{p} AS (SELECT query_id, {key}, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY phrase) AS score FROM hit_{p} JOIN spr_{p} USING (query_id, phrase) JOIN len_{p} USING ({key}) GROUP BY 1, 2),
kw_{p} AS (SELECT query_id, {key}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank FROM bm_{p})"""


def _near_sql(p: str, source: str, key: str, where: str) -> str:
    return f"""
vc_{p} AS (SELECT query_id, {key}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (
  SELECT q.id AS query_id, v.id AS {key}, round(coalesce(s, 0), 6) AS score FROM (SELECT DISTINCT id FROM e_qq) q CROSS JOIN (SELECT DISTINCT id FROM e_{source}) v
  LEFT JOIN (SELECT q.id AS a, v.id AS b, sum(q.x * v.x ORDER BY q.dim) AS s FROM e_qq q JOIN e_{source} v USING (dim) GROUP BY 1, 2) ON a = q.id AND b = v.id) {where})"""


@query(
    f"""
WITH qq AS (SELECT item_id, {_SCOPED} AS text FROM benchmark), st AS (SELECT conv_id * 100000 + turn AS statement_id, conv_id AS doc_id, text FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)),
sco AS (SELECT item_id AS query_id, scope FROM qq, (VALUES {", ".join(f"('{k}', '{v.lower()}')" for k, v in _SCOPES.items())}) n(scope, name) WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ', ' ' || name || ' ')),
perm AS (SELECT item_id AS query_id, doc_id FROM qq, documents WHERE item_id NOT IN (SELECT query_id FROM sco) OR lang IN (SELECT scope FROM sco WHERE query_id = item_id)),
{_bm25_sql("d", "documents", "doc_id")}, {_bm25_sql("s", "st", "statement_id")},
{_EMBED.format(t="documents", k="doc_id")}, {_EMBED.format(t="st", k="statement_id")}, {_EMBED.format(t="qq", k="item_id")},
{_near_sql("d", "documents", "doc_id", "SEMI JOIN perm USING (query_id, doc_id)")}, {_near_sql("s", "st", "statement_id", "")},
l1 AS (SELECT query_id, doc_id, 0 AS o, 0.5 AS w, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM kw_d SEMI JOIN perm USING (query_id, doc_id) WHERE rank <= 1000),
l2 AS (SELECT query_id, doc_id, 1 AS o, 0.5 AS w, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS r FROM kw_s JOIN st USING (statement_id) SEMI JOIN perm USING (query_id, doc_id) WHERE rank <= 1000 GROUP BY 1, 2),
l3 AS (SELECT query_id, doc_id, 2 AS o, 3.0 AS w, rank AS r FROM vc_d),
l4 AS (SELECT query_id, doc_id, 3 AS o, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS r FROM vc_s JOIN st USING (statement_id) SEMI JOIN perm USING (query_id, doc_id) WHERE rank <= 1000 GROUP BY 1, 2),
fu AS (SELECT query_id, doc_id, sum(w::DOUBLE / (10 + r) ORDER BY o) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) WHERE r <= 200 GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu) WHERE rank <= 10"""
)
def search_four_lists(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sections of a scope each, turns as statements on them; questions name scopes in words."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_SCOPED).alias("query"))
    names = spark.createDataFrame(list(_SCOPES.items()), "scope string, name string")
    only = search.infer_scopes(asked, names).groupBy("query_id").agg(F.sort_array(F.collect_set("scope")).alias("only"))
    asked = materialize(asked.join(only, "query_id", "left"), "questions")
    docs = table(spark, d, "documents")
    owner = docs.select(F.col("doc_id").alias("conv_id")).distinct()
    stated = table(spark, d, "conversations").join(owner, "conv_id", "left_semi")
    stated = stated.select((F.col("conv_id") * 100000 + F.col("turn")).alias("statement_id"), F.col("conv_id").alias("chunk_id"), "text")
    parts = index.of(spark, d, docs, "doc_id", "text").renamed("doc_id", "chunk_id")
    about = index.of(spark, d + "#turns", stated, "statement_id", "text")
    sections = docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("scope"))
    dropped = F.array(*[F.lit(w.lower()) for w in _SCOPES.values()])
    found = search.four_lists(asked, sections, stated.select("statement_id", "chunk_id"), parts, about, search.hash_vectors, dropped, 6)
    out = search.ranked(found.withColumn("score", F.round("score", 9)), "chunk_id", 10)
    return out.select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


@query(
    f"""WITH {_HYBRID}, dg AS (SELECT query_id, d.doc_id, rank, sha256(coalesce(text, '')) AS digest FROM rk JOIN documents d USING (doc_id)),
fst AS (SELECT *, min(rank) OVER (PARTITION BY query_id, digest) AS best FROM dg), pl AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS result_no FROM fst)
SELECT query_id, result_no::INTEGER AS result_no, max(doc_id) FILTER (rank = best) AS doc_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank > best), '') AS also_in FROM pl WHERE result_no <= 10 GROUP BY 1, 2"""
)
def search_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: two rankings, fusion, and equal texts as one result."""
    texts = table(spark, d, "documents").select("doc_id", T.sha(F.coalesce("text", F.lit(""))).alias("digest"), F.col("doc_id").cast("string").alias("label"))
    rows = fused(spark, d).join(texts, "doc_id")
    out = search.collapse(rows, "digest", "label", [F.desc("score"), F.col("doc_id")], 10)
    return out.select("query_id", "result_no", "doc_id", F.array_join("also_in", ",").alias("also_in"))


@query(
    "SELECT lang, doc_id, also_in FROM (SELECT lang, min(doc_id) AS doc_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (doc_id > first), '') AS also_in FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first FROM documents) GROUP BY lang, sha256(text))"
)
def collapse_also_in(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts of a language, by aggregation alone: nothing is sorted but the labels of copies."""
    digest = T.sha("text")
    groups = table(spark, d, "documents").groupBy("lang", digest.alias("digest")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    later = F.transform(F.slice("ids", F.lit(2), F.size("ids")), lambda i: i.cast("string"))
    return groups.select("lang", F.col("ids")[0].alias("doc_id"), F.array_join(later, ",").alias("also_in"))


@query(
    "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND list_has_any([lang, source], ['fr', 'src1', 'src2', 'src3']) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
)
def allowed_set(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("scope"), F.array("lang", "source").alias("tags"))
    topic = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("topic"))
    return search.allowed(chunks, topic, ["en", "fr"], ["fr", "src1", "src2", "src3"], ["good"]).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_translated(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("translation_of"), F.lit(None).cast("long").alias("c_custkey"))
    rows = table(spark, d, "customer").select("c_custkey", F.lit(None).cast("long").alias("translation_of")).unionByName(done)
    return topics.untranslated(rows, "c_custkey").where("c_custkey is not null").select("c_custkey")


@query(
    """
WITH q AS (SELECT c_custkey, ' ' || array_to_string(regexp_extract_all(lower('orders of ' || a.n_name || ' or ' || b.n_name || ' by ' || c_name), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS t
  FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 25)
SELECT c_custkey AS query_id, n_nationkey AS scope FROM q, nation WHERE contains(t, ' ' || lower(n_name) || ' ')"""
)
def infer_scopes(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("an")), nation.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("bn"))
    asked = table(spark, d, "customer").join(a, F.col("c_nationkey") == F.col("ak")).join(b, F.col("c_custkey") % 25 == F.col("bk"))
    asked = asked.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("orders of "), "an", F.lit(" or "), "bn", F.lit(" by "), "c_name").alias("query"))
    return search.infer_scopes(asked, nation.select(F.col("n_nationkey").alias("scope"), F.col("n_name").alias("name")))


@query(
    """
WITH o AS (SELECT o_orderstatus, o_orderpriority, o_orderkey, o_totalprice, lower(o_orderpriority) || ' ' || (o_custkey % 100) AS q FROM orders),
k AS (SELECT *, trim(regexp_replace(q, '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS key FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, key ORDER BY o_orderkey) AS n FROM k),
g AS (SELECT o_orderstatus, key, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) FILTER (n > 1), '') AS also_in FROM f GROUP BY 1, 2),
p AS (SELECT f.*, also_in, count(*) OVER (PARTITION BY o_orderstatus) AS total,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END, o_totalprice DESC, o_orderkey) AS place FROM f JOIN g USING (o_orderstatus, key) WHERE n = 1)
SELECT o_orderstatus, o_orderkey, also_in, total, place::INTEGER AS place FROM p WHERE place <= 40"""
)
def topic_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumns(
        {"quote": F.concat_ws(" ", F.lower("o_orderpriority"), (F.col("o_custkey") % 100).cast("string")), "label": F.col("o_orderkey").cast("string")}
    )
    order = [topics.rank_of("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), F.desc("o_totalprice"), F.col("o_orderkey")]
    out = topics.topic_listing(rows, ["o_orderstatus"], "quote", "label", order, ["o_orderkey"], topics.clamp(40, 200))
    return out.select("o_orderstatus", "o_orderkey", F.array_join("also_in", ",").alias("also_in"), "total", "place")




@query(
    """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS effective_from FROM orders)
SELECT o_orderkey, effective_from, CASE WHEN NOT coalesce(effective_from <= substr('1996-06-15', 1, length(effective_from)), true) THEN false END AS in_force FROM p"""
)
def availability_in_force(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    partial = F.when(k == 0, F.substring(day, 1, 4)).when(k == 1, F.substring(day, 1, 7)).when(k == 2, day)
    rows = table(spark, d, "orders").select("o_orderkey", partial.alias("effective_from"))
    return topics.availability(rows, "1996-06-15")


@query(
    """
WITH cur AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, cur.o_orderkey AS current_order, coalesce(n.n, 0) AS n_orders, coalesce(u.n, 0) AS n_urgent FROM customer LEFT JOIN cur ON cur.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN u ON u.o_custkey = c_custkey"""
)
def sources_listing(spark: SparkSession, d: str) -> DataFrame:
    from lectern.operators import versions

    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderpriority")
    now = versions.current(orders, "c_custkey", "o_orderdate", "o_orderdate", "o_orderkey").select("c_custkey", F.col("o_orderkey").alias("current_order"))
    counts = [("n_orders", orders), ("n_urgent", orders.where("o_orderpriority = '1-URGENT'"))]
    return topics.sources(table(spark, d, "customer").select("c_custkey"), now, counts, "c_custkey")


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def get_section(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("ref", F.concat(F.lit("s (part "), F.col("turn").cast("string"), F.lit(")")))
    out = topics.section(rows, ["conv_id"], "ref", "turn", "text")
    return out.select("conv_id", T.sha("section_text").alias("sha256"), "n_parts")


_COMPARABLE = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace({x}, chr(173), ''), '\s+', ' ', 'g')), '(\p{{L}}) ?- ?(\p{{L}})', '\1\2', 'g'), '(\p{{L}}) ?- ?(\p{{L}})', '\1\2', 'g'), '\s+', '', 'g')"
_EXPECTED = f"SELECT item_id AS query_id, doc_id FROM (SELECT item_id, {_COMPARABLE.format(x='text')} AS q FROM benchmark) JOIN (SELECT doc_id, {_COMPARABLE.format(x='text')} AS t FROM documents) ON contains(t, q)"


@query(f"SELECT query_id AS item_id, doc_id FROM ({_EXPECTED})")
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """All quotes against all texts, whatever white space and hyphens do."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), T.comparable("text").alias("quote"))
    texts = table(spark, d, "documents").select("doc_id", T.comparable("text").alias("t"))
    return quotes_in.containing(texts, "doc_id", "t", quotes).select(F.col("quote_id").alias("item_id"), "doc_id")


@query(
    """
WITH s AS (SELECT DISTINCT trim(s) AS quote FROM (SELECT unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT string_split_regex(coalesce(text, ''), '[.!?\\n]') AS l FROM documents)) WHERE k % 3 = 1 AND trim(s) <> '')
SELECT sha256(quote) AS quote_sha, doc_id FROM s JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) ON contains(text, quote)"""
)
def sentence_containment(spark: SparkSession, d: str) -> DataFrame:
    """Every third sentence of the documents as a quote (the stated query set), against all documents."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = docs.select(F.posexplode(F.split("text", r"[.!?\n]", -1)).alias("k", "s")).where("k % 3 = 0").select(F.trim("s").alias("quote")).where("quote <> ''").distinct()
    found = quotes_in.containing(docs, "doc_id", "text", said.select(T.sha("quote").alias("quote_id"), "quote"))
    return found.select(F.col("quote_id").alias("quote_sha"), "doc_id")


@query(
    f"""WITH {_HYBRID}, x AS ({_EXPECTED}), h AS (SELECT query_id, min(rank) AS first_rank FROM rk JOIN x USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1)
SELECT query_id, first_rank::INTEGER AS first_rank, first_rank IS NOT NULL AS hit FROM (SELECT DISTINCT query_id FROM x) LEFT JOIN h USING (query_id)"""
)
def golden_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    expected = quote_containment(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("place"))
    found = search.ranked(fused(spark, d), "doc_id", 5).select("query_id", "rank", F.col("doc_id").alias("place"))
    return audit.hit_rate(found, materialize(expected, "expected"))


@query(
    f"""WITH rk AS ({SQL["search_four_lists"]}), dd AS (SELECT doc_id, source FROM documents),
x AS (SELECT item_id AS query_id, 'src' || (item_id % 2) || '*' AS a, '*' || (item_id % 10) AS b FROM benchmark UNION ALL SELECT item_id, 'src?', '[!0-4]*' FROM benchmark WHERE item_id % 3 = 0),
h AS (SELECT query_id, min(rank) AS first_rank FROM rk JOIN dd USING (doc_id) JOIN x USING (query_id) WHERE rank <= 5 AND source GLOB a AND doc_id::VARCHAR GLOB b GROUP BY 1)
SELECT query_id, first_rank::INTEGER AS first_rank, first_rank IS NOT NULL AS hit FROM (SELECT DISTINCT query_id FROM x) LEFT JOIN h USING (query_id)"""
)
def golden_globs(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions whose answers are told by globs on sources and ids, over the search of four lists."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    k = lambda n: (F.col("query_id") % n).cast("string")
    one = asked.select("query_id", F.concat(F.lit("src"), k(2), F.lit("*")).alias("source_glob"), F.concat(F.lit("*"), k(10)).alias("section_glob"))
    two = asked.where("query_id % 3 = 0").select("query_id", F.lit("src?").alias("source_glob"), F.lit("[!0-4]*").alias("section_glob"))
    named = table(spark, d, "documents").select("doc_id", F.col("source").alias("document"), F.col("doc_id").cast("string").alias("ref"))
    found = search_four_lists(spark, d).join(named, "doc_id").select("query_id", "rank", "document", "ref")
    return audit.glob_hits(found, one.unionByName(two)).select("query_id", "first_rank", "hit")
