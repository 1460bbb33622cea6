"""Queries on what a rebuild changes, on extraction runs, agreement, reviews and registry rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, extraction, store, topics, trust, validate, versions
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


# orders are versions, their lines the sections; the new build differs where the order key says so
_OLD = "SELECT l_orderkey AS version_id, l_linenumber AS ord, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag AS section_ref, sha256(l_partkey::VARCHAR) AS sha256 FROM lineitem WHERE l_orderkey % 11 <> 0"
_NEW = """SELECT l_orderkey AS version_id, l_linenumber AS ord, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag AS section_ref, sha256((l_partkey + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END)::VARCHAR) AS sha256
  FROM lineitem WHERE l_orderkey % 13 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)"""
_ACTIONS = f"""o AS ({_OLD}), n AS ({_NEW}), c AS (SELECT DISTINCT chunk_id FROM o WHERE version_id % 3 = 0),
a AS (SELECT coalesce(o.version_id, n.version_id) AS version_id, CASE WHEN count(*) FILTER ((o.section_ref, o.sha256) IS DISTINCT FROM (n.section_ref, n.sha256) OR o.ord IS NULL OR n.ord IS NULL) = 0 OR count(n.ord) = 0 THEN 'kept'
  WHEN count(o.ord) = 0 THEN 'new' WHEN bool_or(c.chunk_id IS NOT NULL) THEN 'refused' ELSE 'replaced' END AS action FROM o FULL JOIN n ON o.version_id = n.version_id AND o.ord = n.ord LEFT JOIN c ON c.chunk_id = o.chunk_id GROUP BY 1)"""


def _builds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")

    def sections(part):
        return [key.alias("version_id"), line.alias("ord"), (key * 10 + line).alias("chunk_id"), F.col("l_returnflag").alias("section_ref"), part.alias("part"), T.sha(part.cast("string")).alias("sha256")]

    old = lines.where(key % 11 != 0).select(*sections(F.col("l_partkey")))
    other = F.col("l_partkey") + F.when((key % 5 == 0) & (line == 1), 1).otherwise(0)
    new = lines.where((key % 13 != 0) & ~((key % 7 == 0) & (line == 2))).select(*sections(other))
    return old, new, old.where("version_id % 3 = 0").select("chunk_id")


@query(f"WITH {_ACTIONS} SELECT version_id, action FROM a")
def store_actions(spark: SparkSession, d: str) -> DataFrame:
    """What a build may do to each version; what statements cite is never changed."""
    return store.section_actions(*_builds(spark, d))


@query(
    f"WITH {_ACTIONS} SELECT chunk_id, sha256 FROM o WHERE version_id NOT IN (SELECT version_id FROM a WHERE action IN ('new', 'replaced')) UNION ALL SELECT chunk_id, sha256 FROM n WHERE version_id IN (SELECT version_id FROM a WHERE action IN ('new', 'replaced'))"
)
def store_sections(spark: SparkSession, d: str) -> DataFrame:
    old, new, cited = _builds(spark, d)
    actions = store.section_actions(old, new, cited)
    kept = store.replace_sections(old.drop("sha256"), new.drop("sha256"), actions)  # digests are longer than what they are of
    return kept.select("chunk_id", T.sha(F.col("part").cast("string")).alias("sha256"))


@query(f"WITH {_ACTIONS} SELECT chunk_id FROM o WHERE version_id NOT IN (SELECT version_id FROM a WHERE action = 'replaced')")
def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    old, new, cited = _builds(spark, d)
    return store.dropped_vectors(old.select("chunk_id"), old, store.section_actions(old, new, cited))


@query(
    "SELECT event_id, user_id AS chunk_id, event_type AS modality FROM events WHERE user_id % 3 <> 0 OR user_id IS NULL UNION ALL SELECT event_id + 1000000, user_id, 'new' FROM events WHERE user_id % 3 = 0 AND value > 20"
)
def statement_replace(spark: SparkSession, d: str) -> DataFrame:
    """Statements of the sections that were read again are replaced, also by nothing."""
    rows = table(spark, d, "events")
    old = rows.select("event_id", F.col("user_id").alias("chunk_id"), F.col("event_type").alias("modality"))
    new = rows.where("value > 20").select(F.col("event_id") + 1000000, F.col("user_id").alias("chunk_id"), F.lit("new").alias("modality")).toDF("event_id", "chunk_id", "modality")
    return store.replace_statements(old, new, old.where("chunk_id % 3 = 0").select("chunk_id"))


_RUN_REF = "CASE WHEN doc_id % 9 = 0 THEN '(preamble)' ELSE source END"


@query(
    f"""
WITH s AS (SELECT doc_id, source, coalesce(text, '') AS text, {_RUN_REF} AS ref FROM documents),
w AS (SELECT *, CASE WHEN starts_with(ref, '(preamble)') THEN 'preamble' WHEN regexp_matches(ref, '^(?:src1)') THEN 'skipped' WHEN NOT regexp_matches(text, '[Tt]he?') THEN 'unmatched' END AS why FROM s),
l AS (SELECT doc_id, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality = 0) AS rejected FROM labels GROUP BY 1),
x AS (SELECT w.*, coalesce(kept, 0) AS kept, coalesce(rejected, 0) AS rejected, CASE WHEN why IS NULL AND w.doc_id % 17 = 0 THEN 'timeout' END AS error FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, CASE WHEN why = 'skipped' THEN 'skipped: cleared' WHEN why IS NOT NULL THEN 'not read' WHEN error IS NOT NULL THEN 'failed: kept' WHEN kept > 0 THEN 'stored' WHEN rejected > 0 THEN 'rejected: cleared' ELSE 'none: cleared' END AS outcome FROM x"""
)
def extraction_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A run over all sections: which are read, and what that does to the statements they have."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_RUN_REF).alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("why", extraction.eligibility("ref", "text", "src1", "[Tt]he?"))
    found = table(spark, d, "labels").groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("kept"), F.count_if(F.col("quality") == 0).alias("rejected"))
    rows = rows.join(found, "doc_id", "left").withColumn("error", F.when(F.col("why").isNull() & (F.col("doc_id") % 17 == 0), "timeout"))
    return extraction.outcomes(rows, F.coalesce("kept", F.lit(0)), F.coalesce("rejected", F.lit(0))).select("doc_id", "outcome")


@query(
    """
WITH s AS (SELECT o_orderkey AS id, o_custkey AS chunk_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS original_id FROM orders),
t AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS topics FROM lineitem GROUP BY 1)
SELECT s.id, s.chunk_id, topics, c_name AS original, row_number() OVER (PARTITION BY s.chunk_id ORDER BY s.id)::INTEGER AS n FROM s LEFT JOIN t USING (id) LEFT JOIN customer ON c_custkey = original_id"""
)
def statement_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("original_id"))
    said = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("topic"))
    originals = table(spark, d, "customer").select(F.col("c_custkey").alias("original_id"), F.col("c_name").alias("label"))
    return topics.statement_rows(rows, said, originals, "id", ["id"])


_AGREE = """
WITH b AS (SELECT user_id AS section, event_type AS topic, CASE WHEN value < 25 THEN 'must' ELSE 'may' END AS modality FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id AS section, event_type AS topic, CASE WHEN value < 30 THEN 'must' ELSE 'may' END AS modality FROM events WHERE event_id % 3 <> 0 AND event_type <> 'error'),
x AS (SELECT section, count(*) AS n_base, list_distinct(list(topic)) AS t FROM b GROUP BY 1), y AS (SELECT section, count(*) AS n_rerun, list_distinct(list(topic)) AS t FROM r GROUP BY 1),
m AS (SELECT section, 1 - sum(greatest(nb - coalesce(nr, 0), 0)) / greatest(sum(nb), 1) AS modalities FROM (SELECT section, modality, count(*) AS nb FROM b GROUP BY 1, 2) LEFT JOIN (SELECT section, modality, count(*) AS nr FROM r GROUP BY 1, 2) USING (section, modality) GROUP BY 1),
a AS (SELECT section, coalesce(n_base, 0) AS n_base, coalesce(n_rerun, 0) AS n_rerun, CASE WHEN x.t IS NULL AND y.t IS NULL THEN 1.0 ELSE len(list_intersect(coalesce(x.t, []), coalesce(y.t, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(x.t, []), coalesce(y.t, [])))) END AS topics,
  coalesce(modalities, 1.0) AS modalities FROM x FULL JOIN y USING (section) LEFT JOIN m USING (section)),
g AS (SELECT *, n_base = n_rerun AS equal, abs(n_base - n_rerun) <= greatest(1, round_even(greatest(n_base, n_rerun) * 0.25, 0)) AS close FROM a)"""


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")

    def side(where: str, bar: int) -> DataFrame:
        return rows.where(where).select(F.col("user_id").alias("section"), F.col("event_type").alias("topic"), F.when(F.col("value") < bar, "must").otherwise("may").alias("modality"))

    base, rerun = side("event_id % 2 = 0", 25), side("event_id % 3 <> 0 and event_type <> 'error'", 30)
    return audit.agreement(base, rerun, rows.select(F.col("user_id").alias("section")), "section", "topic", "modality")


@query(_AGREE + " SELECT section, n_base, n_rerun, round(topics, 9) AS topics, round(modalities, 9) AS modalities, equal, close FROM g")
def extraction_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _agreement(spark, d).withColumns({"topics": F.round("topics", 9), "modalities": F.round("modalities", 9)})


@query(
    _AGREE + " SELECT count(*) AS sections, round(avg(topics), 6) AS mean_topics, round(quantile_cont(topics, 0.5), 6) AS median_topics, round(avg(modalities), 6) AS mean_modalities, round(avg(equal::INTEGER), 6) AS share_equal, round(avg(close::INTEGER), 6) AS share_close FROM g"
)
def extraction_agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    out = audit.agreement_summary(_agreement(spark, d))
    return out.select("sections", *[F.round(c, 6).alias(c) for c in out.columns if c != "sections"])


@query(_AGREE + " SELECT section, round(topics, 9) AS topics FROM g ORDER BY round(topics, 9), round(modalities, 9), section LIMIT 15")
def extraction_worst(spark: SparkSession, d: str) -> DataFrame:
    """A report of the 15 sections that agree least."""
    return audit.worst(extraction_agreement(spark, d), "section", 15).select("section", "topics")


_INCOMING = "SELECT event_id, user_id, event_type AS reviewer, CASE WHEN event_type = 'view' THEN 'maybe' WHEN value > 40 THEN 'disputed' ELSE 'vetted' END AS verdict, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN 'why' END AS note, CASE WHEN user_id % 10 <> 0 THEN user_id END AS version_id FROM events"
_PROBLEM = "CASE WHEN verdict NOT IN ('vetted', 'disputed') THEN 'the verdict is unknown' WHEN verdict = 'disputed' AND trim(coalesce(note, '')) = '' THEN 'a dispute needs a note' WHEN version_id IS NULL THEN 'there is no fetched version' END"


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events")
    verdict = F.when(F.col("event_type") == "view", "maybe").when(F.col("value") > 40, "disputed").otherwise("vetted")
    note = F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, "why")
    incoming = rows.select("user_id", F.col("event_type").alias("reviewer"), verdict.alias("verdict"), note.alias("note"), F.col("event_id").alias("created_at"))
    now = rows.where("user_id % 10 <> 0").select("user_id", F.col("user_id").alias("version_id")).distinct()
    none = spark.createDataFrame([], "version_id long, reviewer string, verdict string, note string, created_at long")
    return trust.record(none, incoming, now, "user_id")


@query(f"SELECT version_id, reviewer, verdict, note, event_id AS created_at FROM ({_INCOMING}) WHERE {_PROBLEM} IS NULL")
def reviews_recorded(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d)[0]


@query(f"SELECT event_id, {_PROBLEM} AS problem FROM ({_INCOMING}) WHERE {_PROBLEM} IS NOT NULL")
def reviews_refused(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d)[1].select(F.col("created_at").alias("event_id"), "problem")


@query(
    """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Act ' || p_size WHEN p_partkey % 6 = 1 THEN NULL ELSE 'type-' || (p_partkey // 3) END AS id, p_partkey % 4 <> 0 AS binding, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'a guide' END AS note FROM part)
SELECT 'doc_type.id' AS rule, id AS entity FROM p WHERE NOT coalesce(regexp_matches(id, '^[a-z0-9]+(?:[_-][a-z0-9]+)*$'), false)
UNION ALL SELECT 'doc_type.note', id FROM p WHERE trim(note) = '' UNION ALL SELECT 'doc_type.binding', id FROM p WHERE NOT binding AND note IS NULL
UNION ALL SELECT 'doc_type.unique', id FROM p GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'topic.id', id FROM p WHERE NOT coalesce(regexp_matches(id, '^[a-z0-9]+(?:[_-][a-z0-9]+)*$'), false) UNION ALL SELECT 'topic.label', id FROM p WHERE trim(coalesce(note, '')) = '' UNION ALL SELECT 'topic.unique', id FROM p GROUP BY id HAVING count(*) > 1"""
)
def domain_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules on document types and on topics."""
    k = lambda n: F.col("p_partkey") % n
    name = F.when(k(6) == 0, F.concat(F.lit("Act "), F.col("p_size").cast("string"))).when(k(6) != 1, F.concat(F.lit("type-"), F.expr("cast(p_partkey div 3 as string)")))
    rows = table(spark, d, "part").select(name.alias("id"), (k(4) != 0).alias("binding"), F.when(k(5) == 0, " ").when(k(5) == 1, "a guide").alias("note"))
    found = validate.doc_types(rows).unionByName(validate.terms(rows.withColumnRenamed("note", "label"), "topic"))
    return found.select("rule", "entity")


@query(
    """
WITH s AS (SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['name', 'colour'] WHEN 2 THEN ['name', 'tags', 'topics'] ELSE ['tags'] END AS names, CASE o_orderkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a', 'a'] WHEN 2 THEN ['B c'] ELSE ['a_b', 'a-b'] END AS tags,
  o_orderkey % 3 <> 0 AS has_scopes, CASE WHEN o_orderkey % 7 = 0 THEN ['open', 'unknown'] ELSE ['open'] END AS statuses FROM orders)
SELECT 'domain.fields' AS rule, id AS entity FROM s WHERE list_contains(names, 'colour') UNION ALL SELECT 'domain.required', id FROM s WHERE NOT list_contains(names, 'name')
UNION ALL SELECT 'tags.some', id FROM s WHERE len(tags) = 0 UNION ALL SELECT 'tags.slug', id FROM s WHERE list_contains(tags, 'B c') UNION ALL SELECT 'tags.once', id FROM s WHERE len(list_distinct(tags)) < len(tags)
UNION ALL SELECT 'domain.availability_scopes', id FROM s WHERE NOT has_scopes UNION ALL SELECT 'domain.availability_tags', id FROM s WHERE len(list_filter(tags, lambda x: x NOT IN ('a', 'a-b'))) > 0 UNION ALL SELECT 'domain.availability_unknown', id FROM s WHERE list_contains(statuses, 'unknown')"""
)
def domain_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rules on a domain's fields, slug lists and availability."""
    k = lambda n: F.col("o_orderkey") % n
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(k(4) == 1, words("name", "colour")).when(k(4) == 2, words("name", "tags", "topics")).when(k(4) == 3, words("tags")).alias("names"),
        F.when(k(5) == 0, words()).when(k(5) == 1, words("a", "a")).when(k(5) == 2, words("B c")).otherwise(words("a_b", "a-b")).alias("tags"),
        (k(3) != 0).alias("has_scopes"), F.when(k(7) == 0, words("open", "unknown")).otherwise(words("open")).alias("statuses"), words("a", "a-b").alias("domain_tags"),
    )
    found = validate.fields(rows, "id", "names", ["name", "tags", "topics", "doc_types"], ["name"], "domain")
    return found.unionByName(validate.slugs(rows, "id", "tags", "tags")).unionByName(validate.domain_availability(rows)).select("rule", "entity")


@query(
    """
WITH s AS (SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'read the annex' END AS extract_note, CASE doc_id % 5 WHEN 0 THEN ['a b'] WHEN 1 THEN [''] ELSE ['menu'] END AS skip_classes, CASE doc_id % 3 WHEN 0 THEN '(?P<ref>\\d+)' WHEN 1 THEN '\\d+' END AS section_pattern,
  CASE doc_id % 7 WHEN 0 THEN 'Art. \\1' WHEN 1 THEN '' END AS section_label, CASE WHEN doc_id % 2 = 0 THEN 'Article 1' END AS body_start, doc_id % 11 = 0 AS drop_preamble FROM documents)
SELECT 'source.extract_note' AS rule, id AS entity FROM s WHERE trim(extract_note) = '' UNION ALL SELECT 'source.skip_classes', id FROM s WHERE skip_classes[1] IN ('a b', '')
UNION ALL SELECT 'source.pattern_ref', id FROM s WHERE NOT contains(section_pattern, '(?P<ref>') UNION ALL SELECT 'source.label_pattern', id FROM s WHERE section_label IS NOT NULL AND section_pattern IS NULL
UNION ALL SELECT 'source.label', id FROM s WHERE section_label = '' UNION ALL SELECT 'source.drop_preamble', id FROM s WHERE drop_preamble AND body_start IS NULL"""
)
def source_option_violations(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: F.col("doc_id") % n
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(k(4) == 0, " ").when(k(4) == 1, "read the annex").alias("extract_note"),
        F.when(k(5) == 0, words("a b")).when(k(5) == 1, words("")).otherwise(words("menu")).alias("skip_classes"), F.when(k(3) == 0, r"(?P<ref>\d+)").when(k(3) == 1, r"\d+").alias("section_pattern"),
        F.when(k(7) == 0, r"Art. \1").when(k(7) == 1, "").alias("section_label"), F.when(k(2) == 0, "Article 1").alias("body_start"), (k(11) == 0).alias("drop_preamble"),
    )
    return validate.source_options(rows).select("rule", "entity")


@query(
    """
WITH s AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 9 <> 0 THEN 'N' || (c_nationkey + CASE WHEN c_custkey % 20 = 0 THEN 100 ELSE 0 END) END AS scope, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS language, CASE WHEN c_custkey % 4 = 0 THEN 'x' END AS translation_of FROM customer),
c AS (SELECT 'N' || n_nationkey AS scope, CASE WHEN n_nationkey % 2 = 0 THEN ['en', 'fr'] ELSE ['de'] END AS languages FROM nation),
v AS (SELECT 'N' || s_nationkey AS scope, s_suppkey::VARCHAR AS tag, CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE s_suppkey::VARCHAR END AS source_id FROM supplier)
SELECT 'cross.scope' AS rule, s.id AS entity FROM s LEFT JOIN c USING (scope) WHERE scope IS NOT NULL AND languages IS NULL
UNION ALL SELECT 'cross.language', s.id FROM s JOIN c USING (scope) WHERE translation_of IS NULL AND NOT list_contains(languages, language)
UNION ALL SELECT 'cross.backing', v.scope || '/' || tag FROM v LEFT JOIN s ON s.id = source_id WHERE s.id IS NULL
UNION ALL SELECT 'cross.backing_scope', v.scope || '/' || tag FROM v JOIN s ON s.id = source_id WHERE s.scope IS DISTINCT FROM v.scope"""
)
def cross_registry(spark: SparkSession, d: str) -> DataFrame:
    """Rules between the registries of sources, scopes and availability."""
    k = lambda n: F.col("c_custkey") % n
    number = F.col("c_nationkey") + F.when(k(20) == 0, 100).otherwise(0)
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.when(k(9) != 0, F.concat(F.lit("N"), number.cast("string"))).alias("scope"),
        F.when(k(3) == 0, "en").when(k(3) == 1, "fr").otherwise("de").alias("language"), F.when(k(4) == 0, "x").alias("translation_of"),
    )
    languages = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de")))
    scopes = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), languages.alias("languages"))
    backed = table(spark, d, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("scope"), F.col("s_suppkey").cast("string").alias("tag"), F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise(F.col("s_suppkey").cast("string")).alias("source_id")
    )
    return validate.cross(rows, scopes, backed).select("rule", "entity")


@query(
    r"""
WITH p AS (SELECT page_id::VARCHAR AS id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, CASE page_id % 3 WHEN 0 THEN 'Gazette' WHEN 1 THEN 'Board' ELSE 'Stranger' END AS publisher, page_id FROM pages)
SELECT 'publisher.known' AS rule, id AS entity FROM p WHERE publisher = 'Stranger'
UNION ALL SELECT 'publisher.host', id FROM p WHERE publisher = 'Gazette' AND NOT (h = 'example.org' OR ends_with(h, '.example.org')) OR publisher = 'Board' AND NOT (h = 'example.net' OR ends_with(h, '.example.net') OR h = 'example.com' OR ends_with(h, '.example.com'))
UNION ALL SELECT 'golden.question', id FROM p WHERE page_id % 10 = 0 UNION ALL SELECT 'golden.expect', id FROM p WHERE page_id % 7 = 0"""
)
def publishing_violations(spark: SparkSession, d: str) -> DataFrame:
    """Declared publishers and their hosts, and golden questions that say nothing."""
    k = lambda n: F.col("page_id") % n
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url", "page_id", F.when(k(3) == 0, "Gazette").when(k(3) == 1, "Board").otherwise("Stranger").alias("publisher"))
    registry = spark.createDataFrame([("Gazette", ["example.org"]), ("Board", ["example.net", "example.com"])], "publisher string, domains array<string>")
    asked = rows.select("id", F.when(k(10) == 0, " ").otherwise("what?").alias("question"), (k(7) % 7).cast("int").alias("n_expected"))
    return validate.publishing(rows, registry).unionByName(validate.golden(asked)).select("rule", "entity")


@query("SELECT t AS name, n FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents)")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """The row counts of a manifest: one aggregation a table."""
    counts = [table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("orders", "events", "documents")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    """
WITH cur AS (SELECT o_custkey, max(o_orderdate) AS checked FROM orders GROUP BY 1), l AS (SELECT c_custkey, c_mktsegment AS doc_type, CASE WHEN c_custkey % 6 = 0 THEN c_custkey - 1 END AS translation_of, c_acctbal FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'disputed' WHEN c_custkey % 5 = 0 THEN 'unverified' WHEN c_custkey % 2 = 0 AND doc_type <> 'BUILDING' THEN 'official' ELSE 'secondary' END AS level,
  CASE WHEN c_acctbal < 0 THEN 'a reviewer disputes it' WHEN c_custkey % 5 = 0 THEN 'the publisher is unknown or the host isn''t its own' WHEN c_custkey % 2 = 0 AND doc_type <> 'BUILDING' THEN 'an official publisher''s binding document' ELSE 'a known publisher' END AS reason,
  translation_of IS NULL AND doc_type <> 'BUILDING' AS binding, nullif(concat_ws('; ', CASE WHEN doc_type = 'BUILDING' THEN 'guidance only' END, CASE WHEN translation_of IS NOT NULL THEN 'a translation; its original binds' END), '') AS note, checked IS NOT NULL AS fetched
FROM l LEFT JOIN cur ON o_custkey = c_custkey"""
)
def sources_with_trust(spark: SparkSession, d: str) -> DataFrame:
    """The listing of sources with level, reason, binding and notes; those never fetched are in it."""
    of = table(spark, d, "customer").withColumn("translation_of", F.when(F.col("c_custkey") % 6 == 0, F.col("c_custkey") - 1)).withColumnRenamed("c_mktsegment", "doc_type")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    now = versions.current(orders, "c_custkey", "o_orderdate", "o_orderdate", "o_orderkey").select("c_custkey", F.lit(True).alias("has"))
    listing = topics.sources(of.select("c_custkey", "doc_type", "translation_of"), now, [], "c_custkey")
    known, official, binds = F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2 == 0, F.col("doc_type") != "BUILDING"
    no, disputed = F.lit(False), F.col("c_acctbal") < 0
    levels = of.select("c_custkey", trust.level(known, official, binds, no, disputed).alias("level"), trust.reason(known, official, binds, no, disputed).alias("reason"))
    notes = spark.createDataFrame([("BUILDING", "guidance only")], "doc_type string, note string")
    out = topics.sources_full(listing, levels, notes, "c_custkey", "doc_type", "translation_of", ["BUILDING"])
    return out.select("c_custkey", "level", "reason", "binding", "note", F.col("has").isNotNull().alias("fetched"))


@query(
    """
WITH v AS (SELECT l_suppkey AS s_suppkey, count(*) AS versions, datediff('day', max(l_shipdate)::DATE, DATE '1999-01-01') AS age_days FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
c AS (SELECT l_suppkey AS s_suppkey, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_linenumber <= 2),
t AS (SELECT l_suppkey AS s_suppkey, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag AS prompt_version, l_linestatus = 'O' AS stale FROM lineitem WHERE l_quantity > 20),
b AS (SELECT s_suppkey, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM t WHERE NOT stale)) AS without_statements FROM c GROUP BY 1),
s AS (SELECT s_suppkey, count(*) FILTER (NOT stale) AS statements, count(*) FILTER (NOT stale AND prompt_version IS DISTINCT FROM 'A') AS old_prompt, count(*) FILTER (stale) AS stale FROM t GROUP BY 1)
SELECT s_suppkey, coalesce(versions, 0) AS versions, age_days, coalesce(without_statements, 0) AS without_statements, coalesce(statements, 0) AS statements, coalesce(old_prompt, 0) AS old_prompt, coalesce(stale, 0) AS stale FROM supplier LEFT JOIN v USING (s_suppkey) LEFT JOIN b USING (s_suppkey) LEFT JOIN s USING (s_suppkey)"""
)
def source_signals(spark: SparkSession, d: str) -> DataFrame:
    """The audit's signals on versions and statements; structure_audit has those on texts."""
    rows = table(spark, d, "lineitem").withColumn("chunk_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumnRenamed("l_suppkey", "s_suppkey")
    seen = rows.where("l_linenumber = 1").select("s_suppkey", F.col("l_shipdate").alias("checked"))
    said = rows.where("l_quantity > 20").select("s_suppkey", "chunk_id", F.col("l_returnflag").alias("prompt_version"), (F.col("l_linestatus") == "O").alias("stale"))
    chunks = rows.where("l_linenumber <= 2").select("s_suppkey", "chunk_id")
    out = audit.source_signals(table(spark, d, "supplier").select("s_suppkey"), seen, chunks, said, "s_suppkey", "A", "1999-01-01")
    return out.withColumn("age_days", F.col("age_days").cast("long"))
