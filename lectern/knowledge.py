"""The read API over a folder of tables: search, get, topic and sources, each on DataFrames.

Tables (Parquet): documents (id, publisher, title, url, language, doc_type, tags, scope, translation_of),
versions (id, document_id, sha256, fetched_at, last_checked_at), chunks (id, version_id, ord, section_ref,
heading_path, text, sha256), statements (id, chunk_id, verbatim_quote, summary, modality, applies_to,
effective_from, topic; a row for each topic of a statement), and where there are any scopes (id, name, aliases).
Time is a parameter, and every listing is in a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import index, search, topics, trust, versions
from lectern.session import materialize


STATEMENTS = "array<struct<id:string,quote:string,summary:string,modality:string,topics:array<string>,applies_to:array<string>,effective_from:string>>"


class KnowledgeBase:
    """embed(rows, key, text) gives key and v: the place of an embedding model; the default hashes words."""

    def __init__(self, spark: SparkSession, path: str, doc_types: list[str] | None = None, modalities: list[str] | None = None, embed: Callable[[DataFrame, str, str], DataFrame] = search.hash_vectors):
        self.spark, self.path = spark, path
        self.doc_types, self.modalities, self.embed = doc_types or [], modalities or [], embed

    def _index(self, name: str, rows: DataFrame, key: str, text: str, heading: str, embedded: str, tells: tuple[str, ...]) -> index.Index:
        """Built once and read by every search until the indexed rows change."""
        embed = lambda r, k, _: self.embed(r, k, embedded)
        return index.of(self.spark, f"{self.path}#{name}", rows, key, text, heading, tells, embed, self.embed)

    def scopes(self) -> list:
        """id, name and aliases of the registered scopes, a registry of checked size; none where the table is missing."""
        try:
            rows = self.table("scopes").select("id", "name", "aliases")
        except AnalysisException:
            return []
        return sorted(search._batch(rows, "scopes"), key=lambda r: r.id)

    def scopes_inferred(self, queries: DataFrame) -> DataFrame:
        """query_id, only: the scopes whose name or alias a query names as whole words, by id."""
        names = [(r.id, n) for r in self.scopes() for n in (r.name, *(r.aliases or []))]
        rows = search.infer_scopes(queries, self.spark.createDataFrame(names, "scope string, name string"))
        return rows.groupBy("query_id").agg(F.sort_array(F.collect_set("scope")).alias("only"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def sections(self) -> DataFrame:
        """Chunks of current versions with their document."""
        now = versions.current(self.table("versions")).select(F.col("id").alias("version_id"), "document_id")
        docs = self.table("documents").select(F.col("id").alias("document_id"), "title", "url", "language", "doc_type", "tags", "scope")
        return self.table("chunks").withColumnRenamed("id", "chunk_id").join(now, "version_id").join(docs, "document_id")

    def search(self, queries: DataFrame, scopes: list | None = None, tags: list | None = None, topic: list | None = None, limit: int = 10) -> DataFrame:
        """queries: query_id, query. The best sections of each, equal texts once, with an excerpt.

        Without scopes those hold that a query names. Unknown scopes and topics are errors that list the known ones.
        """
        names = self.scopes()
        if names:
            scopes = search.resolve(scopes, [r.id for r in names], "scope")
        if topic:
            search.resolve(topic, [r.topic for r in search._batch(self.table("statements").select("topic").distinct(), "topics")], "topic")
        parts = self.sections()
        indexed = F.concat_ws("\n", "title", F.concat_ws(" > ", "section_ref", F.array_join("heading_path", " > ")), "text")
        parts = parts.withColumns({"heading": F.concat_ws(" ", "section_ref", F.array_join("heading_path", " ")), "indexed": indexed})
        stated = self.table("statements").withColumnRenamed("id", "statement_id").join(parts.select("chunk_id"), "chunk_id", "left_semi")
        # a statement has a row for each of its topics
        stated = stated.groupBy("statement_id", "chunk_id").agg(F.first("summary").alias("summary"), F.first("verbatim_quote").alias("verbatim_quote"))
        of_sections = self._index("sections", parts, "chunk_id", "text", "heading", "indexed", ("sha256", "title"))
        of_statements = self._index("statements", stated, "statement_id", "verbatim_quote", "summary", "summary", ("chunk_id", "summary", "verbatim_quote"))
        asked = queries.select("query_id", "query")
        if names and not scopes:
            asked = materialize(asked.join(self.scopes_inferred(asked), "query_id", "left"), "asked")
        else:
            asked = asked.withColumn("only", F.lit(None).cast("array<string>"))
        allowed = search.allowed(parts, self.table("statements"), scopes, tags, topic)
        words = sorted({w for r in names for n in (r.name, *(r.aliases or [])) for w in n.lower().split()})
        dropped = F.array(*[F.lit(w) for w in words]) if words else None
        fused = search.four_lists(asked, allowed, stated.select("statement_id", "chunk_id"), of_sections, of_statements, self.embed, dropped)
        rows = fused.join(parts.select("chunk_id", "document_id", "section_ref", "title", "url", "text", "sha256"), "chunk_id")
        rows = rows.withColumn("label", F.concat_ws(" ", "document_id", "section_ref")).withColumn("excerpt", T.excerpt("text")).drop("text")
        out = search.collapse(rows, "sha256", "label", [F.desc("score"), F.col("chunk_id")], topics.clamp(limit, 50))
        return out.join(self.statements(out.select("chunk_id"), tags), "chunk_id", "left").withColumn("statements", F.coalesce("statements", F.array().cast(STATEMENTS)))

    def statements(self, chunks: DataFrame, tags: list | None = None) -> DataFrame:
        """chunk_id, statements of the given chunks: their statements by id, of those that apply to one of the tags where any are given."""
        rows = self.table("statements").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
        if tags:
            rows = rows.where(F.arrays_overlap("applies_to", F.array(*[F.lit(t) for t in tags])))
        # a statement has a row for each of its topics
        first = [F.first(c).alias(c) for c in ("verbatim_quote", "summary", "modality", "applies_to", "effective_from")]
        rows = rows.groupBy("chunk_id", "id").agg(*first, F.sort_array(F.collect_set("topic")).alias("topics"))
        one = F.struct("id", F.col("verbatim_quote").alias("quote"), "summary", "modality", "topics", "applies_to", "effective_from")
        return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list(one)).alias("statements"))

    def answers(self, queries: DataFrame, **filters) -> DataFrame:
        """One row a query: results in order, the scopes that were inferred (null where none were), and a note where nothing matches."""
        found = self.search(queries, **filters)
        columns = [c for c in found.columns if c != "query_id"]
        rows = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("result_no", *[c for c in columns if c != "result_no"]))).alias("results"))
        out = queries.select("query_id").join(rows, "query_id", "left")
        if self.scopes() and not filters.get("scopes"):
            out = out.join(self.scopes_inferred(queries).withColumnRenamed("only", "scopes_inferred"), "query_id", "left")
        else:
            out = out.withColumn("scopes_inferred", F.lit(None).cast("array<string>"))
        return out.withColumn("note", F.when(F.col("results").isNull(), "nothing matches; what isn't found here should not be made up"))

    def get(self, document_id: str, section_ref: str) -> DataFrame:
        """One section, its parts joined; no row (and similar() to ask) if there is none."""
        mine = self.sections().where((F.col("document_id") == document_id) & ((F.col("section_ref") == section_ref) | F.startswith("section_ref", F.lit(section_ref + " (part "))))
        return topics.section(mine, ["document_id", "title", "url"], "section_ref", "ord", "text")

    def section(self, document_id: str, section_ref: str) -> DataFrame:
        """One row: the section with its statements, or an error with the references that are like the one asked for."""
        mine = self.sections().where(F.col("document_id") == document_id)
        base = F.regexp_replace("section_ref", r" \(part [0-9]+\)$", "")
        chunks = mine.where((F.col("section_ref") == section_ref) | (base == section_ref)).select("chunk_id", "ord")
        said = self.statements(chunks).join(chunks, "chunk_id").select(F.explode("statements").alias("s"), "ord")
        said = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]).alias("statements"))
        like = self.similar(document_id, section_ref).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_ref"))), lambda x: x["section_ref"]).alias("similar"))
        asked = self.spark.createDataFrame([(document_id, section_ref)], "document_id string, section_ref string")
        got = self.get(document_id, section_ref).drop("document_id", "first_ord")
        out = asked.join(got, F.col("base_ref") == F.col("section_ref"), "left").drop("base_ref").join(said, F.lit(True)).join(like, F.lit(True))  # one row each
        missing = F.col("section_text").isNull()
        error = F.when(missing, F.when(F.size("similar") > 0, "there is no such section; see similar").otherwise("there is no such document"))
        return out.withColumns({"error": error, "similar": F.when(missing, F.col("similar")), "statements": F.when(~missing, F.col("statements"))})

    def similar(self, document_id: str, section_ref: str) -> DataFrame:
        mine = self.sections().where(F.col("document_id") == document_id).select("section_ref", "ord")
        return topics.similar_refs(mine, "section_ref", section_ref, "ord")

    def topic(self, topic: str, tags: list | None = None, limit: int = 40) -> DataFrame:
        """Statements on a topic from documents without a translation, by modality, type, document and place."""
        documents = topics.untranslated(self.table("documents")).select(F.col("id").alias("document_id"))
        rows = self.table("statements").where(F.col("topic") == topic)
        if tags:
            rows = rows.where(F.arrays_overlap("applies_to", F.array(*[F.lit(t) for t in tags])))
        rows = rows.join(self.sections().drop("text"), "chunk_id").join(documents, "document_id", "left_semi")
        rows = rows.withColumn("label", F.concat_ws(" ", "document_id", "section_ref"))
        order = [topics.rank_of("modality", self.modalities), topics.rank_of("doc_type", self.doc_types), F.col("document_id"), F.col("ord"), F.col("id")]
        return topics.topic_listing(rows, ["topic"], "verbatim_quote", "label", order, ["document_id", "ord", "id"], topics.clamp(limit, 200))

    def sources(self, scope: str | None = None) -> DataFrame:
        docs = self.table("documents").withColumnRenamed("id", "document_id")
        docs = docs.where(F.col("scope") == scope) if scope else docs
        now = versions.current(self.table("versions")).select("document_id", F.col("id").alias("version_id"), "last_checked_at")
        parts = self.sections().select("document_id", "chunk_id")
        stated = self.table("statements").join(parts, "chunk_id").select("document_id")
        return topics.sources(docs, now, [("n_sections", parts), ("n_statements", stated)], "document_id").orderBy("document_id")

    def _optional(self, name: str, schema: str) -> DataFrame:
        """A table that a knowledge base may lack; empty where it does."""
        try:
            rows = self.table(name)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])

    def sources_full(self, scope: str | None = None) -> DataFrame:
        """sources() with level and reason of trust, whether each document binds, and what is to be noted on it.

        From the tables publishers (publisher, domains, official), reviews (version_id, reviewer, verdict, created_at) and
        doc_types (doc_type, binding, note), where they are there: a publisher that isn't registered is unknown, a type
        that isn't is binding. Of each reviewer's verdicts on the current version the last one counts.
        """
        listing = self.sources(scope)
        publishers = self._optional("publishers", "publisher string, domains array<string>, official boolean")
        types = self._optional("doc_types", "doc_type string, binding boolean, note string")
        reviews = self._optional("reviews", "version_id string, reviewer string, verdict string, created_at string")
        said = trust.latest_verdicts(reviews, "version_id", "reviewer", "verdict", ["created_at"]).groupBy("version_id")
        said = said.agg(F.max(F.col("verdict") == "vetted").alias("vetted"), F.max(F.col("verdict") == "disputed").alias("disputed"))
        rows = trust.provenance(listing, publishers).join(types.select("doc_type", "binding"), "doc_type", "left").join(said, "version_id", "left")
        no = F.lit(False)
        binds = F.coalesce("binding", F.lit(True)) & F.col("translation_of").isNull()
        known = (F.col("on_domain"), F.col("official"), binds, F.coalesce("vetted", no), F.coalesce("disputed", no))
        levels = rows.select("document_id", trust.level(*known).alias("level"), trust.reason(*known).alias("reason"))
        unbound = [r.doc_type for r in search._batch(types.where("not binding").select("doc_type").distinct(), "document types")]
        return topics.sources_full(listing, levels, types.select("doc_type", "note"), "document_id", "doc_type", "translation_of", unbound).orderBy("document_id")
