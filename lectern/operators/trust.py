"""How far a source can be trusted, what reviewers say, and the quality of its statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Lowest first.
LEVELS = ["disputed", "unverified", "secondary", "official"]


def latest_verdicts(reviews: DataFrame, version: str, reviewer: str, verdict: str, order: list[str]) -> DataFrame:
    """The last verdict of each reviewer on each version; arrival order decides within a second."""
    return reviews.groupBy(version, reviewer).agg(F.max_by(verdict, F.struct(*order)).alias("verdict"))


def level(provenance: Column, official: Column, binding: Column, vetted: Column, disputed: Column) -> Column:
    """provenance: the publisher is known and the host is on its domains. Any number of vetted verdicts is one step up."""
    base = F.when(~provenance, 1).when(official & binding, 3).otherwise(2)
    index = F.when(disputed, 0).otherwise(F.least(base + vetted.cast("int"), F.lit(3)))
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), index + 1)


def provenance(documents: DataFrame, publishers: DataFrame, url: str = "url", publisher: str = "publisher") -> DataFrame:
    """documents with `official` and `on_domain`; publishers (publisher, domains, official) are a registry, joined by name."""
    out = documents.join(publishers, publisher, "left")
    on = F.coalesce(T.on_domains(T.host(url), F.col("domains")), F.lit(False))
    return out.withColumns({"on_domain": on, "official": F.coalesce("official", F.lit(False))})


def quality(documents: DataFrame, chunks: DataFrame, statements: DataFrame, key: str, verified: Column, evidence: Column) -> DataFrame:
    """Per document: sections, covered sections, statements, verified ones and evidence; zeros for a document without any."""
    per_chunk = chunks.groupBy(key).agg(F.count("*").alias("sections"))
    marked = statements.withColumn("ok", verified.cast("int"))
    per_statement = marked.groupBy(key).agg(F.count_distinct("chunk_id").alias("covered"), F.count("*").alias("statements"), F.sum("ok").alias("verified"))
    out = documents.join(per_chunk, key, "left").join(per_statement, key, "left")
    names = ["sections", "covered", "statements", "verified"]
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    return out.withColumn("evidence", F.when(evidence, F.col("verified")).otherwise(0).cast("long"))


def reason(provenance: Column, official: Column, binding: Column, vetted: Column, disputed: Column) -> Column:
    """One line that says why a document has its level."""
    base = F.when(~provenance, "the publisher is unknown or the host isn't its own").when(official & binding, "an official publisher's binding document").otherwise("a known publisher")
    return F.when(disputed, "a reviewer disputes it").when(vetted, F.concat(base, F.lit("; vetted"))).otherwise(base)


def review_problem(verdict: Column, note: Column, version: Column) -> Column:
    """Why a review can't be recorded, or null: the verdict is none, a dispute has no note, nothing was fetched."""
    return (
        F.when(~F.coalesce(verdict.isin("vetted", "disputed"), F.lit(False)), "the verdict is unknown")
        .when((verdict == "disputed") & (F.trim(F.coalesce(note, F.lit(""))) == ""), "a dispute needs a note")
        .when(version.isNull(), "there is no fetched version")
    )


def record(reviews: DataFrame, incoming: DataFrame, current: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Reviews with the incoming ones (document, reviewer, verdict, note, created_at) on each document's current version
    (document, version_id), and the incoming ones that are refused, with `problem`.
    """
    met = incoming.join(current.select(document, "version_id"), document, "left")
    met = met.withColumn("problem", review_problem(F.col("verdict"), F.col("note"), F.col("version_id")))
    taken = met.where("problem is null").select("version_id", "reviewer", "verdict", "note", "created_at")
    return reviews.unionByName(taken), met.where("problem is not null")
