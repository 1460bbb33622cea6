"""Listings: statements on a topic, availability by scope, sources, and whole sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def clamp(limit: int, most: int) -> int:
    return max(1, min(most, limit))


def rank_of(value: Column | str, order: list[str]) -> Column:
    """Place in a fixed order, from 0; what is unknown comes last as 99."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.array_position(F.array(*[F.lit(o) for o in order]), v)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(99)).cast("int")


def topic_listing(
    statements: DataFrame, by: list[str], quote: str, label: str, order: list[Column], scan: list[str], limit: int
) -> DataFrame:
    """Statements of each group `by`, equal quotes once.

    The first in the order of `scan` stands for its quote and names the others in also_in; the list is then
    put in `order`. Each row carries the group's number of statements that are left.
    """
    rows = statements.withColumn("quote_key", T.dedupe_key(quote))
    columns, group = statements.columns, [*by, "quote_key"]
    # of each quote the first row and the number of rows combine before the shuffle
    kept = rows.groupBy(*group).agg(F.min_by(F.struct(*columns), F.struct(*scan)).alias("kept"), F.count("*").alias("copies"))
    totals = kept.groupBy(*by).agg(F.count("*").alias("total"))
    kept = kept.select("quote_key", "copies", "kept.*")
    place = Window.partitionBy(*by).orderBy(*order)
    top = kept.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
    # labels are listed for the rows of the result only
    wanted = top.where("copies > 1").select(*group)
    listed = rows.join(wanted, group, "left_semi").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*scan, F.col(label).alias("copy_label")))).alias("all"))
    later = listed.select(*group, F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["copy_label"]).alias("also_in"))
    out = top.join(later, group, "left").join(totals, by)
    also = F.coalesce("also_in", F.array().cast("array<string>"))
    return out.select(*columns, also.alias("also_in"), "total", "place")


def availability(rows: DataFrame, as_of: str, tags: list[str] | None = None) -> DataFrame:
    """scope, tag, status and in_force (false or null: absent means in force)."""
    if tags:
        rows = rows.where(F.col("tag").isin(tags))
    return rows.withColumn("in_force", F.when(~T.in_force("effective_from", as_of), F.lit(False)))


def untranslated(documents: DataFrame, key: str = "id", original: str = "translation_of") -> DataFrame:
    """Documents of which no translation is registered."""
    done = documents.where(F.col(original).isNotNull()).select(F.col(original).alias(key))
    return documents.join(done, key, "left_anti")


def sources(documents: DataFrame, versions: DataFrame, counts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """All documents, also those never fetched, with their current version and the counts (0 where there are none)."""
    out = documents.join(versions, key, "left")
    for name, rows in counts:
        per = rows.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(per, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def section(chunks: DataFrame, group: list[str], ref: str, order: str, text: str) -> DataFrame:
    """Sections with their parts joined in order; " (part n)" is not part of a section's reference."""
    base = F.regexp_replace(ref, r" \(part [0-9]+\)$", "")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.withColumn("base_ref", base).groupBy(*group, "base_ref").agg(
        F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("section_text"), F.count("*").alias("n_parts"), F.min(order).alias("first_ord")
    )


def similar_refs(chunks: DataFrame, ref: str, wanted: str, order: str, limit: int = 15) -> DataFrame:
    """References to suggest for one that doesn't exist: those with its first number, else all, in order."""
    import re

    number = re.search(r"\d+", wanted)
    rows = chunks.where(F.contains(ref, F.lit(number[0]))) if number else chunks
    return rows.orderBy(order).limit(limit)


def standing(doc_type: str, translation_of: str, non_binding: list[str]) -> Column:
    """Whether a document binds; null where the registry makes no such difference."""
    translated = F.col(translation_of).isNotNull()
    known = translated | F.lit(bool(non_binding))
    return F.when(known, ~translated & ~F.col(doc_type).isin(non_binding))


def statement_rows(statements: DataFrame, topic_rows: DataFrame, originals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Statements with their topics (joined by commas, in order) and, for translations, the original's label; `n` numbers
    them in each section by `order`.

    topic_rows: key, topic. originals: original_id, label. What isn't set is null, so that JSON leaves it out.
    """
    listed = topic_rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))
    rows = statements.join(listed, key, "left").join(originals.withColumnRenamed("label", "original"), "original_id", "left")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).drop("original_id")


def sources_full(listing: DataFrame, trust: DataFrame, notes: DataFrame, key: str, doc_type: str, translation_of: str, non_binding: list[str]) -> DataFrame:
    """A listing with level and reason (trust: key, level, reason), whether each document binds, and the notes on its type
    (notes: doc_type, note), joined with what is said of translations.
    """
    rows = listing.join(trust, key, "left").join(notes, doc_type, "left")
    said = F.concat_ws("; ", "note", F.when(F.col(translation_of).isNotNull(), "a translation; its original binds"))
    return rows.withColumns({"binding": standing(doc_type, translation_of, non_binding), "note": F.nullif(said, F.lit(""))})
