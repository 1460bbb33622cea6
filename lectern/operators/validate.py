"""Registry rules as violations: every rule that an entry breaks is a row (rule, entity, message)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: The forms of names in a domain, of a source's id, of languages and of hosts; a line's end at the end counts.
SLUG = r"^[a-z0-9]+(?:[_-][a-z0-9]+)*\z"
SOURCE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
LANGUAGE = r"^[a-z]{2}\z"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
HOST = rf"^{_LABEL}(?:\.{_LABEL})+\z"


def row_rules(rows: DataFrame, entity: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Rules on one entry each: (rule, condition for a violation, message)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, c, m in rules]))
    return rows.select(F.col(entity).cast("string").alias("entity"), F.explode(found).alias("v")).select("v.rule", "entity", "v.message")


def duplicates(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    return rows.groupBy(key.cast("string").alias("entity")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "entity", F.lit("is listed more than once").alias("message"))


def missing(rows: DataFrame, entity: str, column: str, known: DataFrame, key: str, rule: str) -> DataFrame:
    """Entries whose column names something that isn't registered."""
    named = rows.where(F.col(column).isNotNull())
    bad = named.join(known.select(F.col(key).alias(column)), column, "left_anti")
    return bad.select(F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity"), F.concat(F.lit("unknown "), F.lit(column)).alias("message"))


def sources(rows: DataFrame, doc_types: list[str], tags: list[str], scoped: bool) -> DataFrame:
    """Rules on registered sources: id, publisher, title, url, language, doc_type, tags, scope, translation_of."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [(f"source.{c}", blank(c), f"{c} is missing") for c in ("publisher", "title", "url", "language", "doc_type")]
    rules += [
        ("source.id", ~F.col("id").rlike(SOURCE_ID), "the id is no slug"),
        ("source.language_code", ~blank("language") & ~F.col("language").rlike(LANGUAGE), "the language isn't two letters"),
        ("source.known_type", ~blank("doc_type") & ~F.col("doc_type").isin(doc_types), "the doc_type is unknown"),
        ("source.https", ~blank("url") & (~F.col("url").startswith("https://") | T.host("url").isNull()), "the url isn't an absolute https one"),
        ("source.tags", F.size("tags") < 1, "there are no tags"),
        ("source.known_tags", F.size(F.array_except("tags", F.array(*[F.lit(t) for t in tags]))) > 0, "tags are unknown"),
        ("source.tags_once", F.size(F.array_distinct("tags")) < F.size("tags"), "tags repeat"),
        ("source.scope", F.col("scope").isNull() if scoped else F.col("scope").isNotNull(), "a scope is given or missing against the domain"),
    ]
    return row_rules(rows, "id", rules).unionByName(duplicates(rows, F.col("id"), "source.unique")).unionByName(translations(rows))


def translations(rows: DataFrame) -> DataFrame:
    """A translation names another source that is no translation, in another language and of the same scope."""
    o = rows.select(F.col("id").alias("o_id"), F.col("language").alias("o_language"), F.col("scope").alias("o_scope"), F.col("translation_of").alias("o_of"))
    t = rows.where(F.col("translation_of").isNotNull()).join(o, F.col("translation_of") == F.col("o_id"), "left")
    rules = [
        ("translation.exists", F.col("o_id").isNull(), "the original is unknown"),
        ("translation.self", F.col("translation_of") == F.col("id"), "it translates itself"),
        ("translation.chain", F.col("o_of").isNotNull() & (F.col("o_id") != F.col("id")), "the original is a translation"),
        ("translation.language", (F.col("o_language") == F.col("language")) & (F.col("o_id") != F.col("id")), "both are in one language"),
        ("translation.scope", F.col("o_id").isNotNull() & ~F.col("o_scope").eqNullSafe(F.col("scope")), "the scopes differ"),
    ]
    return row_rules(t, "id", rules)


def scopes(rows: DataFrame) -> DataFrame:
    """Rules on scopes: id, name, languages."""
    rules = [
        ("scope.id", ~F.col("id").rlike(r"^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*$"), "the id is no name"),
        ("scope.name", F.trim(F.coalesce("name", F.lit(""))) == "", "the name is missing"),
        ("scope.languages", (F.size("languages") < 1) | F.exists("languages", lambda x: ~x.rlike(LANGUAGE)), "languages are missing or wrong"),
    ]
    return row_rules(rows, "id", rules).unionByName(duplicates(rows, F.lower("id"), "scope.unique"))


def availability(rows: DataFrame, scope_rows: DataFrame, tags: list[str], statuses: list[str]) -> DataFrame:
    """Each scope states each tag once, with a known status, a source unless unknown, and a partial date."""
    wanted = scope_rows.select(F.col("id").alias("scope"), F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"))
    name = F.concat_ws("/", "scope", "tag")
    gap = wanted.join(rows.select("scope", "tag"), ["scope", "tag"], "left_anti")
    gap = gap.select(F.lit("availability.all").alias("rule"), name.alias("entity"), F.lit("the tag isn't stated").alias("message"))
    rules = [
        ("availability.tag", ~F.col("tag").isin(tags), "the tag is unknown"),
        ("availability.status", ~F.col("status").isin([*statuses, "unknown"]), "the status is unknown"),
        ("availability.source", (F.col("status") != "unknown") & F.col("source_id").isNull(), "no source backs it"),
        ("availability.date", F.col("effective_from").isNotNull() & ~T.partial_date_valid("effective_from"), "the date is no partial date"),
    ]
    return row_rules(rows.withColumn("entity_name", name), "entity_name", rules).unionByName(gap)


def publishers(rows: DataFrame) -> DataFrame:
    rules = [
        ("publisher.name", F.trim(F.coalesce("publisher", F.lit(""))) == "", "the name is missing"),
        ("publisher.domains", (F.size("domains") < 1) | F.exists("domains", lambda x: ~x.rlike(HOST)), "domains are missing or no lower-case hosts"),
    ]
    return row_rules(rows, "publisher", rules).unionByName(duplicates(rows, F.trim("publisher"), "publisher.unique"))


_BLANK = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def fields(rows: DataFrame, entity: str, names: str, known: list[str], required: list[str], rule: str) -> DataFrame:
    """Rules on the names of an entry's fields (an array): none that is unknown, all that are required."""
    words = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return row_rules(rows, entity, [
        (f"{rule}.fields", F.size(F.array_except(names, words(known))) > 0, "fields are unknown"),
        (f"{rule}.required", F.size(F.array_except(words(required), names)) > 0, "fields are missing"),
    ])


def slugs(rows: DataFrame, entity: str, column: str, rule: str) -> DataFrame:
    """Rules on a list of slugs: some, each a slug, none twice."""
    return row_rules(rows, entity, [
        (f"{rule}.some", F.coalesce(F.size(column) < 1, F.lit(True)), "the list is empty"),
        (f"{rule}.slug", F.exists(column, lambda x: ~x.rlike(SLUG)), "an item is no slug"),
        (f"{rule}.once", F.size(F.array_distinct(column)) < F.size(column), "items repeat"),
    ])


def doc_types(rows: DataFrame) -> DataFrame:
    """Rules on document types: id, binding, note. What doesn't bind has to say why."""
    rules = [
        ("doc_type.id", ~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)), "the id is no slug"),
        ("doc_type.note", F.col("note").isNotNull() & _BLANK("note"), "the note is empty"),
        ("doc_type.binding", ~F.coalesce("binding", F.lit(True)) & F.col("note").isNull(), "a type that doesn't bind needs a note"),
    ]
    return row_rules(rows, "id", rules).unionByName(duplicates(rows, F.col("id"), "doc_type.unique"))


def terms(rows: DataFrame, rule: str) -> DataFrame:
    """Rules on modalities or topics: id, label."""
    rules = [(f"{rule}.id", ~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)), "the id is no slug"), (f"{rule}.label", _BLANK("label"), "the label is missing")]
    return row_rules(rows, "id", rules).unionByName(duplicates(rows, F.col("id"), f"{rule}.unique"))


def domain_availability(rows: DataFrame) -> DataFrame:
    """Rules on a domain's availability: id, has_scopes, tags, domain_tags, statuses."""
    return row_rules(rows, "id", [
        ("domain.availability_scopes", ~F.col("has_scopes") & F.col("tags").isNotNull(), "availability needs scopes"),
        ("domain.availability_tags", F.size(F.array_except("tags", "domain_tags")) > 0, "tags are unknown"),
        ("domain.availability_unknown", F.array_contains("statuses", "unknown"), "unknown is no status of its own"),
    ])


def unknown_status(rows: DataFrame) -> DataFrame:
    """Rules on what a domain calls an unknown availability: id, unknown, statuses."""
    return row_rules(rows, "id", [
        ("domain.availability_unknown_slug", ~F.coalesce(F.col("unknown").rlike(SLUG), F.lit(False)), "unknown is no slug"),
        ("domain.availability_unknown_own", F.array_contains("statuses", F.col("unknown")), "unknown is one of the values"),
    ])


def source_options(rows: DataFrame) -> DataFrame:
    """Rules on a source's options: id, extract_note, skip_classes, section_pattern, section_label, body_start, drop_preamble."""
    return row_rules(rows, "id", [
        ("source.extract_note", F.col("extract_note").isNotNull() & _BLANK("extract_note"), "the note is empty"),
        ("source.skip_classes", F.exists("skip_classes", lambda x: (x == "") | x.rlike(r"\s")), "a class name is empty or has white space"),
        ("source.pattern_ref", F.col("section_pattern").isNotNull() & ~F.contains("section_pattern", F.lit("(?P<ref>")), "the pattern has no ref group"),
        ("source.label_pattern", F.col("section_label").isNotNull() & F.col("section_pattern").isNull(), "a label needs its pattern"),
        ("source.label", F.col("section_label").isNotNull() & _BLANK("section_label"), "the label is empty"),
        ("source.drop_preamble", F.coalesce("drop_preamble", F.lit(False)) & F.col("body_start").isNull(), "dropping the preamble needs a body start"),
    ])


def pattern_problem(pattern: str | None, label: str | None = None) -> str | None:
    """What is wrong with a pattern (and the label made of it), or None; on the driver, a registry's patterns are few."""
    if pattern is None:
        return None
    try:
        found = re.compile(pattern)
    except re.error as e:
        return f"the pattern doesn't compile: {e}"
    if "ref" not in found.groupindex and label is None:
        return "the pattern has no ref group"
    names = set(re.findall(r"\\g<([^>]+)>", label or ""))
    unknown = {n for n in names if n not in found.groupindex and not (n.isdigit() and int(n) <= found.groups)}
    return f"the label names unknown groups: {', '.join(sorted(unknown))}" if unknown else None


def cross(sources_: DataFrame, scopes_: DataFrame, availability_: DataFrame) -> DataFrame:
    """Rules between registries. sources: id, scope, language, translation_of; scopes: id, languages; availability: scope, tag, source_id."""
    s = sources_.select("id", "scope", "language", "translation_of")
    met = s.join(scopes_.select(F.col("id").alias("scope"), "languages", F.lit(True).alias("known")), "scope", "left")
    foreign = F.col("known") & F.col("translation_of").isNull() & ~F.array_contains("languages", F.col("language"))
    out = row_rules(met, "id", [
        ("cross.scope", F.col("scope").isNotNull() & F.col("known").isNull(), "the scope is unknown"),
        ("cross.language", foreign, "a source in another language has to be a translation"),
    ])
    backing = s.select(F.col("id").alias("source_id"), F.col("scope").alias("source_scope"), F.lit(True).alias("is_source"))
    named = availability_.where(F.col("source_id").isNotNull()).join(backing, "source_id", "left").withColumn("entry", F.concat_ws("/", "scope", "tag"))
    return out.unionByName(row_rules(named, "entry", [
        ("cross.backing", F.col("is_source").isNull(), "the backing source is unknown"),
        ("cross.backing_scope", F.col("is_source") & ~F.col("source_scope").eqNullSafe(F.col("scope")), "the backing source is of another scope"),
    ]))


def publishing(sources_: DataFrame, publishers_: DataFrame) -> DataFrame:
    """Every source's publisher is declared and the source stands on its domains. sources: id, publisher, url."""
    met = sources_.join(publishers_.select("publisher", "domains", F.lit(True).alias("known")), "publisher", "left")
    return row_rules(met, "id", [
        ("publisher.known", F.col("known").isNull(), "the publisher isn't declared"),
        ("publisher.host", F.col("known") & ~F.coalesce(T.on_domains(T.host("url"), F.col("domains")), F.lit(False)), "the url isn't on the publisher's domains"),
    ])


def golden(rows: DataFrame) -> DataFrame:
    """Rules on golden questions: id, question, n_expected."""
    return row_rules(rows, "id", [
        ("golden.question", _BLANK("question"), "the question is missing"), ("golden.expect", F.coalesce(F.col("n_expected") < 1, F.lit(True)), "nothing is expected"),
    ])
