"""A round over landed bodies: which are refused, and what the others make of their sources' versions.

Requests are not Spark's work. Whoever makes them lands rows, RESPONSES, or files saved by hand, one folder a source
(sources.markup.landed). Here those are checked, met with what is stored, and told as one result a source.

* `resolved` follows pointers: a source whose URL is a manifest is asked for at the item that the manifest names.
* `received` and `saved` give each body its first reason for refusal; `picked` leaves one body a source.
* `body_digests` reads bodies into sections and keeps a digest of them, so that two readings are compared as two strings.
* `observe` is the round: results, and what is added to versions and raw bodies.

Versions are a log (VERSIONS) that only grows: a round appends a row for each version it has seen, and `versions_of` folds the
log. Bodies move only where something changed: a source whose body's SHA-256 is the stored one is settled from digests.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sections, versions
from lectern.session import keep, materialize, scratch
from lectern.sources import markup

#: url is what was asked for, final_url what answered (null: unknown); header names are lower case.
RESPONSES = "source_id string, url string, final_url string, status int, headers map<string,string>, content binary"
BODIES = "source_id string, final_url string, content_type string, etag string, last_modified string, content binary, origin string, error string"
VERSIONS = "document_id string, sha256 string, content_type string, etag string, last_modified string, fetched_at string, last_checked_at string"
RESULTS = "source_id string, status string, detail string, sha256 string"

MAX_BYTES = 50 * 1024 * 1024
STATUSES = ["new", "changed", "unchanged", "failed"]
#: The media types of pages and of saved files, marks of challenge pages and who serves them, and pointer URLs.
PAGE_TYPES = ["text/html", "application/xhtml+xml"]
SAVED_TYPES = {".pdf": "application/pdf", ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml"}
CHALLENGES = {"_cf_chl_opt": "Cloudflare", 'id="anubis_challenge"': "Anubis"}
POINTER = r"^(https://repository\.officiele-overheidspublicaties\.nl/bwb/BWBR\d+/)manifest\.xml\z"
LATEST = "_latestItem"


class Reading(NamedTuple):
    """How a source's bodies are read."""

    rules: sections.Rules = sections.Rules()
    skip_classes: tuple[str, ...] = ()


class Round(NamedTuple):
    results: DataFrame
    seen: DataFrame  # rows for the log of versions
    raw: DataFrame  # document_id, sha256, content of versions that weren't stored


def resolved(sources: DataFrame, manifests: DataFrame, pointer: str = POINTER, attribute: str = LATEST) -> DataFrame:
    """sources (source_id, url) with `target`, where to ask, and `error`; manifests are responses to the pointers among them.

    A pointer's target stands beside it, under the name in the manifest; a name that climbs (..) is none.
    """
    folder = F.nullif(F.regexp_extract("url", pointer, 1), F.lit(""))
    answers = manifests.where(F.col("content").isNotNull()).groupBy(F.col("url").alias("pointer")).agg(F.max(F.decode("content", "UTF-8")).alias("manifest"))
    met = sources.withColumn("folder", folder).join(answers, F.col("folder").isNotNull() & (F.col("url") == F.col("pointer")), "left")
    item = markup.manifest_target("manifest", attribute)
    usable = item.isNotNull() & ~F.contains(item, F.lit(".."))
    target = F.when(F.col("folder").isNull(), F.col("url")).when(usable, F.concat("folder", item))
    error = F.when(target.isNull() & F.col("folder").isNotNull(), F.when(F.col("manifest").isNull(), "nothing landed for the manifest").otherwise("the manifest names no usable item"))
    return met.withColumns({"target": target, "error": error}).select(*sources.columns, "target", "error")


def _challenge(content: str) -> Column:
    """The filter whose mark stands in a body. Marks are ASCII, so bytes are read one a character."""
    read = F.decode(content, "ISO-8859-1")
    out = F.lit(None).cast("string")
    for mark, name in reversed(CHALLENGES.items()):
        out = F.when(F.contains(read, F.lit(mark)), name).otherwise(out)
    return out


def received(responses: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """BODIES of responses, each with the first reason why it is refused, in this order: redirected off https, an error status
    (none counts as one), too long, a challenge that only a browser passes, empty, shorter than announced, a challenge page.
    """
    length, told = F.coalesce(F.length("content"), F.lit(0)), F.col("headers")
    mitigated = F.coalesce(told["cf-mitigated"] == "challenge", F.lit(False))
    announced = F.when(told["content-length"].rlike(r"^[0-9]{1,18}\z"), told["content-length"].cast("long"))
    filter_name = _challenge("content")
    error = (
        F.when(F.col("final_url").isNotNull() & ~F.startswith("final_url", F.lit("https://")), F.concat(F.lit("redirected to non-https URL "), "final_url"))
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")), F.when(mitigated, " (Cloudflare challenge)").otherwise("")))
        .when(length > max_bytes, f"body exceeds {max_bytes} bytes")
        .when(F.coalesce(told["x-amzn-waf-action"] == "challenge", F.lit(False)), "AWS WAF challenge (needs a browser)")
        .when(length == 0, "empty body")
        .when(F.coalesce(announced != length, F.lit(False)), F.format_string("truncated: got %d of %d bytes", length, announced))
        .when(mitigated, "Cloudflare challenge page")
        .when(filter_name.isNotNull(), F.concat(filter_name, F.lit(" challenge page")))
    )
    kind = F.lower(F.trim(F.split(told["content-type"], ";")[0]))
    return responses.select(
        "source_id", "final_url", kind.alias("content_type"), told["etag"].alias("etag"), told["last-modified"].alias("last_modified"), "content", F.lit(None).cast("string").alias("origin"), error.alias("error")
    )


def on_publisher(bodies: DataFrame, sources: DataFrame, publishers: DataFrame) -> DataFrame:
    """bodies, refused where the URL that answered isn't on a domain of the source's publisher; an unknown publisher has none."""
    known = sources.select("source_id", "publisher").join(publishers.select("publisher", "domains"), "publisher", "left")
    out = bodies.join(known, "source_id", "left")
    off = F.col("final_url").isNotNull() & ~F.coalesce(T.on_domains(T.host("final_url"), F.col("domains")), F.lit(False))
    why = F.concat(F.lit("redirected off the publisher's domains: "), F.coalesce(T.host("final_url"), F.lit("no host")))
    return out.withColumn("error", F.coalesce("error", F.when(off, why))).select(*bodies.columns)


def saved(files: DataFrame) -> DataFrame:
    """BODIES of files saved by hand (markup.landed); a source with several files is one refused body."""
    kind = F.lit(None).cast("string")
    for suffix, media in SAVED_TYPES.items():
        kind = F.when(F.col("suffix") == suffix, media).otherwise(kind)
    filter_name = _challenge("content")
    wrong = F.coalesce(
        F.when(F.col("error") == "more than one file", F.col("error")), F.when(kind.isNull(), F.concat(F.lit("no reader for "), F.coalesce("suffix", F.lit("")), F.lit(" files"))),
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty file"), F.when(filter_name.isNotNull(), F.concat(F.lit("a challenge page ("), filter_name, F.lit(")"))),
    )
    rows = files.select("source", kind.alias("content_type"), "content", "path", wrong.alias("error"))
    none = F.lit(None).cast("string")
    good = rows.where("error is null").select(F.col("source").alias("source_id"), none.alias("final_url"), "content_type", none.alias("etag"), none.alias("last_modified"), "content", F.col("path").alias("origin"), "error")
    bad = rows.where("error is not null").groupBy(F.col("source").alias("source_id")).agg(F.min("error").alias("error"), F.min("path").alias("origin"))
    return good.unionByName(bad.withColumns({"final_url": none, "content_type": none, "etag": none, "last_modified": none, "content": F.lit(None).cast("binary")}))


def picked(sources: DataFrame, responses: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each source, with `sha256` in place of the content: its saved file before any response. A repeated response counts
    once; different ones, or none, are refused, since a round has one answer a source. Bodies of sources that aren't listed are left out.
    Null ids are no source's. Contents don't move.
    """
    wanted = sources.where("source_id is not null").select("source_id").distinct()
    told = lambda b: b.withColumns({"sha256": F.sha2("content", 256), "error": F.coalesce("error", F.lit(""))}).drop("content", "final_url")
    bodies = told(responses)
    if files is not None:
        bodies = bodies.join(files.select("source_id").distinct(), "source_id", "left_anti").unionByName(told(files))
    rest = F.struct(*[c for c in bodies.columns if c != "source_id"])
    answer = F.struct(F.coalesce("sha256", F.lit("")), "error")
    least, most = F.min(F.struct(answer.alias("answer"), rest.alias("rest"))), F.max(answer)
    one = bodies.groupBy("source_id").agg(least.alias("one"), most.alias("last"))
    several = F.col("one.answer") != F.col("last")
    met = wanted.join(one, "source_id", "left").select("source_id", several.alias("several"), "one.rest.*")
    error = F.when(F.col("several"), "several answers landed").when(F.col("several").isNull(), "nothing landed").otherwise(F.nullif("error", F.lit("")))
    return met.withColumn("error", error).drop("several")


def contents(asked: DataFrame, *landed: DataFrame) -> DataFrame:
    """source_id, sha256, content of the asked answers (source_id, sha256), each once; no others leave their tasks."""
    rows = [b.select("source_id", F.sha2("content", 256).alias("sha256"), "content") for b in landed]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.join(asked.select("source_id", "sha256").distinct(), ["source_id", "sha256"], "left_semi").dropDuplicates(["source_id", "sha256"])


def body_sections(bodies: DataFrame, readings: dict[str | None, Reading]) -> DataFrame:
    """Sections of bodies (key, reading, content_type, content) by the reading that each names; unnamed ones by the plain reading.

    What can't be read (no reader for its type, broken markup, no body where the rules want one) is a row with `error`.
    """
    names = [n for n in readings if n is not None]
    named = F.when(F.col("reading").isin(names), F.col("reading")) if names else F.lit(None).cast("string")
    texts = markup.decoded(bodies.select("key", named.alias("reading"), "content_type", "content"), "content").drop("content")
    out = None
    for name, reading in {None: Reading(), **readings}.items():
        some = texts.where(F.col("reading").eqNullSafe(F.lit(name)))
        blocks = materialize(markup.html_blocks(some, "key", "text", reading.skip_classes, "content_type").withColumnRenamed("key", "doc_id"), "body-blocks")
        broken = blocks.where("text is null").select("doc_id").distinct()
        found = sections.split(blocks.join(broken, "doc_id", "left_anti"), reading.rules)
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in found.schema if f.name not in ("doc_id", "section_no", "error")}
        found = found.unionByName(broken.withColumns({"section_no": F.lit(0), **nulls, "error": F.lit("no reader for this body")}))
        out = found if out is None else out.unionByName(found)
    return out


def body_digests(bodies: DataFrame, readings: dict[str | None, Reading]) -> DataFrame:
    """key, body: a digest of references and texts of a body's sections in order, without the preamble. '' if it has none, null if it can't be read.

    Only digests of sections come together in a row, and a body has no more of them than it has lines.
    """
    found = body_sections(bodies, readings)
    inside = F.col("error").isNull() & ~F.startswith("section_ref", F.lit(sections.PREAMBLE))
    line = F.struct("section_no", "section_ref", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    told = found.groupBy(F.col("doc_id").alias("key")).agg(F.array_sort(F.collect_list(F.when(inside, line))).alias("lines"), F.count("error").alias("errors"))
    body = F.when(F.col("errors") > 0, F.lit(None)).when(F.size("lines") == 0, "").otherwise(F.sha2(F.to_json("lines").cast("binary"), 256))
    # a body without any block has no sections either
    return bodies.select("key").distinct().join(told, "key", "left").select("key", F.when(F.col("errors").isNull(), "").otherwise(body).alias("body"))


def versions_of(log: DataFrame) -> DataFrame:
    """The log of versions as versions: one row a document and content, first fetched, last checked, with what the first row says of it."""
    first = F.min_by(F.struct("content_type", "etag", "last_modified"), F.struct("fetched_at", "last_checked_at", F.col("content_type").isNull()))
    out = log.groupBy("document_id", "sha256").agg(first.alias("told"), F.min("fetched_at").alias("fetched_at"), F.max("last_checked_at").alias("last_checked_at"))
    short = F.concat_ws("@", "document_id", F.substring("sha256", 1, 12))
    return out.select(short.alias("id"), "document_id", "sha256", "told.content_type", "told.etag", "told.last_modified", "fetched_at", "last_checked_at")


def _told(bodies: DataFrame, landed: tuple[DataFrame, ...], now_held: DataFrame, raw: DataFrame, readings: dict[str | None, Reading], reading_of: DataFrame | None) -> DataFrame:
    """The picked bodies with status, detail and `left`, the content that is current after the round (null: none)."""
    plain = bodies.join(now_held, "source_id", "left")
    differs = F.col("error").isNull() & F.col("old").isNotNull() & (F.col("old") != F.col("sha256"))
    plain = materialize(plain.withColumn("differs", differs), "round")
    if reading_of is None:
        reading_of = plain.select("source_id").limit(0).withColumn("reading", F.lit(None).cast("string"))
    asked = plain.where("differs").join(reading_of, "source_id", "left")
    key = lambda sha: F.concat_ws("@", "source_id", sha)
    after = asked.select("source_id", "sha256", "reading", "content_type", key("sha256").alias("key")).join(contents(asked, *landed), ["source_id", "sha256"])
    before = asked.select("source_id", "reading", F.col("old_type").alias("content_type"), F.col("old").alias("sha256"), key("old").alias("key"))
    before = before.join(raw.select(F.col("document_id").alias("source_id"), "sha256", "content"), ["source_id", "sha256"])
    columns = ["key", "reading", "content_type", "content"]
    read = materialize(body_digests(before.select(*columns).unionByName(after.select(*columns)), readings), "read")
    met = plain.withColumn("key", key("sha256")).join(read.withColumnRenamed("body", "after"), "key", "left").withColumn("key", key("old"))
    met = met.join(read.withColumnRenamed("body", "before"), "key", "left")
    had = F.coalesce(F.col("before") != "", F.lit(False))
    page, was_page = F.coalesce(F.col("content_type").isin(PAGE_TYPES), F.lit(False)), F.col("old_type").isNull() | F.col("old_type").isin(PAGE_TYPES)
    short, old = F.substring("sha256", 1, 12), F.substring("old", 1, 12)
    kept = F.lit("; a block page? current version kept")
    says = lambda status, detail: F.struct(F.lit(status).alias("status"), detail.alias("detail"))
    told = (
        F.when(F.col("error").isNotNull(), says("failed", F.col("error")))
        .when(F.col("old").isNull(), says("new", short))
        .when(~F.col("differs"), says("unchanged", short))
        .when(had & F.coalesce(F.col("before") == F.col("after"), F.lit(False)), says("unchanged", F.concat(old, F.lit(" (markup-only change "), short, F.lit(" ignored)"))))
        .when(page & ~was_page, says("failed", F.concat(F.lit("got "), "content_type", F.lit(" where "), old, F.lit(" is "), "old_type", kept)))
        .when(had & F.coalesce(F.col("after") == "", F.lit(False)), says("failed", F.concat(short, F.lit(" has no body sections where "), old, F.lit(" has"), kept)))
        .otherwise(says("changed", F.concat(old, F.lit(" -> "), short)))
    )
    origin = F.when(F.col("origin").isNotNull() & (F.col("told.status") != "failed"), F.concat(F.lit(" (saved by hand: "), F.regexp_extract("origin", r"([^/]+)\z", 1), F.lit(")"))).otherwise("")
    left = F.when(F.col("told.status").isin("new", "changed"), F.col("sha256")).otherwise(F.col("old"))
    out = met.withColumn("told", told).withColumns({"status": F.col("told.status"), "detail": F.concat("told.detail", origin), "left": left})
    return out.drop("told", "key", "before", "after", "differs")


def observe(bodies: DataFrame, landed: tuple[DataFrame, ...], log: DataFrame, raw: DataFrame, now: str, readings: dict[str | None, Reading] | None = None, reading_of: DataFrame | None = None) -> Round:
    """The round over `picked` bodies and what landed with contents (received, saved), with the log of versions and raw bodies (document_id, sha256, content) before it.

    new: the source has no version. unchanged: the bytes are those of the current version, or its sections are (only markup
    differs; the new bytes are dropped). failed, and what is stored stays: the body was refused, a page came where the current
    version is none, or a body without sections where it has some. changed otherwise, also back to an earlier version, which is
    then current again. reading_of: source_id, reading.
    """
    stored = versions_of(log)
    now_held = versions.current(stored).select(F.col("document_id").alias("source_id"), F.col("sha256").alias("old"), F.col("content_type").alias("old_type"))
    with scratch(bodies.sparkSession):
        out = keep(_told(bodies, landed, now_held, raw, readings or {}, reading_of), "round")
    results = out.select("source_id", "status", "detail", F.col("left").alias("sha256"))
    at = F.lit(now)
    taken = F.col("status").isin("new", "changed")
    # a version that is only checked again brings nothing of its own
    own = {c: F.when(taken, F.col(c)) for c in ("content_type", "etag", "last_modified")}
    seen = out.where("status <> 'failed'").select(F.col("source_id").alias("document_id"), F.col("left").alias("sha256"), *[c.alias(n) for n, c in own.items()], at.alias("fetched_at"), at.alias("last_checked_at"))
    fresh = out.where(taken).select("source_id", "sha256").join(stored.select(F.col("document_id").alias("source_id"), "sha256"), ["source_id", "sha256"], "left_anti")
    added = contents(fresh, *landed).select(F.col("source_id").alias("document_id"), "sha256", "content")
    return Round(results, seen, added)


def counts(results: DataFrame, *by: str) -> DataFrame:
    """How many sources are new, changed, unchanged and failed."""
    return results.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])
