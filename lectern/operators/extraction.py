"""Statements that a model reads out of sections: prompts, memo, validation, translations.

The model call is the only Python in here: a callable on (system, message) inside mapInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

QUOTE_CHARS = 1000
RECORD = "verbatim_quote string, summary string, modality string, topics array<string>, applies_to array<string>, effective_from string"
OUTPUT = f"statements array<struct<{RECORD.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>>"


def message(columns: dict[str, str], heading: str, text: str) -> Column:
    """The prompt of a section: labelled lines, headings joined or "-", and the text in its tag."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(label + ": "), F.col(c).cast("string"))) for label, c in columns.items()]
    path = F.when(F.size(heading) > 0, F.array_join(heading, " > ")).otherwise("-")
    return F.concat_ws("\n", *lines, F.concat(F.lit("Headings: "), path), F.concat(F.lit("<section>\n"), F.col(text), F.lit("\n</section>")))


def system_prompt(base: str, modalities: list[str], topics: list[tuple[str, str]]) -> tuple[str, str]:
    """The system prompt of a domain, and its version: 12 hexadecimal digits that change with any word of it."""
    import hashlib

    lines = [base.strip(), "", "Modalities: " + ", ".join(modalities), "Topics:", *[f"- {i}: {label}" for i, label in topics]]
    prompt = "\n".join(lines)
    return prompt, hashlib.sha256(prompt.encode()).hexdigest()[:12]


def eligibility(ref: str, text: str, skip: str | None = None, matching: str | None = None) -> Column:
    """Why a section isn't read: preamble, skipped (its reference begins with `skip`), unmatched (its text lacks `matching`); else null."""
    why = F.when(F.col(ref).startswith("(preamble)"), "preamble")
    why = why.when(F.col(ref).rlike(f"^(?:{T.java_regex(skip)})"), "skipped") if skip else why
    return why.when(~F.coalesce(F.col(text).rlike(T.java_regex(matching)), F.lit(False)), "unmatched") if matching else why


def selected(rows: DataFrame, source: str, wanted: list[str] | None) -> DataFrame:
    """Rows of the wanted sources; an unknown source is an error."""
    if not wanted:
        return rows
    known = {r[0] for r in rows.where(F.col(source).isin(wanted)).select(source).distinct().collect()}  # of the wanted ones at most
    if unknown := sorted(set(wanted) - known):
        raise ValueError(f"unknown sources {unknown}")
    return rows.where(F.col(source).isin(wanted))


def outcomes(sections: DataFrame, kept: Column, rejected: Column) -> DataFrame:
    """sections (why, cached, error) with `outcome`: what a run does to each section's statements.

    Sections that aren't read keep theirs, but skipped ones lose them; a failed call leaves the old ones; an output of
    which every record was rejected clears them.
    """
    read = F.when(F.col("error").isNotNull(), "failed: kept").when(kept > 0, "stored").when(rejected > 0, "rejected: cleared").otherwise("none: cleared")
    return sections.withColumn("outcome", F.when(F.col("why") == "skipped", "skipped: cleared").when(F.col("why").isNotNull(), "not read").otherwise(read))


def cached(sections: DataFrame, memo: DataFrame, key: list[str]) -> DataFrame:
    """Sections with the memo's output, null where the model has to be called."""
    return sections.join(memo, key, "left")


def call_model(misses: DataFrame, call: Callable[[str, str], str], system: str, attempts: int = 2, unique: bool = False) -> DataFrame:
    """message_sha256, output, error for each distinct message (`unique`: they are); one failure never stops the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, text in zip(batch["message_sha256"], batch["message"]):
                error = None
                for _ in range(attempts):
                    try:
                        out.append((digest, call(system, text), None))
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the callable raises is that section's failure
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append((digest, None, error))
            yield pd.DataFrame(out, columns=["message_sha256", "output", "error"])

    rows = misses.select("message_sha256", "message")
    return (rows if unique else rows.dropDuplicates(["message_sha256"])).mapInPandas(run, "message_sha256 string, output string, error string")


def records(outputs: DataFrame, output: str = "output", text: str | None = None) -> DataFrame:
    """A row for each record of a model's output, `n` from 1; an output that can't be read has one row with bad_output.

    `text`: the section's text; `comparable` is then its comparable form, made once a section and only where one of the
    quotes asks for it (else null).
    """
    rows = outputs.withColumn("parsed", F.from_json(T.unfence(output), OUTPUT)["statements"]).withColumn("bad_output", F.col("parsed").isNull())
    if text:
        asks = F.exists("parsed", lambda r: (F.length(r["verbatim_quote"]) <= QUOTE_CHARS) & ~literal(r["verbatim_quote"], F.col(text)))
        rows = rows.withColumn("comparable", F.when(asks, T.comparable(text)))
    return rows.select(*[c for c in rows.columns if c != "parsed"], F.posexplode_outer("parsed").alias("pos", "record")).withColumn("n", F.col("pos") + 1).drop("pos")


def contained(quote: Column | str, text: Column | str) -> Column:
    return F.contains(T.comparable(text), T.comparable(quote))


#: Ends of a quote of which comparable() may leave out more or less in a text than in the quote alone.
_OPEN_END = rf"\A(?:{T.SPACE[:-1]}|[-\u00ad])|(?:{T.SPACE[:-1]}|[-\u00ad])\z"


def literal(quote: Column, text: Column) -> Column:
    """Whether a quote is in a text as it is and between ends of its own, so that its comparable form is in the text's."""
    return F.contains(text, quote) & ~F.rlike(quote, F.lit(_OPEN_END))


def reject_reason(quote: Column, text_comparable: Column, summary: Column, modality: Column, topics: Column, applies_to: Column, effective: Column,
                  modalities: list[str], known_topics: list[str], tags: Column, text: Column | None = None) -> Column:
    """The first rule that a record breaks, or null. With `text`, the comparable form is looked at only for quotes that aren't in it literally."""
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    distinct = F.array_distinct(topics)
    there = F.contains(text_comparable, T.comparable(quote))
    there = there if text is None else literal(quote, text) | there
    return (
        F.when(blank(quote), "quote missing")
        .when(F.length(quote) > QUOTE_CHARS, "quote too long")
        .when(~F.coalesce(there, F.lit(False)), "quote not verbatim")
        .when(blank(summary), "summary missing")
        .when(~F.coalesce(modality.isin(modalities), F.lit(False)), "unknown modality")
        .when(~F.coalesce(F.size(distinct).between(1, 3) & (F.size(F.array_except(distinct, words(known_topics))) == 0), F.lit(False)), "topics")
        .when(~F.coalesce((F.size(applies_to) > 0) & (F.size(F.array_except(applies_to, tags)) == 0), F.lit(False)), "applies_to")
        .when(effective.isNotNull() & ~T.partial_date_valid(effective), "effective_from")
    )


def link_translations(translated: DataFrame, originals: DataFrame, document: str, ref: str, original_id: str) -> DataFrame:
    """Sections of a translation with the original's section of the same key, where that key is unique there."""
    keyed = originals.withColumn("ref_key", T.ref_key(ref))
    unique = keyed.where(F.size("ref_key") > 0).groupBy(document, "ref_key").agg(F.min(original_id).alias("original_section"), F.count("*").alias("n"))
    unique = unique.where("n = 1").drop("n")
    return translated.withColumn("ref_key", T.ref_key(ref)).join(unique, [document, "ref_key"], "left")
