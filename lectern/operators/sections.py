"""From the blocks of a document to its sections.

`split` is the whole rule set as windows over a document's blocks. A block's section is the number of section starts
up to it; a heading, which travels with what it introduces, takes the least such number among the later blocks that are
none (a running minimum from the end). Heading paths are forward fills, one a level, each void once a higher one came
later. The title line before a number, which depends on what the section before has left, is told by runs.
The functions below express single rules over any partitioned, ordered rows. Patterns are regular expressions that
mean the same in Python and in Java; a section pattern that matches nothing of a line starts no section. Blocks without a
doc_id are no document's. Of heading levels beyond DEPTH all count as DEPTH.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

PREAMBLE = "(preamble)"
MAX_CHARS = 12_000
REF_CHARS = 120
DEPTH = 9


@dataclass(frozen=True)
class Rules:
    """How a source is split; patterns are Python regular expressions matched at a line's start.

    title_lines: in pattern mode a title line just before a section's number goes with that section.
    """

    section_pattern: str | None = None
    chapter_pattern: str | None = None
    body_start: str | None = None
    body_end: str | None = None
    chapter_label: str | None = None
    first_chapter: str = ""
    section_label: str | None = None
    drop_preamble: bool = False
    title_lines: bool = True
    max_chars: int = MAX_CHARS


BLOCKS = "doc_id string, ord int, text string, level int, ref string, page int, quoted boolean"
SECTIONS = "doc_id string, section_no int, section_ref string, heading_path array<string>, text string, error string"


def _at_start(pattern: str) -> str:
    """A Python pattern as one of Java's that is matched at a line's start."""
    re.compile(pattern)
    return r"\A(?:" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")) + ")"


def _group(view: Column, pattern: str, name: str | int) -> Column:
    number = int(name) if str(name).isdigit() else re.compile(pattern).groupindex[str(name)]
    return F.regexp_extract(view, _at_start(pattern), number)


def _label(view: Column, pattern: str, template: str | None) -> Column:
    """What a matching line is called: its group "ref", or a template of groups (\\g<name>, \\1)."""
    if template is None:
        return _group(view, pattern, "ref")
    pieces = re.split(r"\\g<(\w+)>|\\(\d)", template)
    out = [F.lit(pieces[0])]
    for k in range(1, len(pieces), 3):
        out += [_group(view, pattern, pieces[k] or pieces[k + 1]), F.lit(pieces[k + 2])]
    return F.concat(*out)


def _placed(blocks: DataFrame, rules: Rules) -> DataFrame:
    """Blocks up to the body's end with `start` (a section's own reference), `head`, `chapter` and `place` (the section's
    number, 0 for what stands before the first). Documents whose body isn't found have `error` and nothing else.
    """
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("level") > 0, F.col("level"))
    view = F.concat(F.when(F.coalesce("quoted", F.lit(False)), "> ").otherwise(""), F.when(level.isNotNull(), F.concat(F.expr("repeat('#', level)"), F.lit(" "))).otherwise(""), F.col("text"))
    rows = blocks.withColumns({"view": view, "level": level})
    begins = F.col("view").rlike(_at_start(rules.body_start)) if rules.body_start is not None else F.lit(True)
    rows = rows.withColumn("begin", F.min(F.when(begins, F.col("ord"))).over(doc))
    error = F.when(F.col("begin").isNull(), f"no line begins the body (body_start {rules.body_start!r})")
    if rules.body_end is not None:
        ends = F.col("view").rlike(_at_start(rules.body_end)) & (F.col("ord") > F.col("begin"))
        rows = rows.withColumn("stop", F.min(F.when(ends, F.col("ord"))).over(doc))
        error = F.coalesce(error, F.when(F.col("stop").isNull(), f"no line ends the body (body_end {rules.body_end!r})"))
        rows = rows.withColumn("error", error).where("error is not null or ord < stop")
    else:
        rows = rows.withColumn("error", error)
    inside, v = F.col("ord") >= F.col("begin"), F.col("view")
    by_ref = F.max(F.coalesce(F.col("ref") != "", F.lit(False))).over(doc)
    by_level = F.max(F.col("level").isNotNull()).over(doc)
    before = F.when(F.col("ord") > F.col("begin"), F.lag("page").over(doc.orderBy("ord")))
    page = F.when(F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before), F.concat(F.lit("p. "), F.col("page").cast("string")))
    other = F.when(by_level, F.when(F.col("level").isNotNull(), F.substring("text", 1, REF_CHARS))).otherwise(page)
    if rules.section_pattern:
        label = _label(v, rules.section_pattern, rules.section_label)
        other = F.when(v.rlike(_at_start(rules.section_pattern)) & (_group(v, rules.section_pattern, 0) != ""), label)
    rows = rows.withColumn("by_ref", by_ref).withColumn("start", F.when(inside, F.when(F.col("by_ref"), F.col("ref")).otherwise(other)))
    opens = inside & v.rlike(_at_start(rules.chapter_pattern)) if rules.chapter_pattern else F.lit(False)
    rows = rows.withColumn("opens", opens)
    named = F.when(F.col("opens"), _label(v, rules.chapter_pattern, rules.chapter_label)) if rules.chapter_pattern else F.lit(None).cast("string")
    rows = rows.withColumn("chapter", F.coalesce(F.last(named, ignorenulls=True).over(upto), F.lit(rules.first_chapter)))
    rows = rows.withColumn("head", F.col("start").isNull() & (F.col("level").isNotNull() | F.col("opens")))
    rows = rows.withColumn("count", F.count("start").over(upto))
    # a heading goes with what comes next: the least count of what is no heading, from the end on
    back = doc.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.coalesce(F.min(F.when(~F.col("head"), F.col("count"))).over(back), F.count("start").over(doc))
    return rows.withColumn("place", F.when(F.col("head"), ahead).otherwise(F.col("count")))


def _paths(rows: DataFrame) -> DataFrame:
    """Adds `heading_path`: headings before a block, of each level the last one unless a higher one came after it."""
    earlier = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.when(F.col("level").isNotNull(), F.least("level", F.lit(DEPTH))).when(F.col("opens"), F.lit(1))
    last = {k: F.last(F.when(depth == k, F.struct("ord", "text")), ignorenulls=True).over(earlier) for k in range(1, DEPTH + 1)}
    rows = rows.withColumns({f"last_{k}": c for k, c in last.items()})
    own = F.when(F.col("level").isNotNull(), F.least("level", F.lit(DEPTH))).when(F.col("opens"), F.lit(1)).otherwise(F.lit(DEPTH + 1))
    found, newest = [], F.lit(-1)
    for k in range(1, DEPTH + 1):
        at = F.coalesce(F.col(f"last_{k}.ord"), F.lit(-1))
        found.append(F.when((own > k) & (at > newest), F.col(f"last_{k}.text")))
        newest = F.greatest(newest, at)
    return rows.withColumn("heading_path", F.filter(F.array(*found), lambda t: t.isNotNull())).drop(*[f"last_{k}" for k in last])


def _with_titles(rows: DataFrame) -> DataFrame:
    """In pattern mode a title line just before a section's number moves on to it.

    Whether one may depends on the section before having more than one line, its own or one that has moved to it, so
    a line of a section with one line moves where the one before it does: an unbroken run of such moves counts back to
    a section with several.
    """
    doc = Window.partitionBy("doc_id")
    lines = Window.partitionBy("doc_id", "place")
    rows = rows.withColumns({"lines": F.count("*").over(lines), "is_last": F.col("ord") == F.max("ord").over(lines), "head_before": F.lag("head", 1, False).over(doc.orderBy("ord"))})
    # the last line of a section meets the next start: a start's head_before, brought to the section's number
    starts = rows.where("start is not null").select("doc_id", F.col("count").alias("k"), F.col("head_before").alias("travels"))
    ends = rows.where("is_last and not by_ref").select("doc_id", (F.col("place") + 1).alias("k"), "ord", "lines", T.is_title("text").alias("title"))
    met = starts.join(ends, ["doc_id", "k"])
    upto = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    may = F.col("title") & ~F.col("travels")
    met = met.withColumns({"broken": F.max(F.when(~may, F.col("k"))).over(upto), "rooted": F.max(F.when(may & (F.col("lines") > 1), F.col("k"))).over(upto)})
    moved = met.where(may & (F.col("rooted") > F.coalesce("broken", F.lit(-1)))).select("doc_id", "ord", F.lit(1).alias("moves"))
    rows = rows.join(moved, ["doc_id", "ord"], "left").withColumn("moves", F.coalesce("moves", F.lit(0)))
    # a start that moves leaves its name behind
    leaves = F.when((F.col("moves") == 1) & F.col("start").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("moves") == 1))
    rows = rows.withColumn("moved", F.explode(leaves))
    stays = ~F.col("moved") & (F.col("moves") == 1)
    changed = {"place": F.col("place") + F.col("moved").cast("int"), "start": F.when(~F.col("moved"), F.col("start")), "text": F.when(~stays, F.col("text"))}
    return rows.withColumns(changed).drop("lines", "is_last", "head_before", "moves", "moved")


def split(blocks: DataFrame, rules: Rules) -> DataFrame:
    """Sections of every document; a document that fails is one row with `error`, the others go on.

    Windows over a document's blocks, which Spark sorts and spills; only a section's lines come together in a row.
    """
    rows = _paths(_placed(blocks.where("doc_id is not null"), rules))
    failed = rows.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("error"))
    rows = rows.where("error is null")
    if rules.section_pattern and rules.title_lines:
        rows = _with_titles(rows)
    own = F.when((F.col("chapter") == "") | F.startswith("start", "chapter"), F.col("start")).otherwise(F.concat_ws(" ", "chapter", "start"))
    begun = F.col("start").isNotNull()
    found = rows.groupBy("doc_id", "place").agg(
        F.first(F.when(begun, own), ignorenulls=True).alias("ref"), F.first(F.when(begun, F.col("heading_path")), ignorenulls=True).alias("heading_path"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))), lambda b: b["text"]).alias("texts"), F.sum(F.length("text") + 1).alias("chars"),
    )
    found = found.withColumns({"ref": F.when(F.col("place") == 0, PREAMBLE).otherwise(F.col("ref")), "heading_path": F.coalesce("heading_path", F.array().cast("array<string>"))})
    found = disambiguate(found, ["doc_id"], "ref", ["place"])
    whole = F.array(F.col("texts"))
    parts = F.when(F.col("chars") - 1 <= rules.max_chars, whole).otherwise(cap(F.col("texts"), rules.max_chars))
    found = found.select("doc_id", "place", "unique_ref", "heading_path", F.posexplode(parts).alias("part", "lines"), F.size(parts).alias("n_parts"))
    ref = F.when(F.col("n_parts") == 1, F.col("unique_ref")).otherwise(F.format_string("%s (part %d)", F.col("unique_ref"), F.col("part") + 1))
    found = found.select("doc_id", "place", "part", ref.alias("section_ref"), "heading_path", F.array_join("lines", "\n").alias("text"))
    if rules.drop_preamble:
        kept = found.where(~F.startswith("section_ref", F.lit(PREAMBLE)))
        none = found.select("doc_id").distinct().join(kept.select("doc_id"), "doc_id", "left_anti")
        failed, found = failed.unionByName(none.withColumn("error", F.lit("no sections"))), kept
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "part")) - 1
    done = found.select("doc_id", number.alias("section_no"), "section_ref", "heading_path", "text", F.lit(None).cast("string").alias("error"))
    nothing = {c: F.lit(None).cast(done.schema[c].dataType) for c in ("section_ref", "heading_path", "text")}
    return done.unionByName(failed.select("doc_id", F.lit(0).alias("section_no"), *[c.alias(n) for n, c in nothing.items()], "error"))


def chunk_rows(sections: DataFrame, version: str = "version_id", number: str = "section_no") -> DataFrame:
    """Chunk ids (version#0000), ordinals from 0 and text digests."""
    return sections.withColumns(
        {"id": F.format_string("%s#%04d", F.col(version), F.col(number)), "ord": F.col(number), "sha256": F.sha2(F.col("text").cast("binary"), 256)}
    )


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of a text: key, ord (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ord", "line"))


def disambiguate(rows: DataFrame, group: list[str], ref: str, order: list[str]) -> DataFrame:
    """The second and later rows with a reference get " (n)"."""
    n = F.row_number().over(Window.partitionBy(*group, ref).orderBy(*order))
    return rows.withColumn("unique_ref", F.when(n == 1, F.col(ref)).otherwise(F.concat(ref, F.lit(" ("), n.cast("string"), F.lit(")"))))


def carry_chapter(rows: DataFrame, group: list[str], chapter: Column, order: list[str], first: str = "") -> DataFrame:
    """Each row with the latest chapter at or before it."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.coalesce(F.last(chapter, ignorenulls=True).over(upto), F.lit(first)))


def body_window(rows: DataFrame, group: list[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """Rows from the first start to before the first end after it; groups without a start go.

    The bounds are aggregated before they are joined back, so that no group is sorted.
    """
    first = rows.where(starts).groupBy(*group).agg(F.min(order).alias("first_row"))
    bounded = rows.join(first, group)
    last = bounded.where(ends & (F.col(order) > F.col("first_row"))).groupBy(*group).agg(F.min(order).alias("end_row"))
    return bounded.join(last, group, "left").where((F.col(order) >= F.col("first_row")) & (F.col("end_row").isNull() | (F.col(order) < F.col("end_row"))))


def cap(texts: Column, limit: int = MAX_CHARS) -> Column:
    """Greedy parts of an array of texts: a part is closed before the text that would take it over the limit."""
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("part"), F.lit(0).alias("size")
    )

    def add(acc: Column, t: Column) -> Column:
        over = (F.size(acc["part"]) > 0) & (acc["size"] + F.length(t) > limit)
        return F.when(over, F.struct(F.concat(acc["done"], F.array(acc["part"])).alias("done"), F.array(t).alias("part"), (F.length(t) + 1).alias("size"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["part"], F.array(t)).alias("part"), (acc["size"] + F.length(t) + 1).alias("size"))
        )

    return F.aggregate(texts, start, add, lambda acc: F.concat(acc["done"], F.array(acc["part"])))


def running_lines(pages: DataFrame, doc: str, page: str, ord_: str, line: str, edge: int = 3, least_pages: int = 4, share: float = 0.5) -> DataFrame:
    """Shapes of lines that stand in the first or last few lines of at least that share of a document's pages."""
    kept = pages.where(F.trim(line) != "")
    w = Window.partitionBy(doc, page)
    kept = kept.withColumns({"from_top": F.row_number().over(w.orderBy(ord_)), "from_end": F.row_number().over(w.orderBy(F.desc(ord_)))})
    total = pages.select(doc, page).distinct().groupBy(doc).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    edges = kept.where((F.col("from_top") <= edge) | (F.col("from_end") <= edge))
    shapes = edges.select(doc, page, F.regexp_replace(line, r"\p{Nd}+", "#").alias("shape")).distinct().groupBy(doc, "shape").agg(F.count("*").alias("on_pages"))
    return shapes.join(total, doc).where(F.col("on_pages") >= F.col("n_pages") * share)


def page_blocks(lines: DataFrame, doc: str, page: str, ord_: str, line: str, least_pages: int = 4, share: float = 0.5) -> DataFrame:
    """doc, page, ord, text: the lines of paged documents (as a PDF's text gives them) as blocks, without running lines."""
    running = running_lines(lines, doc, page, ord_, line, least_pages=least_pages, share=share).select(doc, "shape")
    rows = lines.select(doc, page, F.col(ord_).alias("ord"), T.clean(line).alias("text")).where("text <> ''")
    return rows.withColumn("shape", T.shape("text")).join(running, [doc, "shape"], "left_anti").drop("shape")
