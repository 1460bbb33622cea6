"""XML bodies as a table of events, and the two dialects whose rules are set operations over it.

`events` is the only Python: it flattens a body into rows of elements and texts with the path of each. A dialect is
then a composition of DataFrame operations: what encloses a text, which version of it counts, where headings begin
and what a reference is called are columns, aggregations by enclosing node, and running values in document order.

Paths are kept to their first PATH elements, deeper ones are known by these; so an event's size is bounded whatever the
nesting. A body that is no XML gives one event with `error`.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

PATH = 24
EVENTS = "at int, path array<string>, nodes array<int>, attributes map<string,string>, text string, error string"
BLOCKS = ["at", "part", "text", "level", "ref"]


def flattened(body: str | bytes) -> Iterator[tuple]:
    """An event for each element (its text is null) and each piece of text, in document order."""
    root = ElementTree.fromstring(body)
    at, todo = 0, [(root, (), ())]
    while todo:
        x, path, nodes = todo.pop()
        if isinstance(x, str):
            yield at, list(path), list(nodes), None, x
        elif isinstance(x.tag, str):
            path, nodes = (path + (x.tag.rpartition("}")[2],))[:PATH], (nodes + (at,))[:PATH]
            yield at, list(path), list(nodes), dict(x.attrib), None
            inner = [(x.text, path, nodes)] if x.text else []
            for child in x:
                inner.append((child, path, nodes))
                if child.tail:
                    inner.append((child.tail, path, nodes))
            todo += reversed(inner)
        at += 1


def events(bodies: DataFrame, key: str, body: str) -> DataFrame:
    kind = bodies.schema[key].dataType.simpleString()
    columns = [key, *(c.split()[0] for c in EVENTS.split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, b in zip(batch[key], batch[body]):
                try:
                    rows = [(k, *e, None) for e in flattened(b)]
                except (ElementTree.ParseError, ValueError) as e:
                    rows = [(k, 0, None, None, None, None, f"malformed XML: {e}")]
                yield pd.DataFrame(rows, columns=columns)

    return bodies.select(key, body).where(F.col(body).isNotNull()).mapInPandas(read, f"{key} {kind}, {EVENTS}")


def _said() -> Column:
    """All the text of a group of events in order."""
    found = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text"))))
    return T.clean(F.array_join(F.transform(found, lambda e: e["text"]), " "))


def _nth(column: str, n: Column | int) -> Column:
    return F.try_element_at(F.col(column), F.lit(n) if isinstance(n, int) else n)


#: The levels of heading paragraphs by what their class begins with.
HEADINGS = {"anexo": 1, "titulo": 1, "capitulo": 2, "seccion": 3, "subseccion": 4}


def dated_blocks(found: DataFrame, key: str) -> DataFrame:
    """Spanish consolidated texts: blocks with dated versions, the last of which counts.

    Heading paragraphs of a heading block are one heading a level. A provision's first paragraph bears its title as a
    reference; after an annex has begun its number does ("Anexo 3"), and paragraphs that begin with its sub-points bear theirs.
    """
    inside = found.where(F.slice("path", 1, 4) == F.array(*map(F.lit, ("response", "data", "texto", "bloque"))))
    inside = inside.withColumns({"block": _nth("nodes", 4), "version": _nth("nodes", 5), "paragraph": _nth("nodes", 6)})
    blocks = inside.where((F.size("path") == 4) & F.col("text").isNull())
    blocks = blocks.select(key, "block", F.col("attributes")["tipo"].alias("kind"), F.coalesce(T.clean(F.col("attributes")["titulo"]), F.lit("")).alias("title"))
    dated = inside.where(_nth("path", 5) == "version")
    last = dated.groupBy(key, "block").agg(F.max("version").alias("version"))
    own = (F.size("path") == 6) & F.col("text").isNull()
    lines = dated.where(_nth("path", 6) == "p").groupBy(key, "block", "version", "paragraph").agg(_said().alias("said"), F.max(F.when(own, F.col("attributes")["class"])).alias("class"))
    lines = lines.where("said <> ''").join(last, [key, "block", "version"]).join(blocks, [key, "block"]).where("kind is null or kind <> 'firma'")
    name = F.regexp_replace(F.coalesce("class", F.lit("")), "_(num|tit)$", "")
    level = F.when(F.col("kind") == "encabezado", F.coalesce(*[F.when(name == n, k) for n, k in HEADINGS.items()]))
    one = Window.partitionBy(key, "block")
    earlier = Window.partitionBy(key).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"level": level, "annexed": F.when((name == "anexo") & level.isNotNull(), True)})
    lines = lines.withColumns(
        {"headed": F.max("level").over(one).isNotNull(), "in_annex": F.max("annexed").over(earlier).isNotNull(), "first": F.col("paragraph") == F.min("paragraph").over(one)}
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "said"))), lambda p: p["said"]), " ")
    heads = lines.where("level is not null").groupBy(key, "block", "level").agg(F.min("paragraph").alias("part"), text.alias("text"))
    number = F.when(F.col("kind") == "precepto", F.regexp_extract("title", r"^(\d+)\.? ", 1))
    point = F.regexp_extract("said", r"^(\d+(?:\.\d+)+)\.? ", 1)
    mine = F.when(F.col("in_annex") & (number != "") & F.startswith(point, F.concat(number, F.lit("."))), F.concat(F.lit("Anexo "), point))
    titled = F.when((F.col("kind") == "precepto") & F.col("first"), F.nullif("title", F.lit("")))
    titled = F.when(F.col("in_annex") & titled.isNotNull(), F.concat(F.lit("Anexo "), F.when(number != "", number).otherwise(titled))).otherwise(titled)
    plain = lines.where("not headed").select(key, F.col("block").alias("at"), F.col("paragraph").alias("part"), F.col("said").alias("text"), F.lit(None).cast("int").alias("level"), F.coalesce(mine, titled).alias("ref"))
    return plain.unionByName(heads.select(key, F.col("block").alias("at"), "part", "text", F.col("level").cast("int").alias("level"), F.lit(None).cast("string").alias("ref")))


#: Element names of Danish acts.
UNITS = ["Paragraf", "AendringCentreretParagraf", "IkraftCentreretParagraf"]
LINES = ["Stk", "Exitus", "AendringsNummer"]
TITLES, SILENT = {"Kapitel": (1, ["Explicatus", "Rubrica"]), "ParagrafGruppe": (2, ["Rubrica"])}, ["Meta", "Rubrica", "Explicatus", "Ikraft", "Nota"]


def _first(names: list[str]) -> Column:
    """Where the first element with one of these names stands in a path; null if none does."""
    return F.array_min(F.filter(F.array(*[F.array_position("path", n) for n in names]), lambda p: p > 0)).cast("int")


def numbered_units(found: DataFrame, key: str) -> DataFrame:
    """Danish acts: one section a unit, the outermost one. Its label opens its first line; what is quoted inside a line is
    that line's text. Chapters and groups are headings by their titles.
    """
    rows = found.where(_nth("path", 1) == "Dokument").withColumns({"unit": _first(UNITS), "silent": _first(SILENT)})
    in_unit = F.col("unit").isNotNull() & (F.col("silent").isNull() | (F.col("unit") < F.col("silent")))
    child = rows.where(in_unit & (F.size("path") > F.col("unit"))).groupBy(
        key, _nth("nodes", F.col("unit")).alias("of"), _nth("nodes", F.col("unit") + 1).alias("part"), _nth("path", F.col("unit") + 1).alias("name")
    ).agg(_said().alias("said"))
    labels = child.where("name = 'Explicatus'").groupBy(key, "of").agg(F.min_by("said", "part").alias("label"))
    lines = child.where(F.col("name").isin(LINES)).withColumn("n", F.row_number().over(Window.partitionBy(key, "of").orderBy("part"))).join(labels, [key, "of"], "left")
    opens = (F.col("n") == 1) & F.col("label").isNotNull()
    text = F.when(opens, F.trim(F.concat_ws(" ", "label", "said"))).otherwise(F.col("said"))
    ref = F.when(opens, F.nullif(F.trim(F.rtrim(F.col("label"), F.lit("."))), F.lit("")))
    sections = lines.select(key, F.col("of").alias("at"), "part", text.alias("text"), F.lit(None).cast("int").alias("level"), ref.alias("ref"))
    above = _nth("path", F.col("silent") - 1)
    title = F.coalesce(*[F.when((above == n) & _nth("path", F.col("silent")).isin(t), k) for n, (k, t) in TITLES.items()])
    titles = rows.where(F.col("silent").isNotNull() & (F.col("silent") > 1) & (F.col("unit").isNull() | (F.col("unit") > F.col("silent"))))
    titles = titles.withColumn("level", title).where("level is not null")
    titles = titles.groupBy(key, _nth("nodes", F.col("silent") - 1).alias("at"), "level").agg(_said().alias("text")).where("text <> ''")
    return sections.unionByName(titles.select(key, "at", F.col("at").alias("part"), "text", F.col("level").cast("int").alias("level"), F.lit(None).cast("string").alias("ref")))


#: Root elements that are read here.
DIALECTS = {"response": dated_blocks, "Dokument": numbered_units}


def root_name(body: str) -> Column:
    """The local name of a body's first element."""
    return F.regexp_extract(body, r"(?s)\A\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)


def blocks(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """The key and the blocks (as sources.markup gives them) of bodies with such roots; one that can't be read gives a row without text."""
    found = events(bodies, key, body)
    read = None
    for rules in DIALECTS.values():
        one = rules(found.where("error is null"), key).select(key, *BLOCKS)
        read = one if read is None else read.unionByName(one)
    order = F.row_number().over(Window.partitionBy(key).orderBy("at", "part")) - 1
    numbered = read.select(key, order.alias("ord"), "text", "level", "ref")
    known = found.where((_nth("path", 1) == "Dokument") | (F.slice("path", 1, 3) == F.array(*map(F.lit, ("response", "data", "texto"))))).select(key).distinct()
    failed = bodies.select(key).distinct().join(known, key, "left_anti").select(key, F.lit(0).alias("ord"), *[F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("level", "int"), ("ref", "string"))])
    return numbered.unionByName(failed).select("*", F.lit(None).cast("int").alias("page"), F.lit(False).alias("quoted"))
