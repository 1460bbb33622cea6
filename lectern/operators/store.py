"""What a rebuild may change: sections are replaced whole or not at all, statements follow their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section_actions(old: DataFrame, new: DataFrame, cited: DataFrame, version: str = "version_id", order: str = "ord", same: tuple = ("section_ref", "sha256"), chunk: str = "chunk_id") -> DataFrame:
    """version, action of every version that is stored or comes: kept, new, replaced or refused.

    The lists are compared place by place by two 64-bit hashes of what has to be the same, and all rows of a version meet
    in one shuffle of numbers. A version whose list differs is refused if statements cite one of its stored sections
    (cited: chunk ids): what is cited never changes.
    """
    told = [c for s in same for c in (F.isnull(s), F.col(s))]
    hashes = [F.xxhash64(*told).alias("h1"), F.xxhash64(F.lit("two"), *told).alias("h2")]

    def side(was: int, now: int) -> list:
        return [F.lit(was).alias("was"), F.lit(now).alias("now"), F.lit(False).alias("_cited")]

    stated = old.select(chunk, version).join(cited.select(chunk), chunk, "left_semi").select(version).distinct()
    marks = stated.select(version, F.lit(None).cast(old.schema[order].dataType).alias(order), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).alias("was"), F.lit(0).alias("now"), F.lit(True).alias("_cited"))
    rows = old.select(version, order, *hashes, *side(1, 0)).unionByName(new.select(version, order, *hashes, *side(0, 1))).unionByName(marks)
    places = rows.repartition(F.col(version)).groupBy(version, order, "_cited").agg(
        *[f(h).alias(f"{n}_{h}") for h in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))], F.max("was").alias("was"), F.max("now").alias("now")
    )
    alike = (F.col("least_h1") == F.col("most_h1")) & (F.col("least_h2") == F.col("most_h2")) & (F.col("was") == 1) & (F.col("now") == 1)
    alike = alike & F.col(version).isNotNull() & F.col(order).isNotNull()  # a place without a number is like no other
    sums = places.groupBy(version).agg(
        F.max(~alike & ~F.col("_cited")).alias("differs"), F.max("was").alias("was"), F.max("now").alias("now"), F.max("_cited").alias("is_cited")
    )
    action = F.when(~F.col("differs") | (F.col("now") == 0), "kept").when(F.col("was") == 0, "new").when(F.col("is_cited"), "refused").otherwise("replaced")
    return sums.select(version, action.alias("action"))


def replace_sections(old: DataFrame, new: DataFrame, actions: DataFrame, version: str = "version_id") -> DataFrame:
    """The stored sections after the actions: new rows of new and replaced versions, old rows of all others."""
    coming = actions.where(F.col("action").isin("new", "replaced")).select(version)
    return old.join(coming, version, "left_anti").unionByName(new.join(coming, version, "left_semi"))


def dropped_vectors(vectors: DataFrame, old: DataFrame, actions: DataFrame, version: str = "version_id", chunk: str = "chunk_id") -> DataFrame:
    """The vectors that stay when the sections of replaced versions go."""
    gone = old.join(actions.where("action = 'replaced'").select(version), version, "left_semi").select(chunk)
    return vectors.join(gone, chunk, "left_anti")


def replace_statements(old: DataFrame, new: DataFrame, done: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """The stored statements after the sections of `done` were read anew: theirs go, the new ones come.

    A section that was read and gave nothing ends without statements; one that wasn't keeps what it has.
    """
    read = done.select(chunk).distinct()
    return old.join(read, chunk, "left_anti").unionByName(new.join(read, chunk, "left_semi"))
