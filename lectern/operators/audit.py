"""Reports on a build: structure, agreement between builds, samples and retrieval quality."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import map_parts

GAP = 20
TINY = 80
NUMBERED = r"^(?:s\.|Article|Artigo|§|Section)? ?([0-9]+)[A-Za-z]?$"


def length_report(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Count, least, whole median and greatest length of texts."""
    n = F.length(text)
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min(n).alias("min_len"), F.floor(F.percentile(n, F.lit(0.5))).cast("long").alias("median_len"), F.max(n).alias("max_len")
    )


def number_gaps(numbers: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers missing between neighbours that are at most GAP apart."""
    step = F.col(number) - F.lag(number).over(Window.partitionBy(by).orderBy(number))
    rows = numbers.select(by, number).distinct().withColumn("step", step)
    return rows.groupBy(by).agg(F.sum(F.when((F.col("step") > 1) & (F.col("step") <= GAP), F.col("step") - 1).otherwise(0)).cast("long").alias("gaps"))


def ref_number(ref: str) -> Column:
    return F.regexp_extract(ref, NUMBERED, 1).try_cast("long")


def structure(chunks: DataFrame, by: str, ref: str, text: str) -> DataFrame:
    """One wide aggregation over the sections of each source."""
    base = F.regexp_replace(ref, r" \(part [0-9]+\)$", "")
    n = F.length(text)
    return chunks.groupBy(by).agg(
        F.count("*").alias("chunks"),
        F.sum(F.when(F.col(ref).startswith("(preamble)"), n).otherwise(0)).cast("long").alias("preamble_chars"),
        F.count_if(F.col(ref).rlike(r" \(part [0-9]+\)$")).alias("parts"),
        F.max(n).alias("max_len"),
        F.count_if(n < TINY).alias("tiny"),
        F.count_if(T.toc_like(text)).alias("toc_like"),
        (F.count("*") - F.count_distinct(base) + F.count_if(F.col(ref).rlike(r" \([0-9]+\)$"))).alias("dup_refs"),
    )


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either build with their state: same, differs, only_left, only_right."""
    a, b = left.select(key, F.col(value).alias("l"), F.lit(1).alias("in_l")), right.select(key, F.col(value).alias("r"), F.lit(1).alias("in_r"))
    state = F.when(F.col("in_r").isNull(), "only_left").when(F.col("in_l").isNull(), "only_right").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows of left have no partner in right, by value."""
    a = left.groupBy(*columns).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*columns).agg(F.count("*").alias("n_right"))
    surplus = F.col("n_left") - F.coalesce("n_right", F.lit(0))
    return a.join(b, columns, "left").withColumn("surplus", surplus).where("surplus > 0").select(*columns, "surplus")


#: Vectors of one side of a tile.
TILE = 1024


def best_match(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Mean best inner product in both directions between the vectors (id, v) of two sides that share a section.

    Each side of a section is dealt to blocks of TILE vectors; a tile of two blocks is one matrix product that gives the
    best of each row and of each column, and their maxima are merged. So pairs are never rows and a section
    may have any number of vectors. Tiles are read in order, many to an Arrow batch, so that small sections cost no call each. Vectors meet those
    of their own length only; null ones and null sections meet none.
    """
    def dealt(rows: DataFrame, other: DataFrame, mine: str, its: str) -> DataFrame:
        size = lambda r, name: r.groupBy(by, "dims").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
        held = rows.join(size(rows, "own"), [by, "dims"]).join(size(other, "others"), [by, "dims"])
        return held.withColumn(mine, F.pmod(F.xxhash64("id"), F.col("own")).cast("int")).withColumn(its, F.explode(F.sequence(F.lit(0), F.col("others") - 1)))

    place = [by, "dims", "i", "j"]

    def tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in itertools.chain(parts, [None]):
            frame = held if part is None else part if held is None else pd.concat([held, part], ignore_index=True)
            if frame is None:
                return
            new = np.zeros(len(frame), dtype=bool)
            for c in place:
                values = frame[c].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            ends = [0, *np.flatnonzero(new), *([len(frame)] if part is None else [])]  # the last tile may go on
            of_a, v, at, best = frame["of_a"].to_numpy(dtype=bool), frame["v"].to_numpy(), [], []
            for lo, hi in zip(ends, ends[1:]):
                mid = lo + np.count_nonzero(of_a[lo:hi])
                if lo < mid < hi:
                    cos = np.stack(v[lo:mid]).astype(float) @ np.stack(v[mid:hi]).astype(float).T
                    at.append(np.arange(lo, hi))
                    best += [cos.max(axis=1), cos.max(axis=0)]
            if at:
                yield frame.iloc[np.concatenate(at)][[by, "of_a", "id"]].assign(m=np.concatenate(best))
            held = frame.iloc[ends[-1] :].reset_index(drop=True)

    # both sides may come from one table, so each names its columns anew; an id is only told from others, so both go as strings
    sides = [r.select(*[F.col(c).alias(c) for c in (by, "id", "v")]).where(F.col(by).isNotNull() & F.col("v").isNotNull()).withColumn("dims", F.size("v")) for r in (left, right)]
    both = [dealt(sides[0], sides[1], "i", "j").withColumn("of_a", F.lit(True)), dealt(sides[1], sides[0], "j", "i").withColumn("of_a", F.lit(False))]
    columns = [*place, "of_a", F.col("id").cast("string").alias("id"), "v"]
    rows = both[0].select(*columns).unionByName(both[1].select(*columns)).repartition(*place).sortWithinPartitions(*place, F.desc("of_a"))
    met = map_parts(rows, tiles, f"{by} {left.schema[by].dataType.simpleString()}, of_a boolean, id string, m double", step=4 * TILE)
    best = met.where("id is not null").groupBy(by, "of_a", "id").agg(F.max("m").alias("m"))
    mean = lambda mine: F.avg(F.when(F.col("of_a") == mine, F.col("m")))
    return best.groupBy(by).agg(((mean(True) + mean(False)) / 2).alias("similarity"))


def modality_agreement(left: DataFrame, right: DataFrame, by: str, modality: str) -> DataFrame:
    """1 minus the share of left's modalities that right lacks, counted with repeats."""
    a = left.groupBy(by, modality).agg(F.count("*").alias("nb"))
    b = right.groupBy(by, modality).agg(F.count("*").alias("nr"))
    lost = F.sum(F.greatest(F.col("nb") - F.coalesce("nr", F.lit(0)), F.lit(0)))
    return a.join(b, [by, modality], "left").groupBy(by).agg((1 - lost / F.greatest(F.sum("nb"), F.lit(1))).alias("agreement"))


def close_counts(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1), F.bround(F.greatest(a, b) * 0.25).cast("int"))


def hash_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of each group with the smallest digests: a sample that stays when rows are added elsewhere."""
    digest = T.sha(F.col(key).cast("string"))
    order = Window.partitionBy(by).orderBy(digest, key)
    return rows.withColumn("sample_no", F.row_number().over(order)).where(F.col("sample_no") <= n)


def window_around(text: str, quote: str, reach: int = 1500) -> Column:
    """The text up to `reach` characters on either side of the quote's first place, else its start."""
    at = F.instr(text, F.col(quote)) if isinstance(quote, str) else F.instr(text, quote)
    begin = F.greatest(at - reach, F.lit(1))
    return F.substring(text, begin, (F.greatest(at, F.lit(1)) - begin + F.length(quote) + reach).cast("int"))


def hit_rate(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """results: query_id, rank, place (a row for every place of a result); expected: query_id, place.

    One row a question that has expectations: hit, first_rank (null without a hit).
    """
    hits = results.where(F.col("rank") <= k).join(expected, ["query_id", "place"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(hits, "query_id", "left").withColumn("hit", F.col("first_rank").isNotNull())


def glob_hits(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """results: query_id, rank, document, ref (a row for every place of a result); expected: query_id, source_glob, section_glob.

    A place is expected if its document matches the one glob and its reference the other or is a part of such a section.
    Places meet the globs of their own question, and of these only those whose literal starts are theirs. One row a
    question that has expectations: hit, first_rank (null without a hit).
    """
    wanted = expected.select("query_id", T.glob_head("source_glob").alias("d"), T.glob_pattern("source_glob").alias("d_re"), T.glob_head("section_glob").alias("s"), T.glob_pattern("section_glob").alias("s_re"), "section_glob")
    met = results.where(F.col("rank") <= k).join(wanted.distinct(), "query_id").where(F.startswith("document", "d") & F.startswith("ref", "s"))
    section = F.rlike("ref", F.col("s_re")) | F.startswith("ref", F.concat("section_glob", F.lit(" (part ")))
    first = met.where(F.rlike("document", F.col("d_re")) & section).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(first, "query_id", "left").withColumn("hit", F.col("first_rank").isNotNull())


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded order: the same for the same seed, another for another."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def source_signals(sources: DataFrame, versions: DataFrame, chunks: DataFrame, statements: DataFrame, key: str, prompt: str, as_of: str) -> DataFrame:
    """The signals of a source beside those of `structure`: versions, age in days of the last check, statements, sections
    without any, statements of another prompt version and statements on sections of earlier versions.

    versions: key, version_id, checked, is_current. chunks: key, chunk_id of current versions. statements: chunk_id, key,
    prompt_version, stale. All counts are zero where there is nothing.
    """
    seen = versions.groupBy(key).agg(F.count("*").alias("versions"), F.datediff(F.lit(as_of).cast("date"), F.max("checked").cast("date")).alias("age_days"))
    fresh = statements.where("not stale").select("chunk_id").distinct().withColumn("has", F.lit(1))
    bare = chunks.join(fresh, "chunk_id", "left").groupBy(key).agg(F.count_if(F.col("has").isNull()).alias("without_statements"))
    said = statements.groupBy(key).agg(
        F.count_if(~F.col("stale")).alias("statements"), F.count_if(~F.col("stale") & ~F.col("prompt_version").eqNullSafe(F.lit(prompt))).alias("old_prompt"), F.count_if("stale").alias("stale")
    )
    out = sources.join(seen, key, "left").join(bare, key, "left").join(said, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("versions", "without_statements", "statements", "old_prompt", "stale")})


def agreement(base: DataFrame, rerun: DataFrame, sections: DataFrame, section: str, topic: str, modality: str) -> DataFrame:
    """How two readings of the same sections agree: a row for each section that either has statements on.

    n_base, n_rerun, topics (Jaccard of the sets of topics), modalities (share of the base's that come again), equal and
    close (counts within max(1, a quarter)).
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(section).agg(F.count("*").alias(f"n_{name}"), F.sort_array(F.collect_set(topic)).alias(f"t_{name}"))

    met = side(base, "base").join(side(rerun, "rerun"), section, "full_outer").join(sections.select(section).distinct(), section, "left_semi")
    again = modality_agreement(base, rerun, section, modality).withColumnRenamed("agreement", "modalities")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("n_base", F.lit(0)), F.coalesce("n_rerun", F.lit(0))
    met = met.withColumns({"topics": T.jaccard(F.coalesce("t_base", none), F.coalesce("t_rerun", none)), "n_base": a, "n_rerun": b})
    met = met.join(again, section, "left").withColumn("modalities", F.coalesce("modalities", F.lit(1.0)))
    return met.select(section, "n_base", "n_rerun", "topics", "modalities", (F.col("n_base") == F.col("n_rerun")).alias("equal"), close_counts(F.col("n_base"), F.col("n_rerun")).alias("close"))


def agreement_summary(rows: DataFrame) -> DataFrame:
    """One row: sections, mean and median of topics, mean of modalities, shares of equal and close counts."""
    return rows.agg(
        F.count("*").alias("sections"), F.avg("topics").alias("mean_topics"), F.percentile("topics", F.lit(0.5)).alias("median_topics"), F.avg("modalities").alias("mean_modalities"),
        F.avg(F.col("equal").cast("double")).alias("share_equal"), F.avg(F.col("close").cast("double")).alias("share_close"),
    )


def worst(rows: DataFrame, section: str, n: int) -> DataFrame:
    """A report of the n sections that agree least."""
    return rows.orderBy("topics", "modalities", section).limit(n)
