"""Two builds of one registry compared section by section: what a second reading of the same texts says.

Sections meet by document, reference and the text's digest; of a base's equal sections the last one counts. Only
sections that the rerun has read are compared. Quotes and topics are compared as sets, modalities with repeats, and
summaries by the mean best match of their vectors both ways, in tiles (audit.best_match), so that no pair is a row.
Where both sides say nothing they agree wholly; a side without a vector for each of its statements agrees in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit
from lectern.session import materialize

PLACE = ["document", "ref", "sha256"]
_NONE = "array<string>"


def met_sections(base: DataFrame, rerun: DataFrame, read: DataFrame) -> DataFrame:
    """document, ref, section (the rerun's chunk), base_chunk. Sides: document, ref, sha256, chunk_id, ord; read: chunk_id."""
    last = base.groupBy(*PLACE).agg(F.max_by("chunk_id", "ord").alias("base_chunk"))
    mine = rerun.join(read.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return mine.join(last, PLACE).select("document", "ref", F.col("chunk_id").alias("section"), "base_chunk")


def extraction(met: DataFrame, base: DataFrame, rerun: DataFrame) -> DataFrame:
    """A row a section: document, ref, section, n_base, n_rerun, quotes, topics, modalities, summary, equal, close.

    Statements: chunk_id, id, quote, modality, topics (array), v (the summary's vector or null).
    """
    met = materialize(met, "met")

    def side(rows: DataFrame, chunk: str, name: str) -> DataFrame:
        """A statement row for each section that it belongs to; base chunks may belong to several."""
        return materialize(met.select("section", F.col(chunk).alias("chunk_id")).join(rows, "chunk_id").drop("chunk_id"), name)

    a, b = side(base, "base_chunk", "base-said"), side(rerun, "section", "rerun-said")

    def told(rows: DataFrame, s: str) -> DataFrame:
        return rows.groupBy("section").agg(
            F.count("*").alias(f"n_{s}"), F.collect_set("quote").alias(f"quotes_{s}"), F.array_distinct(F.flatten(F.collect_set("topics"))).alias(f"topics_{s}"),
            F.count_if(F.col("v").isNull()).alias(f"bare_{s}"),
        )

    def overlap(name: str) -> Column:
        none = F.array().cast(_NONE)
        return T.jaccard(F.coalesce(f"{name}_base", none), F.coalesce(f"{name}_rerun", none))

    again = audit.modality_agreement(a, b, "section", "modality").withColumnRenamed("agreement", "modalities")
    summary = audit.best_match(a, b, "section").withColumnRenamed("similarity", "summary")
    rows = met.join(told(a, "base"), "section", "left").join(told(b, "rerun"), "section", "left").join(again, "section", "left").join(summary, "section", "left")
    n, m = F.coalesce("n_base", F.lit(0)), F.coalesce("n_rerun", F.lit(0))
    whole = (F.coalesce("bare_base", F.lit(0)) == 0) & (F.coalesce("bare_rerun", F.lit(0)) == 0)
    alike = F.when((n == 0) & (m == 0), 1.0).when(whole, F.coalesce("summary", F.lit(0.0))).otherwise(0.0)
    return rows.select(
        "document", "ref", "section", n.cast("long").alias("n_base"), m.cast("long").alias("n_rerun"), overlap("quotes").alias("quotes"), overlap("topics").alias("topics"),
        F.coalesce("modalities", F.lit(1.0)).alias("modalities"), alike.alias("summary"), (n == m).alias("equal"), audit.close_counts(n, m).alias("close"),
    )


def report(rows: DataFrame) -> DataFrame:
    """One row over all sections: counts, means and the median of the quotes' overlap."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.agg(
        F.count("*").alias("sections"), F.sum("n_base").alias("statements_base"), F.sum("n_rerun").alias("statements_rerun"), share("equal").alias("share_equal"), share("close").alias("share_close"),
        share("quotes").alias("mean_quotes"), F.percentile("quotes", F.lit(0.5)).alias("median_quotes"), share("topics").alias("mean_topics"), share("modalities").alias("mean_modalities"), share("summary").alias("mean_summary"),
    )


def worst(rows: DataFrame, n: int) -> DataFrame:
    """A report of the n sections whose summaries, then quotes, agree least."""
    return rows.orderBy("summary", "quotes", "document", "ref", "section").limit(n)


def worst_documents(rows: DataFrame, n: int = 15, least: int = 3) -> DataFrame:
    """A report of the n documents with `least` sections or more whose summaries agree least on average."""
    means = rows.groupBy("document").agg(F.avg("summary").alias("mean_summary"), F.count("*").alias("sections")).where(F.col("sections") >= least)
    return means.orderBy(F.round("mean_summary", 12), "document").limit(n)
