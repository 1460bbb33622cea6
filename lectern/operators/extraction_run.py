"""One extraction run: sections to messages, messages to a model unless it has answered them, answers to statements.

The memo is a folder of answers by (message, prompt version, model). A run asks for what the memo lacks, BATCH messages
at a time (more where that would be over BATCHES batches), and each batch is a partition of the memo that Spark commits
as a whole; a run that ends in the middle has committed the batches before, and the next run asks only for the rest.
What is asked for is written once, dealt to a folder a batch, so that a batch reads its own messages and no others. Failures are no answers: they are tried again
by the next run. Answers are validated anew on every run, so that rules may change without a call. Equal messages are
asked once, also within a batch; an answer that is there twice (from two runs at a time) is one, the least.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import extraction
from lectern.session import materialize

#: Messages whose answers are committed together, batches of a run at most (Spark jobs, one after the other), files of a batch.
BATCH, BATCHES, PARTS = 10_000, 64, 32
KEY = ["message_sha256", "prompt_version", "model"]
MEMO = "message_sha256 string, prompt_version string, model string, output string"


def memo(spark: SparkSession, path: str) -> DataFrame:
    """All answers; none where the folder isn't there yet."""
    try:
        rows = spark.read.schema(MEMO).parquet(path)
    except AnalysisException:
        return _none(spark, [*KEY, "output"])
    return rows.groupBy(*KEY).agg(F.min("output").alias("output"))


def _none(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in columns])


def ask(messages: DataFrame, path: str, call: Callable[[str, str], str], system: str, version: str, model: str, attempts: int = 2) -> DataFrame:
    """message_sha256, error of the messages (message_sha256, message) that failed; answers are in the memo afterwards."""
    spark = messages.sparkSession
    known = memo(spark, path).where((F.col("prompt_version") == version) & (F.col("model") == model)).select("message_sha256")
    asked = messages.select("message_sha256", "message")
    if not known.isEmpty():
        asked = asked.join(known, "message_sha256", "left_anti")
    batches = min(-(-asked.select("message_sha256").distinct().count() // BATCH), BATCHES)
    failed = _none(spark, ["message_sha256", "error"])
    if not batches:
        return failed
    part = F.pmod(F.xxhash64("message_sha256"), F.lit(batches * PARTS)).cast("int")
    dealt = asked.withColumn("part", part).repartition("part").dropDuplicates(["part", "message_sha256"])
    misses = materialize(dealt.select("message_sha256", "message", (F.col("part") % batches).alias("batch")), "misses", by="batch")
    for k in range(batches):  # each a Spark job over its own folder
        told = materialize(extraction.call_model(misses.where(F.col("batch") == k), call, system, attempts, unique=True), "answers")
        answers = told.where("error is null").select("message_sha256", F.lit(version).alias("prompt_version"), F.lit(model).alias("model"), "output")
        answers.write.parquet(f"{path}/batch={uuid.uuid4().hex}")
        failed = failed.unionByName(told.where("error is not null").select("message_sha256", "error"))
    return failed


def run(
    sections: DataFrame, path: str, call: Callable[[str, str], str], system: str, version: str, model: str, modalities: list[str], topics: list[str], tags: Column,
    skip: str | None = None, matching: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """sections: section, ref, text, message. Returns their outcomes and the records that are kept.

    Outcomes: section, why, cached, error, n_kept, n_rejected, outcome. Records: section, n, quote, summary, modality, topics,
    applies_to, effective_from. `tags` are what a section's statements may apply to.
    """
    rows = sections.withColumns({"why": extraction.eligibility("ref", "text", skip, matching), "message_sha256": T.sha("message"), "tags": tags})
    rows = materialize(rows, "sections")
    read = rows.where("why is null")
    spark = sections.sparkSession
    before = memo(spark, path).where((F.col("prompt_version") == version) & (F.col("model") == model)).select("message_sha256", F.lit(True).alias("cached"))
    before = materialize(before, "cached")
    failed = ask(read, path, call, system, version, model)
    answers = memo(spark, path).where((F.col("prompt_version") == version) & (F.col("model") == model)).select("message_sha256", "output")
    said = read.join(answers, "message_sha256").select("section", "text", "tags", "output")
    parsed = extraction.records(said, text="text")
    r = F.col("record")
    reason = extraction.reject_reason(
        r["verbatim_quote"], F.col("comparable"), r["summary"], r["modality"], r["topics"], r["applies_to"], r["effective_from"], modalities, topics, F.col("tags"), F.col("text")
    )
    reason = F.when(F.col("bad_output"), "output can't be read").otherwise(reason).alias("reason")
    judged = materialize(parsed.where("record is not null or bad_output").select("section", "n", "record", reason), "judged")
    counts = judged.groupBy("section").agg(F.count_if(F.col("reason").isNull()).alias("n_kept"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
    out = rows.select("section", "why", "message_sha256").join(before, "message_sha256", "left").join(failed, "message_sha256", "left").join(counts, "section", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_kept", "n_rejected")}
    out = out.withColumns({**zero, "cached": F.coalesce("cached", F.lit(False)) & F.col("why").isNull(), "error": F.when(F.col("why").isNull(), F.col("error"))})
    out = extraction.outcomes(out, F.col("n_kept"), F.col("n_rejected")).select("section", "why", "cached", "error", "n_kept", "n_rejected", "outcome")
    kept = judged.where("reason is null").select("section", "n", F.col("record.verbatim_quote").alias("quote"), *[f"record.{c}" for c in ("summary", "modality", "topics", "applies_to", "effective_from")])
    return out, kept


def report(outcomes: DataFrame) -> DataFrame:
    """One row: sections, read, cached, called, failed, statements, rejected."""
    asked = F.col("why").isNull()
    return outcomes.agg(
        F.count("*").alias("sections"), F.count_if(asked).alias("read"), F.count_if("cached").alias("cached"), F.count_if(asked & ~F.col("cached")).alias("called"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("n_kept").alias("statements"), F.sum("n_rejected").alias("rejected"),
    )
