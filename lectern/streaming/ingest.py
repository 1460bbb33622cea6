"""Structured Streaming extensions: a landing folder as a stream, versions kept as state, sections written on.

The batch operators hold the rules; a stream only decides when they run. Event time is the observation's
stamp with an explicit watermark, which is an extension: the batch rules know no late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import fetching, sections, versions
from lectern.sources import markup


def observations(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Files of observations as they arrive, at most max_files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def version_stream(stream: DataFrame) -> DataFrame:
    """document, seq, sha, body, is_html in; a status for each observation out, with one state a document."""
    return versions.stream_machine(stream)


def check_counts(stream: DataFrame, at: str, by: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Observations by window and kind; rows later than the watermark are left out by Spark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def sections_sink(rules: sections.Rules, path: str):
    """A foreachBatch function that writes the sections of each micro-batch below its own number.

    A batch that is run again after a failure overwrites what it wrote, so every section is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        sections.split(batch, rules).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def landed_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Files saved below one folder a source, as they arrive, at most max_files a micro-batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)


#: What the rounds of a stream keep, each a folder with one part a micro-batch.
KEPT = {
    "versions": fetching.VERSIONS, "raw": "document_id string, sha256 string, content binary", "results": fetching.RESULTS,
    "sections": "version_id string, section_no int, section_ref string, heading_path array<string>, text string, error string",
}


def kept(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """One of KEPT, of all micro-batches or of those before a number; the others' files aren't read."""
    if before == 0:
        return spark.createDataFrame([], KEPT[name])
    rows = spark.read.schema(f"{KEPT[name]}, batch long").parquet(f"{path}/{name}")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def rounds_sink(sources: DataFrame, path: str, readings: dict[str | None, fetching.Reading] | None = None):
    """A foreachBatch function that makes a round of each micro-batch of landed files, from bodies to versions to sections.

    sources: source_id, and `reading` if readings are named. A round stands on the micro-batches before it alone and its clock
    is that of its newest file, so one that is run again after a failure writes the same once more, over what it had written.
    Path belongs to one stream with one checkpoint. A source with several files in a micro-batch fails in it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0] or ""
        files = fetching.saved(markup.landed(batch.select("path", "content")))
        here = sources.join(files.select("source_id").distinct(), "source_id", "left_semi")
        reading_of = sources.select("source_id", "reading") if "reading" in sources.columns else None
        found = fetching.observe(
            fetching.picked(here, files.limit(0), files), (files,), kept(spark, path, "versions", number), kept(spark, path, "raw", number), newest, readings, reading_of
        )
        to = lambda name: f"{path}/{name}/batch={number}"
        found.raw.write.mode("overwrite").parquet(to("raw"))
        added = spark.read.schema(KEPT["raw"]).parquet(to("raw"))
        kinds = found.seen.where("content_type is not null").select("document_id", "sha256", "content_type")
        bodies = added.join(kinds, ["document_id", "sha256"])
        named = bodies.withColumn("reading", F.lit(None).cast("string")) if reading_of is None else bodies.join(reading_of.withColumnRenamed("source_id", "document_id"), "document_id", "left")
        key = F.concat_ws("@", "document_id", F.substring("sha256", 1, 12))
        read = fetching.body_sections(named.select(key.alias("key"), "reading", "content_type", "content"), readings or {})
        read.withColumnRenamed("doc_id", "version_id").write.mode("overwrite").parquet(to("sections"))
        found.results.write.mode("overwrite").parquet(to("results"))
        found.seen.write.mode("overwrite").parquet(to("versions"))

    return write
