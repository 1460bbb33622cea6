"""Versioned snapshots of a knowledge base: a folder of tables, their digests and a manifest.

A digest of a table doesn't depend on row order or partitioning, so equal content is never published twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
DERIVED = frozenset(("postings", "vectors"))


def digest(df: DataFrame) -> str:
    """Two exclusive-ors and a count of row hashes, as text; independent of order, and one pass."""
    columns = sorted(df.columns)
    row = F.to_json(F.struct(*columns))
    hashed = df.select(F.xxhash64(F.lit(1), row).alias("a"), F.xxhash64(row, F.lit(2)).alias("b"))
    # equal rows cancel in an exclusive-or; sums of halves don't
    half = lambda c: F.sum((F.col(c).bitwiseAND(0xFFFFFFFF)).cast("decimal(38,0)"))
    r = hashed.agg(F.count("*"), F.bit_xor("a"), half("a"), half("b")).first()
    return f"{r[0]}-{(r[1] or 0) & (1 << 64) - 1:016x}-{r[2] or 0}-{r[3] or 0}"


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, name: str, known: dict | None = None) -> dict:
    """Write the tables that aren't derived below path/name/version and return the manifest.

    known is the manifest before this one; nothing is written if all digests are the same.
    """
    kept = {n: df for n, df in tables.items() if n not in DERIVED}
    content = {n: digest(df) for n, df in kept.items()}
    if known and known["content"] == content:
        return known
    version = (known["version"] if known else 0) + 1
    for n, df in kept.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/{version}/{n}")
    manifest = {"format": FORMAT, "name": name, "version": version, "content": content}
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
    line.write.mode("overwrite").text(f"{path}/{name}/{version}/manifest")
    return manifest


def problems(manifest: dict, name: str) -> list[str]:
    """What is wrong with a manifest; empty if nothing is."""
    out = []
    if manifest.get("format") != FORMAT:
        out.append("the format is unknown")
    if manifest.get("name") != name:
        out.append("the name is another one")
    if not isinstance(manifest.get("version"), int) or manifest["version"] < 1:
        out.append("the version is no positive number")
    if not isinstance(manifest.get("content"), dict) or not manifest["content"]:
        out.append("the tables are missing")
    return out


def pull(spark: SparkSession, path: str, name: str, version: int) -> dict[str, DataFrame]:
    """The tables of a version; ValueError if the manifest or any table's digest is wrong."""
    base = f"{path}/{name}/{version}"
    manifest = json.loads(spark.read.text(f"{base}/manifest").first()[0])
    if found := problems(manifest, name):
        raise ValueError("; ".join(found))
    tables = {n: spark.read.parquet(f"{base}/{n}") for n in manifest["content"]}
    wrong = [n for n, df in tables.items() if digest(df) != manifest["content"][n]]
    if wrong:
        raise ValueError(f"digests differ: {', '.join(sorted(wrong))}")
    return tables


def keep_derived(new: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """A derived table with the rows of the previous one that it doesn't have."""
    return new.unionByName(previous.join(new.select(*key), key, "left_anti"))
