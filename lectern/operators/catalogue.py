"""A catalogue of published snapshots: numbers claimed without a lock, listings and states as tables.

A publisher claims the next version of a name by creating its claim file, which succeeds for one of any number of
publishers, and writes tables and then the manifest below that number. What has no manifest isn't published, so a publisher
that is lost leaves a gap in the numbers and nothing else. Manifests are JSON lines that Spark reads as a table; the state
of a local copy compares digests table by table. Only tables and files of known names are published or restored.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import snapshot

#: What a snapshot may hold: tables of the data model, and configuration below these names.
TABLES = frozenset("documents versions chunks statements topics scopes availability reviews memo".split())
FILES, FOLDERS = frozenset(("domain.yaml", "sources.yaml", "scopes.yaml")), frozenset(("eval", "prompts"))
NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
MANIFEST = "format int, name string, version int, content map<string,string>, counts map<string,long>, files map<string,string>, title string, private boolean, published_at string"


def path_problem(path: str) -> str | None:
    """Why a file of a snapshot may not be written below a home folder; null if it may."""
    parts = path.split("/")
    if path.startswith("/") or "\\" in path or ".." in parts or "" in parts or "." in parts:
        return f"{path!r} leads out of the folder"
    if path in FILES or len(parts) > 1 and parts[0] in FOLDERS:
        return None
    return f"{path!r} is no file of a knowledge base"


def _claimed(spark: SparkSession, folder: str, version: int) -> bool:
    """Whether this call created the claim of a version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/claims/{version:09d}")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(at.getParent())
    return fs.createNewFile(at)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, name: str, title: str | None = None, private: bool = False, files: dict[str, str] | None = None, at: str | None = None) -> dict:
    """Publishes as the next version, unless tables, files, title and visibility are those of the last one."""
    files = files or {}
    wrong = [f"{t!r} is no table of a knowledge base" for t in sorted(set(tables) - TABLES - snapshot.DERIVED)]
    wrong += [p for p in map(path_problem, sorted(files)) if p] + ([] if NAME.fullmatch(name) else [f"{name!r} is no name"])
    if wrong:
        raise ValueError("; ".join(wrong))
    kept = {t: df for t, df in tables.items() if t in TABLES}
    content = {t: snapshot.digest(df) for t, df in kept.items()}
    shown = None if private else title
    last = latest(manifests(spark, path)).where(F.col("name") == name).first()
    if last and (last.content, last.files or {}, last.title, last.private) == (content, files, shown, private):
        return json.loads(last.line)
    version = (last.version if last else 0) + 1
    while not _claimed(spark, f"{path}/{name}", version):
        version += 1
    base = f"{path}/{name}/{version}"
    for t, df in kept.items():
        df.write.option("compression", "zstd").parquet(f"{base}/{t}")
    counts = {t: int(digest.split("-", 1)[0]) for t, digest in content.items()}
    manifest = {"format": snapshot.FORMAT, "name": name, "version": version, "content": content, "counts": counts, "files": files, "title": shown, "private": private, "published_at": at}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{base}/manifest")
    return manifest


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All published manifests with `line`, their text, and `problem` where one can't be used."""
    try:
        lines = spark.read.text(f"{path}/*/*/manifest").select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    except AnalysisException:
        return spark.createDataFrame([], f"folder string, {MANIFEST}, line string, problem string")
    m = F.from_json("line", MANIFEST)
    folder = F.regexp_extract("file", r"([^/]+)/[0-9]+/manifest/[^/]*$", 1)
    problem = (
        F.when(~m["format"].eqNullSafe(F.lit(snapshot.FORMAT)), "the format is unknown").when(~m["name"].eqNullSafe(folder), "the name is another one")
        .when(~F.coalesce(m["version"] > 0, F.lit(False)), "the version is no positive number").when(~F.coalesce(F.size(m["content"]) > 0, F.lit(False)), "the tables are missing")
    )
    return lines.select(folder.alias("folder"), m.alias("m"), "line", problem.alias("problem")).select("folder", "m.*", "line", "problem")


def latest(rows: DataFrame) -> DataFrame:
    """The last usable version of each name."""
    order = Window.partitionBy("name").orderBy(F.desc("version"))
    return rows.where("problem is null").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def listing(rows: DataFrame, local: DataFrame) -> DataFrame:
    """One row a knowledge base: name, version, title, tables, n_rows, local, outdated, problem. local: name, version (null: built here).

    A name of which no manifest can be used is listed with what is wrong.
    """
    here = local.select(F.col("name").alias("folder"), F.coalesce(F.concat(F.lit("v"), F.col("version").cast("string")), F.lit("built here")).alias("local"))
    good = latest(rows)
    broken = rows.where("problem is not null").join(good.select("folder"), "folder", "left_anti").groupBy("folder").agg(F.min("problem").alias("problem"))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, n: s + n)
    shown = good.select("folder", "version", F.coalesce("title", F.lit("(private)")).alias("title"), F.size("content").alias("tables"), total.alias("n_rows"), F.lit(None).cast("string").alias("problem"))
    out = shown.unionByName(broken, allowMissingColumns=True).join(here, "folder", "left")
    behind = F.startswith("local", F.lit("v")) & (F.col("local") != F.concat(F.lit("v"), F.col("version").cast("string")))
    return out.select(F.col("folder").alias("name"), "version", "title", "tables", "n_rows", F.coalesce("local", F.lit("not installed")).alias("local"), F.coalesce(behind, F.lit(False)).alias("outdated"), "problem")


def state(spark: SparkSession, tables: dict[str, DataFrame], manifest: dict) -> DataFrame:
    """name, state of each table: same, changed here, new here, missing here; against a published manifest."""
    here = {t: snapshot.digest(df) for t, df in tables.items() if t in TABLES}
    there = manifest["content"]
    told = [(t, "missing here" if t not in here else "new here" if t not in there else "same" if here[t] == there[t] else "changed here") for t in sorted({*here, *there})]
    return spark.createDataFrame(told, "name string, state string")  # a row a table of the data model


def summary(states: DataFrame, version: int) -> str:
    changed = states.where("state <> 'same'").isEmpty()
    return f"matches v{version}" if changed else "unpublished changes"
