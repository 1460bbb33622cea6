"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: str = "8", memory: str = "8g", app: str = "lectern") -> SparkSession:
    """A session for tests and single-node benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir of the session.

    Where the setting is missing a temporary folder is set on one machine (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = getattr(sc, "_lectern_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="lectern-")
            sc._lectern_dir = found
            sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; `by`, its last column, gives each value a folder of its own.

    This cuts lineage, and a lost executor costs only the tasks it ran: finished parts are files
    that all executors share. The written schema is given, so nothing is inferred.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*[by] if by else []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Folders of the scratch blocks that are open, the innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def _folder(spark: SparkSession) -> str:
    return _OPEN.get()[-1] if _OPEN.get() else f"{shared_dir(spark)}/lectern"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes in the block goes to one folder that is dropped at its end, also after an error."""
    path = f"{_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _OPEN.set((*_OPEN.get(), path))
    try:
        yield
    finally:
        _OPEN.reset(token)
        _delete(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """materialize() to the folder around the innermost scratch block, so that it outlives the block."""
    token = _OPEN.set(_OPEN.get()[:-1])
    try:
        return materialize(df, name)
    finally:
        _OPEN.reset(token)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() gave, once nothing reads them any more."""
    _delete(df.sparkSession, df._written)


#: Rows that map_parts() gives a function at a time.
PART_ROWS = 128


def map_parts(rows: DataFrame, read: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, step: int = PART_ROWS) -> DataFrame:
    """mapInPandas in small parts: of an Arrow batch only `step` rows at a time are Python objects."""
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in read(parts(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return rows.mapInArrow(run, schema)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run in the block gives Python workers Arrow batches of at most `most` rows, or fewer where the session has it so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
