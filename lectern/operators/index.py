"""Stored tables that are derived from a table of texts key by key, and follow its changes without being built anew.

A `Store` keeps segments. One holds what was derived from the rows of its keys, and what each key's rows were (a
digest). An update compares the digests of the rows as they are now with those of all segments: keys with a digest
that no segment holds are derived into a new segment, and each segment gets the list of its keys that are not as they
were, its dead. Reading is the union of the segments, each without its dead. A row that comes back as it once was is
alive again where it lies. When the dead and the later segments hold more than SHARE of all keys, or there are more
than MOST segments, what is alive is copied into one segment; nothing is derived for that.

Every version of a store is a partition of its manifest and names finished tables only, so a writer that is lost
leaves the version before. Rows without a key are no part of a store. Rows that share a key are one entry, whose
digest doesn't depend on their order.

`Index` is two stores of texts, of words (a row a document: its terms and their counts) and of vectors; each follows its source when it is read.
`of` keeps the session's indexes by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.session import arrow_rows, materialize, scratch, shared_dir

SHARE, MOST = 0.25, 8
#: Texts of an Arrow batch.
BATCH_ROWS = 512
ENTRY = "segment string, keys long, dead long, dead_at string"


def stamp(rows: DataFrame, key: str, *columns: str) -> tuple:
    """Changes with every row that is added, removed or altered; one pass, no order."""
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, *columns)).alias("x"), F.sum(F.xxhash64(key, *columns).cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.x, r.s


def digests(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, digest: of all rows of a key, whatever their order; combines before the shuffle."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("two"), *columns)
    total = F.sum(F.pmod(one, F.lit(1 << 31)))  # tells how often a row repeats
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), total.alias("t"))
    return found.select(key, F.concat_ws(":", "n", "x", "y", "t").alias("digest"))


@dataclass
class Segment:
    name: str
    keys: int
    dead: int = 0
    dead_at: str | None = None


@dataclass
class Store:
    """make(rows) gives the derived tables by name, each with the key; columns tell a change of a row."""

    spark: SparkSession
    path: str
    key: str
    columns: list[str]
    make: Callable[[DataFrame], dict[str, DataFrame]]
    version: int = 0
    segments: list[Segment] = field(default_factory=list)

    def __post_init__(self) -> None:
        try:
            held = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return
        self.version = held.agg(F.max("version")).first()[0]
        rows = held.where(F.col("version") == self.version).orderBy("segment").collect()  # MOST + 1 at most
        self.segments = [Segment(r.segment, r.keys, r.dead, r.dead_at) for r in rows if r.segment]

    def there(self) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return False
        return True

    def _read(self, segment: Segment, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{segment.name}/{name}")
        return rows.join(self.spark.read.parquet(segment.dead_at), self.key, "left_anti") if segment.dead else rows

    def table(self, name: str) -> DataFrame:
        """What is alive of a derived table (or of "known": key, digest)."""
        if not self.segments:
            raise ValueError("the store is empty; update it first")
        out = self._read(self.segments[0], name)
        for s in self.segments[1:]:
            out = out.unionByName(self._read(s, name))
        return out

    def update(self, rows: DataFrame) -> dict[str, int]:
        """Follows rows; counts the keys that are new, changed, gone and same, and those that were derived."""
        rows = rows.where(F.col(self.key).isNotNull())
        with scratch(self.spark):
            now = materialize(digests(rows, self.key, *self.columns), "now")
            counts = {"new": 0, "changed": 0, "gone": 0, "same": 0}
            fresh = now
            if self.segments:
                before = self.table("known").withColumnRenamed("digest", "before")
                action = F.when(F.col("before").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("before") == F.col("digest"), "same").otherwise("changed")
                counts |= {r.action: r["count"] for r in before.join(now, self.key, "full_outer").groupBy(action.alias("action")).count().collect()}
                held = [self.spark.read.parquet(f"{self.path}/{s.name}/known") for s in self.segments]
                for known in held:
                    fresh = fresh.join(known, [self.key, "digest"], "left_anti")
                fresh = materialize(fresh, "fresh")
            n = fresh.count()
            counts["derived"] = n
            if not self.segments:
                counts["new"] = n
            elif not (counts["new"] or counts["changed"] or counts["gone"]):
                return counts
            segments = [self._dying(s, known, now) for s, known in zip(self.segments, held)] if self.segments else []
            if n or not segments:
                segments.append(self._written(self.make(rows.join(fresh, self.key, "left_semi") if segments else rows), fresh, n))
            self._commit(segments)
        total = sum(s.keys for s in self.segments)
        if len(self.segments) > MOST or sum(s.dead for s in self.segments) + sum(s.keys for s in self.segments[1:]) > SHARE * total:
            self.compact()
        return counts

    def _dying(self, s: Segment, known: DataFrame, now: DataFrame) -> Segment:
        dead_at = f"{self.path}/dead-{uuid.uuid4().hex}"
        known.join(now, [self.key, "digest"], "left_anti").select(self.key).write.parquet(dead_at)
        return Segment(s.name, s.keys, self.spark.read.parquet(dead_at).count(), dead_at)

    def _written(self, tables: dict[str, DataFrame], known: DataFrame, keys: int) -> Segment:
        name = f"segment-{self.version:09d}-{uuid.uuid4().hex}"
        for table, df in {**tables, "known": known}.items():
            df.write.parquet(f"{self.path}/{name}/{table}")
        return Segment(name, keys)

    def _commit(self, segments: list[Segment]) -> None:
        self.version, self.segments = self.version + 1, segments
        rows = [(s.name, s.keys, s.dead, s.dead_at) for s in segments] or [(None, 0, 0, None)]
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")

    def compact(self) -> None:
        """One segment of all that is alive."""
        if len(self.segments) == 1 and not self.segments[0].dead:
            return
        names = [n for n in self.names() if n != "known"]
        self._commit([self._written({n: self.table(n) for n in names}, self.table("known"), sum(s.keys - s.dead for s in self.segments))])

    def names(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.segments[0].name}")
        found = fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(fs_path)
        return sorted(f.getPath().getName() for f in found)


Embed = Callable[[DataFrame, str, str], DataFrame]


@dataclass
class Index:
    """An index of rows: key, text, heading. Its parts are stores that are updated when they are first read after rows
    have changed, so that keywords don't wait for vectors. embed(rows, key, text) gives key and v: the model's place.
    """

    spark: SparkSession
    path: str
    key: str
    text: str
    heading: str | None = None
    embed: Embed = search.hash_vectors
    tells: tuple[str, ...] = ()
    rows: DataFrame | None = None
    stamp: tuple = ()
    alias: str | None = None
    updated: dict = field(default_factory=dict)
    stores: dict = field(default_factory=dict)

    def _words(self, rows: DataFrame) -> dict[str, DataFrame]:
        return {"counts": search.term_counts(rows, self.key, self.text, self.heading)}

    def _vectors(self, rows: DataFrame) -> dict[str, DataFrame]:
        return {"vectors": self.embed(rows, self.key, self.text)}

    def part(self, kind: str) -> Store:
        if kind not in self.stores:
            columns = list(self.tells or [c for c in (self.text, self.heading) if c])
            self.stores[kind] = Store(self.spark, f"{self.path}/{kind}", self.key, columns, {"words": self._words, "vectors": self._vectors}[kind])
        store = self.stores[kind]
        if self.rows is not None and self.updated.get(kind) != self.stamp:
            with arrow_rows(self.spark, BATCH_ROWS):
                self.followed = store.update(self.rows)
            self.updated[kind] = self.stamp
        return store

    def follow(self, rows: DataFrame) -> Index:
        """The index of these rows from now on; nothing is done before a part is read."""
        mark = stamp(rows, self.key, *(self.tells or [c for c in (self.text, self.heading) if c]))
        self.rows, self.stamp = rows, mark
        return self

    def _table(self, kind: str, name: str) -> DataFrame:
        out = self.part(kind).table(name)
        return out.withColumnRenamed(self.key, self.alias) if self.alias else out

    @property
    def counts(self) -> DataFrame:
        return self._table("words", "counts")

    @property
    def postings(self) -> DataFrame:
        return search.postings_from(self.counts, self.alias or self.key)

    @property
    def lengths(self) -> DataFrame:
        return search.lengths_from_counts(self.counts, self.alias or self.key)

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", "vectors")

    def there(self) -> bool:
        return all(s.there() for s in self.stores.values())

    def renamed(self, key: str, other: str) -> Index:
        """The same index, whose tables call the key by another name."""
        out = Index(**{f: getattr(self, f) for f in self.__dataclass_fields__})
        out.alias = other
        return out


_HELD: dict[tuple, Index] = {}


def of(spark: SparkSession, name: str, rows: DataFrame, key: str, text: str, heading: str | None = None, tells: tuple[str, ...] = (), embed: Embed = search.hash_vectors, model: object = None) -> Index:
    """The session's index of a source by name, which follows the rows; `tells` are columns that change with the texts.

    model: what embeds, where embed is made anew for each call; an index belongs to one model.
    """
    at = (spark.sparkContext.applicationId, name, key, text, heading, model or embed)
    if at not in _HELD or not _HELD[at].there():
        _HELD[at] = Index(spark, f"{shared_dir(spark)}/lectern/index-{uuid.uuid4().hex}", key, text, heading, embed, tells)
    held = _HELD[at]
    held.embed = embed
    return held.follow(rows)
