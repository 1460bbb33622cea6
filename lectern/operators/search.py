"""Batch retrieval: keyword and vector rankings of many queries at once, fused and collapsed.

Every operator takes a table of queries and works on all of them in one plan; a single query is a batch of
one. Ties end in ids, so that every order is total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions import text as T
from lectern.operators.quotes import containing as containing  # searches use it beside rankings
from lectern.session import map_parts, materialize

#: Fixed values of the ranking.
B25_K1, B25_B = 1.2, 0.75
HEADING_WEIGHT, TEXT_WEIGHT = 2.0, 1.0
RRF_K = 10
CUT, KEPT = 1000, 200
WEIGHTS = {"section_keyword": 0.5, "statement_keyword": 0.5, "section_vector": 3.0, "statement_vector": 1.0}
DIMS = 64
#: Scores are summed in units of 1e-12.
FIXED = 1e12


def postings(docs: DataFrame, doc: str, text: str, heading: str | None = None) -> DataFrame:
    """term, doc, tf_heading, tf_text. One explode and one aggregation that combines before the shuffle."""
    parts = [docs.select(doc, F.explode(T.tokens(F.coalesce(text, F.lit("")))).alias("term"), F.lit(0).alias("in_heading"))]
    if heading:
        parts.append(docs.select(doc, F.explode(T.tokens(F.coalesce(heading, F.lit("")))).alias("term"), F.lit(1).alias("in_heading")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("term", doc).agg(F.sum("in_heading").alias("tf_heading"), F.sum(1 - F.col("in_heading")).alias("tf_text"))


#: Documents whose words are Arrow arrays at a time.
DOCS = 256


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether a key stands in several rows; reads the keys alone."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def _per_document(rows: DataFrame, read: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """read gives the columns of `schema` from a few documents at a time."""
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in read(batch.slice(lo, DOCS))], schema=out)

    return rows.mapInArrow(run, schema)


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the number of each string of lists, and the distinct strings by number."""
    found = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def term_counts(docs: DataFrame, doc: str, text: str, heading: str | None = None) -> DataFrame:
    """doc, terms, in_heading, in_text: the distinct terms of each document and how often they stand in either.

    Documents stay where they are read; only where several rows share a key are words shuffled to count them.
    """
    if repeats(docs, doc):
        held = postings(docs, doc, text, heading).groupBy(doc).agg(F.collect_list(F.struct("term", "tf_heading", "tf_text")).alias("x"))
        lists = [F.coalesce(F.col(f"x.{c}").cast(kind), F.array().cast(kind)).alias(name) for c, kind, name in (("term", "array<string>", "terms"), ("tf_heading", "array<int>", "in_heading"), ("tf_text", "array<int>", "in_text"))]
        return docs.select(doc).distinct().join(held, doc, "left").select(doc, *lists)

    def read(batch: pa.RecordBatch) -> list:
        both = batch.column(1)
        row, word, names = _numbered(both)
        sizes, ahead = both.value_lengths().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        in_heading = np.arange(len(row)) - first[row] < ahead[row]
        width = max(len(names), 1)
        found, at = np.unique(row * width + word, return_inverse=True)
        heads, all_of = np.bincount(at, in_heading, len(found)).astype(np.int32), np.bincount(at, minlength=len(found)).astype(np.int32)
        ends = pa.array(np.searchsorted(found, np.arange(batch.num_rows + 1) * width).astype(np.int32))
        lists = [names.take(pa.array(found % width)), pa.array(heads), pa.array(all_of - heads)]
        return [batch.column(0), *[pa.ListArray.from_arrays(ends, x) for x in lists]]

    words = lambda c: T.tokens(F.coalesce(c, F.lit("")))
    rows = docs.select(doc, F.concat(words(heading), words(text)) if heading else words(text), F.size(words(heading)) if heading else F.lit(0))
    return _per_document(rows, read, f"{doc} {docs.schema[doc].dataType.simpleString()}, terms array<string>, in_heading array<int>, in_text array<int>")


def postings_from(counts: DataFrame, doc: str) -> DataFrame:
    """term, doc, tf_heading, tf_text as postings, from term_counts."""
    rows = counts.select(doc, F.explode(F.arrays_zip("terms", "in_heading", "in_text")).alias("x"))
    return rows.select(F.col("x.terms").alias("term"), doc, F.col("x.in_heading").cast("long").alias("tf_heading"), F.col("x.in_text").cast("long").alias("tf_text"))


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def lengths_from_counts(counts: DataFrame, doc: str) -> DataFrame:
    """doc, dl as lengths_of, from term_counts."""
    return counts.select(doc, (_total("in_heading") + _total("in_text")).alias("dl"))


def query_phrases(queries: DataFrame, dropped: Column | None = None) -> DataFrame:
    """query_id, phrase, term, is_prefix: the distinct terms of each query."""
    terms = queries.select("query_id", F.explode(T.query_terms("query", dropped)).alias("phrase"))
    return terms.withColumns({"term": T.fold("phrase"), "is_prefix": T.is_prefix_term(F.col("phrase"))})


def bm25(queries: DataFrame, posts: DataFrame, lengths: DataFrame, doc: str, dropped: Column | None = None) -> DataFrame:
    """query_id, doc, score (higher is better) for every document with a hit.

    The distinct query terms are first expanded over the distinct terms, the small side of a prefix join on the
    first four characters; what comes out joins the postings on equality. Each (phrase, doc) is weighed once,
    however many queries ask for the phrase, and meets the queries last. lengths: doc, dl (tokens, all columns).
    """
    phrases = query_phrases(queries, dropped)
    weighed = _weighed(phrases, posts, lengths, doc)
    scored = weighed.join(phrases.select("query_id", "phrase"), "phrase")
    # whole multiples of 1 / FIXED add up to the same sum in any order and combine before the shuffle
    return scored.groupBy("query_id", doc).agg((F.sum("units") / FIXED).alias("score"))


def _weighed(phrases: DataFrame, posts: DataFrame, lengths: DataFrame, doc: str) -> DataFrame:
    """phrase, doc, units: what a phrase adds to a document's score, in whole multiples of 1 / FIXED."""
    vocabulary = posts.select("term").distinct().withColumn("stem", F.substring("term", 1, 4))
    wanted = phrases.select("phrase", F.col("term").alias("wanted"), "is_prefix", F.substring("term", 1, 4).alias("stem")).distinct()
    fits = F.when(F.col("is_prefix"), F.col("term").startswith(F.col("wanted"))).otherwise(F.col("term") == F.col("wanted"))
    expanded = vocabulary.join(wanted, "stem").where(fits).select("phrase", "term")
    weighted = HEADING_WEIGHT * F.sum("tf_heading") + TEXT_WEIGHT * F.sum("tf_text")
    # read twice below; a frequent term's postings meet few expanded terms, so the join sends those to all or is split
    hits = materialize(posts.join(expanded, "term").groupBy("phrase", doc).agg(weighted.alias("tf")), "hits")
    spread = hits.groupBy("phrase").agg(F.count("*").alias("n_docs"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    spread = spread.join(F.broadcast(stats), F.lit(True)).withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf))  # stats is one row
    part = F.col("idf") * F.col("tf") * (B25_K1 + 1) / (F.col("tf") + B25_K1 * (1 - B25_B + B25_B * F.col("dl") / F.col("avgdl")))
    return hits.join(spread, "phrase").join(lengths, doc).select("phrase", doc, F.round(part * FIXED).cast("long").alias("units"))


#: Phrases of a query up to which sums of units are whole numbers that a double holds, and documents of a block.
PHRASES, BLOCK = 80, 512
#: Terms whose phrases a worker keeps, and the characters that a term has in common with what may begin it.
KNOWN, STEM = 250_000, 4


def bm25_topk(queries: DataFrame, posts: DataFrame, lengths: DataFrame, doc: str, cut: int, digits: int, dropped: Column | None = None) -> DataFrame:
    """query_id, doc, score, rank: the best `cut` of bm25 by the score rounded to `digits` places, then by doc.

    A document's phrases come together in a row, a block of documents meets all queries in one product, and a task gives at
    most `cut` rows a query, so pairs are never rows. Sums are of whole numbers and so don't depend on their order.
    Queries beyond QUERY_LIMIT, QUERY_NUMBERS or PHRASES are ranked from the rows of bm25.
    """
    phrases = materialize(query_phrases(queries, dropped).distinct(), "phrases")
    size = phrases.groupBy("query_id").count().agg(F.count("*").alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    terms = [r.phrase for r in phrases.select("phrase").distinct().orderBy("phrase").limit(QUERY_LIMIT + 1).collect()]
    if size.most > PHRASES or size.rows > QUERY_NUMBERS or len(terms) > QUERY_LIMIT or size.n * len(terms) > QUERY_NUMBERS:
        return ranked(bm25(queries, posts, lengths, doc, dropped).withColumn("score", F.round("score", digits)), doc, cut)
    asked = phrases.select("query_id", "phrase").toArrow()  # QUERY_NUMBERS at most
    number = {t: k for k, t in enumerate(terms)}
    ids = sorted(set(asked["query_id"].to_pylist()))
    place = {q: k for k, q in enumerate(ids)}
    wanted = np.zeros((len(terms), len(ids)))
    wanted[[number[t] for t in asked["phrase"].to_pylist()], [place[q] for q in asked["query_id"].to_pylist()]] = 1.0
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast(wanted)
    key, kind = queries.schema["query_id"].dataType.simpleString(), posts.schema[doc].dataType.simpleString()
    step = int(FIXED) // 10**digits

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(ids), cut)
        for batch in batches:
            nos, units = np.concatenate(batch["nos"].to_list()), np.concatenate(batch["units"].to_list())
            at = np.repeat(np.arange(len(batch)), batch["nos"].map(len))
            parts, there = np.zeros((len(batch), len(terms))), np.zeros((len(batch), len(terms)))
            parts[at, nos] = units
            sums = (parts @ held.value).astype(np.int64)
            there[at, nos] = 1.0
            hit = sums > 0 if (units > 0).all() else there @ held.value > 0
            order = np.where(hit, (sums + step // 2) // step, -1)
            names = batch[doc].to_numpy()
            for k in np.flatnonzero((order >= np.maximum(best.bar, 0)).any(axis=0)):
                live = np.flatnonzero(order[:, k] >= max(best.bar[k], 0))
                best.add(k, order[live, k], names[live], sums[live, k])
        yield from best.frames(ids, doc, "sum", names_type)

    numbers = spark.createDataFrame(list(number.items()), "phrase string, no int")
    one = _weighed(phrases, posts, lengths, doc).join(F.broadcast(numbers), "phrase")
    rows = one.groupBy(doc).agg(F.collect_list(F.struct("no", "units")).alias("x")).select(doc, F.col("x.no").alias("nos"), F.col("x.units").alias("units"))
    names_type = "int64" if kind in ("int", "bigint") else object
    found = map_parts(rows, read, f"query_id {key}, {doc} {kind}, sum bigint", BLOCK)
    return ranked(found.select("query_id", doc, F.round(F.col("sum") / FIXED, digits).alias("score")), doc, cut)


def counts_topk(queries: DataFrame, counts: DataFrame, doc: str, cut: int, digits: int, dropped: Column | None = None) -> DataFrame:
    """bm25_topk from term_counts: documents are read where they lie, once for the phrases in them and once for scores.

    What moves is a count a phrase and at most `cut` rows a query and task. Beyond the limits of bm25_topk it is that on the postings.
    """
    phrases = materialize(query_phrases(queries, dropped).distinct(), "phrases")
    size = phrases.groupBy("query_id").count().agg(F.count("*").alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    if size.most > PHRASES or size.rows > QUERY_NUMBERS // 8 or size.n > QUERY_LIMIT:
        return bm25_topk(queries, postings_from(counts, doc), lengths_from_counts(counts, doc), doc, cut, digits, dropped)
    spark = queries.sparkSession
    asked = phrases.toArrow().to_pylist()  # QUERY_NUMBERS / 8 at most
    terms = sorted({r["phrase"] for r in asked})
    number = {t: k for k, t in enumerate(terms)}
    ids = sorted({r["query_id"] for r in asked})
    place = {q: k for k, q in enumerate(ids)}
    whole: dict[str, list[int]] = {}
    begin: dict[str, list[int]] = {}
    for phrase, term, is_prefix in sorted({(r["phrase"], r["term"], r["is_prefix"]) for r in asked}):
        (begin if is_prefix else whole).setdefault(term, []).append(number[phrase])
    pairs = np.array(sorted((number[r["phrase"]], place[r["query_id"]]) for r in asked), dtype=np.int64).reshape(-1, 2)
    # terms that begin like none are passed over in arrays, unless what begins them is shorter
    stems = None if any(len(t) < STEM for t in begin) else sorted({t[:STEM] for t in (*whole, *begin)})
    sizes: dict[str, set[int]] = {}
    for t in begin:
        sizes.setdefault(t[:STEM] if stems is not None else "", set()).add(len(t))
    held = spark.sparkContext.broadcast((whole, begin, {t: sorted(n) for t, n in sizes.items()}, stems))
    key, kind = queries.schema["query_id"].dataType.simpleString(), counts.schema[doc].dataType.simpleString()

    def look() -> Callable[[pa.RecordBatch], list]:
        known: dict[str, tuple[int, ...]] = {}  # a worker's, of a task

        def phrases_of(term: str) -> tuple[int, ...]:
            found = known.get(term)
            if found is None:
                whole, begin, sizes, stems = held.value
                some = sizes.get(term[:STEM] if stems is not None else "", ())
                found = tuple(whole.get(term, ())) + tuple(k for n in some if n <= len(term) for k in begin.get(term[:n], ()))
                if len(known) > KNOWN:
                    known.clear()
                known[term] = found
            return found

        def read(batch: pa.RecordBatch) -> list:
            row, word, names = _numbered(batch.column(1))
            heads, texts = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            stems = held.value[3]
            near = np.arange(len(names))
            if stems is not None:
                near = np.flatnonzero(pc.is_in(pc.utf8_slice_codeunits(names, 0, STEM), value_set=pa.array(stems, names.type)).to_numpy(zero_copy_only=False))
            of = [phrases_of(t) for t in names.take(pa.array(near)).to_pylist()]
            n = np.zeros(len(names), dtype=np.int64)
            n[near] = [len(f) for f in of]
            ends = np.r_[0, np.cumsum(n)]
            every = np.array([k for f in of for k in f], dtype=np.int64)
            live = np.flatnonzero(n[word])
            times = n[word[live]]
            at = np.repeat(live, times)
            nos = every[np.repeat(ends[word[live]], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
            width = max(len(terms), 1)
            found, where = np.unique(row[at] * width + nos, return_inverse=True)
            tf = np.bincount(where, (HEADING_WEIGHT * heads + TEXT_WEIGHT * texts)[at], len(found))
            dl = np.bincount(row, heads + texts, batch.num_rows).astype(np.int64)
            stops = pa.array(np.searchsorted(found, np.arange(batch.num_rows + 1) * width).astype(np.int32))
            return [batch.column(0), pa.array(dl), pa.ListArray.from_arrays(stops, pa.array((found % width).astype(np.int32))), pa.ListArray.from_arrays(stops, pa.array(tf))]

        return read

    rows = counts.select(doc, "terms", "in_heading", "in_text")
    hits = materialize(_per_document(rows, lambda batch, held=[]: (held or held.append(look()) or held)[0](batch), f"{doc} {kind}, dl long, nos array<int>, tfs array<double>"), "hits")
    stats = hits.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    spread = hits.select(F.explode("nos").alias("no")).groupBy("no").agg(F.count("*").alias("n_docs"))
    idf = F.log((F.col("n") - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    spread = spread.join(F.broadcast(stats), F.lit(True)).select("no", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl").toArrow()  # a row a phrase
    idfs, avgdl = np.zeros(len(terms)), (spread["avgdl"][0].as_py() if spread.num_rows else 1.0) or 1.0
    idfs[spread["no"].to_numpy()] = spread["idf"].to_numpy()
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    weights = spark.sparkContext.broadcast((idfs, first, pairs[:, 1].copy()))
    step, names_type = int(FIXED) // 10**digits, "int64" if kind in ("int", "bigint") else object

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(ids), cut)
        for batch in batches:
            idf, first, queries_of = weights.value
            sizes = batch["nos"].map(len).to_numpy()
            nos, tf = np.concatenate(batch["nos"].to_list()).astype(np.int64), np.concatenate(batch["tfs"].to_list())
            at = np.repeat(np.arange(len(batch)), sizes)
            part = idf[nos] * tf * (B25_K1 + 1) / (tf + B25_K1 * (1 - B25_B + B25_B * batch["dl"].to_numpy()[at] / avgdl))
            units = np.floor(part * FIXED + 0.5)
            n = first[nos + 1] - first[nos]
            which = queries_of[np.repeat(first[nos], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            cell = np.repeat(at, n) * len(ids) + which
            # sums of up to PHRASES whole numbers, which a double holds
            sums = np.bincount(cell, np.repeat(units, n), len(batch) * len(ids)).astype(np.int64).reshape(len(batch), len(ids))
            there = sums > 0
            if not (units > 0).all():
                there.ravel()[cell] = True
            order = np.where(there, (sums + step // 2) // step, -1)
            names = batch[doc].to_numpy()
            for k in np.flatnonzero((order >= np.maximum(best.bar, 0)).any(axis=0)):
                live = np.flatnonzero(order[:, k] >= max(best.bar[k], 0))
                best.add(k, order[live, k], names[live], sums[live, k])
        yield from best.frames(ids, doc, "sum", names_type)

    block = max(16, min(2048, (1 << 20) // max(len(ids), 1)))
    found = map_parts(hits.where("size(nos) > 0"), score, f"query_id {key}, {doc} {kind}, sum bigint", block)
    return ranked(found.select("query_id", doc, F.round(F.col("sum") / FIXED, digits).alias("score")), doc, cut)


class Best:
    """The best `cut` items of each of n queries so far, by score and then by item, with a value each."""

    def __init__(self, n: int, cut: int) -> None:
        self.cut, self.bar = cut, np.full(n, -np.inf)
        self.held: list[tuple | None] = [None] * n

    def add(self, k: int, scores: np.ndarray, items: np.ndarray, values: np.ndarray) -> None:
        if self.held[k] is not None:
            scores, items, values = (np.concatenate(pair) for pair in zip(self.held[k], (scores, items, values)))
        if len(scores) > self.cut:
            bar = np.partition(scores, len(scores) - self.cut)[len(scores) - self.cut]
            live = np.flatnonzero(scores >= bar)
            live = live[np.lexsort((items[live], -scores[live]))][: self.cut]
            scores, items, values = scores[live], items[live], values[live]
        if len(scores) >= self.cut:
            self.bar[k] = scores.min()
        self.held[k] = (scores, items, values)

    def frames(self, ids: list, item: str, value: str, kind) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(ids), 256):
            some = [(ids[k], self.held[k]) for k in range(lo, min(lo + 256, len(ids))) if self.held[k] is not None]
            if some:
                names = [q for q, h in some for _ in range(len(h[0]))]
                yield pd.DataFrame({"query_id": names, item: np.concatenate([h[1] for _, h in some]).astype(kind), value: np.concatenate([h[2] for _, h in some])})


def lengths_of(docs: DataFrame, doc: str, *columns: str) -> DataFrame:
    size = sum((F.size(T.tokens(F.coalesce(c, F.lit("")))) for c in columns[1:]), F.size(T.tokens(F.coalesce(columns[0], F.lit("")))))
    return docs.select(doc, size.alias("dl"))


def lengths_from(posts: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """doc, dl as lengths_of, summed from postings that are there already; documents without tokens have 0."""
    known = posts.groupBy(doc).agg(F.sum(F.col("tf_heading") + F.col("tf_text")).alias("n"))
    return docs.select(doc).distinct().join(known, doc, "left").select(doc, F.coalesce("n", F.lit(0)).alias("dl"))


def ranked(scored: DataFrame, item: str, cut: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The best `cut` of each query with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)


def owner_list(cut: DataFrame, owners: DataFrame, allowed: DataFrame | None, item: str, owner: str, kept: int = KEPT) -> DataFrame:
    """A list that is cut before it is filtered: items map to owners, the first of each owner stays."""
    rows = cut.join(owners, item)
    if allowed is not None:
        rows = rows.join(allowed.select(owner), owner, "left_semi")
    return first_owners(rows, owner, kept)


def first_owners(rows: DataFrame, owner: str, kept: int = KEPT) -> DataFrame:
    """query_id, owner, rank: each owner once, at its first place, ranked anew."""
    first = rows.groupBy("query_id", owner).agg(F.min("rank").alias("old"))
    order = Window.partitionBy("query_id").orderBy("old", owner)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).drop("old")


def filtered_list(cut: DataFrame, allowed: DataFrame | None, item: str, kept: int = KEPT) -> DataFrame:
    """A list that is cut, filtered and ranked anew."""
    rows = cut.select("query_id", item, F.col("rank").alias("old"))
    if allowed is not None:
        rows = rows.join(allowed.select(item), item, "left_semi")
    order = Window.partitionBy("query_id").orderBy("old", item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).drop("old")


def hash_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and v, a deterministic stand-in for a model: 64 counts of hashed words, scaled to unit length.

    Rows stay where they are read; only where several share a key are words shuffled to count them. A text without words has no vector.
    """
    if not repeats(rows, key):
        return _hashed(rows, key, text)
    bucket = F.conv(F.right(T.sha("word"), F.lit(2)), 16, 10).cast("int") % DIMS
    counted = rows.select(key, F.explode(T.words(F.coalesce(text, F.lit("")))).alias("word")).groupBy(key, bucket.alias("dim")).agg(F.count("*").cast("double").alias("c"))
    listed = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dims = F.array(*[F.lit(k) for k in range(DIMS)])
    return listed.select(key, F.transform(dims, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm")).alias("v"))


def _hashed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """hash_vectors of rows of which each has a key of its own."""

    def look() -> Callable[[pa.RecordBatch], list]:
        known: dict[str, int] = {}  # a worker's, of a task

        def dim(word: str) -> int:
            found = known.get(word)
            if found is None:
                if len(known) > KNOWN:
                    known.clear()
                found = known[word] = hashlib.sha256(word.encode()).digest()[-1] % DIMS
            return found

        def read(batch: pa.RecordBatch) -> list:
            row, word, names = _numbered(batch.column(1))
            dims = np.array([dim(w) for w in names.to_pylist()], dtype=np.int64)
            counts = np.bincount(row * DIMS + dims[word], minlength=batch.num_rows * DIMS).astype(np.float64).reshape(-1, DIMS)
            norm = np.sqrt((counts * counts).sum(axis=1))
            live = np.flatnonzero(norm > 0)
            v = (counts[live] / norm[live, None]).ravel()
            return [batch.column(0).take(pa.array(live)), pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1, dtype=np.int32) * DIMS), pa.array(v))]

        return read

    words = rows.select(key, T.words(F.coalesce(text, F.lit(""))))
    return _per_document(words, lambda batch, held=[]: (held or held.append(look()) or held)[0](batch), f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>")


#: Queries or quotes of one batch, and of all their vectors' numbers: what goes out to every task is at most 160 MB.
QUERY_LIMIT, QUERY_NUMBERS = 20_000, 20_000_000


def _batch(rows: DataFrame, what: str) -> list:
    """A stated set of rows whose size is checked before it is brought together."""
    found = rows.limit(QUERY_LIMIT + 1).collect()
    if len(found) > QUERY_LIMIT:
        raise ValueError(f"more than {QUERY_LIMIT} {what}; split the batch")
    return found


def vector_topk(queries: DataFrame, vectors: DataFrame, item: str, cut: int, digits: int | None = None, positive: bool = False, others: bool = False, scope: str | None = None) -> DataFrame:
    """query_id, item, score, rank: of each query (query_id, q) the `cut` vectors (item, v) with the highest inner products.

    Up to QUERY_LIMIT queries go out to all blocks of vectors; a block is one matrix product, and a task gives at most
    `cut` rows a query, so pairs are never rows. More queries meet the vectors in tiles of a block of each. Ties go to the smaller item. positive: scores over 0 only; others:
    not the vector whose item is the query's own id; scope: a column of the vectors that must be among the query's
    `only`, where that isn't empty. Vectors of another length are no candidates.
    """
    columns = ["query_id", "q", *(["only"] if scope else [])]
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("numbers")).first()
    if size.n > QUERY_LIMIT or size.numbers > QUERY_NUMBERS:
        return _tiled_topk(queries.select(*columns), vectors, item, cut, digits, positive, others, scope)
    asked = [r for r in _batch(queries.select(*columns), "queries") if r.q]
    key = queries.schema["query_id"].dataType.simpleString()
    kind = vectors.schema[item].dataType.simpleString()
    schema = f"query_id {key}, {item} {kind}, score double"
    ids = [r.query_id for r in asked]
    sizes: dict[int, list[int]] = {}
    for k, r in enumerate(asked):
        sizes.setdefault(len(r.q), []).append(k)
    matrices = {n: (np.array(at), np.array([asked[k].q for k in at], dtype=np.float64)) for n, at in sizes.items()}
    held = queries.sparkSession.sparkContext.broadcast(matrices)

    only = [frozenset(r.only or ()) if scope else frozenset() for r in asked]

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(ids), cut)
        for batch in batches:
            lengths = batch["v"].map(lambda v: -1 if v is None else len(v))
            for n, (at, q) in held.value.items():
                part = batch[lengths == n]
                for lo in range(0, len(part), 2048):
                    some = part.iloc[lo : lo + 2048]
                    names = some[item].to_numpy()
                    scores = q @ np.array(some["v"].tolist(), dtype=np.float64).T
                    scores = np.round(scores, digits) if digits else scores
                    for i, k in enumerate(at):
                        ok = (scores[i] >= best.bar[k]) & (scores[i] > (0 if positive else -np.inf)) & (names != ids[k] if others else True)
                        live = np.flatnonzero(ok & some[scope].isin(only[k]).to_numpy() if only[k] else ok)
                        if len(live):
                            best.add(k, scores[i][live], names[live], scores[i][live])
        yield from best.frames(ids, item, "score", names_type)

    names_type = "int64" if kind in ("int", "bigint") else object
    return ranked(vectors.select(item, "v", *[scope] if scope else []).mapInPandas(block, schema), item, cut)


#: Queries and vectors of a tile.
TILE_QUERIES, TILE_ITEMS = 4096, 1 << 15


def _tiled_topk(queries: DataFrame, vectors: DataFrame, item: str, cut: int, digits: int | None, positive: bool, others: bool, scope: str | None) -> DataFrame:
    """vector_topk for any number of queries: each tile gives its queries' best `cut`, and these are ranked together."""
    key, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[item].dataType.simpleString()
    n_queries, n_items = queries.count(), vectors.count()
    across, down = -(-n_queries // TILE_QUERIES) or 1, -(-n_items // TILE_ITEMS) or 1
    spread = lambda rows, name, own, n, other, m: rows.withColumns({own: F.pmod(F.xxhash64(name), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    queries, vectors = (r.select(*[F.col(c).alias(c) for c in r.columns]) for r in (queries, vectors))  # may come from one table
    asked = spread(queries.where("size(q) > 0"), "query_id", "tile_q", across, "tile_i", down)
    held = spread(vectors.where("v is not null").select(item, "v", *([scope] if scope else [])), item, "tile_i", down, "tile_q", across)

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], item: [], "score": []})]
        lengths = b["v"].map(len)
        for n, some in a.groupby(a["q"].map(len)):
            part = b[lengths == n]
            if not len(part):
                continue
            names, matrix = part[item].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64)
            for lo in range(0, len(some), 256):
                block = some.iloc[lo : lo + 256]
                scores = np.stack(block["q"].to_numpy()).astype(np.float64) @ matrix.T
                scores = np.round(scores, digits) if digits else scores
                for k, (query, row) in enumerate(zip(block["query_id"], scores)):
                    ok = row > (0 if positive else -np.inf)
                    if others:
                        ok &= names != query
                    if scope and block["only"].iloc[k] is not None and len(block["only"].iloc[k]):
                        ok &= part[scope].isin(list(block["only"].iloc[k])).to_numpy()
                    live = np.flatnonzero(ok)
                    if len(live) > cut:
                        bar = np.partition(row[live], len(live) - cut)[len(live) - cut]
                        live = live[row[live] >= bar]
                    best = live[np.lexsort((names[live], -row[live]))][:cut]
                    found.append(pd.DataFrame({"query_id": [query] * len(best), item: names[best], "score": row[best]}))
        return pd.concat(found)

    met = asked.groupBy("tile_q", "tile_i").cogroup(held.groupBy("tile_q", "tile_i"))
    return ranked(met.applyInPandas(tile, f"query_id {key}, {item} {kind}, score double"), item, cut)


def fuse(lists: dict[str, DataFrame], item: str, weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: query_id, item, score; the terms are added in the order of the lists."""
    names = list(lists)
    rows = None
    for name in names:
        one = lists[name].select("query_id", item, F.struct(F.lit(names.index(name)).alias("o"), (F.lit(weights[name]) / (k + F.col("rank"))).alias("t")).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    terms = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return rows.groupBy("query_id", item).agg(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("score"))


def four_lists(queries: DataFrame, sections: DataFrame, statements: DataFrame, section_index, statement_index, embed, dropped: Column | None = None, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: keywords and vectors of sections and of statements, fused by reciprocal ranks.

    queries: query_id, query, only (scopes to keep to; empty: all). sections: chunk_id, scope of what may be found;
    statements: statement_id, chunk_id. The indexes hold both by these ids. Keyword lists and the statements' vector
    list are cut before they are filtered, the sections' vector list after; a statement stands for its section. `dropped`
    words are no keywords. digits: scores are rounded before they are ranked.
    """
    allowed = materialize(sections.select("chunk_id", "scope"), "allowed")
    per = queries.select("query_id", F.coalesce("only", F.array().cast("array<string>")).alias("only"))

    def permitted(rows: DataFrame) -> DataFrame:
        mine = rows.join(allowed, "chunk_id").join(per, "query_id")
        return mine.where((F.size("only") == 0) | F.array_contains("only", F.col("scope"))).select("query_id", "chunk_id", "rank")

    def keywords(index, item: str) -> DataFrame:
        asked = queries.select("query_id", "query")
        if digits:
            return counts_topk(asked, index.counts, item, CUT, digits, dropped)
        return ranked(bm25(asked, index.postings, index.lengths, item, dropped), item, CUT)

    asked = embed(queries.select("query_id", "query"), "query_id", "query").withColumnRenamed("v", "q")
    asked = materialize(asked.join(per, "query_id"), "asked")
    lists = {
        "section_keyword": filtered_list(permitted(keywords(section_index, "chunk_id")), None, "chunk_id"),
        "statement_keyword": first_owners(permitted(keywords(statement_index, "statement_id").join(statements, "statement_id")), "chunk_id"),
        "section_vector": vector_topk(asked, section_index.vectors.join(allowed, "chunk_id"), "chunk_id", KEPT, digits, scope="scope"),
        "statement_vector": first_owners(permitted(vector_topk(asked, statement_index.vectors, "statement_id", CUT, digits).join(statements, "statement_id")), "chunk_id"),
    }
    return fuse(lists, "chunk_id")


def resolve(asked: list[str] | None, known: list[str], what: str) -> list[str] | None:
    """Names as they are registered, found whatever their case; an unknown one is an error that lists the known."""
    if not asked:
        return None
    if not known:
        raise ValueError(f"there are no {what}s here; leave them out")
    by_lower = {k.lower(): k for k in sorted(known)}
    if unknown := [a for a in asked if a.lower() not in by_lower]:
        raise ValueError(f"unknown {what}s {unknown}; known: {', '.join(by_lower.values())}")
    return [by_lower[a.lower()] for a in asked]


def collapse(results: DataFrame, digest: str, label: str, order: list[Column], limit: int, by: str = "query_id") -> DataFrame:
    """The best row of each text and query, with the labels of later copies in order, first `limit` of a query.

    Copies count also where they rank beyond the limit.
    """
    place = Window.partitionBy(by).orderBy(*order)
    rows = results.withColumn("place", F.row_number().over(place))
    others = [c for c in rows.columns if c not in (by, digest)]
    groups = rows.groupBy(by, digest).agg(F.min_by(F.struct(*others), "place").alias("best"), F.array_sort(F.collect_list(F.struct("place", label))).alias("all"))
    also = F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x[label])
    final = Window.partitionBy(by).orderBy("best.place")
    out = groups.withColumn("result_no", F.row_number().over(final)).where(F.col("result_no") <= limit)
    return out.select(by, "result_no", digest, *[F.col(f"best.{c}").alias(c) for c in others if c != "place"], also.alias("also_in"))


def allowed(sections: DataFrame, statements: DataFrame | None = None, scopes: list | None = None, tags: list | None = None, topics: list | None = None) -> DataFrame:
    """Sections of the scopes, with one of the tags, with a statement on one of the topics."""
    if scopes:
        sections = sections.where(F.col("scope").isin(scopes))
    if tags:
        sections = sections.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if topics and statements is not None:
        sections = sections.join(statements.where(F.col("topic").isin(topics)).select("chunk_id"), "chunk_id", "left_semi")
    return sections


def infer_scopes(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, scope: names (scope, name) that stand in a query as whole words.

    Names are a registry's and few; a query's words join them on the first word of a name.
    """
    names = names.withColumn("name_words", T.words("name"))
    names = names.where(F.size("name_words") > 0).withColumn("head", F.col("name_words")[0])
    asked = queries.withColumn("query_words", F.array_join(T.words("query"), " "))
    heads = asked.select("query_id", "query_words", F.explode(F.array_distinct(T.words("query"))).alias("head"))
    padded = F.concat(F.lit(" "), "query_words", F.lit(" "))
    hit = F.contains(padded, F.concat(F.lit(" "), F.array_join("name_words", " "), F.lit(" ")))
    return heads.join(names, "head").where(hit).select("query_id", "scope").distinct()
