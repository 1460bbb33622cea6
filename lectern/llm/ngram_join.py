"""N-gram Jaccard self-join of documents by chosen paths.

Sets are the distinct 5-word shingles of a whole text (lower case, runs of word characters; a text of 1 to 4
words is one shingle). Two sets link at Jaccard 0.8 or more, computed exactly.

1. Texts with equal sets are one class from here on; `copies` counts their rows.
2. Each class is embedded as 128 min-hash values, so that two sets agree in a coordinate with their Jaccard
   similarity as probability. RUNS paths start at the root, which splits the classes by two seeded coordinates:
   similar sets stay together. A bucket of BRUTE classes or fewer is compared by brute force on the embeddings. A
   larger one is compared with a seeded member of its own and split again by the values of a seeded coordinate, at
   times of two in turn (1 / 0.8 on average), DEPTH times at most. Classes near that member go down once only, and
   buckets in which all are near it end there, since they are in one component already.
   What is still too large after that is compared as a whole, block by block.
3. Agreements in 65 % of the coordinates (over four standard deviations below 0.8) make candidate edges; of
   each bucket a spanning forest of them goes on, so that rows grow with members and not with pairs. RUNS are as
   many as miss a pair at 0.8 with a probability under 1 - RECALL if a run keeps it with PER_RUN; that is then
   measured: AUDIT classes of components and AUDIT others (fixed numbers, by hash, others each time) are compared
   with the embeddings of all classes in blocks. Pairs that the runs did not bring together become edges, and
   while of either kind more than one pair and more than 1 - AUDIT_BAR of the pairs were missed, further runs follow.
   (The bar is one that some hundred audited pairs can tell; the runs are laid out for RECALL.)

The root split reads two bytes a coordinate, where the sketch is made; all else compares, and all that is shuffled for
it carries, one byte a coordinate, which agrees where the value does and otherwise by chance in 1 of 256.
4. Inside each component of candidates the exact sets are compared in tiles of at most 2 x TILE classes, so
   that links found and links merely implied by a path are both counted once, and links that are none drop
   out. A tile gives link counts and a spanning forest; the forests' components are the groups.

No bucket, group or set is cut: BRUTE and DEPTH part the ways of comparing, and step 4 compares every member of a
component with every other. Texts move once, for members of components; nothing grows with pairs but the
tiles' arithmetic. A pair that shares a text's common passage in one run's bucket meets in other runs without it.

Cases. Null and empty texts (and texts without word characters) have no set and link with nothing. Rows
equal in doc_id and text are copies of each other; null doc_ids are kept and never represent a group that has
another id. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.session import keep, materialize, scratch, table

WORDS = 5
#: Jaccard of 4/5: 5 * both >= 4 * either.
SIMILAR = (4, 5)
COORDINATES = 128
CANDIDATE = 0.65
RECALL = 0.9999
AUDIT_BAR = 0.99
#: A root splits by two coordinates, so it keeps a pair at 0.8 with probability 0.64; down the path of a large
#: bucket this is assumed.
PER_RUN = 0.3
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - PER_RUN))
#: Buckets up to FEW travel as lists, many to a batch; those up to BRUTE as a group each.
FEW = 64
BRUTE = 2048
DEPTH = 8
#: Bits a key of the map that keeps texts that are in no component from being moved, and the most keys it is made for
#: (a broadcast of 2 M words, 32 MB); more of them are joined.
MAP_SHARE, MAP_KEYS = 16, 1 << 23
#: Sets of a tile's block, and bytes of their shingles, on average.
TILE, TILE_BYTES = 256, 6 << 20
AUDIT = 128
#: Agreements from which a pair that the runs missed becomes an edge, as its Jaccard may be 0.8; the audit's share is
#: that of the pairs which agree in 0.8 or more.
AUDITED = 0.76
#: Words whose hashes a worker keeps, some 150 bytes each.
KNOWN = 250_000
_WORD = re.compile(r"\w+")
_KNOWN: dict[str, int] = {}
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a whole text."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    try:
        hashed = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_KNOWN) > KNOWN:
            _KNOWN.clear()
        for w in words:
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh64_intdigest(w)
        hashed = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(words))
    rolled = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + hashed[k : len(words) - n + 1 + k]
    return np.unique(_mix(rolled))


_FACTORS = np.random.default_rng(11).integers(1 << 20, 1 << 31, COORDINATES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
#: Shingles that meet all coordinates at a time, and where (1 MB a worker).
STEP = 2048
_ROOM = np.empty(COORDINATES * STEP, dtype=np.uint32)
_SHIFTS = np.random.default_rng(12).integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]


def signature(found: np.ndarray) -> bytes:
    """COORDINATES low bytes of the min-hash values, then as many next higher ones."""
    x = (found >> _U(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), STEP):
        part = x[lo : lo + STEP]
        room = _ROOM[: COORDINATES * len(part)].reshape(COORDINATES, len(part))  # the same memory each time, which stays in the cache
        np.add(np.multiply(part, _FACTORS, out=room), _SHIFTS, out=room)
        np.minimum(out, room.min(axis=1), out=out)
    return (out & 255).astype(np.uint8).tobytes() + (out >> 8 & 255).astype(np.uint8).tobytes()


def sliced(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Few texts at a time, so that a worker holds the shingles of these alone."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


def sketches(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text_key, set_key (null without a set), sig, size (of the set)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            keys, sigs, sizes = [], [], []
            for text in batch["text"]:
                found = shingles(text)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
                sizes.append(len(found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "set_key": keys, "sig": sigs, "size": sizes})

    return keyed(docs).mapInPandas(read, "doc_id long, text_key long, set_key binary, sig binary, size long")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _chosen(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinate at which each path splits, and a second one for every fourth path."""
    h = _mix(paths + _U(0x9E3779B97F4A7C15))
    first = (h & _U(COORDINATES - 1)).astype(np.int64)
    second = (first + 1 + ((h >> _U(8)) % _U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    return first, second, (h >> _U(40)) % _U(4) == 0


def _down(paths: np.ndarray, sigs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The paths one split further, by the values at the given coordinates."""
    token = sigs[np.arange(len(sigs)), at].astype(np.uint64) | (at.astype(np.uint64) << _U(32))
    return _mix(_mix(paths) ^ (token * _U(0xD6E8FEB86659FD93)))


def _root(run: int, sigs: np.ndarray) -> np.ndarray:
    paths = np.full(len(sigs), run * 7919 + 1, dtype=np.uint64)
    first, second, _ = _chosen(paths)
    return _down(_down(paths, sigs, first), sigs, second)


def _split(paths: np.ndarray, sigs: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (into sigs) and their paths one level down; those marked once go down by one coordinate only."""
    first, second, twice = _chosen(paths)
    again = np.flatnonzero(twice & ~once)
    rows = np.r_[np.arange(len(paths)), again]
    return rows, np.r_[_down(paths, sigs, first), _down(paths[again], sigs[again], second[again])]


def _matrix(column: pd.Series) -> np.ndarray:
    """Sketches of one byte a coordinate."""
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), COORDINATES)


def _wide(column: pd.Series) -> np.ndarray:
    """Sketches of two bytes a coordinate."""
    both = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), 2, COORDINATES).astype(np.uint16)
    return both[:, 0] | both[:, 1] << 8


def narrow(classes: DataFrame) -> DataFrame:
    return classes.select("node", F.substring("sig", 1, COORDINATES).alias("sig"))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(linked[u] & left)
            left[new] = False
            out += [(u, v) for v in new.tolist()]
            todo += new.tolist()
    return out


def agreeing(sigs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows that agree in CANDIDATE of the coordinates.

    Rows that are reached are not compared again, so a bucket of near copies costs a pass or a few.
    """
    left, short_left, out, todo = np.arange(len(sigs)), sigs, [], []
    while len(left):
        if todo:
            u = todo.pop()
        else:
            u, left, short_left = int(left[0]), left[1:], short_left[1:]
        near = np.count_nonzero(short_left == sigs[u], axis=1) >= CANDIDATE * COORDINATES
        if near.any():
            new = left[near].tolist()
            out += [(u, v) for v in new]
            todo += new
            left, short_left = left[~near], short_left[~near]
    return out


def candidates(classes: DataFrame, first_run: int = 0, runs: int = RUNS) -> DataFrame:
    """Edges a, b between classes (node, sig) that a chosen path brings together and their embeddings support."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs, nodes = _wide(batch["sig"]), batch["node"].to_numpy()
            for run in range(first_run, first_run + runs):
                yield pd.DataFrame({"path": _root(run, sigs).view(np.int64), "node": nodes})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs, nodes, leader = _matrix(batch["sig"]), batch["node"].to_numpy(), batch["leader"].to_numpy()
            near = (sigs == _matrix(batch["leader_sig"])).mean(axis=1) >= CANDIDATE
            new = near & (nodes != leader)
            yield pd.DataFrame({"path": None, "node": nodes[new], "other": leader[new], "near": True, "sig": None}).astype({"path": "Int64", "other": "Int64"})
            rows, paths = _split(batch["path"].to_numpy().view(np.uint64), sigs, near)
            down = pd.DataFrame({"path": paths.view(np.int64), "node": nodes[rows], "other": None, "near": near[rows], "sig": batch["sig"].to_numpy()[rows]})
            yield down.astype({"path": "Int64", "other": "Int64"})

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for members in batch["members"]:
                nodes = [m["node"] for m in members]
                pairs = agreeing(_matrix([m["sig"] for m in members]))
                a += [nodes[i] for i, _ in pairs]
                b += [nodes[j] for _, j in pairs]
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, pairs = frame["node"].to_numpy(), agreeing(_matrix(frame["sig"]))
        return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")

    few, some, edges = [], [], []
    paths = materialize(classes.select("node", "sig").mapInPandas(roots, "path long, node long"), "paths")
    for level in range(DEPTH + 1):
        far = F.lit(True) if level == 0 else F.bool_or(~F.col("near"))
        sizes = paths.groupBy("path").agg(F.count("*").alias("size"), far.alias("far")).where("size > 1 and far")
        sizes = materialize(sizes, "path-sizes")
        few.append(paths.select("path", "node").join(sizes.where(F.col("size") <= FEW).select("path"), "path"))
        if sizes.where(F.col("size") > FEW).isEmpty():
            break
        some.append(paths.select("path", "node").join(sizes.where(F.col("size").between(FEW + 1, BRUTE)).select("path"), "path"))
        large = sizes.where(F.col("size") > BRUTE).select("path")
        if large.isEmpty():
            break
        if level == DEPTH:
            edges.append(blockwise(paths.join(sizes.where(F.col("size") > BRUTE).select("path", "size"), "path").select("path", "node", "size"), classes))
            break
        held = paths.join(large, "path")
        if level == 0:  # further down, large buckets' rows bring their embeddings along
            held = held.join(narrow(classes), "node")
        # one seeded order a level: a group that many runs keep together has few leaders, so edges are equal ones
        lead = held.groupBy("path").agg(F.min(F.struct(F.xxhash64(F.lit(level), "node"), "node", "sig")).alias("l"))
        lead = lead.select("path", F.col("l.node").alias("leader"), F.col("l.sig").alias("leader_sig"))
        pairs = held.select("path", "node", "sig").join(lead, "path")
        done = materialize(pairs.mapInPandas(step, "path long, node long, other long, near boolean, sig binary"), "path-step")
        edges.append(done.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        paths = done.where("path is not null").select("path", "node", "near", "sig")
    buckets = few[0]
    for more in few[1:]:
        buckets = buckets.unionByName(more)
    # many runs give the same bucket
    buckets = buckets.groupBy("path").agg(F.array_sort(F.collect_list("node")).alias("nodes")).groupBy("nodes").agg(F.min("path").alias("path"))
    rows = buckets.select("path", F.explode("nodes").alias("node")).join(narrow(classes), "node")
    rows = rows.groupBy("path").agg(F.collect_list(F.struct("node", "sig")).alias("members"))
    out = rows.select("members").mapInPandas(brute, "a long, b long")
    if some:
        rows = some[0]
        for more in some[1:]:
            rows = rows.unionByName(more)
        out = out.unionByName(rows.join(narrow(classes), "node").groupBy("path").applyInPandas(bucket, "a long, b long"))
    for more in edges:
        out = out.unionByName(more)
    return out


def blockwise(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges a, b of buckets (path, node, size) of any size, compared as pairs of blocks of BRUTE / 2 classes."""
    half = BRUTE // 2
    spread = rows.withColumn("blocks", F.ceil(F.col("size") / half).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.select(F.concat_ws("-", "path", F.least("block", "k"), F.greatest("block", "k")).alias("tile"), "node").join(narrow(classes), "node")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        nodes, pairs = frame["node"].to_numpy(), agreeing(_matrix(frame["sig"]))
        return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")

    return tiles.groupBy("tile").applyInPandas(tile, "a long, b long")


def audit(classes: DataFrame, groups: DataFrame, seed: int) -> tuple[DataFrame, bool]:
    """Missed edges of the audited classes (a, b), and whether the share of their pairs that was found meets AUDIT_BAR."""
    # only embeddings of classes that may be in a component move
    rows = flagged(narrow(classes), groups.select("node"), "node")
    met = rows.where("map_maybe").drop("map_maybe").join(groups, "node", "left")
    met = met.unionByName(rows.where("not map_maybe").select("node", "sig", F.lit(None).cast("long").alias("component")))
    placed = materialize(met.select("node", "sig", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("alone")), "audited")
    order = [F.xxhash64("node", F.lit(seed)), F.col("node")]
    asked = [r for alone in (False, True) for r in placed.where(F.col("alone") == alone).orderBy(*order).limit(AUDIT).collect()]  # 2 x AUDIT classes
    held = classes.sparkSession.sparkContext.broadcast([(r.node, r.component, r.alone, bytes(r.sig)) for r in asked])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [(n, c, alone, np.frombuffer(sig, dtype=np.uint8)) for n, c, alone, sig in held.value]
        for batch in batches:
            nodes, comps = batch["node"].to_numpy(), batch["component"].to_numpy()
            columns = _matrix(batch["sig"])
            a, b, kinds, found, counts = [0, 0], [0, 0], [False, True], [0, 0], [0, 0]
            for n, c, alone, sig in queries:
                agree = np.count_nonzero(columns == sig, axis=1)
                other = (nodes != n) & (comps != c)
                at_bar = agree * SIMILAR[1] >= SIMILAR[0] * COORDINATES
                missed = np.flatnonzero((agree >= AUDITED * COORDINATES) & other)
                found[alone] += int(np.count_nonzero(at_bar & (nodes != n) & ~other))
                a += nodes[missed].tolist()
                b += [n] * len(missed)
                kinds += [alone] * len(missed)
                counts += at_bar[missed].astype(int).tolist()
            yield pd.DataFrame({"a": a, "b": b, "alone": kinds, "found": found + [0] * (len(a) - 2), "missed": counts})

    seen = materialize(placed.mapInPandas(look, "a long, b long, alone boolean, found long, missed long"), "audit")
    there = seen.groupBy("alone").agg(F.sum("found").alias("found"), F.sum("missed").alias("missed")).collect()  # two rows
    return seen.where("a <> b").select("a", "b"), all(r.missed <= max(1, (1 - AUDIT_BAR) * (r.found + r.missed)) for r in there)


def near_components(classes: DataFrame) -> DataFrame:
    """node, component of the classes that candidate edges join; runs go on until the audit is content."""
    spark = classes.sparkSession
    edges, first, runs = None, 0, RUNS
    for attempt in itertools.count():
        with scratch(spark):  # a run's paths go once its components are written
            found = candidates(classes, first, runs)
            groups = keep(components(found if edges is None else edges.unionByName(found)), "near")
        missed, enough = audit(classes, groups, attempt)
        edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)
        if enough:
            return components(edges) if not missed.isEmpty() else groups
        first, runs = first + runs, max(4, RUNS // 4)


def compare(rows: DataFrame) -> DataFrame:
    """rows: node, copies, component, blocks (of the component), shingles (binary). Returns node, links (rows linked),
    other (forest edge or null).
    """
    spread = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one key, so that the tiles of a large component are dealt to different tasks
    key = F.concat_ws("-", "component", F.least("block", "k"), F.greatest("block", "k"))
    tiles = spread.select(key.alias("tile"), "block", "node", "copies", "shingles")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node")
        nodes, copies, block = frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
        del frame, sets
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        del order
        new = np.r_[True, values[1:] != values[:-1]]
        shared = ~new | ~np.r_[new[1:], True]  # the others meet nobody
        owner, new = owner[shared], new[shared]
        del values, shared
        group = np.cumsum(new, dtype=np.int32) - 1
        both = np.zeros((len(n), len(n)), dtype=np.float32)
        width = 4096
        for lo in range(0, int(group[-1]) + 1 if len(group) else 0, width):
            a, b = np.searchsorted(group, [lo, lo + width])
            part = np.zeros((len(n), width), dtype=np.float32)
            part[owner[a:b], group[a:b] - lo] = 1
            both += part @ part.T
        meet = both.astype(np.int64)
        linked = SIMILAR[1] * meet >= SIMILAR[0] * (n[:, None] + n[None, :] - meet)
        np.fill_diagonal(linked, False)
        if block.min() != block.max():  # pairs inside a block belong to the block's own tile
            linked &= block[:, None] != block[None, :]
        links = (linked * copies[None, :]).sum(axis=1)
        pairs = forest(linked)
        some = np.flatnonzero(links)
        a = [nodes[i] for i, _ in pairs]
        b = [nodes[j] for _, j in pairs]
        out = pd.DataFrame({"node": np.r_[nodes[some], np.array(a, dtype=np.int64)], "links": np.r_[links[some], np.zeros(len(a), dtype=np.int64)]})
        out["other"] = pd.array([None] * len(some) + b, dtype="Int64")
        return out.astype({"node": "int64", "links": "int64"})

    return tiles.groupBy("tile").applyInPandas(tile, "node long, links long, other long")


def flagged(rows: DataFrame, wanted: DataFrame, key: str = "text_key") -> DataFrame:
    """rows with `map_maybe`: whether the key may be among the wanted ones, by a bit map that is sized for their number
    and broadcast; where it would be larger than for MAP_KEYS keys, a join says it exactly.
    """
    keys = wanted.count()
    if keys > MAP_KEYS:
        there = wanted.select(F.col(key).alias("map_key")).distinct().withColumn("map_maybe", F.lit(True))
        held = rows.join(there, rows[key] == there["map_key"], "left").drop("map_key")
        return held.withColumn("map_maybe", F.coalesce("map_maybe", F.lit(False)))
    bits = max(1 << 16, 1 << (MAP_SHARE * keys - 1).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = wanted.select(word.alias("map_word"), bit.alias("bit")).groupBy("map_word").agg(F.bit_or("bit").alias("map_bits"))
    held = rows.withColumn("map_word", word).join(F.broadcast(words), "map_word", "left")
    return held.withColumn("map_maybe", F.coalesce(F.col("map_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("map_word", "map_bits")


def mapped(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return flagged(rows, wanted).where("map_maybe").drop("map_maybe")


def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_key, group (of linked sets; null without a set), class_id (smallest doc_id
    of its group), n_links (other rows linked directly).
    """
    with scratch(docs.sparkSession):
        return keep(_join(docs), "placed")


def _join(docs: DataFrame) -> DataFrame:
    rows = materialize(sketches(docs), "sketches")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min(F.struct("text_key", "doc_id")).alias("one"), F.first("sig").alias("sig"),
        F.first("size").alias("size"),
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = near_components(classes)
    member = materialize(near.join(classes.select("node", "copies", "one", "set_key", "size"), "node"), "members")
    # a component's blocks are known before its texts move
    totals = member.groupBy("component").agg(F.count("*").alias("members"), F.sum(8 * F.col("size")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("bytes") / TILE_BYTES))
    totals = materialize(totals.select("component", F.least(blocks, F.col("members")).cast("int").alias("blocks")), "component-sizes")
    wanted = member.join(totals, "component").select("node", "component", "blocks", "copies", "set_key", F.col("one.text_key").alias("text_key"), F.col("one.doc_id").alias("one_id"))

    def reread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            sets = [shingles(t) for t in batch["text"]]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(k) for s, k in zip(sets, batch["set_key"])]
            out = batch[["node", "copies", "component", "blocks"]].assign(shingles=[s.tobytes() for s in sets])
            yield out[same]

    # by text and doc_id, so that the copies of a hot text do not come together
    texts = mapped(keyed(docs), wanted).withColumnRenamed("text_key", "own_key")
    texts = texts.join(wanted, (F.col("own_key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("one_id")))
    sets = texts.select("node", "copies", "component", "blocks", "set_key", "text").mapInPandas(reread, "node long, copies long, component long, blocks int, shingles binary")
    found = materialize(compare(materialize(sets, "sets")), "links")
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = groups.join(classes.select("node", "first_id"), "node")
    first = materialize(groups.groupBy("component").agg(F.min("first_id").alias("group_id")), "first-ids")
    groups = groups.join(first, "component").select("node", "component", "group_id")
    named = classes.select("set_key", "node", "first_id", "copies").join(groups, "node", "left").join(links, "node", "left")
    named = named.select(
        "set_key", F.coalesce("component", "node").alias("group"), F.coalesce("group_id", "first_id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")
    )
    # rows of one hot set meet its class in a plain join of written tables, which adaptive execution splits; rows without a set meet nobody
    rows = rows.select("doc_id", "text_key", "set_key")
    there = rows.where("set_key is not null").join(materialize(named, "named"), "set_key").drop("set_key")
    no = F.lit(None).cast("long")
    out = there.unionByName(rows.where("set_key is null").select("doc_id", "text_key", no.alias("group"), no.alias("group_id"), F.lit(0).cast("long").alias("n")))
    return out.select("doc_id", "text_key", "group", F.coalesce("group_id", "doc_id").alias("class_id"), F.col("n").cast("long").alias("n_links"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("text_key", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id, then the smallest text_key.

    Null doc_ids stay only where a group has no other. Rows without a set stay, but rows equal in doc_id and
    text are one. Further columns stay, except those that begin with map_; of rows equal in doc_id and text any one is taken.
    """
    found = join(docs)
    alone = found.where("`group` is null")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = found.where("`group` is not null").groupBy("group").agg(F.min(place).alias("f")).select(F.col("f.doc_id").alias("map_id"), F.col("f.text_key").alias("map_first"))
    first = materialize(first.unionByName(alone.select(F.col("doc_id").alias("map_id"), F.col("text_key").alias("map_first")).distinct()), "first")
    # only rows whose text is a copy, or comes again, move; all others are known to stay where they are read
    copies = found.join(first, [found["text_key"] == first["map_first"], found["doc_id"].eqNullSafe(first["map_id"])], "left_anti").select("text_key")
    again = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key")
    own = [c for c in docs.columns if not c.startswith("map_")]
    rows = docs.select(*own, F.xxhash64(F.coalesce("text", F.lit(""))).alias("map_text"))
    rows = flagged(rows, materialize(copies.unionByName(again).select(F.col("text_key").alias("map_text")).distinct(), "copies"), "map_text")
    doubtful = rows.where("map_maybe")
    kept = doubtful.join(first, (doubtful["map_text"] == first["map_first"]) & doubtful["doc_id"].eqNullSafe(first["map_id"]))
    kept = kept.dropDuplicates(["doc_id", "map_text"])
    return rows.where("not map_maybe").select(*own).unionByName(kept.select(*own))
