"""Near-duplicate embeddings by NN-descent.

1. Vectors become unit vectors in double precision; equal ones are one class (`copies` counts them). Null,
   zero and non-finite vectors take no part. The search (2 to 4) reads them in single precision, what counts
   links (5, 6) in double.
2. First neighbour lists: the exact LIST nearest inside the leaves of TREES random hyperplane trees of about
   LEAF vectors. A leaf that stays large, as of a hot group, is dealt out by a seeded hash.
3. NN-descent: a vector's neighbours and those that have it as a neighbour meet in its local join; pairs
   that are nearer than what a list holds enter it. Rounds end when under CHANGE of the lists' places change.
4. A list full of links is saturated: more links may stand beyond its end. It is enlarged by the whole
   component of links around it, which takes no places, and by LIST new places for vectors outside it. These
   are filled as in 2 and 3, from other trees and with vectors of other components alone. What links is merged,
   and lists whose new places are again full of links are enlarged anew, until each list ends below LINK.
5. Audit: AUDIT vectors of components and AUDIT others (fixed numbers, by hash, others each time) are compared
   with all vectors in blocks. Links between components that the search did not find are counted as missed and
   are kept as edges; while of either kind the share found is under RECALL, 2 to 4 go on from more trees. Each
   time merges components, so this ends.
6. Links are counted exactly among all members of a component, whatever its size, and never as pairs. A component
   of up to TILE vectors is one tile. A larger one gets a pivot: where all its members stand within half the
   angle of a link around it, all are linked and nothing is compared. Otherwise two members link only if their
   angles to the pivot differ by less than a link's angle; they are compared in tiles of at most 2 x TILE vectors
   from rings of that width that touch. A tile gives the number of links of each member and a spanning forest.

The lists' length and the caps of 2 x LIST members of a local join bound the search, not the result.

Cases. Vectors of different lengths never link. Equal vec_ids are different rows with the same id; a null
vec_id is kept and never names a component that has another id. An empty table gives no rows; further
columns, labels among them, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.graph import components
from lectern.llm.ngram_join import forest
from lectern.session import materialize, table

LINK = 0.95
#: Candidate edges keep a little below, so that a component is not torn where a list is short.
LOOSE = 0.94
LIST = 8
TREES = 4
LEAF = 256
TILE = 512
#: Members whose mean is the pivot of a large component.
PIVOT = 64
CHANGE = 0.01
ROUNDS = 4
AUDIT = 256
RECALL = 0.99


def unit(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the unit vector as little-endian doubles (null where it takes no part)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for e in batch["embedding"]:
                x = np.array([np.nan if v is None else v for v in e] if e is not None else [], dtype=np.float64)
                scale = np.abs(x).max() if len(x) else 0.0
                x = x / scale if scale and np.isfinite(scale) else x
                norm = math.sqrt(float(x @ x)) if len(x) else 0.0
                out.append((x / norm).astype("<f8").tobytes() if norm and np.isfinite(norm) else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "v": out})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(read, "vec_id long, v binary")


def _stack(column: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _rough(column: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), -1)


def rough(classes: DataFrame) -> DataFrame:
    """classes with `v` in single precision."""

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[np.frombuffer(v, dtype="<f8").astype("<f4").tobytes() for v in batch["v"]])

    return classes.select("node", "v").mapInPandas(cast, "node long, v binary")


def first_lists(placed: DataFrame, n: int, seed: list[int]) -> DataFrame:
    """placed: node, v, component, wanted. Returns node, other, cos: for wanted nodes, the nearest LIST of other
    components inside each leaf of the trees.
    """
    planes = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                v = _rough(part["v"].tolist())
                for tree in range(TREES):
                    normal = np.random.default_rng([*seed, tree, int(dim)]).standard_normal((v.shape[1], planes))
                    code = ((v @ normal) > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(v), dtype=np.int64)
                    kept = {c: part[c].to_numpy() for c in ("node", "v", "component", "wanted")}
                    yield pd.DataFrame({"tree": tree, "dim": int(dim), "leaf": code, **kept})

    def nearest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v, nodes = _rough(frame["v"].tolist()), frame["node"].to_numpy()
        wanted, component = np.flatnonzero(frame["wanted"].to_numpy()), frame["component"].to_numpy()
        k = min(LIST, len(nodes) - 1)
        if k < 1 or not len(wanted):
            return pd.DataFrame({"node": [], "other": [], "cos": []}).astype({"node": "int64", "other": "int64"})
        cos = v[wanted] @ v.T
        cos[component[wanted][:, None] == component[None, :]] = -2
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        out = pd.DataFrame({"node": np.repeat(nodes[wanted], k), "other": nodes[top].ravel(), "cos": np.take_along_axis(cos, top, axis=1).ravel()})
        return out[out["cos"] > -2]

    rows = placed.select("node", "v", "component", "wanted")
    rows = rows.mapInPandas(leaves, "tree int, dim int, leaf long, node long, v binary, component long, wanted boolean")
    rows = materialize(rows, "leaves")
    sizes = rows.groupBy("tree", "dim", "leaf").agg(F.count("*").alias("size"))
    parts = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / (2 * LEAF)))
    dealt = rows.join(sizes, ["tree", "dim", "leaf"])
    # one key, so that the parts of a large leaf are dealt to different tasks
    cell = F.concat_ws("-", "tree", "dim", "leaf", parts)
    return dealt.select(cell.alias("cell"), "node", "v", "component", "wanted").groupBy("cell").applyInPandas(nearest, "node long, other long, cos double")


def best(edges: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    once = edges.groupBy("node", "other").agg(F.max("cos").alias("cos"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def both_ways(lists: DataFrame) -> DataFrame:
    """node, member: the nearest 2 x LIST among a node's list and the nodes that list it."""
    back = lists.select(F.col("other").alias("node"), F.col("node").alias("other"), "cos")
    return best(lists.select("node", "other", "cos").unionByName(back), 2 * LIST).select("node", F.col("other").alias("member"))


def descend(placed: DataFrame, lists: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """One round: the lists after all local joins. inner: node, member, further members of the local joins."""
    bar = lists.groupBy("node").agg(F.when(F.count("*") == LIST, F.min("cos")).otherwise(-2.0).alias("bar"))
    around = both_ways(lists)
    if inner is not None:
        around = around.unionByName(inner.join(around.select("node").distinct(), "node", "left_semi"))
    bar_or_none = F.when(F.col("wanted"), F.coalesce("bar", F.lit(-2.0))).otherwise(2.0)  # who is not wanted takes none
    known = placed.join(bar, "node", "left").select(F.col("node").alias("member"), "v", "component", bar_or_none.alias("bar"))
    local = around.join(known, "member").groupBy("node").agg(F.collect_list(F.struct("member", "v", "component", "bar")).alias("members"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b, c = [], [], []
            for members in batch["members"]:
                if len(members) < 2:
                    continue
                v = _rough([m["v"] for m in members])
                nodes, bars = np.array([m["member"] for m in members]), np.array([m["bar"] for m in members])
                component = np.array([m["component"] for m in members])
                cos = v @ v.T
                i, j = np.nonzero((cos > bars[:, None]) & (component[:, None] != component[None, :]))
                a.append(nodes[i])
                b.append(nodes[j])
                c.append(cos[i, j])
            if a:
                yield pd.DataFrame({"node": np.concatenate(a), "other": np.concatenate(b), "cos": np.concatenate(c)})

    found = local.select("members").mapInPandas(meet, "node long, other long, cos double")
    return best(lists.select("node", "other", "cos").unionByName(found), LIST)


def settle(placed: DataFrame, lists: DataFrame, n: int, inner: DataFrame | None = None) -> DataFrame:
    """Rounds of descent until few of the places of n lists change."""
    for _ in range(ROUNDS):
        after = materialize(descend(placed, lists, inner), "lists")
        changed = after.join(lists.select("node", "other"), ["node", "other"], "left_anti").count()
        lists = after
        if changed <= CHANGE * LIST * n:
            break
    return lists


def saturated(lists: DataFrame) -> DataFrame:
    """node: those whose list is full of links."""
    ends = lists.groupBy("node").agg(F.count("*").alias("places"), F.min("cos").alias("last"))
    return ends.where((F.col("places") == LIST) & (F.col("last") >= LINK)).select("node")


def close(lists: DataFrame) -> DataFrame:
    return lists.where(F.col("cos") >= LOOSE).select(F.col("node").alias("a"), F.col("other").alias("b"))


def as_edges(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))


def enlarge(classes: DataFrame, lists: DataFrame, groups: DataFrame, n: int, seed: int) -> DataFrame:
    """The groups (node, component) after every saturated list has gone on beyond its component."""
    inner, full = None, materialize(saturated(lists), "saturated")
    for step in itertools.count(1):
        n_full = full.count()
        if not n_full:
            break
        inner = materialize(both_ways(lists), "inner") if inner is None else inner
        wanted = full.withColumn("wanted", F.lit(True))
        placed = classes.select("node", "v").join(groups, "node", "left").join(wanted, "node", "left")
        placed = placed.select("node", "v", F.coalesce("component", "node").alias("component"), F.coalesce("wanted", F.lit(False)).alias("wanted"))
        placed = materialize(placed, "placed")
        beyond = materialize(best(first_lists(placed, n, [seed, step]), LIST), "lists")
        beyond = settle(placed, beyond, n_full, inner)
        groups = materialize(components(as_edges(groups).unionByName(close(beyond))), "groups")
        full = materialize(saturated(beyond), "saturated")
    return groups


def _tile(frame: pd.DataFrame, block: np.ndarray | None) -> pd.DataFrame:
    """node, links, other of a tile; with blocks only pairs of different blocks count."""
    nodes, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    v = _stack(frame["v"].tolist())
    linked = v @ v.T >= LINK
    np.fill_diagonal(linked, False)
    if block is not None:
        linked &= block[:, None] != block[None, :]
    links = (linked * copies[None, :]).sum(axis=1)
    pairs, some = forest(linked), np.flatnonzero(links)
    a, b = np.array([nodes[i] for i, _ in pairs], dtype=np.int64), [nodes[j] for _, j in pairs]
    out = pd.DataFrame({"node": np.r_[nodes[some], a], "links": np.r_[links[some], np.zeros(len(a), dtype=np.int64)]})
    out["other"] = pd.array([None] * len(some) + b, dtype="Int64")
    return out.astype({"node": "int64", "links": "int64"})


def compare(rows: DataFrame) -> DataFrame:
    """rows: node, copies, component, v. Returns node, links (rows linked), other (forest edge or null)."""
    found = "node long, links long, other long"
    sizes = rows.groupBy("component").agg(F.count("*").alias("members"), F.sum("copies").alias("total"))
    rows = rows.join(materialize(sizes, "component-sizes"), "component")

    def small(frame: pd.DataFrame) -> pd.DataFrame:
        return _tile(frame.sort_values("node"), None)

    few = rows.where(F.col("members") <= TILE).select("component", "node", "copies", "v").groupBy("component").applyInPandas(small, found)
    large = materialize(rows.where(F.col("members") > TILE), "large-components")
    return few.unionByName(compare_large(large)) if not large.isEmpty() else few


def compare_large(rows: DataFrame) -> DataFrame:
    """rows: node, copies, component, v, members, total, of components that are no tile of their own."""
    width = math.acos(LINK) + 1e-6

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        v = _stack(frame.sort_values("node")["v"].tolist()).sum(axis=0)
        norm = float(np.linalg.norm(v))
        pivot = v / norm if norm else _stack(frame["v"].tolist()[:1])[0]
        return pd.DataFrame({"component": frame["component"].iloc[:1], "pivot": [pivot.astype("<f8").tobytes()]})

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cos = np.zeros(len(batch))
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                cos[lo : lo + 1000] = np.einsum("ij,ij->i", _stack(part["v"].tolist()), _stack(part["pivot"].tolist()))
            yield batch.drop(columns=["pivot"]).assign(angle=np.arccos(np.clip(cos, -1, 1)))

    # any direction will do as a pivot; this one is the mean of PIVOT members
    first = Window.partitionBy("component").orderBy(F.xxhash64("node"), "node")
    few = rows.select("component", "node", "v", F.row_number().over(first).alias("rank")).where(F.col("rank") <= PIVOT)
    pivots = materialize(few.select("component", "node", "v").groupBy("component").applyInPandas(mean, "component long, pivot binary"), "pivots")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(rows.join(pivots, "component").mapInPandas(turn, f"{columns}, angle double"), "turned")
    radius = placed.groupBy("component").agg(F.max("angle").alias("radius"), F.min("node").alias("root"))
    placed = placed.join(materialize(radius, "radius"), "component")
    tight = F.col("radius") <= (width - 1e-5) / 2
    whole = placed.where(tight)
    counts = whole.select("node", (F.col("total") - F.col("copies")).alias("links"), F.lit(None).cast("long").alias("other"))
    edges = whole.where("node <> root").select("node", F.lit(0).cast("long").alias("links"), F.col("root").alias("other"))
    # rings, their blocks, and the tiles of a node: its block with each block of its ring and of those that touch it
    rings = placed.where(~tight).withColumn("ring", F.floor(F.col("angle") / width).cast("int"))
    blocks = rings.groupBy("component", "ring").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    plans = blocks.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("ring", "blocks"))).alias("plan"))  # 180 / 18 rings at most
    spread = rings.join(materialize(plans, "rings"), "component")
    own = F.filter("plan", lambda r: r["ring"] == F.col("ring"))[0]["blocks"]
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), own).cast("int"))
    near = F.filter("plan", lambda r: F.abs(r["ring"] - F.col("ring")) <= 1)
    partners = F.flatten(F.transform(near, lambda r: F.transform(F.sequence(F.lit(0), r["blocks"] - 1), lambda k: F.struct(r["ring"].alias("ring"), k.alias("block")))))
    mine = F.struct("ring", "block")
    spread = spread.withColumn("mine", mine).withColumn("partner", F.explode(partners))
    key = F.concat_ws("-", "component", F.to_json(F.least("mine", "partner")), F.to_json(F.greatest("mine", "partner")))
    tiles = spread.select(key.alias("tile"), F.concat_ws("-", "ring", "block").alias("block"), "node", "copies", "v")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        block = pd.factorize(frame["block"])[0]
        return _tile(frame, block if block.max() else None)

    return counts.unionByName(edges).unionByName(tiles.groupBy("tile").applyInPandas(tile, "node long, links long, other long"))


def audit(classes: DataFrame, groups: DataFrame, seed: int) -> tuple[DataFrame, bool]:
    """Missed edges of the audited vectors (a, b), and whether the share of their links that was found meets RECALL."""
    placed = classes.select("node", "v").join(groups, "node", "left").select("node", "v", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("alone"))
    placed = materialize(placed, "audited")
    order = [F.xxhash64("node", F.lit(seed)), F.col("node")]
    asked = [r for alone in (False, True) for r in placed.where(F.col("alone") == alone).orderBy(*order).limit(AUDIT).collect()]  # 2 x AUDIT vectors
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(len(r.v), []).append(r)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                queries = by_dim.get(int(dim))
                if not queries:
                    continue
                q = _stack([r.v for r in queries])
                ids, own, alone = np.array([r.node for r in queries]), np.array([r.component for r in queries]), np.array([r.alone for r in queries])
                for lo in range(0, len(part), 2000):
                    some = part.iloc[lo : lo + 2000]
                    nodes, comps = some["node"].to_numpy(), some["component"].to_numpy()
                    link = (_stack(some["v"].tolist()) @ q.T >= LINK) & (nodes[:, None] != ids[None, :])
                    missed = link & (comps[:, None] != own[None, :])
                    i, j = np.nonzero(missed)
                    yield pd.DataFrame({"a": nodes[i], "b": ids[j], "alone": alone[j], "found": 0})
                    for kind in (False, True):
                        yield pd.DataFrame({"a": [0], "b": [0], "alone": [kind], "found": [int((link & ~missed)[:, alone == kind].sum())]})

    seen = materialize(placed.mapInPandas(look, "a long, b long, alone boolean, found long"), "audit")
    there = seen.groupBy("alone").agg(F.sum("found").alias("found"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("missed")).collect()  # two rows
    return seen.where("a <> b").select("a", "b"), all(r.found >= RECALL * (r.found + r.missed) for r in there)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows = materialize(unit(vectors), "units")
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    searched = materialize(rough(classes), "rough")
    alone = searched.select("node", "v", F.col("node").alias("component"), F.lit(True).alias("wanted"))
    lists, known = None, None
    for attempt in itertools.count():
        new = first_lists(alone, n, [attempt, 0])
        lists = new if lists is None else new.unionByName(lists.select("node", "other", "cos"))
        lists = settle(alone, materialize(best(lists, LIST), "lists"), n)
        edges = close(lists) if known is None else close(lists).unionByName(known)
        groups = enlarge(searched, lists, materialize(components(edges), "groups"), n, attempt)
        missed, enough = audit(classes, groups, attempt)
        known = as_edges(groups).unionByName(missed)
        if enough:
            break
    groups = components(known)
    held = groups.join(classes.select("node", "copies", "v"), "node")
    links = materialize(compare(materialize(held, "held")), "vector-links")
    parts = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    parts = parts.join(classes.select("node", "first_id"), "node")
    first = parts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    parts = parts.join(materialize(first, "first-ids"), "component").select("node", "component_id")
    named = classes.join(parts, "node", "left").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    named = named.select("v", F.coalesce("component_id", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    # rows of one hot vector meet its class in a plain join of written tables, which adaptive execution splits; rows without a vector meet nobody
    there = rows.where("v is not null").join(materialize(named, "named"), "v").select("vec_id", "n", "component_id")
    out = there.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
