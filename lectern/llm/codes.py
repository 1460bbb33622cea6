"""Compression of vectors to codes: product quantisation with codebooks trained by Yinyang Lloyd, in whole numbers.

A component x becomes the integer floor(4096 x), a vector PARTS equal parts, and every part position has a
codebook of ENTRIES entries. A round assigns each part to its nearest entry and moves each entry to the floor of
its parts' mean. Entries are clustered into GROUPS groups once. Each part carries an upper bound of the distance
to its entry and one lower bound a group of the distance to any other entry in it. When entries move, the upper
bound grows by its entry's drift and each lower one shrinks by the largest drift in its group; a part whose upper
bound lies below all of them keeps its entry unseen, otherwise the upper bound is made exact, and then only groups
whose bound still fails are scanned. Bounds are doubles, widened by more than their rounding; whatever is decided
by a scan compares squared distances in 64-bit integers, ties to the lower index, so that the result is that of
plain Lloyd. A group with a bound that only ties is scanned.

The state (integers, entries, bounds) is a table that a round reads and the next one writes; the round before is
dropped then. A task adds up its parts by entry and writes that as one row, Spark sums these rows, and codebooks
(PARTS x ENTRIES entries) alone reach the driver. A lost executor costs the tasks it ran.

Cases. Rows whose vector is null or holds null or non-finite components are dropped. The first entries are those
of the smallest vec_ids, null ids last; equal ids go by their components. With fewer vectors than ENTRIES the
codebooks have as many entries as there are vectors. The dimension is that of the row with the smallest id whose
vector can be cut into PARTS parts; rows with another dimension, or with an integer beyond LARGEST (where squares
leave 64 bits), stay in the result with null code and error and take no part otherwise. Repeated rows count as
often as they occur. Rows without a label share the null label's sum. An empty table gives no rows. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import drop, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Groups of entries, each with a lower bound.
GROUPS = 4
LARGEST = 1 << 26
#: Parts of the rows with one label, whose sum each part takes from its own copy.
SALTS = 16
#: Vectors worked on at once.
BLOCK = 1 << 14
#: Bounds are widened by this share, which is far above the rounding of a square root and a sum.
SLACK = 1e-9

STATE = "vec_id long, label int, ints array<int>, entry array<int>, upper array<double>, lower array<double>"
SUMS = "part int, entry int, n long, total array<long>, looked long, held long"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integers of each vector that is kept."""
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    doubled = F.transform(x, lambda v: v.cast("double") * F.lit(float(SCALE)))
    inside = ~F.exists(doubled, lambda v: F.abs(v) > LARGEST)
    ints = F.when(inside, F.transform(doubled, lambda v: F.floor(v).cast("int")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    return rows.where(usable).select("vec_id", "label", ints.alias("ints"))


def fits(parts: int) -> Column:
    return F.col("ints").isNotNull() & (F.size("ints") > 0) & (F.size("ints") % parts == 0)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: centres far from each other, then a few rounds of Lloyd."""
    x = entries.astype(float)
    picked = [0]
    for _ in range(min(groups, len(x)) - 1):
        picked.append(int(np.argmax(((x[:, None] - x[None, picked]) ** 2).sum(axis=2).min(axis=1))))
    centres, of = x[picked], np.zeros(len(x), dtype=np.int64)
    for _ in range(5):
        of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return of


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)


def scan_all(x: np.ndarray, entries: np.ndarray, of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, the upper bound and the lower bounds from all distances."""
    d = squared(x, entries)
    entry = d.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, entry].astype(float)) * (1 + SLACK)
    return entry, upper, _lower(d, entry, of, np.arange(groups))


def _lower(d: np.ndarray, entry: np.ndarray, of: np.ndarray, which: np.ndarray) -> np.ndarray:
    """A bound below the distance to every entry of each group but one's own."""
    roots = np.sqrt(d.astype(float)) * (1 - SLACK)
    roots[np.arange(len(d)), entry] = np.inf
    return np.stack([roots[:, of == g].min(axis=1, initial=np.inf) for g in which], axis=1)


def assign(
    x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, drift: np.ndarray, of: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round of one part position: new entries, bounds, and how many distances were computed."""
    groups = lower.shape[1]
    most = np.array([drift[of == g].max(initial=0.0) for g in range(groups)])
    upper = (upper + drift[entry]) * (1 + SLACK)
    lower = np.maximum(lower - most, 0.0) * (1 - SLACK)
    entry = entry.copy()
    todo = np.flatnonzero(upper >= lower.min(axis=1))
    looked = len(todo)
    own = ((x[todo] - entries[entry[todo]]) ** 2).sum(axis=1)
    upper[todo] = np.sqrt(own.astype(float)) * (1 + SLACK)
    fails = upper[todo, None] >= lower[todo]
    some = fails.any(axis=1)
    todo, own, fails = todo[some], own[some], fails[some]
    if not len(todo):
        return entry, upper, lower, looked
    best, best_entry = own.copy(), entry[todo]
    seen = {}
    for g in range(groups):
        members, rows = np.flatnonzero(of == g), np.flatnonzero(fails[:, g])
        if not len(members) or not len(rows):
            continue
        d = squared(x[todo[rows]], entries[members])
        looked += d.size
        seen[g] = (members, rows, d)
        k = d.argmin(axis=1)
        near, which = d[np.arange(len(rows)), k], members[k]
        won = (near < best[rows]) | (near == best[rows]) & (which < best_entry[rows])
        best[rows[won]], best_entry[rows[won]] = near[won], which[won]
    before = entry[todo]
    moved = before != best_entry
    # an entry that a part has left bounds its group from now on
    left_root = np.sqrt(own[moved].astype(float)) * (1 - SLACK)
    entry[todo] = best_entry
    upper[todo] = np.sqrt(best.astype(float)) * (1 + SLACK)
    for g, (members, rows, d) in seen.items():
        roots = np.sqrt(d.astype(float)) * (1 - SLACK)
        roots[members[None, :] == best_entry[rows][:, None]] = np.inf
        lower[todo[rows], g] = roots.min(axis=1)
    at = (todo[moved], of[before[moved]])
    lower[at] = np.minimum(lower[at], left_root)
    return entry, upper, lower, looked


def _arrays(batch: pd.DataFrame, name: str, dtype) -> np.ndarray:
    return np.stack(batch[name].to_numpy()).astype(dtype)


def _round(state: DataFrame, books: np.ndarray, drift: np.ndarray | None, of: np.ndarray, groups: int) -> DataFrame:
    """The next state, with a last row a task for each part and entry that holds the task's sums."""
    parts, entries, width = books.shape
    names = [c.split()[0] for c in STATE.split(", ")]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        looked = held = 0
        for whole in batches:
            for lo in range(0, len(whole), BLOCK):
                batch = whole.iloc[lo : lo + BLOCK].reset_index(drop=True)
                x = _arrays(batch, "ints", np.int64).reshape(len(batch), parts, width)
                if drift is None:
                    found = [scan_all(x[:, p], books[p], of[p], groups) for p in range(parts)]
                    looked += len(batch) * parts * entries
                else:
                    entry, upper = _arrays(batch, "entry", np.int64), _arrays(batch, "upper", float)
                    lower = _arrays(batch, "lower", float).reshape(len(batch), parts, groups)
                    done = [assign(x[:, p], entry[:, p], upper[:, p], lower[:, p], books[p], drift[p], of[p]) for p in range(parts)]
                    found = [d[:3] for d in done]
                    looked += sum(d[3] for d in done)
                held += len(batch) * parts * entries
                for p, (entry, _, _) in enumerate(found):
                    n[p] += np.bincount(entry, minlength=entries)
                    np.add.at(total[p], entry, x[:, p])
                batch["entry"] = list(np.stack([f[0] for f in found], axis=1).astype(np.int32))
                batch["upper"] = list(np.stack([f[1] for f in found], axis=1))
                batch["lower"] = list(np.stack([f[2] for f in found], axis=1).reshape(len(batch), -1))
                batch["vec_id"], batch["label"] = batch["vec_id"].astype("Int64"), batch["label"].astype("Int32")
                batch["sums"] = None
                yield batch[[*names, "sums"]]
        if held:
            rows = [(p, e, int(n[p, e]), total[p, e].tolist(), looked if p == e == 0 else 0, held if p == e == 0 else 0) for p in range(parts) for e in range(entries)]
            last = pd.DataFrame({c: [None] for c in names}, dtype=object)
            last["sums"] = [[dict(zip(("part", "entry", "n", "total", "looked", "held"), r)) for r in rows]]
            yield last

    return state.select(*names).mapInPandas(step, f"{STATE}, sums array<struct<{SUMS.replace(' ', ':').replace(',:', ',')}>>")


def _summed(state: DataFrame, width: int) -> list:
    """Sums by part and entry over all tasks' rows."""
    rows = state.where("sums is not null").select(F.explode("sums").alias("s")).select("s.*")
    totals = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("looked").alias("looked"), F.sum("held").alias("held"), *totals).collect()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray, list[float]] | None:
    """The last state, the codebooks (part, entry, component) and each round's share of distances that were computed.

    rows: vec_id, label, ints; None if none of them can be cut into parts.
    """
    first = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    leading = rows.where(fits(parts)).select("vec_id", "ints").orderBy(*first).limit(1).collect()
    if not leading:
        return None
    width = len(leading[0].ints) // parts
    state = rows.where(fits(parts) & (F.size("ints") == width * parts))
    start = np.array([r.ints for r in state.select("vec_id", "ints").orderBy(*first).limit(entries).collect()], dtype=np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    groups = min(groups, len(start))
    of = np.stack([grouped(b, groups) for b in books])
    for empty in STATE.split(", ")[3:]:
        state = state.withColumn(empty.split()[0], F.lit(None).cast(empty.split()[1]))
    drift, shares, before = None, [], None
    for k in range(rounds + 1):
        state = materialize(_round(state, books, drift, of, groups), "codes")
        if before is not None:
            drop(before)
        before = state
        summed = _summed(state, width)
        shares.append(sum(r.looked for r in summed) / max(1, sum(r.held for r in summed)))
        if k < rounds:
            old, books = books, books.copy()
            for r in summed:
                if r.n:
                    books[r.part, r.entry] = [r[f"t{d}"] // r.n for d in range(width)]
            drift = np.sqrt(((books - old) ** 2).sum(axis=2).astype(float)) * (1 + SLACK)
        state = state.where("sums is null")
    return state, books, shares


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of each kept row."""
    rows = integers(vectors)
    trained = train(rows, parts, entries, rounds)
    if trained is None:
        return rows.select("vec_id", "label", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"))), F.lit(digest(np.zeros(0, dtype=np.int64))).alias("codebooks_sha256"))
    state, books, _ = trained
    n_parts, _, width = books.shape
    out = "vec_id long, label int, code string, error long"

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, entry = _arrays(batch, "ints", np.int64).reshape(len(batch), n_parts, width), _arrays(batch, "entry", np.int64)
            error = sum(((x[:, p] - books[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(n_parts))
            code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"].astype("Int32"), "code": code, "error": error})

    done = state.select("vec_id", "label", "ints", "entry").mapInPandas(coded, out)
    other = rows.where(~(fits(parts) & (F.size("ints") == n_parts * width)) | F.col("ints").isNull())
    rest = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return done.unionByName(rest).withColumn("codebooks_sha256", F.lit(digest(books)))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels, nulls together; a label's rows are dealt to SALTS copies of its sum."""
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    copies = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))
    return salted.join(copies, same, "left").drop("salt", "of_salt", "of_label")


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = materialize(encode(table(spark, sf_dir, "embeddings")), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
