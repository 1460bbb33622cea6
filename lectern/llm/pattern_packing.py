"""Packing by patterns: few-document length patterns fitted to the histogram by non-negative least squares.

Every document becomes ids with an end id; one longer than a window is cut into full windows behind a first,
shorter piece. The histogram of piece lengths has at most `window` rows, whatever the corpus holds, and is all
that the driver sees. Over it

1. all patterns of one to three lengths that fill a window exactly and occur are enumerated (at most about window^2 / 12),
2. repeat counts x >= 0 are fitted by minimising sum_l w_l ((A x)_l - h_l)^2 with accelerated projected gradients,
   whose step of each pattern is its row sum of A'WA; w_l grows with the length, as short pieces fill gaps later,
3. the counts are rounded, what a rounding leaves being carried on to the next pattern with the same longest
   length, and never beyond what the histogram still holds,
4. the rest of the histogram is packed best-fit, longest lengths first, counts at a time.

The plan that results says of each length how many of its pieces go to which pattern. Pieces of equal length
are alike, so a piece needs only its number among those of its length: tasks number their own pieces while they
read the texts, and the tasks' counts are added up by length in a window over tasks. No length is gathered in
one task, texts never move, and the numbered pieces are a written table, so a lost executor changes no number.

Cases. A null or empty text is one end id. Repeated rows are packed as often as they occur, also with a null
doc_id. An empty table gives no rows. Further columns are ignored, whatever their names. Very long texts are
encoded in groups of bounded size. Ties between equal lengths go by task and place in it; piece numbers of
a plan don't depend on them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.session import materialize, table

#: Gradient steps; what they leave is packed by step 4.
STEPS = 400
#: The largest window: its patterns are 1.4 million, 40 MB on the driver.
LARGEST = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class Plan(NamedTuple):
    """Rows of one (length, pattern) each, by length and then rank: the pieces of a length from `first` on
    (up to the next row's) go to copies of one pattern, `times` of them a copy."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    #: Number of the pattern's first sequence and where this length's pieces begin in each.
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def patterns(held: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths in `held` that add up to the window; 0 stands for none."""
    there = np.zeros(window + 1, dtype=bool)
    there[held] = True
    there[0] = True
    found = []
    lengths = np.r_[0, np.sort(held)]
    for a in held[held * 3 >= window]:
        b = lengths[(lengths <= a) & (lengths * 2 >= window - a) & (lengths <= window - a)]
        c = window - a - b
        ok = there[c]
        found.append(np.stack([np.full(int(ok.sum()), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), dtype=np.int64)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts of the patterns."""
    n = len(histogram)
    weight = np.arange(n) / n
    weight[0] = 0.0

    def cover(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], weights=x, minlength=n) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    step = 1.0 / np.maximum(back(weight * cover(np.ones(len(rows)))), 1e-12)
    x = np.zeros(len(rows))
    ahead, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(ahead - step * back(weight * (cover(ahead) - histogram)), 0.0)
        if float((new - x) @ (new - ahead)) < 0 and t > 1.0:  # the momentum points uphill
            t, ahead = 1.0, x
            continue
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whole repeat counts; takes their pieces out of `left`."""
    out = np.zeros(len(rows), dtype=np.int64)
    carry, longest = 0.5, -1
    for k in np.lexsort((-x, -rows[:, 0])).tolist():
        pattern = rows[k]
        if pattern[0] != longest:
            carry, longest = 0.5, pattern[0]
        carry += x[k]
        want = int(carry)
        if want:
            lengths, times = np.unique(pattern[pattern > 0], return_counts=True)
            got = min(want, int((left[lengths] // times).min()))
            left[lengths] -= got * times
            out[k] = got
            carry -= want
    return out


def best_fit(left: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with their repeat counts for all that is left, longest lengths first."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}  # open windows of equal room: contents, count
    for length in np.flatnonzero(left)[::-1].tolist():
        n, moved = int(left[length]), []
        for room in sorted(r for r in rooms if r >= length):
            each, held = room // length, rooms.pop(room)
            while held and n:
                contents, count = held.pop()
                full = min(count, n // each)
                if full:
                    moved.append((room - each * length, {**contents, length: each}, full))
                    n, count = n - full * each, count - full
                if count and n:  # fewer than fill one window
                    moved.append((room - n * length, {**contents, length: n}, 1))
                    n, count = 0, count - 1
                if count:
                    held.append((contents, count))
            if held:
                rooms[room] = held
            if not n:
                break
        each = window // length
        for times, count in ((each, n // each), (n % each, 1 if n % each else 0)):
            if count:
                moved.append((window - times * length, {length: times}, count))
        for room, contents, count in moved:
            rooms.setdefault(room, []).append((contents, count))
    return [entry for room in sorted(rooms) for entry in rooms[room]]


def plan(histogram: np.ndarray) -> Plan:
    """How the pieces of each length are dealt to sequences; histogram[l] pieces have length l."""
    window = len(histogram) - 1
    if window > LARGEST:
        raise ValueError(f"windows of more than {LARGEST} ids have too many patterns")
    left = histogram.astype(np.int64).copy()
    rows = patterns(np.flatnonzero(left), window)
    counts = rounded(rows, fit(rows, left.astype(float)), left) if len(rows) else np.zeros(0, dtype=np.int64)
    chosen = [(dict(zip(*(v.tolist() for v in np.unique(p[p > 0], return_counts=True)))), int(n)) for p, n in zip(rows[counts > 0], counts[counts > 0])]
    out, sequence = [], 0
    for contents, count in chosen + best_fit(left, window):
        offset = 0
        for length in sorted(contents, reverse=True):
            out.append((length, count * contents[length], contents[length], sequence, offset))
            offset += length * contents[length]
        sequence += count
    cells = np.array(sorted(out, key=lambda r: (r[0], r[3])), dtype=np.int64).reshape(-1, 5)
    before = np.cumsum(cells[:, 1]) - cells[:, 1]
    begins = np.searchsorted(cells[:, 0], cells[:, 0], side="left")
    return Plan(cells[:, 0], before - before[begins] if len(cells) else before, cells[:, 2], cells[:, 3], cells[:, 4], sequence)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of the pieces with these lengths and numbers among those of their length."""
    span = int(p.first.max(initial=0)) + 1
    ranks = np.minimum(rank, span - 1)  # beyond the last row's first the row stays the same
    at = np.searchsorted(p.length * span + p.first, length * span + ranks, side="right") - 1
    inside = rank - p.first[at]
    return p.sequence[at] + inside // p.times[at], p.offset[at] + inside % p.times[at] * length


def pieces(docs: DataFrame, window: int, end_id: int, tokenizer: str, kind: str) -> DataFrame:
    """One row a piece, with its task and its number among the task's pieces of that length."""
    from pyspark import TaskContext

    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.default_path(tokenizer), kind)
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            texts = batch["text"].tolist()
            for lo in range(0, len(texts), 256):
                out = []
                for doc, got in zip(ids[lo : lo + 256], encoder.many(texts[lo : lo + 256])):
                    raw = got + end
                    total = len(raw) // 4
                    start, k = 0, 0
                    while start < total:
                        n = (total - start) % window or window  # only the first is shorter
                        out.append((doc, k, start, n, zlib.crc32(raw[start * 4 : (start + n) * 4]), part, seen[n]))
                        seen[n] += 1
                        start, k = start + n, k + 1
                frame = pd.DataFrame(out, columns=names)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(cut, PIECES)


def pack(docs: DataFrame, window: int = 2048, end_id: int = 0, tokenizer: str = "byte_bpe_50k.json", kind: str = "space_starts") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, window, end_id, tokenizer, kind), "pieces")
    counted = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r.length] = r.n
    dealt = plan(histogram)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counted.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sequence_id"], batch["offset"] = place(dealt, batch["length"].to_numpy(), batch.pop("rank").to_numpy())
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    numbered = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return numbered.mapInPandas(placed, out)


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
