"""Sequence packing with bounded space: a fixed number of open windows a partition, best-fit.

Every document becomes ids with an end id. Parts of a full window's length are windows of their own; the
rest of a document is one piece and goes to the open window with the least room that holds it. Where none
does, a new window is opened, and if that is one too many, the fullest is emitted. What is still open at a
partition's end is leftover: at most OPEN_WINDOWS windows a partition, whatever the partition holds. They
are merged in rounds of MERGE_PARTITIONS partitions each, largest piece first, and there a piece may be
cut to fill a window, so that only the last window of a merge is padded.

All metadata of a piece is worked out where its text is read; texts are never shuffled. The first pass is
written to the shared folder, and so sequence numbers stay as they are when an executor is lost.

Cases. A null or empty text is one end id. Repeated rows are packed as often as they occur, also with a
null doc_id. An empty table gives no sequences. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.session import materialize, table

#: Open windows a partition; 64 windows of 4096 ids are one megabyte.
OPEN_WINDOWS = 64
#: Partitions whose leftovers meet in one merging task: at most 8 x 64 windows, 8 MB.
MERGE_PARTITIONS = 8
#: Windows numbered by one task at most.
SPAN = 1 << 34

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, is_open boolean, ids binary"


class Packer:
    """Places pieces (any object, with a length) into windows of `size`; keeps at most `limit` open."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, piece, length: int) -> list | None:
        """Places a piece shorter than a window; returns the pieces of a window that is done, if any."""
        at = bisect.bisect_left(self.rooms, (length, -1))
        done = None
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.limit:
                done = self.held.pop(self.rooms.pop(0)[1])
            room, w = self.size, self.next
            self.next += 1
            self.held[w] = []
        self.held[w].append(piece)
        if room > length:
            bisect.insort(self.rooms, (room - length, w))
            return done
        return self.held.pop(w)

    def leftovers(self) -> list[list]:
        return [self.held[w] for _, w in self.rooms]


def pack(
    docs: DataFrame, window: int = 4096, end_id: int = 2, tokenizer: str = "word_bpe_49k.json", kind: str = "word_ends",
    open_windows: int = OPEN_WINDOWS, keep_ids: bool = True,
) -> DataFrame:
    """One row a piece, with its ids (little-endian unsigned 32-bit) where keep_ids is set.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.
    """
    from pyspark import TaskContext

    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(windows: list[list], first: int, part: int, is_open: bool) -> pd.DataFrame:
        out = []
        for k, pieces in enumerate(windows):
            offset = 0
            for doc, start, raw, total in pieces:
                n = len(raw) // 4
                out.append((doc, start, n, zlib.crc32(raw), total, first + k, offset, part, is_open, raw if keep_ids or is_open else None))
                offset += n
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.default_path(tokenizer), kind)
        part = TaskContext.get().partitionId()
        packer, number, done = Packer(window, open_windows), part * SPAN, []
        for batch in batches:
            texts = batch["text"].tolist()
            docs_ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for lo in range(0, len(texts), 256):
                for doc, got in zip(docs_ids[lo : lo + 256], encoder.many(texts[lo : lo + 256])):
                    raw = got + end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        piece = (doc, start, raw[start * 4 : (start + window) * 4], total)
                        made = [piece] if start + window <= total else packer.add(piece, total - start)
                        if made:
                            done.append(made)
                if done:
                    yield rows(done, number, part, False)
                    number, done = number + len(done), []
        left = packer.leftovers()
        if left:
            yield rows(left, number, part, True)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Fills windows with the leftover pieces, largest first, cutting a piece where a window ends."""
        frame = frame.sort_values(["length", "part", "sequence_id", "offset"], ascending=[False, True, True, True])
        windows: list[list] = [[]]
        room = window
        for r in frame.itertuples(index=False):
            doc, at, raw = None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), bytes(r.ids)
            while raw:
                if not room:
                    windows.append([])
                    room = window
                now, raw = raw[: room * 4], raw[room * 4 :]
                windows[-1].append((doc, at, now, int(r.doc_tokens)))
                at, room = at + len(now) // 4, room - len(now) // 4
        return rows(windows, -(int(key[0]) + 1) * SPAN, -1, False)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = materialize(source.mapInPandas(first_pass, PIECES), "packed")
    grouped = placed.where("is_open").groupBy(F.floor(F.col("part") / MERGE_PARTITIONS).alias("merge"))
    merged = grouped.applyInPandas(merge, PIECES)
    out = placed.where("not is_open").unionByName(merged)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def op3_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
