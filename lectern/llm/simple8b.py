"""Token ids in a binary file format: Simple-8b words in blocks, written and read by Spark.

Format. A file set is a Parquet folder whose rows are chunks in ascending doc_id order; Spark's commit
protocol makes each shard whole or absent. A chunk holds whole documents (a new one starts after
CHUNK_IDS ids): `doc_ids`, `doc_lens` (ids a document, end id included), `n_ids`, `offsets` (the first
64-bit word of each block of BLOCK_IDS ids, little-endian unsigned 32-bit), `words` (little-endian
64-bit words) and `escapes` (position and value pairs, 32-bit each). A word's top four bits select how
many ids it packs and at what width (SELECTORS); the last word of a block may be padded with zeros. An
id of more than 20 bits is an escape: its place in the words holds 0, and the pair stands in `escapes`.
Every block can be decoded alone, so readers work on arrays of words without branching.

Cases. A null text is empty; an empty text is one end id. Rows with equal doc_id are ordered by a hash of the
text and all kept; a null doc_id comes first. An empty table gives an empty file set. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.session import shared_dir, table

#: Fixed values of the format: ids a word and bits an id, by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20)]
COUNTS = np.array([c for c, _ in SELECTORS])
WIDTHS = np.array([w for _, w in SELECTORS])
ESCAPE_BITS = 20
BLOCK_IDS = 1024
CHUNK_IDS = 1 << 18
#: The bit length of every id that is not an escape.
_BITS = np.frexp(np.arange(1 << ESCAPE_BITS, dtype=np.float64))[1].astype(np.int8)

FILE_SCHEMA = (
    "shard int, chunk long, doc_ids array<long>, doc_lens array<long>, n_ids long, offsets binary, words binary, escapes binary"
)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the blocks and (position, value) escapes of one chunk's ids."""
    n = len(ids)
    blocks = max(1, -(-n // BLOCK_IDS))
    over = np.flatnonzero(ids >> ESCAPE_BITS)
    escapes = np.stack([over, ids[over]], axis=1).astype("<u4")
    grid = np.zeros(blocks * BLOCK_IDS, dtype=np.uint64)
    grid[:n] = ids
    grid[over] = 0
    grid = grid.reshape(blocks, BLOCK_IDS)
    bits = _BITS[grid.astype(np.int32)]
    # the selector with the most ids whose widest id still fits, at every place of every block
    best = np.full(grid.shape, len(SELECTORS) - 1, dtype=np.int8)
    widest, span = bits, 1
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        while span < count:
            step = min(span, count - span)
            ahead = np.zeros_like(widest)
            ahead[:, :-step] = widest[:, step:]
            widest, span = np.maximum(widest, ahead), span + step
        fits = widest <= width
        if not fits.any():  # then no longer run of narrower ids fits either
            break
        best[fits] = s
    # all blocks walk their words in step
    limit = np.full(blocks, BLOCK_IDS)
    limit[-1] = n - (blocks - 1) * BLOCK_IDS
    at, rows = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    starts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    live = rows[at < limit]
    while len(live):
        starts.append(at[live].copy())
        owners.append(live)
        at[live] += COUNTS[best[live, at[live]]]
        live = live[at[live] < limit[live]]
    if not starts:
        return np.zeros(0, dtype="<u8"), np.zeros(blocks, dtype="<u4"), escapes
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    chosen = best[owner, start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([grid, np.zeros((blocks, 240), dtype=np.uint64)], axis=1)  # a last word may reach over
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == s)
        if width and len(mine):
            for k in range(count):
                words[mine] |= padded[owner[mine], start[mine] + k] << np.uint64(k * width)
    offsets = np.searchsorted(owner, rows).astype("<u4")
    return words.astype("<u8"), offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ids of one chunk; any block could be decoded alone from its offset."""
    out = np.zeros(n, dtype="<u4")
    if n:
        chosen = (words >> np.uint64(60)).astype(np.int64)
        counts = COUNTS[chosen]
        before = np.cumsum(counts) - counts
        block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
        start = before - before[offsets[block]] + block * BLOCK_IDS
        end = np.minimum(n, (block + 1) * BLOCK_IDS)
        for s, (count, width) in enumerate(SELECTORS):
            mine = np.flatnonzero(chosen == s)
            if width and len(mine):
                mask = np.uint64((1 << width) - 1)
                for k in range(count):
                    fits = mine[start[mine] + k < end[mine]]
                    out[start[fits] + k] = (words[fits] >> np.uint64(k * width)) & mask
        if len(escapes):
            out[escapes[:, 0]] = escapes[:, 1]
    return out


def write(docs: DataFrame, path: str, end_id: int = 0, tokenizer: str = "byte_bpe_50k.json", kind: str = "space_starts") -> None:
    """Encode every text, end it with end_id and write the ids in ascending doc_id order to a new folder."""
    from pyspark import TaskContext

    end = np.array([end_id], dtype="<u4").tobytes()

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.default_path(tokenizer), kind)
        number, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal chunk, held, size
            raw = b"".join(x for _, x in held)
            words, offsets, escapes = encode(np.frombuffer(raw, dtype="<u4").astype(np.uint64))
            row = pd.DataFrame(
                {
                    "shard": [number], "chunk": [chunk], "doc_ids": [[i for i, _ in held]], "doc_lens": [[len(x) // 4 for _, x in held]],
                    "n_ids": [len(raw) // 4], "offsets": [offsets.tobytes()], "words": [words.tobytes()], "escapes": [escapes.tobytes()],
                }
            )
            chunk, held, size = chunk + 1, [], 0
            return row

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for lo in range(0, len(texts), 256):
                for i, got in zip(ids[lo : lo + 256], encoder.many(texts[lo : lo + 256])):
                    held.append((i, got + end))
                    size += len(got) // 4 + 1
                    if size >= CHUNK_IDS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = [F.col("doc_id"), F.xxhash64("text")]  # one order for the borders and inside them
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.mapInPandas(shard, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32, and the ids where asked for."""
    chunks = spark.read.schema(FILE_SCHEMA).parquet(path)
    # prefix sums over one row a chunk inside each shard, then over one row a shard
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.select("shard", "chunk", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    all_before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("shard_start", F.coalesce(F.sum("total").over(all_before), F.lit(0)))
    starts = sizes.join(shards, "shard").select("shard", "chunk", (F.col("before") + F.col("shard_start")).alias("chunk_start"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = decode(
                    np.frombuffer(r.words, dtype="<u8"), np.frombuffer(r.offsets, dtype="<u4").astype(np.int64), r.n_ids,
                    np.frombuffer(r.escapes, dtype="<u4").reshape(-1, 2),
                )
                raw, lens = ids.tobytes(), np.asarray(r.doc_lens, dtype=np.int64)
                ends = np.cumsum(lens)
                cuts = list(zip(((ends - lens) * 4).tolist(), (ends * 4).tolist()))
                out = {
                    "shard": r.shard, "chunk": r.chunk, "doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "inside": ends - lens, "n_tokens": lens,
                    "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in cuts],
                }
                yield pd.DataFrame(out | ({"ids": [raw[a:b] for a, b in cuts]} if with_ids else {}))

    schema = "shard int, chunk long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = chunks.mapInPandas(unpack, schema).join(starts, ["shard", "chunk"])
    out = ["doc_id", (F.col("chunk_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return docs.select(*out, *["ids"] * with_ids)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/lectern/simple8b-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
