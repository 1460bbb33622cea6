"""Which texts hold which quotes, for any number of both: quotes go out to the texts, HELD at a time.

A quote of fewer than GRAM characters is looked for by its own hash among the hashes of all grams of its length, and its
characters are compared. A longer one goes by one gram of GRAM characters, the one that is rarest among the quotes that were
seen with it; where that stands in a text, the digest of what would be the quote decides. A pass is what tells at most HELD
quotes, sent to all tasks, and one reading of the texts; only pairs come out, so neither texts nor their grams move, and
disk holds the quotes and the pairs. Pairs are two numbers until the end, in order of quotes. Ids of the shortest quotes go
out to all tasks to meet their pairs, which are most of all, so that only the pairs of others are shuffled.

Beyond PASSES passes a kind of quotes (short, long) goes by winnowed fingerprints instead: a fingerprint is the least hash of `window` neighbouring grams
of `gram` characters, and a text that holds a quote has all the quote's fingerprints. Each quote goes by one of
them, the one that the fewest texts have, and of the pairs that come out the whole quote is looked for in the text.
A quote with a fingerprint that no text has is in none. Longer quotes use longer windows and so fewer fingerprints a
text; quotes that are too short for any window are met by grams of just their length. While the quotes' fingerprints are at
most HELD these go out, so that texts pass on only what is among them; beyond that texts' fingerprints are shuffled, and
texts move once, to the pairs that the fingerprints leave. Nothing is brought together by a quote but its pairs, which are the result.

Cases. A null text or quote is in no pair; an empty quote is in every text. Repeated texts (rows of one key) give a row
each; a key that is null is looked at by no join and gives none. Equal quotes are looked for once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import arrow_rows, keep, map_parts, materialize, scratch

#: Grams and windows of quotes from gram + window - 1 characters.
LEVELS = ((16, 32), (8, 8))
#: Quotes that go out to all tasks in a pass (60 MB at most), and passes of either kind; fingerprints of quotes beyond these that do.
HELD = 1 << 20
PASSES = 64
#: Quotes from this length on go by one gram of it, shorter ones by themselves.
GRAM = 16
#: Of quotes between this length and GRAM only those places are looked at where one of them begins.
HEAD = 8
#: Ids of the shortest quotes that go out to all tasks, so that most pairs aren't shuffled to meet theirs.
SENT = 1 << 17
#: Code points that are looked at together, and pairs that are put in order together.
BLOCK, FLUSH = 1 << 16, 1 << 20
#: Stands between texts; no character has it.
BREAK = 0x110000
#: Texts of an Arrow batch; a worker holds up to two batches beside the text it is at.
BATCH_ROWS = 512
#: Copies of empty quotes, so that all texts don't meet them in one task.
SALTS = 64
_BASE, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64


def fingerprints(text: str, gram: int, window: int) -> np.ndarray:
    """The distinct fingerprints of a text; none if it is shorter than a window."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - gram + 1
    if n < window:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        h = h * _BASE + codes[k : k + n] + _U(1)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    span = 1
    while span < window:  # least of `span` neighbours, doubled until it is of `window`
        by = min(span, window - span)
        h = np.minimum(h[:-by], h[by:])
        span += by
    return np.unique(h).view(np.int64)


def _prints(rows: DataFrame, key: str, text: str, gram: int, window: int, among: np.ndarray | None = None) -> DataFrame:
    """key, print: each row's fingerprints, those in `among` (ascending) where it is given."""
    held = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fingerprints(t, gram, window) for t in batch[text]]
            if held is not None:
                all_of = held.value
                place = [np.minimum(np.searchsorted(all_of, f), len(all_of) - 1) for f in found]
                found = [f[all_of[p] == f] for f, p in zip(found, place)]
            keys = batch[key].to_numpy()[np.repeat(np.arange(len(found)), [len(f) for f in found])]
            yield pd.DataFrame({key: keys, "print": np.concatenate(found) if found else np.zeros(0, dtype=np.int64)})

    return map_parts(rows.select(key, text), read, f"{key} {rows.schema[key].dataType.simpleString()}, print long")


def _candidates(texts: DataFrame, key: str, text: str, quotes: DataFrame, gram: int, window: int, by: str = "quote") -> DataFrame:
    """key, quote (by what names it) of texts and quotes that share the quote's rarest fingerprint."""
    asked = materialize(_prints(quotes.select(F.col(by).alias(by), F.col("quote").alias("body")), by, "body", gram, window), "quote-prints")
    wanted = materialize(asked.select("print").distinct(), "prints")
    among = None
    if wanted.count() <= HELD:
        among = np.sort(np.array(wanted.toArrow()["print"].to_numpy(), dtype=np.int64))
        if not len(among):
            return quotes.select(F.lit(None).cast(texts.schema[key].dataType).alias(key), by).limit(0)
    met = _prints(texts, key, text, gram, window, among)
    met = materialize(met if among is not None else met.join(wanted, "print", "left_semi"), "text-prints")
    spread = asked.join(met.groupBy("print").agg(F.count("*").alias("texts")), "print", "left")
    best = spread.groupBy(by).agg(F.min_by("print", F.struct(F.coalesce("texts", F.lit(0)), "print")).alias("print"))
    return met.join(best, "print").select(key, by).distinct()  # rows of one key give a pair once


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in one array, BREAK after each, and where each text begins."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    codes[starts + sizes] = BREAK
    return codes, starts


def _longer(h: np.ndarray, codes: np.ndarray, at: int, gram: int) -> np.ndarray:
    """The hashes of all grams of `gram` from those of grams of `at`, which are none longer; from nothing if `at` is 0."""
    if not at:
        h, at = codes + _U(1), 1
    while at < gram:
        by = min(at, gram - at)  # hashes of two neighbours make that of both
        if by == at:
            h = h[:-by] * _U(pow(int(_BASE), by, 1 << 64)) + h[by:]
        else:
            by, h = 1, h[:-1] * _BASE + codes[at:] + _U(1)
        at += by
    return h


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - bits)).view(np.int64)


def _digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _marks(quotes: DataFrame) -> DataFrame:
    """no, print, at, size, digest of quotes (no, quote) of GRAM characters or more: a gram's hash and place, and what tells the quote.

    The gram is the one that was met least often among the quotes of the task so far.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = np.zeros(1 << 18, dtype=np.int64)
        for batch in batches:
            codes, starts = _joined(batch["quote"].tolist())
            h = _longer(None, codes.astype(np.uint64), 0, GRAM)
            slots = _slots(h, 18)
            met += np.bincount(slots, minlength=len(met))
            ends = np.r_[starts[1:], len(codes)] - 1
            at = np.array([np.argmin(met[slots[lo : hi - GRAM + 1]]) for lo, hi in zip(starts, ends)], dtype=np.int64)
            digests = [_digest(codes[lo:hi]) for lo, hi in zip(starts, ends)]
            yield pd.DataFrame({"no": batch["no"], "print": h[starts + at].view(np.int64), "at": at, "size": ends - starts, "digest": digests})

    return map_parts(quotes.select("no", "quote"), read, "no long, print long, at int, size int, digest binary", BATCH_ROWS)


def _plan(quotes: DataFrame) -> list[tuple]:
    """What tells quotes (no, quote, level; HELD at most) in texts: by length of gram, hashes in order and their quotes.

    (gram, bits, seen, hashes, nos, codes, head) of quotes that are shorter than GRAM, (..., (at, size, digest), None) of the
    others. head: bits and flags of the first HEAD characters of all that are longer than these, and shorter than GRAM.
    """
    short: dict[int, list[tuple[int, str]]] = {}
    table = quotes.where(F.length("quote") < GRAM).select("no", "quote").toArrow()
    for no, quote in zip(table["no"].to_pylist(), table["quote"].to_pylist()):
        short.setdefault(len(quote), []).append((no, quote))
    plan, head = [], (22, np.zeros(1 << 22, dtype=bool))

    def add(gram: int, h: np.ndarray, nos: np.ndarray, more) -> None:
        order = np.argsort(h, kind="stable")
        bits = min(23, max(16, int(8 * len(h)).bit_length()))
        seen = np.zeros(1 << bits, dtype=bool)
        seen[_slots(h, bits)] = True
        more = tuple(m[order] for m in more) if isinstance(more, tuple) else more[order]
        plan.append((gram, bits, seen, h[order], nos[order], more, head if HEAD < gram < GRAM else None))

    for gram, some in sorted(short.items()):
        codes = np.frombuffer("".join(q for _, q in some).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(some), gram)
        h = np.zeros(len(some), dtype=np.uint64)
        for k in range(gram):
            h = h * _BASE + codes[:, k] + _U(1)
            if k == HEAD - 1 and gram > HEAD:
                head[1][_slots(h, head[0])] = True
        add(gram, h, np.array([no for no, _ in some], dtype=np.int64), codes)
    table = _marks(quotes.where(F.length("quote") >= GRAM)).toArrow()
    if table.num_rows:
        digests = np.frombuffer(b"".join(d.as_py() for d in table["digest"]), dtype="V16")
        add(GRAM, table["print"].to_numpy().view(np.uint64), table["no"].to_numpy(), (table["at"].to_numpy(), table["size"].to_numpy(), digests))
    return plan


def _met(texts: list[str], plan: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts, numbers and gram lengths of the quotes in them, each pair once."""
    codes, starts = _joined(texts)
    wide, h, at, hashes, begin = codes.astype(np.uint64), None, 0, {}, None
    who, nos, grams = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
    for gram, bits, seen, own, names, more, head in plan:
        if len(codes) <= gram:
            break
        if head is None:
            hashes[gram] = h = _longer(h, wide, at, gram)
            at = gram
            place = np.flatnonzero(seen[_slots(h, bits)])
            mine = h[place]
        else:  # the rest is at most as long as the head
            for n in (gram - HEAD, HEAD):
                if n not in hashes:
                    hashes[n] = _longer(None, wide, 0, n)
            if begin is None:
                begin = np.flatnonzero(head[1][_slots(hashes[HEAD], head[0])])
            place = begin[: np.searchsorted(begin, len(codes) - gram, side="right")]
            mine = hashes[HEAD][place] * _U(pow(int(_BASE), gram - HEAD, 1 << 64)) + hashes[gram - HEAD][place + HEAD]
            some = np.flatnonzero(seen[_slots(mine, bits)])
            place, mine = place[some], mine[some]
        found = np.searchsorted(own, mine)
        hit = own[np.minimum(found, len(own) - 1)] == mine
        place, found = place[hit], found[hit]
        if gram < GRAM:
            text = np.searchsorted(starts, place, side="right") - 1
            # quotes of one length with one hash would be told below
            pair = text * len(own) + found
            if 8 * len(pair) > len(texts) * len(own):
                spot = np.zeros(len(texts) * len(own), dtype=np.int64)
                spot[pair] = place + 1
                pair = np.flatnonzero(spot)
                place = spot[pair] - 1
            else:
                pair, first = np.unique(pair, return_index=True)
                place = place[first]
            text, found = pair // len(own), pair % len(own)
            same = np.ones(len(place), dtype=bool)
            for k in range(gram):
                same &= codes[place + k] == more[found, k]
            twice = np.searchsorted(own, own[found], side="right") - found > 1
            if not same.all() or twice.any():  # two strings of one hash: look for all quotes of it
                doubt = np.flatnonzero(~same | twice)
                some = [(t, j) for t, i in zip(text[doubt], found[doubt]) for j in range(i, np.searchsorted(own, own[i], side="right")) if more[j].tobytes().decode("utf-32-le", "surrogatepass") in texts[t]]
                sure = same & ~twice
                text = np.r_[text[sure], np.array([t for t, _ in some], dtype=np.int64)]
                found = np.r_[found[sure], np.array([j for _, j in some], dtype=np.int64)]
        else:
            n = np.searchsorted(own, own[found], side="right") - found  # quotes that go by this gram
            found = np.repeat(found, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lo = np.repeat(place, n) - more[0][found]
            hi = lo + more[1][found]
            text = np.searchsorted(starts, np.repeat(place, n), side="right") - 1
            fits = (lo >= starts[text]) & (hi < np.r_[starts[1:], len(codes)][text])
            text, found, lo, hi = text[fits], found[fits], lo[fits], hi[fits]
            same = np.array([_digest(codes[x:y]) == more[2][i].tobytes() for x, y, i in zip(lo, hi, found)], dtype=bool)
            pair = np.unique(text[same] * len(own) + found[same])
            text, found = pair // len(own), pair % len(own)
        who.append(text)
        nos.append(names[found])
        grams.append(np.full(len(text), gram))
    return np.concatenate(who), np.concatenate(nos), np.concatenate([np.zeros(0, dtype=np.int64), *grams])


def _held_pairs(rows: DataFrame, key: str, held, most: int) -> DataFrame:
    """key, no, hot: each row with the quotes of a broadcast _plan that it holds; hot: the quote has `most` characters or fewer.

    The exact test is made where the text is. Pairs come out by quote, FLUSH of them at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0

        def pairs() -> pd.DataFrame:
            keys, nos, hot = (np.concatenate([o[k] for o in out]) for k in range(3))
            order = np.argsort(np.where(hot, nos - (1 << 62), nos))
            return pd.DataFrame({key: keys[order], "no": nos[order], "hot": hot[order]})

        for batch in batches:
            keys, texts = batch[key].to_numpy(), batch["held_text"].tolist()
            ends = np.cumsum([len(t) + 1 for t in texts]) // BLOCK
            for lo, hi in zip(cut := np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]), np.r_[cut[1:], len(texts)]):
                who, nos, grams = _met(texts[lo:hi], held.value)
                if len(who):
                    out.append((keys[lo:hi][who], nos, grams <= most))
                    n += len(who)
                if n >= FLUSH:
                    yield pairs()
                    out, n = [], 0
        if out:
            yield pairs()

    return map_parts(rows.select(key, "held_text"), read, f"{key} {rows.schema[key].dataType.simpleString()}, no long, hot boolean", BATCH_ROWS)


def _shape(level: int) -> tuple[int, int]:
    return next(((g, w) for g, w in LEVELS if g + w - 1 == level), (level, 1))


def containing(texts: DataFrame, key: str, text: str, quotes: DataFrame) -> DataFrame:
    """quote_id, key for every text that holds a quote (quote_id, quote)."""
    rows = texts.select(F.col(key), F.col(text).alias("held_text")).where("held_text is not null")
    rows = rows.where(F.col(key).isNotNull())
    quotes = quotes.select("quote_id", "quote").where("quote is not null")
    size = F.length("quote")
    level = F.lit(0)
    for gram, window in reversed(LEVELS):  # the least length of its level
        level = F.when(size >= gram + window - 1, gram + window - 1).otherwise(level)
    with scratch(texts.sparkSession), arrow_rows(texts.sparkSession, BATCH_ROWS):
        # a quote is its number from here on, so that pairs move as two numbers; one shuffle finds equal quotes
        named = quotes.withColumn("one", F.monotonically_increasing_id()).withColumn("no", F.min("one").over(Window.partitionBy("quote")))
        named = named.select("quote_id", "quote", "no", (F.col("one") == F.col("no")).alias("first"), F.when(level > 0, level).otherwise(size).alias("level"))
        named = materialize(named, "quotes")
        unique, ids = named.where("first").drop("quote_id", "first"), keep(named.select("no", "quote_id", F.length("quote").alias("size")), "quote-ids")
        sizes = {r.size: r.n for r in unique.groupBy(F.least(size, F.lit(GRAM)).alias("size")).agg(F.count("*").alias("n")).collect()}  # GRAM + 1 at most
        short, long = sum(n for k, n in sizes.items() if 0 < k < GRAM), sizes.get(GRAM, 0)
        ids_of = {r.size: r.n for r in ids.where(F.col("size") < GRAM).groupBy("size").agg(F.count("*").alias("n")).collect()}
        hot, sent = -1, 0  # lengths up to which the ids go out to all: their quotes are few, and most pairs are theirs
        while hot + 1 < GRAM and sent + ids_of.get(hot + 1, 0) <= SENT:
            hot += 1
            sent += ids_of.get(hot, 0)
        passes, left = [], []
        kinds = [((size > 0) & (size < GRAM), short), (size >= GRAM, long)]
        if short + long <= HELD:
            kinds = [(size > 0, short + long)]
        for what, n in kinds:
            parts = -(-n // (HELD - HELD // 16)) if HELD else PASSES + 1  # hashes deal them out almost evenly
            if n and parts <= PASSES:
                passes += [what & (F.pmod(F.xxhash64("quote"), F.lit(parts)) == k) for k in range(parts)]
            elif n:
                left.append(what)
        found = []
        for mine in passes:
            held = texts.sparkSession.sparkContext.broadcast(_plan(unique.where(mine)))
            found.append(keep(_held_pairs(rows, key, held, hot), "containing"))
            held.destroy()
        empty = unique.where("level = 0").select("no", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pairs = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(empty, "salt").select(key, "no", F.lit(hot >= 0).alias("hot"))
        met = None
        for what in left:
            others = unique.where(what)
            for r in others.select("level").distinct().orderBy("level").collect():  # fewer than the longest level
                mine = others.where(F.col("level") == r.level)
                some = _candidates(rows, key, "held_text", mine, *_shape(r.level), by="no").join(mine.select("no", "quote"), "no").withColumnRenamed(key, "found_key")
                met = some if met is None else met.unionByName(some)
        if met is not None:  # texts move once
            pairs = pairs.unionByName(rows.join(met, (F.col(key) == F.col("found_key")) & F.contains("held_text", F.col("quote"))).select(key, "no", (F.length("quote") <= hot).alias("hot")))
        pairs = keep(pairs, "containing")
        for more in found:
            pairs = pairs.unionByName(more)
    near = pairs.where("hot").join(F.broadcast(ids.where(F.col("size") <= hot)), "no")  # SENT at most
    far = pairs.where("not hot").join(ids.where(F.col("size") > hot), "no")
    return near.unionByName(far).select("quote_id", key)
