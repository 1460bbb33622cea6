"""Exact encoding with the public tokenizers inside tasks; equal pieces are encoded once a worker.

Both vocabularies cut a text into pieces before byte-pair merging, and no merge crosses a piece. The cuts are
found here on arrays of characters, many texts at a time; a piece of up to 16 Latin-1 characters is its own key
(two 64-bit words, so no hash stands for it) in a table of bounded size that holds its ids. Pieces that the
table lacks are encoded by the library. Longer pieces, and whatever stands between white space around another
character, go to the library as they are; so do whole texts with the spelling of a special token or with white
space outside Latin-1. tests/llm/test_exact.py holds the results against plain encoding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Pieces kept in the table; it takes about 60 bytes each.
CACHE_SIZE = 1_000_000
#: Characters worked on at once; a longer text is cut at spaces that are piece borders.
GROUP = 1 << 18
_KEY = 16
_SPACE, _LETTER, _NUMBER, _OTHER, _HARD = range(5)
_WIDE_SPACE = re.compile(r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BORDER = re.compile(r"[!-~](?= [!-~])")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _class(c: int) -> int:
    if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
        return _SPACE
    kind = unicodedata.category(chr(c))[0]
    return _HARD if c == 0 else {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)


#: Of Latin-1 characters; 0 also stands for all others.
_CLASSES = np.array([_class(c) for c in range(256)], dtype=np.int8)
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], dtype=np.uint8)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def default_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Table:
    """Ids by key: open addressing over arrays. When it is full, the pieces that came again stay."""

    def __init__(self, size: int):
        self.size = size
        self.bits = max(4, (2 * size - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.at, self.count, self.again = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
        self.ids, self.n_ids, self.held = np.zeros(1 << 16, dtype="<u4"), 0, 0

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = np.full(len(low), -1, dtype=np.int64)
        todo, slot = np.arange(len(low)), self.place(low, high)
        while len(todo):
            there = self.low[slot]
            same = (there == low[todo]) & (self.high[slot] == high[todo])
            out[todo[same]] = slot[same]
            on = (there != 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, new: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Appends pieces' ids; returns where each piece's begin."""
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        begin = self.n_ids + np.cumsum(count) - count
        self.n_ids += len(new)
        return begin

    def add(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        todo, slot = np.arange(len(low)), self.place(low, high)
        self.held += len(low)
        while len(todo):
            free = self.low[slot] == 0
            self.low[slot[free]] = low[todo[free]]
            self.high[slot[free]] = high[todo[free]]
            won = free & (self.low[slot] == low[todo]) & (self.high[slot] == high[todo])  # of several for a slot the last
            self.at[slot[won]], self.count[slot[won]] = at[todo[won]], count[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def renew(self) -> None:
        """Keeps what came again since the last time, if that leaves room."""
        kept = np.flatnonzero(self.again)
        low, high, at, count, ids = self.low[kept], self.high[kept], self.at[kept], self.count[kept], self.ids
        self.clear()
        if 0 < len(kept) <= self.size // 2:
            new = ids[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            self.add(low, high, self.put(new, count), count)


class _Cached:
    """ids(text) gives little-endian unsigned 32-bit ids."""

    #: Whether letters are lowered before anything else.
    lowers = False

    def __init__(self, tokenizer, size: int = CACHE_SIZE):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.model, self.size = tokenizer, tokenizer.model, size
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(1, 256)}
        self.table = _Table(size)
        self.long: dict[str, np.ndarray] = {}
        self.long_size = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def many(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = []
        parts: list[str] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            out.append([])
            if any(s in text for s in self.special) or not _latin(text) and _WIDE_SPACE.search(text):
                out[k].append(self.whole(text))
                continue
            for part in self._parts(text):
                parts.append(part)
                owners.append(k)
                size += len(part)
                if size >= GROUP:
                    for o, raw in zip(owners, self._group(parts)):
                        out[o].append(raw)
                    parts, owners, size = [], [], 0
        if parts:
            for o, raw in zip(owners, self._group(parts)):
                out[o].append(raw)
        return [b"".join(p) for p in out]

    def _parts(self, text: str) -> Iterable[str]:
        at = 0
        while len(text) - at > 2 * GROUP:
            m = _BORDER.search(text, at + GROUP)
            if m is None:
                break
            yield text[at : m.end()]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text

    def _group(self, texts: list[str]) -> list[bytes]:
        text = "".join(texts)
        try:
            raw = np.frombuffer(text.encode("latin-1") + bytes(_KEY), dtype=np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            raw = np.r_[np.where(points < 256, points, 0).astype(np.uint8), np.zeros(_KEY, dtype=np.uint8)]
        raw = _LOWER[raw] if self.lowers else raw
        b = raw[:-_KEY]
        firsts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        kinds = _CLASSES[b]
        before = np.r_[np.int8(-1), kinds[:-1]]
        before[firsts] = -1
        after = np.r_[kinds[1:], np.int8(-1)]
        after[firsts[1:] - 1] = -1
        cuts = self.cuts(b, kinds, before, after)
        if (kinds == _HARD).any():  # up to the next white space all is one piece
            words = (kinds != _SPACE) & ((before == _SPACE) | (before == -1))
            number = np.cumsum(words)
            hard = np.zeros(number[-1] + 1, dtype=bool)
            hard[number[kinds == _HARD]] = True
            cuts &= ~(hard[number] & (kinds != _SPACE) & ~words)
        start = np.flatnonzero(cuts)
        length = np.diff(np.r_[start, len(b)])
        start, length = self.held(start, length, kinds)
        # where no two texts share a piece, a text's pieces are a range
        bounds = np.searchsorted(start, np.r_[firsts, len(b)])
        at, count = self._ids(text, raw, start, length, kinds)
        before_piece = np.cumsum(count) - count
        total = int(count.sum())
        found = self.table.ids[np.repeat(at - before_piece, count) + np.arange(total)].tobytes()
        ends = np.r_[before_piece, total][bounds] * 4
        return [found[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _ids(self, text: str, raw: np.ndarray, start: np.ndarray, length: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in the table's ids, and how many there are."""
        t = self.table
        if t.held + len(start) > self.size or t.n_ids > 16 * self.size:
            t.renew()
        if len(start) > self.size:  # a small table, as in tests
            t.clear()
        easy = length <= _KEY
        if (kinds == _HARD).any():
            easy &= np.add.reduceat(kinds == _HARD, start) == 0 if len(start) else easy
        at, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        windows = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        few = np.flatnonzero(easy)
        s, n = start[few], length[few]
        low = windows[s] & _MASKS[np.minimum(n, 8)]
        high = np.where(n > 8, windows[np.minimum(s + 8, len(windows) - 1)] & _MASKS[np.maximum(n - 8, 0)], np.uint64(0))
        slot = t.find(low, high)
        missing = np.flatnonzero(slot < 0)
        t.again[slot[slot >= 0]] = True
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            new = np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]
            first = order[new]
            body, ids, counts = raw.tobytes().decode("latin-1"), [], []
            for a, k in zip(s[first].tolist(), n[first].tolist()):
                found = self.model.tokenize(body[a : a + k].translate(self.spelling))
                ids += [x.id for x in found]
                counts.append(len(found))
            ids, counts = np.array(ids, dtype="<u4"), np.array(counts)
            t.add(low[first], high[first], t.put(ids, counts), counts)
            slot[missing] = t.find(low[missing], high[missing])
        at[few], count[few] = t.at[slot], t.count[slot]
        many = np.flatnonzero(~easy)
        if len(many):
            spelt = [text[a : a + k] for a, k in zip(start[many].tolist(), length[many].tolist())]
            if self.long_size > 2 * self.size:
                self.long, self.long_size = {}, 0
            known = self.long
            for w in set(spelt).difference(known):
                known[w] = np.frombuffer(self.whole(w), dtype="<u4")
                self.long_size += len(w)
            count[many] = [len(known[w]) for w in spelt]
            at[many] = t.put(np.concatenate([known[w] for w in spelt]), count[many])
        return at, count

    def cuts(self, b: np.ndarray, kinds: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; `before` and `after` are -1 at a text's ends."""
        raise NotImplementedError

    def held(self, start: np.ndarray, length: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that have ids."""
        return start, length


def _contracted(cuts: np.ndarray, b: np.ndarray, free: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The cuts with 's 't 'm 'd 're 've 'll as pieces, where the mark is one at which a piece may begin (free)."""
    marks = np.flatnonzero((b == 39) & free)
    if not len(marks):
        return cuts
    ahead = np.r_[b, np.zeros(3, dtype=np.uint8)]
    ends = np.r_[before == -1, np.ones(3, dtype=bool)]  # another text begins there
    one, two = np.where(ends[marks + 1], 0, ahead[marks + 1]), np.where(ends[marks + 1] | ends[marks + 2], 0, ahead[marks + 2])
    short = np.isin(one, [115, 116, 109, 100])
    long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
    out = np.r_[cuts, np.zeros(3, dtype=bool)]
    out[marks[short | long] + 1] = False
    out[marks[short] + 2] = True
    out[marks[long] + 3] = True
    return out[: len(b)]


class WordEnds(_Cached):
    """Lower-casing vocabulary with word ends: white space is dropped, a digit is a piece of its own."""

    lowers = True

    def cuts(self, b, kinds, before, after):
        return _contracted((kinds != before) | (kinds == _NUMBER), b, before != _OTHER, before)

    def held(self, start, length, kinds):
        kept = kinds[start] != _SPACE
        return start[kept], length[kept]


class SpaceStarts(_Cached):
    """Byte-level vocabulary: a piece takes one space before it; of more white space the last stands apart."""

    def cuts(self, b, kinds, before, after):
        spaced = np.r_[False, b[:-1] == 32] & (before == _SPACE)
        space = kinds == _SPACE
        out = np.where(space, (before != _SPACE) | (after > _SPACE), (kinds != before) & ~spaced)
        return _contracted(out, b, ~spaced & (before != _OTHER), before)


_LOADED: dict[str, _Cached] = {}


def encoder(path: str, kind: str) -> _Cached:
    """One encoder a worker process; kind is "word_ends" or "space_starts"."""
    if path not in _LOADED:
        _LOADED[path] = {"word_ends": WordEnds, "space_starts": SpaceStarts}[kind](load(path))
    return _LOADED[path]
