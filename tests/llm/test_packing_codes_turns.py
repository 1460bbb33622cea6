"""Patterns, vector codes and conversation repair: hard rows, and brute force on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import codes, pattern_packing, tokens, turns
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"


# --- packing


def _whole(spark, found, texts, window):
    e = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, versions in texts.items():
        expected = []
        for text in versions:
            ids = [*e.encode(text, add_special_tokens=False).ids, 0]
            first = len(ids) % window or window
            cuts = [0, *range(first, len(ids) + 1, window)]
            expected += [(k, a, z - a, zlib.crc32(np.array(ids[a:z], dtype="<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces.pop(doc)) == sorted(expected)
    assert not pieces
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences)


def test_op11_whole_table(spark):
    texts = {r.doc_id: [r.text or ""] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = pattern_packing.op11_pattern_packing(spark, SF).collect()
    n = _whole(spark, found, texts, 2048)
    assert n <= -(-sum(r.length for r in found) // 2048) * 1.02


@pytest.mark.parametrize("window", [16, 2048])
def test_op11_hard_rows(spark, window):
    names = ["piece", "part", "length", "rank", "before", "place", "n", "start"]
    docs = spark.createDataFrame([(r[0], r[1], *["x"] * len(names)) for r in TEXTS], ["doc_id", "text", *names])
    texts = {}
    for r in TEXTS:
        texts.setdefault(r[0], []).append(r[1] or "")
    _whole(spark, pattern_packing.pack(docs.repartition(3), window=window).collect(), texts, window)
    assert pattern_packing.pack(docs.limit(0)).count() == 0


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(5)
    shapes = [rng.integers(0, 30, 65), np.eye(65, dtype=int)[33] * 1000, np.eye(65, dtype=int)[1] * 1000, (np.arange(65) % 7 == 3) * 50, np.zeros(65, dtype=int)]
    for h in shapes:
        h[0] = 0
        p = pattern_packing.plan(h)
        length = np.repeat(np.arange(65), h)
        rank = np.concatenate([np.arange(n) for n in h])
        seq, off = pattern_packing.place(p, length, rank) if len(length) else (length, length)
        cells = np.zeros((p.n_sequences, 64), dtype=int)
        for s, o, n in zip(seq, off, length):
            cells[s, o : o + n] += 1
        assert cells.max(initial=0) <= 1 and cells.sum() == length.sum()
        assert all((np.diff(row) <= 0).all() for row in cells)  # gapless from 0
        assert p.n_sequences <= 1.02 * sum(n for _, n in pattern_packing.best_fit(h.copy(), 64))


def test_fitted_counts_explain_a_histogram_of_patterns():
    rows = pattern_packing.patterns(np.arange(1, 33), 32)
    assert {tuple(r) for r in rows.tolist()} == {(a, b, 32 - a - b) for a in range(1, 33) for b in range(33) if a >= b >= 32 - a - b >= 0}
    h = np.bincount(np.r_[[20] * 90, [12] * 90, [16] * 80, [10] * 30, [11] * 60], minlength=33).astype(float)
    kept = rows[np.isin(rows, np.r_[0, np.flatnonzero(h)]).all(axis=1)]
    x = pattern_packing.fit(kept, h, 4000)
    cover = sum(np.bincount(kept[:, k], weights=x, minlength=33) for k in range(3))
    assert (x >= 0).all() and np.abs(cover - h)[1:].max() < 0.5


# --- vector codes


def brute_codes(x, parts=8, entries=16, rounds=6):
    """x: kept integers by ascending id."""
    width, out, error, books = x.shape[1] // parts, [], 0, []
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        book = part[:entries].copy()
        for _ in range(rounds):
            near = ((part[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
            for e in set(near.tolist()):
                book[e] = part[near == e].sum(axis=0) // (near == e).sum()
        d = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        out.append(d.argmin(axis=1))
        error = error + d.min(axis=1)
        books.append(book)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return ["".join(f"{c:02x}" for c in row) for row in np.array(out).T.tolist()], error.tolist(), sha


def _codes(spark, vectors):
    """Holds encode() against brute force; vectors: (id, components, label)."""
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(3)
    found = codes.with_label_errors(codes.encode(df)).toPandas().sort_values(["vec_id", "code"])
    kept = sorted(vectors, key=lambda v: (v[0] is None, v[0]))
    x = np.array([[int(np.floor(4096 * c)) for c in v[1]] for v in kept], dtype=np.int64)
    code, error, sha = brute_codes(x)
    assert sorted(zip(found.code, found.error)) == sorted(zip(code, error)) and set(found.codebooks_sha256) == {sha}
    sums = {}
    for v, e in zip(kept, error):
        sums[v[2]] = sums.get(v[2], 0) + e
    assert {None if np.isnan(k) else int(k): v for k, v in zip(found.label.astype(float), found.label_error)} == sums


def test_op12_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = {r.vec_id: r for r in codes.op12_yinyang_codes(spark, SF).collect()}
    kept = sorted(rows, key=lambda r: r.vec_id)
    code, error, sha = brute_codes(np.floor(4096 * np.array([r.embedding for r in kept], dtype=float)).astype(np.int64))
    assert [found[r.vec_id].code for r in kept] == code and [found[r.vec_id].error for r in kept] == error
    assert {r.codebooks_sha256 for r in found.values()} == {sha}


def test_op12_ties_and_copies(spark):
    rng = random.Random(3)
    # components on a coarse grid, so that distances tie often
    grid = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(600)]
    _codes(spark, grid)
    _codes(spark, [(k, [0.25] * 8, 1) for k in range(200)])
    _codes(spark, grid[:5])


def test_op12_groups_are_skipped(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)) * 0.02 + rng.choice([-1, 1], size=(2000, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    shares = codes.train(codes.integers(df))[2]
    assert shares[0] == 1 and max(shares[2:]) < 0.7


def test_op12_hard_rows(spark, edge):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7.0] * 8, 1) for k in range(20)]
    hard = [(100, None, 1), (101, [nan] * 8, 1), (102, [inf] + [0.0] * 7, 1), (103, [None] + [0.0] * 7, 1), (104, [1e300] * 8, None), (105, [1.0, 0.0], 1), (106, [], 1), (None, [0.5] * 8, None)]
    df = spark.createDataFrame([(*v, "x", "y", "z") for v in good + hard], "vec_id long, embedding array<double>, label int, entry string, ints string, sums string")
    found = {r.vec_id: r for r in codes.with_label_errors(codes.encode(df)).collect()}
    assert set(found) == {*range(20), 104, 105, 106, None}
    assert all(found[k].code is None and found[k].error is None for k in (104, 105, 106))
    assert len(found[None].code) == 16 and found[None].label_error == found[None].error == found[104].label_error
    assert codes.op12_yinyang_codes(spark, edge).where("code is not null").count() == 0  # no vector there has 8 parts
    assert codes.encode(df.limit(0)).count() == 0


# --- conversations

SPACES = " \t\n\x0b\x0c\r"


def _rows_after(rows):
    out = []
    for conv, turn, role, text in rows:
        conv, number, role, text = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        code = zlib.crc32(f"{conv}:{number}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()))


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        out.append("blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def exhaustive(rows, faults):
    """Every string of edits with at most two inserts between turns; cost, audit, lines of the best."""
    best = None
    choices = [[p * "I" + e for p in range(3) for e in ("D" if f in ("blank", "duplicate") else "DRK")] for f in faults]
    for picked in itertools.product(*choices, [p * "I" for p in range(3)]):
        audit = "".join(picked)
        options = [("", 0, ())]
        k = 0
        for letter in audit:
            new = []
            for initials, cost, lines in options:
                if letter == "I":
                    new += [(initials + r[0], cost + 2, (*lines, f"{r}:")) for r in ("user", "assistant")]
                elif letter == "D":
                    new.append((initials, cost + 3, lines))
                else:
                    extra = faults[k] == "truncated"
                    roles = [(rows[k][1], 0)][: len(rows[k][1])] if letter == "K" else [("user", 2), ("assistant", 2)]
                    new += [(initials + r[:1], cost + c + extra, (*lines, f"{r}:{rows[k][2]}")) for r, c in roles]
            k += letter != "I"
            options = new
        for initials, cost, lines in options:
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def by_state(rows, faults):
    """The same by the least (cost, audit) a state, with lines carried along."""
    follows = {"E": "user", "S": "user", "U": "assistant", "A": "user"}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(now):
        for _ in range(2):
            new = dict(now)
            for state, (cost, audit, lines) in now.items():
                put(new, follows[state][0].upper(), (cost + 2, audit + "I", (*lines, follows[state] + ":")))
            now = new
        return now

    now = {"E": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in inserted(now).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra, other = fault == "truncated", follows[state]
            put(new, other[0].upper(), (cost + 2 + extra, audit + "R", (*lines, f"{other}:{text}")))
            if role[:1] == other[0] or state == "E" and role[:1] == "s":
                put(new, role[0].upper(), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        now = new
    return min((v for s, v in inserted(now).items() if s in "EA"), key=lambda v: v[:2])


def _expected(rows, search=by_state):
    rows = _rows_after(rows)
    faults = _faults(rows)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = search(rows, faults)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _check_turns(spark, rows, search=by_state):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, pos int")
    found = {r.conv_id: tuple(r)[1:] for r in turns.repair(turns.damaged(df)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert found == {c: _expected(g, search) for c, g in groups.items()}


def test_op13_whole_table(spark):
    found = {r.conv_id: tuple(r)[1:] for r in turns.op13_turn_repair(spark, SF).collect()}
    groups = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    assert found == {c: _expected(g) for c, g in groups.items()}


def test_op13_against_all_edits(spark):
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["Yes.", "no", " ", None, "Why?", "No. "]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.choice([1, 2, 3]))]
    _check_turns(spark, rows, exhaustive)


def test_op13_hard_rows(spark, edge, empty):
    rng = random.Random(9)
    roles = ["system", "user", "assistant", "Übung", None]
    texts = ["A b c.", "a b", " ", "\t\n", "", None, "é!", "😀?", "x" * 30000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    _check_turns(spark, rows)
    assert turns.op13_turn_repair(spark, edge).count() == 6
    assert turns.op13_turn_repair(spark, empty).count() == 0


def test_op13_conversations_longer_than_a_batch(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(turns, "BATCH", 7)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "two", f"{t}.", ""])) for c, n in ((1, 40), (2, 3), (3, 90), (4, 1), (5, 14)) for t in range(n)]
    con, going, done = duckdb.connect(), None, []
    con.register("edits", turns._edits())
    table = turns.faults(turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).coalesce(1).toArrow().combine_chunks()
    (batch,) = table.to_batches()
    order = sorted(range(batch.num_rows), key=lambda k: batch.column("conv_id")[k].as_py())  # parts of several tasks
    batch = batch.take(pa.array(order))
    for lo in range(0, batch.num_rows, 7):
        *more, going = turns._advance(con, batch.slice(lo, 7), going)
        done += more
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert {o.conv_id: o.row()[1:] for o in [*done, going]} == {c: _expected(g) for c, g in groups.items()}
