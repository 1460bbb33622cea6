"""Containment by fingerprints against looking for every quote in every text."""

import random

import numpy as np
import pytest

from lectern.operators import quotes

TEXTS = "id long, text string"
ASKED = "quote_id long, quote string"


def _check(spark, texts, asked):
    found = quotes.containing(spark.createDataFrame(texts, TEXTS), "id", "text", spark.createDataFrame(asked, ASKED))
    want = sorted((q, k) for q, quote in asked for k, t in texts if None not in (quote, k, t) and quote in t)
    assert sorted((r.quote_id, r.id) for r in found.collect()) == want
    return want


@pytest.mark.parametrize("held", [quotes.HELD, 0])
def test_quotes_of_all_lengths(spark, monkeypatch, held):
    monkeypatch.setattr(quotes, "HELD", held)
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 5, 60, 400])))) for k in range(40)] + [(40, None), (None, "abé"), (1, "abé" * 30), (1, "abé" * 30)]
    whole = [t for _, t in texts if t]
    asked = [(0, ""), (1, None), (2, "not in any of the texts, and longer than the longest window of them all"), (3, "zz")]
    for n in [1, 2, 7, 14, 15, 16, 46, 47, 48, 200]:
        for _ in range(3):
            t = rng.choice([t for t in whole if len(t) >= n])
            at = rng.randrange(len(t) - n + 1)
            asked += [(len(asked), t[at : at + n]), (len(asked) + 1, t[at : at + n - 1] + "x")]
    asked.append((len(asked), asked[4][1]))
    assert len(_check(spark, texts, asked)) > 200


def test_no_quotes_or_texts(spark):
    assert _check(spark, [(1, "a")], [(1, None)]) == []
    assert _check(spark, [(1, None)], [(1, "a"), (2, "")]) == []
    assert _check(spark, [(1, "a"), (2, "")], [(1, "")]) == [(1, 1), (1, 2)]


def test_common_beginnings_make_no_pairs(spark):
    head = "all of these quotes and texts begin in one and the same way, word for word, and then "
    texts = [(k, head + f"goes on to {k} in its own words, which are not those of any other text {k}") for k in range(300)]
    asked = [(k, t) for k, t in texts]
    rows = spark.createDataFrame(asked, ASKED)
    pairs = quotes._candidates(spark.createDataFrame(texts, TEXTS), "id", "text", rows.select("quote").distinct(), *quotes.LEVELS[0])
    assert pairs.count() < 1000  # of 90,000
    assert len(_check(spark, texts, asked)) == 300


def test_every_window_has_its_least_hash():
    rng = np.random.default_rng(1)
    for n in (46, 47, 48, 100, 333):
        text = "".join(map(chr, rng.integers(97, 123, n)))
        found = set(quotes.fingerprints(text, 16, 32).tolist())
        for at in range(n - 46):
            assert set(quotes.fingerprints(text[at : at + 47], 16, 32).tolist()) <= found
        assert bool(found) == (n >= 47)


def test_short_quotes_leave_nothing_on_disk_but_pairs(spark, monkeypatch):
    names, write = [], quotes.materialize
    monkeypatch.setattr(quotes, "materialize", lambda df, name, *a: names.append(name) or write(df, name, *a))
    assert len(_check(spark, [(k, f"a short one, {k}") for k in range(20)], [(0, "short"), (1, "one, 1"), (2, "none")])) == 31
    assert names == ["quotes"]


def test_texts_come_in_small_arrow_batches(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], quotes.keep
    before = spark.conf.get(name)
    monkeypatch.setattr(quotes, "keep", lambda df, what: seen.append(int(spark.conf.get(name))) or write(df, what))
    assert len(_check(spark, [(k, f"text {k}") for k in range(20)], [(0, "text 1")])) == 11
    assert seen and max(seen) <= 512 and spark.conf.get(name) == before


def test_pairs_of_many_quotes_take_a_shuffle_of_quotes_alone(spark, monkeypatch):
    """Beyond HELD quotes go out in parts; fingerprints of texts, texts and the pairs of short quotes aren't dealt out."""
    monkeypatch.setattr(quotes, "HELD", 40)
    monkeypatch.setattr(quotes, "_candidates", lambda *a, **b: pytest.fail("texts' fingerprints were dealt out"))
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("abcé😀 ") for _ in range(rng.choice([0, 15, 16, 17, 300, 70_000 if k == 7 else 90])))) for k in range(60)]
    whole = [t for _, t in texts if len(t) > 40]
    asked = [(n * 100 + k, (t := rng.choice(whole))[(at := rng.randrange(len(t) - n + 1)) : at + n]) for n in range(1, 40) for k in range(6)]
    asked += [(9000, "a" * 15), (9001, "a" * 16), (9002, "a" * 17), (9003, asked[0][1])]
    assert len(_check(spark, [*texts, (99, "a" * 40), (98, "a" * 16)], asked)) > 800


def test_strings_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quotes, "_BASE", np.uint64(0))  # a gram's hash is that of its last character
    texts = [(0, "xyzab"), (1, "cab ab"), (2, "dbcb"), (3, "this text ends in the same way, or does it?")]
    asked = [(0, "ab"), (1, "cb"), (2, "db"), (3, "eb"), (4, "zab"), (5, "or does it?"), (6, "of does it?")]
    who, nos, _ = quotes._met([t for _, t in texts], quotes._plan(spark.createDataFrame(asked, "no long, quote string")))
    assert sorted(zip(nos.tolist(), who.tolist())) == sorted((q, k) for q, quote in asked for k, t in texts if quote in t)
