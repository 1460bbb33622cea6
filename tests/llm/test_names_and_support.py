"""Columns with the names of inner ones, and what the personal-data operator makes of few and of many co-occurrences."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing, ngram_join, pii
from lectern.session import materialize

PII_NAMES = "remove generalise row_key base spans same value values terms term n_e n_t n_te share close body texts x y pii_text pii_key pii_base pii_spans".split()
MIX_NAMES = "whole last_key budget rest key bucket cap tokens root w short upto before n_copies mix_budget mix_whole mix_last mix_tokens t last".split()
JOIN_NAMES = "maybe map_word map_key text_key node sig set_key keep_id group class_id n component blocks one first_id no_id own_key".split()
ROWS = [(1, "write to jane.doe@mail.example.com about Zorblax and its matters now", "en", "src1"), (2, None, None, None), (3, "nothing here to be seen at all today", "fr", "src2")]


@pytest.mark.parametrize("names, act", [(PII_NAMES, pii.redact), (MIX_NAMES, mixing.mix), (JOIN_NAMES, ngram_join.keep_one)])
def test_clashing_columns(spark, names, act):
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"{n} string" for n in names)]))
    found = act(df).collect()
    own = [n for n in names if not n.startswith(("pii_", "mix_", "map_")) and n != "n_copies"]
    assert found and all(r[n] == "x" for r in found for n in own)


def test_find_replaces_only_its_own_columns(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in ROWS], "doc_id long, text string, lang string, source string, base string, spans string, remove string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert [s.kind for s in found[1].base] == ["email"] and found[3].spans == [] and found[2].remove == "c"


def test_a_list_that_comes_again_is_one_value(spark):
    addresses = [f"person{k}@mail{k}.example.com" for k in range(6000)]
    names = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(6000)]
    text = " ".join(f"{n} {a}" for n, a in zip(names, addresses))
    df = spark.createDataFrame([(1, text, "en", "s"), (2, text + " again", "en", "s"), *((10 + k, "plain words of no matter", "en", "s") for k in range(50))], "doc_id long, text string, lang string, source string")
    hits = materialize(pii.suspects(df)[0], "t")
    held = hits.select("pii_key", F.explode("pii_base").alias("b"))
    assert held.count() == 12000
    terms = {r.pii_key: len(r.pii_generalise) + len(r.pii_remove) for r in pii.disclosing(df, hits).collect()}
    assert len(terms) == 2 and min(terms.values()) >= 6000  # and not 6000 x 6000 pairs, which would not end


def test_a_single_row_far_from_the_value_tells_nothing(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    common = [word() for _ in range(60)]
    talk = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rare = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{talk(30)}.", "en", "s") for k in range(300)]
    # Zorblax stands beside an address in two texts; rare words stand in their other sentences, in one text each
    texts = [f"{rare(20)}. {talk(10)} Zorblax {talk(10)}. {rare(20)}. {talk(3)} person@mail.example.com {talk(3)}. {rare(20)}" for _ in range(2)]
    rows += [(500 + k, t, "en", "s") for k, t in enumerate(texts)]
    found = {r.doc_id: {s.value.lower(): s.kind for s in r.spans} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k in (500, 501):
        assert found[k].pop("person@mail.example.com") == "email"
        assert found[k] == {"zorblax": "removed"}


def test_copies_of_a_text_are_no_further_support(spark):
    rows = [(k, f"the weather of day {k} was fine and about as usual.", "en", "s") for k in range(200)]
    rows += [(500 + k, "quixotic marmalade stood there. write to solo@mail.example.com now.", "en", "s") for k in range(5)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("doc_id >= 500").collect()
    assert len(found) == 5 and all({s.value.lower() for s in r.spans} == {"solo@mail.example.com", "write", "now"} for r in found)
