"""The windows of the section builder against its rules applied one block after another."""

import random
from types import SimpleNamespace

import pytest

from lectern.operators import sections
from lectern.operators.sections import Rules
from tests.sections_by_rule import sections_of

RULES = [
    Rules(),
    Rules(max_chars=20),
    Rules(section_pattern=r"(?P<ref>\d+)\. "),
    Rules(section_pattern=r"(?P<ref>\d+)\. ", section_label=r"s. \g<ref>", chapter_pattern=r"Part (?P<ref>[A-Z])", drop_preamble=True),
    Rules(section_pattern=r"(?:§ )?(?P<ref>\d+)\. ", chapter_pattern=r"# Part (?P<ref>(?P<x>[A-Z]))", chapter_label=r"[\g<x>-\2]", first_chapter="0"),
    Rules(section_pattern=r"(?P<ref>\d+)\. ", body_start="BODY", body_end="END", max_chars=30),
    Rules(chapter_pattern=r"Part (?P<ref>[A-Z])", body_start="BODY", drop_preamble=True),
]
TEXTS = ["1. one", "2. two", "1. again", "Part A", "Part B", "BODY", "END", "A title", "prose that goes on.", "lower case line", "§ 3. three", "1. a title", "2. Title", "a", "x" * 25]


def _documents(rng, levels, refs, pages):
    out = []
    for k in range(60):
        for i in range(rng.choice([1, 2, 5, 12])):
            level = rng.choice([None, None, 1, 2, 3]) if levels else None
            ref = rng.choice([None, None, "s. 1", "s. 2"]) if refs else None
            out.append((f"d{k}", i, rng.choice(TEXTS), level, ref, rng.choice([None, 1 + i // 3]) if pages else None, rng.random() < 0.1))
    return out


@pytest.mark.parametrize("n", range(len(RULES)))
def test_split_is_the_rules(spark, n):
    rules, rng = RULES[n], random.Random(n)
    rows = []
    for at, (levels, refs, pages) in enumerate([(False, False, False), (True, False, False), (True, True, False), (False, False, True)]):
        rows += [(f"{at}{r[0]}", *r[1:]) for r in _documents(rng, levels, refs, pages)]
    rng.shuffle(rows)
    found = {}
    for r in sections.split(spark.createDataFrame(rows, sections.BLOCKS), rules).collect():
        found.setdefault(r.doc_id, []).append((r.section_no, r.section_ref, tuple(r.heading_path or ()), r.text, r.error))
    want = {}
    for doc in {r[0] for r in rows}:
        blocks = [SimpleNamespace(text=r[2], level=r[3], ref=r[4], page=r[5], quoted=r[6]) for r in sorted(r for r in rows if r[0] == doc)]
        try:
            made = sections_of(blocks, rules)
            want[doc] = [(i, *s, None) for i, s in enumerate(made)] or [(0, None, (), None, "no sections")]
        except ValueError as e:
            want[doc] = [(0, None, (), None, str(e))]
    assert {d: sorted(v) for d, v in found.items()} == want


def test_plan_has_no_python(spark):
    plan = sections.split(spark.createDataFrame([("a", 0, "x", None, None, None, False)], sections.BLOCKS), RULES[3])._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_a_run_of_title_lines_moves_as_far_as_it_is_fed(spark):
    lines = ["one.", "Title", "1. Alpha", "2. Beta", "3. gamma.", "4. Delta", "5. Epsilon"]
    rows = [("d", i, t, None, None, None, False) for i, t in enumerate(lines)]
    rules = Rules(section_pattern=r"(?P<ref>\d+)\. ")
    blocks = [SimpleNamespace(text=t, level=None, ref=None, page=None, quoted=False) for t in lines]
    found = sections.split(spark.createDataFrame(rows, sections.BLOCKS), rules).orderBy("section_no").collect()
    assert [(r.section_ref, (), r.text) for r in found] == sections_of(blocks, rules)
    assert found[0].text == "one." and found[1].text == "Title"


def test_empty(spark):
    assert sections.split(spark.createDataFrame([], sections.BLOCKS), Rules()).count() == 0


def test_title_lines_stay_where_the_query_says_so(spark, tmp_path):
    import duckdb

    from lectern.plans import documents
    from tests.oracle import check

    texts = [(1, "First. line\nno stop here\nA title\nNext. line\nAnother title"), (2, "one\nA title\nNext. line"), (3, None), (4, "Next. a\nB\nNext. c")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    check(documents.section_split_lines(spark, str(tmp_path)), con, documents.SQL["section_split_lines"])
