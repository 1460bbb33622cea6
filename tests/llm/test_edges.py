"""Every operator on hard rows and on empty tables."""

import re
import zlib

import pytest

from lectern.llm import registry

NAMES = list(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def rows(spark, edge, number):
    name = next(n for n in NAMES if n.startswith(f"op{number}_"))
    return registry.queries()[name](spark, edge).collect()


def test_op1(spark, edge):
    found = {(r.conv_id, r.segment): r for r in rows(spark, edge, 1)}
    # 1 is a prefix of 2, and 3 equals 2 with other turn numbers (its last turn is in another segment)
    assert set(found) == {(2, 0), (4, 0), (None, 0), (5, 0)}
    assert found[2, 0].n_copies == 2
    assert found[2, 0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert found[4, 0].text == "<|im_start|>unknown\n<|im_end|>\n" and found[4, 0].n_turns == 1
    assert "< |im_end|>" in found[None, 0].text
    assert found[5, 0].text.index("also") < found[5, 0].text.index("hi")


def test_op2(spark, edge):
    found = rows(spark, edge, 2)
    assert sorted((r.page_id or 0, r.n_chars) for r in found if not r.text) == [(1, 0), (2, 0), (3, 0)]
    assert next(r.text for r in found if r.page_id is None) in ("just & text <", "")
    assert len(found) == 5


def test_op3(spark, edge):
    found = rows(spark, edge, 3)
    for s in {r.sequence_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in found if r.doc_id == 1) == 2 * next(r.doc_tokens for r in found if r.doc_id == 1)
    assert [r.length for r in found if r.doc_id == 3] == [1]


def test_op4(spark, edge):
    found = rows(spark, edge, 4)
    assert len(found) == 10
    hit = next(r for r in found if r.doc_id is None)
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (1, 1, 0, 1)
    assert hit.spans.startswith("email:9:34,ip:")
    assert all(r.spans == "" for r in found if r.doc_id is not None)


def test_op5(spark, edge):
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows(spark, edge, 5)}
    assert {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (None, 1, 4, False), (9, 1, 9, True)} <= found
    assert {(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (10, 0, 10, True), (11, 0, 11, True)} <= found


def test_op6(spark, edge):
    found = rows(spark, edge, 6)
    assert all(1 <= r.n_copies <= 3 for r in found)
    budget = {(r.domain, r.language, r.origin): r.leaf_budget for r in found}
    used = {}
    for r in found:
        used[r.domain, r.language, r.origin] = used.get((r.domain, r.language, r.origin), 0) + r.n_copies * r.n_tokens
    assert all(used[k] <= budget[k] for k in used)


def test_op7(spark, edge):
    found = rows(spark, edge, 7)
    assert len(found) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)


def test_op8(spark, edge):
    found = sorted(rows(spark, edge, 8), key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in found] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 7]
    assert [r.ids_crc32 for r in found if r.doc_id in (3, 4)] == [zlib.crc32(bytes(4))] * 2


def test_op9(spark, edge):
    found = rows(spark, edge, 9)
    assert len(found) == 10 and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) for r in found)
    assert len({r.media_sha256 for r in found if r.doc_id in (1, 2)}) == 1
    assert next(r.n_bytes for r in found if r.doc_id == 3) == 0


def test_op10(spark, edge):
    found = rows(spark, edge, 10)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id in (1, 2)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in found if r.doc_id not in (1, 2))


def test_pipeline(spark, edge, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, edge)
        assert docs.columns == p.COLUMNS, name
    kept = docs.collect()
    assert sum(r.doc_id in (1, 2) for r in kept) <= 1
    assert not any(re.search("jane.doe", r.text or "") for r in kept)
    assert p.run(spark, empty).count() == 0
