"""A store follows its source: what is derived, what is read, what is left after a change."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, search

SCHEMA = "id long, text string"


def _rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), SCHEMA)


@pytest.fixture
def embedded(spark, tmp_path):
    """A store of vectors and the texts that were embedded for it, in order."""
    seen = []

    def make(rows):
        seen.append(sorted(r.text or "" for r in rows.collect()))
        return {"vectors": search.hash_vectors(rows, "id", "text")}

    return index.Store(spark, str(tmp_path / "store"), "id", ["text"], make), seen


def _held(store):
    return {r.id: tuple(r.v) for r in store.table("vectors").collect()}


def _anew(spark, texts):
    return {r.id: tuple(r.v) for r in search.hash_vectors(_rows(spark, texts), "id", "text").collect()}


def test_only_new_and_changed_texts_are_embedded(spark, embedded):
    store, seen = embedded
    texts = {k: f"text number {k}" for k in range(40)}
    assert store.update(_rows(spark, texts)) == {"new": 40, "changed": 0, "gone": 0, "same": 0, "derived": 40}
    assert store.update(_rows(spark, texts)) == {"new": 0, "changed": 0, "gone": 0, "same": 40, "derived": 0}
    texts2 = {**texts, 3: "another", 100: "added"}
    del texts2[7]
    assert store.update(_rows(spark, texts2)) == {"new": 1, "changed": 1, "gone": 1, "same": 38, "derived": 2}
    assert seen[1:] == [["added", "another"]] and _held(store) == _anew(spark, texts2)
    # back again: nothing is embedded, the old entries are alive where they lie
    assert store.update(_rows(spark, texts))["derived"] == 0
    assert len(seen) == 2 and _held(store) == _anew(spark, texts)
    # another reader of the same folder
    again = index.Store(spark, store.path, "id", ["text"], store.make)
    assert again.version == store.version and _held(again) == _held(store)


def test_compaction_copies_and_derives_nothing(spark, embedded):
    store, seen = embedded
    texts = {k: f"text number {k}" for k in range(20)}
    store.update(_rows(spark, texts))
    for k in range(6):  # with the second text more than a quarter is dead or later
        texts = {**texts, k: f"new text {k}"}
        store.update(_rows(spark, texts))
        assert _held(store) == _anew(spark, texts)
        assert sum(s.dead for s in store.segments) + sum(s.keys for s in store.segments[1:]) <= 0.25 * sum(s.keys for s in store.segments)
    assert [len(s) for s in seen] == [20, 1, 1, 1, 1, 1, 1] and len(store.segments) < 6
    store.compact()
    assert len(store.segments) == 1 and store.segments[0].keys == 20 and _held(store) == _anew(spark, texts)


def test_hard_rows(spark, embedded):
    store, _ = embedded
    rows = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (None, "no key"), (3, ""), (4, "d"), (4, "d")], SCHEMA)
    assert store.update(rows)["derived"] == 4
    assert set(_held(store)) == {1, 4}
    turned = spark.createDataFrame([(4, "d"), (3, ""), (1, "c"), (4, "d"), (2, None), (1, "a b")], SCHEMA)
    assert store.update(turned)["same"] == 4
    assert store.update(spark.createDataFrame([(4, "d")], SCHEMA)) == {"new": 0, "changed": 1, "gone": 3, "same": 0, "derived": 1}
    assert store.update(rows.limit(0))["gone"] == 1 and _held(store) == {}
    assert store.update(rows)["new"] == 4 and set(_held(store)) == {1, 4}


def test_a_lost_writer_leaves_the_version_before(spark, embedded, monkeypatch):
    store, _ = embedded
    store.update(_rows(spark, {1: "one", 2: "two"}))
    monkeypatch.setattr(index.Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.update(_rows(spark, {1: "one", 2: "zwei"}))
    monkeypatch.undo()
    again = index.Store(spark, store.path, "id", ["text"], store.make)
    assert _held(again) == _anew(spark, {1: "one", 2: "two"})
    again.update(_rows(spark, {1: "one", 2: "zwei"}))
    assert _held(again) == _anew(spark, {1: "one", 2: "zwei"})


def test_an_edit_of_equal_length_is_seen(spark):
    find = lambda word, texts: [r.id for r in search.bm25(
        spark.createDataFrame([(1, word)], "query_id long, query string"), *(lambda i: (i.postings, i.lengths))(index.of(spark, "equal", _rows(spark, texts), "id", "text")), "id"
    ).collect()]
    assert find("zebra", {1: "a zebra runs past", 2: "nothing"}) == [1]
    assert find("zebra", {1: "a camel runs past", 2: "nothing"}) == []
    assert find("camel", {1: "a camel runs past", 2: "nothing"}) == [1]


def test_words_are_indexed_without_vectors(spark):
    calls = []
    held = index.of(spark, "lazy", _rows(spark, {1: "one"}), "id", "text", embed=lambda r, k, t: calls.append(1) or search.hash_vectors(r, k, t))
    assert held.postings.count() == 1 and not calls
    assert held.renamed("id", "other").vectors.columns[0] == "other" and calls == [1]
    assert held.vectors.where(F.col("id") == 1).count() == 1 and calls == [1]


def test_words_are_counted_where_documents_lie(spark, tmp_path):
    """A document's words are a row: none are dealt out, and their ranking is that of the postings."""
    texts = {k: f"Élan vital number {k} of the recall{'s' * (k % 3)}, élan again" + " toy" * (k % 5) for k in range(60)} | {90: "", 91: None, 92: "x élan_toy"}
    rows = spark.createDataFrame([(k, t, "recall of toys" if k % 2 else None) for k, t in texts.items()], "id long, text string, heading string")
    counts = search.term_counts(rows, "id", "text", "heading")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in search.hash_vectors(rows, "id", "text")._jdf.queryExecution().executedPlan().toString()
    listed = lambda df: sorted(map(tuple, df.collect()))
    again = rows.unionByName(rows.where("id % 7 = 1"))  # keys that come twice
    for some in (rows, again):
        found = search.term_counts(some, "id", "text", "heading")
        posts = search.postings(some, "id", "text", "heading").select("term", "id", "tf_heading", "tf_text")
        assert listed(search.postings_from(found, "id")) == listed(posts)
        lengths = search.lengths_from(posts, some, "id")
        assert listed(search.lengths_from_counts(found, "id")) == listed(lengths)
        asked = spark.createDataFrame([(1, "recall élan"), (2, "toy toys éé"), (3, "x number"), (4, "the"), (5, "nowhere")], "query_id long, query string")
        want = search.bm25_topk(asked, posts, lengths, "id", 7, 6)
        assert listed(search.counts_topk(asked, found, "id", 7, 6).select("query_id", "rank", "id", "score")) == listed(want.select("query_id", "rank", "id", "score"))
        monkey = search.PHRASES
        try:
            search.PHRASES = 0  # by the postings
            assert listed(search.counts_topk(asked, found, "id", 7, 6).select("query_id", "rank", "id", "score")) == listed(want.select("query_id", "rank", "id", "score"))
        finally:
            search.PHRASES = monkey


def test_vectors_of_repeated_keys_count_all_their_rows(spark):
    rows = spark.createDataFrame([(1, "one two"), (1, "two three"), (2, "one"), (3, "")], "id long, text string")
    whole = spark.createDataFrame([(1, "one two two three"), (2, "one"), (3, None)], "id long, text string")
    vectors = lambda df: {r.id: list(r.v) for r in search.hash_vectors(df, "id", "text").collect()}
    assert vectors(rows) == vectors(whole) and set(vectors(whole)) == {1, 2}
