"""Extraction runs with their memo, blocked matches and tiled rankings on literal rows."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, comparison, extraction, extraction_run, search, topics

SYSTEM = ("Read.", "v1", "m", ["must"], ["recalls"])


def _sections(spark, n):
    rows = [(k, "(preamble)" if k == 0 else f"s. {k}", f"text {k % 5}.") for k in range(n)]
    df = spark.createDataFrame(rows, "section long, ref string, text string")
    return df.withColumn("message", F.concat(F.lit("<section>\n"), "text", F.lit("\n</section>")))


def _caller(log, failing=()):
    def call(system, message):
        with open(os.path.join(log, f"{os.getpid()}-{random.random()}"), "w") as f:
            f.write(message)
        if any(x in message for x in failing):
            raise RuntimeError("no answer")
        quote = message.split("\n")[1]
        return json.dumps({"statements": [{"verbatim_quote": quote, "summary": "s", "modality": "must", "topics": ["recalls"], "applies_to": ["food"]}]})

    return call


def _asked(log):
    return sorted(open(os.path.join(log, f)).read().split("\n")[1] for f in os.listdir(log))


def _run(spark, rows, memo, call):
    return extraction_run.run(rows, memo, call, *SYSTEM, F.array(F.lit("food")))


def test_a_second_run_asks_only_what_failed(spark, tmp_path):
    log, memo = tmp_path / "log", str(tmp_path / "memo")
    log.mkdir()
    out, kept = _run(spark, _sections(spark, 11), memo, _caller(str(log), ["text 3"]))
    first = extraction_run.report(out).first()
    assert (first["sections"], first["read"], first["cached"], first["called"], first["failed"], first["statements"]) == (11, 10, 0, 10, 2, 8)
    assert _asked(str(log)) == ["text 0.", "text 1.", "text 2.", "text 3.", "text 3.", "text 4."] and kept.count() == 8
    out, _ = _run(spark, _sections(spark, 11), memo, _caller(str(log)))
    second = extraction_run.report(out).first()
    assert (second["cached"], second["failed"], second["statements"]) == (8, 0, 10) and len(_asked(str(log))) == 7
    out, _ = extraction_run.run(_sections(spark, 11), memo, _caller(str(log)), *SYSTEM[:3], ["may"], ["recalls"], F.array(F.lit("food")))
    third = extraction_run.report(out).first()  # the answers are judged by other rules
    assert (third["cached"], third["statements"], third["rejected"]) == (10, 0, 10) and len(_asked(str(log))) == 7


def test_a_run_that_ends_in_the_middle_is_gone_on_with(spark, tmp_path, monkeypatch):
    log, memo = tmp_path / "log", str(tmp_path / "memo")
    log.mkdir()
    monkeypatch.setattr(extraction_run, "BATCH", 1)
    call_model, done = extraction.call_model, []

    def until_third(*args, **more):
        if len(done) == 3:
            raise KeyboardInterrupt
        done.append(1)
        return call_model(*args, **more)

    monkeypatch.setattr(extraction, "call_model", until_third)
    with pytest.raises(KeyboardInterrupt):
        _run(spark, _sections(spark, 11), memo, _caller(str(log)))
    before = _asked(str(log))
    monkeypatch.setattr(extraction, "call_model", call_model)
    out, _ = _run(spark, _sections(spark, 11), memo, _caller(str(log)))
    assert 0 < len(before) < 5 and _asked(str(log)) == ["text 0.", "text 1.", "text 2.", "text 3.", "text 4."]
    assert extraction_run.report(out).first()["statements"] == 10


def test_best_match_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "TILE", 4)
    rng = np.random.default_rng(3)
    sides = [[(s, k, rng.normal(size=3 if s != "c" else 3 + at).tolist()) for s in "abc" for k in range(n)] for at, n in enumerate((13, 6))]
    sides[0] += [("d", 1, [1.0]), (None, 2, [1.0]), ("a", 99, None)]
    schema = "section string, id long, v array<double>"
    found = {r.section: r.similarity for r in audit.best_match(*[spark.createDataFrame(x, schema) for x in sides], "section").collect()}
    want = {}
    for s in "ab":
        cos = np.array([v for t, _, v in sides[0] if t == s and v]) @ np.array([v for t, _, v in sides[1] if t == s]).T
        want[s] = (cos.max(axis=1).mean() + cos.max(axis=0).mean()) / 2
    assert set(found) == {"a", "b"} and all(abs(found[s] - want[s]) < 1e-12 for s in want)


def test_sections_without_statements_or_vectors(spark):
    section = "document string, ref string, sha256 string, chunk_id long, ord int"
    base = spark.createDataFrame([("d", f"s. {k}", "x", k, k) for k in range(4)] + [("d", "s. 0", "x", 9, 9)], section)
    rerun = spark.createDataFrame([("d", f"s. {k}", "x" if k < 3 else "y", 10 + k, k) for k in range(4)], section)
    said = "chunk_id long, id long, quote string, modality string, topics array<string>, v array<double>"
    b = spark.createDataFrame([(9, 1, "q", "must", ["t"], [1.0]), (1, 2, "q", "must", ["t"], None)], said)
    r = spark.createDataFrame([(10, 3, "q", "may", ["t", "u"], [0.5]), (11, 4, "q", "must", ["t"], [1.0])], said)
    read = spark.createDataFrame([(10,), (11,), (12,), (13,)], "chunk_id long")
    rows = {x.section: x for x in comparison.extraction(comparison.met_sections(base, rerun, read), b, r).collect()}
    assert set(rows) == {10, 11, 12}  # the text of the fourth is another
    assert (rows[10].quotes, rows[10].topics, rows[10].modalities, rows[10].summary) == (1.0, 0.5, 0.0, 0.5)
    assert (rows[11].summary, rows[12].summary, rows[12].quotes, rows[12].equal) == (0.0, 1.0, 1.0, True)
    assert [x.section for x in comparison.worst(comparison.extraction(comparison.met_sections(base, rerun, read), b, r), 2).collect()] == [11, 10]


def test_tiles_rank_as_one_batch_does(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(k, np.round(rng.normal(size=3), 1).tolist(), "ab"[k % 2]) for k in range(300)] + [(900, None, "a"), (901, [1.0], "a")]
    asked = [(k, np.round(rng.normal(size=3), 1).tolist(), ["a"] if k % 3 == 0 else []) for k in range(40)] + [(77, None, []), (78, [2.0], None)]
    held = spark.createDataFrame(items, "item long, v array<double>, scope string"), spark.createDataFrame(asked, "query_id long, q array<double>, only array<string>")
    rank = lambda **k: sorted((r.query_id, r["rank"], r["item"], r.score) for r in search.vector_topk(held[1], held[0], "item", 7, 6, scope="scope", **k).collect())
    for more in ({}, {"positive": True, "others": True}):
        monkeypatch.setattr(search, "QUERY_LIMIT", 20_000)
        want = rank(**more)
        monkeypatch.setattr(search, "QUERY_LIMIT", 10)
        monkeypatch.setattr(search, "TILE_QUERIES", 8)
        monkeypatch.setattr(search, "TILE_ITEMS", 64)
        assert rank(**more) == want and len(want) > 200


def test_one_table_as_both_sides(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_LIMIT", 3)
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(12)], "id long, v array<double>").withColumn("id", F.col("id") + 0)
    asked = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert search.vector_topk(asked, rows, "id", 2, others=True).count() == 12
    sides = rows.withColumn("s", F.lit("x"))
    assert audit.best_match(sides.where("id % 2 = 0"), sides.where("id % 2 = 1"), "s").count() == 1


def test_topic_listing_of_a_hot_quote(spark):
    rows = [("t", "Same  quote!", f"l{k}", k % 3, k) for k in range(50)] + [("t", "other", "o", 0, 99), ("u", "same quote", "x", 0, 100)]
    df = spark.createDataFrame(rows, "topic string, quote string, label string, rank int, id long")
    found = topics.topic_listing(df, ["topic"], "quote", "label", [F.col("rank"), F.desc("id")], ["id"], 1).collect()
    assert sorted((r.topic, r.id, r.total, r.place, len(r.also_in)) for r in found) == [("t", 99, 2, 1, 0), ("u", 100, 1, 1, 0)]
    found = topics.topic_listing(df, ["topic"], "quote", "label", [F.col("rank"), F.col("id")], ["id"], 5).where("topic = 't'").orderBy("place").collect()
    assert [r.id for r in found] == [0, 99] and found[0].also_in == [f"l{k}" for k in range(1, 50)]


def test_actions_of_repeated_and_missing_places_without_an_outer_join(spark):
    from lectern.operators import store

    columns = "version_id long, ord int, chunk_id long, section_ref string, sha256 string"
    old = [(1, 0, 10, "a", None), (2, 0, 20, "a", "x"), (2, 0, 21, "a", "x"), (3, None, 30, "a", "x"), (4, 0, 40, None, "a"), (5, 0, 50, "a", "x"), (6, 0, 60, "a", "x")]
    new = [(1, 0, 11, "a", None), (2, 0, 22, "a", "x"), (3, None, 31, "a", "x"), (4, 0, 41, "a", None), (5, 0, 51, "a", "y"), (7, 0, 70, "a", "x")]
    cited = spark.createDataFrame([(50,), (10,)], "chunk_id long")
    out = store.section_actions(spark.createDataFrame(old, columns), spark.createDataFrame(new, columns), cited)
    assert {r.version_id: r.action for r in out.collect()} == {1: "kept", 2: "kept", 3: "replaced", 4: "replaced", 5: "refused", 6: "kept", 7: "new"}
    assert "FullOuter" not in out._jdf.queryExecution().toString()


def test_a_batch_reads_its_own_messages_and_there_are_few_batches(spark, tmp_path, monkeypatch):
    log, memo = tmp_path / "log", str(tmp_path / "memo")
    log.mkdir()
    monkeypatch.setattr(extraction_run, "BATCH", 1)
    monkeypatch.setattr(extraction_run, "BATCHES", 3, raising=False)
    call_model, read = extraction.call_model, []
    monkeypatch.setattr(extraction, "call_model", lambda misses, *args, **more: read.append(misses._jdf.queryExecution().executedPlan().toString()) or call_model(misses, *args, **more))
    rows = _sections(spark, 40).withColumn("message", F.concat("message", F.col("section").cast("string")))
    out, _ = _run(spark, rows, memo, _caller(str(log)))
    report = extraction_run.report(out).first()
    assert len(read) == 3 and all("PartitionFilters: [isnotnull(batch" in plan and "Exchange" not in plan for plan in read)
    assert (report["read"], report["called"], report["statements"], len(_asked(str(log)))) == (39, 39, 39, 39)  # the first is a preamble


def test_literal_quotes_are_in_the_comparable_text_and_need_no_copy_of_it(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        text = "".join(rng.choice("aé-- \n­　") for _ in range(rng.randrange(1, 24)))
        at = rng.randrange(len(text))
        rows.append((k, text, text[at : at + rng.randrange(1, 12)]))
    df = spark.createDataFrame(rows, "section long, text string, quote string")
    found = df.select(extraction.literal(F.col("quote"), F.col("text")).alias("literal"), extraction.contained("quote", "text").alias("held")).groupBy("literal", "held").count().collect()
    assert {(r.literal, r.held) for r in found} == {(True, True), (False, True), (False, False)}
    said = df.withColumn("output", F.to_json(F.struct(F.array(F.struct(F.col("quote").alias("verbatim_quote"))).alias("statements"))))
    parsed = extraction.records(said, text="text").withColumn("literal", extraction.literal(F.col("quote"), F.col("text")))
    assert parsed.where(F.col("literal") != F.col("comparable").isNull()).count() == 0
    words = [F.lit(""), F.lit("may"), F.array(F.lit("t")), F.array(F.lit("food")), F.lit(None).cast("string")]
    reasons = [extraction.reject_reason(F.col("quote"), c, *words, ["may"], ["t"], F.array(F.lit("food")), t) for c, t in ((T.comparable("text"), None), (F.col("comparable"), F.col("text")))]
    assert parsed.where(~reasons[0].eqNullSafe(reasons[1])).count() == 0


def test_small_sections_are_matched_many_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(audit, "TILE", 2)  # parts of eight rows, so that tiles go on from one to the next
    rng = np.random.default_rng(6)
    big = 2**53  # ids that doubles don't tell apart
    sides = [[(s, big + k, rng.normal(size=3).tolist()) for s in range(60) for k in range(rng.integers(0, 6 if s % 9 else 30))] for _ in "ab"]
    frames = [spark.createDataFrame(x, "section long, id long, v array<double>") for x in sides]
    out = audit.best_match(*frames, "section")
    found = {r.section: r.similarity for r in out.collect()}
    want = {}
    for s in range(60):
        a, b = ([np.array(v) for t, _, v in x if t == s] for x in sides)
        if a and b:
            cos = np.array(a) @ np.array(b).T
            want[s] = (cos.max(axis=1).mean() + cos.max(axis=0).mean()) / 2
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-12 for s in want)
    assert "CoGroups" not in out._jdf.queryExecution().toString()
