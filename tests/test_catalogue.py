"""The catalogue of snapshots, globs and samples."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, catalogue, snapshot


def test_versions_listing_and_state(spark, tmp_path):
    at = str(tmp_path)
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    one = catalogue.publish(spark, {"documents": docs, "vectors": docs}, at, "running", "Running")
    assert (one["version"], one["counts"]) == (1, {"documents": 2})
    assert catalogue.publish(spark, {"documents": docs.orderBy(F.desc("id"))}, at, "running", "Running")["version"] == 1
    two = catalogue.publish(spark, {"documents": docs, "chunks": docs}, at, "running", "Running", files={"domain.yaml": "name: x"})
    catalogue.publish(spark, {"documents": docs}, at, "secret", "Hidden", private=True)
    assert catalogue._claimed(spark, f"{at}/running", 3)  # another publisher that is lost
    assert catalogue.publish(spark, {"documents": docs.limit(1)}, at, "running", "Running")["version"] == 4
    spark.createDataFrame([("no json",)], "value string").coalesce(1).write.text(f"{at}/broken/1/manifest")
    local = spark.createDataFrame([("running", 2), ("secret", None)], "name string, version int")
    found = {r["name"]: (r.version, r.title, r.n_rows, r.local, r.outdated, r.problem) for r in catalogue.listing(catalogue.manifests(spark, at), local).collect()}
    assert found == {
        "running": (4, "Running", 1, "v2", True, None), "secret": (1, "(private)", 2, "built here", False, None), "broken": (None, None, None, "not installed", False, "the format is unknown"),
    }
    states = catalogue.state(spark, {"documents": docs.limit(1), "reviews": docs, "postings": docs}, two)
    assert {r["name"]: r.state for r in states.collect()} == {"documents": "changed here", "reviews": "new here", "chunks": "missing here"}
    assert catalogue.summary(states, 2) == "unpublished changes"
    assert catalogue.summary(catalogue.state(spark, {"documents": docs, "chunks": docs}, two), 2) == "matches v2"
    assert snapshot.pull(spark, at, "running", 2)["chunks"].count() == 2
    assert catalogue.manifests(spark, f"{at}/nothing").count() == 0


def test_two_publishers_get_two_numbers(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", 1)], "id string, n int")
    other = spark.createDataFrame([("b", 1)], "id string, n int")
    claimed, inner = catalogue._claimed, []

    def late(*args):  # the other one publishes between this one's look and its claim
        if not inner:
            inner.append(1)
            inner.append(catalogue.publish(spark, {"documents": other}, str(tmp_path), "kb")["version"])
        return claimed(*args)

    monkeypatch.setattr(catalogue, "_claimed", late)
    assert catalogue.publish(spark, {"documents": docs}, str(tmp_path), "kb")["version"] == 2 and inner == [1, 1]
    assert [snapshot.pull(spark, str(tmp_path), "kb", v)["documents"].first().id for v in (1, 2)] == ["b", "a"]


@pytest.mark.parametrize("path", ["/etc/passwd", "../x", "eval/../../x", "sources.txt", "eval", "eval//x", "prompts/./x", "a\\b"])
def test_paths_that_are_refused(spark, tmp_path, path):
    assert catalogue.path_problem(path)
    with pytest.raises(ValueError):
        catalogue.publish(spark, {"documents": spark.range(1)}, str(tmp_path), "kb", files={path: ""})


def test_names_that_are_published(spark, tmp_path):
    assert all(catalogue.path_problem(p) is None for p in ("domain.yaml", "eval/golden.yaml", "prompts/a/b.md"))
    for tables, name in (({"secrets": spark.range(1)}, "kb"), ({"documents": spark.range(1)}, "No name")):
        with pytest.raises(ValueError):
            catalogue.publish(spark, tables, str(tmp_path), name)


def test_globs(spark):
    globs = ["*", "s. *", "a?c", "[abc]x", "[!abc]x", "a[b", "x.y", "(1)", "a+b|c", "^a$", "{a}", "a\\b", "", "art *[0-9]", "é*", "[a-]x", "a&&b"]
    texts = ["s. 1", "abc", "ax", "dx", "a[b", "x.y", "xzy", "(1)", "a+b|c", "^a$", "{a}", "a\\b", "", "art 12", "art x", "été", "-x", "a&&b", "line\nbreak"]
    rows = spark.createDataFrame([(g, t) for g in globs for t in texts], "g string, t string")
    found = {(r.g, r.t) for r in rows.where(F.rlike("t", T.glob_pattern("g"))).collect()}
    assert found == {(g, t) for g in globs for t in texts if fnmatch.fnmatchcase(t, g)}
    assert all(t.startswith(h) for g, t, h in [(r.g, r.t, r.h) for r in rows.withColumn("h", T.glob_head("g")).collect()] if (g, t) in found)


def test_parts_and_samples(spark):
    places = spark.createDataFrame([(1, 1, "gb-act", "s. 2 (part 3)"), (1, 2, "gb-act", "s. 3"), (2, 1, "se", "s. 1"), (3, 7, "se", "s. 1")], "query_id int, rank int, document string, ref string")
    wanted = spark.createDataFrame([(1, "gb-*", "s. 2"), (1, "gb-*", "s. 3"), (2, "gb-*", "*"), (3, "se", "s. 1")], "query_id int, source_glob string, section_glob string")
    assert {r.query_id: (r.hit, r.first_rank) for r in audit.glob_hits(places, wanted).collect()} == {1: (True, 1), 2: (False, None), 3: (False, None)}
    picked = [[r.id for r in audit.random_sample(spark.range(1000), "id", 20, seed).collect()] for seed in (1, 1, 2)]
    assert picked[0] == picked[1] != picked[2] and len(set(picked[0])) == 20
