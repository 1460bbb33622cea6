"""Rounds over landed bodies on literal rows, and a stream of saved files that stops and goes on."""

import hashlib

import pytest

from lectern.operators import fetching as f
from lectern.operators import sections
from lectern.streaming import ingest

HTML = {"content-type": "text/html"}
RAW = "document_id string, sha256 string, content binary"


def page(text, extra=""):
    return bytearray(f"<html><body><h1>One</h1><p>{text}</p>{extra}</body></html>".encode())


def sha(body):
    return hashlib.sha256(bytes(body)).hexdigest()


def answers(spark, rows):
    """Rows of (source, content, headers, status, final url)."""
    full = [(r + (HTML, 200, "https://a.org/x")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(s, "https://a.org/x", final, status, headers, body) for s, body, headers, status, final in full], f.RESPONSES)


def observed(spark, rows, log=(), raw=(), **more):
    sources = spark.createDataFrame([(s,) for s in sorted({r[0] for r in rows})], "source_id string")
    landed = f.received(answers(spark, rows))
    return f.observe(f.picked(sources, landed), (landed,), spark.createDataFrame(list(log), f.VERSIONS), spark.createDataFrame(list(raw), RAW), "2026-02-01T00:00:00Z", **more)


def statuses(found):
    return {r.source_id: (r.status, r.detail) for r in found.results.collect()}


def version(source, body, kind="text/html", at="2026-01-01T00:00:00Z", checked=None):
    return (source, sha(body), kind, None, None, at, checked or at)


def test_reasons_in_their_order(spark):
    body = page("text")
    rows = [
        ("http", body, HTML, 404, "http://a.org/x"), ("code", bytearray(b""), HTML, 503), ("none", body, HTML, None), ("mitigated", body, {**HTML, "cf-mitigated": "challenge"}, 403),
        ("waf", bytearray(b""), {"x-amzn-waf-action": "challenge"}, 202), ("empty", bytearray(b""), HTML), ("null", None, HTML), ("cut", body, {**HTML, "content-length": "9999"}),
        ("odd", body, {**HTML, "content-length": "x9"}), ("late", body, {**HTML, "cf-mitigated": "challenge"}), ("cloud", page("_cf_chl_opt")), ("anubis", page("", '<i id="anubis_challenge">')),
        ("both", page("_cf_chl_opt", '<i id="anubis_challenge">')), ("bare", body, None), ("fine", body, HTML, 200, None),
    ]
    got = {r.source_id: r.error for r in f.received(answers(spark, rows), 10_000).collect()}
    assert got == {
        "http": "redirected to non-https URL http://a.org/x", "code": "HTTP 503", "none": "HTTP none", "mitigated": "HTTP 403 (Cloudflare challenge)", "waf": "AWS WAF challenge (needs a browser)",
        "empty": "empty body", "null": "empty body", "cut": f"truncated: got {len(body)} of 9999 bytes", "odd": None, "late": "Cloudflare challenge page", "cloud": "Cloudflare challenge page",
        "anubis": "Anubis challenge page", "both": "Cloudflare challenge page", "bare": None, "fine": None,
    }
    assert f.received(answers(spark, [("long", body)]), len(body) - 1).first().error == f"body exceeds {len(body) - 1} bytes"
    assert f.received(answers(spark, [("long", body)]), len(body)).first().error is None


def test_pointers_name_their_item(spark):
    site = "https://repository.officiele-overheidspublicaties.nl/bwb/"
    sources = spark.createDataFrame([(x, f"{site}{x}/manifest.xml") for x in ("BWBR1", "BWBR2", "BWBR3", "BWBR4")] + [("plain", "https://a.org/manifest.xml"), ("none", None)], "source_id string, url string")
    landed = [("BWBR1", b'<m _latestItem="2026/x.xml"/>'), ("BWBR2", b'<m _latestItem="../x.xml"/>'), ("BWBR3", b"<m/>")]
    manifests = spark.createDataFrame([(x, f"{site}{x}/manifest.xml", None, 200, None, bytearray(b)) for x, b in landed], f.RESPONSES)
    got = {r.source_id: (r.target, r.error) for r in f.resolved(sources, manifests).collect()}
    unusable = (None, "the manifest names no usable item")
    assert got == {
        "BWBR1": (f"{site}BWBR1/2026/x.xml", None), "BWBR2": unusable, "BWBR3": unusable, "BWBR4": (None, "nothing landed for the manifest"),
        "plain": ("https://a.org/manifest.xml", None), "none": (None, None),
    }


def test_answers_off_the_publishers_domains(spark):
    sources = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "nobody"), ("d", "P")], "source_id string, publisher string")
    publishers = spark.createDataFrame([("P", ["a.org"])], "publisher string, domains array<string>")
    rows = [("a", page("x"), HTML, 200, "https://www.a.org/x"), ("b", page("x"), HTML, 200, "https://nota.org/x"), ("c", page("x")), ("d", page("x"), HTML, 200, None)]
    got = {r.source_id: r.error for r in f.on_publisher(f.received(answers(spark, rows)), sources, publishers).collect()}
    off = "redirected off the publisher's domains: "
    assert got == {"a": None, "b": off + "nota.org", "c": off + "a.org", "d": None}


def test_one_answer_a_source(spark):
    sources = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "source_id string")
    files = spark.createDataFrame([("a", ".html", "/in/a/x.html", page("saved"), None), ("e", ".doc", "/in/e/x.doc", page("y"), "unknown suffix")], "source string, suffix string, path string, content binary, error string")
    rows = [("a", page("asked")), ("b", page("x")), ("b", page("x")), ("c", page("x")), ("c", page("y")), ("other", page("x"))]
    got = {r.source_id: r for r in f.picked(sources, f.received(answers(spark, rows)), f.saved(files)).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": "several answers landed", "d": "nothing landed", "e": "no reader for .doc files"}
    assert got["a"].sha256 == sha(page("saved")) and got["a"].content_type == "text/html" and got["b"].sha256 == sha(page("x"))


def test_statuses_of_a_round(spark):
    old = page("text")
    bare = bytearray(b"<html><body><p>no heading</p></body></html>")
    stored = {"same": old, "markup": old, "text": old, "pdf": bytearray(b"%PDF-1"), "bare": old, "was_bare": bare, "back": page("second"), "now_pdf": old, "untyped": old, "down": old}
    kinds = {"pdf": "application/pdf", "untyped": None}
    log = [version(s, b, kinds.get(s, "text/html")) for s, b in stored.items()] + [version("back", page("first"), at="2025-01-01T00:00:00Z")]
    raw = [(s, sha(b), b) for s, b in stored.items()] + [("back", sha(page("first")), page("first"))]
    rows = [
        ("fresh", old), ("same", old), ("markup", page("text", "<!-- c --><script>1</script>")), ("text", page("other")), ("pdf", old), ("bare", bare), ("was_bare", bytearray(b"<html><p>x</p></html>")),
        ("back", page("first")), ("now_pdf", bytearray(b"%PDF-2"), {"content-type": "application/pdf"}), ("untyped", page("other")), ("down", old, HTML, 500),
    ]
    found = observed(spark, rows, log, raw)
    got = statuses(found)
    assert {s: x[0] for s, x in got.items()} == {
        "fresh": "new", "same": "unchanged", "markup": "unchanged", "text": "changed", "pdf": "failed", "bare": "failed", "was_bare": "changed", "back": "changed", "now_pdf": "changed",
        "untyped": "changed", "down": "failed",
    }
    assert got["markup"][1] == f"{sha(old)[:12]} (markup-only change {sha(rows[2][1])[:12]} ignored)" and got["text"][1] == f"{sha(old)[:12]} -> {sha(page('other'))[:12]}"
    assert got["pdf"][1].startswith("got text/html where") and "no body sections" in got["bare"][1] and got["down"][1] == "HTTP 500"
    assert {r.source_id: r.sha256 for r in found.results.collect()}["bare"] == sha(old)
    assert {r.document_id for r in found.raw.collect()} == {"fresh", "text", "was_bare", "now_pdf", "untyped"}, "a body that is stored or refused isn't stored again"
    after = {(r.document_id, r.sha256): r for r in f.versions_of(spark.createDataFrame(log, f.VERSIONS).unionByName(found.seen)).collect()}
    first = after["back", sha(page("first"))]
    assert (first.fetched_at, first.last_checked_at, first.content_type) == ("2025-01-01T00:00:00Z", "2026-02-01T00:00:00Z", "text/html")
    assert after["markup", sha(old)].last_checked_at == "2026-02-01T00:00:00Z" and ("markup", sha(rows[2][1])) not in after
    assert after["down", sha(old)].last_checked_at == "2026-01-01T00:00:00Z"
    assert f.counts(found.results).first().asDict() == {"n_new": 1, "n_changed": 5, "n_unchanged": 2, "n_failed": 3}


def test_sources_are_read_by_their_own_rules(spark):
    first, second = (bytearray(f"<p>1. Scope</p><p>text</p><p class='date'>{x}</p>".encode()) for x in ("Monday", "Tuesday"))
    log, raw = [version("a", first), version("b", first)], [(s, sha(first), first) for s in "ab"]
    readings = {"law": f.Reading(sections.Rules(section_pattern=r"(?P<ref>\d+)\."), ("date",))}
    reading_of = spark.createDataFrame([("a", "law")], "source_id string, reading string")
    got = statuses(observed(spark, [("a", second), ("b", second)], log, raw, readings=readings, reading_of=reading_of))
    assert got["a"][0] == "unchanged" and got["b"][0] == "changed", "only for one of them is the date no text"


@pytest.mark.parametrize("rows", [[], [("a", page("x"))]])
def test_no_answers_and_no_store(spark, rows):
    found = observed(spark, rows)
    assert found.results.count() == found.raw.count() == found.seen.count() == len(rows)


def test_digests_of_bodies(spark):
    rows = [("a", page("x"), "text/html"), ("b", page("x", "<script/>"), "text/html"), ("c", bytearray(b"%PDF"), "application/pdf"), ("d", bytearray(b""), "text/html"), ("e", bytearray(b"<broken"), "text/xml"), ("f", None, "text/html")]
    bodies = spark.createDataFrame([(k, None, kind, b) for k, b, kind in rows], "key string, reading string, content_type string, content binary")
    got = {r.key: r.body for r in f.body_digests(bodies, {}).collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 64 and got["c"] is None and got["d"] == "" and got["e"] is None and got["f"] == ""


def test_stream_from_folder_to_sections(spark, tmp_path):
    inbox, kept = tmp_path / "in", str(tmp_path / "kept")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    sink = ingest.rounds_sink(sources, kept)

    def save(source, name, body):
        (inbox / source).mkdir(parents=True, exist_ok=True)
        (inbox / source / name).write_bytes(bytes(body))

    def run(write):
        stream = ingest.landed_stream(spark, str(inbox)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint"))
        stream.trigger(availableNow=True).start().awaitTermination()

    save("a", "1.html", page("first"))
    save("b", "1.html", page("first"))
    save("b", ".hidden", page("dot"))
    save("unlisted", "1.html", page("x"))
    run(sink)
    save("a", "2.html", page("second"))
    save("b", "2.html", page("first", "<!-- c -->"))
    save("c", "1.html", page("x"))
    save("c", "2.html", page("y"))

    def broken(batch, number):
        sink(batch, number)
        raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        run(broken)
    run(sink)  # the micro-batch is made again
    got = sorted((r.source_id, r.status) for r in ingest.kept(spark, kept, "results").collect())
    assert got == [("a", "changed"), ("a", "new"), ("b", "new"), ("b", "unchanged"), ("c", "failed")]
    versions = f.versions_of(ingest.kept(spark, kept, "versions")).collect()
    assert sorted((r.document_id, r.sha256) for r in versions) == sorted([("a", sha(page("first"))), ("a", sha(page("second"))), ("b", sha(page("first")))])
    assert ingest.kept(spark, kept, "raw").count() == 3
    read = ingest.kept(spark, kept, "sections").where("section_ref = 'One'").collect()
    assert sorted(r.version_id[:2] for r in read) == ["a@", "a@", "b@"] and all("error" not in (r.error or "") for r in read)
