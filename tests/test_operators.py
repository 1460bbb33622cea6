"""Rules of the operators on small literal tables."""

import datetime
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.knowledge import KnowledgeBase
from lectern.operators import audit, extraction, search, sections, snapshot, topics, trust, validate, versions
from lectern.operators.sections import Rules
from tests.sections_by_rule import sections_of
from lectern.sources import markup
from lectern.sources.markup import Block


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_text_functions(spark):
    assert values(spark, T.comparable("t"), "re-\ncall the pro­duct", "2-3", "a - b") == ["recalltheproduct", "2-3", "ab"]
    assert values(spark, T.query_terms("t"), "What must the Foo_bar foo do in x yz?") == [["foo_bar", "foo", "yz"]]
    assert values(spark, T.tokens("t"), "Éa foo_bar 3ÀB") == [["ea", "foo", "bar", "3ab"]]
    assert values(spark, T.ref_key("t"), "Article 12 (b)", "3 kap. 6 §") == [["12", "b"], ["3", "6"]]
    assert values(spark, T.partial_date_valid("t"), "2024", "2024-13", "2024-02-29", "2023-02-29", "0000", "soon", None) == [True, False, True, False, False, False, False]
    assert values(spark, T.in_force("t", "2024-05-01"), "2024", "2024-06", None) == [True, False, True]
    assert values(spark, T.host("t"), "https://User@Example.ORG:80/a", "no url") == ["example.org", None]
    assert values(spark, T.is_title("t"), "Product safety", "ends.", "lower") == [True, False, False]
    assert values(spark, T.unfence("t"), '```json\n{"a": 1}\n```', "{}") == ['{"a": 1}', "{}"]
    assert values(spark, F.col("t").rlike(T.glob_regex("code 3.*[!x]")), "code 3.5.1", "code 3.5.x", "acode 3.51") == [True, False, False]


def b(*texts, **kw):
    return [Block(t, **kw) for t in texts]


def test_split_modes():
    pattern = Rules(section_pattern=r"(?P<ref>\d+)\. ")
    assert [s[0] for s in sections_of(b("intro", "1. one", "more", "2. two", "1. again"), pattern)] == ["(preamble)", "1", "2", "1 (2)"]
    titled = sections_of(b("1. one", "text of one.", "A title", "2. two"), pattern)
    assert [s[2] for s in titled] == ["1. one\ntext of one.", "A title\n2. two"]
    heads = [Block("Top", 1), Block("text"), Block("Sub", 2), Block("more"), Block("End", 1)]
    assert sections_of(heads, Rules()) == [("Top", (), "Top\ntext"), ("Sub", ("Top",), "Sub\nmore"), ("End", (), "End")]
    pages = [Block("a", page=1), Block("b", page=1), Block("c", page=2)]
    assert [s[0] for s in sections_of(pages, Rules())] == ["p. 1", "p. 2"]
    marked = [Block("Part I", 1), Block("x", ref="s. 1"), Block("y"), Block("Part II", 1), Block("z", ref="s. 2")]
    assert sections_of(marked, Rules()) == [("s. 1", ("Part I",), "Part I\nx\ny"), ("s. 2", ("Part II",), "Part II\nz")]
    chapters = Rules(section_pattern=r"(?P<ref>\d+ §)", chapter_pattern=r"(?P<ref>\d+ kap\.)")
    assert [s[0] for s in sections_of(b("1 kap. A", "1 § x", "2 kap. B", "1 § y"), chapters)] == ["1 kap. 1 §", "2 kap. 1 §"]
    capped = sections_of(b("1. aaaa", "bbbb", "cccc"), Rules(section_pattern=r"(?P<ref>\d)", max_chars=10))
    assert [s[0] for s in capped] == ["1 (part 1)", "1 (part 2)"]
    quoted = [Block("1. mine"), Block("2. theirs", quoted=True), Block("2. mine")]
    assert [s[0] for s in sections_of(quoted, pattern)] == ["1", "2"]
    window = Rules(section_pattern=r"(?P<ref>\d+)\. ", body_start="BODY", body_end="ANNEX", drop_preamble=True)
    assert [s[0] for s in sections_of(b("1. toc", "BODY", "1. real", "ANNEX", "2. x"), window)] == ["1"]
    with pytest.raises(ValueError, match="body_start"):
        sections_of(b("x"), Rules(body_start="BODY"))


def test_split_isolates_failures(spark):
    rows = [("a", 0, "x", None, None, None, False), ("b", 0, "BODY", None, None, 1, False)]
    found = {r.doc_id: r for r in sections.split(spark.createDataFrame(rows, sections.BLOCKS), Rules(body_start="BODY")).collect()}
    assert "body_start" in found["a"].error and found["b"].section_ref == "p. 1"


def test_markup():
    page = """<body><nav>skip</nav><h2>Head</h2><p>One<br>two<table><tr><td>a<td>b</tr></table><blockquote><p>quoted</blockquote>
      <div class="my-cookie-bar">no</div><p hidden>no</p><p aria-hidden="true">no</p><div class="skipme">no</div><p>end</body>"""
    found = markup.read_html(page, ["skipme"])
    assert [(x.text, x.level, x.quoted) for x in found] == [("Head", 2, False), ("One two", None, False), ("a | b", None, False), ("quoted", None, True), ("end", None, False)]
    form = '<body><form><input name="__VIEWSTATE"><p>kept</p><form><p>x</p></form></form></body>'
    assert [x.text for x in markup.read_html(form)][:1] == ["kept"]


def test_json_items_and_encodings(spark):
    bodies = [(1, '{"title": "T", "details": {"body": "<p>x</p>"}}', "application/json"), (2, "{}", "application/json; charset=utf-8"), (3, "no json", "text/json"), (4, "<p>y</p>", "text/html"), (5, None, "application/json"), (6, '{"details": {"body": ""}}', "application/json")]
    found = markup.html_blocks(spark.createDataFrame(bodies, "id int, body string, kind string"), "id", "body", content_type="kind").collect()
    assert sorted((r.id, r.ord, r.text, r.level) for r in found if r.text) == [(1, 0, "T", 1), (1, 1, "x", None), (4, 0, "y", None)]
    assert sorted({r.id for r in found if r.text is None}) == [2, 3, 5]
    raw = [b'<meta charset="iso-8859-1">\x80', "é".encode(), b"\xe9", b"<META http-equiv=x content='text/html; charset=UTF-16LE'>", b"<meta charset=odd>\xc3\xa9", None, b""]
    rows = markup.decoded(spark.createDataFrame(list(enumerate(map(lambda b: b and bytearray(b), raw))), "id int, raw binary"), "raw")
    names = {r.id: r.n for r in rows.select("id", markup.charset(F.col("raw")).alias("n")).collect()}
    assert [names[k] for k in (0, 1, 2, 3, 4, 6)] == ["cp1252", "utf-8", "cp1252", "utf-16le", "odd", "utf-8"]
    texts = {r.id: r.text for r in rows.collect()}
    assert texts[0].endswith("€") and texts[1] == texts[2] == "é" and texts[4].endswith("é") and texts[5] is None and texts[6] == ""


def test_patterns_prompts_and_selections(spark):
    assert validate.pattern_problem(None) is None and validate.pattern_problem(r"(?P<ref>\d+)") is None
    assert "compile" in validate.pattern_problem("(") and "ref" in validate.pattern_problem(r"\d+")
    assert validate.pattern_problem(r"(\d+)", r"Art. \g<1>") is None and "unknown" in validate.pattern_problem(r"(?P<ref>\d)", r"\g<other>")
    prompt, version = extraction.system_prompt("Read.", ["must"], [("recalls", "Recalls")])
    assert "- recalls: Recalls" in prompt and re.fullmatch("[0-9a-f]{12}", version)
    assert extraction.system_prompt("Read.", ["must"], [("recalls", "Recall")])[1] != version
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    assert [r.n for r in extraction.selected(rows, "source", ["b"]).collect()] == [2] and extraction.selected(rows, "source", None).count() == 2
    with pytest.raises(ValueError, match="c"):
        extraction.selected(rows, "source", ["a", "c"])


def test_topk_and_containment(spark):
    """Ties end in ids across blocks, other lengths and nulls are no candidates, scopes keep to their own; anchors shared by quotes."""
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], "ab"[i % 2]) for i in range(60)] + [(98, [1.0], "a"), (99, None, "a")], "item int, v array<double>, scope string").repartition(7)
    asked = spark.createDataFrame([("x", [1.0, 0.0], []), ("y", [1.0, 0.0], ["b"]), ("z", None, [])], "query_id string, q array<double>, only array<string>")
    found = search.vector_topk(asked, vectors, "item", 4, scope="scope").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["item"]) for r in found] == [("x", 1), ("x", 2), ("x", 4), ("x", 5), ("y", 1), ("y", 5), ("y", 7), ("y", 11)]
    assert search.vector_topk(asked, vectors, "item", 100, positive=True).where("query_id = 'x'").count() == 40
    long = "q" * 60
    texts = spark.createDataFrame([(1, f"a {long}1 b"), (2, f"{long}2"), (3, None), (4, "")], "id int, t string")
    quotes = spark.createDataFrame([(1, long + "1"), (2, long + "2"), (3, long), (4, "absent"), (5, ""), (6, None)], "quote_id int, quote string")
    pairs = {(r.quote_id, r.id) for r in search.containing(texts, "id", "t", quotes).collect()}
    assert pairs == {(1, 1), (2, 2), (3, 1), (3, 2), (5, 1), (5, 2), (5, 4)}


def test_links_of_what_is_kept(spark):
    page = """<body><nav><a href="/menu">m</a></nav><main><p><a href='a/b.html#x'>1</a> <a href=../c?x=1&amp;y=2>2</a> <a href="//other.org/">3</a> <a href="a/b.html">again</a>
      <a href="mailto:x@y.z">no</a> <a href="#top">self</a> <a href="http://[bad">bad</a><div class=drop><a href="/d">4</a></div></p></main></body>"""
    want = ["https://x.org/docs/a/b.html", "https://x.org/c?x=1&y=2", "https://other.org/", "https://x.org/d"]
    assert markup.read_links(page, "https://x.org/docs/index.html#here") == want
    rows = spark.createDataFrame([(1, page, "https://x.org/docs/index.html"), (2, None, None)], "id long, html string, url string")
    assert [r.link for r in markup.kept_links(rows, "id", "html", "url", ["drop"]).orderBy("place").collect()] == want[:3]


def test_xml_dialects(spark):
    def by_events(*bodies):
        rows = spark.createDataFrame([(k, "<?xml version='1.0'?>" + b) for k, b in enumerate(bodies)], "id int, body string")
        found = markup.html_blocks(rows, "id", "body").orderBy("id", "ord").collect()
        return [[(r.text, r.level, r.ref) for r in found if r.id == k] for k in range(len(bodies))]

    read = lambda xml: [(x.text, x.level, x.ref) for x in markup.read_xml(xml)]
    act = """<Legislation xmlns="u"><Metadata>m</Metadata><Primary><Body><Part><Number>Part 1</Number><Title>Start</Title><Pblock><Title>Basics</Title><P1group><Title>Scope</Title>
      <P1><Pnumber>1</Pnumber><P1para><P2><Pnumber><CommentaryRef/>1</Pnumber><P2para>First rule<CommentaryRef/></P2para></P2></P1para></P1></P1group></Pblock></Part></Body></Primary></Legislation>"""
    assert read(act) == [("Part 1 Start", 1, None), ("Basics", 3, None), ("Scope 1 (1) First rule", None, "s. 1")]
    schedule = """<Legislation><Primary><Schedule><Number>SCHEDULE 9A</Number><P1><Pnumber>4</Pnumber><P1para>Text</P1para></P1><P1group><Title>Notes:</Title><P2><Pnumber>1</Pnumber>Means this</P2></P1group></Schedule></Primary></Legislation>"""
    assert read(schedule) == [("SCHEDULE 9A", 1, None), ("4 Text", None, "Sch. 9A para. 4"), ("Notes: (1) Means this", None, "Sch. 9A Notes")]
    law = """<response><data><texto><bloque tipo="encabezado"><version><p class="titulo_num">TITULO I</p><p class="titulo_tit">Start</p></version></bloque>
      <bloque tipo="precepto" titulo="Art 1"><version><p>old</p></version><version><p>Art 1</p><p>new</p><blockquote><p>note</p></blockquote></version></bloque><bloque tipo="firma"><version><p>signed</p></version></bloque>
      <bloque tipo="encabezado"><version><p class="anexo_num">ANEXO</p></version></bloque><bloque tipo="precepto" titulo="3. Tests"><version><p>3. Tests</p><p>3.1 First</p><p>3.2. Second</p></version></bloque></texto></data></response>"""
    expected_law = [
        ("TITULO I Start", 1, None), ("Art 1", None, "Art 1"), ("new", None, None), ("ANEXO", 1, None), ("3. Tests", None, "Anexo 3"), ("3.1 First", None, "Anexo 3.1"), ("3.2. Second", None, "Anexo 3.2")
    ]
    wet = """<toestand><wettekst><hoofdstuk><kop><label>Hoofdstuk</label> <nr>1</nr></kop><afdeling><kop>Afdeling 2</kop><artikel><kop><label>Artikel</label> <nr>5</nr></kop><lid>Text</lid></artikel>
      <artikel status="vervallen"><kop><nr>6</nr></kop><lid>gone</lid></artikel></afdeling></hoofdstuk></wettekst></toestand>"""
    assert read(wet) == [("Hoofdstuk 1", 1, None), ("Afdeling 2", 2, None), ("Artikel 5 Text", None, "Artikel 5")]
    akoma = """<akomaNtoso><act><meta>m</meta><body><chapter><num>1 luku</num><heading>Start</heading><section><num>1 §</num><heading>Scope</heading><p>Text<authorialNote>n</authorialNote> goes on</p></section></chapter>
      <section><num>Capo I</num><heading/><article><num>Art. 2.</num><p>More</p></article></section></body></act></akomaNtoso>"""
    assert read(akoma) == [("1 luku Start", 2, None), ("1 § Scope Text goes on", None, "1 §"), ("Capo I", 3, None), ("Art. 2. More", None, "Art. 2")]
    danish = """<Dokument><Meta>m</Meta><Kapitel><Explicatus>Kapitel 1</Explicatus><Rubrica>Start</Rubrica><ParagrafGruppe><Rubrica>Scope</Rubrica><Paragraf><Explicatus>§ 1.</Explicatus><Stk>First</Stk><Stk>Second</Stk></Paragraf></ParagrafGruppe></Kapitel>
      <AendringCentreretParagraf><Explicatus>§ 2</Explicatus><Exitus>The law is amended</Exitus><AendringsNummer>1. <Paragraf><Explicatus>§ 9</Explicatus></Paragraf> goes</AendringsNummer></AendringCentreretParagraf></Dokument>"""
    expected_danish = [("Kapitel 1 Start", 1, None), ("Scope", 2, None), ("§ 1. First", None, "§ 1"), ("Second", None, None), ("§ 2 The law is amended", None, "§ 2"), ("1. § 9 goes", None, None)]
    two = law.replace("3. Tests", "Sin numero").replace('tipo="encabezado"><version><p class="anexo_num">ANEXO', 'tipo="encabezado"><version><p class="nota">Nota</p></version><version><p class="x">y</p><p class="anexo_tit">ANEXO')
    assert by_events(law, danish, "<Dokument/>", "<response/>", "<Dokument><open></Dokument>", two) == [
        expected_law, expected_danish, [], [(None, None, None)], [(None, None, None)], [*expected_law[:4], ("Sin numero", None, "Anexo Sin numero"), *[(t, None, None) for t in ("3.1 First", "3.2. Second")]],
    ]
    assert by_events("<Dokument>" + "<x>" * 20_000 + "<Paragraf/>" + "</x>" * 20_000 + "</Dokument>") == [[]]
    deep = "<akomaNtoso><body>" + "<p>" * 20_000 + "x" + "</p>" * 20_000 + "</body></akomaNtoso>"
    assert markup.read_xml(deep) == []
    for wrong in ("<other/>", "<open>", "<response/>"):
        with pytest.raises(ValueError):
            markup.read_xml(wrong)


OBSERVED = "document string, seq long, sha string, body string, is_html boolean"


def test_version_machine(spark):
    rows = [("a", i, s, s, False) for i, s in enumerate(["v1", "v2", "v1", "v1"])]
    rows += [("b", 0, "x1", "body", False), ("b", 1, "x2", "body", False), ("b", 2, "x3", None, False), ("b", 3, "x4", "page", True)]
    found = versions.version_machine(spark.createDataFrame(rows, OBSERVED)).orderBy("document", "seq").collect()
    assert [r.status for r in found] == ["new", "changed", "changed", "unchanged", "new", "unchanged", "failed", "failed"]
    assert [r.is_new_version for r in found][:4] == [True, True, False, False]


def test_version_stream(spark, tmp_path):
    from lectern.streaming import ingest

    for k, part in enumerate(([("a", 0, "v1", "v1", False)], [("a", 1, "v1", "v1", False), ("a", 2, "v2", "v2", False)])):
        spark.createDataFrame(part, OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = ingest.observations(spark, f"{tmp_path}/in/*", OBSERVED, 1)
    q = ingest.version_stream(stream).writeStream.format("memory").queryName("seen_versions").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r.status for r in spark.table("seen_versions").orderBy("seq").collect()] == ["new", "unchanged", "changed"]


def test_model_call_and_records(spark):
    def call(system, message):
        if "bad" in message:
            raise TimeoutError("slow")
        return '```json\n{"statements": [{"verbatim_quote": "q", "summary": "s", "modality": "must", "topics": ["t"], "applies_to": ["a"]}]}\n```'

    rows = spark.createDataFrame([("1", "ok"), ("2", "bad")], "message_sha256 string, message string")
    out = {r.message_sha256: r for r in extraction.call_model(rows, call, "sys").collect()}
    assert out["1"].error is None and "TimeoutError" in out["2"].error
    got = extraction.records(spark.createDataFrame([("1", out["1"].output), ("3", "no json")], "k string, output string")).orderBy("k").collect()
    assert (got[0].n, got[0].record.verbatim_quote, got[0].bad_output) == (1, "q", False) and got[1].bad_output


def test_trust_levels(spark):
    rows = [(True, True, True, False, False), (True, True, False, True, False), (False, True, True, True, False), (True, False, True, False, True)]
    df = spark.createDataFrame(rows, "p boolean, o boolean, b boolean, v boolean, d boolean")
    assert [r[0] for r in df.select(trust.level(F.col("p"), F.col("o"), F.col("b"), F.col("v"), F.col("d"))).collect()] == ["official", "official", "secondary", "disputed"]


def test_audit(spark):
    refs = [("x", r) for r in ["(preamble)", "s. 1", "s. 2A", "Article 5", "§ 6", "Schedule 1", "40"]]
    numbers = spark.createDataFrame(refs, "k string, ref string").select("k", audit.ref_number("ref").alias("n")).where("n is not null")
    assert audit.number_gaps(numbers, "k", "n").first().gaps == 2
    toc = "\n".join(f"Chapter {i} ........ {i}" for i in range(6))
    assert values(spark, T.toc_like("t"), toc, "a\nb\nc\nd\ne") == [True, False]


def test_validation(spark):
    rows = [
        ("a", "P", "T", "https://x.org", "en", "act", ["t"], "SE", None), ("b", "P", "T", "https://x.org", "en", "act", ["t"], "GB", "a"), ("c", "P", "T", "https://x.org", "sv", "act", ["t"], "SE", "zz"),
    ]
    df = spark.createDataFrame(rows, "id string, publisher string, title string, url string, language string, doc_type string, tags array<string>, scope string, translation_of string")
    found = {(r.rule, r.entity) for r in validate.sources(df, ["act"], ["t"], True).collect()}
    assert found == {("translation.language", "b"), ("translation.scope", "b"), ("translation.exists", "c"), ("translation.scope", "c")} - {("translation.scope", "c")}
    stated = spark.createDataFrame([("SE", "a", "licensed", None, "2024-13"), ("SE", "q", "unknown", None, None)], "scope string, tag string, status string, source_id string, effective_from string")
    scope = spark.createDataFrame([("SE", "Sweden", ["sv"]), ("se", "", ["x"])], "id string, name string, languages array<string>")
    rules = {(r.rule, r.entity) for r in validate.availability(stated, scope.where("id = 'SE'"), ["a", "b"], ["licensed"]).collect()}
    assert rules == {("availability.source", "SE/a"), ("availability.date", "SE/a"), ("availability.tag", "SE/q"), ("availability.all", "SE/b")}
    assert {r.rule for r in validate.scopes(scope).collect()} == {"scope.unique", "scope.name", "scope.languages"}


def test_lists_are_cut_before_they_are_filtered(spark):
    scored = spark.createDataFrame([(1, i, float(-i)) for i in range(5)], "query_id int, item int, score double")
    cut = search.ranked(scored, "item", 3)
    allowed = spark.createDataFrame([(2,), (4,)], "item int")
    assert [(r.item, r["rank"]) for r in search.filtered_list(cut, allowed, "item").collect()] == [(2, 1)]


def test_bm25_prefix_and_ties_against_sqlite(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(heading, text, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    rows = [(1, "recall", "Recalls of toys"), (2, "toys", "the toy recalled élan"), (3, "", "nothing here"), (4, "code", "toys toys toys recall"), (5, "x", "y elan z")]
    con.executemany("insert into f(rowid, heading, text) values (?, ?, ?)", rows)
    expected = dict(con.execute("select rowid, -bm25(f, 2.0, 1.0) from f where f match '\"recall\"* OR \"élan\"* OR \"toy\"'").fetchall())
    docs = spark.createDataFrame(rows, "doc int, heading string, text string")
    asked = spark.createDataFrame([(1, "recall élan toy")], "query_id int, query string")
    got = {r.doc: r.score for r in search.bm25(asked, search.postings(docs, "doc", "text", "heading"), search.lengths_of(docs, "doc", "text", "heading"), "doc").collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    one = snapshot.publish(spark, {"documents": df, "vectors": df}, str(tmp_path), "kb")
    assert snapshot.publish(spark, {"documents": df.repartition(3)}, str(tmp_path), "kb", one) == one
    two = snapshot.publish(spark, {"documents": df.limit(2)}, str(tmp_path), "kb", one)
    assert two["version"] == 2 and snapshot.pull(spark, str(tmp_path), "kb", 1)["documents"].count() == 3
    assert snapshot.problems({"format": 9, "name": "x"}, "kb")


def test_knowledge_base(spark, tmp_path):
    at = datetime.datetime(2026, 9, 24)
    doc = lambda i, lang, kind, tags, scope, of=None: Row(id=i, publisher="P", title=i, url="https://x.org", language=lang, doc_type=kind, tags=tags, scope=scope, translation_of=of)
    docs = [doc("code", "en", "regulation", ["food"], "GB"), doc("code-retail", "en", "regulation", ["food"], "GB"), doc("lag", "sv", "act", ["cosmetics"], "SE"), doc("never", "en", "act", [], "GB")]
    spark.createDataFrame(docs, "id string, publisher string, title string, url string, language string, doc_type string, tags array<string>, scope string, translation_of string").write.parquet(f"{tmp_path}/documents")
    seen = [(f"{d}@1", d, "s", at, at) for d in ("code", "code-retail", "lag")]
    spark.createDataFrame(seen, "id string, document_id string, sha256 string, fetched_at timestamp, last_checked_at timestamp").write.parquet(f"{tmp_path}/versions")
    chunk = lambda d, n, ref, text: (f"{d}@1#{n:04d}", f"{d}@1", n, ref, ["Product safety"], text, str(hash(text)))
    chunks = [chunk("code", 0, "code 3", "Recall unsafe food."), chunk("code", 1, "code 5 (part 1)", "one"), chunk("code", 2, "code 5 (part 2)", "two"), chunk("code-retail", 0, "code 3", "Recall unsafe food."), chunk("lag", 0, "14 kap.", "Farlig kosmetik")]
    spark.createDataFrame(chunks, "id string, version_id string, ord int, section_ref string, heading_path array<string>, text string, sha256 string").write.parquet(f"{tmp_path}/chunks")
    stated = [(f"{c[0]}/1", c[0], q, "s", m, ["food"], None, "recalls") for c, q, m in ((chunks[0], "Recall unsafe food", "should"), (chunks[3], "recall, unsafe food", "must"), (chunks[4], "Farlig", "must"))]
    spark.createDataFrame(stated, "id string, chunk_id string, verbatim_quote string, summary string, modality string, applies_to array<string>, effective_from string, topic string").write.parquet(f"{tmp_path}/statements")
    kb = KnowledgeBase(spark, str(tmp_path), ["act", "regulation"], ["must", "should"])
    asked = spark.createDataFrame([(1, "recall of food")], "query_id int, query string")
    hits = kb.search(asked).collect()
    assert (hits[0].section_ref, hits[0].also_in) == ("code 3", ["code-retail code 3"])
    assert [r.document_id for r in kb.search(asked, tags=["cosmetics"]).collect()] in ([], ["lag"])
    assert kb.get("code", "code 5").first().section_text == "one\ntwo"
    assert [r.section_ref for r in kb.similar("code", "code 55 or 5").collect()][:1] != ["code 3"]
    listed = kb.topic("recalls").collect()
    assert [(r.document_id, r.total) for r in listed] == [("lag", 2), ("code", 2)] and listed[1].also_in == ["code-retail code 3"]
    assert {r.document_id: (r.n_sections, r.n_statements) for r in kb.sources("GB").collect()} == {"code": (3, 1), "code-retail": (1, 1), "never": (0, 0)}
    assert topics.clamp(500, 50) == 50
    from lectern.__main__ import evaluate

    # scopes: named in the query, or asked for whatever their case; unknown ones are errors that list the known
    spark.createDataFrame([("GB", "Britain", ["UK"]), ("SE", "Sweden", [])], "id string, name string, aliases array<string>").write.parquet(f"{tmp_path}/scopes")
    named = spark.createDataFrame([(1, "recall in Sweden"), (2, "recall of food")], "query_id int, query string")
    answers = {r.query_id: r for r in kb.answers(named).collect()}
    assert answers[1].scopes_inferred == ["SE"] and {x.document_id for x in answers[1].results} == {"lag"}
    assert answers[2].scopes_inferred is None and answers[2].results[0].document_id == "code" and answers[2].note is None
    assert {r.document_id for r in kb.search(named, scopes=["gb"]).collect()} == {"code"}
    assert kb.answers(named, tags=["toys"]).first().note
    with pytest.raises(ValueError, match="GB, SE"):
        kb.search(named, scopes=["FR"])
    with pytest.raises(ValueError, match="recalls"):
        kb.search(named, topic=["nothing"])
    assert [x.quote for x in hits[0].statements] == ["Recall unsafe food"] and hits[0].statements[0].topics == ["recalls"]
    assert kb.search(asked, tags=["food"]).first().statements[0].applies_to == ["food"]
    there, parts, absent, nowhere = [kb.section(*at).collect() for at in (("code", "code 3"), ("code", "code 5"), ("code", "code 55"), ("none", "code 3"))]
    assert [s.quote for s in there[0].statements] == ["Recall unsafe food"] and there[0].error is None and there[0].similar is None
    assert parts[0].section_text == "one\ntwo" and parts[0].statements == []
    assert absent[0].error and absent[0].similar == ["code 3", "code 5 (part 1)", "code 5 (part 2)"][: len(absent[0].similar)] and absent[0].section_text is None
    assert nowhere[0].error == "there is no such document" and nowhere[0].similar == []
    plain = {r.document_id: (r.level, r.binding, r.note) for r in kb.sources_full().collect()}
    assert plain == {d: ("unverified", None, None) for d in ("code", "code-retail", "lag", "never")}  # nothing is registered
    spark.createDataFrame([("P", ["x.org"], True)], "publisher string, domains array<string>, official boolean").write.parquet(f"{tmp_path}/publishers")
    spark.createDataFrame([("act", True, None), ("regulation", False, "guidance")], "doc_type string, binding boolean, note string").write.parquet(f"{tmp_path}/doc_types")
    verdicts = [("lag@1", "r", "vetted", "1"), ("lag@1", "r", "disputed", "2"), ("code@1", "r", "disputed", "1"), ("code@1", "r", "vetted", "2")]
    spark.createDataFrame(verdicts, "version_id string, reviewer string, verdict string, created_at string").write.parquet(f"{tmp_path}/reviews")
    full = {r.document_id: (r.level, r.binding, r.note, r.n_statements) for r in kb.sources_full().collect()}
    assert full == {"code": ("official", False, "guidance", 1), "code-retail": ("secondary", False, "guidance", 1), "lag": ("disputed", True, None, 1), "never": ("official", True, None, 0)}
    golden = spark.createDataFrame([(1, "recall of food", "code*", "code ?"), (2, "kosmetik", "nowhere", "*")], "query_id int, query string, source_glob string, section_glob string")
    assert {r.query_id: (r.hit, r.first_rank) for r in evaluate(kb, golden).collect()} == {1: (True, 1), 2: (False, None)}


def test_registry_files(spark, tmp_path):
    pytest.importorskip("yaml")
    from lectern.sources import registry_files

    (tmp_path / "s.yaml").write_text("- {id: a, publisher: P, title: T, url: https://x.org, language: en, doc_type: act, tags: [t]}\n")
    (tmp_path / "bad.yaml").write_text("- {id: a, colour: red}\n")
    (tmp_path / "scopes.yaml").write_text("- {id: SE, name: Sweden, languages: [sv], availability: {t: {status: licensed, source: a, effective_from: 2024}}}\n")
    (tmp_path / "golden.yaml").write_text("- question: what?\n  expect: [{source: a, section: 's. *'}, {source: b}]\n")
    assert registry_files.sources(spark, str(tmp_path / "s.yaml")).first().tags == ["t"]
    with pytest.raises(ValueError, match="colour"):
        registry_files.sources(spark, str(tmp_path / "bad.yaml"))
    scopes, stated = registry_files.scopes(spark, str(tmp_path / "scopes.yaml"))
    assert scopes.first().languages == ["sv"] and stated.first().effective_from == "2024"
    assert [r.section_glob for r in registry_files.golden(spark, str(tmp_path / "golden.yaml")).orderBy("source_glob").collect()] == ["s. *", "*"]


def test_best_of_keywords_in_blocks_is_the_ranking_of_all(spark, monkeypatch):
    rows = [(k, " ".join(w for j, w in enumerate(["apple", "apples", "pear", "plum", "fig"]) if (k * 7 + 3) >> j & 1)) for k in range(64)]
    posts = search.postings(spark.createDataFrame(rows, "doc long, text string"), "doc", "text")
    lengths = search.lengths_of(spark.createDataFrame(rows, "doc long, text string"), "doc", "text")
    asked = spark.createDataFrame([(1, "apple pear"), (2, "plum"), (3, "nothing here"), (4, "fig fig apples")], "query_id long, query string")
    monkeypatch.setattr(search, "BLOCK", 8)
    want = search.ranked(search.bm25(asked, posts, lengths, "doc").withColumn("score", F.round("score", 6)), "doc", 5)
    found = search.bm25_topk(asked, posts, lengths, "doc", 5, 6)
    told = lambda df: sorted((r.query_id, r.rank, r.doc, r.score) for r in df.select("query_id", "rank", "doc", "score").collect())
    assert told(found) == told(want) and len(told(want)) == 15


def test_pages_are_read_in_small_parts(spark, monkeypatch):
    from lectern import session

    pages = spark.createDataFrame([(k, "" if k < 9 else f"<p>page {k}</p>") for k in range(20)], "page_id long, html string").coalesce(1)
    sizes = session.map_parts(pages, lambda parts: (p.head(1).assign(n=len(p))[["n"]] for p in parts), "n int", 8)
    assert sorted(r.n for r in sizes.collect()) == [4, 8, 8]
    out = markup.html_blocks(pages, "page_id", "html")
    assert sorted(r.text for r in out.collect()) == sorted(f"page {k}" for k in range(9, 20))
    assert "MapInArrow" in out._jdf.queryExecution().toString()
