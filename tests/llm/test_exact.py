"""Operators against brute force, exact round trips and held-out accuracy, on the small tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import graph, html_text, neighbours, ngram_join, ogg, packing, pii, quality, registry, simple8b, tokens
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    check(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


@pytest.mark.parametrize("file, kind", [("word_bpe_49k.json", "word_ends"), ("byte_bpe_50k.json", "space_starts")])
def test_cached_encoding_is_exact(docs, monkeypatch, file, kind):
    hard = ["a  b", "x\n y", "don't stop. It's <|endoftext|> ok", "tab\there", "", " lead", "trail ", " ", ".", ",", "a, b.", "ÄÖ ß é ñ.", "ﬁ İstanbul Ω", "a\x1cb c", "éa b", "Ä b", "x.y ,z a,,b 1,2.", "A\0B c"]
    plain = Tokenizer.from_file(tokens.default_path(file))
    rng = random.Random(6)
    alphabets = [[chr(c) for c in range(256)], list("aé's t'll've'red'm'S \t\n  x9²½ªµ"), [*"ab \n'", "😀", "—", "“", "日", "\u0301", "\u2003", "\0", "İ", "ﬁ"]]
    hard += ["a <|endoftext|> b", "<|startoftext|>", "<|ENDOFTEXT|> x"] + ["".join(rng.choices(a, k=rng.choice([1, 3, 10, 60]))) for a in alphabets for _ in range(1500)]
    texts = [*docs.values(), *hard]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encoder(tokens.default_path(file), kind).many(texts) == want
    # a table so small that it is renewed again and again, and texts longer than a group
    small = {"word_ends": tokens.WordEnds, "space_starts": tokens.SpaceStarts}[kind](tokens.load(tokens.default_path(file)), 300)
    monkeypatch.setattr(tokens, "GROUP", 64)
    assert small.many(texts) == want


def test_op3_covers_every_id_once(spark, docs):
    e = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    found = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), keep_ids=True).collect()
    pieces = collections.defaultdict(list)
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    for doc, text in docs.items():
        parts = sorted(pieces[doc], key=lambda r: r.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in parts), dtype="<u4").tolist()
        assert ids == [*e.encode(text, add_special_tokens=False).ids, 2]
    used = collections.Counter()
    for r in found:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sum(used.values()) / (4096 * len(used)) > 0.97


def test_op4_base_spans(spark, docs):
    # the contract's patterns, as they stand
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    hard = ["a@b.c_x@y.z.", "😀 x@y.co 😀 1.2.3.4.5.6.7.8", "4092 9988-5579 4968 40929988557949684092998855794968", "+1 (234) 555-1234 +1--2 +12345678901234567890", "a@b@c.d foo@bar@baz.com",
            "256.1.1.1 001.002.003.0255 1.1.1.1.", "1" * 20000 + " " + "a" * 20000 + "@", "4111 1111 1111 1111 x 4111-1111-1111-1111-"]
    texts = {**docs, **{10**6 + i: t for i, t in enumerate(hard)}}
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    for r in pii.find(table).select("doc_id", pii.spelt(pii.F.col("base")).alias("base")).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, texts[r.doc_id]) if holds(k, m[0])]
        assert r.base == ",".join(spans)


def test_op4_terms_that_give_a_value_away(spark):
    rows = [(i, f"case {i} of Zorblax wrote to secret@mail.example.com about item number{i}", "en", "s") for i in range(5)]
    rows += [(100 + i, f"the weather of day {i} was fine and about as usual", "en", "s") for i in range(200)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    kinds = {s.value.lower(): s.kind for s in found[0].spans}
    assert kinds["zorblax"] == "removed" and "about" not in kinds and "of" not in kinds
    assert all(not r.spans for i, r in found.items() if i >= 100)
    text = next(r.text for r in pii.redact(spark.createDataFrame(rows[:5] + rows[5:], "doc_id long, text string, lang string, source string")).collect() if r.doc_id == 0)
    assert "[EMAIL]" in text and "Zorblax" not in text


def _term_spans(spark, rows):
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    return {r.doc_id: {s.value.lower(): s.kind for s in r.spans} for r in found}


def test_op4_value_in_one_text(spark):
    rows = [(i, f"the weather of day {i} was fine", "en", "s") for i in range(200)]
    rows.append((500, "the weather of Zorblax was fine, write to solo@mail.example.com", "en", "s"))
    kinds = _term_spans(spark, rows)
    assert kinds[500]["zorblax"] == "removed" and not {"the", "weather", "was", "fine"} & set(kinds[500])
    assert not any(kinds[i] for i in range(200))


def test_op4_term_far_from_the_value(spark):
    gap = "the weather was fine " * 10
    rows = [(i, f"the weather was fine on day {i}", "en", "s") for i in range(200)]
    rows += [(500 + i, f"Zorblax {gap} write to shared@mail.example.com case{'abc'[i]}", "en", "s") for i in range(3)]
    rows.append((600, f"shared@mail.example.com, {gap} zorblax", "en", "s"))
    kinds = _term_spans(spark, rows)
    assert all(kinds[i]["zorblax"] == "removed" for i in (500, 501, 502, 600))
    assert not any("weather" in k for k in kinds.values())


def _links(x):
    """n_links, component_id and kept of each row of x by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    component = np.arange(len(x))
    while True:  # the smallest id among those linked, until nothing changes
        least = np.array([component[row].min() for row in linked])
        if (least == component).all():
            break
        component = least
    return (linked.sum(axis=1) - 1).tolist(), component.tolist(), (component == np.arange(len(x))).tolist()


def _check_op5(spark, x):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = neighbours.near_duplicates(table).toPandas().sort_values("vec_id")
    n_links, component, kept = _links(x)
    assert found.n_links.tolist() == n_links
    assert found.component_id.tolist() == component and found.kept.tolist() == kept


def test_op5_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([c + 0.1 * rng.standard_normal((n, 32)) for c, n in zip(centres, [1] * 20 + [2] * 10 + [9] * 8 + [150, 700])])
    _check_op5(spark, x)


def _near(rng, centre, cos, n):
    """n vectors that have about this cosine with each other, around a centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return math.sqrt(cos) * centre + math.sqrt(1 - cos) * noise


def test_op5_tight_groups_that_link_and_chains(spark):
    """Sub-clusters of 12 and of 200 whose centres have cosine 0.96, chains whose ends do not link, and a large loose group."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [rng.standard_normal((2000, 64))]
    for n, groups in ((12, 40), (200, 2)):
        for _ in range(groups):
            for sub in _near(rng, unit(rng.standard_normal(64)), 0.96, 2):
                rows.append(_near(rng, unit(sub), 0.998, n))
    for _ in range(2):
        a, b = unit(rng.standard_normal(64)), unit(rng.standard_normal(64))
        b = unit(b - (a @ b) * a)
        turn = np.linspace(0, np.pi / 2, 60)
        rows.append(np.outer(np.cos(turn), a) + np.outer(np.sin(turn), b))
    rows.append(_near(rng, unit(rng.standard_normal(64)), 0.95, 700))  # half of its pairs link; more than a tile
    rows.append(_near(rng, unit(rng.standard_normal(64)), 0.99, 600))  # all link, and nothing need be compared
    x = np.concatenate(rows)
    _check_op5(spark, x[rng.permutation(len(x))])


def test_op7_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in quality.op7_neighbour_voting(spark, d).collect()}
    labels = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if found[r.doc_id].held_out]
    right = sum(q == r.predicted for q, r in labels)
    assert right / len(labels) > 0.95


def test_op7_votes_are_plain_nearest_neighbours(spark):
    """Blocked scores of all documents against sorting all cosines of each; a very long text counts in full in the sample too."""
    docs_, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    long = "a b " * 90_000
    extra = spark.createDataFrame([(10**7 + i, long, "en", "s", len(long)) for i in range(3)], docs_.schema)
    docs_ = docs_.unionByName(extra)
    labels = labels.unionByName(spark.createDataFrame([(10**7 + i, 0, 0) for i in range(3)], labels.schema))
    x, y = quality.sample(docs_, labels)
    assert x.max() > 70_000
    model = quality.fit(x, y)
    for r in quality.score(docs_, model).collect():
        cos = (model.latent(quality.counts([r.text or ""])) @ model.vectors.T)[0].astype(np.float64)
        near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cos[near], 0) ** quality.SHARPNESS
        want = (weight * model.labels[near]).sum() / weight.sum() if weight.sum() else model.prior
        assert abs(r.score - want) < 1e-3 or np.ptp(np.sort(-cos)[quality.NEIGHBOURS - 1 : quality.NEIGHBOURS + 1]) < 1e-6
        assert r.predicted == (r.score >= 0.3)


def test_op8_round_trip():
    rng = random.Random(1)
    for ids in ([], [0] * 5000, [1 << 31, 5, (1 << 20) - 1, 1 << 20] * 700, list(range(3000)), [1] * 239 + [70000], [rng.randrange(1 << rng.randrange(1, 33)) for _ in range(9000)]):
        a = np.array(ids, dtype=np.uint64)
        words, offsets, escapes = simple8b.encode(a)
        assert simple8b.decode(words, offsets.astype(np.int64), len(a), escapes).tolist() == ids


def test_op8_file(spark, docs):
    e = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(simple8b.op8_token_binary(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = [*e.encode(docs[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_op8_one_id_across_borders(spark, tmp_path):
    """Rows of one doc_id that fill several shards keep their stated order, and every row is read back."""
    rows = [(7, f"text {i} of one id") for i in range(400)] + [(3, "<|endoftext|> is spelt here"), (None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    simple8b.write(table, f"{tmp_path}/f")
    found = sorted(simple8b.read(spark, f"{tmp_path}/f", with_ids=True).collect(), key=lambda r: r.start)
    e = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    hashes = {r.text: r.h for r in table.selectExpr("text", "xxhash64(text) h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    assert [r.doc_id for r in found] == [i for i, _ in ordered]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[*e.encode(t, add_special_tokens=False).ids, 0] for _, t in ordered]


def test_op9_container():
    def bitwise(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    assert ogg.checksum(b"OggS and more \xff\x00") == bitwise(b"OggS and more \xff\x00")
    for n in (64, 4096, 64_000, 255 * 255 * 2 + 64 - 255 * 255 * 2 % 64, 200_000):
        payload = random.Random(n).randbytes(n)
        media = ogg.store(payload, n - 3)
        info = ogg.load(media)
        assert info["payload"] == payload and info["length"] == n - 3 and info["n_streams"] == 2
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ValueError):
            ogg.load(bytes(broken))
    info = ogg.load(ogg.store(bytes(20_000), 20_000))
    assert info["times"] == [(0.0, 1.0), (1.0, 2.0), (2.0, 2.5)]
    marks_only = b"".join(ogg.Writer(7).pages([(b"\x01mark" + bytes(4), 0)], first=True, last=True))
    for wrong in (b"", marks_only, marks_only * 2, b"no ogg"):
        with pytest.raises(ValueError):
            ogg.load(wrong)
    long_packet = ogg.Writer(9).pages([(bytes(255 * 300), 7)], first=True, last=True)
    assert len(long_packet) == 2 and ogg.streams(b"".join(long_packet))[9]["packets"] == [bytes(255 * 300)]


def test_op9_broken_files_are_rows(spark):
    good = ogg.store(bytes(64), 3)
    rows = spark.createDataFrame([(1, good), (2, good[:-1]), (None, b""), (3, None)], "doc_id long, media binary")
    found = {r.doc_id: r for r in ogg.features(rows).collect()}
    assert found[1].n_bytes == 3 and found[1].error is None
    assert all(found[k].error and found[k].payload_bytes is None for k in (2, None, 3))


def test_op9_reads_back(spark, docs):
    for r in ogg.op9_ogg_media(spark, SF).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op10_links(spark, docs):
    rng = random.Random(5)
    texts = dict(docs)
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)]
    for i in range(300):  # a large group of near copies
        words = list(base)
        words[rng.randrange(120)] = f"w{i}"
        texts[10**6 + i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, where = {}, collections.defaultdict(list)
    links, parent = collections.Counter(), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(texts):
        w = re.findall(r"\w+", texts[i].lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        meet = collections.Counter(j for s in sets[i] for j in where[s])
        for s in sets[i]:
            where[s].append(i)
        for j, m in meet.items():
            if 5 * m >= 4 * (len(sets[i]) + len(sets[j]) - m):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for r in ngram_join.join(table).collect():
        assert (r.class_id, r.n_links) == (root(r.doc_id), links[r.doc_id])


def test_op10_ways_for_large_buckets(spark, docs, monkeypatch):
    """With buckets that are always too large, one level and one run, what is left is compared in blocks, and the audit
    calls for further runs until nothing is missed: the links stay the same.
    """
    rng = random.Random(8)
    texts = dict(list(docs.items())[:60])
    base = [f"w{rng.randrange(900)}" for _ in range(90)]
    for i in range(80):
        words = list(base)
        words[rng.randrange(90)] = f"x{i}"
        texts[10**6 + i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = lambda: sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(table).collect())
    want = rows()
    for name, value in (("FEW", 2), ("BRUTE", 8), ("DEPTH", 0), ("RUNS", 1), ("TILE", 16), ("TILE_BYTES", 4000)):
        monkeypatch.setattr(ngram_join, name, value)
    assert rows() == want and len({c for _, c, n in want if n > 50}) == 1


def test_components_raise_when_they_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(edges, 1).count()


def _main_text(page):
    tree = html_text.grow(*html_text.labelled())
    found = html_text.blocks(page)
    keep = html_text.judge(tree, html_text.features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep) if k)


def test_op7_scores_are_a_texts_own(spark, docs):
    """Alone, in another block or beside its copies: one score; of equally near neighbours label 0 and smaller ids come first."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(*quality.sample(rows, spark.read.parquet(f"{SF}/labels.parquet")))
    texts = list(docs.values())[:120] + list(docs.values())[:5]
    whole = model.score(quality.counts(texts))
    assert [float(model.score(quality.counts([t]))[0]) for t in texts] == whole.tolist()
    assert whole[:5].tolist() == whole[120:].tolist()
    n = 3 * quality.NEIGHBOURS
    tied = quality.Model(model.idf, model.axes, np.repeat(model.vectors[:1], n, axis=0), np.r_[np.zeros(quality.NEIGHBOURS - 2), np.ones(n - quality.NEIGHBOURS + 2)], 0.5)
    assert abs(tied.score(quality.counts(texts[:1]))[0] - 2 / quality.NEIGHBOURS) < 1e-9


def test_op7_driver_holds_one_table_of_counts(spark):
    """Sampling and fitting take little more of the driver's Python than the counts; the model is the one of whole tables."""
    rows, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    tracemalloc.start()
    try:
        x, y = quality.sample(rows, labels)
        assert tracemalloc.get_traced_memory()[1] < 1.75 * x.nbytes
        raw, y = np.tile(x, (1 + 2000 // len(x), 1)), np.tile(y, 1 + 2000 // len(x))
        counted = raw.copy()
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        model = quality.fit(raw, y)
        assert tracemalloc.get_traced_memory()[1] - held < raw.nbytes
    finally:
        tracemalloc.stop()
    assert np.allclose(model.vectors, model.latent(counted), atol=1e-6)
    assert np.array_equal(raw, model.weighted(counted))


def test_op2_tree_decides(spark):
    """The tree splits on words and densities of the block and of both neighbours beside what the markup says, and drops blocks of pages."""

    def columns(tree):
        return set() if tree.at < 0 else {html_text.FEATURES[tree.at]} | columns(tree.low) | columns(tree.high)

    tree = html_text.grow(*html_text.labelled())
    assert {"links", "words", "words_before", "words_after", "links_before", "links_after", "sink", "strong", "inside"} <= columns(tree)
    x, y = html_text.labelled(seed=1)  # the outlines with other words
    assert ((html_text.judge(tree, x) >= 0.5) == y).mean() > 0.99
    seen = dropped = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        keep = html_text.judge(tree, html_text.features(html_text.blocks(r.html))) >= 0.5
        seen, dropped = seen + len(keep), dropped + int((~keep).sum())
    assert 0.2 * seen < dropped < 0.8 * seen


W = lambda n, w="word": " ".join([w] * n)
LINKS = "".join(f"<li><a href=/{i}>go there</a></li>" for i in range(5))
MENU = "".join(f"<div><a href=/{i}>go there</a></div>" for i in range(4))
PAGES = [
    (f"<ul>{LINKS}</ul><h1>Big news</h1><p>{W(40)}</p><p>{W(30)}</p>", f"Big news {W(40)} {W(30)}"),  # nothing has a name
    (f"{MENU}<h1>Big news</h1><p>{W(40)}<p>{W(30)}{MENU}<div>All rights kept</div>", f"Big news {W(40)} {W(30)}"),
    (f"<p><a href=/>Home</a> <a href=/b>About us</a></p><p>{W(60)}</p><p>{W(25)}</p><p><a href=/c>More of it</a></p><p>By us</p>", f"{W(60)} {W(25)}"),
    (f"<div>Site name</div>{MENU}<p>{W(50)}</p><div><a href=/>read this too</a></div><p>{W(50)}</p>", f"{W(50)} {W(50)}"),
    (f"<article><h1>Title</h1><p>Short.</p><p>{W(90)}</p><p>Yes.</p></article>", f"Title Short. {W(90)} Yes."),
    (f"<article><h1>Title</h1><p>{W(20)}</p><ul>{LINKS}</ul><p>{W(20)}</p></article>", f"Title {W(20)} {W(20)}"),  # links without a name inside
    (f"<article><p>{W(20)}</p></article><p>{W(60, 'other')}</p>", W(20)),  # prose beside an article
    (f"<div class='ad'>{W(30, 'buy')}</div><div id=content><h2>Title</h2><p>{W(9)}</p></div>", f"Title {W(9)}"),
    (f"<article><header><h1>Title</h1><p>By someone</p></header><p>{W(20)}</p><footer>Filed under</footer></article>", f"Title {W(20)}"),
    (f"<article><p>{W(10)} <span class=advert>buy this</span> {W(10)}</p></article>", f"{W(20)}"),
    (f"<article><p>{W(10)} <b hidden>not <b>to be</b> seen</b> {W(10)}<p>{W(5)}</article>", f"{W(20)} {W(5)}"),
    (f"<article><p>{W(10)} <span class=ad>never closed<p>{W(12)}</p></article>", f"{W(10)} {W(12)}"),
    (f"<main><p>{W(15)} <a href=/x>a link</a> {W(15)}</p><form><p>{W(30, 'fill')}</p></form></main>", f"{W(15)} a link {W(15)}"),
    (f"<article><p>{W(15)}</p><select><option>one<option>two</select><textarea>x</textarea><button>Send</button></article>", W(15)),
    (f"<article><p>{W(15)}</p><select><option>never closed<p>{W(3)}</p></article>", f"{W(15)} never closed {W(3)}"),
    (f"<article><h1>A &amp; B &eacute;&#233;&#x41;</h1><p>{W(8)}&nbsp;\n \t{W(8)}</p></article>", f"A & B ééA {W(16)}"),
    (f"<main><h1>Title</h1><p>{W(12)}</p></main><section class=comments><p>{W(40, 'reply')}</p></section>", f"Title {W(12)}"),
    (f"<div class=sidebar><p>{W(40, 'side')}</p></div><h1>Title</h1><p>{W(40)}</p><div class='cookie-notice'>{W(30, 'yum')}</div>", f"Title {W(40)}"),
    ("<p>all there is</p>", "all there is"),
    (f"<p>{W(50)}</p><p>{W(30)}</p>", f"{W(50)} {W(30)}"),
    (f"<div style='display: none'>{W(50, 'gone')}</div><h1>Title</h1><p>{W(50)}</p>", f"Title {W(50)}"),
    ("<nav>" + LINKS + "</nav><script>var x = '<p>no</p>'</script><style>p{}</style>", ""),
    (f"<article><h1>Title</h1><p>{W(20)}</p><section id='social'><p>{W(40, 'people')}</p></section></article>", f"Title {W(20)} {W(40, 'people')}"),  # odd names
    (f"<article id='search-results-story' class='legal'><h1>Title</h1><p>{W(20)}</p><p>{W(5)}</p></article>", f"Title {W(25)}"),
    (f"<nav><a href=/>Home</a><article><h1>Title</h1><p>{W(20)}</p></article>", f"Title {W(20)}"),  # sinks that nothing closes
    (f"<header><p>The site</p><main><p>{W(20)}</p><p>{W(30)}</p></main>", W(50)),
    (f"<aside><a href=/x>More</a><h1>Title</h1><p>{W(40)}</p><p>{W(30)}</p>", f"Title {W(70)}"),
    ("<nav><a href=/>Home</a></nav><article><p><a href=/report>The whole report</a></p></article><footer>By us</footer>", "The whole report"),  # links that are the text
    (f"<article><h1>Title</h1><p>{W(30)}</p><h2>References</h2><ul>{LINKS}</ul></article>", f"Title {W(30)} References {' '.join(['go there'] * 5)}"),
    (f"<article><p>{W(30)}</p><div class='sponsored'><p>{W(60, 'buy')}</p></div><p>{W(9)}</p><nav>{LINKS}</nav></article>", W(39)),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_op2_pages(k):
    assert _main_text(PAGES[k][0]) == PAGES[k][1]


def test_op2_long_hostile_page():
    """Time in proportion to the page: many elements that are never closed."""
    for piece in ("<select>", "<button>x", "<a href='", "<!--", "<div class=a><p>", "&amp", "<span hidden>"):
        html_text.features(html_text.blocks("<p>start</p>" + piece * 60_000))


def test_op2_named_parts():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></ul></nav>
    <div class="cookie-banner"><p>We use cookies on this site and others of ours.</p></div><main><article><h1>Big&nbsp;News &amp; more</h1><p>First <b>bold</b> words<br>of a story.
    <p>Second one, unclosed.<aside>Buy this now, it is cheap and good</aside><script>var s = "</p><p>no</p>";</script><p>Third.</p></article></main>
    <div id="sidebar"><p>About the author and all that he ever wrote in his life.</p></div><form><label>Name</label><input></form>
    <section class="comments"><p>I liked it very much, thanks for writing this long story.</p></section><!-- ad --><footer>&copy; 2024 Someone</footer></body></html>"""
    assert _main_text(page) == "Big News & more First bold words of a story. Second one, unclosed. Third."


def test_pipeline_near_duplicates_and_personal_data_by_brute_force(spark, docs):
    """Of each group of texts that link by brute force the smallest id stays; personal data is replaced span by span."""
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    kept = p.near_duplicate_stage(spark, table, SF)
    assert kept.columns == p.COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if root(i) == i)
    spans = {r.doc_id: r.spans for r in pii.find(table).collect()}
    for r in p.personal_data_stage(spark, table, SF).collect():
        text, out, at = docs[r.doc_id], "", 0
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, -s.end)):
            if s.end > at:
                out += text[at : s.start] + {"removed": "", "general": "[TERM]"}.get(s.kind, f"[{s.kind.upper()}]")
                at = s.end
        assert r.text == out + text[at:] and r.n_chars == len(r.text)


def test_op4_many_matches(spark):
    """Positions and replacements of thousands of values in one text, in runs and across them."""
    text = "".join(f"\U0001f600 n{i}@m.example.org, +1 555 {1000000 + i} é; " for i in range(3000))
    rows = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    found = pii.find(rows).first().base
    assert len(found) == 6000 and all(text[s.start : s.end] == s.value for s in found)
    assert pii.redact(rows).first().text == "\U0001f600 [EMAIL], [PHONE] é; " * 3000


def test_pipeline_stages_by_brute_force(spark):
    """Mixing keeps each document at most once and no more tokens than its budget; packing covers what was kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = p.mixing_stage(spark, docs, SF)
    words = lambda t: len(re.findall("[^ \n\r\t]+", t or ""))
    every, kept = docs.collect(), mixed.collect()
    assert len({r.doc_id for r in kept}) == len(kept)
    assert sum(words(r.text) for r in kept) <= p.MIX_FRACTION * sum(words(r.text) for r in every)
    assert sum(words(r.text) for r in kept) >= 0.6 * sum(words(r.text) for r in every)
    packed = p.packing_stage(spark, mixed, SF).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept}


def test_sketches_are_made_in_memory_that_is_there_already():
    import tracemalloc

    from lectern.llm import ngram_join

    for n in (1, 7, ngram_join.COORDINATES, 2047, 2048, 2049, 50_000):
        found = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.array([(x * f + s).min() for f, s in zip(ngram_join._FACTORS.ravel(), ngram_join._SHIFTS.ravel())], dtype=np.uint32)
        assert ngram_join.signature(found) == (least & 255).astype(np.uint8).tobytes() + (least >> 8 & 255).astype(np.uint8).tobytes()
    tracemalloc.start()
    try:
        ngram_join.signature(found)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
