"""Personal data: base patterns with positions, and terms that give the protected value away.

Base. Four patterns, leftmost and non-overlapping for each kind. The written forms below are the contract's
patterns with possessive quantifiers and with a look-behind (or the end of the match before) at their
start; both find the same matches, and neither backtracks nor tries every start in a long run. Positions
come from the pieces between the matches.

Information-theoretic part. Over the whole corpus of N rows, n(t) rows hold the term, n(e) the value, n(t, e)
both. The share of the value's information that the term gives away is PMI(t, e) / IC(e), with
PMI = log2(n(t, e) N / (n(t) n(e))) and IC = log2(N / n(e)). A single row says little: there every rare word has the
share 1. So a term of a row is scored on the rows with other texts alone (each count less the rows of this text: what
the rest of the corpus tells of the value), unless it stands in one sentence with a base match, where all rows count.
A term is generalised where its share is at least GENERALISE and removed where it is at least REMOVE, in every row
that holds both, however far apart. As n(t, e) <= n(e), terms with n(t) > N (n(e) / N)^GENERALISE cannot reach the
share; they are left out before pairs are made. Values that stand in the same rows score alike and are one (a list
of addresses that comes again is one value), so pairs grow with a row's terms times its different sets of rows.

Every step is DataFrame functions. Only rows that hold a digit or "@" carry their texts beyond the scan.

Cases. A null text is empty and has no spans. Rows with equal texts are equal cases; all stay, also with a null
doc_id. An empty table gives no rows. Terms inside base spans are never added. find() replaces columns of the caller
that are called base or spans; redact() gives all columns back as they were but for text. Inner names begin with
"pii_"; columns of the caller that begin so are lost. Ties have no part: shares are compared with thresholds only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize, table

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){15,}+",  # shorter ones fail for their length
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERALISE, REMOVE = 0.85, 0.97
#: Tries the costly patterns on rows that can hold a match.
GUARDS = {"email": "@", "phone": "+"}
_SPAN = "struct<kind:string,start:long,end:long,value:string>"


def _ok(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":

        def luhn(total: Column, i: Column) -> Column:
            d = F.substring(digits, n - i + F.lit(1), F.lit(1)).cast("int")
            twice = d * 2
            return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

        return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


#: Steps of a fold that builds an array; what is longer is folded in pieces, as each step copies what is there.
FOLD = 128


def _pieces(items: Column) -> Column:
    """An array as an array of arrays of up to FOLD items."""
    last = F.floor((F.size(items) - 1) / FOLD).cast("int")
    return F.when(F.size(items) == 0, F.array(items)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * FOLD + 1, FOLD)))


def located(text: Column, pattern: str | Column, kind: str | Column) -> Column:
    """All matches of the pattern with their code-point positions: array of kind, start, end, value.

    Positions are running sums over the pieces between the matches, inside runs of FOLD matches and then over runs.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    name = F.lit(kind) if isinstance(kind, str) else kind
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.from_json(F.lit("[]"), f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["1"])
        end = begin + F.length(x["0"])
        one = F.struct(name.alias("kind"), begin.alias("start"), end.alias("end"), x["0"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # the last piece has no match after it
    pairs = F.zip_with(matches, F.slice(F.split(text, regex, -1), F.lit(1), F.size(matches)), lambda m, gap: F.struct(m.alias("0"), gap.alias("1")))
    runs = F.transform(_pieces(pairs), lambda run: F.aggregate(run, start, step))
    offsets = F.struct(zero.alias("at"), F.from_json(F.lit("[]"), "array<long>").alias("out"))
    before = F.aggregate(runs, offsets, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    moved = lambda s, by: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
    return F.flatten(F.zip_with(runs, before, lambda r, by: F.transform(r["out"], lambda s: moved(s, by))))


def _base(text: Column, kind: str) -> Column:
    found = F.filter(located(text, PATTERNS[kind], kind), lambda s: _ok(kind, s["value"]))
    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    return F.when(F.contains(text, F.lit(GUARDS[kind])), found).otherwise(none) if kind in GUARDS else found


def suspects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can hold base spans (with `pii_base` and the key `pii_key` of their text), and the other rows."""
    docs = docs.withColumn("pii_text", F.coalesce("text", F.lit("")))
    may = F.col("pii_text").rlike("[0-9@]")
    spans = F.concat(*[_base(F.col("pii_text"), k) for k in KINDS])
    hits = docs.where(may).withColumn("pii_base", spans)
    return hits.withColumn("pii_key", F.sha2("pii_text", 256)), docs.where(~may)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1)))


def beside(text: Column) -> Column:
    """The words in one sentence with a match of a base pattern."""
    near = []
    for kind in KINDS:
        gaps = F.split(text, PATTERNS[kind], -1)
        cut = lambda g: F.split(g, r"[.!?\n]", -1)
        last, n = lambda g: F.element_at(cut(g), -1), F.size(gaps)
        ends = F.transform(gaps, lambda g, k: F.concat_ws(" ", F.when(k > 0, cut(g)[0]), F.when(k < n - 1, last(g))))  # noqa: B023
        ends = F.when(n > 1, F.array_join(ends, " "))
        near.append(F.when(F.contains(text, F.lit(GUARDS[kind])), ends) if kind in GUARDS else ends)
    return words(F.concat_ws(" ", *near))


def _share(n_te: Column, n_t: Column, n_e: Column, n: Column) -> Column:
    """PMI / IC; 0 where a count leaves nothing to say."""
    fine = (n_te > 0) & (n_e > 0) & (n_e < n)
    return F.when(fine, F.log2(n_te * n / (n_t * n_e)) / F.log2(n / n_e)).otherwise(F.lit(0.0))


def disclosing(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """pii_key, pii_generalise and pii_remove: a text's terms that give a protected value in it away."""
    value = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9.]", "")))
    rows = hits.where(F.size("pii_base") > 0).select("pii_key", "pii_base", "pii_text")
    # equal texts are one here and count `same` times
    rows = rows.groupBy("pii_key").agg(F.count("*").alias("same"), F.first("pii_base").alias("base"), F.first("pii_text").alias("body"))
    rows = rows.select("pii_key", "same", F.array_distinct(F.transform("base", value)).alias("values"), words(F.col("body")).alias("terms"), beside(F.col("body")).alias("close"))
    rows = materialize(rows, "pii-rows")
    held = rows.select("pii_key", "same", F.explode("values").alias("value"))
    # a value's set of texts: two independent hashes, each folded by exclusive or, and its size
    of = held.groupBy("value").agg(
        F.sum("same").alias("n_e"), F.count("*").alias("texts"), F.bit_xor(F.xxhash64("pii_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "pii_key")).alias("y")
    )
    held = held.join(of, "value").select("pii_key", "same", "n_e", F.concat_ws(":", "texts", "x", "y").alias("value"))
    held = materialize(held.distinct(), "pii-values")
    n = float(docs.count())
    most = held.agg(F.max("n_e")).first()[0] or 0
    reach = lambda n_e: 1 + (1 + 1e-9) * n * F.pow(n_e / F.lit(n or 1.0), F.lit(GENERALISE))
    counts = docs.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = counts.where(F.col("n_t") <= reach(F.lit(most)))
    terms = rows.select("pii_key", F.explode("terms").alias("term"), "close").withColumn("close", F.array_contains("close", F.col("term"))).join(counts, "term")
    near = terms.join(held, "pii_key").where(F.col("n_t") <= reach(F.col("n_e")))
    near = materialize(near.select("pii_key", "same", "value", "n_e", "term", "n_t", "close"), "pii-near")
    both = near.groupBy("value", "term").agg(F.sum("same").alias("n_te"))
    others = lambda c: F.col(c) - F.when(F.col("close"), F.lit(0)).otherwise(F.col("same"))
    total = F.lit(n) - F.when(F.col("close"), F.lit(0)).otherwise(F.col("same"))
    share = _share(others("n_te"), others("n_t"), others("n_e"), total)
    mine = near.join(both, ["value", "term"]).groupBy("pii_key", "term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)
    listed = mine.groupBy("pii_key").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("remove")))).alias("terms"))
    pick = lambda flag: F.transform(F.filter("terms", lambda t: t["remove"] == flag), lambda t: t["term"])
    return listed.select("pii_key", pick(False).alias("pii_generalise"), pick(True).alias("pii_remove"))


def _found(docs: DataFrame) -> DataFrame:
    """docs with pii_text, pii_base and pii_spans: arrays of kind, start, end, value; spans are base spans, then terms."""
    docs = docs.select(*[c for c in docs.columns if not c.startswith("pii_")])
    hits, clean = suspects(docs)
    hits = materialize(hits, "pii-hits")
    # two written tables: adaptive execution splits the copies of a hot text
    out = hits.join(materialize(disclosing(docs, hits), "pii-terms"), "pii_key", "left")
    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    no_terms = F.array().cast("array<string>")
    terms = F.concat(F.coalesce("pii_generalise", no_terms), F.coalesce("pii_remove", no_terms))
    regex = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    outside = F.filter(located(F.col("pii_text"), regex, "general"), lambda s: ~F.exists("pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("pii_terms", F.when(F.size(terms) > 0, outside).otherwise(none))
    gone = lambda s: F.array_contains("pii_remove", F.lower(s["value"]))
    removed = F.transform(F.filter("pii_terms", gone), lambda s: s.withField("kind", F.lit("removed")))
    out = out.withColumn("pii_spans", F.concat("pii_base", F.filter("pii_terms", lambda s: ~F.coalesce(gone(s), F.lit(False))), F.coalesce(removed, none)))
    clean = clean.withColumns({"pii_base": none, "pii_spans": none})
    return out.drop("pii_key", "pii_generalise", "pii_remove", "pii_terms").unionByName(clean)


def find(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`: arrays of kind, start, end, value; spans are base spans, then terms."""
    own = [c for c in docs.columns if c not in ("base", "spans") and not c.startswith("pii_")]
    return _found(docs).select(*own, "pii_text", F.col("pii_base").alias("base"), F.col("pii_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind, generalised terms by a class, removed terms by nothing."""
    found = _found(docs)
    by_place = F.array_sort("pii_spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"].cast("int") - a["end"].cast("int")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["part"], (acc["at"] - acc["from"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["kind"] == "removed", F.lit("")).when(s["kind"] == "general", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        nested = s["end"] <= acc["at"]
        one = F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["from"].alias("from"), acc["part"].alias("part"), F.concat(acc["out"], gap, mark).alias("out"))
        return F.when(nested, acc).otherwise(one)

    def run(acc: Column, spans: Column) -> Column:
        """A run of spans reads its own part of the text, so that no step goes through all of it."""
        part = F.substring("pii_text", (acc["at"] + 1).cast("int"), (F.array_max(F.transform(spans, lambda s: s["end"])) - acc["at"]).cast("int"))
        first = F.struct(acc["at"].alias("at"), acc["at"].alias("from"), F.coalesce(part, F.lit("")).alias("part"), F.lit("").alias("out"))
        done = F.aggregate(spans, first, step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(_pieces(by_place), start, run)
    rest = F.substring("pii_text", (done["at"] + 1).cast("int"), F.length("pii_text"))
    text = F.when(F.size("pii_spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(done["out"], ""), rest))
    return found.withColumn("text", text).select(*[c for c in docs.columns if not c.startswith("pii_")])


def spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op4_disclosure_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelt(F.col("base")), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))
