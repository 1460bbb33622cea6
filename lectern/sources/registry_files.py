"""Registries kept as YAML: read by Spark, checked as rows, used as small tables.

A registry is written by hand and small; its text passes the driver, its rules are the violations of
lectern.operators.validate. PyYAML is needed only here.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import validate

SOURCE = (
    "id string, publisher string, title string, url string, language string, doc_type string, tags array<string>, scope string, translation_of string, "
    "section_pattern string, chapter_pattern string, body_start string, body_end string, chapter_label string, first_chapter string, section_label string, "
    "skip_sections string, skip_classes array<string>, drop_preamble boolean, extract_note string"
)
SCOPE = "id string, name string, aliases array<string>, languages array<string>, details map<string,string>"
AVAILABILITY = "scope string, tag string, status string, source_id string, effective_from string, note string"
GOLDEN = "query_id int, query string, source_glob string, section_glob string, tags array<string>, scopes array<string>"


def read_yaml(spark: SparkSession, path: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("registries need PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(text[0]) if text else None


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.replace("map<string,string>", "map").split(",")]


def unknown_fields(entries: list[dict], schema: str) -> list[str]:
    known = set(_names(schema))
    return [f"entry {i}: unknown field {k!r}" for i, e in enumerate(entries, 1) for k in e if k not in known]


def sources(spark: SparkSession, path: str) -> DataFrame:
    entries = read_yaml(spark, path) or []
    if wrong := unknown_fields(entries, SOURCE):
        raise ValueError("\n".join(wrong))
    return spark.createDataFrame([tuple(e.get(n) for n in _names(SOURCE)) for e in entries], SOURCE)


def scopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scopes and what each states on its tags."""
    entries = read_yaml(spark, path) or []
    rows = [(e.get("id"), e.get("name"), e.get("aliases") or [], e.get("languages") or [], {k: str(v) for k, v in (e.get("details") or {}).items()}) for e in entries]
    stated = [
        (e.get("id"), tag, s.get("status"), s.get("source"), None if s.get("effective_from") is None else str(s["effective_from"]), s.get("note"))
        for e in entries for tag, s in (e.get("availability") or {}).items()
    ]
    return spark.createDataFrame(rows, SCOPE), spark.createDataFrame(stated, AVAILABILITY)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place that a question's answer may stand in; ValueError lists all questions that lack something."""
    entries = read_yaml(spark, path) or []
    wrong = [f"question {i}: text and expect are needed" for i, e in enumerate(entries, 1) if not str(e.get("question") or "").strip() or not e.get("expect")]
    if wrong:
        raise ValueError("\n".join(wrong))
    rows = [
        (i, e["question"], x.get("source"), x.get("section", "*"), e.get("tags") or [], e.get("scopes") or [])
        for i, e in enumerate(entries, 1) for x in e["expect"]
    ]
    return spark.createDataFrame(rows, GOLDEN)


DOC_TYPE, TERM, PUBLISHER = "id string, binding boolean, note string", "id string, label string, description string", "publisher string, domains array<string>, official boolean"
#: What a domain has and, of each part, what its entries have. Parts are mappings, lists of mappings, or lists of names.
PARTS = {
    "modalities": ["id", "description"], "topics": ["id", "label", "description"], "publishers": ["name", "domains", "official"],
    "scopes": ["label"], "availability": ["tags", "values", "unknown"],
}
DOMAIN = ["name", "instructions", "doc_types", "tags", "modalities", "topics"]  # the other parts may be missing


class Domain(NamedTuple):
    """A domain's registry as small tables; lists keep their order in `place` (0 is most authoritative or strongest)."""

    name: str
    instructions: str
    scope_label: str | None
    availability: dict | None
    doc_types: DataFrame
    tags: DataFrame
    modalities: DataFrame
    topics: DataFrame
    publishers: DataFrame


def _is_text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _are_names(x) -> bool:
    return isinstance(x, list) and bool(x) and all(isinstance(v, str) for v in x)


def _shape(raw: dict) -> list[str]:
    """What in a domain is of another kind than it should be; the rules on values need rows and so come after these."""
    out = [f"unknown field {k!r}" for k in sorted(map(str, raw)) if k not in DOMAIN and k not in PARTS]
    out += [f"{k} has to be a text" for k in ("name", "instructions") if not _is_text(raw.get(k))]
    out += [] if _are_names(raw.get("tags")) else ["tags has to be a list of names"]
    types = raw.get("doc_types")
    ids = [t.get("id") if isinstance(t, dict) else t for t in types] if isinstance(types, list) else types
    out += [] if _are_names(ids) else ["doc_types has to be a list of names, or of entries with an id"]
    for t in types if isinstance(types, list) else []:
        if isinstance(t, dict):
            where = f"doc_types {t.get('id')!r}"
            out += [f"{where}: unknown field {k!r}" for k in t if k not in ("id", "binding", "note")]
            out += [f"{where}: binding has to be true or false"] if not isinstance(t.get("binding", True), bool) else []
            out += [f"{where}: note has to be a text"] if "note" in t and not _is_text(t["note"]) else []
    kinds = {"domains": _are_names, "official": lambda x: isinstance(x, bool)}
    for part in ("modalities", "topics", "publishers"):
        entries = raw.get(part)
        if part == "publishers" and entries is None:
            continue
        if not isinstance(entries, list) or not entries:
            out.append(f"{part} has to be a list")
            continue
        fits = [isinstance(e, dict) and set(e) == set(PARTS[part]) and all(kinds.get(k, _is_text)(v) for k, v in e.items()) for e in entries]
        out += [f"{part} entry {i}: needs {', '.join(PARTS[part])} and nothing else" for i, fit in enumerate(fits, 1) if not fit]
    scopes_, stated = raw.get("scopes"), raw.get("availability")
    if scopes_ is not None and not (isinstance(scopes_, dict) and [*scopes_] == PARTS["scopes"] and _is_text(scopes_["label"])):
        out.append("scopes needs a label and nothing else")
    if stated is not None and scopes_ is None:
        out.append("availability needs scopes")
    elif stated is not None:
        fits = isinstance(stated, dict) and set(stated) == set(PARTS["availability"])
        fits = fits and _are_names(stated["tags"]) and _are_names(stated["values"]) and isinstance(stated["unknown"], str)
        out += [] if fits else [f"availability needs {', '.join(PARTS['availability'])} and nothing else"]
    return out


def domain(spark: SparkSession, path: str) -> Domain:
    """A domain's registry; ValueError lists all that is wrong: first what is of the wrong kind, else the rules broken by its rows."""
    raw = read_yaml(spark, path)
    if not isinstance(raw, dict):
        raise ValueError("a domain has to be a mapping")
    if wrong := _shape(raw):
        raise ValueError("\n".join(wrong))

    def rows(part: str, schema: str, entries: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], f"place int, {schema}")

    plain = lambda text: " ".join(text.split())
    typed = [t if isinstance(t, dict) else {"id": t} for t in raw["doc_types"]]
    types = rows("doc_types", DOC_TYPE, [(t["id"], t.get("binding", True), plain(t["note"]) if "note" in t else None) for t in typed])
    tags = rows("tags", "id string", [(t,) for t in raw["tags"]])
    modalities = rows("modalities", TERM, [(m["id"], m["description"], m["description"]) for m in raw["modalities"]])
    topics = rows("topics", TERM, [(t["id"], t["label"], t["description"]) for t in raw["topics"]])
    publishers = rows("publishers", PUBLISHER, [(p["name"].strip(), p["domains"], p["official"]) for p in raw.get("publishers") or []])
    stated = raw.get("availability")
    lists = [("tags", raw["tags"]), *((f"availability.{k}", v) for k, v in (stated or {}).items() if k != "unknown")]
    found = [
        validate.doc_types(types), validate.terms(modalities, "modality"), validate.terms(topics, "topic"), validate.publishers(publishers),
        validate.slugs(spark.createDataFrame(lists, "entity string, items array<string>"), "entity", "items", "list"),
    ]
    if stated:
        one = spark.createDataFrame([("availability", True, stated["tags"], raw["tags"], stated["values"], stated["unknown"])], "id string, has_scopes boolean, tags array<string>, domain_tags array<string>, statuses array<string>, unknown string")
        # a domain names its own unknown status
        found += [validate.domain_availability(one).where("rule <> 'domain.availability_unknown'"), validate.unknown_status(one)]
    broken = found[0]
    for more in found[1:]:
        broken = broken.unionByName(more)
    if wrong := sorted(f"{r.rule}: {r.entity}: {r.message}" for r in broken.collect()):
        raise ValueError("\n".join(wrong))
    label = raw["scopes"]["label"].strip() if raw.get("scopes") else None
    return Domain(raw["name"].strip(), plain(raw["instructions"]), label, stated, types, tags, modalities, topics, publishers)


def non_binding(found: Domain) -> list[str]:
    """The document types that don't bind; a domain has few."""
    return [r[0] for r in found.doc_types.where(~F.col("binding")).orderBy("place").select("id").collect()]
