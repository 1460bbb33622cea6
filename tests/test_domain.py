"""A domain's registry from YAML to tables, and all that can be wrong with it."""

import pytest

from lectern.operators import trust
from lectern.sources import registry_files

GOOD = """
name: " Safety "
instructions: |
  Read
  closely.
doc_types: [act, {id: case, binding: false, note: "Shows how\\n courts read it"}, guidance]
tags: [adults, young-people]
modalities: [{id: must, description: a duty}, {id: may, description: a choice}]
topics: [{id: noise, label: Noise, description: Loud places}]
scopes: {label: country}
availability: {tags: [adults], values: ["yes", "no"], unknown: unknown}
publishers: [{name: " State ", domains: [law.example.org], official: true}]
"""


def load(spark, tmp_path, text):
    path = tmp_path / "domain.yaml"
    path.write_text(text)
    return registry_files.domain(spark, str(path))


def test_a_domain_as_tables(spark, tmp_path):
    d = load(spark, tmp_path, GOOD)
    assert (d.name, d.instructions, d.scope_label, d.availability["values"]) == ("Safety", "Read closely.", "country", ["yes", "no"])
    assert [tuple(r) for r in d.doc_types.orderBy("place").collect()] == [(0, "act", True, None), (1, "case", False, "Shows how courts read it"), (2, "guidance", True, None)]
    assert registry_files.non_binding(d) == ["case"]
    assert [r.id for r in d.modalities.orderBy("place").collect()] == ["must", "may"] and d.topics.first().label == "Noise"
    documents = spark.createDataFrame([("a", "State", "https://www.law.example.org/1"), ("b", "Other", "https://law.example.org/")], "id string, publisher string, url string")
    assert [(r.id, r.on_domain, r.official) for r in trust.provenance(documents, d.publishers).orderBy("id").collect()] == [("a", True, True), ("b", False, False)]


def test_a_domain_without_the_parts_that_may_be_missing(spark, tmp_path):
    text = "\n".join(line for line in GOOD.splitlines() if not line.startswith(("scopes", "availability", "publishers")))
    d = load(spark, tmp_path, text)
    assert d.scope_label is None and d.availability is None and d.publishers.count() == 0


SHAPES = [
    ("name:", "nme:", ["unknown field 'nme'", "name has to be a text"]), ("[adults, young-people]", "adults", ["tags has to be a list of names"]), ("[adults, young-people]", "[]", ["tags has to be a list of names"]),
    ("binding: false", "binding: nope", ["doc_types 'case': binding has to be true or false"]), ("id: case,", "id: case, kind: x,", ["doc_types 'case': unknown field 'kind'"]), ("[act,", "[7,", ["doc_types has to be a list of names, or of entries with an id"]),
    ("label: Noise, ", "", ["topics entry 1: needs id, label, description and nothing else"]), ("description: a choice", 'description: " "', ["modalities entry 2: needs id, description and nothing else"]),
    ("official: true", "official: 1", ["publishers entry 1: needs name, domains, official and nothing else"]), ("{label: country}", "{label: country, x: 1}", ["scopes needs a label and nothing else"]),
    ("scopes: {label: country}\n", "", ["availability needs scopes"]), (", unknown: unknown", "", ["availability needs tags, values, unknown and nothing else"]),
]


@pytest.mark.parametrize(("old", "new", "said"), SHAPES)
def test_wrong_kinds(spark, tmp_path, old, new, said):
    with pytest.raises(ValueError) as e:
        load(spark, tmp_path, GOOD.replace(old, new, 1))
    assert str(e.value).splitlines() == said


def test_broken_rules_are_all_told(spark, tmp_path):
    text = GOOD.replace("[act,", "[Act, guidance,").replace("young-people]", "adults]").replace("id: may", "id: must").replace("[law.example.org]", "[Law.example.org]")
    text = text.replace(', note: "Shows how\\n courts read it"', "").replace("tags: [adults], values", "tags: [old], values").replace("unknown: unknown", "unknown: 'yes'")
    with pytest.raises(ValueError) as e:
        load(spark, tmp_path, text)
    told = {line.split(": ")[0] for line in str(e.value).splitlines()}
    assert told == {"doc_type.id", "doc_type.unique", "doc_type.binding", "list.once", "modality.unique", "publisher.domains", "domain.availability_tags", "domain.availability_unknown_own"}


def test_no_mapping(spark, tmp_path):
    with pytest.raises(ValueError, match="mapping"):
        load(spark, tmp_path, "- a\n")
