"""The version machine by blocks against its rules applied one observation after another."""

import random

import pytest

from lectern.operators import versions

ROWS = "document string, seq long, sha string, body string, is_html boolean"


def _contents(rng, n):
    """sha -> (body, is_html); some share a body, some have none."""
    return {f"s{k}": (rng.choice([None, f"b{k}", "b0", "b1"]), rng.random() < 0.4) for k in range(n)}


def _want(rows):
    out = {}
    for document in {r[0] for r in rows}:
        mine = [dict(zip(("seq", "sha", "body", "is_html"), r[1:])) for r in sorted(r for r in rows if r[0] == document)]
        for o in versions.fold_observations({}, mine):
            out[document, o["seq"]] = (o["status"], o["version"], o["is_new_version"])
    return out


@pytest.mark.parametrize("block, fan", [(4096, 4096), (8, 4096), (8, 3), (1, 2)])
def test_blocks_are_the_rules(spark, monkeypatch, block, fan):
    monkeypatch.setattr(versions, "BLOCK", block)
    monkeypatch.setattr(versions, "FAN", fan)
    rng = random.Random(block + fan)
    rows = []
    for d in range(12):  # the first document holds a third of all rows
        held = _contents(rng, rng.choice([2, 4, 8]))
        for seq in range(150 if d == 0 else rng.choice([1, 3, 40])):
            sha = rng.choice(list(held))
            rows.append((f"d{d}", seq, sha, *held[sha]))
    order = rows[:]
    rng.shuffle(order)
    found = {(r.document, r.seq): (r.status, r.version, r.is_new_version) for r in versions.version_machine(spark.createDataFrame(order, ROWS).repartition(4)).collect()}
    assert found == _want(rows)


def test_maps_compose():
    rng = random.Random(2)
    for _ in range(300):
        held = _contents(rng, rng.choice([1, 2, 3, 6]))
        row = lambda: (lambda sha: {"seq": 0, "sha": sha, "body": held[sha][0], "is_html": held[sha][1]})(rng.choice(list(held)))  # noqa: B023, E731
        runs = [[row() for _ in range(rng.choice([1, 2, 5]))] for _ in range(3)]
        maps = [versions.block_map(r) for r in runs]
        left = versions.composed(versions.composed(maps[0], maps[1]), maps[2])
        right = versions.composed(maps[0], versions.composed(maps[1], maps[2]))
        for state in [None, *((s, *held[s]) for s in held), ("elsewhere", "b0", True), ("elsewhere2", None, False)]:
            want = versions._folded(state, sum(runs, []))
            assert versions.applied(left, state) == versions.applied(right, state) == want


def test_hot_document_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(versions, "BLOCK", 64)
    rows = [("hot" if k % 3 == 0 else f"d{k}", k, f"s{k % 5}", f"b{k % 5}", False) for k in range(3000)]
    blocks = []
    monkeypatch.setattr(versions, "_entries", lambda maps, f=versions._entries: blocks.append(maps.where("document = 'hot'").count()) or f(maps))
    found = versions.version_machine(spark.createDataFrame(rows, ROWS)).where("document = 'hot'").collect()
    assert len(found) == 1000 and blocks[0] >= 15 and sum(r.is_new_version for r in found) == 5


def test_empty(spark):
    assert versions.version_machine(spark.createDataFrame([], ROWS)).count() == 0
