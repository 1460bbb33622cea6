"""Versions of documents: what is current, and what an observation of a document means."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize


def current(versions: DataFrame, document: str = "document_id", checked: str = "last_checked_at", fetched: str = "fetched_at", key: str = "id") -> DataFrame:
    """The version last checked of each document, then last fetched, then with the greatest key.

    An aggregation and not a window: it combines before the shuffle, so a hot document costs nothing.
    """
    whole = F.struct(*versions.columns)
    pick = versions.groupBy(document).agg(F.max_by(whole, F.struct(checked, fetched, key)).alias("v"))
    return pick.select("v.*")


def version_rows(observations: DataFrame, document: str, content: str, at: str) -> DataFrame:
    """One row a document and content: first seen, last checked."""
    return observations.groupBy(document, content).agg(F.min(at).alias("fetched_at"), F.max(at).alias("last_checked_at"))


def version_status(observations: DataFrame, document: str, content: str, order: list[str]) -> DataFrame:
    """new, changed or unchanged for each observation, by the one before it."""
    before = F.lag(content).over(Window.partitionBy(document).orderBy(*order))
    status = F.when(before.isNull(), "new").when(before == F.col(content), "unchanged").otherwise("changed")
    return observations.withColumn("status", status)


def status_counts(observed: DataFrame, by: str) -> DataFrame:
    kinds = ["new", "changed", "unchanged"]
    return observed.groupBy(by).agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in kinds])


MACHINE = "document string, seq long, status string, version string, is_new_version boolean"


def fold_observations(state: dict, rows: list[dict]) -> list[dict]:
    """The sequential rules over one document's observations in order; state lives on between calls.

    state: current (sha), body (its digest or None), markup (whether it is HTML), known (shas seen).
    A row: seq, sha, body (digest of the sections without preamble, None if there are none), is_html.
    """
    out = []
    for r in rows:
        now = state.get("current")
        fresh = False
        if now is None:
            status, fresh = "new", True
        elif r["sha"] == now:
            status = "unchanged"
        elif (r["is_html"] and not state["markup"]) or (state["body"] is not None and r["body"] is None):
            status = "failed"  # a page instead of the document, or a document without a body
        elif state["body"] is not None and r["body"] == state["body"]:
            status = "unchanged"  # only markup differs; the stored version stays
        else:
            status, fresh = "changed", r["sha"] not in state.get("known", ())
        if status in ("new", "changed"):
            state.update(current=r["sha"], body=r["body"], markup=r["is_html"])
            state.setdefault("known", set()).add(r["sha"])
        out.append({"seq": r["seq"], "status": status, "version": state["current"], "is_new_version": fresh})
    return out


#: Observations of a block, and maps or blocks that one task composes.
BLOCK, FAN = 1 << 12, 1 << 12
ENTRY = "document string, at long, entry string"

#: What is current: sha, body and whether it is HTML.
State = tuple[str, str | None, bool]


def _folded(state: State | None, rows: list[dict]) -> State | None:
    held = {} if state is None else {"current": state[0], "body": state[1], "markup": state[2]}
    fold_observations(held, rows)
    return (held["current"], held["body"], held["markup"]) if held else None


def _class(state: State) -> tuple[str, str]:
    """The kind of a state, which says what rows it can give way to, and what such a row must differ in."""
    sha, body, markup = state
    return f"{int(markup)}{int(body is None)}", sha if body is None else body


def block_map(rows: list[dict]) -> dict:
    """What a run of observations makes of any state before it.

    A state gives way to the first row that its kind may give way to, unless that row is as it is itself, and then to the
    first such row that isn't. From there on the run alone decides. So for each kind there is a key (of the first row),
    an outcome for states with another key, and one for states with that key; null leaves a state as it was.
    """
    states = [(r["sha"], r["body"], bool(r["is_html"])) for r in rows]
    out: dict = {"start": _folded(None, rows)}
    for markup in (False, True):
        for bare in (False, True):
            may = [k for k, s in enumerate(states) if (markup or not s[2]) and (bare or s[1] is not None)]
            key = lambda k: states[k][0] if bare else states[k][1]  # noqa: B023, E731
            other = next((k for k in may if key(k) != key(may[0])), None)
            after = lambda k: None if k is None else _folded(states[k], rows[k + 1 :])
            out[f"{int(markup)}{int(bare)}"] = (key(may[0]), after(may[0]), after(other)) if may else (None, None, None)
    return out


def applied(m: dict, state: State | None) -> State | None:
    """The state after a map."""
    if state is None:
        return m["start"]
    kind, own = _class(state)
    key, other, same = m[kind]
    out = same if key is not None and key == own else other
    return state if key is None or out is None else tuple(out)


def composed(first: dict, second: dict) -> dict:
    """The map of two runs one after the other; it is as small as each of them."""
    out = {"start": applied(second, tuple(first["start"]))}
    for kind in ("00", "01", "10", "11"):
        key, other, same = first[kind]
        if key is None:
            out[kind] = second[kind]
            continue
        if same is not None:
            left = applied(second, tuple(same))
        else:  # states with this key come through as they were
            k, o, s = second[kind]
            left = s if k == key else o
        out[kind] = (key, applied(second, tuple(other)), left)
    return out


def _entries(maps: DataFrame) -> DataFrame:
    """document, at, entry: the state in which each map of a document (document, at, map; ascending) is entered."""

    def scan(frame: pd.DataFrame, state: State | None) -> pd.DataFrame:
        out = []
        for r in frame.sort_values("at").itertuples(index=False):
            out.append((r.document, r.at, json.dumps(state)))
            state = applied(json.loads(r.map), state)
        return pd.DataFrame(out, columns=["document", "at", "entry"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return scan(frame, None)

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        begun = json.loads(frame["upper_entry"].iloc[0])
        return scan(frame, tuple(begun) if begun else None)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        found = None
        for m in map(json.loads, frame.sort_values("at")["map"]):
            found = m if found is None else composed(found, m)
        return pd.DataFrame([(frame["document"].iloc[0], frame["upper"].iloc[0], json.dumps(found))], columns=["document", "at", "map"])

    most = maps.groupBy("document").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FAN:
        return maps.groupBy("document").applyInPandas(whole, ENTRY)
    maps = maps.withColumn("upper", F.expr(f"at div {FAN}"))
    above = materialize(maps.groupBy("document", "upper").applyInPandas(joined, "document string, at long, map string"), "upper-maps")
    entered = _entries(above).select(F.col("document").alias("of"), F.col("at").alias("of_upper"), F.col("entry").alias("upper_entry"))
    held = maps.join(entered, (F.col("document") == F.col("of")) & (F.col("upper") == F.col("of_upper")))
    return held.groupBy("document", "upper").applyInPandas(inside, ENTRY)


def version_machine(observations: DataFrame) -> DataFrame:
    """observations: document, seq, sha, body, is_html. One row each: its status and the version it leaves current.

    body and is_html are told from the content that sha is the digest of, so that equal shas have equal ones. Rows are
    dealt to ranges by document and seq and then to blocks of BLOCK, whatever document they are of. A block that a
    document goes through is summed up as a map of states; maps are composed, in ranges where there are many,
    and each block is gone through once more from the state in which it is entered. No document is one task's.
    """
    columns = ["document", "seq", "sha", "body", "is_html"]
    ranged = observations.select(*columns).repartitionByRange("document", "seq").sortWithinPartitions("document", "seq")
    rows = materialize(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("at", F.expr(f"place div {BLOCK}")), "observed")

    def records(frame: pd.DataFrame) -> list[dict]:
        return [
            {"seq": r.seq, "sha": r.sha, "body": None if pd.isna(r.body) else r.body, "is_html": bool(r.is_html), "place": r.place, "document": r.document}
            for r in frame.sort_values("place").itertuples(index=False)
        ]

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        found = records(frame)
        edges = {found[0]["document"], found[-1]["document"]}  # the others are wholly in this block
        at = int(frame["at"].iloc[0])
        out = [(d, at, json.dumps(block_map([r for r in found if r["document"] == d]))) for d in edges]
        return pd.DataFrame(out, columns=["document", "at", "map"])

    def replayed(frame: pd.DataFrame) -> pd.DataFrame:
        begun = frame.dropna(subset=["entry"])
        entered = {d: json.loads(e) for d, e in zip(begun["document"], begun["entry"])}
        out = []
        for document, some in itertools.groupby(records(frame), key=lambda r: r["document"]):
            some, state = list(some), entered.get(document)
            held = {"current": state[0], "body": state[1], "markup": state[2]} if state else {}
            out += [(document, r["seq"], o["status"], o["version"], r["place"]) for r, o in zip(some, fold_observations(held, some))]
        return pd.DataFrame(out, columns=["document", "seq", "status", "version", "place"])

    maps = materialize(rows.groupBy("at").applyInPandas(summed, "document string, at long, map string"), "maps")
    through = maps.join(maps.groupBy("document").agg(F.count("*").alias("blocks")).where("blocks > 1").select("document"), "document", "left_semi")
    entries = materialize(_entries(through).where("entry <> 'null'"), "entries")
    known = rows.join(entries, ["document", "at"], "left")
    told = materialize(known.groupBy("at").applyInPandas(replayed, "document string, seq long, status string, version string, place long"), "told")
    first = told.where("status in ('new', 'changed')").groupBy("document", "version").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    return told.join(first, "place", "left").select("document", "seq", "status", "version", F.coalesce("is_first", F.lit(False)).alias("is_new_version"))


def stream_machine(observations: DataFrame) -> DataFrame:
    """The same rules on a stream (document, seq, sha, body, is_html), with the state kept by Spark.

    Observations of one micro-batch are put in order of seq; a later batch is taken as later.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state: dict = {}
        if held.exists:
            current_sha, body, markup, known = held.get
            state = {"current": current_sha, "body": body, "markup": markup, "known": set(known.split(","))}
        frame = pd.concat(list(frames)).sort_values("seq")
        rows = [{"seq": r.seq, "sha": r.sha, "body": None if pd.isna(r.body) else r.body, "is_html": bool(r.is_html)} for r in frame.itertuples(index=False)]
        out = fold_observations(state, rows)
        held.update((state["current"], state["body"], state["markup"], ",".join(sorted(state["known"]))))
        yield pd.DataFrame(out).assign(document=key[0])[["document", "seq", "status", "version", "is_new_version"]]

    return observations.groupBy("document").applyInPandasWithState(
        step, MACHINE, "current string, body string, markup boolean, known string", "append", GroupStateTimeout.NoTimeout
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new (a merge that never deletes)."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def stale(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are stored and no longer listed."""
    return old.select(*key).join(new.select(*key), key, "left_anti")


def sync_plan(known: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """What an incremental rebuild has to do for each key: new, changed, same or gone."""
    a, b = known.select(F.col(key), F.col(digest).alias("old")), now.select(F.col(key), F.col(digest).alias("new"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
