"""Repair of conversations' structure: the cheapest edits that make their roles follow a grammar.

Rows are damaged (as a test of the repair) and classed with DataFrame functions, then brought together by a hash
of their conversation and sorted within it. In each batch of such a partition DuckDB runs one recursive query over
all its conversations at once: each recursion advances every conversation by one turn and keeps for every grammar
state the least cost with its audit. States: E nothing yet, S a system turn, U a user turn, A an assistant turn; E and
A are ends. A step is up to two inserted turns and one edit of the turn. Given a state, an edit's letter decides the
next one, so an audit stands for one repaired conversation; and of two equally cheap audits of the same turns and
state neither begins the other, so that keeping the least one a state is exact.

A conversation may be of any length: one that goes on beyond a batch leaves per state its cost, audit, running hash
and counts, and the next batch starts from them. So a task holds one batch, and one audit per state. The hash of a
repaired conversation is one sequential hash, so its turns pass through one task by the result's definition, however
many they are; that task streams them.

Cases. Nulls count as one space in what is hashed, compared and written; a null conv_id is a conversation. Rows of
one turn go by role and then by the text's SHA-256, a repeated row follows its first one. An empty role has no initial
and can't be kept; an initial is the first character as it stands, whatever the role's other letters. A conversation
whose rows all go has zeros, an empty audit and the empty string's hash. Repeated rows are duplicates; ties between
audits are ASCII-least. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import table

#: Turns a batch; the most recursions that one query makes.
BATCH = 2048
#: White space, and the marks that end a sentence.
BLANKS, ENDS = r"\x20\x09-\x0D", ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _edits() -> pa.Table:
    """Each state's steps: letters, the initial that a kept turn needs, the next state and the cost."""
    expected = {"E": "u", "S": "u", "U": "a", "A": "u"}
    rows = []
    for state in "ESUA":
        now = state
        for inserted in range(3):
            moves = [(DELETE, None, now), (REROLE, None, expected[now].upper()), (KEEP, expected[now], expected[now].upper())]
            if now == "E":
                moves.append((KEEP, "s", "S"))
            for letter, initial, after in moves:
                rows.append((state, INSERT * inserted + letter, letter, initial, after, COSTS[INSERT] * inserted + COSTS[letter]))
            now = expected[now].upper()
    columns = ["state", "letters", "edit", "needs", "after", "price"]
    return pa.table({c: [r[k] for r in rows] for k, c in enumerate(columns)})


REPAIR = """
with recursive best as (
    select conv, 0 as pos, origin, state, cost, audit from starts
    union all
    select conv, pos, origin, state, least.cost, least.audit from (
        select best.conv, turns.pos, best.origin, edits.after as state,
               min(struct_pack(cost := best.cost + edits.price + case when edits.edit = 'D' then 0 else turns.extra end, audit := best.audit || edits.letters)) as least
        from best
        join turns on turns.conv = best.conv and turns.pos = best.pos + 1
        join edits on edits.state = best.state
        where edits.edit = 'D' or (not turns.goes and (edits.edit = 'R' or edits.needs = turns.initial))
        group by all
    )
)
select best.conv, origin, state, cost, audit from best join (select conv, max(pos) as n from turns group by conv) last on last.conv = best.conv and last.n = best.pos
"""

COUNTS = """
select conv, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
       count(*) filter (where fault = 'truncated') as truncated, min(turn) as low, max(turn) as high, count(distinct turn) as held,
       count(*) filter (where pos > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, arg_min(initial, pos) as head, arg_max(initial, pos) as tail
from (select *, lag(initial) over (partition by conv order by pos) as before from turns) group by conv
"""


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage; `gone` marks rows that were dropped, `again` rows that were repeated."""
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(times).alias("again"))


def faults(rows: DataFrame) -> DataFrame:
    """Each row's first fault (empty if it has none) in its conversation; one shuffle, by conversation."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows = rows.withColumn("sha", sha).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("again")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "sha").orderBy(*order)) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), "blank").when(seen, "duplicate")
        .when(~F.col("text").rlike(rf"[{ENDS}][{BLANKS}]*\z"), "truncated").otherwise("")
    )
    return rows.withColumn("fault", fault).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


@dataclass
class Path:
    """The cheapest way to a state: what it costs, its letters, and what has been written so far."""

    cost: int = 0
    audit: str = ""
    written: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    lines: int = 0
    state: str = "E"

    def then(self, letters: str, cost: int, rows: list[tuple[str, str]]) -> Path:
        """The path after these letters over rows of role and text."""
        out = Path(cost, self.audit + letters, self.written.copy(), self.lines, self.state)
        row = iter(rows)
        for letter in letters:
            role, text = ("", "") if letter == INSERT else next(row)
            if letter == DELETE:
                continue
            if letter != KEEP:
                role = "assistant" if out.state == "U" else "user"
            out.state = role[0].upper()
            out.written.update(f"{chr(10) if out.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.lines += 1
        return out

    def ended(self) -> Path:
        more = {"S": 2, "U": 1}.get(self.state, 0)
        return self.then(INSERT * more, self.cost + COSTS[INSERT] * more, [])


@dataclass
class Open:
    """A conversation whose rows may go on in the next batch."""

    conv_id: int | None
    paths: dict[str, Path] = field(default_factory=lambda: {"E": Path()})
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    held: int = 0
    low: int | None = None
    high: int | None = None
    tail: str | None = None

    def count(self, c: dict) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + c["blank"], self.duplicate + c["duplicate"], self.truncated + c["truncated"]
        self.illegal += c["illegal"] + (self.tail is not None and self.tail + c["head"] not in ("su", "ua", "au"))
        self.held += c["held"] - (self.high is not None and self.high == c["low"])
        self.low = c["low"] if self.low is None else self.low
        self.high = self.high if c["high"] is None else c["high"]
        self.tail = c["tail"]

    def row(self) -> tuple:
        best = min((p.ended() for p in self.paths.values()), key=lambda p: (p.cost, p.audit))
        gaps = self.high - self.low + 1 - self.held if self.low is not None else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit, best.written.hexdigest())


def _advance(con, batch: pa.RecordBatch, going: Open | None) -> list[Open]:
    """The batch's conversations in order, the first of which may be the one that was going on."""
    ids = batch.column("conv_id").to_pylist()
    gone = batch.column("gone").to_numpy(zero_copy_only=False)
    changes = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
    firsts = [0, *changes]
    opened = [Open(ids[k]) for k in firsts]
    if going is not None and going.conv_id == ids[0]:
        opened[0] = going
    elif going is not None:
        opened.insert(0, going)
        firsts.insert(0, 0)
    conv = np.searchsorted(firsts, np.arange(len(ids)), side="right") - 1
    live = np.flatnonzero(~gone)
    if not len(live):
        return opened
    held = batch.take(pa.array(live))
    conv = conv[live]
    pos = np.arange(len(conv)) - np.searchsorted(conv, conv) + 1
    roles, texts, fault = held.column("role").to_pylist(), held.column("text").to_pylist(), np.array(held.column("fault").to_pylist())
    turns = {
        "conv": conv, "pos": pos, "turn": held.column("turn"), "initial": [r[:1] for r in roles], "fault": fault.tolist(),
        "goes": np.isin(fault, ["blank", "duplicate"]), "extra": (fault == "truncated").astype(np.int64),
    }
    begun = [(c, s, p.cost) for c in np.unique(conv).tolist() for s, p in opened[c].paths.items()]
    starts = {"conv": [b[0] for b in begun], "origin": [b[1] for b in begun], "state": [b[1] for b in begun], "cost": [b[2] for b in begun], "audit": [""] * len(begun)}
    con.register("turns", pa.table(turns))
    con.register("starts", pa.table(starts))
    for c in con.sql(COUNTS).to_arrow_table().to_pylist():
        opened[c["conv"]].count(c)
    reached: dict[tuple[int, str], tuple[int, str, str, str]] = {}
    for r in con.sql(REPAIR).to_arrow_table().to_pylist():
        whole = opened[r["conv"]].paths[r["origin"]].audit + r["audit"]
        key, new = (r["conv"], r["state"]), (r["cost"], whole, r["audit"], r["origin"])
        if key not in reached or new < reached[key]:
            reached[key] = new
    last, after = int(conv[-1]), {}
    bounds = np.searchsorted(conv, np.arange(len(opened) + 1))
    for (c, state), (cost, _, letters, origin) in reached.items():
        after.setdefault(c, {})[state] = (letters, cost, origin)
    for c, found in after.items():
        rows = list(zip(roles[bounds[c] : bounds[c + 1]], texts[bounds[c] : bounds[c + 1]]))
        before = opened[c].paths
        if c != last:  # only the way that is taken
            ends = {"U": 1, "S": 2}
            whole = {s: (cost + COSTS[INSERT] * ends.get(s, 0), before[o].audit + letters + INSERT * ends.get(s, 0)) for s, (letters, cost, o) in found.items()}
            found = {s: found[s] for s in [min(whole, key=whole.get)]}
        opened[c].paths = {s: before[o].then(letters, cost, rows) for s, (letters, cost, o) in found.items()}
    return opened


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation; rows as damaged() gives them."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
        con, going = duckdb.connect(config={"threads": 1}), None
        con.register("edits", _edits())

        def made(done: list[Open]) -> pa.RecordBatch:
            cells = zip(*(o.row() for o in done))
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, types)], names=names)

        for part in parts:
            for lo in range(0, part.num_rows, BATCH):
                *done, going = _advance(con, part.slice(lo, BATCH), going)
                if done:
                    yield made(done)
        if going is not None:
            yield made([going])
        con.close()

    return faults(rows).select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(batches, RESULT)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
