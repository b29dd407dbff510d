"""Repair of the structure of conversations: cheapest edits by forward Viterbi.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``:
perhaps a system turn, then users and assistants in turns.  Its rows are read in
order of their turn.  Each is kept (K, 0), given another role (R, 1) or deleted
(D, 2), and empty turns may be inserted anywhere (I, 5); what is blank or a
duplicate must go, and a truncated text that stays costs 5 more.

A layer holds, for each of the four states of the grammar (nothing, system, user,
assistant), the least (cost, edits) that ends there; a row makes the next layer,
and inserts close it.  Two equally dear edit strings of one layer never begin with
one another (more inserts cost more), so the lesser of two prefixes stays the
lesser whatever follows, and the least string as a whole is found.

Rows are shuffled by conversation, sorted and streamed.  Edits are written as soon
as all states that can still win agree on them, which mostly is a row or two later,
so a task holds a few rows of a conversation, not the conversation, and 16 bytes
for each different turn of it (to know duplicates).  One task reads a conversation
from first to last: a repair depends on all rows before.

Edge cases: a null role or text counts as one space; a null turn comes first; a null
conversation id is a conversation; rows of equal turn (ties) are ordered by role,
then text; repeated rows are duplicates, all but the first; an empty role has no
initial and can only be given another or be deleted; texts are taken whole; an empty
table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

# Costs of the edits, and what a truncated text that stays costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
#: State before -> state after, by the role's initial.
MOVES = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, ASKED), (SYSTEM, ASKED), (ANSWERED, ASKED)), "a": ((ASKED, ANSWERED),)}
TURNS = MOVES["u"] + MOVES["a"]
SPACES = " \t\n\v\f\r"
LOG = "conv_id long, place long, edit string, turn long, role string, text string, fault string, illegal boolean, cost int"
#: Open edits from which on a task looks for those that are settled.
OPEN = 16
#: Characters of text of one Arrow batch.
BATCH_CHARS = 1 << 22


def fault_of(role: str, text: str, seen: set[bytes]) -> str | None:
    """The first fault of a row: blank, duplicate or truncated; the row is added to those seen."""
    last = text.rstrip(SPACES)[-1:]
    if not last:
        return "blank"
    raw = role.encode("utf-8", "surrogatepass")
    key = blake2b(len(raw).to_bytes(8, "big") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if key in seen:
        return "duplicate"
    seen.add(key)
    return None if last in ".!?" else "truncated"


def closed(layer: list) -> list:
    """The layer after any inserts: two rounds reach every state there is a use in reaching."""
    for _ in range(2):
        for a, b in TURNS:
            if layer[a] is not None:
                way = (layer[a][0] + INSERT, layer[a][1] + "I")
                if layer[b] is None or way < layer[b]:
                    layer[b] = way
    return layer


def step(layer: list, role: str, fault: str | None) -> list:
    """The layer after one more row."""
    new = [None if w is None else (w[0] + DELETE, w[1] + "D") for w in layer]
    if fault in (None, "truncated"):
        extra = TRUNCATED if fault else 0
        for letter, cost, moves in (("K", KEEP, MOVES.get(role[:1], ())), ("R", REROLE, TURNS)):
            for a, b in moves:
                if layer[a] is not None:
                    way = (layer[a][0] + cost + extra, layer[a][1] + letter)
                    if new[b] is None or way < new[b]:
                        new[b] = way
    return closed(new)


def pruned(layer: list) -> list:
    """Without states that cannot win: whatever follows, an answered conversation does as well as one that has only a
    system turn, and for a deletion as well as one that has nothing."""
    best = layer[ANSWERED]
    if best is not None:
        for state, gap in ((SYSTEM, 0), (NOTHING, DELETE)):
            if layer[state] is not None and layer[state][0] > best[0] + gap:
                layer[state] = None
    return layer


class Repair:
    """One conversation: rows go in by ``add``; settled rows of the log come out of it and of ``end``."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.layer = closed([(0, ""), None, None, None])
        self.open: list[tuple] = []
        self.seen: set[bytes] = set()
        self.state, self.place, self.before = NOTHING, 0, None

    def add(self, turn, role: str, text: str) -> list[tuple]:
        fault = fault_of(role, text, self.seen)
        illegal = self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.open.append((turn, role, text, fault, illegal))
        self.layer = pruned(step(self.layer, role, fault))
        if len(self.open) % OPEN:
            return []
        return self.settle(commonprefix([w[1] for w in self.layer if w is not None]))

    def end(self) -> list[tuple]:
        """The rest of the log; a conversation without rows has one row without an edit."""
        best = min(w for w in (self.layer[NOTHING], self.layer[ANSWERED]) if w is not None)
        out = self.settle(best[1])
        return out if self.place else [(self.conv_id, 0, None, None, None, None, None, False, 0)]

    def settle(self, edits: str) -> list[tuple]:
        out, used = [], 0
        for edit in edits:
            turn, role, text, fault, illegal = (None, "", "", None, False) if edit == "I" else self.open[used]
            used += edit != "I"
            cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit in "RI":
                role = ASSISTANT if self.state == ASKED else USER
            if edit != "D":
                self.state = {a: b for a, b in MOVES[role[:1]]}[self.state]
            out.append((self.conv_id, self.place, edit, turn, role, text, fault, illegal, cost))
            self.place += 1
        self.layer = [None if w is None else (w[0], w[1][len(edits):]) if w[1].startswith(edits) else None for w in self.layer]
        self.open = self.open[used:]
        return out


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: Column | None = None) -> DataFrame:
    """The log of all edits (LOG): one row per edit, in the order of ``place`` within its conversation.

    Rows with an edit other than D, in order, are the repaired conversation.  Deleted rows keep their role and text,
    inserted ones have no turn.  Rows that are not ``alive`` only name their conversation.
    """
    import pyarrow as pa

    names = ["conv_id", "place", "edit", "turn", "role", "text", "fault", "illegal", "cost"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        now, out, chars = None, [], 0
        for b in slices(batches):
            for conv, live, at, who, said in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now is None or now.conv_id != conv:
                    out += now.end() if now else []
                    now = Repair(conv)
                if live:
                    out += now.add(at, who, said)
                    chars += len(said)
                if len(out) >= 1000 or out and chars > BATCH_CHARS:
                    yield packed(out)
                    out, chars = [], 0
        out += now.end() if now else []
        if out:
            yield packed(out)

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    live = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    rows = turns.select(F.col(key).cast("long").alias("conv_id"), live.alias("alive"), F.col(turn).cast("long").alias("turn"),
                        *[F.when(live, space(c)).otherwise(F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, LOG)
