"""Many margins of one table, each summed from the smallest margin at hand.

GROUPING SETS copies every row once per margin: all pairs of 30 variables copy a table 465 times.  Here a few larger margins
are written first and the rest are summed from them.  Which ones is decided on the lattice of variable sets: margins that are
summed from the table are put together two by two, those whose union makes the smallest table first, as long as that saves
copying rows, a row of the union counting ``SHUFFLED`` times; a union that does not save ``WORTH`` rows is left out again.
Sizes are bounds: a margin has no more rows than states, and no more than what it is summed from.  Steps of a ``Rollup`` have
at most ``STEP_CELLS`` states however large the table is: every task sums its part of the table to at most that many rows
before it shuffles them, so the shuffle does not grow to the table's size.

States that fit into a long (``packing``) are summed as such, others by grouping sets.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Schema
from .packing import Packing
from .storage import drop, materialise
from .table import SETS_PER_JOB, VALUE, entropies_of, project_many

#: Copied rows that a written margin must save.
WORTH = 1 << 20
#: Copied rows that cost as much as one row of a step: it is shuffled, written and read.
SHUFFLED = 8
#: States of a step, at most, unless it is asked for itself.
STEP_CELLS = 1 << 16


def cover(masks, cells, most: int) -> list[int]:
    """Masks that contain all given ones, put together largest first where their union has at most ``most`` states and grows least."""
    steps: list[int] = []
    for m in sorted(set(masks), key=lambda m: (-cells(m), m)):
        if any(m & ~s == 0 for s in steps):
            continue
        fits = [(cells(s | m), k) for k, s in enumerate(steps) if cells(s | m) <= most]
        if fits:
            steps[min(fits)[1]] |= m
        else:
            steps.append(m)
    return steps


@dataclass(frozen=True)
class Node:
    """A margin, and what it is summed from (0: the table).  ``wanted``: asked for, not only a step."""

    mask: int
    parent: int
    wanted: bool


def plan(masks, rows: int, cells, full: int, worth: int = WORTH, most: int | None = None) -> list[Node]:
    """Margins in an order in which each comes after what it is summed from.

    rows: of the table; cells: states of a mask; full: the mask of all variables; most: states of a union, None for any number.
    """
    wanted = list(dict.fromkeys(masks))
    asked = set(wanted)
    size = lambda m: min(rows, cells(m)) if m else rows
    pays = lambda m: (most is None or cells(m) <= most) and (2 + SHUFFLED) * size(m) < rows  # noqa: E731  two margins summed from it cost less than from the table
    parent = dict.fromkeys(wanted, 0)
    tops = set(wanted)
    heap = [(size(a | b), a | b) for a in tops for b in tops if a < b and a | b != full and pays(a | b)]
    heap = list(set(heap))
    heapq.heapify(heap)
    while heap:
        _, union = heapq.heappop(heap)
        own = {m for m in tops if m & ~union == 0 and m != union}
        if not own or union not in tops and len(own) < 2:
            continue
        for m in own:
            parent[m] = union
        parent.setdefault(union, 0)
        tops = (tops - own) | {union}
        for m in tops:
            more = m | union
            if m != union and more != full and pays(more):
                heapq.heappush(heap, (size(more), more))
    # steps that hardly save: what is summed from them is summed from what they would be
    for step in sorted(parent, key=size):
        children, above = [m for m, p in parent.items() if p == step], size(parent[step])
        saved = len(children) * (above - size(step)) - SHUFFLED * size(step) - (0 if step in asked else above)
        if children and saved < worth:
            for m in children:
                parent[m] = parent[step]
            if step not in asked:
                del parent[step]
    out: list[Node] = []
    done, left = {0}, dict(parent)
    while left:
        for m in [m for m, p in left.items() if p in done]:
            out.append(Node(m, left.pop(m), m in asked))
            done.add(m)
    return out


def copied_rows(nodes: list[Node], rows: int, cells) -> int:
    """Rows that grouping copies for a plan, by the bounds of its sizes."""
    return sum(min(rows, cells(n.parent)) if n.parent else rows for n in nodes)


class Rollup:
    """The margins of one table.  ``release`` deletes what was written for them."""

    def __init__(self, t: DataFrame, schema: Schema, masks, rows: int, worth: int = WORTH):
        self.schema, self.table = schema, t
        try:
            self.packing = Packing(schema)
        except ValidationError:  # too wide for a long
            self.packing = None
        self.nodes = plan(masks, rows, schema.cells, schema.full, worth, STEP_CELLS)
        if not self.nodes:
            raise ValidationError("no projection given")
        self.written: list[DataFrame] = []
        self._sources: dict[int, DataFrame] = {0: t if self.packing is None else t.select(self.packing.key().alias("key"), VALUE)}
        steps = {n.parent for n in self.nodes} - {0}
        depth = {0: 0}
        for n in self.nodes:
            depth[n.mask] = depth[n.parent] + 1
        for level in range(1, max(depth.values()) + 1):  # the steps of a level are written together
            own = [n for n in self.nodes if n.mask in steps and depth[n.mask] == level]
            if own:
                stored = materialise(self._summed(own), by="mask")
                self.written.append(stored)
                for n in own:
                    names = schema.names(n.mask) if self.packing is None else ["key"]
                    self._sources[n.mask] = stored.where(F.col("mask") == n.mask).select(*names, VALUE)

    def _summed(self, nodes: list[Node]) -> DataFrame:
        out = None
        for p in dict.fromkeys(n.parent for n in nodes):
            own = [n.mask for n in nodes if n.parent == p]
            source = self._sources[p]
            if self.packing is not None:
                part = self.packing.sums(source, own)
                out = part if out is None else out.union(part)
                continue
            missing = [c for c in self.schema.columns if c not in source.columns]
            small = self.schema.select([c for c in self.schema.columns if c in source.columns])
            place = {c: k for k, c in enumerate(small.columns)}
            for at in range(0, len(own), SETS_PER_JOB):
                some = {sum(1 << place[c] for c in self.schema.names(m)): m for m in own[at: at + SETS_PER_JOB]}
                part = project_many(source, small, list(some))
                to = F.create_map(*[x for a, b in some.items() for x in (F.lit(a).cast("long"), F.lit(b).cast("long"))])
                part = part.select(*[F.lit(None).cast("int").alias(c) if c in missing else F.col(c) for c in self.schema.columns], VALUE, F.element_at(to, F.col("mask")).alias("mask"))
                out = part if out is None else out.union(part)
        return out

    def margins(self) -> DataFrame:
        """All margins asked for: the schema's columns (null where summed out), value and mask."""
        out = self._asked()
        return out if self.packing is None else out.select(*self.packing.codes(F.col("key"), F.col("mask")), VALUE, "mask")

    def _asked(self) -> DataFrame:
        """The same by packed keys, if there are such."""
        ready = [n for n in self.nodes if n.wanted and n.mask in self._sources]
        rest = [n for n in self.nodes if n.wanted and n.mask not in self._sources]
        out = self._summed(rest) if rest else None
        for n in ready:
            source = self._sources[n.mask]
            if self.packing is not None:
                part = source.select(F.lit(n.mask).cast("long").alias("mask"), "key", VALUE)
                out = part if out is None else out.union(part)
                continue
            part = source.select(*[F.col(c) if c in source.columns else F.lit(None).cast("int").alias(c) for c in self.schema.columns], VALUE, F.lit(n.mask).cast("long").alias("mask"))
            out = part if out is None else out.union(part)
        return out

    def entropies(self) -> DataFrame:
        """(mask, entropy in bits, n, states) of each margin asked for."""
        return entropies_of(self._asked())

    def release(self) -> None:
        drop(*self.written)
