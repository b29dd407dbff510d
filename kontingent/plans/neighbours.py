"""Neighbour rules of the model lattice (driver side; models are small).

Each rule yields distinct models in a fixed order.  Directed rules work on
predictive relations, those that hold a dependent variable.
"""

from __future__ import annotations

from itertools import combinations, permutations

from ..algebra import Model, bits, independence, size
from ..errors import SearchError


def _distinct(models, keep=lambda m: True) -> list[Model]:
    return [m for m in dict.fromkeys(models) if keep(m)]


def _swap(m: Model, old: dict[int, list[int]]) -> Model:
    """The model with some relations replaced."""
    return Model(m.schema, [x for r in m.relations for x in old.get(r, [r])])


def _merge_pairs(m: Model):
    """For each pair of variables that no relation holds together: the last relations holding one each, merged."""
    for i, j in combinations(range(len(m.schema)), 2):
        a, b = 1 << i, 1 << j
        if any(r & a and r & b for r in m.relations):
            continue
        left, right = [r for r in m.relations if r & a], [r for r in m.relations if r & b]
        if left and right:
            yield _swap(m, {left[-1]: [left[-1] | right[-1]], right[-1]: []})


def _add_iv(m: Model):
    """One independent variable moved from the independent-only relation into a predictive relation."""
    s = m.schema
    iv_only = next((r for r in m.relations if not r & s.dependent), 0)
    for k in bits(s.independent):
        for r in m.relations:
            if r & s.dependent and not r >> k & 1:
                yield _swap(m, {r: [r | 1 << k], iv_only: [iv_only & ~(1 << k)]})


def _remove_iv(m: Model, keep_single: bool = False):
    s = m.schema
    for r in m.relations:
        if r & s.dependent and r & s.independent:
            for k in bits(r & s.independent):
                yield _swap(m, {r: [r & ~(1 << k), *([1 << k] if keep_single else [])]})


def loopless_up(m: Model) -> list[Model]:
    moves = _add_iv(m) if m.schema.is_directed else _merge_pairs(m)
    return _distinct(moves, lambda x: not x.has_loops)


def loopless_down(m: Model) -> list[Model]:
    if m.schema.is_directed:
        return _distinct(_remove_iv(m), lambda x: not x.has_loops)

    def split():
        for i, j in combinations(range(len(m.schema)), 2):
            holding = [r for r in m.relations if r >> i & 1 and r >> j & 1]
            if len(holding) == 1 and size(holding[0]) > 2:
                r = holding[0]
                yield _swap(m, {r: [r & ~(1 << i), r & ~(1 << j)]})

    return _distinct(split(), lambda x: not x.has_loops)


def full_up(m: Model) -> list[Model]:
    if m.schema.is_directed:
        return _distinct(_add_iv(m))

    def grow():
        yield from _merge_pairs(m)
        for i, j in combinations(range(len(m.schema)), 2):
            pair = 1 << i | 1 << j
            if not m.contains_relation(pair):
                yield Model(m.schema, [*m.relations, pair])

    return _distinct(grow())


def full_down(m: Model) -> list[Model]:
    if m.schema.is_directed:
        return _distinct(_remove_iv(m))

    def split():
        for i, j in combinations(range(len(m.schema)), 2):
            for r in m.relations:
                if r >> i & 1 and r >> j & 1 and size(r) > 2:
                    yield _swap(m, {r: [r & ~(1 << i), r & ~(1 << j)]})

    return _distinct(split())


def disjoint_up(m: Model) -> list[Model]:
    if m.schema.is_directed:
        s = m.schema
        dv = next((r for r in m.relations if r & s.dependent), 0)
        iv_only = next((r for r in m.relations if not r & s.dependent), 0)

        def move():
            for k in bits(s.independent & ~dv):
                drop = {r: [] for r in m.relations if r == 1 << k}
                yield _swap(m, drop | {dv: [dv | 1 << k], iv_only: [iv_only & ~(1 << k)]})

        return _distinct(move(), lambda x: x.is_disjoint) if dv else []
    return _distinct((_swap(m, {a: [a | b], b: []}) for a, b in combinations(m.relations, 2)), lambda x: x.is_disjoint)


def disjoint_down(m: Model) -> list[Model]:
    if m.schema.is_directed:
        return _distinct(_remove_iv(m, keep_single=True), lambda x: x.is_disjoint)
    return _distinct((_swap(m, {r: [1 << k, r & ~(1 << k)]}) for r in m.relations if size(r) > 1 for k in bits(r)), lambda x: x.is_disjoint)


def pair_up(m: Model) -> list[Model]:
    """For each pair not held together: the pair and every relation that touches it become one."""

    def merge():
        for i, j in combinations(range(len(m.schema)), 2):
            pair = 1 << i | 1 << j
            if not m.contains_relation(pair):
                touched = [r for r in m.relations if r & pair]
                whole = pair
                for r in touched:
                    whole |= r
                yield Model(m.schema, [whole, *(r for r in m.relations if r not in touched)])

    return _distinct(merge())


def drop_down(m: Model) -> list[Model]:
    """A variable leaves a relation of two or more and stands alone where nothing else holds it."""
    return _distinct(Model(m.schema, [*(x for x in m.relations if x != r), r & ~(1 << k), 1 << k]) for r in m.relations if size(r) > 1 for k in bits(r))


RULES = {
    ("loopless", "up"): loopless_up, ("loopless", "down"): loopless_down,
    ("full", "up"): full_up, ("full", "down"): full_down,
    ("disjoint", "up"): disjoint_up, ("disjoint", "down"): disjoint_down,
    ("pairs", "up"): pair_up, ("pairs", "down"): drop_down,
}


def rule(name, direction):
    """A neighbour rule by name and direction; a callable is taken as it is."""
    if callable(name):
        return name
    key = (getattr(name, "value", name), getattr(direction, "value", direction))
    if key not in RULES:
        raise SearchError(f"no neighbour rule {key}")
    return RULES[key]


def parents(m: Model) -> list[Model]:
    """One step up the lattice: two variables that no relation holds together are joined, and their relations merged."""
    return _distinct(_merge_pairs(m))


def children(m: Model) -> list[Model]:
    """One step down the lattice: a relation loses each of two of its variables in turn, both rests stay."""

    def split():
        for r in m.relations:
            for i, j in combinations(bits(r), 2):
                yield _swap(m, {r: [r & ~(1 << i), r & ~(1 << j)]})

    return _distinct(split())


# Whole families -----------------------------------------------------------------

def all_chains(schema, mask: int | None = None, most: int = 9) -> list[Model]:
    """Every path model over the variables: half of their permutations."""
    places = bits(schema.full if mask is None else mask)
    if len(places) > most:
        raise SearchError(f"{len(places)} variables make too many chains")
    if len(places) < 2:
        return []
    return [Model(schema, [1 << a | 1 << b for a, b in zip(p, p[1:])]) for p in permutations(places) if p[0] < p[-1]]


def chain_order(m: Model) -> list[int] | None:
    """The variables in path order if the model is a chain of pairs (two or more), else None."""
    near: dict[int, list[int]] = {}
    for r in m.relations:
        if size(r) != 2:
            return None
        a, b = bits(r)
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    ends = sorted(k for k, v in near.items() if len(v) == 1)
    if len(m.relations) < 2 or len(ends) != 2 or any(len(v) > 2 for v in near.values()):
        return None
    out, before = [ends[0]], None
    while len(out) <= len(m.relations):
        step = [k for k in near[out[-1]] if k != before]
        if not step:
            return None
        before = out[-1]
        out.append(step[0])
    return out if len(set(out)) == len(near) else None


def is_chain(m: Model, allow_single: bool = False) -> bool:
    """Whether the model is a chain; with ``allow_single`` also a lone relation."""
    return chain_order(m) is not None or allow_single and len(m.relations) <= 1


def lattice(schema, loopless_only: bool = False, most: int = 10_000, start: Model | None = None) -> list[tuple[Model, bool, int]]:
    """(model, has loops, level) of all models that merging pairs reaches from independence, breadth first."""
    if schema.is_directed and start is None:
        return directed_lattice(schema, loopless_only, most)
    start = start or independence(schema)
    return _breadth_first(start, lambda m: _distinct(_merge_pairs(m)), loopless_only, most)


def directed_lattice(schema, loopless_only: bool = False, most: int = 10_000) -> list[tuple[Model, bool, int]]:
    """All models that moving independent variables into the predictive relation reaches."""
    start = Model(schema, [schema.independent, schema.dependent])
    return _breadth_first(start, lambda m: _distinct(_add_iv(m)), loopless_only, most)


def _breadth_first(start, step, loopless_only, most):
    level, seen, out = {start: 0}, [start], [(start, start.has_loops, 0)]
    for m in seen:
        if len(out) >= most:
            break
        for x in step(m):
            if x not in level and not (loopless_only and x.has_loops) and len(out) < most:
                level[x] = level[m] + 1
                seen.append(x)
                out.append((x, x.has_loops, level[x]))
    return sorted(out, key=lambda e: (e[2], -len(e[0].relations), e[0].name))


def are_neighbours(a: Model, b: Model) -> bool:
    """Whether one model covers the other, one level apart."""
    return abs(a.level - b.level) == 1 and (a.contains(b) or b.contains(a))
