"""Graph tests on small sets of variables (driver side): chordality, cliques, junction forests.

Graphs are dictionaries node -> set of neighbours; relations are bit masks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from .algebra import bits, is_subset, size
from .errors import JunctionTreeError

Graph = dict[int, set[int]]


def primal_graph(relations) -> Graph:
    """Variables are joined where some relation holds both."""
    g: Graph = {}
    for r in relations:
        for k in bits(r):
            g.setdefault(k, set()).update(j for j in bits(r) if j != k)
    return g


def intersection_graph(relations) -> dict[tuple[int, int], int]:
    """Pairs of relations that overlap, with the overlap."""
    return {(i, j): a & b for (i, a), (j, b) in combinations(enumerate(relations), 2) if a & b}


def maximum_cardinality_search(g: Graph) -> list[int]:
    """Visits the node with most visited neighbours next; ties go to the least node."""
    weight, order = {v: 0 for v in g}, []
    while weight:
        v = max(weight, key=lambda x: (weight[x], -x))
        order.append(v)
        del weight[v]
        for u in g[v]:
            if u in weight:
                weight[u] += 1
    return order


def is_perfect_elimination(g: Graph, order: list[int]) -> bool:
    """Whether the later neighbours of each node form a clique."""
    place = {v: k for k, v in enumerate(order)}
    for v in order:
        later = [u for u in g[v] if place[u] > place[v]]
        if later:
            first = min(later, key=place.__getitem__)
            if not all(u == first or u in g[first] for u in later):
                return False
    return True


def perfect_elimination(g: Graph) -> list[int] | None:
    order = maximum_cardinality_search(g)[::-1]
    return order if is_perfect_elimination(g, order) else None


def is_chordal(g: Graph) -> bool:
    return perfect_elimination(g) is not None


def maximal_cliques(g: Graph) -> list[int]:
    """Masks of all maximal cliques (pivoting search)."""
    out: list[int] = []

    def grow(clique: int, open_: set[int], done: set[int]) -> None:
        if not open_ and not done:
            out.append(clique)
            return
        pivot = max(open_ | done, key=lambda v: len(g[v] & open_))
        for v in sorted(open_ - g[pivot]):
            grow(clique | 1 << v, open_ & g[v], done & g[v])
            open_ = open_ - {v}
            done = done | {v}

    if g:
        grow(0, set(g), set())
    return sorted(out, key=bits)


def has_redundancy(relations) -> bool:
    """Whether one relation lies inside another, or is listed twice."""
    return any(is_subset(a, b) or is_subset(b, a) for a, b in combinations(relations, 2))


def is_acyclic(relations) -> bool:
    """No redundancy, chordal, and every clique of the primal graph is a relation."""
    relations = list(relations)
    if len(relations) <= 1:
        return True
    if has_redundancy(relations):
        return False
    g = primal_graph(relations)
    return is_chordal(g) and all(any(is_subset(c, r) for r in relations) for c in maximal_cliques(g))


@dataclass(frozen=True)
class JunctionForest:
    """Cliques with a parent each (-1 for a root), and the overlap with the parent (0 for a root)."""

    cliques: tuple[int, ...]
    parent: tuple[int, ...]
    separators: tuple[int, ...]

    @property
    def roots(self) -> list[int]:
        return [k for k, p in enumerate(self.parent) if p < 0]

    def children(self, k: int) -> list[int]:
        return [j for j, p in enumerate(self.parent) if p == k]

    def is_leaf(self, k: int) -> bool:
        return not self.children(k)

    def leaves(self) -> list[int]:
        return [k for k in range(len(self.cliques)) if self.is_leaf(k)]

    def separator(self, a: int, b: int) -> int:
        if self.parent[a] == b:
            return self.separators[a]
        if self.parent[b] == a:
            return self.separators[b]
        raise JunctionTreeError("the cliques are not neighbours")

    def pre_order(self) -> list[int]:
        out, stack = [], self.roots[::-1]
        while stack:
            k = stack.pop()
            out.append(k)
            stack += self.children(k)[::-1]
        return out

    def post_order(self) -> list[int]:
        return self.pre_order()[::-1]

    @property
    def is_tree(self) -> bool:
        return len(self.roots) == 1


def junction_forest(relations) -> JunctionForest:
    """Spanning forest of greatest overlaps; an error where the relations have a loop.

    Models that fall apart give one tree per part.
    """
    cliques = tuple(relations)
    if not is_acyclic(cliques):
        raise JunctionTreeError("the model has a loop")
    edges = sorted(intersection_graph(cliques).items(), key=lambda e: (-size(e[1]), e[0]))
    part = list(range(len(cliques)))
    near: dict[int, list[int]] = {k: [] for k in part}
    for (i, j), _ in edges:
        if part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
            near[i].append(j)
            near[j].append(i)
    parent, separators = [-2] * len(cliques), [0] * len(cliques)
    for root in range(len(cliques)):
        if parent[root] == -2:
            parent[root] = -1
            stack = [root]
            while stack:
                k = stack.pop()
                for j in near[k]:
                    if parent[j] == -2:
                        parent[j], separators[j] = k, cliques[k] & cliques[j]
                        stack.append(j)
    return JunctionForest(cliques, tuple(parent), tuple(separators))


def running_intersection_order(relations) -> list[int] | None:
    """Relations in an order in which each meets the earlier ones inside one of them; None if there is none."""
    try:
        forest = junction_forest(relations)
    except JunctionTreeError:
        return None
    return [forest.cliques[k] for k in forest.pre_order()]


# Triangulation ------------------------------------------------------------------------

def elimination_order(scopes, cells, keep: int = 0) -> list[int]:
    """Variables of the scopes (masks) that are not kept, in the order in which to sum them out.

    The next one is that which makes the smallest table (``cells`` of a mask), then the fewest new neighbours, then the
    first by place.
    """
    g = primal_graph(scopes)
    order, left = [], set(g) - set(bits(keep))
    while left:
        def cost(v: int):
            near = g[v]
            fill = sum(1 for a, b in combinations(sorted(near), 2) if b not in g[a])
            return cells(1 << v | sum(1 << u for u in near)), fill, v

        order.append(_eliminate(g, min(left, key=cost)))
        left.discard(order[-1])
    return order


def _eliminate(g: Graph, v: int) -> int:
    """Takes v out of the graph; its neighbours become neighbours of each other."""
    near = g.pop(v)
    for u in near:
        g[u].discard(v)
        g[u] |= near - {u}
    return v


def triangulated(relations, cells) -> tuple[int, ...]:
    """Maximal cliques of a chordal graph that holds all relations: fewest new edges first (min-fill), then smallest tables."""
    g, cliques = primal_graph(relations), []
    while g:
        def cost(v: int):
            near = g[v]
            fill = sum(1 for a, b in combinations(sorted(near), 2) if b not in g[a])
            return fill, cells(1 << v | sum(1 << u for u in near)), v

        v = min(g, key=cost)
        cliques.append(1 << v | sum(1 << u for u in g[v]))
        _eliminate(g, v)
    kept = [c for k, c in enumerate(cliques) if not any(is_subset(c, d) and (c != d or j < k) for j, d in enumerate(cliques) if j != k)]
    return tuple(sorted(kept, key=bits))


def clique_tree(relations, cells) -> JunctionForest:
    """Junction forest of the triangulated relations; any relations will do."""
    return junction_forest(triangulated(relations, cells))


def blocks(forest: JunctionForest, relations) -> list[list[int]]:
    """Cliques by block: neighbours are in one block unless some relation holds their separator.

    A separator inside a relation cuts a hierarchical model into parts that can be fitted each by itself.
    """
    of = list(range(len(forest.cliques)))
    for k, (p, s) in enumerate(zip(forest.parent, forest.separators)):
        if p >= 0 and s and not any(is_subset(s, r) for r in relations):
            old, new = of[k], of[p]
            of = [new if x == old else x for x in of]
    return [[k for k in range(len(of)) if of[k] == b] for b in dict.fromkeys(of)]
