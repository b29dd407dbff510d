"""Models: sets of relations, each a bit mask over the schema's variables.

A model never holds a relation twice or inside another one.  Names list the
relations' abbreviations, joined by colons, in schema order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

from .errors import ModelError, ValidationError
from .schema import Schema


def bits(mask: int) -> list[int]:
    """Places of the set bits, ascending."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def size(mask: int) -> int:
    return mask.bit_count()


def is_subset(a: int, b: int) -> bool:
    return a & ~b == 0


def order_key(mask: int) -> tuple:
    """Relations are ordered by their first variables."""
    return tuple(bits(mask))


def simplify(relations) -> tuple[int, ...]:
    """Without empty, repeated and contained relations, in order."""
    own = {r for r in relations if r}
    return tuple(sorted((r for r in own if not any(r != q and is_subset(r, q) for q in own)), key=order_key))


@dataclass(frozen=True)
class Model:
    schema: Schema
    relations: tuple[int, ...]

    def __init__(self, schema: Schema, relations):
        object.__setattr__(self, "schema", schema)
        object.__setattr__(self, "relations", simplify(relations))
        if not self.relations:
            raise ModelError("a model needs at least one relation")

    def __hash__(self):
        return hash(self.relations)

    def __eq__(self, other):
        return isinstance(other, Model) and self.relations == other.relations

    def __lt__(self, other):
        return [order_key(r) for r in self.relations] < [order_key(r) for r in other.relations]

    @cached_property
    def name(self) -> str:
        return ":".join("".join(self.schema.names(r)) for r in self.relations)

    def __str__(self):
        return self.name

    @cached_property
    def cover(self) -> int:
        """All variables of the model."""
        out = 0
        for r in self.relations:
            out |= r
        return out

    @property
    def uncovered(self) -> int:
        return self.schema.full & ~self.cover

    def contains_relation(self, relation: int) -> bool:
        return any(is_subset(relation, r) for r in self.relations)

    def contains(self, other: "Model") -> bool:
        """Whether the other model lies at or below this one in the lattice."""
        return all(self.contains_relation(r) for r in other.relations)

    @property
    def contains_dependent(self) -> bool:
        return bool(self.cover & self.schema.dependent)

    @property
    def is_independence(self) -> bool:
        return all(size(r) == 1 for r in self.relations)

    @property
    def is_saturated(self) -> bool:
        return self.relations == (self.schema.full,)

    @property
    def is_disjoint(self) -> bool:
        return sum(map(size, self.relations)) == size(self.cover)

    @property
    def level(self) -> int:
        """Sum of the relations' sizes less one each."""
        return sum(size(r) - 1 for r in self.relations)

    @cached_property
    def has_loops(self) -> bool:
        from .graph import is_acyclic

        return not is_acyclic(self.relations)

    @property
    def is_decomposable(self) -> bool:
        return not self.has_loops

    def completed(self) -> "Model":
        """With a relation of its own for every variable that it misses."""
        return Model(self.schema, [*self.relations, *(1 << k for k in bits(self.uncovered))])


def independence(schema: Schema, mask: int | None = None) -> Model:
    return Model(schema, [1 << k for k in bits(schema.full if mask is None else mask)])


def saturated(schema: Schema) -> Model:
    return Model(schema, [schema.full])


def top(schema: Schema) -> Model:
    return saturated(schema)


def bottom(schema: Schema) -> Model:
    """Neutral: every variable alone.  Directed: the independent variables together, the dependent ones together."""
    if schema.is_directed:
        return Model(schema, [schema.independent, schema.dependent])
    return independence(schema)


def parse_relation(schema: Schema, text: str, strict: bool = True) -> int:
    """Mask of a run of abbreviations; at each place the longest one that exists is read."""
    mask, at = 0, 0
    longest = max(len(v.abbrev) for v in schema)
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            k = schema.find(text[at: at + n])
            if k >= 0 and (n == 1 or text[at + 1: at + n] == text[at + 1: at + n].lower()):
                mask |= 1 << k
                at += n
                break
        else:
            if strict:
                raise ModelError(f"{text[at:]!r} in {text!r} is no variable")
            at += 1
    return mask


def parse_model(schema: Schema, text: str, strict: bool = True) -> Model:
    """A model from its name.  ``IV`` and ``DV`` name all independent and dependent variables of a
    directed system; a lower relation that a higher one contains may be listed (long notation)."""
    relations = []
    for part in text.replace(" ", "").split(":"):
        if part in ("IV", "IVs") and schema.is_directed:
            relations.append(schema.independent)
        elif part in ("DV", "DVs") and schema.is_directed:
            relations.append(schema.dependent)
        elif part:
            relations.append(parse_relation(schema, part, strict))
    if not any(relations):
        raise ModelError(f"{text!r} names no relation")
    return Model(schema, relations)


def reference_model(schema: Schema, text: str | None) -> Model:
    """The start of a search: by name (``top``, ``bottom`` or a model), by default the bottom."""
    text = (text or "").strip()
    if not text or text.lower() in ("bottom", "default", "independence"):
        return bottom(schema)
    if text.lower() in ("top", "saturated"):
        return top(schema)
    return parse_model(schema, text, strict=True)


def is_valid_reference(schema: Schema, text: str | None) -> tuple[bool, str]:
    """Whether the text names a model, and why not."""
    try:
        reference_model(schema, text)
    except (ModelError, ValidationError) as e:
        return False, str(e)
    return True, ""


# Degrees of freedom ---------------------------------------------------------

def relation_df(schema: Schema, mask: int) -> int:
    return schema.cells(mask) - 1


def model_df(model: Model, pairwise: bool = False) -> int:
    """Free parameters of a model.

    Exact: the product of (cardinality - 1) over every non-empty subset of a relation.  ``pairwise``:
    the sum over relations less that over pairwise overlaps, which differs for models with
    overlaps of overlaps.
    """
    s = model.schema
    if pairwise:
        return sum(relation_df(s, r) for r in model.relations) - sum(relation_df(s, a & b) for a, b in combinations(model.relations, 2))
    if not model.has_loops:
        from .graph import junction_forest

        tree = junction_forest(model.relations)
        return sum(relation_df(s, r) for r in tree.cliques) - sum(relation_df(s, e) for e in tree.separators if e)
    seen: set[int] = set()
    for r in model.relations:
        part = r
        while part:
            seen.add(part)
            part = (part - 1) & r
    out = 0
    for part in seen:
        own = 1
        for k in bits(part):
            own *= s[k].cardinality - 1
        out += own
    return out


def delta_df(a: Model, b: Model, pairwise: bool = False) -> int:
    return model_df(a, pairwise) - model_df(b, pairwise)


def ddf(model: Model, pairwise: bool = False) -> int:
    """Degrees of freedom that the saturated model has beyond this one."""
    return relation_df(model.schema, model.schema.full) - model_df(model, pairwise)
