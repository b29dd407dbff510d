"""Variables and schemas: which columns a table has, and how many states each."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field

from .errors import ValidationError

#: A probability at or below this counts as none.
PROB_MIN = 1e-36
#: Fitted cells at or below this are left out of printed tables.
PRINT_MIN = 1e-8


class TableKind(enum.Enum):
    INFORMATION_THEORETIC = "information"
    SET_THEORETIC = "set"


class Direction(enum.Enum):
    UP = "up"
    DOWN = "down"


class SearchFilter(enum.Enum):
    FULL = "full"
    LOOPLESS = "loopless"
    DISJOINT = "disjoint"
    CHAIN = "chain"


class Statistic(enum.Enum):
    DDF = "ddf"
    DF = "df"
    AIC = "aic"
    BIC = "bic"
    H = "h"
    LR = "lr"


@dataclass(frozen=True)
class Variable:
    """A nominal variable with codes 0 .. cardinality - 1; its column is named by the abbreviation."""

    name: str
    abbrev: str
    cardinality: int
    is_dependent: bool = False
    values: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.abbrev or not self.abbrev[0].isalpha() or not self.abbrev.isalnum():
            raise ValidationError(f"abbreviation {self.abbrev!r} must start with a letter and hold letters and digits only")
        if self.cardinality < 1:
            raise ValidationError(f"{self.name}: cardinality must be positive")
        object.__setattr__(self, "abbrev", self.abbrev[0].upper() + self.abbrev[1:].lower())

    def labels(self) -> tuple[str, ...]:
        return self.values or tuple(str(k) for k in range(self.cardinality))

    def label(self, code: int) -> str:
        own = self.labels()
        return own[code] if 0 <= code < len(own) else str(code)


@dataclass(frozen=True)
class Schema:
    """Ordered variables; a relation is a bit mask over their places."""

    variables: tuple[Variable, ...]
    _place: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "variables", tuple(self.variables))
        for k, v in enumerate(self.variables):
            if v.abbrev.lower() in self._place:
                raise ValidationError(f"abbreviation {v.abbrev} is used twice")
            self._place[v.abbrev.lower()] = k

    def __len__(self):
        return len(self.variables)

    def __iter__(self):
        return iter(self.variables)

    def __getitem__(self, k: int) -> Variable:
        return self.variables[k]

    def find(self, abbrev: str) -> int:
        """Place of a variable by its abbreviation, in any case; -1 if there is none."""
        return self._place.get(abbrev.lower(), -1)

    @property
    def columns(self) -> list[str]:
        return [v.abbrev for v in self.variables]

    @property
    def full(self) -> int:
        return (1 << len(self.variables)) - 1

    @property
    def dependent(self) -> int:
        """Mask of the dependent variables."""
        return sum(1 << k for k, v in enumerate(self.variables) if v.is_dependent)

    @property
    def independent(self) -> int:
        return self.full & ~self.dependent

    @property
    def is_directed(self) -> bool:
        return self.dependent != 0

    def cells(self, mask: int | None = None) -> int:
        """Number of states of the variables in the mask."""
        return math.prod(v.cardinality for k, v in enumerate(self.variables) if mask is None or mask >> k & 1)

    def names(self, mask: int) -> list[str]:
        return [v.abbrev for k, v in enumerate(self.variables) if mask >> k & 1]

    def select(self, abbrevs) -> "Schema":
        return Schema(tuple(self.variables[self.find(a)] for a in abbrevs))

    def require_valid(self) -> "Schema":
        if not self.variables:
            raise ValidationError("a data set needs at least one variable")
        if not self.independent and self.is_directed:
            raise ValidationError("a directed system needs an independent variable")
        return self


def spreadsheet_name(k: int) -> str:
    """A .. Z, Aa, Ab, ...: distinct abbreviations by place."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out[0] + out[1:].lower()


def unique_abbrevs(names) -> list[str]:
    """Short abbreviations: the first letter, lengthened until it is free."""
    out: list[str] = []
    for k, name in enumerate(names):
        letters = "".join(c for c in name if c.isascii() and c.isalnum())
        letters = letters if letters and letters[0].isalpha() else "V" + letters
        tries = [letters[0].upper() + letters[1:n].lower() for n in range(1, len(letters) + 1)]
        tries += [letters[0].upper() + str(n) for n in range(2, 10_000)]
        out.append(next(t for t in tries if t not in out))
    return out
