"""Policies as values: terms, intervals and formulas."""

from __future__ import annotations

from dataclasses import dataclass, fields


class PolicyError(ValueError):
    """A policy that cannot be parsed or evaluated."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | str


Term = Var | Const


@dataclass(frozen=True)
class Interval:
    """Closed; end is None for infinity."""

    start: int = 0
    end: int | None = None

    def __post_init__(self):
        if self.start < 0 or (self.end is not None and self.end < self.start):
            raise PolicyError(f"empty interval {self}")

    def __str__(self):
        return f"[{self.start},*)" if self.end is None else f"[{self.start},{self.end}]"

    @property
    def has_zero(self) -> bool:
        return self.start == 0


EVER = Interval()


class Formula:
    """Base of all formulas. Equal formulas are equal values, so plans can be shared."""

    def parts(self) -> tuple[Formula, ...]:
        return tuple(v for v in (getattr(self, f.name) for f in fields(self)) if isinstance(v, Formula))


@dataclass(frozen=True)
class Truth(Formula):
    value: bool


@dataclass(frozen=True)
class Pred(Formula):
    name: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class Eq(Formula):
    left: Term
    right: Term


@dataclass(frozen=True)
class Json(Formula):
    """A query over documents: outputs are (path, variable), conditions (path, operator, value)."""

    outputs: tuple[tuple[str, str], ...]
    conditions: tuple[tuple[str, str, object], ...]
    as_object: bool = False


@dataclass(frozen=True)
class Unsupported(Formula):
    """Syntax that parses but has no meaning as a policy (VALUE, <eos>)."""

    what: str


@dataclass(frozen=True)
class Not(Formula):
    body: Formula


@dataclass(frozen=True)
class And(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Or(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Implies(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Iff(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Exists(Formula):
    names: tuple[str, ...]
    body: Formula


@dataclass(frozen=True)
class Forall(Formula):
    names: tuple[str, ...]
    body: Formula


@dataclass(frozen=True)
class Previous(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class Next(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class Once(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class Eventually(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class PastAlways(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class Always(Formula):
    interval: Interval
    body: Formula


@dataclass(frozen=True)
class Since(Formula):
    interval: Interval
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Until(Formula):
    interval: Interval
    left: Formula
    right: Formula


def free(f: Formula) -> tuple[str, ...]:
    """Free variables in the order in which they first appear; those of SINCE and UNTIL in the order of the right side."""
    if isinstance(f, Pred):
        return tuple(dict.fromkeys(t.name for t in f.args if isinstance(t, Var)))
    if isinstance(f, Eq):
        return tuple(dict.fromkeys(t.name for t in (f.left, f.right) if isinstance(t, Var)))
    if isinstance(f, Json):
        return ("object",) if f.as_object else tuple(dict.fromkeys(name for _, name in f.outputs))
    if isinstance(f, (Exists, Forall)):
        return tuple(v for v in free(f.body) if v not in f.names)
    if isinstance(f, (Since, Until)):
        return tuple(dict.fromkeys(free(f.right) + free(f.left)))
    return tuple(dict.fromkeys(v for p in f.parts() for v in free(p)))


def show(f: Formula) -> str:
    """The policy text of a formula, fully parenthesised; parses back to the same formula."""
    term = lambda t: t.name if isinstance(t, Var) else str(t.value) if isinstance(t.value, int) else "'" + t.value + "'"
    if isinstance(f, Truth):
        return "TRUE" if f.value else "FALSE"
    if isinstance(f, Pred):
        return f"{f.name}({', '.join(map(term, f.args))})"
    if isinstance(f, Eq):
        return f"({term(f.left)} = {term(f.right)})"
    if isinstance(f, Json):
        quote = lambda v: f'"{v}"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        items = [p if f.as_object else f"{p} AS {n}" for p, n in f.outputs]
        return "<<" + " & ".join(items + [f"{p} {o} {quote(v)}" for p, o, v in f.conditions]) + ">>"
    if isinstance(f, Unsupported):
        return f.what
    if isinstance(f, Not):
        return f"(NOT {show(f.body)})"
    if isinstance(f, (And, Or, Implies, Iff)):
        word = {And: "AND", Or: "OR", Implies: "IMPLIES", Iff: "EQUIV"}[type(f)]
        return f"({show(f.left)} {word} {show(f.right)})"
    if isinstance(f, (Exists, Forall)):
        return f"({'EXISTS' if isinstance(f, Exists) else 'FORALL'} {', '.join(f.names)}. {show(f.body)})"
    if isinstance(f, (Since, Until)):
        return f"({show(f.left)} {type(f).__name__.upper()} {f.interval} {show(f.right)})"
    word = {Previous: "PREVIOUS", Next: "NEXT", Once: "ONCE", Eventually: "EVENTUALLY", PastAlways: "PAST_ALWAYS", Always: "ALWAYS"}[type(f)]
    return f"({word} {f.interval} {show(f.body)})"
