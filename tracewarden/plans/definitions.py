"""Policies as SQL that spells out the definitions: every temporal operator is an EXISTS or NOT EXISTS over time-points. For comparison; slow by design.

The SQL runs on DuckDB over views times(tp, ts) and, per predicate, p_<name>(tp, c0, ...), and documents_(tp, document).
"""

from __future__ import annotations

from itertools import count

from .normalize import conjuncts, desugar
from .parser import parse
from .syntax import And, Const, Eq, Eventually, Exists, Formula, Interval, Next, Not, Once, Or, Pred, Previous, Since, Term, Truth, Var, free


def _literal(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _term(t: Term, names: dict[str, str]) -> str:
    return names[t.name] if isinstance(t, Var) else _literal(t.value)


def _within(interval: Interval, distance: str) -> str:
    return f"{distance} >= {interval.start}" + ("" if interval.end is None else f" AND {distance} <= {interval.end}")


class Definitions:
    """holds(f, tp, names): a condition that f holds at the time-point tp with the variables' values given as SQL expressions."""

    def __init__(self):
        self.number = count()

    def fresh(self, letter: str) -> str:
        return f"{letter}{next(self.number)}"

    def holds(self, f: Formula, tp: str, names: dict[str, str]) -> str:
        if isinstance(f, Truth):
            return "TRUE" if f.value else "FALSE"
        if isinstance(f, Pred):
            a = self.fresh("f")
            where = "".join(f" AND {a}.c{k} = {_term(t, names)}" for k, t in enumerate(f.args))
            return f"EXISTS (SELECT 1 FROM p_{f.name} {a} WHERE {a}.tp = {tp}{where})"
        if isinstance(f, Eq):
            return f"{_term(f.left, names)} = {_term(f.right, names)}"
        if isinstance(f, Not):
            return f"NOT ({self.holds(f.body, tp, names)})"
        if isinstance(f, (And, Or)):
            return f"({self.holds(f.left, tp, names)}) {'AND' if isinstance(f, And) else 'OR'} ({self.holds(f.right, tp, names)})"
        if isinstance(f, Exists):
            d = self.fresh("d")
            inner = names | {v: f"{d}.{v}" for v in f.names}
            return f"EXISTS (SELECT 1 FROM ({self.domain(f.body)}) {d} WHERE {d}.tp = {tp} AND {self._agree(d, f.body, f.names, names)} AND {self.holds(f.body, tp, inner)})"
        t, u = self.fresh("t"), self.fresh("t")
        now = f"times {u} JOIN times {t} ON {u}.tp = {tp}"
        if isinstance(f, (Once, Eventually)):
            past = isinstance(f, Once)
            near = f"{t}.tp {'<=' if past else '>='} {tp} AND {_within(f.interval, f'({u}.ts - {t}.ts)' if past else f'({t}.ts - {u}.ts)')}"
            return f"EXISTS (SELECT 1 FROM {now} WHERE {near} AND {self.holds(f.body, f'{t}.tp', names)})"
        if isinstance(f, (Previous, Next)):
            past = isinstance(f, Previous)
            near = f"{t}.tp = {tp} {'-' if past else '+'} 1 AND {_within(f.interval, f'({u}.ts - {t}.ts)' if past else f'({t}.ts - {u}.ts)')}"
            return f"EXISTS (SELECT 1 FROM {now} WHERE {near} AND {self.holds(f.body, f'{t}.tp', names)})"
        past = isinstance(f, Since)
        k = self.fresh("t")
        near = f"{t}.tp {'<=' if past else '>='} {tp} AND {_within(f.interval, f'({u}.ts - {t}.ts)' if past else f'({t}.ts - {u}.ts)')}"
        between = f"{k}.tp > {t}.tp AND {k}.tp <= {tp}" if past else f"{k}.tp >= {tp} AND {k}.tp < {t}.tp"
        return f"EXISTS (SELECT 1 FROM {now} WHERE {near} AND {self.holds(f.right, f'{t}.tp', names)} AND NOT EXISTS (SELECT 1 FROM times {k} WHERE {between} AND NOT ({self.holds(f.left, f'{k}.tp', names)})))"

    def _agree(self, d: str, f: Formula, own: tuple[str, ...], names: dict[str, str]) -> str:
        return " AND ".join([f"{d}.{v} = {names[v]}" for v in free(f) if v not in own] or ["TRUE"])

    def domain(self, f: Formula) -> str:
        """(tp, free variables): a superset of the satisfying assignments, at all time-points where the formula might hold."""
        names = free(f)
        if isinstance(f, Pred):
            a, first = self.fresh("f"), {}
            for k, t in enumerate(f.args):
                if isinstance(t, Var):
                    first.setdefault(t.name, f"{a}.c{k}")
            return f"SELECT {', '.join([f'{a}.tp AS tp', *[f'{c} AS {v}' for v, c in first.items()]])} FROM p_{f.name} {a}"
        if isinstance(f, Truth):
            return "SELECT tp FROM times"
        if isinstance(f, Eq):
            var, other = (f.left, f.right) if isinstance(f.left, Var) else (f.right, f.left)
            return f"SELECT tp, {_literal(other.value)} AS {var.name} FROM times" if isinstance(other, Const) else ""
        if isinstance(f, And):
            parts = [(self.domain(p), free(p), p) for p in conjuncts(f) if not isinstance(p, Not)]
            eqs = [p for p in parts if isinstance(p[2], Eq)]
            parts = [p for p in parts if not isinstance(p[2], Eq)] or eqs
            have: dict[str, str] = {}
            sql = ""
            for text, vs, _ in parts:
                a = self.fresh("q")
                on = [f"{a}.tp = {have['tp']}"] if have else []
                on += [f"{a}.{v} = {have[v]}" for v in vs if v in have]
                sql += f" JOIN ({text}) {a} ON {' AND '.join(on)}" if have else f"({text}) {a}"
                have = {"tp": f"{a}.tp"} | {v: f"{a}.{v}" for v in vs} | have
            for _, vs, p in eqs:  # a variable that only an equality binds
                for v in vs:
                    if v not in have:
                        other = p.right if p.left == Var(v) else p.left
                        have[v] = _term(other, have)
            return f"SELECT {', '.join(f'{have[v]} AS {v}' for v in ('tp', *names))} FROM {sql}"
        if isinstance(f, Or):
            columns = ", ".join(("tp", *names))
            return f"SELECT {columns} FROM ({self.domain(f.left)}) {self.fresh('q')} UNION SELECT {columns} FROM ({self.domain(f.right)}) {self.fresh('q')}"
        if isinstance(f, Exists):
            return f"SELECT DISTINCT {', '.join(('tp', *names))} FROM ({self.domain(f.body)}) {self.fresh('q')}"
        if isinstance(f, Not):
            return "SELECT tp FROM times"
        body = f.right if hasattr(f, "right") else f.body
        q, t = self.fresh("q"), self.fresh("t")
        columns = ", ".join([f"{t}.tp AS tp", *[f"{q}.{v} AS {v}" for v in names]])
        return f"SELECT {columns} FROM times {t}, (SELECT DISTINCT {', '.join(names) or '1 AS one'} FROM ({self.domain(body)}) {self.fresh('q')}) {q}"


def views(predicates: dict[str, str], times: str, documents: str | None = None) -> str:
    """WITH clauses: predicates maps names to SELECTs of (ts, c0, ...); times is a SELECT of distinct ts."""
    parts = [f"times AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS tp, CAST(ts AS BIGINT) AS ts FROM ({times}))"]
    parts += [f"p_{name} AS MATERIALIZED (SELECT DISTINCT times.tp, q.* EXCLUDE (ts) FROM ({sql}) q JOIN times ON times.ts = q.ts)" for name, sql in predicates.items()]
    return "WITH " + ",\n".join(parts)


def definition(policy: str, predicates: dict[str, str], times: str) -> str:
    """SQL for (tp, variables) of a policy without JSON queries."""
    f = desugar(parse(policy))
    names = free(parse(policy))
    d = Definitions()
    condition = d.holds(f, "d.tp", {v: f"d.{v}" for v in names})
    used = {p for p in predicates if f"p_{p} " in condition}
    return f"{views({p: predicates[p] for p in predicates if p in used}, times)}\nSELECT {', '.join(['d.tp AS tp', *[f'd.{v} AS {v}' for v in names]])} FROM (SELECT DISTINCT * FROM ({d.domain(f)})) d WHERE {condition}"
