"""Formulas to DataFrames: one DataFrame per distinct subformula, one or two operators per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import temporal as tmp
from .context import Context
from .normalize import binds, conjuncts, normalize, order
from .parser import parse
from .syntax import And, Eq, Eventually, Exists, Formula, Json, Next, Not, Once, Or, PolicyError, Pred, Previous, Since, Truth, Until, free, show


class Compiler:
    def __init__(self, ctx: Context):
        self.ctx, self.done = ctx, {}

    def rows(self, f: Formula) -> DataFrame:
        """(tp, free variables): all satisfying assignments."""
        if f not in self.done:
            self.done[f] = self._rows(f)
        return self.done[f]

    def _rows(self, f: Formula) -> DataFrame:
        ctx = self.ctx
        if isinstance(f, Truth):
            return rel.truth(ctx, f.value)
        if isinstance(f, Pred):
            return rel.atom_scan(ctx, f)
        if isinstance(f, Json):
            if ctx.documents is None:
                raise PolicyError("there are no documents to query")
            return rel.json_scan(ctx, f)
        if isinstance(f, Eq):
            return rel.constant(ctx, f)
        if isinstance(f, Not):
            return self.check(ctx.times.select("tp"), f)
        if isinstance(f, And):
            return self.conjunction(None, conjuncts(f))
        if isinstance(f, Or):
            return rel.union(self.rows(f.left), self.rows(f.right))
        if isinstance(f, Exists):
            return rel.project_away(self.rows(f.body), f.names)
        if isinstance(f, (Previous, Next, Once, Eventually)):
            run = {Previous: tmp.previous, Next: tmp.following, Once: tmp.once, Eventually: tmp.eventually}[type(f)]
            return run(ctx, self.rows(f.body), f.interval)
        assert isinstance(f, (Since, Until))
        if isinstance(f.left, Not):
            run, left = (tmp.neg_since if isinstance(f, Since) else tmp.neg_until), f.left.body
        else:
            run, left = (tmp.since if isinstance(f, Since) else tmp.until), f.left
        return run(ctx, self.rows(left), self.rows(f.right), f.interval)

    def conjunction(self, given: DataFrame | None, items: list[Formula]) -> DataFrame:
        """Joins, extends and checks in a safe order, starting from given rows or from the time-points' truth."""
        bound = tuple(c for c in given.columns if c != "tp") if given is not None else ()
        steps = order(items, bound)
        if steps is None:
            raise PolicyError("not monitorable: " + " AND ".join(map(show, items)))
        df = given
        for how, f in steps:
            if df is None:
                df = self.rows(f)
            elif how == "join":
                df = rel.semi_join(df, self.rows(f)) if set(free(f)) <= set(df.columns) else rel.join(df, self.rows(f))
            elif how == "extend":
                df = rel.extend(df, f)
            else:
                df = self.check(df, f)
        return df

    def check(self, df: DataFrame, f: Formula) -> DataFrame:
        """The rows of df, which binds all free variables of f, that satisfy f."""
        if isinstance(f, Eq):
            return rel.equal(df, f)
        if isinstance(f, Truth):
            return df if f.value else df.where(F.lit(False))
        if isinstance(f, Not):
            if isinstance(f.body, Eq):
                return rel.unequal(df, f.body)
            if isinstance(f.body, Not):
                return self.check(df, f.body.body)
            if binds(f.body):
                return rel.anti_join(df, self.rows(f.body))
            asked = self._asked(df, f.body)
            return rel.anti_join(df, self.check(asked, f.body))
        if binds(f):
            return rel.semi_join(df, self.rows(f))
        if isinstance(f, And):
            return self.check(self.check(df, f.left), f.right)
        if isinstance(f, Or):
            asked = self._asked(df, f)
            return rel.semi_join(df, rel.union(self.check(asked, f.left), self.check(asked, f.right)))
        asked = self._asked(df, f)
        if isinstance(f, Exists):
            inner = asked.select(*[f"`{c}`" for c in asked.columns])
            return rel.semi_join(df, rel.project_away(self.conjunction(inner, conjuncts(f.body)), f.names))
        names = [f"`{c}`" for c in asked.columns if c != "tp"]
        if isinstance(f, (Previous, Next)):
            back = isinstance(f, Previous)
            shift, unshift = (tmp.following, tmp.previous) if back else (tmp.previous, tmp.following)
            there = shift(self.ctx, asked, type(f.interval)())
            return rel.semi_join(df, unshift(self.ctx, self.check(there, f.body), f.interval))
        assert isinstance(f, (Once, Eventually))
        # Each asked row with the time-points of its window; those that satisfy the body there lead back.
        pairs = asked.join(tmp.windows(self.ctx, f.interval, isinstance(f, Once)), "tp").select(F.col("tp").alias("__tp"), F.col("other").alias("tp"), *names)
        there = pairs.select("tp", *names).distinct()
        good = self.check(there, f.body)
        back_ = rel.semi_join(pairs, good).select(F.col("__tp").alias("tp"), *names).distinct()
        return rel.semi_join(df, back_)

    def _asked(self, df: DataFrame, f: Formula) -> DataFrame:
        return df.select("tp", *[f"`{v}`" for v in free(f)]).distinct()


def monitor(policy: str | Formula, ctx: Context) -> DataFrame:
    """(tp, variables in the order of the policy): the assignments that satisfy the policy at each time-point, as a set."""
    f = parse(policy) if isinstance(policy, str) else policy
    names = free(f)
    out = Compiler(ctx).rows(normalize(f))
    missing = [v for v in names if v not in out.columns]
    if missing:
        raise PolicyError(f"no values for {', '.join(missing)} in {show(f)}")
    return out.select("tp", *[f"`{v}`" for v in names])
