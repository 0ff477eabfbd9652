"""The first-order operators over tables (tp, values...). All results are sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_paths
from ..plans.context import Context
from ..plans.syntax import Const, Eq, Json, Pred, Term, Var


def atom_scan(ctx: Context, p: Pred) -> DataFrame:
    """Facts that match constants and repeated variables, with a column per distinct variable. The conditions are plain comparisons, so they reach a Parquet scan."""
    df = ctx.predicate(p.name, len(p.args))
    columns = [F.col(f"`{c}`") for c in df.columns if c != "tp"]
    where, first = [], {}
    for arg, c in zip(p.args, columns):
        if isinstance(arg, Const):
            where.append(c == F.lit(arg.value))
        elif arg.name in first:
            where.append(c == first[arg.name])
        else:
            first[arg.name] = c
    if where:
        df = df.where(reduce(Column.__and__, where))
    return df.select("tp", *[c.alias(v) for v, c in first.items()]).distinct()


def json_scan(ctx: Context, q: Json) -> DataFrame:
    """Documents that satisfy all conditions, projected to the outputs; documents without one of the paths to be output are passed over."""
    doc = F.col("document")
    df = ctx.documents
    for path, op, value in q.conditions:
        df = df.where(json_paths.condition(doc, path, op, value))
    df = df.select("tp", *json_paths.outputs(q, doc))
    return df.dropna(subset=[c for c in df.columns if c != "tp"]).distinct()


def truth(ctx: Context, value: bool) -> DataFrame:
    return ctx.times.select("tp") if value else ctx.times.select("tp").where(F.lit(False))


def constant(ctx: Context, eq: Eq) -> DataFrame:
    """x = c on its own: one row per time-point."""
    var, value = (eq.left, eq.right) if isinstance(eq.left, Var) else (eq.right, eq.left)
    return ctx.times.select("tp", F.lit(value.value).alias(var.name))


def _term(t: Term) -> Column:
    return F.col(f"`{t.name}`") if isinstance(t, Var) else F.lit(t.value)


def equal(df: DataFrame, eq: Eq) -> DataFrame:
    return df.where(_term(eq.left) == _term(eq.right))


def unequal(df: DataFrame, eq: Eq) -> DataFrame:
    return df.where(_term(eq.left) != _term(eq.right))


def extend(df: DataFrame, eq: Eq) -> DataFrame:
    """Binds the one side that is a new variable to the other."""
    left_new = isinstance(eq.left, Var) and eq.left.name not in df.columns
    new, old = (eq.left, eq.right) if left_new else (eq.right, eq.left)
    return df.withColumn(new.name, _term(old))


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join on the time-point and all shared variables; without shared variables the pairs of a time-point."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def semi_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left_semi")


def anti_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left without a row of right that agrees on the time-point and all shared variables."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left_anti")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right.select(*[f"`{c}`" for c in left.columns])).distinct()


def project_away(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    gone = [c for c in df.columns if c in names]
    return df.drop(*gone).distinct() if gone else df

