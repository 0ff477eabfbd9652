"""The temporal operators, as joins and windows over range-encoded tuples.

Rows are (tp, values...). A witness at time-point j satisfies the operator at the time-points of one contiguous range, since timestamps do not fall; ranges come from Context.ranges(), one row per
time-point. Ranges of equal tuples are merged before they are expanded, so no DISTINCT over the output is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.context import Context
from ..plans.syntax import Interval


def _names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "tp"]


def _q(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def expand(df: DataFrame, names: list[str]) -> DataFrame:
    """(values, lo, hi) to (tp, values): overlapping ranges of a tuple become one, then each is expanded."""
    df = df.where("lo <= hi")
    by = Window.partitionBy(*_q(names)) if names else Window.partitionBy(F.lit(0))
    before = F.max("hi").over(by.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    apart = df.withColumn("new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
    group = F.sum("new").over(by.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = apart.withColumn("run", group).groupBy(*_q(names), "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select(F.explode(F.sequence("lo", "hi")).alias("tp"), *_q(names))


def _past(ctx: Context, interval: Interval) -> DataFrame:
    """(tp, lo, hi): where a witness at tp counts for an operator that looks back."""
    ranges = ctx.ranges(interval.start, interval.end)
    return ranges.select("tp", F.greatest("lo", "tp").alias("lo"), "hi")


def _future(ctx: Context, interval: Interval) -> DataFrame:
    ranges = ctx.ranges(None if interval.end is None else -interval.end, -interval.start)
    return ranges.select("tp", "lo", F.least("hi", "tp").alias("hi"))


def once(ctx: Context, df: DataFrame, interval: Interval) -> DataFrame:
    names = _names(df)
    rows = df.join(_past(ctx, interval), "tp")
    if interval.end is None:  # the first witness has the longest range
        rows = rows.where("lo <= hi").groupBy(*_q(names)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rows = rows.where("lo is not null")
        return rows.select(F.explode(F.sequence("lo", "hi")).alias("tp"), *_q(names))
    return expand(rows.select(*_q(names), "lo", "hi"), names)


def eventually(ctx: Context, df: DataFrame, interval: Interval) -> DataFrame:
    names = _names(df)
    rows = df.join(_future(ctx, interval), "tp")
    if interval.end is None:
        rows = rows.where("lo <= hi").groupBy(*_q(names)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rows = rows.where("lo is not null")
        return rows.select(F.explode(F.sequence("lo", "hi")).alias("tp"), *_q(names))
    return expand(rows.select(*_q(names), "lo", "hi"), names)


def _shifted(ctx: Context, df: DataFrame, interval: Interval, by: int) -> DataFrame:
    """Rows at the neighbouring time-point, if that exists and the timestamps' distance lies in the interval."""
    last = ctx.bounds()[0]
    moved = (F.col("tp") + by).alias("tp")
    if interval.start == 0 and interval.end is None:
        return df.select(moved, *_q(_names(df))).where(F.col("tp").between(0, last))
    a = ctx.times
    b = ctx.times.select((F.col("tp") - by).alias("tp"), F.col("ts").alias("other"))
    gap = (F.col("other") - F.col("ts")) * by
    near = a.join(b, "tp").where((gap >= interval.start) & (F.lit(True) if interval.end is None else gap <= interval.end)).select("tp")
    return df.join(near, "tp").select(moved, *_q(_names(df)))


def previous(ctx: Context, df: DataFrame, interval: Interval) -> DataFrame:
    return _shifted(ctx, df, interval, 1)


def following(ctx: Context, df: DataFrame, interval: Interval) -> DataFrame:
    return _shifted(ctx, df, interval, -1)


def _keyed(left: DataFrame, right: DataFrame) -> list[str]:
    return [n for n in _names(right) if n in _names(left)]


def _over(names: list[str]):
    return Window.partitionBy(*_q(names)) if names else Window.partitionBy(F.lit(0))


def _runs(left: DataFrame, names: list[str], back: bool) -> DataFrame:
    """(tp, key, edge): for each row of left the last (or with back the first) time-point of its run of consecutive ones."""
    rows = left.select("tp", *_q(names)).distinct()
    island = (F.col("tp") - F.row_number().over(_over(names).orderBy("tp"))).alias("island")
    rows = rows.select("tp", *_q(names), island)
    edge = (F.min if back else F.max)("tp").over(Window.partitionBy(*_q(names), "island"))
    return rows.select("tp", *_q(names), edge.alias("edge"))


def _binary(ctx: Context, right: DataFrame, edges: DataFrame, keys: list[str], interval: Interval, back: bool) -> DataFrame:
    """edges: (tp, keys, edge) for time-points of witnesses; the outputs are those between a witness and its edge (itself without one) that the interval allows."""
    names = _names(right)
    rows = right.join(_past(ctx, interval) if back else _future(ctx, interval), "tp").where("lo <= hi").join(edges, ["tp", *keys], "left")
    edge = F.coalesce("edge", "tp")
    if back:
        rows = rows.select(*_q(names), "lo", F.least("hi", edge).alias("hi"))
    else:
        rows = rows.select(*_q(names), F.greatest("lo", edge).alias("lo"), "hi")
    return expand(rows, names)


def since(ctx: Context, left: DataFrame, right: DataFrame, interval: Interval) -> DataFrame:
    """left must hold at every time-point after the witness, up to the output."""
    keys = _keyed(left, right)
    edges = _runs(left, keys, back=False).withColumn("tp", F.col("tp") - 1)
    return _binary(ctx, right, edges, keys, interval, back=True)


def until(ctx: Context, left: DataFrame, right: DataFrame, interval: Interval) -> DataFrame:
    """left must hold at every time-point from the output up to the one before the witness."""
    keys = _keyed(left, right)
    edges = _runs(left, keys, back=True).withColumn("tp", F.col("tp") + 1)
    return _binary(ctx, right, edges, keys, interval, back=False)


def _stops(ctx: Context, left: DataFrame, right: DataFrame, keys: list[str], back: bool) -> DataFrame:
    """(tp, keys, edge) for the time-points of witnesses: the last output before the next row of left (or with back False, the first after the one before)."""
    last = ctx.bounds()[0]
    own = left.select("tp", *_q(keys)).distinct().withColumn("at", F.col("tp")).withColumn("asks", F.lit(False))
    asks = right.select("tp", *_q(keys)).distinct().withColumn("at", F.lit(None).cast("long")).withColumn("asks", F.lit(True))
    both = own.unionByName(asks)
    by = _over(keys).orderBy("tp")
    if back:
        edge = F.coalesce(F.min("at").over(by.rangeBetween(1, Window.unboundedFollowing)) - 1, F.lit(last).cast("long"))
    else:
        edge = F.coalesce(F.max("at").over(by.rangeBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0).cast("long"))
    return both.withColumn("edge", edge).where("asks").select("tp", *_q(keys), "edge")


def neg_since(ctx: Context, left: DataFrame, right: DataFrame, interval: Interval) -> DataFrame:
    """left must hold at no time-point after the witness, up to the output."""
    keys = _keyed(left, right)
    return _binary(ctx, right, _stops(ctx, left, right, keys, back=True), keys, interval, back=True)


def neg_until(ctx: Context, left: DataFrame, right: DataFrame, interval: Interval) -> DataFrame:
    keys = _keyed(left, right)
    return _binary(ctx, right, _stops(ctx, left, right, keys, back=False), keys, interval, back=False)


def windows(ctx: Context, interval: Interval, back: bool) -> DataFrame:
    """(tp, other): for each time-point those that its operator looks at."""
    if back:
        ranges = ctx.ranges(None if interval.end is None else -interval.end, -interval.start).select("tp", "lo", F.least("hi", "tp").alias("hi"))
    else:
        ranges = ctx.ranges(interval.start, interval.end).select("tp", F.greatest("lo", "tp").alias("lo"), "hi")
    return ranges.where("lo <= hi").select("tp", F.explode(F.sequence("lo", "hi")).alias("other"))
