"""Contexts from tables: timestamps become dense time-points, rows become facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.context import Context


def dense_times(timestamps: DataFrame, calendar: bool = False) -> DataFrame:
    """(tp, ts) from a column ts (whole numbers): the rank of each distinct timestamp. calendar: every number between the first and the last is a time-point.

    Ranks are counted in stretches of the sorted timestamps, with the sizes of earlier stretches added, so that no task sorts all of them.
    """
    from pyspark.sql import Window

    ts = timestamps.select(F.col("ts").cast("long").alias("ts")).where("ts is not null")
    if calendar:
        ends = ts.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null")
        return ends.select(F.explode(F.sequence("a", "b")).alias("ts"), "a").select((F.col("ts") - F.col("a")).alias("tp"), "ts")
    ts = ts.distinct()
    low, high = ts.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return ts.select(F.col("ts").alias("tp"), "ts")
    width = max(1, (high - low) // 4096)
    ts = ts.withColumn("stretch", F.floor((F.col("ts") - low) / width))
    sizes = ts.groupBy("stretch").agg(F.count("*").alias("n"))
    before = sizes.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("stretch").orderBy("ts")) - 1
    return ts.withColumn("rank", rank).join(before, "stretch").select((F.col("rank") + F.col("before")).cast("long").alias("tp"), "ts")


class Trace:
    """A table with a timestamp expression; predicates are filters and projections of it."""

    def __init__(self, df: DataFrame, ts: Column, calendar: bool = False, persist: bool = True):
        self.df = df.withColumn("__ts", ts.cast("long"))
        self.times = dense_times(self.df.select(F.col("__ts").alias("ts")), calendar)
        if persist:  # one row per time-point; every temporal operator reads it
            self.times = self.times.persist()
        self.facts: dict[str, DataFrame] = {}
        self.documents: DataFrame | None = None

    def predicate(self, name: str, *args: Column | str, where: Column | str | None = None) -> Trace:
        """Declares name(args...) as the rows that satisfy where; the filter and the columns reach the scan."""
        df = self.df if where is None else self.df.where(where)
        columns = [(F.col(a) if isinstance(a, str) else a).alias(f"c{k}") for k, a in enumerate(args)]
        at = self.times.select("tp", F.col("ts").alias("__ts"))
        self.facts[name] = df.select("__ts", *columns).join(at, "__ts").select("tp", *[f"c{k}" for k in range(len(args))])
        return self

    def with_documents(self, document: Column | str) -> Trace:
        doc = F.col(document) if isinstance(document, str) else document
        at = self.times.select("tp", F.col("ts").alias("__ts"))
        self.documents = self.df.select("__ts", doc.alias("document")).join(at, "__ts").select("tp", "document")
        return self

    def context(self) -> Context:
        return Context(self.facts, self.times, self.documents)


def days(column: str) -> Column:
    return F.unix_date(F.to_date(column))


def hours(column: str, start: str = "2024-01-01") -> Column:
    seconds = F.unix_seconds(F.col(column).cast("timestamp")) - F.unix_seconds(F.lit(start).cast("timestamp"))
    return F.floor(seconds / 3600)
