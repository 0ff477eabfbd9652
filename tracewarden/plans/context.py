"""What a policy is evaluated over: facts by predicate, documents, and the time-points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import PolicyError

#: The time line is cut into about so many stretches, so that no window runs over all of it.
STRETCHES = 4096


class Context:
    """facts: name -> DataFrame(tp, c0, c1, ...); times: DataFrame(tp, ts), tp from 0 without gaps and ts not falling with tp; documents: DataFrame(tp, document).

    Use the constructors in tracewarden.sources to get dense time-points from timestamps. Unless strict, a predicate without facts is empty.
    """

    def __init__(self, facts: dict[str, DataFrame], times: DataFrame, documents: DataFrame | None = None, strict: bool = True):
        self.facts, self.documents, self.strict = facts, documents, strict
        self.times = times.select(F.col("tp").cast("long").alias("tp"), F.col("ts").cast("long").alias("ts"))
        self._bounds: tuple[int, int, int] | None = None
        self._ranges: dict = {}

    @property
    def spark(self):
        return self.times.sparkSession

    def bounds(self) -> tuple[int, int, int]:
        """The last time-point (-1 if there is none), the first and the last timestamp."""
        if self._bounds is None:
            row = self.times.agg(F.max("tp"), F.min("ts"), F.max("ts"), F.count("*")).first()
            if row[3] and row[0] + 1 != row[3]:
                raise PolicyError("time-points must be numbered from 0 without gaps")
            self._bounds = (-1, 0, 0) if row[0] is None else (row[0], row[1], row[2])
        return self._bounds

    def predicate(self, name: str, arity: int) -> DataFrame:
        df = self.facts.get(f"{name}/{arity}", self.facts.get(name))
        if df is not None and len(df.columns) == arity + 1:
            return df
        if df is not None and self.strict:
            raise PolicyError(f"{name} has {len(df.columns) - 1} arguments, not {arity}")
        if self.strict:
            raise PolicyError(f"no predicate {name}; there are {', '.join(sorted(self.facts))}")
        fields = [T.StructField("tp", T.LongType()), *[T.StructField(f"c{k}", T.StringType()) for k in range(arity)]]
        return self.spark.createDataFrame([], T.StructType(fields))

    def ranges(self, from_offset: int | None, to_offset: int | None) -> DataFrame:
        """(tp, lo, hi): the time-points whose timestamp lies within ts + from_offset .. ts + to_offset; None is no bound. Rows with lo > hi are empty ranges.

        Both ends are found by one window per stretch of the time line, over time-points and sought timestamps together.
        """
        key = (from_offset, to_offset)
        if key not in self._ranges:
            last = self.bounds()[0]
            out = self.times.select("tp")
            for name, offset, first in (("lo", from_offset, True), ("hi", to_offset, False)):
                if offset is None:
                    out = out.withColumn(name, F.lit(0 if first else last).cast("long"))
                else:
                    out = out.join(self._located(offset, first).withColumnRenamed("found", name), "tp")
            self._ranges[key] = out.select("tp", "lo", "hi")
        return self._ranges[key]

    def _located(self, offset: int, first: bool) -> DataFrame:
        """(tp, found): the first time-point with a timestamp >= ts + offset (or the last with one <=); last + 1 (or -1) if there is none."""
        from pyspark.sql import Window

        last, low, high = self.bounds()
        width = max(1, (high - low) // STRETCHES)
        points = self.times.select(F.col("ts").alias("x"), F.lit(None).cast("long").alias("tp"), F.col("tp").alias("at"))
        sought = self.times.select((F.col("ts") + offset).alias("x"), "tp", F.lit(None).cast("long").alias("at"))
        both = points.unionAll(sought).withColumn("stretch", F.floor((F.col("x") - low) / width))
        # The nearest time-point of the other stretches, for stretches where none is left.
        marks = points.groupBy(F.floor((F.col("x") - low) / width).alias("stretch")).agg((F.min if first else F.max)("at").alias("mark"))
        # range_between is on x, so equal timestamps see each other.
        own = Window.partitionBy("stretch").orderBy("x")
        if first:
            own = own.rangeBetween(Window.currentRow, Window.unboundedFollowing)
        else:
            own = own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        here = both.withColumn("here", (F.min if first else F.max)("at").over(own)).where("tp is not null").select("tp", "stretch", "here")
        wanted = here.where("here is null").select("stretch").distinct()
        line = marks.select("stretch", "mark").unionAll(wanted.select("stretch", F.lit(None).cast("long").alias("mark")))
        over = Window.orderBy("stretch")  # a few thousand stretches
        near = F.min("mark").over(over.rangeBetween(1, Window.unboundedFollowing)) if first else F.max("mark").over(over.rangeBetween(Window.unboundedPreceding, -1))
        other = line.select("stretch", near.alias("there")).groupBy("stretch").agg((F.min if first else F.max)("there").alias("there"))
        none = F.lit(last + 1 if first else -1).cast("long")
        return here.join(other, "stretch", "left").select("tp", F.coalesce("here", "there", none).alias("found"))
