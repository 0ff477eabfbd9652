"""Where verdicts go: Parquet, text lines, the console, or nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_lines(verdicts: DataFrame, times: DataFrame) -> DataFrame:
    """(tp, value): a line `@ts (time point tp): (a,b) (c,d)` per time-point with verdicts; values of every type are printed.

    times: (tp, ts), and label if lines had time-points of their own. Verdicts of a time-point meet in one row, which the format asks for; write Parquet where they are many.
    """
    names = [c for c in verdicts.columns if c != "tp"]
    text = F.concat(F.lit("("), F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in names]), F.lit(")"))
    rows = verdicts.select("tp", text.alias("t")).groupBy("tp").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("t"))
    label = F.col("label") if "label" in times.columns else F.col("tp")
    return rows.join(times, "tp").select("tp", F.format_string("@%d (time point %d): %s", "ts", label, "t").alias("value"))


def write_parquet(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").parquet(path)


def write_text(verdicts: DataFrame, times: DataFrame, path: str) -> None:
    """Lines sorted by time-point."""
    verdict_lines(verdicts, times).orderBy("tp").select("value").write.mode("overwrite").text(path)


def print_lines(verdicts: DataFrame, times: DataFrame, batch: int | None = None) -> None:
    """Prints lines as they come from the executors, batch of them at a time."""
    held = []
    for row in verdict_lines(verdicts, times).select("value").toLocalIterator():
        held.append(row.value)
        if len(held) >= (batch or 1):
            print("\n".join(held))
            held = []
    if held:
        print("\n".join(held))


def discard(verdicts: DataFrame) -> None:
    verdicts.write.format("noop").mode("overwrite").save()
