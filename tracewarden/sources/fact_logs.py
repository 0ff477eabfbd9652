"""Text logs of facts, JSON documents, and lists of verdicts.

A fact line is `Name, tp=N, ts=N[, attr=value ...]`, with or without a leading `digits'` (its time of emission, which is passed over). Attribute names are passed over too: values are positional.
A watermark line is `>WATERMARK n<`, in any case, with or without the same prefix. Other lines are passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.context import Context

HEAD = r"^\s*(?:\d+')?\s*([A-Za-z_]\w*)\s*,\s*tp\s*=\s*(\d+)\s*,\s*ts\s*=\s*(\d+)\s*((?:,\s*\w+\s*=\s*(?:'[^']*'|\"[^\"]*\"|[^,'\"]*?)\s*)*)$"
VALUE = r",\s*\w+\s*=\s*('[^']*'|\"[^\"]*\"|[^,'\"]*)"
WATERMARK = r"(?i)^\s*(?:\d+')?\s*>WATERMARK\s+(-?\d+)<\s*$"
VERDICT = re.compile(r"@(\d+) \(time point (\d+)\):(.*)")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, label, ts, args): label is the line's time-point, args an array of texts without quotes."""
    got = lambda k: F.regexp_extract(column, HEAD, k)
    rows = lines.where(F.col(column).rlike(HEAD)).select(got(1).alias("name"), got(2).cast("long").alias("label"), got(3).cast("long").alias("ts"), got(4).alias("rest"))
    raw = F.regexp_extract_all("rest", F.lit(VALUE), F.lit(1))
    return rows.select("name", "label", "ts", F.transform(raw, lambda v: F.regexp_replace(F.trim(v), r"^(['\"])(.*)\1$", "$2")).alias("args"))


def watermarks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(watermark), not below 0."""
    return lines.where(F.col(column).rlike(WATERMARK)).select(F.greatest(F.regexp_extract(column, WATERMARK, 1).cast("long"), F.lit(0)).alias("watermark"))


def _typed(df: DataFrame, arity: int) -> DataFrame:
    """Columns c0.. of the argument texts; a column all of whose values are whole numbers is one of numbers."""
    flat = df.select("tp", *[F.get("args", k).alias(f"c{k}") for k in range(arity)])
    if not arity:
        return flat.distinct()
    whole = flat.agg(*[F.min(F.col(f"c{k}").rlike(r"^\d{1,18}$").cast("int")).alias(f"c{k}") for k in range(arity)]).first()
    return flat.select("tp", *[F.col(f"c{k}").cast("long").alias(f"c{k}") if whole[k] else F.col(f"c{k}") for k in range(arity)])


def context_of(parsed: DataFrame, cache: bool = True) -> tuple[Context, DataFrame]:
    """The context of parsed lines, and (tp, label, ts): time-points are numbered without gaps in the order of their labels.

    A predicate of several arities is found by name/arity. Predicates and types come from the data, so it is read for each of them; cached unless told otherwise.
    """
    from pyspark.sql import Window

    if cache:
        parsed = parsed.persist()
    labels = parsed.groupBy("label").agg(F.min("ts").alias("ts"))
    # Labels are ranked by timestamp within the dense order of timestamps, so windows stay small.
    from .traces import dense_times

    rank = dense_times(labels.select(F.col("label").alias("ts"))).select("tp", F.col("ts").alias("label"))
    times = labels.join(rank, "label").select("tp", "label", "ts").persist()
    facts = parsed.join(times.select("tp", "label"), "label").select("tp", "name", "args")
    out = {}
    for name, arity in sorted((r[0], r[1]) for r in parsed.select("name", F.size("args").alias("n")).distinct().collect()):
        out[f"{name}/{arity}"] = _typed(facts.where((F.col("name") == name) & (F.size("args") == arity)), arity)
    return Context(out, times, strict=False), times


def read_fact_log(spark: SparkSession, path: str) -> tuple[Context, DataFrame]:
    return context_of(parse_lines(spark.read.text(path)))


def fact_lines(spark: SparkSession, lines: Iterable[str]) -> tuple[Context, DataFrame]:
    return context_of(parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))


#: The first whole number under a key `timestamp`, at any depth.
TIMESTAMP = r"\"timestamp\"\s*:\s*(\d+)\s*[,}]"


def read_json_documents(spark: SparkSession, path: str, whole_files: bool = False) -> Context:
    """One document per line, or with whole_files any number of them over several lines; time-point and timestamp are the document's `timestamp`. Documents without one, or that are no JSON, are passed over."""
    if whole_files:
        texts = spark.read.text(path, wholetext=True)
        lines = texts.mapInArrow(_split_documents, "value string")
    else:
        lines = spark.read.text(path)
    return json_context(lines)


def json_context(lines: DataFrame, column: str = "value") -> Context:
    from .traces import Trace

    docs = lines.where(F.col(column).rlike(TIMESTAMP)).where(F.try_parse_json(column).isNotNull())
    return Trace(docs, F.regexp_extract(column, TIMESTAMP, 1)).with_documents(column).context()


def _split_documents(batches):
    import pyarrow as pa

    decoder = json.JSONDecoder()
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            at = 0
            while (begin := re.compile(r"[{\[]").search(text, at)) is not None:
                try:
                    _, at = decoder.raw_decode(text, begin.start())
                    out.append(" ".join(text[begin.start() : at].split("\n")))
                except ValueError:
                    at = begin.start() + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def edit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON edit events (type, ts, user, bot) to fact lines (column value)."""
    e = F.from_json(column, "type string, ts long, user string, bot boolean")
    rows = lines.select(e.alias("e")).where("e.type is not null and e.ts is not null")
    return rows.select(F.format_string('%s, tp=%d, ts=%d, user="%s", bot=%d', "e.type", "e.ts", "e.ts", "e.user", F.coalesce(F.col("e.bot"), F.lit(False)).cast("int")).alias("value"))


def with_watermarks(lines: Iterable[str]) -> list[str]:
    """A watermark line after the last line of each time-point, for tests of online use."""
    out, last = [], None
    for line in lines:
        m = re.search(r"tp\s*=\s*(\d+)", line)
        tp = int(m[1]) if m else last
        if last is not None and tp != last:
            out.append(f">WATERMARK {last}<")
        out.append(line)
        last = tp
    return out + ([f">WATERMARK {last}<"] if last is not None else [])


def parse_verdicts(text: str) -> dict[tuple[int, int], list[tuple]]:
    """(tp, ts) -> sorted tuples, from lines `@ts (time point tp): (a,b) (c,d)`; whole numbers become numbers."""
    value = lambda v: int(v) if re.fullmatch(r"-?\d+", v) else v.strip("'\"")
    out = {}
    for line in text.split("\n"):
        if m := VERDICT.match(line):
            rows = [tuple(value(v.strip()) for v in t.split(",") if v.strip()) for t in re.findall(r"\(([^()]*)\)", m[3])]
            out[int(m[2]), int(m[1])] = sorted(rows, key=str)
    return out
