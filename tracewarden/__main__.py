"""python -m tracewarden POLICY [FILE]: monitors a policy over a fact log or JSON documents.

POLICY is the text of a policy or a file that holds it. Without FILE facts are read from standard input; with --online verdicts are printed as soon as watermark lines
make them final, instead of at the end of the input.
"""

from __future__ import annotations

import argparse
import re
import shutil
import sys
import tempfile
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .plans.compiler import monitor
from .plans.syntax import PolicyError
from .sources import fact_logs, sinks


def online(spark: SparkSession, policy: str, lines: Iterable[str], step: int) -> None:
    """Prints @ts: (values) for each verdict. Facts are taken step lines at a time, or at a watermark line; the end of the input decides the rest."""
    from .streaming.monitor import FACTS, StreamMonitor

    def show(verdicts, _epoch):
        for row in verdicts.orderBy("ts").toLocalIterator():
            print(f"@{row[0]}: ({','.join(map(str, row[1:]))})", flush=True)

    folder = tempfile.mkdtemp(prefix="tracewarden-")
    m = StreamMonitor(spark, policy, f"file://{folder}", show, delay=None)
    held: list[str] = []
    epoch = 0

    def flush():
        nonlocal held, epoch
        if held:
            facts = fact_logs.parse_lines(spark.createDataFrame([(x,) for x in held], "value string")).select("name", "ts", "args")
            m.process(spark.createDataFrame(facts.collect(), FACTS), epoch)
            held, epoch = [], epoch + 1

    try:
        for line in lines:
            mark = re.match(fact_logs.WATERMARK, line)
            if not mark:
                held.append(line)
            if mark or len(held) >= step:
                flush()
            if mark:
                m.advance(max(0, int(mark[1])))
        flush()
        m.finish()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewarden", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("policy")
    p.add_argument("file", nargs="?")
    p.add_argument("-w", "--workers", type=int, default=1, help="local threads, unless Spark's master is set elsewhere")
    p.add_argument("-m", "--mode", choices=("file", "print", "batches", "discard", "parquet", "0", "1", "2"), default="print", help="0: file, 1: print, 2: batches")
    p.add_argument("-o", "--output", default="verdicts", help="the folder for file and parquet")
    p.add_argument("-f", "--format", choices=("csv", "json"), default="csv")
    p.add_argument("-b", "--batch", type=int, default=1000, help="lines that are printed together in mode batches")
    p.add_argument("-s", "--step", type=int, default=1000, help="lines that are taken together in online mode")
    p.add_argument("--online", action="store_true", help="print verdicts when watermark lines make them final; fact lines on standard input only")
    p.add_argument("-d", "--deduplicate", action="store_true", help="accepted for compatibility; results are sets in any case")
    a = p.parse_args(args)
    spark = SparkSession.builder.master(f"local[{a.workers}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.online:
            online(spark, a.policy, (x.rstrip("\n") for x in sys.stdin), a.step)
            return 0
        lines = spark.read.text(a.file) if a.file else spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "value string")
        if a.format == "json":
            ctx = fact_logs.json_context(lines)
            times = ctx.times
        else:
            ctx, times = fact_logs.context_of(fact_logs.parse_lines(lines))
        out = monitor(a.policy, ctx)
    except PolicyError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    mode = {"0": "file", "1": "print", "2": "batches"}.get(a.mode, a.mode)
    if mode == "file":
        sinks.write_text(out, times, a.output)
    elif mode == "parquet":
        sinks.write_parquet(out, a.output)
    elif mode == "discard":
        sinks.discard(out)
    else:
        sinks.print_lines(out, times, a.batch if mode == "batches" else None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
