"""Policies over streams: bounded replay of the batch plan.

Facts arrive in any order as rows (name, ts, args), in micro-batches. Let W be the watermark: all facts with a timestamp below W have arrived. A verdict at timestamp t is final once everything that it looks at lies below W; then it is emitted, once. Facts that no
later verdict can look at are dropped. How far a policy looks comes from reach(): sums of interval ends, plus neighbouring time-points for PREVIOUS and NEXT.

* Unbounded past operators keep all facts (their plan needs the first witness or the open run of a tuple). Unbounded future operators emit at finish() only.
* Facts below the watermark are late and are dropped; late() counts them.

The retained facts are a Parquet table in a folder that all machines share, replaced in each step, so a lost executor costs a retry of tasks only. State that survives
the driver (the watermark, the table's place, the number of time-points dropped) is one small row in the same table's folder, written last. start() goes on from it.
A driver lost between the sink and that row gives the same verdicts again, with the same epoch: a sink that replaces by (epoch, ts) holds each once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import monitor
from ..plans.context import Context
from ..plans.normalize import normalize, reach
from ..plans.parser import parse
from ..plans.syntax import Formula, Pred
from ..sources.traces import dense_times

FACTS = "name string, ts long, args array<string>"


def predicates(f: Formula) -> set[tuple[str, int]]:
    own = {(f.name, len(f.args))} if isinstance(f, Pred) else set()
    return own.union(*[predicates(p) for p in f.parts()]) if f.parts() else own


class StreamMonitor:
    """policy over facts (name, ts, args); sink gets (verdicts, epoch) with columns ts and the policy's variables.

    delay: the watermark trails the largest timestamp by so much; None: it moves by advance() only. types: SQL types of variables' values by predicate
    (name -> list); arguments are text unless given here.
    """

    def __init__(self, spark: SparkSession, policy: str, folder: str, sink: Callable[[DataFrame, int], None], delay: int | None = 0, types: dict[str, list[str]] | None = None):
        self.spark, self.sink, self.delay, self.types = spark, sink, delay, types or {}
        self.formula = parse(policy)
        self.needs = predicates(self.formula)
        self.past, self.future, self.before, self.after = reach(normalize(self.formula))
        self.folder = folder.rstrip("/")
        self.state = {"table": None, "watermark": None, "done": None, "late": 0, "epoch": -1}
        self.outdated: str | None = None

    # -- one step -----------------------------------------------------------------------------------------------------
    def process(self, batch: DataFrame, epoch: int) -> None:
        """Takes a micro-batch of facts; the function for foreachBatch. A batch that is given again is passed over."""
        if epoch <= self.state["epoch"]:
            return
        w = self.state["watermark"]
        fresh = batch.select("name", F.col("ts").cast("long").alias("ts"), "args")
        high = fresh.agg(F.max("ts"), F.count_if(F.col("ts") < (w if w is not None else -(1 << 62)))).first()
        if w is not None:
            fresh = fresh.where(F.col("ts") >= w)
        new = w
        if self.delay is not None and high[0] is not None:
            new = max(high[0] - self.delay, w if w is not None else high[0] - self.delay)
        self._step(fresh, new, epoch, late=high[1])

    def advance(self, watermark: int) -> None:
        """All facts with timestamps below watermark have arrived (a watermark line)."""
        w = self.state["watermark"]
        self._step(None, max(watermark, w) if w is not None else max(watermark, 0), self.state["epoch"])

    def finish(self) -> None:
        """The stream has ended: everything is decided, with windows cut off at its end."""
        self._step(None, None, self.state["epoch"], end=True)

    def late(self) -> int:
        return self.state["late"]

    def _facts(self) -> DataFrame:
        return self.spark.read.schema(FACTS).parquet(self.state["table"]) if self.state["table"] else self.spark.createDataFrame([], FACTS)

    def _step(self, fresh: DataFrame | None, watermark: int | None, epoch: int, late: int = 0, end: bool = False) -> None:
        facts = self._facts()
        if fresh is not None:
            facts = facts.unionByName(fresh).distinct()
        table = f"{self.folder}/facts-{uuid.uuid4().hex}"
        low = self._keep_from(facts, watermark)
        kept = facts if low is None else facts.where(F.col("ts") >= low)
        kept.write.parquet(table)
        before = dict(self.state)
        self.state |= {"table": table, "watermark": watermark if watermark is not None else before["watermark"], "late": before["late"] + late, "epoch": max(epoch, before["epoch"])}
        self._emit(watermark, end)
        self._save()
        # The table before this one may still be read by what the sink was given last; the one before that is not needed.
        if self.outdated:
            self._remove(self.outdated)
        self.outdated = before["table"]

    def _emit(self, watermark: int | None, end: bool) -> None:
        if not end and (watermark is None or self.future == float("inf")):
            return
        facts = self._facts()
        line = facts.select("ts").distinct()
        if not end:
            line = line.where(F.col("ts") < watermark)
        # The last timestamp whose future lies in what is complete.
        upper = None
        if not end:
            if self.after:
                known = [r.ts for r in line.orderBy(F.desc("ts")).limit(self.after).collect()]
                if len(known) < self.after:
                    return
                upper = min(watermark - self.future - 1, known[-1] - self.future - 1)
            else:
                upper = watermark - self.future - 1
        done = self.state["done"]
        if upper is not None and done is not None and upper <= done:
            return
        used = facts if end else facts.where(F.col("ts") < watermark)
        ctx, times = self._context(used)
        out = monitor(self.formula, ctx).join(times, "tp").drop("tp")
        if upper is not None:
            out = out.where(F.col("ts") <= upper)
        if done is not None:
            out = out.where(F.col("ts") > done)
        names = [c for c in out.columns if c != "ts"]
        self.sink(out.select("ts", *[f"`{n}`" for n in names]), self.state["epoch"])
        self.state["done"] = upper if upper is not None else 1 << 62

    def _context(self, facts: DataFrame) -> tuple[Context, DataFrame]:
        times = dense_times(facts.select("ts"))
        rows = facts.join(times, "ts").select("tp", "name", "args")
        out = {}
        for name, arity in self.needs:
            own = rows.where((F.col("name") == name) & (F.size("args") == arity))
            kinds = self.types.get(name, ["string"] * arity)
            out[f"{name}/{arity}"] = own.select("tp", *[F.get("args", k).cast(kind).alias(f"c{k}") for k, kind in enumerate(kinds)])
        return Context(out, times, strict=False), times

    def _keep_from(self, facts: DataFrame, watermark: int | None) -> int | None:
        """The least timestamp that a verdict not yet emitted may look at; None: all."""
        done = self.state["done"]
        if done is None or self.past == float("inf"):
            return None
        low = done + 1 - self.past
        if self.before:
            older = [r.ts for r in facts.where(F.col("ts") < low).select("ts").distinct().orderBy(F.desc("ts")).limit(self.before).collect()]
            low = older[-1] if older else low
        return low

    def _remove(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- state that survives the driver ---------------------------------------------------------------------------------
    def _save(self) -> None:
        s = self.state
        row = [(s["table"], s["watermark"], s["done"], s["late"], s["epoch"])]
        self.spark.createDataFrame(row, "table string, watermark long, done long, late long, epoch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    def restore(self) -> bool:
        """Goes on from the state in the folder; False if there is none."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/state").orderBy(F.desc("epoch"), F.desc_nulls_last("done"), F.desc_nulls_last("watermark")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
        self.state = rows[0].asDict()
        return True

    # -- Structured Streaming -------------------------------------------------------------------------------------------
    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False):
        """Runs on a streaming DataFrame of facts (name, ts, args), from the state in the folder if there is one."""
        if self.state["table"] is None:
            self.restore()
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def fact_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame of facts from text logs that arrive in a folder."""
    from ..sources.fact_logs import parse_lines

    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_lines(reader.text(folder)).select("name", "ts", "args")

