"""Online verdicts: the union of what is emitted equals the batch result, whatever the order of arrival."""

import os
import random

import pytest

from tracewarden.plans.compiler import monitor
from tracewarden.sources import fact_logs
from tracewarden.streaming.monitor import FACTS, StreamMonitor, fact_stream

FACT_ROWS = [("p", t, (str(v),)) for t, v in ((0, 1), (1, 1), (1, 2), (3, 1), (4, 3), (6, 1), (7, 2), (9, 1), (10, 3))] + [("q", t, (str(v),)) for t, v in ((0, 1), (2, 2), (4, 1), (5, 3), (8, 1), (9, 2))]
POLICIES = ["p(x) AND ONCE[1,3] q(x)", "p(x) AND NOT EVENTUALLY[0,2] q(x)", "(NOT p(x)) SINCE[0,4] q(x)", "NEXT[0,3] p(x)", "PREVIOUS q(x)", "ONCE[2,*) q(x)", "p(x) AND EVENTUALLY q(x)"]


def batch(spark, policy, facts):
    ctx, times = fact_logs.fact_lines(spark, [f"{n}, tp={t}, ts={t}, " + ", ".join(f"a='v{v}'" for v in a) for n, t, a in facts])
    return {(r.ts, *[r[c] for c in r.asDict() if c not in ("tp", "ts", "label")]) for r in monitor(policy, ctx).join(times, "tp").collect()}


def named(facts):
    return [(n, t, [f"v{v}" for v in a]) for n, t, a in facts]


@pytest.mark.parametrize("policy", POLICIES)
def test_any_order_within_the_delay(spark, tmp_path, policy):
    rnd = random.Random(policy)
    facts = sorted(named(FACT_ROWS), key=lambda f: f[1] + rnd.random() * 3)
    seen = []
    m = StreamMonitor(spark, policy, f"file://{tmp_path}/state", lambda df, epoch: seen.extend(map(tuple, df.collect())), delay=3)
    for epoch, k in enumerate(range(0, len(facts), 5)):
        m.process(spark.createDataFrame(facts[k : k + 5], FACTS), epoch)
    early = len(seen)
    m.finish()
    assert len(seen) == len(set(seen)) and set(seen) == batch(spark, policy, FACT_ROWS)
    assert m.late() == 0
    assert early > 0 or m.future == float("inf")


def test_watermarks_late_facts_pruning_and_restart(spark, tmp_path):
    seen = []
    sink = lambda df, epoch: seen.extend(map(tuple, df.collect()))
    folder = f"file://{tmp_path}/state"
    m = StreamMonitor(spark, "p(x) AND ONCE[0,2] q(x)", folder, sink, delay=None)
    m.process(spark.createDataFrame([("q", 1, ["a"]), ("p", 2, ["a"]), ("p", 9, ["a"])], FACTS), 0)
    assert seen == []
    m.advance(5)
    assert seen == [(2, "a")]
    m.process(spark.createDataFrame([("p", 3, ["a"]), ("q", 8, ["a"])], FACTS), 1)
    assert m.late() == 1
    m.process(spark.createDataFrame([("q", 8, ["a"])], FACTS), 1)  # given again
    again = StreamMonitor(spark, "p(x) AND ONCE[0,2] q(x)", folder, sink, delay=None)
    assert again.restore() and again.state["watermark"] == 5
    again.advance(20)
    assert seen == [(2, "a"), (9, "a")]
    again.process(spark.createDataFrame([("p", 30, ["b"])], FACTS), 2)
    again.advance(31)
    assert {r.ts for r in again._facts().collect()} == {30}
    assert not StreamMonitor(spark, "p(x)", f"file://{tmp_path}/none", sink).restore()


def write_logs(folder, files, first=0):
    """Log files whose times tell their order: files of one clock tick have none."""
    for k, lines in enumerate(files, start=first):
        path = folder / f"{k}.csv"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_600_000_000 + 10 * k, 1_600_000_000 + 10 * k))


def test_structured_streaming_over_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_logs(logs, (["E, tp=0, ts=0, u=a", "E, tp=2, ts=2, u=b"], ["E, tp=1, ts=1, u=a"], ["E, tp=9, ts=9, u=a"]))
    seen = []
    m = StreamMonitor(spark, "E(u) AND ONCE[1,1] E(u)", f"file://{tmp_path}/state", lambda df, epoch: seen.extend(map(tuple, df.collect())), delay=2)
    m.start(fact_stream(spark, str(logs), files_per_batch=1), f"file://{tmp_path}/checkpoint", available_now=True).awaitTermination(120)
    m.finish()
    assert set(seen) == {(1, "a")} and m.late() == 0


def test_a_new_driver_goes_on_from_the_state_and_old_tables_go(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    seen = []

    def driver():
        m = StreamMonitor(spark, "E(u) AND ONCE[1,1] E(u)", f"file://{tmp_path}/state", lambda df, epoch: seen.extend(map(tuple, df.collect())), delay=2)
        m.start(fact_stream(spark, str(logs), files_per_batch=1), f"file://{tmp_path}/checkpoint", available_now=True).awaitTermination(120)
        return m

    write_logs(logs, (["E, tp=0, ts=0, u=a"], ["E, tp=3, ts=3, u=b"], ["E, tp=5, ts=5, u=b"]))
    driver()
    write_logs(logs, (["E, tp=6, ts=6, u=b"], ["E, tp=1, ts=1, u=a"]), first=3)
    m = driver()
    m.finish()
    assert sorted(seen) == [(6, "b")] and m.late() == 1
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("facts-")]) <= 3
