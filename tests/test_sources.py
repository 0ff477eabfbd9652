import json

from tests.helpers import rows
from tracewarden.plans.compiler import monitor
from tracewarden.sources import fact_logs, sinks
from tracewarden.sources.traces import dense_times

LINES = ["A, tp=7, ts=7, x0=111613425, x1=2", "11'B, tp=11, ts=12, x0=789708455, x1=1", "12'>WATERMARK 6<", ">WATERMARk -6<", "A, tp=7, ts=7, x0=111613425, x1=2", "no fact", "Z, tp=7, ts=7", "S, tp=11, ts=12, u='a b', v=\"c\", w=bare, z=[unknown]", "A, tp=11, ts=12, x0=5"]


def test_fact_lines(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = sorted((r.name, r.label, r.ts, tuple(r.args)) for r in fact_logs.parse_lines(lines).distinct().collect())
    assert got == [("A", 7, 7, ("111613425", "2")), ("A", 11, 12, ("5",)), ("B", 11, 12, ("789708455", "1")), ("S", 11, 12, ("a b", "c", "bare", "[unknown]")), ("Z", 7, 7, ())]
    assert sorted(r.watermark for r in fact_logs.watermarks(lines).collect()) == [0, 6]


def test_logs_have_dense_time_points_and_arities(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join(LINES) + "\n")
    ctx, times = fact_logs.read_fact_log(spark, f"file://{path}")
    assert sorted((r.tp, r.label, r.ts) for r in times.collect()) == [(0, 7, 7), (1, 11, 12)]
    assert rows(monitor("A(x, y) AND Z()", ctx)) == {(0, 111613425, 2)}
    assert rows(monitor("ONCE[0,5] A(x, 2)", ctx)) == {(0, 111613425), (1, 111613425)}
    assert rows(monitor("A(x)", ctx)) == {(1, 5)}
    assert rows(monitor("never(x)", ctx)) == set()
    out = monitor("ONCE[0,5] A(x, 2)", ctx)
    sinks.write_text(out, times, f"file://{tmp_path}/out")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect())
    assert fact_logs.parse_verdicts(text) == {(7, 7): [(111613425,)], (11, 12): [(111613425,)]}


def test_json_documents(spark, tmp_path):
    docs = [{"a": {"timestamp": 5}, "user": "u", "n": 3}, {"timestamp": 6, "user": "u", "n": 9, "bot": True}, {"user": "none"}, {"timestamp": 6, "user": "v", "n": 1, "bot": False}]
    path = tmp_path / "docs.json"
    path.write_text("\n".join([*map(json.dumps, docs), '{"timestamp": 5, broken']))
    ctx = fact_logs.read_json_documents(spark, f"file://{path}")
    assert rows(monitor("<<.user>>", ctx)) == {(0, "u"), (1, "u"), (1, "v")}
    assert rows(monitor("<<.user AS w & .n > 2>>", ctx)) == {(0, "u"), (1, "u")}
    assert rows(monitor("<<.user & .bot = false>>", ctx)) == {(1, "v")}
    assert rows(monitor("<<.user AS w & .n AS n & .n <= 3>> AND ONCE[1,1] <<.user AS w>>", ctx)) == set()
    assert rows(monitor("<<.user AS w & .n >= 9>> AND ONCE[1,1] <<.user AS w>>", ctx)) == {(1, "u")}
    assert {r[1] for r in rows(monitor("<<.user & .n & .n < 2>>", ctx))} == {'{"user":"v","n":"1"}'}
    whole = tmp_path / "pretty.json"
    whole.write_text("\n".join(json.dumps(d, indent=2) for d in docs) + "\n{ broken")
    assert rows(monitor("<<.user>>", fact_logs.read_json_documents(spark, f"file://{whole}", whole_files=True))) == {(0, "u"), (1, "u"), (1, "v")}


def test_edit_events_become_fact_lines(spark):
    docs = spark.createDataFrame([('{"type":"edit","ts":3,"user":"a b","bot":true}',), ("x",)], "value string")
    lines = [r.value for r in fact_logs.edit_lines(docs).collect()]
    assert lines == ['edit, tp=3, ts=3, user="a b", bot=1']
    ctx, _ = fact_logs.fact_lines(spark, lines)
    assert rows(monitor("edit(u, 1)", ctx)) == {(0, "a b")}


def test_watermarks_are_put_after_time_points():
    assert fact_logs.with_watermarks(["A, tp=1, ts=1", "B, tp=1, ts=1", "A, tp=2, ts=2"]) == ["A, tp=1, ts=1", "B, tp=1, ts=1", ">WATERMARK 1<", "A, tp=2, ts=2", ">WATERMARK 2<"]


def test_dense_times(spark):
    ts = [5, 5, 9, 100000, 7, 123456789]
    df = spark.createDataFrame([(t,) for t in ts], "ts long")
    assert sorted(map(tuple, dense_times(df).collect())) == [(k, t) for k, t in enumerate(sorted(set(ts)))]
    assert [r.tp for r in dense_times(spark.createDataFrame([(3,), (6,)], "ts long"), calendar=True).orderBy("ts").collect()] == [0, 1, 2, 3]
    assert dense_times(spark.createDataFrame([], "ts long")).count() == 0


def test_mixed_values_are_text(spark):
    ctx, _ = fact_logs.fact_lines(spark, ["p, tp=0, ts=0, a=1", "p, tp=1, ts=1, a=x"])
    assert rows(monitor("p(x)", ctx)) == {(0, "1"), (1, "x")}


def test_command_line(spark, tmp_path, capsys):
    from tracewarden.__main__ import main

    path = tmp_path / "log.csv"
    path.write_text("E, tp=0, ts=10, u=a\nE, tp=1, ts=11, u=a\n")
    assert main(["E(u) AND ONCE[1,1] E(u)", f"file://{path}"]) == 0
    assert capsys.readouterr().out == "@11 (time point 1): (a)\n"
    assert main(["NOT E(u)", f"file://{path}"]) == 2


def test_online_command_line(spark, capsys, monkeypatch):
    import io

    from tracewarden.__main__ import main

    lines = ["E, tp=0, ts=10, u=a", "F, tp=1, ts=11, u=a", ">WATERMARK 12<", "3'E, tp=3, ts=13, u=b"]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines) + "\n"))
    assert main(["E(u) AND NOT F(u)", "--online"]) == 0
    assert capsys.readouterr().out == "@10: (a)\n@13: (b)\n"
