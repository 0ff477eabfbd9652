"""Policies with known verdicts."""

import pytest

from tests.helpers import context, rows
from tracewarden.plans.compiler import monitor
from tracewarden.plans.syntax import PolicyError

PQ1 = [{"p": [(3, 4)], "q": [(3, 5)]}, {"p": [(5, 6)], "q": [(5, 7)]}, {"p": [(7, 8)], "q": [(8, 8)]}]
CASES = [
    ("p(x, 5, x)", [{"p": [(4, 5, 4)]}, {"p": [(6, 5, 6)]}, {"p": [(7, 5, 8)]}, {"p": [(5, 5, 4)]}], [0, 1, 2, 3], {(0, 4), (1, 6)}),
    ("p(y, x) AND (x = 3)", [{"p": [(4, 3)]}, {"p": [(6, 5)]}, {"p": [(8, 7)]}, {"p": [(5, 3)]}], [0, 1, 2, 3], {(0, 4, 3), (3, 5, 3)}),
    ("NOT p(x) SINCE [0,*) q(x)", [{"p": [(4,)], "q": [(5,)]}, {"p": [(6,)], "q": [(8,)]}, {"p": [(8,)]}, {"p": [(5,)]}], [0, 1, 2, 3], {(0, 5), (1, 5), (1, 8), (2, 5)}),
    ("PREVIOUS [1,1] (a(x) AND b(x))", [{"a": [(2,)], "b": [(2,)]}, {"a": [(4,)]}, {"a": [(3,)], "b": [(4,)]}], [9, 10, 11], {(1, 2)}),
    ("(NOT (x2 = 24)) UNTIL(0,2) P1(x1,x2)", [{"P3": [()]}, {"P1": [(1, 1)]}, {"P1": [(1, 2), (1, 24), (1, 23)]}], [0, 1, 2], {(0, 1, 1), (1, 1, 2), (1, 1, 23)}),
    ("p(x, y) AND q(x, z)", PQ1, [0, 1, 2], {(0, 3, 4, 5), (1, 5, 6, 7)}),
    ("p(x) AND NOT q(x)", [{"p": [(3,)], "q": [(3,)]}, {"p": [(5,)], "q": [(5,)]}, {"p": [(7,)], "q": [(8,)]}], [0, 1, 2], {(2, 7)}),
    ("EXISTSx.(p(x, y) AND q(x, z))", PQ1, [0, 1, 2], {(0, 4, 5), (1, 6, 7)}),
    ("(a(a,b) OR b(b,a))", [{"a": [(10, 20)], "b": [(20, 2)]}, {"a": [(1, 2)], "b": [(2, 1)]}, {"a": [(2, 2)], "b": [(4, 5)]}], [9, 10, 11], {(0, 2, 20), (0, 10, 20), (1, 1, 2), (2, 2, 2), (2, 5, 4)}),
    ("TRUE UNTIL [10, 20] q(x,y)", [{"q": [(3, 5)]}, {"q": [(5, 7)]}, {"q": [(8, 8)]}], [10, 20, 30], {(0, 5, 7), (0, 8, 8), (1, 8, 8)}),
    ("(ONCE[0, 7] (A(x,y) AND B(y,z))) AND NOT (EVENTUALLY[0, 7] C(z, x))", [{"A": [(1, 1)], "B": [(1, 2)]}, {"A": [(1, 2)], "B": [(2, 1)]}, {"B": [(2, 2)], "A": [(2, 2)], "C": [(1, 1)]}], [0, 1, 2], {(0, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (2, 2, 2, 2)}),
    ("x2 = 40", [{"p": [(1,)]}, {}, {}], [0, 1, 2], {(0, 40), (1, 40), (2, 40)}),
    ("p(x, y)", [{"p": [(3, "foo")]}, {"p": [(4, "bar")]}], [0, 1], {(0, 3, "foo"), (1, 4, "bar")}),
    ("a() AND b()", [{"a": [()], "b": [()]}, {"a": [()]}, {"b": [()]}], [0, 1, 2], {(0,)}),
    ("TRUE", [{"a": [()]}, {}], [3, 4], {(0,), (1,)}),
    ("p(x) AND NOT NOT q(x)", [{"p": [(3,), (4,)], "q": [(3,)]}], [0], {(0, 3)}),
    ("NOT (EXISTS x. q(x))", [{"q": [(3,)]}, {}], [0, 1], {(1,)}),
]


@pytest.mark.parametrize(("policy", "facts", "ts", "want"), CASES, ids=[c[0] for c in CASES])
def test_golden(spark, policy, facts, ts, want):
    assert rows(monitor(policy, context(spark, facts, ts))) == want


def test_errors_name_what_is_wrong(spark):
    ctx = context(spark, [{"p": [(1,)]}], [0])
    with pytest.raises(PolicyError, match="no predicate q"):
        monitor("q(x)", ctx)
    with pytest.raises(PolicyError, match="1 arguments, not 2"):
        monitor("p(x, y)", ctx)
    with pytest.raises(PolicyError, match="violations"):
        monitor("NOT p(x)", ctx)


def test_filters_reach_the_scan(spark, tmp_path):
    from tracewarden.plans.context import Context

    path = f"file://{tmp_path}/facts"
    spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "tp long, c0 long, c1 long").write.parquet(path)
    ctx = Context({"p": spark.read.parquet(path)}, spark.createDataFrame([(0, 0), (1, 1)], "tp long, ts long"))
    plan = monitor("p(x, 4)", ctx)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c1,4)" in plan
