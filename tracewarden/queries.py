"""The registered queries: policies over traces made from the tables, and SQL that spells out their definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.compiler import monitor
from .plans.context import Context
from .plans.definitions import definition
from .sources.traces import Trace, days, hours

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_hourly(spark: SparkSession, sf_dir: str) -> Context:
    """Hours since 2024 as timestamps: <type>(user), ev(user, type), and the documents in props."""
    trace = Trace(_read(spark, sf_dir, "events"), hours("ts"))
    for kind in EVENT_TYPES:
        trace.predicate(kind, "user_id", where=F.col("event_type") == kind)
    return trace.predicate("ev", "user_id", "event_type").with_documents("props").context()


def shipments_daily(spark: SparkSession, sf_dir: str) -> Context:
    """Days of shipment: ship(supplier, part), returned(supplier, part), line(supplier, line number), and A, B, C over suppliers and small classes of parts."""
    trace = Trace(_read(spark, sf_dir, "lineitem"), days("l_shipdate"))
    trace.predicate("ship", "l_suppkey", "l_partkey").predicate("returned", "l_suppkey", "l_partkey", where=F.col("l_returnflag") == "R").predicate("line", "l_suppkey", F.col("l_linenumber").cast("long"))
    for name, flag in (("A", "A"), ("B", "N"), ("C", "R")):
        source, target = F.col("l_suppkey") % 10, F.col("l_partkey") % 10
        trace.predicate(name, source, target, where=F.col("l_returnflag") == flag)
    return trace.context()


def orders_daily(spark: SparkSession, sf_dir: str) -> Context:
    """Days of order: placed(customer, status), prio(customer, priority)."""
    return Trace(_read(spark, sf_dir, "orders"), days("o_orderdate")).predicate("placed", "o_custkey", "o_orderstatus").predicate("prio", "o_custkey", "o_orderpriority").context()


def conversations(spark: SparkSession, sf_dir: str) -> Context:
    """Turns of conversations: said(conversation, role)."""
    return Trace(_read(spark, sf_dir, "conversations"), F.col("turn")).predicate("said", "conv_id", "role").context()


_HOUR = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT)"
_SHIP, _ORDER = "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)", "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
#: context -> (constructor, predicates in SQL, timestamps in SQL)
TRACES: dict[str, tuple[Callable[[SparkSession, str], Context], dict[str, str], str]] = {
    "events": (
        events_hourly,
        {k: f"SELECT {_HOUR} AS ts, user_id AS c0 FROM events WHERE event_type = '{k}'" for k in EVENT_TYPES} | {"ev": f"SELECT {_HOUR} AS ts, user_id AS c0, event_type AS c1 FROM events"},
        f"SELECT DISTINCT {_HOUR} AS ts FROM events",
    ),
    "shipments": (
        shipments_daily,
        {
            "ship": f"SELECT {_SHIP} AS ts, l_suppkey AS c0, l_partkey AS c1 FROM lineitem",
            "returned": f"SELECT {_SHIP} AS ts, l_suppkey AS c0, l_partkey AS c1 FROM lineitem WHERE l_returnflag = 'R'",
            "line": f"SELECT {_SHIP} AS ts, l_suppkey AS c0, CAST(l_linenumber AS BIGINT) AS c1 FROM lineitem",
        }
        | {n: f"SELECT {_SHIP} AS ts, l_suppkey % 10 AS c0, l_partkey % 10 AS c1 FROM lineitem WHERE l_returnflag = '{g}'" for n, g in (("A", "A"), ("B", "N"), ("C", "R"))},
        f"SELECT DISTINCT {_SHIP} AS ts FROM lineitem",
    ),
    "orders": (orders_daily, {"placed": f"SELECT {_ORDER} AS ts, o_custkey AS c0, o_orderstatus AS c1 FROM orders", "prio": f"SELECT {_ORDER} AS ts, o_custkey AS c0, o_orderpriority AS c1 FROM orders"}, f"SELECT DISTINCT {_ORDER} AS ts FROM orders"),
    "conversations": (conversations, {"said": "SELECT turn AS ts, conv_id AS c0, role AS c1 FROM conversations"}, "SELECT DISTINCT turn AS ts FROM conversations"),
}

#: query -> (context, policy)
POLICIES: dict[str, tuple[str, str]] = {
    # scans and constants
    "atom_scan": ("events", "click(u)"),
    "atom_constant": ("events", "ev(u, 'purchase')"),
    "atom_repeated_var": ("shipments", "line(x, x)"),
    "atom_binary": ("orders", "placed(c, s)"),
    "true_source": ("events", "TRUE"),
    "false_source": ("events", "FALSE"),
    "const_source": ("events", "x = 40"),
    # selection, extension, projection
    "filter_const": ("events", "click(u) AND u = 7"),
    "filter_var": ("shipments", "line(x, y) AND x = y"),
    "extend": ("events", "click(u) AND w = u"),
    "extend_const": ("events", "(x = 3) AND click(u)"),
    "neg_filter": ("events", "click(u) AND NOT u = 7"),
    "exists": ("events", "EXISTS v. ev(u, v)"),
    "exists_join": ("shipments", "EXISTS x. (A(x, y) AND B(x, z))"),
    "forall_guarded": ("events", "click(u) AND FORALL v. (ev(u, v) IMPLIES NOT v = 'purchase')"),
    # joins
    "conj_join": ("events", "click(u) AND view(u)"),
    "conj_cross": ("events", "error(u) AND signup(v)"),
    "conj_zero_ary": ("events", "(EXISTS u. error(u)) AND (EXISTS u. signup(u))"),
    "conj_intersect": ("orders", "prio(c, p) AND prio(c, p)"),
    "anti_join": ("events", "click(u) AND NOT purchase(u)"),
    "anti_join_left": ("events", "NOT purchase(u) AND click(u)"),
    "anti_join_no_shared": ("events", "click(u) AND NOT (EXISTS v. signup(v))"),
    # sets and sugar
    "union": ("events", "click(u) OR view(u)"),
    "union_reordered": ("shipments", "A(x, y) OR B(y, x)"),
    "except": ("events", "click(u) AND NOT view(u)"),
    "implies": ("events", "view(u) AND (error(u) IMPLIES click(u))"),
    "equiv": ("events", "view(u) AND (error(u) EQUIV click(u))"),
    "short_forms": ("events", "click(u) && ~view(u) || click(u) && purchase(u)"),
    # neighbours
    "previous": ("events", "PREVIOUS[0,*) click(u)"),
    "previous_metric": ("events", "PREVIOUS[1,1] click(u)"),
    "next": ("events", "NEXT[0,*) click(u)"),
    "next_metric": ("events", "NEXT[1,2] click(u)"),
    # unary temporal operators
    "once_finite": ("events", "ONCE[0,7] click(u)"),
    "once_shifted": ("events", "ONCE[2,5] click(u)"),
    "once_inf": ("events", "ONCE[3,*) purchase(u)"),
    "once_zero_inf": ("events", "ONCE[0,*) purchase(u)"),
    "once_zero_ary": ("events", "ONCE[1,3] (EXISTS u. signup(u))"),
    "eventually_finite": ("events", "EVENTUALLY[0,7] click(u)"),
    "eventually_shifted": ("events", "EVENTUALLY[2,5] click(u)"),
    "eventually_inf": ("events", "EVENTUALLY[3,*) purchase(u)"),
    "eventually_zero_inf": ("events", "EVENTUALLY[0,*) purchase(u)"),
    # binary temporal operators
    "since": ("events", "view(u) SINCE[0,24] click(u)"),
    "since_inf": ("events", "view(u) SINCE[0,*) click(u)"),
    "since_later": ("events", "view(u) SINCE[1,6] click(u)"),
    "since_zero_ary": ("events", "(EXISTS v. view(v)) SINCE[0,12] error(u)"),
    "since_wider_right": ("events", "view(u) SINCE[0,5] ev(u, k)"),
    "until": ("events", "view(u) UNTIL[0,24] click(u)"),
    "until_inf": ("events", "view(u) UNTIL[0,*) click(u)"),
    "until_zero_ary": ("events", "(EXISTS v. view(v)) UNTIL[0,12] error(u)"),
    "neg_since": ("events", "(NOT purchase(u)) SINCE[0,24] error(u)"),
    "neg_until": ("events", "(NOT purchase(u)) UNTIL[0,24] error(u)"),
    "neg_since_wider_right": ("events", "(NOT purchase(u)) SINCE[0,5] ev(u, k)"),
    # guarded universal operators
    "past_always_guarded": ("events", "click(u) AND PAST_ALWAYS[0,3] NOT error(u)"),
    "always_guarded": ("events", "click(u) AND ALWAYS[0,3] NOT error(u)"),
    "past_always_positive": ("events", "click(u) AND PAST_ALWAYS[0,1] view(u)"),
    "always_positive": ("events", "click(u) AND ALWAYS[0,1] view(u)"),
    # nested shapes
    "purchase_after_error": ("events", "purchase(u) AND ONCE[1,24] error(u)"),
    "edit_twice": ("events", "click(u) AND ONCE[1,3] (click(u) AND ONCE[1,3] click(u))"),
    "star": ("shipments", "((ONCE[0,3] A(w, x)) AND B(w, y)) AND ONCE[0,3] C(w, z)"),
    "linear": ("shipments", "((ONCE[0,3] A(w, x)) AND B(x, y)) AND EVENTUALLY[0,3] C(y, z)"),
    "nested_triangle": ("shipments", "((ONCE[0,7] A(x, y)) AND B(y, z)) AND EVENTUALLY[0,7] C(z, x)"),
    "negated_triangle": ("shipments", "((ONCE[0,7] A(x, y)) AND B(y, z)) AND NOT EVENTUALLY[0,7] C(z, x)"),
    "answered_turns": ("conversations", "said(c, 'assistant') AND PREVIOUS[1,1] said(c, 'user')"),
    "returned_soon": ("shipments", "returned(s, p) AND ONCE[1,30] ship(s, p)"),
    # rewrites
    "optimizer_true_since": ("events", "TRUE SINCE[0,7] click(u)"),
    "optimizer_true_until": ("events", "TRUE UNTIL[0,7] click(u)"),
    "optimizer_false_since": ("events", "FALSE SINCE[0,7] click(u)"),
    "optimizer_same_operands": ("events", "(click(u) OR click(u)) AND click(u)"),
}

JSON_POLICIES: dict[str, str] = {
    "json_filter_project": "<<.k AS k & .k > 50>>",
    "json_once": "ONCE[0,3] <<.k AS k & .k >= 90 & .k != 95>>",
}
_DOCS = f"WITH times AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS tp FROM (SELECT DISTINCT {_HOUR} AS ts FROM events)), docs AS (SELECT DISTINCT tp, times.ts, json_extract_string(props, '$.k') AS k FROM (SELECT *, {_HOUR} AS hour FROM events) e JOIN times ON times.ts = e.hour) "
JSON_SQL = {
    "json_filter_project": _DOCS + "SELECT DISTINCT tp, k FROM docs WHERE CAST(k AS DOUBLE) > 50",
    "json_once": _DOCS + "SELECT DISTINCT t.tp, k FROM times t JOIN docs d ON d.tp <= t.tp AND t.ts - d.ts BETWEEN 0 AND 3 WHERE CAST(k AS DOUBLE) >= 90 AND CAST(k AS DOUBLE) <> 95",
}


def _query(name: str, context: str, policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return monitor(policy, TRACES[context][0](spark, sf_dir))

    run.__name__, run.__doc__ = name, policy
    return run


QUERIES = {name: _query(name, *what) for name, what in POLICIES.items()} | {name: _query(name, "events", p) for name, p in JSON_POLICIES.items()}
ORACLE_SQL = {name: definition(policy, TRACES[context][1], TRACES[context][2]) for name, (context, policy) in POLICIES.items()} | JSON_SQL
FLAGSHIP = "purchase_after_error"
