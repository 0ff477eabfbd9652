from tracewarden.plans.context import Context


def context(spark, facts, ts, arities=None):
    """facts: a dict from names to lists of tuples for each time-point; arities for predicates that may be without facts."""
    arities = dict(arities or {})
    rows = {}
    for tp, day in enumerate(facts):
        for name, tuples in day.items():
            for t in tuples:
                arities.setdefault(name, len(t))
                rows.setdefault(name, []).append((tp, *t))
    kinds = {}
    for name, n in arities.items():
        some = rows.get(name, [])
        kinds[name] = ", ".join(["tp long", *[f"c{k} " + ("string" if some and isinstance(some[0][k + 1], str) else "long") for k in range(n)]])
    tables = {name: spark.createDataFrame(rows.get(name, []), kinds[name]) for name in arities}
    return Context(tables, spark.createDataFrame(list(enumerate(ts)), "tp long, ts long"))


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)), "not a set"
    return set(got)
