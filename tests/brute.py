"""Policies by their definitions, in plain Python, for small traces."""

from itertools import product

from tracewarden.plans.syntax import (Always, And, Const, Eq, Eventually, Exists, Forall, Iff, Implies, Next, Not, Once, Or, PastAlways, Pred, Previous, Since, Truth, Until, free)


def holds(f, i, env, facts, ts):
    go = lambda g, j, e=env: holds(g, j, e, facts, ts)
    value = lambda t: t.value if isinstance(t, Const) else env[t.name]
    n = len(ts)
    inside = lambda d: f.interval.start <= d and (f.interval.end is None or d <= f.interval.end)
    match f:
        case Truth():
            return f.value
        case Pred():
            return tuple(map(value, f.args)) in facts[i].get(f.name, ())
        case Eq():
            return value(f.left) == value(f.right)
        case Not():
            return not go(f.body, i)
        case And():
            return go(f.left, i) and go(f.right, i)
        case Or():
            return go(f.left, i) or go(f.right, i)
        case Implies():
            return not go(f.left, i) or go(f.right, i)
        case Iff():
            return go(f.left, i) == go(f.right, i)
        case Exists() | Forall():
            each = (go(f.body, i, env | dict(zip(f.names, vs))) for vs in product(env["*"], repeat=len(f.names)))
            return any(each) if isinstance(f, Exists) else all(each)
        case Previous():
            return i > 0 and inside(ts[i] - ts[i - 1]) and go(f.body, i - 1)
        case Next():
            return i + 1 < n and inside(ts[i + 1] - ts[i]) and go(f.body, i + 1)
        case Once():
            return any(inside(ts[i] - ts[j]) and go(f.body, j) for j in range(i + 1))
        case PastAlways():
            return all(not inside(ts[i] - ts[j]) or go(f.body, j) for j in range(i + 1))
        case Eventually():
            return any(inside(ts[j] - ts[i]) and go(f.body, j) for j in range(i, n))
        case Always():
            return all(not inside(ts[j] - ts[i]) or go(f.body, j) for j in range(i, n))
        case Since():
            return any(inside(ts[i] - ts[j]) and go(f.right, j) and all(go(f.left, k) for k in range(j + 1, i + 1)) for j in range(i + 1))
        case Until():
            return any(inside(ts[j] - ts[i]) and go(f.right, j) and all(go(f.left, k) for k in range(i, j)) for j in range(i, n))
    raise AssertionError(f)


def evaluate(f, facts, ts):
    """facts: a dict from names to sets of tuples for each time-point. The set of (tp, values...)."""
    domain = {v for day in facts for rows in day.values() for r in rows for v in r}
    stack = [f]
    while stack:
        g = stack.pop()
        stack += g.parts()
        domain |= {t.value for t in ([*g.args] if isinstance(g, Pred) else [g.left, g.right] if isinstance(g, Eq) else []) if isinstance(t, Const)}
    names = free(f)
    return {(i, *vs) for i in range(len(ts)) for vs in product(sorted(domain, key=str), repeat=len(names)) if holds(f, i, {"*": domain} | dict(zip(names, vs)), facts, ts)}
