"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans, which may overlap: the base pattern of each kind, and looser forms (addresses spelt out, national telephone numbers, card numbers with other
separators, defanged IP addresses). Matches of a base pattern that pass its check are always kept. Every other candidate is scored by boosted regression trees over
its format and context, compiled into one SQL expression, and is kept if its score reaches the threshold of its kind and it overlaps no base span.

The trees are trained on the driver, once per process, on SYNTHETIC generated texts whose candidates went through the same expressions; a threshold is the least score
that holds PRECISION on the texts held out. Nothing is learnt from the corpus, so no bound or sample of it is involved.

Every text is handled within its row: no shuffle, no Python on executors. Positions are code points. Places, contexts and
overlaps are found in chunks, blocks and by halving, so that the work grows nearly in proportion to a text however many spans it has.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, narrow

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: (kind, base, pattern, pattern that a text must hold before the other is tried). The base patterns are those of the contract, written so that no text makes them slow: runs are
#: taken whole, and a match begins at the start of a run or where the last match ended.
GENERATORS = (
    ("email", True, rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", True, r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][\x20-]?[0-9]"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", False, rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?: ?[\[(]at[\])] ?| at | ?@ ?)[A-Za-z0-9-]{{1,63}}+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{{1,63}}+){{1,8}}", r"(?:[\[(]at[\])]|[\[(]dot[\])]| dot |@ )"),
    ("ip", False, r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", r"\[\.\]"),
    ("card", False, r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", r"[0-9][._/][0-9]{4}[._/]"),
    ("phone", False, r"(?<![0-9+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])", r"[0-9][ .-][0-9]{3,4}(?![0-9])"),
)
BEFORE, AFTER = 24, 8
KEYWORDS = {"email": "mail|contact|write|reach", "ip": "ip|address|host|server|addr", "card": "card|visa|pay|credit|amex|debit", "phone": "tel|phone|call|fax|mobile|cell|contact"}
FEATURES = ("kind", "base", "n_digits", "n_chars", "n_separators", "n_runs", "luhn", "parts", "plus", "paren", "keyword", "edge_before", "edge_after", "letter_share", "unlike")
SYNTHETIC, TREES, DEPTH, SHRINKAGE, PRECISION = 1600, 24, 3, 0.3, 0.98

#: Code points of a block of a text, and elements of an array that are folded at a time: they bound what one step copies or reads, nothing else.
BLOCK, CHUNK = 256, 64

_SPAN = "array<struct<s:int,e:int,t:string>>"


def _let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before_each(values: Column, op, levels: int = 2) -> Column:
    """For each number of an array the ones before it, put together by op from 0 on. Chunks are folded by themselves, then their totals likewise, so no array is copied once per element."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def fold(xs):
        return F.aggregate(xs, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def joined(parts):
        starts = _before_each(F.transform(parts, lambda p: p["at"]), op, levels - 1)
        return _let(starts, lambda all_: F.flatten(F.transform(parts, lambda p, c: F.transform(p["out"], lambda x: op(x, F.get(all_, c))))))

    def cut(xs):
        return F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))

    if not levels:
        return fold(values)["out"]
    return _let(values, lambda xs: _let(F.transform(cut(xs), fold), joined))


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a place in it is reached without reading it from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """The code points a (inclusive) to b (exclusive, perhaps beyond the end) of a text in blocks."""
    first = (a / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, ((b - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(some, a % BLOCK + 1, b - a)).otherwise(F.lit(""))


def _located(matches: Column, gaps: Column) -> Column:
    """Spans of matches: the lengths of the gaps between them give their places."""
    ends = lambda ms, gs: _before_each(F.transform(ms, lambda m, i: F.length(F.get(gs, i)) + F.length(m)), lambda x, y: x + y)

    def span(m, s):
        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("t"))

    def spans(ms, gs):
        return _let(ends(ms, gs), lambda at: F.transform(ms, lambda m, i: span(m, F.get(at, i) + F.length(F.get(gs, i)))))

    return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(_let(matches, lambda ms: _let(gaps, lambda gs: spans(ms, gs))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(backwards, i):
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    n = F.length(digits)
    total = _let(F.reverse(digits), lambda backwards: F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + one(backwards, i)))
    return F.when((n >= 1) & (n <= 40), total % 10 == 0).otherwise(F.lit(False))


def _parts_fit(t: Column) -> Column:
    """Whether the numbers between dots are at most 255."""
    bare = F.transform(F.split(F.translate(t, "[]", ""), r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _passes(kind: str, t: Column, digits: Column) -> Column:
    n = F.length(digits)
    if kind == "ip":
        return _parts_fit(t)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _described(blocks: Column, kind: str, base: bool, span: Column) -> Column:
    """A candidate: its place, whether it is a base span, and its features."""
    t, s, e = span["t"], span["s"], span["e"]
    before = _piece(blocks, F.greatest(s - BEFORE, F.lit(0)), s)
    after = _piece(blocks, e, e + AFTER)
    return _let(_digits(t), lambda d: _let(before, lambda x: _let(after, lambda y: _features(kind, base, t, s, e, d, x, y))))


def _features(kind: str, base: bool, t: Column, s: Column, e: Column, d: Column, before: Column, after: Column) -> Column:
    number = lambda x: x.cast("double")
    ok = _passes(kind, t, d) if base else F.lit(False)
    fields = {
        "kind": F.lit(float(KINDS.index(kind))),
        "base": F.lit(float(base)),
        "n_digits": number(F.length(d)),
        "n_chars": number(F.length(t)),
        "n_separators": number(F.length(F.regexp_replace(t, "[A-Za-z0-9]", ""))),
        "n_runs": number(F.size(F.split(F.regexp_replace(t, "[^0-9]+", " "), " "))),
        "luhn": number(_luhn(d) if kind == "card" else F.lit(False)),
        "parts": number(_parts_fit(t) if kind == "ip" else F.lit(False)),
        "plus": number(F.startswith(t, F.lit("+"))),
        "paren": number(F.contains(t, F.lit("("))),
        "keyword": number(F.rlike(F.lower(before), F.lit(KEYWORDS[kind]))),
        "edge_before": number((before == "") | F.rlike(before, F.lit(r"[\s:(\[<\"']\z"))),
        "edge_after": number((after == "") | F.rlike(after, F.lit(r"\A[\s,;.!?)\]>\"']"))),
        "letter_share": number(F.length(F.regexp_replace(t, "[^A-Za-z]", ""))) / number(F.greatest(F.length(t), F.lit(1))),
        "unlike": number(F.rlike(F.lower(before), F.lit(r"(?:\bv|version|release|isbn|no|nr|#|order|id|total|page|build|figure|section)[ .:]*\z"))),
    }
    return F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"), ok.alias("ok"), *[fields[x].alias(x) for x in FEATURES])


def _describer(blocks: Column, kind: str, base: bool):
    return lambda span: _described(blocks, kind, base, span)


def candidates(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with an array of candidates for the (non-null) text column. The helper columns are named after into."""
    own = df.columns
    for k, (_, _, pattern, gate) in enumerate(GENERATORS):
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        held = F.contains(F.col(text), F.lit(gate)) if gate == "@" else F.rlike(F.col(text), F.lit(gate))
        df = df.withColumn(f"{into}_m{k}", F.when(held, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({f"{into}_g{k}": F.when(F.size(f"{into}_m{k}") > 0, F.split(text, g[2], -1)) for k, g in enumerate(GENERATORS)})
    pairs = F.array(*[F.struct(F.col(f"{into}_m{k}").alias("m"), F.col(f"{into}_g{k}").alias("g")) for k in range(len(GENERATORS))])
    df = df.withColumn(f"{into}_s", F.transform(pairs, lambda pair: _located(pair["m"], pair["g"])))
    spans = F.col(f"{into}_s")
    described = lambda blocks: F.concat(*[F.transform(spans[k], _describer(blocks, g[0], g[1])) for k, g in enumerate(GENERATORS)])
    blocks = F.when(F.exists(spans, lambda own: F.size(own) > 0), _blocks(F.col(text))).otherwise(F.array().cast("array<string>"))
    return df.select(*[f"`{c}`" for c in own], _let(blocks, described).alias(into))


def _synthetic(n: int, seed: int = 11) -> list[tuple[str, str]]:
    """Texts with one thing each, and its kind, or "" if it is no personal data."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeioulnrstdm") for _ in range(rnd.randrange(2, 9)))

    def card(valid: bool) -> str:
        d = digits(15)
        total = sum(int(x) if k % 2 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for k, x in enumerate(d))
        return d + str((-total + (0 if valid else rnd.randrange(1, 10))) % 10)

    four = lambda c, s: s.join(c[k : k + 4] for k in range(0, 16, 4))
    part = lambda: str(rnd.randrange(256))
    makers = [
        ("email", lambda: f"{word()}{rnd.choice([' at ', ' (at) ', '(at)', '[at]', ' [at] '])}{word()}{rnd.choice([' dot ', '[dot]', ' (dot) ', '(dot)'])}{rnd.choice(['com', 'org', 'net', 'de'])}"),
        ("", lambda: f"{word()} at {word()} dot {word()} dot {word()}"),
        ("", lambda: f"{word()} @ {word()}.{word()}"),
        ("ip", lambda: "[.]".join(part() for _ in range(4))),
        ("", lambda: "[.]".join(str(rnd.randrange(256, 999)) for _ in range(4))),
        ("", lambda: ".".join(str(rnd.randrange(256, 9999)) for _ in range(4))),
        ("card", lambda: four(card(True), rnd.choice("._/"))),
        ("", lambda: four(card(False), rnd.choice("._/"))),
        ("", lambda: rnd.choice([digits(16), four(card(False), " "), digits(rnd.randrange(2, 13)), digits(4) + "-" + digits(2) + "-" + digits(2), digits(22)])),
        ("phone", lambda: rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])),
        ("", lambda: rnd.choice([f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}"])),
        ("", lambda: f"+{digits(1)} {digits(2)}-{digits(3)}"),
    ]
    labels = {"email": ["mail: ", "write to ", "contact "], "ip": ["ip ", "server ", "host "], "card": ["card ", "visa ", "pay with "], "phone": ["tel. ", "call ", "phone: ", "fax "]}
    out = []
    for _ in range(n):
        kind, make = rnd.choice(makers)
        lead = rnd.choice(labels[kind]) if kind and rnd.random() < 0.7 else rnd.choice(["order ", "no. ", "id: ", "total ", "version ", "page "]) if not kind and rnd.random() < 0.4 else ""
        out.append((f"{word()} {word()} {lead}{make()}{rnd.choice(['', '.', ',', ' '])} {word()}", kind))
    return out


def _tree(x, grad, hess, rows, depth):
    """The best tree of least squares on gradients: nested (feature, cut, left, right), or a leaf's value."""
    import numpy as np

    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = -g / (h + 1.0)
    if depth == 0 or len(rows) < 12:
        return float(leaf)
    best = (1e-6, None)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gs, hs = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[v[1:] == v[:-1]] = -1
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (gain[k], (f, float((v[k] + v[k + 1]) / 2)))
    if best[1] is None:
        return float(leaf)
    f, cut = best[1]
    left = x[rows, f] <= cut
    return (f, cut, _tree(x, grad, hess, rows[left], depth - 1), _tree(x, grad, hess, rows[~left], depth - 1))


def _value(tree, row) -> float:
    while not isinstance(tree, float):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, cut, low, high = tree
    return f"CASE WHEN c.{FEATURES[f]} <= {cut!r}D THEN {_sql(low)} ELSE {_sql(high)} END"


def boost(x, y):
    """(start, trees) on the logistic loss."""
    import numpy as np

    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    z, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
        trees.append(tree)
        z += SHRINKAGE * np.array([_value(tree, r) for r in x])
    return start, trees


_model: tuple[str, list[float]] | None = None


def model(spark: SparkSession) -> tuple[str, list[float]]:
    """The score of a candidate c as SQL, and the threshold of each kind."""
    global _model
    if _model is None:
        import numpy as np

        texts = spark.createDataFrame(_synthetic(SYNTHETIC), "t string, label string")
        rows = candidates(texts, "t", "c").select("label", "t", F.explode("c").alias("c")).select("label", "t", "c.*").collect()
        rows.sort(key=lambda r: (r.t, r.s, r.k, r.e, r.base))
        x = np.array([[r[f] for f in FEATURES] for r in rows])
        y = np.array([float(KINDS[r.k] == r.label and r.e - r.s > 6) for r in rows])
        texts_of = {t: k for k, t in enumerate(sorted({r.t for r in rows}))}
        held = np.array([texts_of[r.t] % 2 == 1 for r in rows])
        start, trees = boost(x[~held], y[~held])
        score = lambda r: start + SHRINKAGE * sum(_value(t, r) for t in trees)
        scores = np.array([score(r) for r in x])
        limits = []
        for k in range(len(KINDS)):
            own = held & (x[:, 0] == k) & ~np.array([r.ok for r in rows])
            order = np.flatnonzero(own)[np.argsort(-scores[own], kind="stable")]
            precise = np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= PRECISION
            limits.append(float(max(0.0, scores[order][np.flatnonzero(precise)[-1]])) if precise.any() else 1e9)
        _model = f"{start!r}D + {SHRINKAGE!r}D * (" + " + ".join(f"({_sql(t)})" for t in trees) + ")", limits
    return _model


def _starting_before(spans: Column, place: Column) -> Column:
    """How many of the spans, which ascend, start before a place, by halving."""

    def step(acc, _):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        half = lambda m: F.when(F.get(spans, m)["s"] < place, F.struct((m + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), m.alias("hi")))
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(_let(mid, half))

    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(spans)))), start, step, lambda acc: acc["lo"])


def _apart(base: Column, spans: Column) -> Column:
    """The spans that overlap no base span. Those of one kind don't overlap each other, so of each kind the last that starts before a span's end decides."""
    kinds = F.array(*[F.filter(base, _of_kind(k)) for k in range(len(KINDS))])
    hits = lambda c: lambda own: _let(_starting_before(own, c["e"]), lambda n: (n > 0) & (F.get(own, n - 1)["e"] > c["s"]))
    return _let(kinds, lambda all_: F.filter(spans, lambda c: ~F.exists(all_, hits(c))))


def _of_kind(k: int):
    return lambda c: c["k"] == k


def with_spans(df: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """df with two arrays of struct<s, k, e>, sorted: the base spans and all spans (k: the kind's place in KINDS). text: non-null."""
    score, limits = model(df.sparkSession)
    own = df.columns
    df = candidates(df, text, spans)
    limit = "CASE c.k " + " ".join(f"WHEN {k} THEN {x!r}D" for k, x in enumerate(limits)) + " END"
    bare = "array_sort(transform(filter(`{}`, c -> {}), c -> struct(c.s, c.k, c.e)))"
    df = df.select(*[f"`{c}`" for c in own], F.expr(bare.format(spans, "c.ok")).alias(base), F.expr(bare.format(spans, f"NOT c.ok AND ({score}) >= {limit}")).alias(spans))
    once = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))
    added = F.when(F.size(spans) > 0, _apart(F.col(base), _let(F.col(spans), once))).otherwise(F.col(spans))
    return df.withColumn(spans, F.array_sort(F.concat(F.col(base), added)))


def _written(spans: str) -> Column:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), c.k + 1)"
    return F.expr(f"array_join(transform(`{spans}`, c -> concat({names}, ':', c.s, ':', c.e)), ',')")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans, each written as kind:start:end, joined by commas.

    A null text is empty and has no span; ids may be null, rows that repeat are each given, an empty table gives none. Equal starts stand in the order of KINDS.
    """
    rows = with_spans(narrow(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))), "text", "base", "all")
    counts = [F.expr(f"cast(size(filter(base, c -> c.k = {k})) as bigint) as n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, _written("base").alias("base_spans"), _written("all").alias("spans"))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of the text replaced by [KIND]; spans that overlap become one, named by the first. Null texts stay null; all columns are kept."""
    text, base, spans = fresh(df, "pii_text"), fresh(df, "pii_base"), fresh(df, "pii_spans")
    rows = with_spans(df.withColumn(text, F.coalesce(f"`{text_col}`", F.lit(""))), text, base, spans)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = _before_each(F.transform(spans, lambda c: c["e"]), F.greatest)

    def written(blocks, covered):
        one = lambda c, i: F.when(c["s"] >= F.get(covered, i), F.concat(_piece(blocks, F.get(covered, i), c["s"]), F.element_at(names, c["k"] + 1))).otherwise(F.lit(""))
        last = F.greatest(F.element_at(spans, -1)["e"], F.element_at(covered, -1))
        return F.concat(F.array_join(F.transform(spans, one), ""), _piece(blocks, last, F.size(blocks) * BLOCK))

    new = F.when(F.size(spans) == 0, F.col(f"`{text_col}`")).otherwise(_let(_blocks(F.col(text)), lambda blocks: _let(ends, lambda covered: written(blocks, covered))))
    return rows.withColumn(text_col, new).select(*[f"`{c}`" for c in df.columns])
