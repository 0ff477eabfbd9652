import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tracewarden.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for k, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def brute(text):
    spans = sorted((m.start(), n, m.end(), k) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0]))
    return [f"{k}:{a}:{b}" for a, _, b, k in spans]


TEXTS = [
    *ODD,
    "mail a.b+c@x-y.co.uk, a@b, a@b.c@d.e, a@b.c_x@d.e.f and @x.y 🙂é z@q.r",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 999999999999999999999.1.1.1 1.2.3.4é10.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 5 4111  1111 00000000000000 12345678901234567890123",
    "+1 (017) 555-7713, +49 30 1234 and +1.2.3.4.5.6.7.8.9.0 +12345678901234567 +1)",
    "a" * 20000 + "@b.c",
    "7" * 20000,
    "1 2 " * 3000,
]


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("0123456789  .-+()@ab\né") for _ in range(rnd.randrange(120))) for _ in range(400)]
    rows = {r.doc_id: r for r in pii.found(documents(spark, texts).withColumns({"base": F.lit(1), "all": F.lit(2), "all_m0": F.lit(3)})).collect()}
    for k, t in enumerate(texts):
        want = brute(t)
        assert rows[k].base_spans == ",".join(want), t[:100]
        assert set(want) <= set(rows[k].spans.split(",")) | {""}
        assert [rows[k][f"n_{x}"] for x in PATTERNS] == [sum(w.startswith(x + ":") for w in want) for x in PATTERNS]


def test_the_trees_hold_on_fresh_texts(spark):
    data = pii._synthetic(400, seed=99)
    rows = pii.found(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(data)], "doc_id long, text string")).collect()
    hit = wrong = 0
    for r in rows:
        text, kind = data[r.doc_id]
        added = set(filter(None, r.spans.split(","))) - set(filter(None, r.base_spans.split(",")))
        good = [a for a in added if a.split(":")[0] == kind]
        hit += bool(good)
        wrong += len(added) - len(good)
    positive = sum(k != "" and not brute(t) for t, k in data)
    assert hit >= 0.6 * positive and wrong <= 0.05 * max(1, hit)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to ab@c.de or +1 (017) 555-7713 now", "x"), (2, None, "y"), (3, "nothing here", "z"), (4, "1.2.3.4@5.6", "w")], "doc_id long, text string, pii_text string")
    rows = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert rows[1].text == "write to [EMAIL] or [PHONE] now" and rows[1].pii_text == "x"
    assert rows[2].text is None and rows[3].text == "nothing here" and rows[4].text == "[EMAIL]"
    assert pii.redacted(spark.createDataFrame([], SCHEMA)).count() == 0 == pii.found(spark.createDataFrame([], SCHEMA)).count()


def test_no_python_on_executors(spark):
    plan = pii.found(documents(spark, ["a@b.c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|InArrow|ArrowEval|Pandas", plan)


def test_a_text_of_very_many_spans(spark):
    rnd = random.Random(6)
    forms = (lambda k: f"é{k} user{k}@host.org", lambda k: f"1.2.3.{k % 300}", lambda k: f"mail: b{k} [at] host dot org", lambda k: f"10[.]1[.]2[.]{k % 256}", lambda k: "🙂" * (k % 40))
    text = " ".join(rnd.choice(forms)(k) for k in range(20000))
    df = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    row = pii.found(df).where("doc_id = 1").first()
    want = brute(text)
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row.spans.split(","))]
    assert row.base_spans == ",".join(want) and set(want) <= set(row.spans.split(",")) and len(spans) > len(want) + 3000
    assert spans == sorted(set(spans), key=lambda x: (x[1], list(PATTERNS).index(x[0])))
    base = [x for x in spans if ":".join(map(str, x)) in set(want)]
    for k, a, b in set(spans) - set(base):
        at = sum(x[1] < b for x in base)
        assert not at or base[at - 1][2] <= a
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    assert pii.redacted(df).where("doc_id = 1").first().text == "".join(out) + text[at:]


def test_prefixes_in_chunks_equal_a_loop(spark):
    rnd = random.Random(1)
    rows = [(n, [rnd.randrange(50) for _ in range(n)]) for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 9000)]
    df = spark.createDataFrame(rows, "n int, xs array<int>")
    got = {r.n: (r.sums, r.most) for r in df.select("n", pii._before_each(F.col("xs"), lambda a, b: a + b).alias("sums"), pii._before_each(F.col("xs"), F.greatest).alias("most")).collect()}
    for n, xs in rows:
        assert got[n][0] == [sum(xs[:k]) for k in range(n)] if n < 100 else got[n][0][-1] == sum(xs[:-1])
        assert got[n][1] == [max(xs[:k], default=0) for k in range(n)]
