import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tracewarden.llm import ctw, decontaminate, lm_score, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ctw(train, test, depth):
    """log2 of the chance of each test text, by recursion over context tuples."""
    counts = defaultdict(lambda: [0, 0])
    symbols = lambda t: [ctw.START] * depth + list(t) + [ctw.END]
    for t in train:
        s = symbols(t)
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    counts[(1 << j) | (s[i] >> (8 - j)), tuple(s[i - d : i][::-1])][s[i] >> (7 - j) & 1] += 1
    children = defaultdict(set)
    for node, c in counts:
        if c:
            children[node, c[:-1]].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def mixture(node, c):
        if (node, c) not in memo:
            e = kt(*counts[node, c])
            if len(c) == depth:
                memo[node, c] = (e, 1.0)
            else:
                below = sum(mixture(node, x)[0] for x in children[node, c])
                m = max(e, below)
                total = m + math.log(math.exp(e - m) + math.exp(below - m)) - math.log(2)
                memo[node, c] = (total, math.exp(e - total) / 2)
        return memo[node, c]

    def one(node, c, full):
        a, b = counts[node, c]
        own = (b + 0.5) / (a + b + 1)
        if len(c) == depth or (node, full[: len(c) + 1]) not in counts:
            return own
        w = mixture(node, c)[1]
        return w * own + (1 - w) * one(node, full[: len(c) + 1], full)

    out = []
    for t in test:
        s, total = symbols(t), 0.0
        for i in range(depth, len(s)):
            full = tuple(s[i - depth : i][::-1])
            for j in range(8):
                node = (1 << j) | (s[i] >> (8 - j))
                p = one(node, (), full) if (node, ()) in counts else 0.5
                total += math.log2(p if s[i] >> (7 - j) & 1 else 1 - p)
        out.append(total)
    return out


def corpus():
    rnd = random.Random(3)
    vocabulary = ["the", "of", "tion", "blend", "é", "ANd", "ing."] + ["".join(rnd.choice("abc") for _ in range(5)) for _ in range(40)]
    return list(enumerate([" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(25))) for _ in range(60)] + [t for t in ODD if not t or len(t) < 200]))


def test_scores_equal_the_recursion_and_the_unigram_formula(spark):
    docs = corpus()
    rows = {r.doc_id: r for r in lm_score.scored(documents(spark, docs, partitions=3).withColumns({"chunk": F.lit(1), "rows": F.lit(2)}), depth=3).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    norm = {i: " ".join(words(t)).encode() for i, t in docs}
    want = dict(zip(norm, brute_ctw([norm[i] for i, _ in docs if not held(i)], list(norm.values()), 3)))
    count = Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert any(map(held, norm))
    for i, t in docs:
        r, w = rows[i], [*words(t), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, want[i] * math.log10(2), rel_tol=1e-5, abs_tol=1e-4)


def test_chances_of_all_next_bytes_add_up_to_one():
    rnd = np.random.default_rng(1)
    text = bytes(rnd.choice(list(b"abcd "), 3000).tolist())
    keys, counts = np.unique(ctw.grams(text, 4), return_counts=True)
    weights = [ctw.Weights.of(x) for x in ctw.levels(keys, counts, 4, 0)]
    for context in (b"abca", b"zzzz", b"  ab"):
        c = int.from_bytes(context[::-1], "big")
        every = np.array([c << 8 | x for x in range(256)], dtype=np.uint64)
        assert abs((2 ** ctw.log2_chances(every, 4, weights)).sum() - 1) < 1e-9


def test_lm_of_few_or_no_rows(spark):
    assert lm_score.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    got = lm_score.scored(documents(spark, [(None, "a b"), (3, "a"), (3, "a")])).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.held_out) for r in got) == [("3", 2, lm_score.held_out(3))] * 2 + [("None", 3, False)]


def test_quality_learns_toxic_and_low_documents_and_keeps_clean_ones(spark):
    rnd = random.Random(5)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(20, 120))]
        kind = rnd.choice(["good"] * 4 + ["toxic", "low"])
        if kind == "toxic":
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["nasty", "vile", "awful"])
        text = " ".join(f"{x}###" for x in w) if kind == "low" else " ".join(w)
        rows.append((i, text, "en", f"src{i % 5}", 0))
        if i < 400:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
        rows[-1] = (*rows[-1][:4], {"good": 0, "toxic": 1, "low": 2}[kind])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judged(df, lab)
    assert out.columns == [*df.columns, "p_low", "p_toxic", "kept_"]
    fresh = [r for r in out.collect() if r.doc_id >= 400]
    good = [r for r in fresh if r.n_chars == 0]
    assert sum(r.kept_ for r in good) >= 0.98 * len(good)
    assert sum(r.kept_ for r in fresh if r.n_chars) <= 0.1 * len(fresh)


def test_quality_fit_does_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choice("one two three four five six".split()) for _ in range(12)) + (" vile" if k % 4 == 0 else "")) for k in range(60)]
    marks = [(k, 1 if k % 3 else 0, 1 if k % 4 == 0 else 0) for k in range(60)] + [(k, 1, 0) for k in range(0, 60, 7)]  # some conflict
    fits = []
    for seed in (1, 2):
        random.Random(seed).shuffle(docs)
        random.Random(seed).shuffle(marks)
        lab = spark.createDataFrame(marks, "doc_id long, quality long, toxic long").repartition(1 + seed)
        fits.append(quality.fit(documents(spark, docs, partitions=1 + 2 * seed), lab))
    for one, two in zip(*fits):
        assert one.limit == two.limit and (one.v == two.v).all() and (one.w == two.w).all()


def test_site_rates_shrink_sparse_sites_towards_their_parents(spark):
    rows = [("bad", "a", 4.0)] * 200 + [("bad", "b", 4.0)] + [("good", "a", -4.0)] * 800 + [("good", "b", 4.0)] + [(None, None, -4.0)] * 3
    df = spark.createDataFrame(rows, "host string, path string, low_odds double").withColumn("toxic_odds", F.col("low_odds"))
    got = {(r.host, r.path): r.low_shift for r in quality.site_rates(df).collect()}
    assert got["bad", "a"] > 0.5 and got["bad", "b"] > 0.5  # one row, but its host is bad
    assert got["good", "a"] < 0 and got["good", "b"] < got["bad", "b"]
    assert len(got) == 5


def test_quality_without_labels_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judged(documents(spark, list(ODD)), lab)
    assert out.count() == len(ODD) == out.where("kept").count()
    assert quality.judged(spark.createDataFrame([], SCHEMA), lab).count() == 0


def items():
    rnd = random.Random(8)
    vocabulary = [f"t{k}" for k in range(400)]
    return rnd, vocabulary, [(i, ". ".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 40))) for _ in range(rnd.randrange(1, 5)))) for i in range(60)]


def test_decontamination_finds_items_and_leaves_others(spark):
    rnd, vocabulary, bench = items()
    noise = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "x", "y"]) for _ in range(n))
    docs, want = [], set()
    for i in range(150):
        parts = [noise(rnd.randrange(300))]
        for item, text in rnd.sample(bench, rnd.choice([0, 0, 1, 2])):
            if len(text.split()) >= 12:
                parts += [rnd.choice([text, text.upper(), text.replace(" ", "\n")]), noise(rnd.randrange(50))]
                want.add((i, item))
        docs.append((i, " ".join(parts)))
    df = documents(spark, docs)
    b = spark.createDataFrame([*bench, (900, None), (901, " "), (None, "lonely text of a null item id that nobody holds")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, b).collect()}
    assert want <= got
    assert all(any(x == d for x, _ in want) for d, _ in got)
    scores = lambda **k: {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(df, b, **k).collect()}
    assert scores() == scores(slice_items=13) == scores(slice_items=40) and scores().keys() == got  # weights are those of the whole benchmark
    assert {r.doc_id for r in decontaminate.clean(df, b, slice_items=20).collect()} == {i for i, _ in docs} - {d for d, _ in got}
    clean = decontaminate.clean(df.withColumn("score", F.lit(1)), b)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {d for d, _ in got}


def test_block_max_search_equals_full_scoring():
    rnd, vocabulary, bench = items()
    index = decontaminate.Index(bench, part=20, threshold=0.35)
    full = [Counter() for _ in index.owner]
    for block in index.postings:
        for term, rows in block.items():
            for k, w in rows:
                full[k][term] += w
    assert all(abs(sum(f.values()) - 1) < 1e-9 for f in full)
    hits = 0
    for _ in range(60):
        doc = [w for _ in range(4) for w in rnd.choice([bench[rnd.randrange(60)][1].replace(".", "").split()[:15], [rnd.choice(vocabulary) for _ in range(30)]])]
        ids = index.numbers([w.encode() for w in doc])
        got = {(b, k): s for b, block in index.passages(ids) for k, s in index.score(ids[b : b + 40], block)}
        want = {}
        for b in range(0, max(1, len(ids) - 20), 20):
            own = set(ids[b : b + 40].tolist())
            for k, f in enumerate(full):
                if (s := sum(w for t, w in f.items() if t in own)) >= 0.35:
                    want[b, k] = s
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in got)
        hits += len(want)
    assert hits > 20


def test_decontamination_of_odd_and_no_rows(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "word word")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, [(None, "ZERO One two three four five six seven eight nine ten."), (4, None), (5, "")]), b).collect()]
    assert got == [(None, 1)]
    empty = b.where("false")
    assert decontaminate.contaminated(documents(spark, list(ODD)), empty).count() == 0
    assert decontaminate.clean(documents(spark, list(ODD)), empty).count() == len(ODD)
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), b).count() == 0


def test_decontamination_looks_beside_every_place_of_the_question():
    long = "what is the name of the river that runs by the old mill. it is called the winding brook"
    short = "oninhe. " + " ".join(f"a{k}" for k in range(22))
    index = decontaminate.Index([(1, long), (2, short), *[(10 + k, f"filler item number {k} has other words k{k}. and ends so") for k in range(20)]])
    noise = " ".join(f"n{k}" for k in range(400))
    found = lambda *parts: [hit[0] for hit in index.search(" ".join(parts).encode())]
    for item, text in ((1, long), (2, short)):
        question = text.split(". ")[0]
        assert found(text) == found(noise, text, noise) == [item]
        assert found(question, noise, text) == found(question, noise, question, noise, text, noise) == [item]
        assert found(text, noise, question) == [item]
        assert found(question, noise, question) == []
    assert found("oninhe", noise, *[f"a{k}" for k in range(22)], noise, "oninhe") == []  # the answer is beside no place


def test_most_beside_equals_slicing():
    rnd = random.Random(4)
    for _ in range(200):
        ids = np.array([rnd.randrange(12) for _ in range(rnd.randrange(1, 60))], dtype=np.int32)
        places = sorted(rnd.sample(range(len(ids)), rnd.randrange(1, len(ids) + 1)))
        wanted, before, after = set(rnd.sample(range(12), 4)), rnd.randrange(10), rnd.randrange(1, 10)
        want = max(len(wanted & set(ids[max(0, p - before) : p + after].tolist())) for p in places)
        assert decontaminate.most_beside(wanted, ids, places, before, after) == want
