import random
import re

import numpy as np
import xxhash

from tests.llm.helpers import ODD, SCHEMA, documents
from tracewarden.llm import simhash
from tracewarden.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, tau=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = list(ODD)
    for _ in range(40):
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(50)) for _ in range(rnd.randrange(3, 200))]
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            again = list(words)
            again[rnd.randrange(len(again))] = "changed"
            texts.append(" ".join(again))
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert {k: r.component_id for k, r in got.items()} == brute_components(list(range(len(texts))), fps)


def test_links_of_clustered_and_random_fingerprints(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(simhash, "SMALL", 8)
    fps = {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for f in list(fps)[:20]:
        for _ in range(15):
            x = f
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.link_fingerprints(df, 4).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4 for r in links)
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(signed, fps)
    assert {s: roots.get(s, s) for s in signed} == want


def test_large_buckets_are_split_and_dense_ones_give_few_links(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 64)
    rnd = random.Random(4)
    near = np.array(sorted({1 << rnd.randrange(64) | 1 << rnd.randrange(64) for _ in range(500)}), dtype=np.uint64)
    a, b = simhash.forest(near, 4)
    assert len(a) < 5 * len(near)
    joined = brute_components(list(range(len(near))), near.tolist())
    assert set(joined.values()) == {0} and set(a) | set(b) == set(near.tolist())


def test_every_allocation_obeys_the_pigeonhole_principle():
    rnd = np.random.default_rng(0)
    for n in (10, 10_000, 10_000_000, 10_000_000_000):
        x = (rnd.random((2000, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
        parts = simhash.plan(x.T @ x * (n / 2000), n, 4)
        assert sum(t + 1 for _, t in parts) == 5
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits))


def test_null_ids_repeated_rows_and_no_rows(spark):
    got = simhash.near_duplicates(documents(spark, [(None, "solo text here now"), (5, "b c d e"), (5, "b c d e"), (3, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("5", "5"), ("5", "5"), ("None", "None")]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
