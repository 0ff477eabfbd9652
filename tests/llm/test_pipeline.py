import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tracewarden.llm import similar, simhash
from tracewarden.llm.common import write_shared


def tables(spark, folder):
    rnd = random.Random(6)
    plain = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    item = text(30)
    docs, labels = [], []
    for i in range(300):
        t = text(rnd.randrange(40, 120))
        if i % 10 == 3:
            t = t.replace(" ", " nasty ", 4)
        labels.append((i, 1, int(i % 10 == 3)))
        if i % 25 == 7:
            t = t + " " + item
        if i % 25 == 9:
            t = t + " mail me@here.org now"
        docs.append((i, t, "en", f"src{i % 4}", len(t)))
    docs += [(1000 + k, docs[k][1], "en", "src1", docs[k][4]) for k in (0, 1, 2)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    docs = tables(spark, folder)
    ids = lambda df: {r.doc_id for r in df.collect()}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    want = {d[0] for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, df, folder)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        if k == 0:
            want = {i for i in want if i % 10 != 3 or i >= 1000}
        elif k == 1:
            want -= {1000, 1001, 1002}
        elif k == 2:
            want = {i for i in want if i % 25 != 7}
        out.write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        assert ids(df) == want, name
    rows = {r.doc_id: r for r in df.collect()}
    assert rows[9].text.endswith("mail [EMAIL] now") and rows[9].n_chars == len(rows[9].text)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == want
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert zlib.crc32(b"") == 0


def test_deduplicated_keeps_one_row_of_each_component(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(20)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, t) for i, t in enumerate(texts[:5])] + [(3, texts[3]), (None, texts[7]), (None, "only null"), (None, "only null"), (99, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").withColumn("row", F.lit(0))
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    known = {i: t for i, t in rows if i is not None}
    groups = brute_components(sorted(known), [brute_fingerprint(known[i]) for i in sorted(known)])
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert sum(r.doc_id is None for r in out.collect()) == 1
    assert simhash.deduplicated(df.where("false")).count() == 0


def near_copies():
    """Texts with chains of near copies, short and empty ones, and a line that many hold."""
    rnd = random.Random(12)
    text = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    line, texts = text(30), []
    for k in range(60):
        w = text(rnd.choice([3, 6, 20, 60, 150])) + (line if k % 3 == 0 else [])
        texts.append(" ".join(w))
        for _ in range(rnd.randrange(5)):
            w = list(w)
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(99)}"
            texts.append(" ".join(w))
    return [*texts, "", None, "one", "One", " ".join(line)]


def shingle_set(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_stage_links_all_texts_of_similarity_eight_tenths(spark):
    texts = near_copies()
    sets, fps = [shingle_set(t) for t in texts], [brute_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            similar = bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            apart = bin(fps[i] ^ fps[j]).count("1") > 4
            far += similar and apart
            if similar or not apart:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: group.index(g) for g in group}
    assert far > 20
    df = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in enumerate(texts)] * 2, SCHEMA).repartition(3).withColumn("node", F.lit(1))
    got = corpus_pipeline.distinct(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())
    assert corpus_pipeline.distinct(spark, df.where("false"), "").count() == 0


def test_forest_connects_what_is_alike():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 60, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k : k + 30], base[:2]])) for k in range(11)] + [rnd.integers(0, 99, 5, dtype=np.uint64)]
    pairs = [(i, j) for i in range(12) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    group = list(range(12))
    for i, j in pairs:
        group = [group[j] if g == group[i] else g for g in group]
    mine = list(range(12))
    found = similar.alike(sets)
    for i, j in found:
        mine = [mine[j] if g == mine[i] else g for g in mine]
    assert [[a == b for b in group] for a in group] == [[a == b for b in mine] for a in mine]
    assert len(found) == 12 - len(set(group))
    maybe = similar.maybe_alike(np.array([len(x) for x in sets]), np.stack([np.frombuffer(similar.bitmap(x), dtype="<u8") for x in sets]))
    assert all(maybe[i] == maybe[j] for i, j in pairs) and maybe[11] != maybe[0]


def few_links(spark, monkeypatch, texts):
    """The links of these texts as components by number, and rows of what was sent to be compared, by table of places."""
    tables = {}
    monkeypatch.setattr(similar, "write_shared", lambda df, name: tables.setdefault(name, write_shared(df, name)))
    rows = [(zlib.crc32((t or "").lower().encode()), k, t) for k, t in enumerate(texts)]
    found = similar.links(write_shared(spark.createDataFrame(rows, "node long, fp long, text string").repartition(3), "texts"), 5, 42).collect()
    group = list(range(len(texts)))
    for r in found:
        group = [group[r.b] if g == group[r.a] else g for g in group]
    return group, tables


def test_texts_are_sent_once_to_be_compared_and_bitmaps_are_as_wide_as_their_sets(spark, monkeypatch):
    rnd = random.Random(15)
    texts, want = [], []
    for k in range(12):
        w = [f"c{k}w{x}" for x in range(rnd.choice([150, 300]))]
        for _ in range(8):
            again = list(w)
            for _ in range(rnd.randrange(1, 3)):
                again[rnd.randrange(len(again))] = f"edit{rnd.randrange(10**6)}"
            texts.append(" ".join(again))
            want.append(k)
    texts += [" ".join(f"x{k}y{x}" for x in range(100)) for k in range(30)]
    want += list(range(100, 130))
    group, tables = few_links(spark, monkeypatch, texts)
    assert [[a == b for b in group] for a in group] == [[a == b for b in want] for a in want]
    assert tables["members"].count() > 2 * 96  # groups overlap
    assert tables["places"].count() == tables["places"].select("node").distinct().count() == 96
    assert [len(similar.bitmap(np.arange(n, dtype=np.uint64))) for n in (0, 1, 64, 65, 300, 20_000)] == [8, 8, 8, 16, 64, 4096]
    monkeypatch.setattr(similar, "MOST", 2000)  # the places of the longer texts would be larger
    again, tables = few_links(spark, monkeypatch, texts)
    assert [[a == b for b in again] for a in again] == [[a == b for b in want] for a in want]
    assert tables["places"].count() > 96


def test_bitmaps_of_two_widths_lose_no_alike_sets():
    rnd = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(56, 300), dtype=np.uint64))
        sets += [base, base[len(base) // 5 :], base[: -(len(base) // 9)], np.unique(np.append(base, rnd.integers(0, 1 << 63, len(base) // 5, dtype=np.uint64)))]
    size, bits = np.array([len(x) for x in sets]), [np.frombuffer(similar.bitmap(x), dtype="<u8") for x in sets]
    maybe = similar.maybe_alike(size, bits)
    widths = 0
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                widths += len(bits[i]) != len(bits[j])
                assert maybe[i] == maybe[j]
    assert widths > 20 and len(set(maybe.tolist())) >= 50
