import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tracewarden.llm import recompress
from tracewarden.llm.host_rules import host_rules
from tracewarden.llm.recompress import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=20):
    first, words = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words[i] = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [text(rnd.choice([19, 20, 21, 40, 100])) for _ in range(8)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += rnd.choice(passages) if rnd.random() < 0.6 else text(rnd.randrange(30))
        docs.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    docs += docs[3:9] + ["a " * 50, "b a " * 40, "a " * 19, "x " + "a " * 30 + "y", "the the the " * 20, ODD[-7] or ""]
    rnd.shuffle(docs)
    return list(enumerate(docs + list(ODD), start=5))


def test_repeats_equal_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(documents(spark, docs, partitions=4)).collect()}
    assert got == brute(docs)


def test_small_batches_give_the_same(spark):
    docs = corpus(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(documents(spark, docs, partitions=3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(docs)


def test_other_window_null_ids_repeated_rows_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = documents(spark, [(1, text), (1, text), (2, "x " + text), (None, text)]).withColumns({"tag": F.lit(1), "found": F.lit("x"), "kept": F.lit(0)})
    got = sorted(((r.doc_id, r.n_removed) for r in without_repeats(df, window=12).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 30), (None, 0)]
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_inner_windows_with_equal_words_choose_the_same_symbol():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 3, 8, 1000):
        pool = [[b"w%d" % k for k in np.repeat(rnd.integers(0, size, 40), rnd.integers(1, 1 + rnd.integers(1, 9), 40))] for _ in range(6)]
        texts = [sum((pool[k][a:] for k, a in zip(rnd.integers(0, 6, 5), rnd.integers(0, 60, 5))), []) for _ in range(25)]
        by_words = {}
        for together in ([[t] for t in texts], [texts]):  # one by one, and all in one call
            for some in together:
                cut = np.cumsum([0, *map(len, some)])
                best = recompress.choices(recompress.word_names(sum(some, [])), cut, 16) >> np.uint64(recompress.low_bits(16))
                for t, a in zip(some, cut):
                    assert (best[a + max(0, len(t) - 15) : a + len(t)] == 0).all()
                    for k in range(len(t) - 15):
                        assert best[a + k] and by_words.setdefault(tuple(t[k : k + 16]), best[a + k]) == best[a + k]


def test_levels_name_runs_and_pairs_within_their_extents():
    words = [b"x", b"a", b"a", b"a", b"a", b"a", b"y", *[b"v%d" % k for k in range(40)]]
    names = recompress.word_names(words)
    found = recompress.levels(names, np.zeros(len(words), dtype=np.int64), 16)
    assert len(found) > 3 and len(found[0][0]) == len(words)
    longest = max(int((end - begin).max()) for _, _, _, begin, end in found[1:] if len(end))
    assert longest >= 3
    for _, lo, hi, begin, end in found:
        assert ((lo <= begin) & (end <= hi) & (hi - lo <= 16) & (lo >= 0) & (hi <= len(words))).all()
    assert any(((begin <= 2) & (end >= 5)).any() for _, _, _, begin, end in found[1:])  # the inner three of five


def test_names_that_collide_stop_the_job_and_another_seed_answers(spark, tmp_path, monkeypatch):
    docs = corpus(5)
    df = documents(spark, docs, partitions=4)
    with pytest.raises(Exception, match="NamesCollide"):
        without_repeats(df, bits=4).collect()
    # One document a batch: no name meets another before the shuffle, so the comparison of words has to find it.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        with pytest.raises(Exception, match="NamesCollide"):
            without_repeats(df, bits=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    honest = recompress.without_repeats
    monkeypatch.setattr(recompress, "without_repeats", lambda df, seed, **options: honest(df, seed=seed, bits=4 if seed == 0 else 96, **options))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in recompress.repeats_removed(df, f"file://{tmp_path}/kept").collect()}
    assert got == brute(docs)


def test_very_long_and_very_common_texts(spark):
    rnd = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    long = [f"u{rnd.randrange(5000)}" for _ in range(60_000)]
    docs = [(0, " ".join(long + passage + long[:3000]))] + [(k, " ".join([f"d{k}", f"e{k}", *passage, f"f{k}"])) for k in range(1, 400)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(documents(spark, docs, partitions=5)).collect()}
    assert got == brute(docs) and got[0][1] == 3000


def test_sql_separates_words_at_all_six_characters(spark):
    words = [f"w{k}" for k in range(45)]
    seps = " \t\n\x0b\x0c\r"
    docs = [(1, "".join(w + seps[k % 6] for k, w in enumerate(words))), (2, " ".join(words)), (3, None), (4, "\x0b"), (5, "a\x85b\xa0c")]
    table = pa.table({"doc_id": [d[0] for d in docs], "text": pa.array([d[1] for d in docs], pa.string())})
    con = duckdb.connect()
    con.register("documents", table)
    want = {r[0]: r[1:] for r in con.execute(recompress.SQL).fetchall()}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in without_repeats(documents(spark, docs)).collect()}
    assert got == want and got[2][1] == 45


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_rules_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = [*ODD, *[t for _, t in corpus(4)], "a#b * c\nsame line\nsame line\n\n same line\n", "\x0b\x0c a\rb"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(90))) for _ in range(30)]
    got = {r.doc_id: r for r in host_rules(documents(spark, texts).withColumns({"host": F.lit(1), "w": F.lit(2), "soft": F.lit(3)})).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_bad_hosts_are_held_to_more(spark):
    fine = " ".join(f"word{k}" for k in range(80))
    marked = fine + " ***" * 4
    rows = [(k, marked, "en", "bad", 0) for k in range(40)] + [(100 + k, fine, "en", "good", 0) for k in range(200)] + [(500, marked, "en", "good", 0), (501, fine, "en", "bad", 0), (502, marked, "en", None, 0)]
    got = {r.doc_id: r for r in host_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].host_bad and not got[0].kept and got[501].kept
    assert not got[500].host_bad and got[500].kept and got[100].kept
    assert 0 < got[500].host_rate < 0.1 and got[502].host_rate is not None
    assert host_rules(spark.createDataFrame([], SCHEMA)).count() == 0
