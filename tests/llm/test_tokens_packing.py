import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.helpers import ODD, SCHEMA, documents
from tracewarden.llm.packing import pack, packed, sizes_for
from tracewarden.llm.queries import tokenizer_path
from tracewarden.llm.tokens import token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def fuzzed(n, seed=3):
    rnd = random.Random(seed)
    pool = "abc  '  's'll 're\n\t 　é中国1234½²Ⅷ_#🙂\x00stmdrvle'<|endoftext|>\\ŕ"
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_counts_equal_the_library(spark, library):
    texts = ODD + fuzzed(2000)
    got = {r.doc_id: r for r in token_counts(documents(spark, texts), tokenizer_path(), limit=20).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 20), t


def test_counts_of_repeated_null_and_no_rows(spark):
    rows = [(7, "a b"), (7, "a b"), (None, "c")]
    got = sorted(token_counts(documents(spark, rows), tokenizer_path()).collect(), key=str)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(7, 2), (7, 2), (None, 1)]
    assert token_counts(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_packing_is_a_partition_of_the_ids_without_padding(spark, library):
    texts = ODD + fuzzed(300) + ["many words " * 2000]
    rows = packed(documents(spark, texts), tokenizer_path(), size=256, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.token_ids) and len(r.token_ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[k], key=lambda r: r.start)
        assert b"".join(r.token_ids for r in mine) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:j]) for j in range(len(mine))]
        assert {r.doc_tokens for r in mine} == {len(ids)}
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:j]) for j in range(len(s))]
        fill = sum(r.length for r in s)
        assert fill <= 256 and fill & (fill - 1) == 0


def test_packing_cuts_a_document_only_to_fill_a_sequence():
    rnd = random.Random(5)
    lengths = [rnd.randrange(1, 3000) for _ in range(2000)]
    rows = pack(lengths, 2048)
    got = defaultdict(int)
    for d, _, n, _, _ in rows:
        got[d] += n
    assert [got[d] for d in range(len(lengths))] == lengths
    assert len(rows) <= len(lengths) + len({r[3] for r in rows})  # each cut fills a sequence


def brute_pack(lengths, size):
    """Pieces (document, start, length, sequence, offset) by looking at every open sequence."""
    out, left, sequence = [], [], 0
    for d, n in enumerate(lengths):
        out += [(d, k * size, size, sequence + k, 0) for k in range(n // size)]
        sequence += n // size
        if n % size:
            left.append((n % size, d, n - n % size))
    capacity = sizes_for(sum(x[0] for x in left), size)
    used, cost = [0] * len(capacity), [0.0] * len(capacity)
    for n, d, start in sorted(left, key=lambda x: (-x[0], x[1])):
        while n:
            fit = [k for k in range(len(capacity)) if capacity[k] - used[k] >= n] or [k for k in range(len(capacity)) if capacity[k] > used[k]]
            k = min(fit, key=lambda k: (cost[k], k))
            m = min(n, capacity[k] - used[k])
            out.append((d, start, m, sequence + k, used[k]))
            used[k] += m
            cost[k] += m + m * m / 4096
            n, start = n - m, start + m
    return out


def test_packing_takes_the_sequence_of_lowest_cost_that_has_room():
    rnd = random.Random(9)
    for size, n in ((64, 300), (2048, 700), (100, 40), (1, 5)):
        for mu in (1, 4, 5.5):
            lengths = [max(1, int(rnd.lognormvariate(mu, 1))) for _ in range(n)]
            assert pack(lengths, size) == brute_pack(lengths, size)


def test_packing_of_repeated_null_and_no_rows(spark):
    rows = packed(documents(spark, [(1, "a"), (1, "a"), (None, None)]), tokenizer_path()).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens == {1: 4, None: 1} and {(r.doc_id, r.doc_tokens) for r in rows} == {(1, 2), (None, 1)}
    assert packed(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
