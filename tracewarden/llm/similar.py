"""All pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, as links that connect what they connect.

Sets of a and b elements that are so alike share at least 0.8 * max(a, b). So if the elements of each are put in one order, the same for all sets, the first a - 0.8 a + 1 of one
and the first b - 0.8 b + 1 of the other have one in common (prefix filter), and no pair is lost whatever the order is. The order here is by counts in a sample of the texts, then by hash, so that
what many texts hold comes last. Sets that share such an element and whose sizes are near enough are a group; groups of the same members are one. Parities of the
elements by hash classes, at least as many as there are elements, differ in no more classes than the sets differ in elements, which leaves few members of a group to be compared (bitmap filter, exact as well).
Sets that are left in several groups are compared once: groups that share members make up one place, to which each text goes once; places of more than MOST elements stay in their groups.
There sets are compared by all their elements, from node to node, and only the links of a spanning forest are given, never all pairs. Texts without a place stay where they are, but for those that pass
a filter of FILTER bits by chance.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, schema, write_shared
from .components import components
from .recompress import _by_run, _runs, mix

#: Texts whose elements are counted for the order.
SAMPLE = 8_000
#: Bits of the smallest bitmap; others have as many as their set has elements, rounded up to a power of two.
BITMAP = 64
#: Elements of the sets of one place; more are compared group by group.
MOST = 4_000_000
#: Bits of the filter that keeps texts without a place from being sent.
FILTER = 1 << 23


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The XXH64 values of the shingles of one word or more, joined by spaces; fewer words than a shingle has are one shingle."""
    import xxhash

    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    begins, n = (ends - size)[: len(words) - shingle + 1].tolist(), len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist())), dtype="<u8", count=n)


def elements(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The set of a text's shingles, ascending: A-Z lower-cased, words between ASCII white space; empty without a word."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, shingle, seed)) if words else np.zeros(0, dtype="<u8")


def bitmap(some: np.ndarray) -> bytes:
    """The parities of the elements in each hash class; one half over the other (XOR) is the bitmap of half as many classes."""
    n = max(BITMAP, 1 << (len(some) - 1).bit_length())
    return np.packbits(np.bincount((some & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def forest(n: int, near) -> list[tuple[int, int]]:
    """Links that connect what is connected: one for each of n that is reached from another. near(x, rest): which of the rest are near x."""
    rest, out = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            found = rest[hit].tolist()
            out += [(x, y) for y in found]
            queue += found
            rest = rest[~hit]
    return out


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The forest of sets of similarity 0.8 or more: common / (size + other - common) >= 4 / 5, in whole numbers."""
    size = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])

    def near(x, rest):
        mark = np.zeros(len(values), dtype=bool)
        mark[own[x]] = True
        return 9 * np.array([np.count_nonzero(mark[own[y]]) for y in rest]) >= 4 * (size[rest] + size[x])

    return forest(len(sets), near)


def maybe_alike(size: np.ndarray, bits) -> np.ndarray:
    """A number for each set, equal for all that chains of possibly alike sets connect. bits: their bitmaps as 64-bit words.

    Alike sets differ in a ninth of their sizes' sum at most, and the smaller has four fifths of the larger's size, so their bitmaps are of one width or of
    one and its double; of two widths the wider one is folded.
    """
    width = np.array([len(x) for x in bits])
    at, tables = {}, {}  # by width: the rows of the bitmaps of that width and of the folded ones of its double
    for w in set(width.tolist()):
        own, double = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at[w] = np.zeros(len(width), dtype=np.int64)
        at[w][own], at[w][double] = np.arange(len(own)), len(own) + np.arange(len(double))
        tables[w] = np.stack([*(bits[k] for k in own), *(bits[k][:w] ^ bits[k][w:] for k in double)])

    def near(x, rest):
        out = (5 * size[rest] >= 4 * size[x]) & (5 * size[x] >= 4 * size[rest])
        for w in set(width[rest[out]].tolist()):
            some = np.flatnonzero(out & (width[rest] == w))
            other, common = rest[some], min(w, int(width[x]))
            differ = np.bitwise_count(tables[common][at[common][other]] ^ tables[common][at[common][x]]).sum(axis=1, dtype=np.int64)
            out[some] = 9 * differ <= size[other] + size[x]
        return out

    number = np.arange(len(size))
    for x, y in forest(len(size), near):  # x is reached before y
        number[y] = number[x]
    return number


def _elements(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [np.zeros(0, dtype="<u8"), *(elements(t, shingle, seed) for t in as_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])

    return run


def _frequent(texts: DataFrame, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements that several texts of the sample have (ascending), and in how many of them they are."""
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(math.ceil(max(1, texts.count()) / SAMPLE))) == 0)
    rows = some.select("text").mapInArrow(_elements(shingle, seed), schema(key="long")).groupBy("key").agg(F.count("*").alias("n")).where("n > 2").toArrow()
    key, count = np.asarray(rows.column(0)).astype(np.int64).view(np.uint64), np.asarray(rows.column(1)).astype(np.int64)
    order = np.argsort(key)
    return key[order], count[order]


_KEYS = schema(key="long", size="int", node="long")


def _prefixes(frequent, shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        keys, counts = frequent.value
        for batch in batches:
            sets = [elements(t, shingle, seed) for t in as_bytes(batch.column(1))]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            if not size.sum():
                continue
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            often = np.zeros(len(flat), dtype=np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                often = np.where(keys[at] == flat, counts[at], 0)
            order = np.lexsort((flat, often, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            taken = order[place < np.repeat(size - (4 * size + 4) // 5 + 1, size)]
            node = np.asarray(batch.column(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[taken].view(np.int64)), pa.array(size[row[taken]].astype(np.int32)), pa.array(node[row[taken]])], names=_KEYS.names)

    return run


_MEMBERS = schema(group="long", node="long", size="int")


def _groups(batches):
    """Over rows sorted by key, size and node: the groups of two or more, cut where the next size is too large to be alike. Copies count once."""
    for key, size, node in _by_run(batches, 1):
        one, _ = _runs(key, size, node)
        key, size, node = key[one], size[one].astype(np.int64), node[one]
        cut = np.zeros(len(key), dtype=np.int64)
        cut[1:] = (key[1:] == key[:-1]) & (5 * size[:-1] < 4 * size[1:])
        begin, many = _runs(key, np.cumsum(cut))
        yield _members(node, size, begin, many)


def _members(node: np.ndarray, size: np.ndarray, begin: np.ndarray, many: np.ndarray):
    """(group, node, size) of the runs of two nodes or more; runs of the same nodes have the same name, and each name comes once."""
    import pyarrow as pa

    name = mix(np.add.reduceat(mix(node.view(np.uint64)), begin) + many.astype(np.uint64))
    first = np.zeros(len(begin), dtype=bool)
    first[np.unique(name, return_index=True)[1]] = True
    out = np.repeat(first & (many > 1), many)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, many)[out].view(np.int64)), pa.array(node[out]), pa.array(size[out].astype(np.int32))], names=_MEMBERS.names)


_BITS = schema(node="long", bits="binary")


def _bitmaps(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(elements(t, shingle, seed)) for t in as_bytes(batch.column(1))], pa.binary())], names=_BITS.names)

    return run


def _divide(batches):
    """Over rows (group, node, size, bits) sorted by group: the parts of groups that may be alike."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
    for _, group in groupby(rows, key=itemgetter(0)):
        _, node, size, bits = zip(*group)
        node, size = np.array(node, dtype=np.int64), np.array(size, dtype=np.int64)
        number = maybe_alike(size, [np.frombuffer(x, dtype="<u8") for x in bits])
        order = np.lexsort((node, number))
        yield _members(node[order], size[order], *_runs(number[order]))


def places(members: DataFrame) -> DataFrame:
    """(place, node): nodes that groups connect have one place, so each node goes to one only; where that would hold more than MOST elements, the groups are the places."""
    least = members.groupBy("group").agg(F.min("node").alias("a"))
    whole = components(members.join(least, "group").select("a", F.col("node").alias("b")))
    nodes = members.groupBy("node").agg(F.max("size").alias("size")).join(whole, "node")
    nodes = nodes.join(nodes.groupBy("root").agg((F.sum("size") > MOST).alias("large")), "root")
    by_group = members.join(nodes.where("large").select("node"), "node", "left_semi").select(F.col("group").alias("place"), "node")
    return nodes.where("not large").select(F.col("root").alias("place"), "node").unionAll(by_group)


def _passing(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without most of the texts whose node is not among the nodes: those whose lowest bits no node has."""
    rows = nodes.select(F.col("node").bitwiseAND(F.lit(FILTER - 1)).cast("int").alias("at")).distinct().toArrow()
    bits = np.zeros(FILTER, dtype=bool)
    bits[np.asarray(rows.column(0)).astype(np.int64)] = True
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    where = texts.columns.index("node")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.asarray(batch.column(where)).astype(np.int64) & (FILTER - 1)
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.mapInArrow(run, texts.schema)


def _compare(shingle: int, seed: int):
    """Over rows (place, fp, text) sorted by place: links between fingerprints. Holds a place's sets at most."""

    def run(batches):
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))))
        for _, own in groupby(rows, key=itemgetter(0)):
            fp, sets = zip(*((f, elements(t, shingle, seed)) for _, f, t in own))
            found = [(fp[x], fp[y]) for x, y in alike(sets) if fp[x] != fp[y]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def links(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(a, b): links between fingerprints. texts: node (equal for the same words), fp, text, in a table that is read several times; a text without words is like no other."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, shingle, seed))
    keys = texts.select("node", "text").mapInArrow(_prefixes(frequent, shingle, seed), _KEYS).repartition("key").sortWithinPartitions("key", "size", "node")
    groups = write_shared(keys.mapInArrow(_groups, _MEMBERS).distinct(), "groups")
    bits = texts.select("node", "text").mapInArrow(_bitmaps(shingle, seed), _BITS).dropDuplicates(["node"])
    rows = groups.join(bits, "node").select("group", "node", "size", "bits").repartition("group").sortWithinPartitions("group")
    members = write_shared(rows.mapInArrow(_divide, _MEMBERS).distinct(), "members")
    placed = write_shared(places(members), "places")
    own = _passing(texts.select("node", "fp", "text"), placed).dropDuplicates(["node"])
    rows = placed.join(own, "node").select("place", "fp", "text").repartition("place").sortWithinPartitions("place")
    return write_shared(rows.mapInArrow(_compare(shingle, seed), schema(a="long", b="long")), "links")
