"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit set if it is set in over half the XXH64 values of its word shingles. Equal fingerprints
are one node, so copies are never paired. To find all pairs of distinct fingerprints that differ in at most tau bits, the 64 bits are split into m partitions,
bits that go together into the same one, with thresholds t_i of -1 or more that add up to tau - m + 1: any such pair
differs in at most t_i bits in some partition i. The partition count and the thresholds come from dynamic programming
over the estimated cost of signatures and candidates. Each fingerprint is indexed by its bits in each
partition and probes all signatures at distance up to t_i; candidates are verified on all 64 bits inside a streaming pass
over sorted buckets. A large bucket emits the links of a spanning forest only, never all pairs, and no link is lost to components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, narrow, schema, write_shared
from .components import components
from .similar import links, shingle_hashes

BITS = 64
#: Estimated microseconds for a signature (made, shuffled, sorted) and for a candidate (verified).
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.01
#: Buckets up to this size are compared in lockstep, larger ones by searching from node to node.
SMALL = 48
#: Buckets beyond this size are split by further partitions of the fingerprint before they are searched.
LARGE = 8192


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The fingerprint of a text in UTF-8: A-Z lower-cased, words between ASCII white space; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle, seed)
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed number) of each row."""
    out = schema(doc_id="long", fp="long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=out.names)

    return narrow(df, doc_id=id_col, text=text_col).mapInArrow(run, out)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints: partial sums by partition, added by Spark, 64 x 64 to the driver."""
    out = schema(cell="int", n="long")

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(np.asarray(batch.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.astype(np.int64).ravel())], names=out.names)

    both = np.zeros(BITS * BITS)
    for cell, n in fps.select("fp").mapInArrow(run, out).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[cell] = n
    return both.reshape(BITS, BITS)


def within(disagree: np.ndarray, most: int) -> float:
    """The chance that two fingerprints differ in at most so many of these bits, each differing with the given chance."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in disagree:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return float(chance.sum())


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal size (but for one bit), each grown from a seed by the bit that goes best with those it has."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: correlation[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def plan(both: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that take part, of least estimated cost."""
    share = np.diag(both) / max(n, 1)
    disagree = np.clip(2 * share * (1 - share), 1e-9, 0.5)
    spread = np.sqrt(np.clip(share * (1 - share), 1e-9, None))
    correlation = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, tau + 2):
        groups = grouped_bits(correlation, m)
        cost = [[0.0] + [n * (1 + (sum(comb(len(g), d) for d in range(t + 1)) if t else 0)) * SIGNATURE_COST + n * n / 2 * within(disagree[g], t) * CANDIDATE_COST for t in range(tau + 1)] for g in groups]
        # least[s]: of the partitions so far, the least cost with thresholds + 1 that add up to s
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
        for c in cost:
            least = [min(((least[s - x][0] + c[x], [*least[s - x][1], x - 1]) for x in range(s + 1)), key=lambda y: y[0]) for s in range(tau + 2)]
        if least[tau + 1][0] < best[0]:
            best = (least[tau + 1][0], [(g, t) for g, t in zip(groups, least[tau + 1][1]) if t >= 0])
    return best[1]


def _signatures(parts: list[tuple[list[int], int]]):
    """Maps fingerprints to (key, fp): key is the hash of partition and signature, with the lowest bit free of meaning."""
    flips = []
    for bits, t in parts:
        mask = sum(1 << b for b in bits)
        flips.append((mask, [0] + [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(bits, d)]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for k, (mask, some) in enumerate(flips):
                own = fp & np.uint64(mask)
                for at in range(0, len(some), 64):
                    sig = (own[:, None] ^ np.array(some[at : at + 64], dtype=np.uint64)[None, :]).ravel()
                    own_fp = np.repeat(fp, len(some[at : at + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), k, dtype=np.int32)), pa.array(sig.view(np.int64)), pa.array(own_fp.view(np.int64))], names=["part", "sig", "fp"])

    return run


def _sparse_links(fp: np.ndarray, run: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal number, run by run in lockstep."""
    a, b, k = [], [], 1
    while True:
        same = np.flatnonzero(run[k:] == run[:-k]) if k < len(run) else []
        if len(same) == 0:
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + k]) <= tau]
        a.append(fp[near])
        b.append(fp[near + k])
        k += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def forest(fp: np.ndarray, tau: int, level: int = 0) -> tuple[list, list]:
    """Links that connect what is connected among distinct fingerprints: one for each node that is reached from another."""
    if len(fp) > LARGE and level == 0:  # by the pigeonhole principle once more, on all bits
        a, b = [], []
        for bits in np.array_split(np.arange(BITS), tau + 1):
            mask = np.uint64(sum(1 << int(x) for x in bits))
            order = np.argsort(fp & mask, kind="stable")
            cut = np.flatnonzero(np.diff((fp & mask)[order])) + 1
            for group in np.split(order, cut):
                if len(group) > 1:
                    x, y = forest(fp[group], tau, 1)
                    a += x
                    b += y
        return a, b
    a, b, rest = [], [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= tau
            if near.any():
                got = rest[near].tolist()
                a += [int(x)] * len(got)
                b += got
                queue += [np.uint64(y) for y in got]
                rest = rest[~near]
    return a, b


def _verify(tau: int):
    """Over rows sorted by (part, sig): the links among fingerprints of a bucket. Holds a bucket's fingerprints at most."""

    def links(part, sig, fp):
        import pyarrow as pa

        new = np.ones(len(fp), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (sig[1:] != sig[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(fp)))
        number = np.repeat(np.arange(len(begin)), size)
        some = np.repeat((size > 1) & (size <= SMALL), size)
        a, b = _sparse_links(fp[some], number[some], tau)
        a, b = [a], [b]
        for at in np.flatnonzero(size > SMALL):
            x, y = forest(np.unique(fp[begin[at] : begin[at] + size[at]]), tau)
            a.append(np.array(x, dtype=np.uint64))
            b.append(np.array(y, dtype=np.uint64))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            part, sig, fp = (np.asarray(batch.column(k)) for k in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            if held:
                part, sig, fp = (np.concatenate(x) for x in zip(held, (part, sig, fp)))
            if not len(fp):
                continue
            last = np.flatnonzero((part != part[-1]) | (sig != sig[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(part[:cut], sig[:cut], fp[:cut])
            held = part[cut:], sig[cut:], fp[cut:]
        if held and len(held[2]):
            yield links(*held)

    return run


def link_fingerprints(fps: DataFrame, tau: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, no repeats) that differ in at most tau bits, enough of them for all components."""
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = plan(bit_counts(fps), n, tau)
    rows = fps.select("fp").mapInArrow(_signatures(parts), schema(part="int", sig="long", fp="long"))
    return rows.repartition("part", "sig").sortWithinPartitions("part", "sig", "fp").mapInArrow(_verify(tau), schema(a="long", b="long"))


def _roots(nodes: DataFrame, tau: int, more: DataFrame | None = None) -> DataFrame:
    """nodes (distinct fp, and more) with root: the least fp of all that links reach; more: further links (a, b)."""
    edges = link_fingerprints(nodes.select("fp"), tau)
    roots = components(edges.unionAll(more) if more is not None else edges).select(F.col("node").alias("fp"), "root")
    return write_shared(nodes.join(roots, "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, tau: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the least doc_id of all that links reach, itself included).

    A null text has no word and fingerprint zero, which links like any other. Rows that repeat are kept; a null id is kept, and counts for a component's
    least id only if no other is there (component_id is null then). An empty table gives no row. Fingerprints and labels stay distributed.
    """
    docs = write_shared(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    nodes = _roots(write_shared(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes"), tau)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = nodes.join(least, "root").select("fp", "component_id")
    return docs.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, tau: int = 4, alike: int | None = None) -> DataFrame:
    """One row of each component of near_duplicates(), with all columns of df: that of the least id; of rows that share it, one.

    alike: texts are linked too if their sets of shingles of so many words have a Jaccard similarity of 0.8 or more, all of them (see similar.py).
    A component whose ids are all null keeps one row. The rows are written once with their fingerprints and numbers, and shuffled once by number.
    """
    import xxhash

    fp, node, row = fresh(df, "fp"), fresh(df, "node"), fresh(df, "row")
    out = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType()), T.StructField(node, T.LongType())])
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(at))
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
            digests = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64)), pa.array(digests.view(np.int64))], names=out.names)

    docs = write_shared(df.mapInArrow(run, out).withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = docs.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(row).alias("c")).alias("first"))
    more = None
    if alike:
        more = links(narrow(docs, node=node, fp=fp, text=text_col), alike, seed)
    nodes = _roots(write_shared(own.groupBy("fp").agg(F.min("first").alias("first")), "nodes"), tau, more)
    kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.c").alias(row))
    return docs.join(kept, row, "left_semi").select(*[f"`{c}`" for c in df.columns])
