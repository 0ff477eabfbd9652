"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The cost of a piece of n tokens is linear * n + quadratic * n * n (matrix products and attention). Documents are packed in
groups of neighbouring rows, about GROUP_TOKENS tokens each, so no rows move between tasks and memory is bounded by a group.
Within a group whole sequences are cut off documents that are longer; what is left goes, in descending order, to the sequence
of lowest cost that has room for all of it, found exactly; only if no open sequence has it, the document is cut. A group of t tokens
gets t // size full sequences, and for the rest sequences whose sizes are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import as_bytes, narrow, schema
from .tokens import byte_alphabet

#: Tokens of a group, a bound on memory; a longer document is a group of its own.
GROUP_TOKENS = 2_000_000
#: Stands for no sequence, beyond the cost of any.
FULL = (float("inf"), -1)

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary file of a byte-level BPE, with ids in merge order, in the faster of the two libraries; ids are the same."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): k for t, k in model["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def sizes_for(total: int, size: int) -> list[int]:
    """Capacities that add up to total: full sequences, then powers of two."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Open:
    """Open sequences by their room: a heap of (cost, sequence) for each size of room, under a tree of the least heads."""

    def __init__(self, size: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.leaves = 1 << size.bit_length()
        self.least = [FULL] * (2 * self.leaves)  # of node k: that of nodes 2k and 2k + 1; room r is leaf leaves + r

    def _update(self, room: int) -> None:
        at = self.leaves + room
        self.least[at] = self.heaps[room][0] if self.heaps[room] else FULL
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def push(self, cost: float, k: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, k))
        self._update(room)

    def pop(self, room: int) -> tuple[float, int, int] | None:
        """Takes the sequence of lowest cost with so much room or more: cost, number and room; None if no sequence has it."""
        at = self.leaves + room
        best = at
        while at > 1:
            if not at & 1 and self.least[at + 1] < self.least[best]:
                best = at + 1
            at >>= 1
        if self.least[best] == FULL:
            return None
        while best < self.leaves:
            best = 2 * best if self.least[2 * best] == self.least[best] else 2 * best + 1
        own = best - self.leaves
        cost, k = heapq.heappop(self.heaps[own])
        self._update(own)
        return cost, k, own


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; lengths are over 0."""
    out, left, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // size):
            out.append((d, k * size, size, sequence, 0))
            sequence += 1
        if n % size:
            left.append((n % size, d, n - n % size))
    capacity = sizes_for(sum(x[0] for x in left), size)
    cost = lambda n: linear * n + quadratic * n * n
    open_ = Open(size)
    for k, room in enumerate(capacity):
        open_.push(0.0, k, room)
    for n, d, start in sorted(left, key=lambda x: (-x[0], x[1])):
        while n:
            c, k, room = open_.pop(n) or open_.pop(1)  # without room for all of it: cut, to fill the one of lowest cost
            m = min(n, room)
            out.append((d, start, m, sequence + k, capacity[k] - room))
            n, start = n - m, start + m
            if m < room:
                open_.push(c + cost(m), k, room - m)
    return out


def packed(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also token_ids (little-endian unsigned 32 bit).

    Each document's ids end with end_id. A null text is empty and gives one piece with end_id alone; rows that repeat are packed
    as often as they occur, with their own pieces; an empty table gives no piece. sequence_id: the partition in the upper bits.
    """
    fields = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
    out = schema(**fields, **({"token_ids": "binary"} if keep_ids else {}))

    def groups(batches) -> Iterator[tuple[list, list[np.ndarray]]]:
        enc, ids, docs, held = encoder(tokenizer), [], [], 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                one = np.concatenate([enc.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all").astype("<u4"), end])
                docs.append(doc)
                ids.append(one)
                held += len(one)
                if held >= GROUP_TOKENS:
                    yield docs, ids
                    ids, docs, held = [], [], 0
        if docs:
            yield docs, ids

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        for docs, ids in groups(batches):
            rows = pack([len(x) for x in ids], size)
            parts = [ids[d][a : a + n].tobytes() for d, a, n, _, _ in rows]
            columns = [
                pa.array([docs[r[0]] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array([len(ids[r[0]]) for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ]
            base += max(r[3] for r in rows) + 1
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if keep_ids else []), names=out.names)

    return narrow(df, doc_id=id_col, text=text_col).mapInArrow(run, out)
