"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap of question and answer.

The index holds parts of items (PART words at most). BM25 weights are divided by the part's score for itself, so a score is the share of the part's weight
that a passage holds, and one threshold serves all parts. Parts are dealt into blocks, and each term has its largest weight in each block. Every document
is read as passages of 2 * PART words that begin every PART words, so that each run of PART words lies in one passage. For all passages of a document at once, sums of block maxima bound the scores from
above; a passage is scored only in blocks whose bound reaches the threshold, there term by term from the heaviest, until what is left cannot lift a part over it.
Candidates are then verified on the whole document: shares of five-word shingles of the question, and of the words of the answer beside any of their places.

The items are indexed in slices of SLICE items on average, one after another, so what is broadcast is bounded however large the benchmark is; documents are not shuffled. Term
weights are those of the whole benchmark, so scores do not depend on the slicing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, narrow, schema, write_shared

PART = 48
#: Items that are indexed and broadcast together, and blocks of parts in such an index.
SLICE, BLOCKS = 20_000, 32
K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Passages whose bounds are computed at a time.
STRETCH = 512
SHINGLE, QUESTION_OVERLAP, ANSWER_OVERLAP = 5, 0.8, 0.5

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARKS = b"!\"'()*,.:;?[]_`{}"


def terms(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation marks."""
    return text.translate(_LOWER, _MARKS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence or line, or without one the last fifth of the words (one at least); the question is what stands before."""
    pieces = [p for p in (terms(x.encode("utf-8", "replace")) for x in re.split(r"(?<=[.!?])\s+|\n+", text)) if p]
    if len(pieces) > 1:
        return [w for p in pieces[:-1] for w in p], pieces[-1]
    words = pieces[0] if pieces else []
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def most_beside(wanted: set[int], ids: np.ndarray, places: list[int], before: int, after: int) -> int:
    """The most distinct wanted words that stand within ids[place - before : place + after], over all places (in ascending order)."""
    at = np.flatnonzero(np.isin(ids, list(wanted)))
    words, around = ids[at].tolist(), np.array(places)
    held: Counter = Counter()
    most = lo = hi = 0
    for begin, end in zip(np.searchsorted(at, around - before).tolist(), np.searchsorted(at, around + after).tolist()):
        while hi < end:
            held[words[hi]] += 1
            hi += 1
        while lo < begin:
            held[words[lo]] -= 1
            if not held[words[lo]]:
                del held[words[lo]]
            lo += 1
        most = max(most, len(held))
    return most


def parts_of(text: str, part: int) -> tuple[list[bytes], list[bytes], list[Counter]]:
    """Question, answer, and the words of each part of an item."""
    question, answer = question_and_answer(text)
    words, parts = question + answer, []
    for k in range(0, len(words), part):
        piece = words[k : k + part]
        if k and len(piece) < part // 2:  # a short end goes with the words before it
            piece = words[-part:]
        parts.append(Counter(piece))
    return question, answer, parts


def term_counts(parts: list[Counter]) -> tuple[int, int, Counter]:
    """How many parts there are, their words together, and the parts that hold each term."""
    return len(parts), sum(sum(p.values()) for p in parts), Counter(t for p in parts for t in p)


class Index:
    """items: (item_id, text). Terms are numbered; ids without words are left out. counts: as of term_counts() for all parts of the benchmark, where items are a slice of it."""

    def __init__(self, items: list[tuple[int, str]], part: int = PART, threshold: float = THRESHOLD, counts: tuple[int, int, dict[bytes, int]] | None = None):
        self.part, self.threshold = part, threshold
        self.item_ids, self.items, parts, self.owner = [], [], [], []
        for item_id, text in items:
            question, answer, own = parts_of(text, part)
            if not own:
                continue
            parts += own
            self.owner += [len(self.items)] * len(own)
            self.item_ids.append(item_id)
            self.items.append((question, answer))
        self.number = {t: k for k, t in enumerate(sorted({t for p in parts for t in p}))}
        every, total_words, df = counts or term_counts(parts)
        n, mean = len(parts), total_words / max(1, every)
        idf = {t: math.log1p((every - df[t] + 0.5) / (df[t] + 0.5)) for t in self.number}
        self.blocks = max(1, min(BLOCKS, n))
        self.block_max = np.zeros((len(self.number) + 1, self.blocks), dtype=np.float32)  # the last row: other words
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(self.blocks)]
        for k, p in enumerate(parts):
            length = sum(p.values())
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in p.items()}
            total, b = sum(weight.values()), k % self.blocks
            for t, w in weight.items():
                i = self.number[t]
                w /= total
                self.postings[b].setdefault(i, []).append((k, w))
                self.block_max[i, b] = max(self.block_max[i, b], np.float32(w))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        other, get = len(self.number), self.number.get
        return np.fromiter((get(w, other) for w in words), dtype=np.int32, count=len(words))

    def passages(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(begin, block) of the passages whose bound in a block reaches the threshold."""
        n, step = len(ids), self.part
        begins = np.arange(0, max(1, n - step), step)
        known = np.flatnonzero(ids < len(self.number))
        if not len(known):
            return []
        lo, hi = np.searchsorted(known, begins), np.searchsorted(known, np.minimum(begins + 2 * step, n))
        out = []
        for a in range(0, len(begins), STRETCH):  # a long text is bounded stretch by stretch
            own = slice(a, a + STRETCH)
            first = lo[own][0]
            some = ids[known[first : hi[own][-1]]]
            sums = np.zeros((len(some) + 1, self.blocks), dtype=np.float32)
            np.cumsum(self.block_max[some], axis=0, out=sums[1:])
            # A first bound counts a term as often as it occurs; where that reaches the threshold, each term counts once.
            bound = sums[hi[own] - first] - sums[lo[own] - first]
            for k in a + np.flatnonzero((bound >= self.threshold - 1e-3).any(axis=1)):
                exact = self.block_max[np.unique(ids[known[lo[k] : hi[k]]])].sum(axis=0)
                out += [(int(begins[k]), int(b)) for b in np.flatnonzero(exact >= self.threshold - 1e-4)]
        return out

    def score(self, ids: np.ndarray, block: int) -> list[tuple[int, float]]:
        """(part, score) of the block's parts that reach the threshold."""
        unique = np.unique(ids)
        unique = unique[unique < len(self.number)]
        most = self.block_max[unique, block]
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0)
        found: dict[int, float] = {}
        postings = self.postings[block]
        for at, i in enumerate(unique[order].tolist()):
            fresh = left[at] >= self.threshold - 1e-4  # a part not seen so far could still get there
            if not fresh and not found:
                break
            for k, w in postings.get(i, ()):
                if k in found:
                    found[k] += w
                elif fresh:
                    found[k] = w
            if at % 8 == 7:
                found = {k: s for k, s in found.items() if s + left[at + 1] >= self.threshold - 1e-4}
        return [(k, s) for k, s in found.items() if s >= self.threshold - 1e-6]

    def shingles(self, item: int) -> set[tuple]:
        """The distinct shingles of an item's question; a shorter question is one shingle, an empty one none."""
        q = self.numbers(self.items[item][0]).tolist()
        size = min(SHINGLE, len(q))
        return {tuple(q[k : k + size]) for k in range(len(q) - size + 1)} if size else set()

    def verify(self, item: int, ids: np.ndarray, own: set[tuple], places: dict[tuple, list[int]]) -> tuple[float, float]:
        """The shares of the question's shingles in the document, and of the answer's words beside them: the largest over all places of the shingles."""
        question, answer = self.items[item]
        a = set(self.numbers(answer).tolist())
        if not own:
            return 1.0, len(a & set(ids.tolist())) / len(a)
        at = [places[s] for s in own if places[s]]
        if not at:
            return 0.0, 0.0
        reach = len(question) + 2 * len(answer) + SHINGLE
        every = sorted(k for some in at for k in some)
        most = most_beside(a, ids, every, reach, len(question) - min(SHINGLE, len(question)) + reach)
        # A question that is taken apart: the answer may also stand between the first places of its shingles.
        first = [some[0] for some in at]
        most = max(most, most_beside(a, ids, [min(first)], reach, max(first) - min(first) + reach))
        return len(at) / len(own), most / len(a)

    def search(self, text: bytes) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question_overlap, answer_overlap) of the items that a document holds."""
        words = terms(text)
        if not words or not self.items:
            return []
        ids = self.numbers(words)
        best: dict[int, float] = {}
        for begin, block in self.passages(ids):
            for k, s in self.score(ids[begin : begin + 2 * self.part], block):
                item = self.owner[k]
                best[item] = max(s, best.get(item, 0.0))
        if not best:
            return []
        line = ids.tolist()
        own = {item: self.shingles(item) for item in sorted(best)}
        places: dict[tuple, list[int]] = {s: [] for some in own.values() for s in some}
        for size in {len(s) for s in places}:
            for k in range(len(line) - size + 1):
                at = places.get(tuple(line[k : k + size]))
                if at is not None:
                    at.append(k)
        out = []
        for item in own:
            q, a = self.verify(item, ids, own[item], places)
            if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                out.append((self.item_ids[item], best[item], q, a))
        return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and item that it holds.

    Null or empty texts hold nothing, and null or empty items are held by nothing; items with equal texts are all reported. Rows that repeat are each reported; null ids come as null.
    Empty tables give none. The benchmark is read by the driver slice by slice; with more than one slice the documents are read for each, and its results are a table before the next begins.
    """
    out = schema(doc_id="long", item_id="long", score="double", question_overlap="double", answer_overlap="double")
    docs = narrow(df, doc_id=id_col, text=text_col)
    slices, indexes = _indexes(benchmark, item_col, item_text_col, slice_items)
    found = []
    for index in indexes:
        rows = docs.mapInArrow(_search(index, out.names), out)
        found.append(rows if slices == 1 else _ended(rows, index))
    return reduce(DataFrame.unionAll, found)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE) -> DataFrame:
    """The rows of df, with all their columns, whose text holds no item. As in contaminated(); nothing is shuffled."""
    slices, indexes = _indexes(benchmark, item_col, item_text_col, slice_items)
    for index in indexes:
        df = df.mapInArrow(_keep(index, df.columns.index(text_col)), df.schema)
        if slices > 1:
            df = _ended(df, index)
    return df


def _ended(rows: DataFrame, index) -> DataFrame:
    """rows as a table, and the slice's index released, so that only one is held at a time."""
    rows = write_shared(rows, "decontamination")
    index.unpersist()
    return rows


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, slice_items: int) -> tuple[int, Iterator]:
    """The number of slices, and one after another the broadcast indexes; a slice is a hash class of items, of slice_items on average."""
    spark = benchmark.sparkSession
    items = narrow(benchmark, item_id=item_col, text=text_col).where("text is not null")
    slices = max(1, math.ceil(items.count() / slice_items))
    if slices == 1:
        rows = sorted(((r.item_id, r.text) for r in items.collect()), key=str)
        return 1, iter([spark.sparkContext.broadcast(Index(rows))])
    # (slice, term, parts that hold it); with term null: (slice, null, parts, their words)
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    counts = items.select("slice", "text").mapInArrow(_counted, schema(slice="long", term="binary", parts="long", words="long"))
    counts = write_shared(counts.groupBy("slice", "term").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words")), "benchmark-terms")
    whole = counts.where("term is null").agg(F.sum("parts"), F.sum("words")).first()
    terms_ = write_shared(counts.where("term is not null").groupBy("term").agg(F.sum("parts").alias("parts")), "benchmark-counts")

    def each():
        for k in range(slices):
            rows = sorted(((r.item_id, r.text) for r in items.where(F.col("slice") == k).select("item_id", "text").collect()), key=str)
            own = terms_.join(counts.where((F.col("slice") == k) & F.col("term").isNotNull()).select("term"), "term").collect()
            yield spark.sparkContext.broadcast(Index(rows, counts=(whole[0] or 0, whole[1] or 0, {bytes(r.term): r.parts for r in own})))

    return slices, each()


def _counted(batches):
    import pyarrow as pa

    for batch in batches:
        held: dict[int, list[Counter]] = {}
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(k, []).extend(parts_of(text, PART)[2])
        rows = []
        for k, parts in held.items():
            n, words, df = term_counts(parts)
            rows += [(k, None, n, words), *((k, t, c, 0) for t, c in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["slice", "term", "parts", "words"])


def _search(index, names):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) for hit in index.value.search(text)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _keep(index, at):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([not index.value.search(text) for text in as_bytes(batch.column(at))], pa.bool_()))

    return run
