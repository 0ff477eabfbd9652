"""Language-model scores by context-tree weighting, beside those of a word unigram model.

Texts are normalised to their words (A-Z lower-cased) joined by spaces. The model counts bytes after contexts of depth bytes in the training texts, weighs all depths (ctw.py) and scores each text's bytes and its end.
No task ever holds the model, which grows with the corpus:

1. rows are packed into chunks of CHUNK_BYTES; for each chunk the distinct grams and words with their training counts are sorted and dealt into buckets; chunk and buckets
   are written to the shared folder, so texts are read once;
2. buckets meet: all grams with the same last two context bytes share one, which so has whole subtrees from depth two on. Sums for the nodes above (65,535 at most) meet in one task and go back to every bucket;
3. each bucket answers every chunk: the code length of each of the chunk's grams and the count of each of its words, as plain arrays in the chunk's own order;
4. chunks meet their answers and score their texts.

What moves are distinct grams and words of a chunk, not positions. Hot words or contexts cost a row's entry per chunk, however often they occur.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, narrow, schema, shared_path
from .ctw import Level, Weights, grams, levels, log2_chances, parents, runs, summed

DEPTH = 6
CHUNK_BYTES, BLOCK_BYTES = 10 << 20, 1 << 20
#: Buckets: eight for each chunk's worth of text, within these.
LEAST_BUCKETS, MOST_BUCKETS = 32, 4096
#: The row in the sums of step 2 that holds the number of distinct training words, of training words, and of training texts.
TOTALS = -1


def held_out(doc_id: int | None) -> bool:
    """A fifth of the ids, by CRC-32; a null id counts as an empty string, which is not held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Compressed planes of bytes; delta: of a sorted array's differences."""
    import zstandard

    x = np.ascontiguousarray(x)
    if delta:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def _unpack(data: bytes, kind: str, delta: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    x = raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
    return np.cumsum(x, dtype=x.dtype) if delta else x


def bucket_of(distinct: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    pair = (distinct >> np.uint64(8 * (depth - 1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((pair >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Chunk:
    """The distinct grams and words of some normalised texts with their training counts, in the order in which buckets answer."""

    def __init__(self, ids: list[int | None], texts: list[bytes], depth: int, buckets: int):
        import xxhash

        self.texts, self.depth, self.buckets = texts, depth, buckets
        self.held = [held_out(i) for i in ids]
        # Grams of training texts from the front, of the others behind them; both are sorted in place.
        sizes = [len(t) + 1 for t in texts]
        every = np.empty(sum(sizes), dtype=np.uint64)
        at = [0, sum(n for n, h in zip(sizes, self.held) if not h)]
        middle = at[1]
        for t, n, h in zip(texts, sizes, self.held):
            every[at[h] : at[h] + n] = grams(t, depth)
            at[h] += n
        every[:middle].sort()
        every[middle:].sort()
        begin = runs(every[:middle])
        trained, counts = every[begin], np.diff(np.append(begin, middle))
        other = every[middle:][runs(every[middle:])]
        del every
        self.distinct = np.concatenate([trained, other])
        self.distinct.sort()
        self.distinct = self.distinct[runs(self.distinct)]
        all_counts = np.zeros(len(self.distinct), dtype=np.int64)
        all_counts[np.searchsorted(self.distinct, trained)] = counts
        seen, rest = Counter(), {}
        for h, t in zip(self.held, texts):
            if t:
                rest.update(dict.fromkeys(t.split(b" "))) if h else seen.update(t.split(b" "))
        for w in rest:
            if w not in seen:
                seen[w] = 0
        bucket = bucket_of(self.distinct, depth, buckets)
        self.by = np.argsort(bucket, kind="stable")
        self.grams, self.gram_counts = self.distinct[self.by], all_counts[self.by]
        self.gram_cut = np.searchsorted(bucket[self.by], np.arange(buckets + 1))
        words = list(seen)
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        self.word_list = [words[k] for k in order.tolist()]
        self.word_counts = np.fromiter(seen.values(), dtype=np.int64, count=len(words))[order]
        self.word_cut = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def blocks(self) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """Ranges of texts and their grams, about BLOCK_BYTES at a time."""
        begin = size = 0
        for k, t in enumerate(self.texts):
            size += len(t) + 1
            if size >= BLOCK_BYTES or k == len(self.texts) - 1:
                yield (begin, k + 1), np.concatenate([grams(x, self.depth) for x in self.texts[begin : k + 1]])
                begin, size = k + 1, 0

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """The sums over the texts' grams. bits: a value for each of self.grams."""
        value = np.empty(len(bits))
        value[self.by] = bits
        out = []
        for (a, b), block in self.blocks():
            order = np.argsort(block)
            block = block[order]
            begin = runs(block)
            own = np.repeat(value[np.searchsorted(self.distinct, block[begin])], np.diff(np.append(begin, len(block))))
            back = np.empty(len(block))
            back[order] = own
            size = np.fromiter((len(t) + 1 for t in self.texts[a:b]), dtype=np.int64, count=b - a)
            out.append(np.add.reduceat(back, np.cumsum(size) - size))
        return np.concatenate(out)

    def requests(self) -> Iterator[dict]:
        for b in range(self.buckets):
            g, w = slice(*self.gram_cut[b : b + 2]), slice(*self.word_cut[b : b + 2])
            if g.start < g.stop or w.start < w.stop:
                yield {"bucket": b, "grams": _pack(self.grams[g], True), "gram_counts": _pack(self.gram_counts[g].astype("<u4")), "words": b" ".join(self.word_list[w]), "word_counts": _pack(self.word_counts[w].astype("<u4"))}


def _chunk_rows(depth: int, buckets: int):
    """A row per chunk: its number, its rows (compressed), its requests by bucket, and its training texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row():
            chunk = Chunk(ids, texts, depth, buckets)
            sink = pa.BufferOutputStream()
            table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            rows = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            kind = pa.list_(pa.struct([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("grams", "gram_counts", "words", "word_counts")]]))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.binary()), pa.array([list(chunk.requests())], kind), pa.array([len(ids) - sum(chunk.held)], pa.int64())], names=["chunk", "rows", "requests", "train_texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                texts.append(b" ".join(text.lower().split()))
                ids.append(doc_id)
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    return run


def _words(data: bytes, n: int) -> list[bytes]:
    return data.split(b" ") if n else []


def _met(table) -> tuple[np.ndarray, np.ndarray, Counter]:
    """The distinct grams of a bucket with their counts over all chunks, and its words."""
    keys, counts, words, held = [], [], Counter(), 0
    for g, c, w, n in zip(*(table.column(x) for x in ("grams", "gram_counts", "words", "word_counts"))):
        keys.append(_unpack(g.as_py(), "<u8", True))
        counts.append(_unpack(c.as_py(), "<u4").astype(np.int64))
        numbers = _unpack(n.as_py(), "<u4").tolist()
        for x, k in zip(_words(w.as_py(), len(numbers)), numbers):
            words[x] += k
        held += len(keys[-1])
        if held > 4_000_000:  # merge as they come, so that memory follows the distinct grams
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [c], 0
    k, c = summed(np.concatenate(keys), np.concatenate(counts))
    return k, c, words


_SUMS = schema(node="long", mixture="double", zeros="double", ones="double")


def _upper_sums(depth: int):
    def run(table):
        import pyarrow as pa

        keys, counts, words = _met(table)
        trained = counts > 0
        rows = [np.zeros(0, dtype=np.uint64), *[np.zeros(0)] * 3]
        if trained.any():
            rows = parents(levels(keys[trained], counts[trained], depth, 2)[0])
        known = [k for k in words.values() if k]
        return pa.table([pa.array(np.append(rows[0].astype(np.int64), TOTALS)), pa.array(np.append(rows[1], float(len(known)))), pa.array(np.append(rows[2], float(sum(known)))), pa.array(np.append(rows[3], 0.0))], names=_SUMS.names)

    return run


def _upper(batches):
    """The weights of depths 0 and 1, and the totals, in one row. Gets the sums by node, 65,535 rows at most."""
    import pyarrow as pa

    columns = [np.concatenate([np.asarray(c) for c in x]) for x in zip(*(b.columns for b in batches if b.num_rows))]
    if not columns:
        return
    order = np.argsort(columns[0])
    node, mixture, zeros, ones = (c[order] for c in columns)
    weights = []
    if len(node) > 1:
        one = Level.of_counts(node[1:].astype(np.uint64), zeros[1:], ones[1:])
        one.weigh(mixture[1:])
        keys, children, z, o = parents(one)
        root = Level.of_counts(keys, z, o)
        root.weigh(children)
        weights = [Weights.of(root), Weights.of(one)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights, mixture[0], zeros[0]))], pa.binary())], names=["upper"])


_ANSWER = schema(chunk="long", bucket="int", bits="binary", counts="binary", totals="binary")


def _answers(depth: int):
    def run(table, upper):
        import pyarrow as pa

        columns = [pa.array([], kind) for kind in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
        if table.num_rows:
            weights, *totals = pickle.loads(upper.column("upper")[0].as_py())
            keys, counts, words = _met(table)
            trained = counts > 0
            if trained.any():
                weights = weights + [Weights.of(x) for x in levels(keys[trained], counts[trained], depth, 2)]
            bits = log2_chances(keys, depth, weights).astype("<f4")
            out_bits, out_words = [], []
            for g, w, n in zip(*(table.column(x) for x in ("grams", "words", "word_counts"))):
                out_bits.append(_pack(bits[np.searchsorted(keys, _unpack(g.as_py(), "<u8", True))]))
                some = _words(w.as_py(), len(_unpack(n.as_py(), "<u4")))
                out_words.append(_pack(np.fromiter((words[x] for x in some), dtype="<i8", count=len(some))))
            columns = [table.column("chunk"), table.column("bucket"), pa.array(out_bits, pa.binary()), pa.array(out_words, pa.binary()), pa.array([np.array(totals, dtype="<f8").tobytes()] * len(out_bits), pa.binary())]
        return pa.table(columns, names=_ANSWER.names)

    return run


_RESULT = schema(doc_id="long", held_out="boolean", n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double", n_bytes="long")


def _score(depth: int, buckets: int, ends: float):
    def run(rows, answers):
        import pyarrow as pa
        import zstandard

        ids, out = [], []
        distinct, tokens = np.frombuffer(answers.column("totals")[0].as_py(), dtype="<f8")
        distinct, tokens = distinct + (ends > 0), tokens + ends
        norm = math.log10(tokens + 0.5 * (distinct + 1))
        answers = answers.sort_by("bucket")
        bits = np.concatenate([_unpack(x.as_py(), "<f4") for x in answers.column("bits")]).astype(float)
        counts = np.concatenate([_unpack(x.as_py(), "<i8") for x in answers.column("counts")])
        for data in rows.column("rows"):
            table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data.as_py())).read_all()
            c = Chunk(table.column("id").to_pylist(), table.column("text").to_pylist(), depth, buckets)
            scores = c.scores(bits) * math.log10(2)
            place = {w: k for k, w in enumerate(c.word_list)}
            logs = np.log10(counts + 0.5) - norm
            end = math.log10(ends + 0.5) - norm
            for k, text in enumerate(c.texts):
                words = text.split(b" ") if text else []
                at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
                out.append((c.held[k], len(words) + 1, int((counts[at] > 0).sum()) + int(ends > 0), int(tokens), float(logs[at].sum()) + end, float(scores[k]), len(text)))
            ids += table.column("id").to_pylist()
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(ids, pa.int64()), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names=_RESULT.names)

    return run


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the chance of the text, end included), n_bytes (of the normalised text).

    Both models learn from rows that are not held out (see held_out). A null text is empty: one token, its end. Rows that repeat count and are scored as often as they
    occur; a null id belongs to training; an empty table gives none. If all rows are held out, bytes are equally likely. depth: 3 to 7.
    """
    spark = df.sparkSession
    docs = narrow(df, doc_id=id_col, text=text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(8 * total / CHUNK_BYTES)))
    item = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("grams", "gram_counts", "words", "word_counts")]])
    kind = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("requests", T.ArrayType(item)), T.StructField("train_texts", T.LongType())])
    path = shared_path(spark, "chunks")
    docs.mapInArrow(_chunk_rows(depth, buckets), kind).write.parquet(path)
    chunks = spark.read.schema(kind).parquet(path)
    asked = chunks.select("chunk", F.explode("requests").alias("r")).select("chunk", "r.*")

    sums = asked.groupBy("bucket").applyInArrow(_upper_sums(depth), _SUMS).groupBy("node").agg(*[F.sum(x).alias(x) for x in ("mixture", "zeros", "ones")])
    upper = sums.coalesce(1).mapInArrow(_upper, schema(upper="binary")).select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "upper")
    ends = float(chunks.agg(F.sum("train_texts")).first()[0] or 0)
    # Both uses of asked read one exchange.
    answers = asked.groupBy("bucket").cogroup(upper.groupBy("bucket")).applyInArrow(_answers(depth), _ANSWER)
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(depth, buckets, ends), _RESULT)
