"""Removal of repeated substrings by recompression.

Level 0 names each word by a hash of its bytes, so names are equal everywhere without a dictionary. Each further level is a run round and a pair round:

* runs: of three or more equal neighbours the inner ones become one symbol, named by the symbol and their number. The first and the last one keep their names, so a run that a window's border cuts has the same
  symbols beyond its end as anywhere else;
* pairs: names fall into a left and a right half of the alphabet, drawn anew for each level; a left symbol followed by a right one becomes one, named by both.

With each symbol goes its extent, the words that its naming has looked at. Whatever stands around these words, they give this symbol at this place; so a substring that holds the extent holds the symbol wherever the substring occurs.

Round 1 (Spark): every inner window (INNER words) chooses, of the symbols whose extents lie in it, those of the highest level and of them the one with the least hash. Chosen symbols are dealt to tasks by name; those found once
drop out. A window that occurs twice has only inner windows whose symbols occur twice.
Round 2 (Spark): such windows get names of 96 bits. Of the windows of a name the first one stays; each other is linked to an earlier one, as in a tree with FAN children a node, so none has many links however common the window is.
Round 3 (Spark): links are gathered by the text of the earlier window and become stretches, whose words are sent to the text of the later one. There they are compared word by word, and only then removed: no word goes because hashes are equal. If
names ever stood for different words, NamesCollide would stop the job; another seed gives other names.

Within a batch of rows, names that occur more than once are settled before the shuffle (by comparing the words as well): one row per name and batch is sent, so a name that a third of all rows hold stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, narrow, schema, write_shared

WINDOW = 20
#: The words of an inner window, fewer by this than those of a window.
MARGIN = 4
#: Symbols of this level and above are chosen from together.
HIGH = 3
#: Links to one window.
FAN = 8
#: Texts whose symbols are named together have about so many bytes.
GROUP_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
#: Beyond all words of a group; differences of two such still fit.
_FAR = np.int32(1 << 29)


class NamesCollide(RuntimeError):
    """Different words have one name under this seed."""


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _ODD
    x = (x ^ (x >> _S29)) * _ODD_2
    return x ^ (x >> _S32)


def word_names(words: list[bytes], seed: int = 0) -> np.ndarray:
    """The names of words; each distinct word is hashed once."""
    import xxhash

    known = dict.fromkeys(words)
    digest = xxhash.xxh3_64_intdigest
    for w in known:
        known[w] = digest(w, seed)
    if len(set(known.values())) < len(known):
        raise NamesCollide(f"two words have the same name under seed {seed}")
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


class Symbols:
    """The symbols of one level, over the words of several texts in a row: names, the words they stand for (begin, end), extents (lo, hi) and texts."""

    def __init__(self, names: np.ndarray, text: np.ndarray):
        self.name, self.text = names, text
        self.begin = np.arange(len(names), dtype=np.int32)
        self.end = self.begin + 1
        self.lo, self.hi = self.begin.copy(), self.end.copy()
        self.new = np.ones(len(names), dtype=bool)

    def _keep(self, keep: np.ndarray) -> None:
        for x in ("name", "text", "begin", "end", "lo", "hi", "new"):
            setattr(self, x, getattr(self, x)[keep])

    def run_round(self) -> np.ndarray:
        """Merges the inner symbols of runs. Returns which symbols stand in a run that has to be known as a whole for them to be named: all but its ends where they face away from it."""
        same = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        held = np.zeros(len(self.name), dtype=bool)
        if not same.any():
            return held
        first = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(first, len(self.name)))
        low, high = np.minimum.reduceat(self.lo, first), np.maximum.reduceat(self.hi, first)
        some = size > 1
        first, size, low, high = first[some], size[some], low[some], high[some]
        last = first + size - 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(self.name) - 1)
        low = np.where((first > 0) & (self.text[before] == self.text[first]), np.minimum(low, self.lo[before]), -_FAR)
        high = np.where((last + 1 < len(self.name)) & (self.text[after] == self.text[last]), np.maximum(high, self.hi[after]), _FAR)
        self.run = {"lo": np.full(len(self.name), _FAR), "hi": np.full(len(self.name), -_FAR)}
        inside = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        held[inside] = True
        self.run["lo"][inside], self.run["hi"][inside] = np.repeat(low, size), np.repeat(high, size)
        long = size > 2
        at, end, count = first[long] + 1, last[long] - 1, (size[long] - 2).astype(np.uint64)
        self.name[at] = mix(mix(self.name[at] * _ODD_2 + count) + _ODD)
        self.end[at] = self.end[end]
        self.new[at] = True
        self.lo[at], self.hi[at] = low[long], high[long]
        keep = np.ones(len(self.name), dtype=bool)
        gone = np.repeat(at + 1, size[long] - 3) + np.arange((size[long] - 3).sum()) - np.repeat(np.cumsum(size[long] - 3) - (size[long] - 3), size[long] - 3)
        keep[gone] = False
        self._keep(keep)
        self.run = {k: v[keep] for k, v in self.run.items()}
        return held[keep]

    def pair_round(self, level: int, held: np.ndarray, run_before: np.ndarray, run_after: np.ndarray) -> None:
        """held: in a run; run_before, run_after: the neighbour on that side is of the same run."""
        n = len(self.name)
        right = (mix(self.name + mix(np.full(1, level, dtype=np.uint64))) & np.uint64(1)).astype(bool)
        near = self.text[1:] == self.text[:-1]
        pair = ~right[:-1] & right[1:] & near
        # A left symbol has looked at the next one, a right symbol at the one before; within a run that means all of the run.
        lo, hi = self.lo.copy(), self.hi.copy()
        low, high = np.minimum(self.lo[:-1], self.lo[1:]), np.maximum(self.hi[:-1], self.hi[1:])
        low[~near], high[~near] = -_FAR, _FAR
        lo[:-1], hi[:-1] = np.where(right[:-1], lo[:-1], low), np.where(right[:-1], hi[:-1], high)
        lo[1:], hi[1:] = np.where(right[1:], low, lo[1:]), np.where(right[1:], high, hi[1:])
        if right[0]:
            lo[0] = -_FAR
        if not right[-1]:
            hi[-1] = _FAR
        whole = held & np.where(right, run_before, run_after)
        if whole.any():
            lo[whole], hi[whole] = np.minimum(lo[whole], self.run["lo"][whole]), np.maximum(hi[whole], self.run["hi"][whole])
        at = np.flatnonzero(pair)
        name = self.name.copy()
        name[at] = mix(mix(self.name[at]) * _ODD + self.name[at + 1])
        self.end[at] = self.end[at + 1]
        lo[at], hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        self.name, self.lo, self.hi = name, lo, hi
        self.new = self.new.copy()
        self.new[at] = True
        keep = np.ones(n, dtype=bool)
        keep[at + 1] = False
        self._keep(keep)


def levels(names: np.ndarray, text: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, lo, hi, begin, end) of the symbols that are new in each level and have extents of at most so many words, until there are none."""
    s, out, level = Symbols(names.copy(), text), [], 0
    while True:
        fits = s.hi - s.lo <= most
        use = s.new & fits
        out.append((s.name[use], s.lo[use], s.hi[use], s.begin[use], s.end[use]))
        if not fits.any() or len(s.name) < 2:
            return out
        s.new = np.zeros(len(s.name), dtype=bool)
        level += 1
        held = s.run_round()
        runs = np.zeros(len(s.name), dtype=bool), np.zeros(len(s.name), dtype=bool)
        if held.any():
            same = held[1:] & held[:-1] & (s.text[1:] == s.text[:-1]) & (s.run["lo"][1:] == s.run["lo"][:-1]) & (s.run["hi"][1:] == s.run["hi"][:-1])
            own = s.new  # the merged inner symbols, whose neighbours are the ends of their run
            equal = s.name[1:] == s.name[:-1]
            joined = same & (equal | own[1:] | own[:-1])
            runs[0][1:], runs[1][:-1] = joined, joined
        s.pair_round(level, held, *runs)


def low_bits(inner: int) -> int:
    """Bits that differ for any two starts in windows that overlap."""
    return (2 * inner).bit_length()


def choices(names: np.ndarray, cut: np.ndarray, inner: int) -> np.ndarray:
    """For each word the symbol that the inner window from there on chooses; 0 where none fits into the text. cut: where texts begin, and the end.

    The upper bits are a hash of the symbol, the lower ones (see low_bits) tell its occurrences apart.
    """
    below = np.uint64(low_bits(inner))
    size = np.diff(cut)
    text = np.repeat(np.arange(len(size)), size)
    best = np.zeros(len(names), dtype=np.uint64)
    last = np.repeat(cut[1:] - inner, size)  # the last start in each word's text
    open_ = np.arange(len(names)) <= last
    found = levels(names, text, inner)
    found = [*found[:HIGH], tuple(np.concatenate(x) for x in zip(*found[HIGH:]))] if len(found) > HIGH else found
    for name, lo, hi, begin, _ in reversed(found):
        rank = (mix(name ^ _ODD) >> below | np.uint64(1)) << below | begin.astype(np.uint64) & (np.uint64(1) << below) - np.uint64(1)
        low, high = np.maximum(hi - inner, cut[text[begin]]), np.minimum(lo, last[begin])
        level = np.zeros(len(names), dtype=np.uint64)
        own = np.arange(len(name)) if open_.all() else np.flatnonzero(np.cumsum(np.append(0, open_))[np.maximum(high, low - 1) + 1] > np.cumsum(np.append(0, open_))[low])
        t = 0
        while len(own := own[low[own] + t <= high[own]]):
            np.maximum.at(level, low[own] + t, rank[own])
            t += 1
        best = np.where(open_, level, best)
        open_ &= level == 0
        if not open_.any():
            break
    return best


def asked(found: np.ndarray, n: int, window: int) -> np.ndarray:
    """The starts of windows all of whose inner windows have found symbols. found: ranges of starts of inner windows, begin << 31 | end."""
    inner = window - MARGIN
    change = np.zeros(n + 2, dtype=np.int64)
    np.add.at(change, found >> 31, 1)
    np.add.at(change, found & 0x7FFFFFFF, -1)
    missing = np.append(0, np.cumsum(np.cumsum(change)[: n - inner + 1] <= 0))
    starts = np.arange(n - window + 1)
    return starts[missing[starts + MARGIN + 1] == missing[starts]]


_POWERS = np.cumprod(np.full(64, 0x5851F42D4C957F2D, dtype=np.uint64))
_POWERS_2 = np.cumprod(np.full(64, 0xDA942042E4DD58B5, dtype=np.uint64))


def window_names(names: np.ndarray, starts: np.ndarray, window: int, bits: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Names of 64 and 32 bits of the windows. bits: fewer make names that collide, for tests."""
    one, two = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    first, second = mix(names), mix(names + _ODD)
    for k in range(window):
        one += first[starts + k] * _POWERS[k % 64]
        two += second[starts + k] * _POWERS_2[k % 64]
        if k % 64 == 63:
            one, two = mix(one), mix(two)
    one, two = mix(one), mix(two) >> _S32
    if bits < 96:
        one, two = one >> np.uint64(64 - min(bits, 64)), two & np.uint64(0)
    return one.view(np.int64), two.astype(np.uint32).view(np.int32)


# Rows that go from round to round. kind 0: is it the only (first) one? 1: a witness that a key occurs twice; 2: settled, passed on as it is.
ASK, WITNESS, SETTLED = 0, 1, 2


def _batch(arrays: list[np.ndarray], out):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=out.names)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of the runs of equal rows."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(new)))


def _by_run(batches, keys: int):
    """The columns of sorted batches as arrays, cut so that no run of equal keys (the first columns) is divided."""
    held = None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        begin, _ = _runs(*columns[:keys])
        if begin[-1]:
            yield [c[: begin[-1]] for c in columns]
        held = [c[begin[-1] :] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _grouped(rows: Iterator[tuple], seed: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, names of all their words, cut) of about GROUP_BYTES of text at a time; the text is the last field of a row."""
    some, words, size, cut = [], [], 0, [0]
    for row in rows:
        own = row[-1].split()
        some.append(row[:-1])
        words += own
        cut.append(len(words))
        size += len(row[-1])
        if size >= GROUP_BYTES:
            yield some, word_names(words, seed), np.array(cut)
            some, words, size, cut = [], [], 0, [0]
    if some:
        yield some, word_names(words, seed), np.array(cut)


_KEYS = schema(key="long", doc_id="long", at="long", kind="int")


def _send_keys(window: int, seed: int):
    """A row per run of inner windows with one choice (one occurrence of a symbol). at: the tag of the text in the upper half, the first start in the lower one; kind: the number of starts above the kind."""
    inner = window - MARGIN
    below = np.uint64(low_bits(inner))

    def run(batches):
        for batch in batches:
            parts = []
            rows = ((i, tag, t) for i, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))) if i is not None and len(t) >= 2 * window - 1)
            for some, names, cut in _grouped(rows, seed):
                best = choices(names, cut, inner)
                text = np.repeat(np.arange(len(some)), np.diff(cut))
                if not len(best):
                    continue
                begin, size = _runs(best, text)
                begin, size = begin[best[begin] > 0], size[best[begin] > 0]
                doc, tag = np.array([r[0] for r in some], dtype=np.int64), np.array([r[1] for r in some], dtype=np.int64)
                own = text[begin]
                parts.append((best[begin] >> below, doc[own], (tag[own] << 32) + begin - cut[own], size.astype(np.int32)))
            if not parts:
                continue
            key, doc, at, size = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            begin, count = _runs(key[order])
            many = np.empty(len(key), dtype=bool)
            many[order] = np.repeat(count > 1, count)
            witness = key[order[begin[count > 1]]]
            none = np.zeros(len(witness), dtype=np.int64)
            # Settled rows that follow each other in a text are one; they go to tasks at random.
            d, a, n = doc[many], at[many], size[many]
            apart = np.ones(len(d), dtype=bool)
            apart[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + n[:-1])
            begin = np.flatnonzero(apart)
            n = np.add.reduceat(n, begin) if len(begin) else n
            d, a = d[begin], a[begin]
            spread = mix(d.view(np.uint64) * _ODD ^ a.view(np.uint64))
            key, doc, at = np.concatenate([key[~many], witness, spread]), np.concatenate([doc[~many], none, d]), np.concatenate([at[~many], none, a])
            kind = np.concatenate([size[~many] << 2, np.full(len(witness), WITNESS, dtype=np.int32), n.astype(np.int32) << 2 | SETTLED])
            yield _batch([key.view(np.int64), doc, at, kind.astype(np.int32)], _KEYS)

    return run


_FOUND = schema(doc_id="long", tag="int", what="long")


def _repeated_keys(batches):
    for key, doc, at, kind in _by_run(batches, 1):
        begin, size = _runs(key)
        weight = np.array([1, 2, 0])[kind & 3]
        many = np.repeat(np.add.reduceat(weight, begin) > 1, size)
        out = (kind & 3 == SETTLED) | many & (kind & 3 == ASK)
        start = at[out] & 0xFFFFFFFF
        yield _batch([doc[out], (at[out] >> 32).astype(np.int32), start << 31 | start + (kind[out] >> 2)], _FOUND)


_WINDOWS = schema(one="long", two="int", doc_id="long", at="long", end="int", kind="int")


def _send_windows(window: int, seed: int, bits: int):
    """Asks for the earlier windows of the first of each name in a batch; runs of consecutive other windows are settled repeats, a row for each run."""

    def run(batches):
        for batch in batches:
            parts = []
            rows = ((i, tag, np.asarray(f.values), t) for i, tag, t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3)) if f.is_valid)
            at_word, every = 0, []
            for some, names, cut in _grouped(rows, seed):
                for k, (i, tag, found) in enumerate(some):
                    starts = asked(found, int(cut[k + 1] - cut[k]), window)
                    if len(starts):
                        parts.append((np.full(len(starts), i, dtype=np.int64), (np.int64(tag) << 32) + starts, starts + cut[k] + at_word))
                every.append(names)
                at_word += len(names)
            if not parts:
                continue
            names = np.concatenate(every)
            doc, at, place = (np.concatenate(x) for x in zip(*parts))
            one, two = window_names(names, place, window, bits)
            order = np.lexsort((at, doc, two, one))
            begin, size = _runs(one[order], two[order])
            first = np.empty(len(one), dtype=np.int64)
            first[order] = np.repeat(order[begin], size)
            ask = (doc == doc[first]) & (at == at[first])
            rest = np.flatnonzero(~ask)
            for k in range(window):
                if (names[place[rest] + k] != names[place[first[rest]] + k]).any():
                    raise NamesCollide(f"two windows have the same name under seed {seed}")
            yield _batch([one[ask], two[ask], doc[ask], at[ask], np.zeros(ask.sum(), dtype=np.int32), np.full(ask.sum(), ASK, dtype=np.int32)], _WINDOWS)
            doc, at = doc[rest], at[rest]
            if len(doc):
                line = at - np.arange(len(at))  # equal along consecutive windows of a text
                begin, size = _runs(doc, line)
                end = ((at[begin] & 0xFFFFFFFF) + size - 1 + window).astype(np.int32)
                spread = mix(doc[begin].view(np.uint64) * _ODD ^ at[begin].view(np.uint64)).view(np.int64)
                yield _batch([spread, np.zeros(len(begin), dtype=np.int32), doc[begin], at[begin], end, np.full(len(begin), SETTLED, dtype=np.int32)], _WINDOWS)

    return run


_LINKS = schema(source="long", source_tag="int", doc_id="long", at="long", place="long")


def _links(batches):
    """Of the windows of each name, sorted by text and position, all but the first: where they are and which earlier one they are to be compared with. Settled stretches are linked to themselves, place: below 0, their end."""
    for one, two, doc, at, end, kind in _by_run(batches, 2):
        settled = kind == SETTLED
        yield _batch([doc[settled], (at[settled] >> 32).astype(np.int32), doc[settled], at[settled], -end[settled].astype(np.int64)], _LINKS)
        ask = ~settled
        begin, _ = _runs(one[ask], two[ask], doc[ask], at[ask]) if ask.any() else (np.zeros(0, dtype=np.int64), None)
        one, two, doc, at = (x[ask][begin] for x in (one, two, doc, at))
        if not len(one):
            continue
        begin, size = _runs(one, two)
        head = np.repeat(begin, size)
        rank = np.arange(len(one)) - head
        later = rank > 0
        parent = (head + (rank - 1) // FAN)[later]
        yield _batch([doc[parent], (at[parent] >> 32).astype(np.int32), doc[later], at[later], at[parent] & 0xFFFFFFFF], _LINKS)


_STRETCHES = schema(doc_id="long", tag="int", what="long", words="binary")


def _stretches(window: int):
    """Links that go along both texts become one stretch with the words of the earlier text."""

    def run(batches):
        import pyarrow as pa

        parts, size = [], 0

        def out():
            doc, at, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF) << 31 | end), pa.array([w for p in parts for w in p[3]], pa.binary())], names=_STRETCHES.names)

        for batch in batches:
            for text, links in zip(as_bytes(batch.column(2)), batch.column(3)):
                if not links.is_valid:
                    continue
                doc, at, place = (np.asarray(links.values.field(k)) for k in range(3))
                own = place < 0
                parts.append((doc[own], at[own], -place[own], [None] * int(own.sum())))
                doc, at, place = doc[~own], at[~own], place[~own]
                if len(doc):
                    order = np.lexsort((at, at - place, doc))
                    doc, at, place = doc[order], at[order], place[order]
                    begin, count = _runs(doc, at - place, at - np.arange(len(at)))
                    words = text.split()
                    some = [b" ".join(words[p : p + n - 1 + window]) for p, n in zip(place[begin].tolist(), count.tolist())]
                    parts.append((doc[begin], at[begin], (at[begin] & 0xFFFFFFFF) + count - 1 + window, some))
                    size += sum(map(len, some))
                if size >= GROUP_BYTES or len(parts) >= 4096:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return run


_RESULT = schema(doc_id="long", n_words="long", n_removed="long", kept="string")


def _remove(window: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            total, removed, kept = [], [], []
            for text, found in zip(as_bytes(batch.column(2)), batch.column(3)):
                words = text.split()
                total.append(len(words))
                removed.append(0)
                if found.is_valid:
                    what, earlier = np.asarray(found.values.field(0)), found.values.field(1).to_pylist()
                    for x, w in zip(what.tolist(), earlier):
                        if w is not None and w != b" ".join(words[x >> 31 : x & 0x7FFFFFFF]):
                            raise NamesCollide(f"two windows have the same name under seed {seed}")
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, what >> 31, 1)
                    np.add.at(change, what & 0x7FFFFFFF, -1)
                    keep = np.cumsum(change[:-1]) <= 0
                    removed[-1] = len(words) - int(keep.sum())
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=_RESULT.names)

    return run


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = 0, bits: int = 96) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that are left, joined by spaces) of each row.

    A word is removed if a window of so many words covers it whose words also start earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the
    input. A null text has no words. Documents with a null id are neither removed from nor held against others. Rows that repeat (same id and text) are one document: both keep
    what either would; rows with one id and different texts stand in the order of a hash of their texts. An empty table gives none.
    window: 10 words at least. seed: of the names; the job fails with NamesCollide if different words have one name, which repeats_removed() answers with another seed.
    Each round ends in a table in the shared folder, so no round's shuffle files lie beside those of the next. Round 1 shuffles a row for each run of inner windows with one symbol; round 2 the text and a row for each window
    around a repeated symbol; round 3 the text again and the words of the stretches to be compared.
    """
    docs = narrow(df, doc_id=id_col, text=text_col)
    texts = docs.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    tag = F.lit(0) if texts.where("doc_id is not null and a < b").isEmpty() else F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")  # only for ids with several texts
    docs = docs.select("doc_id", tag.alias("tag"), "text")
    keys = docs.mapInArrow(_send_keys(window, seed), _KEYS).repartition("key").sortWithinPartitions("key")
    found = write_shared(keys.mapInArrow(_repeated_keys, _FOUND).groupBy("doc_id", "tag").agg(F.collect_list("what").alias("found")), "found")
    sent = docs.join(found, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "found").mapInArrow(_send_windows(window, seed, bits), _WINDOWS)
    links = write_shared(sent.repartition("one", "two").sortWithinPartitions("one", "two", "doc_id", "at").mapInArrow(_links, _LINKS), "links")
    links = links.groupBy(F.col("source").alias("doc_id"), F.col("source_tag").alias("tag")).agg(F.collect_list(F.struct("doc_id", "at", "place")).alias("links"))
    stretches = docs.join(links, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "links").mapInArrow(_stretches(window), _STRETCHES)
    stretches = stretches.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("what", "words")).alias("stretches"))
    return docs.join(stretches, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "stretches").mapInArrow(_remove(window, seed), _RESULT)


def repeats_removed(df: DataFrame, path: str, seeds: range = range(8), **options) -> DataFrame:
    """without_repeats() written to a Parquet table at path and read again; with the next seed if names collide."""
    for seed in seeds:
        try:
            without_repeats(df, seed=seed, **options).write.mode("overwrite").parquet(path)
            return df.sparkSession.read.schema(_RESULT).parquet(path)
        except Exception as e:
            if NamesCollide.__name__ not in str(e) or seed == seeds[-1]:
                raise
    raise ValueError("no seeds")


#: The result of the registered query in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(20) AS r(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
