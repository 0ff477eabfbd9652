"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE:

* the *splitter* reads code-point classes and emits the borders of the pieces that merges never cross. Texts are cut
  into chunks of equal length; each chunk's state map (start state -> end state) is computed for all chunks in lockstep,
  the maps are composed by a parallel prefix scan, and a second lockstep pass, now with known start states, emits borders;
* the *merger* reads the bytes of a piece. Its states are compiled when first reached, and each transition carries the
  number of tokens that the longer prefix has more (or fewer) than the shorter one, so the sum of annotations along a run
  is the number of tokens. A state lists the suffixes of its prefix that begin some token of the vocabulary, each with the
  last token before it and the number of tokens before it against that of the whole prefix; equal lists are one state, so
  their number depends on the vocabulary and not on the corpus. By the prefix property of BPE the last token of the longer
  prefix is the one suffix that is a token and may stand after the last token of what lies before it.

Each distinct piece of a batch runs through the merger once. Memory is bounded by the batch and by MAX_STATES.
Null texts count as empty (0 tokens); a special string inside a text is one token and separates what lies beside it.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import as_bytes, narrow, schema

#: The states of the merger that a worker keeps; beyond, it starts anew after the batch.
MAX_STATES = 400_000
#: Code points in a chunk of the splitter, and those after which most chunk maps are constant.
CHUNK, HEAD = 512, 16
#: Texts are processed in groups of about so many bytes.
GROUP_BYTES = 8 << 20

# Classes of code points. S: s, t, m, d, which end a contraction; R, V, L2, E2 take part in 're, 've, 'll.
LETTER, CS, CR, CV, CL, CE, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, END = range(12)
# States: nothing pending; runs of letters, numbers, others; after ', 'r, 'v, 'l; blanks: one or more, the last one a space or not.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_A, AFTER_AR, AFTER_AV, AFTER_AL, ONE_SPACE, ONE_BLANK, SPACES, BLANKS = range(12)
STATES = CLASSES = 12
LETTERS = {LETTER, CS, CR, CV, CL, CE}
#: Unicode's white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _begin(c: int) -> int:
    if c in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, OTHER: IN_OTHERS, APOSTROPHE: AFTER_A, END: DONE}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """The next state; whether a piece begins one code point before, and at this one."""
    blank = c in (SPACE, BLANK)
    if state == DONE:
        return _begin(c), False, True
    if state == IN_LETTERS:
        return (IN_LETTERS, False, False) if c in LETTERS else (_begin(c), False, True)
    if state == IN_NUMBERS:
        return (IN_NUMBERS, False, False) if c == NUMBER else (_begin(c), False, True)
    if state == IN_OTHERS:
        return (IN_OTHERS, False, False) if c in (OTHER, APOSTROPHE) else (_begin(c), False, True)
    if state == AFTER_A:
        if c in (OTHER, APOSTROPHE):
            return IN_OTHERS, False, False
        after = {CS: DONE, CR: AFTER_AR, CV: AFTER_AV, CL: AFTER_AL}
        return (after[c], False, False) if c in after else (_begin(c), False, True)
    if state in (AFTER_AR, AFTER_AV, AFTER_AL):
        if c == (CL if state == AFTER_AL else CE):
            return DONE, False, False
        return (IN_LETTERS, True, False) if c in LETTERS else (_begin(c), True, True)
    if blank:
        return (SPACES if c == SPACE else BLANKS), False, False
    if c == END:
        return DONE, False, True
    long = state in (SPACES, BLANKS)
    if state in (ONE_SPACE, SPACES):  # the space goes with what follows
        return (IN_OTHERS if c == APOSTROPHE else _begin(c)), long, False
    return _begin(c), long, True


_table = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
NEXT = np.array([x[0] * CLASSES for x in _table], dtype=np.uint8)  # states are kept multiplied by CLASSES
EMIT = np.array([x[1] * 2 + x[2] for x in _table], dtype=np.uint8)


def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = BLANK
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    for letters, c in (("stmd", CS), ("r", CR), ("v", CV), ("l", CL), ("e", CE)):
        out[[ord(x) for x in letters]] = c
    return out


_class_table: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _class_table
    if _class_table is None:
        _class_table = _classes()
    return _class_table


def _chunk_maps(by_step: np.ndarray) -> np.ndarray:
    """by_step: classes, a row for each step and a column for each chunk. A row for each chunk: the end states from each start state."""
    chunks = by_step.shape[1]
    maps = np.broadcast_to((np.arange(STATES) * CLASSES).astype(np.uint8)[:, None], (STATES, chunks)).copy()
    for row in by_step[:HEAD]:
        maps = NEXT[maps + row]
    same = (maps == maps[:1]).all(axis=0)
    for which, states in ((same, maps[:1, same]), (~same, maps[:, ~same])):
        if which.any():
            rest = np.ascontiguousarray(by_step[HEAD:, which])
            for row in rest:
                states = NEXT[states + row]
            maps[:, which] = states
    return maps // CLASSES


def _prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The start state of each chunk: maps composed over all chunks before it, in a logarithmic number of rounds."""
    done = maps.copy()
    step = 1
    while step < done.shape[1]:
        done[:, step:] = np.take_along_axis(done[:, step:], done[:, :-step].astype(np.intp), axis=0)
        step *= 2
    return np.concatenate([[DONE], done[DONE, :-1]]).astype(np.uint8)


def borders(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in a sequence of classes that starts anew."""
    n = len(classes)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, dtype=np.uint8)
    padded[:n] = classes
    by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = _prefix_scan(_chunk_maps(by_step)) * np.uint8(CLASSES)
    out = np.empty_like(by_step)
    for k in range(CHUNK):
        at = state + by_step[k]
        out[k] = EMIT[at]
        state = NEXT[at]
    out = out.T.reshape(-1)[:n]
    begins = (out & 1).astype(bool)
    begins[:-1] |= out[1:] >= 2
    return np.flatnonzero(begins)


class Pieces:
    """The pieces of a group of texts: .text (index of the text) of each, .which (index into .distinct), .distinct (bytes)."""

    def __init__(self, texts: list[str]):
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        data = joined.encode("utf-8", "surrogatepass")
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))) - 1
        classes = class_table()[points]
        classes[ends] = END
        at = borders(classes)
        if len(points) == len(data):
            offset = at
            ends_b = ends
        else:
            width = np.ones(len(points), dtype=np.uint8)
            for low in (0x80, 0x800, 0x10000):
                width += points >= low
            where = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            offset, ends_b = where[at], where[ends]
        stop = np.append(offset[1:], len(data))
        text = np.searchsorted(ends, at)
        keep = offset != ends_b[text]  # the separators themselves
        self._distinct(data, offset[keep], (stop - offset)[keep])
        self.text = text[keep]

    def _distinct(self, data: bytes, begin: np.ndarray, length: np.ndarray) -> None:
        """Exact: up to 15 bytes by two words, of which a mixed hash is sorted and then compared; longer ones by a dictionary."""
        buf = np.frombuffer(data + bytes(16), dtype=np.uint8)
        words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
        short = length < 16
        b, n = begin[short], length[short]
        low = words[b] & mask[np.minimum(n, 8)]
        high = words[b + 8] & mask[np.clip(n - 8, 0, 8)] | n.astype(np.uint64) << np.uint64(56)
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
        which = np.empty(len(begin), dtype=np.int64)
        self.distinct = [data[x : x + y] for x, y in zip(b[first].tolist(), n[first].tolist())]
        known: dict[bytes, int] = {}
        odd = np.flatnonzero(~short)
        wrong = (low != low[first[inverse]]) | (high != high[first[inverse]])
        which[short] = inverse
        if wrong.any():
            odd = np.concatenate([odd, np.flatnonzero(short)[wrong]])
        for k, x, y in zip(odd.tolist(), begin[odd].tolist(), length[odd].tolist()):
            piece = data[x : x + y]
            if (at := known.get(piece)) is None:
                at = known[piece] = len(self.distinct)
                self.distinct.append(piece)
            which[k] = at
        self.which = which


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the others from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The lazily compiled transducer of a BPE vocabulary whose ids follow the order of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[x] for x in s)
        self.special = [t["content"] for t in model["added_tokens"]]
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
        # Tokens are numbered by merge order, which is all that matters for counts.
        self.ids = {bytes([b]): b for b in range(256)}
        self.split = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            z = self.ids.setdefault(raw(a) + raw(b), len(self.split))
            if z == len(self.split):
                self.split.append((x, y))
            self.pair.setdefault((x, y), z)
        assert all(raw(t) in self.ids for t in vocab if t not in self.special), "a token that no merge makes"
        # The vocabulary as a tree of bytes: node << 8 | byte -> node; the token that ends at a node, or -1; whether it has children.
        self.tree, self.token, self.inner = {}, [-1], [True]
        for text, token in self.ids.items():
            node = 0
            for b in text:
                self.inner[node] = True
                node = self.tree.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = token
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Only the start state: an empty prefix, after no token."""
        start = ((0, -1, 0),)
        self.next: dict[int, int] = {}
        self.state, self.live, self.fits = {start: 0}, [start], {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge across their border comes before those that made them."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        split, pair, limit, out = self.split, self.pair, 1 << 60, True
        a, b = left, right
        while True:
            if pair.get((a, b), limit) < limit:
                out = False
                break
            if a > b:
                limit = a
                a = split[a][1]
                if a == limit:
                    limit = b + 1
                    b = split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = split[a][1]
                    if a == limit:
                        break
        self.fits[key] = out
        return out

    def run(self, piece: bytes) -> int:
        """The sum of the annotations along the run: the number of tokens of the piece."""
        state = total = 0
        follow = self.next
        for b in piece:
            to = follow.get(state << 8 | b)
            if to is None:
                to = self._compile(state, b)
            state = to >> 8
            total += (to & 255) - 128
        return total

    def _compile(self, state: int, b: int) -> int:
        """The transition from state on byte b: the next state, and below it the annotation plus 128."""
        tree, token, live, found, since = self.tree, self.token, [], -1, 0
        for node, before, count in self.live[state]:  # the longest suffix first
            if (node := tree.get(node << 8 | b)) is None:
                continue
            if found < 0 and token[node] >= 0 and (before < 0 or self.follows(before, token[node])):
                found, since = token[node], count + 1
            if self.inner[node]:
                live.append((node, before, count))
        key = (*[(node, before, count - since) for node, before, count in live], (0, found, 0))
        if (to := self.state.get(key)) is None:
            to = self.state[key] = len(self.live)
            self.live.append(key)
        out = self.next[state << 8 | b] = to << 8 | since + 128
        return out


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def groups_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def segments(texts: list[bytes], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts split at special strings: the segments, the index of the text of each, the special tokens of each text."""
    parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        found = [t.decode("utf-8", "replace")]
        for s in special:
            found = [y for x in found for y in x.split(s)]
        extra[k] = len(found) - 1
        parts += found
        owner += [k] * len(found)
    return parts, np.array(owner, dtype=np.int64), extra


def count_tokens(texts: list[bytes], path: str) -> np.ndarray:
    m = merger(path)
    parts, owner, total = segments(texts, m.special)
    pieces = Pieces(parts)
    counts = np.fromiter(map(m.run, pieces.distinct), dtype=np.int64, count=len(pieces.distinct))
    if len(m.live) > MAX_STATES:
        m.reset()
    if len(pieces.which):
        total = total + np.bincount(owner[pieces.text], weights=counts[pieces.which], minlength=len(texts)).astype(np.int64)
    return total


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    No shuffle; rows are kept as often as they occur, null ids stay null, a null text has 0 bytes and tokens, an empty table gives none.
    """
    out = schema(doc_id="long", n_bytes="long", n_tokens="long", over_limit="boolean")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(1))
            n = np.zeros(len(texts), dtype=np.int64)
            for a, b in groups_of(texts):
                n[a:b] = count_tokens(texts[a:b], tokenizer)
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=out.names)

    return narrow(df, doc_id=id_col, text=text_col).mapInArrow(count, out)
