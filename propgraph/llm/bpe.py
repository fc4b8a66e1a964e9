"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point becomes a class (with one or two
code points of lookahead folded in), every class is a function on eight automaton states, and the
functions reachable by composition form a small monoid with a composition table. Composition is
associative, so blocks of text are scanned side by side: each step composes one column of all
blocks, then the blocks' totals are chained, then every prefix is applied to its block's entry
state. A table of (state before, class) says where a pre-token starts.

The slices between starts go through a bounded cache to pair merging by rank. Byte offsets of the
tokens are kept, so a span of ids can be mapped back to a span of bytes.

Null text encodes as empty text: no ids, no bytes. A null id column value passes through. Repeated
rows give repeated results. Other columns of the input are not looked at, so names that clash with
the result's do no harm. An empty table gives no rows. Of a very long text the code points, the bytes
and the pre-tokens are held; classes, states and byte places are held for ``CHUNK`` code points only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

# Classes of code points, with what follows them folded in.
LETTER, NUMBER, OTHER, APO2, APO3, SPACE_JOINS, WHITE_LAST, WHITE, END = range(9)
# States: what the character before leaves open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = range(8)

# Fixed values of the pattern: the endings that follow an apostrophe as one pre-token.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")
# Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Letters and numbers that Unicode 16.0 assigns and the interpreter's tables (15.1) do not know yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A),
    (0xA7CB, 0xA7CD),
    (0xA7DA, 0xA7DC),
    (0x105C0, 0x105F3),
    (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4),
    (0x11380, 0x11389),
    (0x1138B, 0x1138B),
    (0x1138E, 0x1138E),
    (0x11390, 0x113B5),
    (0x113B7, 0x113B7),
    (0x113D1, 0x113D1),
    (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA),
    (0x16100, 0x1611D),
    (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

#: Stands between documents; no code point of a text.
BREAK = 0x110000
#: Code points scanned at once.
CHUNK = 1 << 20
#: Pre-tokens kept in each of the cache's two generations.
CACHE = 120_000
_FAR = 1 << 30


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this character."""
    if kind == LETTER:
        after = {TWO_MORE: ONE_MORE, ONE_MORE: FRESH}.get(state, IN_LETTERS)
        return after, state not in (IN_LETTERS, AFTER_SPACE, ONE_MORE, TWO_MORE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, APO2, APO3):
        joined = state in (IN_OTHERS, AFTER_SPACE)
        if kind == OTHER or joined:
            return IN_OTHERS, not joined
        return (ONE_MORE if kind == APO2 else TWO_MORE), True
    if kind == SPACE_JOINS:
        return AFTER_SPACE, True
    if kind == WHITE_LAST:
        return FRESH, True
    if kind == WHITE:
        return IN_WHITE, state != IN_WHITE
    return FRESH, True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat tables: (element, class) to the composed element, (element, state) to the state after, (state, class) to whether a pre-token starts."""
    maps = [tuple(_step(s, k)[0] for s in STATES) for k in range(9)]
    known: dict[tuple, int] = {tuple(STATES): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in maps:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    n = len(every)
    assert n <= 256
    compose = np.zeros((256, 16), np.uint8)
    for i, f in enumerate(every):
        for k, g in enumerate(maps):
            compose[i, k] = known[tuple(g[x] for x in f)]
    apply = np.zeros((256, 8), np.uint8)
    for i, f in enumerate(every):
        apply[i] = f
    start = np.zeros((8, 16), bool)
    for s in STATES:
        for k in range(9):
            start[s, k] = _step(s, k)[1]
    return compose.ravel(), apply.ravel(), start.ravel()


COMPOSE, APPLY, START = _monoid()
_kinds: list[np.ndarray] = []


def _base_kinds() -> np.ndarray:
    """Class of every code point, without lookahead."""
    if not _kinds:
        category = unicodedata.category
        table = np.full(BREAK + 1, OTHER, np.uint8)
        for point in range(BREAK):
            c = category(chr(point))[0]
            if c == "L":
                table[point] = LETTER
            elif c == "N":
                table[point] = NUMBER
        for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
            for first, last in ranges:
                table[first : last + 1] = kind
        table[list(WHITE_SPACE)] = WHITE
        table[BREAK] = END
        _kinds.append(table)
    return _kinds[0]


def _classes(points: np.ndarray, n: int) -> np.ndarray:
    """Classes of the first ``n`` code points; ``points`` holds two more for lookahead, or ends in breaks."""
    kinds = _base_kinds()[points]
    kind, after = kinds[:n].copy(), kinds[1 : n + 1]
    white = kind == WHITE
    last = white & (after != WHITE) & (after != END)
    if last.any():
        kind[last] = np.where(points[:n][last] == 0x20, SPACE_JOINS, WHITE_LAST)
    for i in np.flatnonzero(points[:n] == 0x27):
        a, b = int(points[i + 1]), int(points[i + 2])
        if a < 128 and chr(a) in ENDINGS_1:
            kind[i] = APO2
        elif a < 128 and b < 128 and chr(a) + chr(b) in ENDINGS_2:
            kind[i] = APO3
    return kind


def _scan(kind: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each character, and the state after the last."""
    n = len(kind)
    width = max(1, min(128, n // 64))
    blocks = -(-n // width)
    padded = np.full(blocks * width, END, np.uint8)
    padded[:n] = kind
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    prefix = np.empty((width + 1, blocks), np.uint8)
    prefix[0] = 0
    key = np.empty(blocks, np.intp)
    for t in range(width):
        np.multiply(prefix[t], 16, out=key, dtype=np.intp, casting="unsafe")
        key += columns[t]
        np.take(COMPOSE, key, out=prefix[t + 1])
    entry = np.empty(blocks, np.intp)
    total = prefix[width]
    for b in range(blocks):
        entry[b] = state
        state = int(APPLY[int(total[b]) * 8 + state])
    before = np.take(APPLY, prefix[:width].astype(np.intp) * 8 + entry)
    before = np.ascontiguousarray(before.T).ravel()[:n]
    after = int(_step(int(before[-1]), int(kind[-1]))[0])
    return before, after


def starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``points`` at which a pre-token, or a break, starts, and their places among the UTF-8 bytes (breaks take none)."""
    n, state, found, places, passed = len(points), FRESH, [], [], 0
    points = np.concatenate([points, np.array([BREAK, BREAK], np.uint32)])
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        own = points[a:b]
        kind = _classes(points[a : b + 2], b - a)
        before, state = _scan(kind, state)
        at = np.flatnonzero(START[before.astype(np.intp) * 16 + kind])
        size = np.ones(b - a, np.int8)
        for least in (0x7F, 0x7FF, 0xFFFF):
            size += own > least
        size[own == BREAK] = 0
        ends = np.cumsum(size, dtype=np.int64)
        found.append(at + a)
        places.append(ends[at] - size[at] + passed)
        passed += int(ends[-1])
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.intp), np.zeros(0, np.int64))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary, for one Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        by_id = [b""] * size
        for token, i in ranks.items():
            lengths[i], by_id[i] = len(token), token
        self.lengths = lengths
        self.places = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if size else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.new: dict[bytes, tuple[str, bytes]] = {}
        self.old: dict[bytes, tuple[str, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is merged until none is known."""
        rank = self.ranks.get
        if (whole := rank(piece)) is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        at = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], _FAR) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == _FAR:
                break
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[at[i] : at[i + 2]], _FAR)
            if i:
                pairs[i - 1] = rank(piece[at[i - 1] : at[i + 1]], _FAR)
        return [self.ranks[piece[a:b]] for a, b in zip(at, at[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for pre-tokens of any length."""
        rank, n = self.ranks.get, len(piece)
        following, previous = list(range(1, n + 2)), list(range(-1, n))
        current: list[int] = [_FAR] * n
        heap = []

        def renew(i: int) -> None:
            j = following[i]
            current[i] = rank(piece[i : following[j]], _FAR) if j < n else _FAR
            if current[i] != _FAR:
                heapq.heappush(heap, (current[i], i))

        for i in range(n - 1):
            renew(i)
        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r:
                continue
            j = following[i]
            k = following[j]
            following[i], current[j] = k, -1
            if k < n:
                previous[k] = i
            renew(i)
            if previous[i] >= 0:
                renew(previous[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def _pieces(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old, merge = self.new, self.old, self.merge
        get = new.get
        out = [get(p) for p in pieces]
        for i, x in enumerate(out):
            if x is None:
                p = pieces[i]
                if (x := get(p)) is None:
                    if (x := old.get(p)) is None:
                        ids = merge(p)
                        x = (",".join(map(str, ids)), np.array(ids, np.uint32).tobytes())
                    if len(p) <= 64:
                        new[p] = x
                out[i] = x
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Of each text the decimal ids joined by commas, and the ids."""
        mark = BREAK.to_bytes(4, "little")
        points = np.frombuffer(mark.join([t.encode("utf-32-le") for t in texts]) + mark, np.uint32)
        data = "".join(texts).encode()
        at, places = starts(points)
        breaks = np.flatnonzero(points[at] == BREAK)
        offsets = np.append(places, len(data)).tolist()
        is_text = points[at] != BREAK
        pieces = [data[a:b] for a, b, real in zip(offsets, offsets[1:], is_text.tolist()) if real]
        coded = self._pieces(pieces)
        ends = (breaks - np.arange(len(breaks))).tolist()
        begin = 0
        for end in ends:
            own = coded[begin:end]
            begin = end
            yield ",".join([x[0] for x in own]), np.frombuffer(b"".join([x[1] for x in own]), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        if not total:
            return b""
        shift = self.places[ids] - (np.cumsum(lengths) - lengths)
        return self.bytes[np.repeat(shift, lengths) + np.arange(total)].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token starts."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        t = t or ""
        if own and size + len(t) > CHUNK:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def encode(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded bytes), ``round_trip`` (whether they are the text's bytes) and,
    with ``ids``, ``token_ids`` and ``token_starts`` (byte offsets).
    """
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    if ids:
        schema += ", token_ids array<int>, token_starts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            done = 0
            for chunk in _chunks(texts):
                n, id_hash, out_hash, same, tokens, places = [], [], [], [], [], []
                for t, (joined, got) in zip(chunk, own.encode_batch(chunk)):
                    back = own.decode(got)
                    n.append(len(got))
                    id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                    out_hash.append(hashlib.sha256(back).hexdigest())
                    same.append(back == t.encode())
                    if ids:
                        tokens.append(got.astype(np.int32))
                        places.append(own.offsets(got).astype(np.int32))
                columns = [keys.slice(done, len(chunk)), pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(out_hash, pa.string()), pa.array(same, pa.bool_())]
                names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if ids:
                    columns += [_lists(tokens), _lists(places)]
                    names += ["token_ids", "token_starts"]
                done += len(chunk)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(doc_id, text).mapInArrow(lean(run), schema)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def decode(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """The id column and ``text``, decoded with replacement of bytes that are no UTF-8; null ids give empty text."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [doc_id, "text"])

    return df.select(doc_id, token_ids).mapInArrow(run, f"`{doc_id}` {kind}, text string")
