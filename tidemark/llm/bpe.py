"""Byte-level BPE from a rank file: pre-tokenisation by array scans, cached pair merging, decoding by offsets.

Texts become arrays of code points, code points become classes (letter, number, space, other white space, apostrophe,
other) by one table look-up, and classes with a look ahead of two become symbols. A match begins where an automaton of
eight states says so; each symbol is a function from states to states, and functions compose associatively, so the scan
runs over many blocks at once: every block's function is composed, the blocks' functions are scanned by doubling, and a
second pass gives the state before each character. No regular expression is used. The slices between boundaries are
merged once each (the least rank first, the leftmost of equal ones), many slices at a time as rows of matrices, long
ones by a heap, and remembered by the worker. Beside its ids, each text keeps the byte offset of each slice and the
number of its first id, so that slices can be decoded and checked on their own.

Defined results: a null text counts as empty (no ids, no slices, decodes to no bytes); rows are independent, so ties and
repeated rows and ids give equal results row by row; an empty table gives no rows; further columns are not read; texts
of any length are taken whole; bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_values, thrifty_batches

LETTER, NUMBER, BLANK, WHITE, APOSTROPHE, OTHER = range(6)
# White space of the pattern's \s, and what Unicode 16 added to letters and numbers, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

#: Symbols of the automaton: an apostrophe that may begin a contraction of two or three characters; white space before
#: white space or the end; a space and other white space before anything else; the gap between texts.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_SPACE, S_WHITE, S_GAP = range(9)
#: States: what the character before belongs to. After CLOSED a match begins; JOINS is a space that the next run takes.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINS, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 128
#: Code points of a scan, bytes of a slice merged in matrices, slices that a worker remembers (it then begins anew).
SCAN, SHORT, REMEMBERED = 1 << 19, 48, 400_000
ROWS = 500
SCHEMA = "ids array<int>, slice_offsets array<int>, slice_first_ids array<int>"


def class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE_SPACE, WHITE)):
        for low, high in ranges:
            table[low : high + 1] = kind
    table[ord(" ")], table[ord("'")] = BLANK, APOSTROPHE
    return table


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]: the state after a character, and whether a match begins with it."""
    opened = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_LEFT, TWO_LEFT, IN_WHITE, JOINS, CLOSED, CLOSED]
    after = np.repeat(np.array(opened, np.uint8)[:, None], 8, 1)
    begins = np.ones((9, 8), bool)
    runs = [(S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_INNER, IN_WHITE), *((s, IN_OTHERS) for s in (S_OTHER, S_SHORT, S_LONG))]
    for symbol, run in runs:
        begins[symbol, run], after[symbol, run] = False, run
        if run != IN_WHITE:
            begins[symbol, JOINS], after[symbol, JOINS] = False, run
    for symbol in range(S_GAP):
        begins[symbol, [ONE_LEFT, TWO_LEFT]] = False
        after[symbol, ONE_LEFT], after[symbol, TWO_LEFT] = CLOSED, ONE_LEFT
    after[S_GAP], begins[S_GAP] = CLOSED, True
    return after, begins


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row by row, the function that applies `first` and then `then`."""
    return np.take_along_axis(then, first, 1)


class Splitter:
    """starts(points) gives where matches begin in texts joined by GAP code points."""

    GAP = 0x110000

    def __init__(self) -> None:
        self.classes = np.append(class_table(), np.uint8(OTHER + 1))  # the gap's class
        self.after, self.begins = transitions()

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """The symbol of each code point; points end with two gaps."""
        kinds = self.classes[points]
        out = np.array([S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_OTHER, S_OTHER, S_GAP], np.uint8)[kinds]
        white = np.flatnonzero((kinds == BLANK) | (kinds == WHITE))
        follows = kinds[white + 1]
        out[white[(follows == BLANK) | (follows == WHITE) | (follows == OTHER + 1)]] = S_INNER
        marks = np.flatnonzero(kinds == APOSTROPHE)
        one, two = points[marks + 1], points[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        out[marks[short]] = S_SHORT
        out[marks[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = S_LONG
        return out

    def starts(self, points: np.ndarray) -> np.ndarray:
        """For each code point whether a match begins there."""
        symbols = self.symbols(points)
        n, blocks = len(symbols), -(-len(symbols) // BLOCK)
        grid = np.full(blocks * BLOCK, S_GAP, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        flat = self.after.ravel()
        whole = np.repeat(np.arange(8, dtype=np.uint8)[None], blocks, 0)
        for step in grid:  # every block's function, one character of all blocks at a time
            whole = flat[(step.astype(np.uint8) * 8)[:, None] + whole]
        span = 1
        while span < blocks:  # inclusive scan by doubling: composition is associative
            whole[span:] = compose(whole[:-span], whole[span:])
            span *= 2
        state = np.concatenate([[CLOSED], whole[:-1, CLOSED]]).astype(np.uint8)
        begins, found = self.begins.ravel(), np.empty(grid.shape, bool)
        for i, step in enumerate(grid):
            at = step * 8 + state
            found[i], state = begins[at], flat[at]
        return found.T.ravel()[:n]


class PairTable:
    """The id that two neighbouring ids merge into: a hash table in arrays; NONE for pairs that do not merge."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        left, put = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slot(left)
        while len(left):  # each free slot takes one of the keys that want it, the others move on
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            lost = self.keys[slot] != left
            self.values[slot[~lost]] = put[~lost]
            left, put, slot = left[lost], put[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self.slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], self.NONE)
        again = np.flatnonzero((at != keys) & (at >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[again]]
            hit = at == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (at >= 0)]
        return out


#: MASKS[k] keeps the first k bytes of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each slice of raw (that ends with 16 further bytes) and the number of a slice of each code.

    Slices of one code are equal. Equal slices may have several codes: those of over 16 bytes, and neighbours by hash.
    """
    view = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    low, high = view[starts] & MASKS[np.minimum(sizes, 8)], view[starts + 8] & MASKS[np.clip(sizes - 8, 0, 8)]
    mixed = (low ^ (high + sizes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed)
    a, b, n = low[order], high[order], sizes[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1]) | (n[1:] > 16)])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, order[new]


def valid(text: bytes) -> bytes:
    """text, with bytes that are not UTF-8 read as U+FFFD."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


class Codec:
    """encode(texts) and decode(ids), with the tables of one rank file."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.widths = np.fromiter(map(len, tokens), np.int64, size)
        self.places = np.concatenate([[0], np.cumsum(self.widths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs, self.splitter = PairTable(self.ranks), Splitter()
        self.remembered, self.known = remembered, {}

    def slices(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Of each text (UTF-8) the byte offsets at which its slices begin."""
        points, sizes = [], []
        for t in texts:
            p = np.frombuffer(t.decode().encode("utf-32-le"), np.uint32)
            points += [p, np.full(2, Splitter.GAP, np.uint32)]
            sizes.append(len(p))
        joined = np.concatenate(points)
        begins = self.splitter.starts(joined)
        out, at = [], 0
        for p, n in zip(points[::2], sizes, strict=True):
            found = np.flatnonzero(begins[at : at + n])
            wide = np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000))  # bytes up to and with each
            out.append(np.concatenate([[0], wide[found[1:] - 1]]) if n else np.zeros(0, np.int64))
            at += n + 2
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one slice of any length: pairs in a heap by rank and place."""
        ids, n = self.single[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        start, before, after = list(range(n)), list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop or rank(piece[start[i] : stop]) != r:
                continue  # one of the two has merged since
            ids[i], end[i], alive[j] = r, stop, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank(piece[start[i] : end[after[i]]])) is not None:
                    heapq.heappush(heap, (s, i, end[after[i]]))
            if before[i] >= 0 and (s := rank(piece[start[before[i]] : stop])) is not None:
                heapq.heappush(heap, (s, before[i], stop))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of slices of up to `width` bytes: in each round every slice merges its least pair."""
        rows, none = len(pieces), PairTable.NONE
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        inside = np.arange(width) < sizes[:, None]
        ids = np.zeros((rows, width), np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((rows, width), none, np.int32)  # of each id and the one after it; the last column never merges
        pair = inside[:, 1:]
        a, b = ids[:, :-1][pair], ids[:, 1:][pair]
        ranks[:, :-1][pair] = self.pairs.merged(a, b)
        live, out_ids, out_sizes = np.arange(rows), ids.copy(), sizes.copy()
        place = np.arange(width)
        while True:
            j = ranks.argmin(1)
            least = ranks[np.arange(len(live)), j]
            done = least == none
            if done.any():
                out_ids[live[done]], out_sizes[live[done]] = ids[done], sizes[done]
                keep = ~done
                live, ids, ranks, sizes, j, least = live[keep], ids[keep], ranks[keep], sizes[keep], j[keep], least[keep]
                if not len(live):
                    break
            r = np.arange(len(live))
            gone = place[:-1] > j[:, None]  # columns behind the merged one move up
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(gone, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            ids[r, j] = least
            sizes -= 1
            has_next, has_before = j + 1 < sizes, j > 0
            ranks[r, j] = none
            some = r[has_next]
            ranks[some, j[some]] = self.pairs.merged(ids[some, j[some]], ids[some, j[some] + 1])
            some = r[has_before]
            ranks[some, j[some] - 1] = self.pairs.merged(ids[some, j[some] - 1], ids[some, j[some]])
        data = out_ids[place < out_sizes[:, None]].tobytes()
        ends = (np.cumsum(out_sizes) * 4).tolist()
        return [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces: set[bytes]) -> None:
        """Merge slices that are not remembered yet; a slice that is a token needs no merging."""
        if len(self.known) + len(pieces) > self.remembered:
            self.known.clear()
        whole = {p: r for p in pieces if (r := self.ranks.get(p)) is not None}
        self.known.update(zip(whole, (r.to_bytes(4, "little") for r in whole.values()), strict=True))
        pieces, low = pieces - whole.keys(), 1
        for width in (8, 16, SHORT):
            some = [p for p in pieces if low <= len(p) <= width]
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                self.known.update(zip(part, self.merge_short(part, width), strict=True))
            low = width + 1
        self.known.update((p, self.merge_long(p).tobytes()) for p in pieces if len(p) > SHORT)

    def encode(self, texts: Sequence[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text its ids (little-endian, 32 bits), its slices' byte offsets and the number of each slice's first id."""
        batch, size = [], 0
        for t in map(valid, texts):
            batch.append(t)
            size += len(t)
            if size >= SCAN:
                yield from self._encode(batch)
                batch, size = [], 0
        if batch:
            yield from self._encode(batch)

    def _encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        offsets = self.slices(texts)
        bases = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        raw = b"".join([*texts, bytes(16)])
        starts = np.concatenate([o + b for o, b in zip(offsets, bases, strict=False)])
        if not len(starts):
            yield from ((b"", o, o) for o in offsets)
            return
        code, first = distinct(raw, starts, np.append(starts[1:], bases[-1]) - starts)
        cut = np.append(starts, bases[-1])
        pieces = [raw[x:y] for x, y in zip(cut[first].tolist(), cut[first + 1].tolist(), strict=True)]
        found = list(map(self.known.get, pieces))
        gaps = [i for i, f in enumerate(found) if f is None]
        if gaps:
            self.learn({pieces[i] for i in gaps})
            for i in gaps:
                found[i] = self.known[pieces[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        places = np.cumsum(sizes) - sizes
        counts = sizes[code]
        ends = np.cumsum(counts)
        at = ends - counts  # the number of each slice's first id, in the batch
        ids = np.frombuffer(b"".join(found), "<i4")[np.repeat(places[code] - at, counts) + np.arange(int(ends[-1]))]
        lo = 0
        for o in offsets:
            hi = lo + len(o)
            yield (ids[at[lo] : ends[hi - 1]].tobytes(), o, at[lo:hi] - at[lo]) if len(o) else (b"", o, o)
            lo = hi

    def decode(self, ids: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> bytes:
        """The bytes of ids; an error if a slice's ids do not fill the bytes between its offset and the next one's."""
        ends = np.cumsum(self.widths[ids])
        starts = ends - self.widths[ids]
        if len(ids) and not np.array_equal(starts[first], offsets):
            raise ValueError("the ids of a slice do not fill it")
        if not len(ids):
            return b""
        source = np.repeat(self.places[ids] - starts, self.widths[ids]) + np.arange(int(ends[-1]))
        return self.bytes[source].tobytes()


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, remembered: int = REMEMBERED) -> Codec:
    """One for each path, bound and Python worker."""
    if (path, remembered) not in _CODECS:
        _CODECS[path, remembered] = Codec(path, remembered)
    return _CODECS[path, remembered]


def int_lists(parts: Sequence[np.ndarray]) -> pa.ListArray:
    cut = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    joined = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(joined))


def encode(df: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids, slice_offsets (bytes) and slice_first_ids for each row."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, remembered)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                ids, offsets, first = zip(*own.encode(binary_values(some.column(1))), strict=True)
                lists = [int_lists([np.frombuffer(x, "<i4") for x in ids]), int_lists(offsets), int_lists(first)]
                yield pa.RecordBatch.from_arrays([some.column(0), *lists], names=["doc_id", "ids", "slice_offsets", "slice_first_ids"])

    return rows.mapInArrow(thrifty_batches(run), f"doc_id long, {SCHEMA}")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with `decoded`, the bytes of the ids, each slice checked against its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                lists = []
                for c in (1, 2, 3):
                    column = some.column(c)
                    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                    lists.append([values[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                made = [own.decode(*x) for x in zip(*lists, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.binary())], names=[*some.schema.names, "decoded"])

    order = encoded.select("doc_id", "ids", "slice_offsets", "slice_first_ids")
    return order.mapInArrow(thrifty_batches(run), f"doc_id long, {SCHEMA}, decoded binary")
