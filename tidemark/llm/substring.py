"""Substring dedup: word windows that occur anywhere else, found by difference-cover anchors.

A window of `size` words is repeated if its words also start at another place, in the same text or another. Anchors
are windows of `size - period + 1` words whose start, modulo `period`, lies in a difference cover: for any two starts
p and q some shift d < period brings both onto the cover, and the anchors at p + d and q + d lie in the two windows
and are equal. So each repeated window holds an anchor that occurs twice, and only 5 of 21 starts are hashed:

1. each block of documents sends the hashes of its anchors, distinct within the block, to buckets by hash, which
   answer with a bit for each: does it occur twice anywhere?
2. only windows around such anchors are extended to their full length: they go the same way with 128-bit hashes;
3. each block reads the answers and marks the words.

A block is a few MB of documents by a hash of the row with its text, so texts without an id, or under one id, lie in
many blocks; only rows equal in all kept columns and the text share one. Blocks, buckets and answers are the only groups. A hash that a
third of all rows holds is sent once by each block, so no bucket depends on how often a passage occurs.
Equal 128-bit hashes count as equal words.

Defined results: a null text has no words; a text shorter than `size` words keeps all; repeated rows count as
occurrences of each other, so they lose all words in full windows; null and repeated ids are kept as they are, with a
row for each; a text of any length lies in one block whole; no result depends on an order, so there are no ties;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_values, byte_words, parts_for, thrifty

SIZE = 35
#: A perfect difference set: every residue modulo 21 is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
BLOCK_BYTES = 4 << 20
BUCKET_HASHES = 1 << 19

_BITS = np.random.default_rng(20240229).integers(1, 2**63, 256 + 4, np.uint64)
_BYTE = _BITS[:256]
_STEP_BYTE, _STEP_WORD, _STEP_WORD_2, _SEED = (x | np.uint64(1) for x in _BITS[256:])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _spans(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of values[start:end] for each pair."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _powers(_inverse(base), len(values) + 1)[starts]


#: Bytes are hashed in pieces of so many, so that the work arrays (8 bytes for each byte) stay small.
CHUNK = 1 << 17
_UP, _DOWN = _powers(_STEP_BYTE, CHUNK), _powers(_inverse(_STEP_BYTE), CHUNK)


def _byte_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of the bytes flat[start:end] for each pair (both ascending)."""
    before = np.zeros((2, len(starts)), np.uint64)
    carry, scale = np.uint64(0), np.uint64(1)
    step = np.uint64(pow(int(_STEP_BYTE), CHUNK, 1 << 64))
    with np.errstate(over="ignore"):
        for lo in range(0, len(flat), CHUNK):
            part = _BYTE[flat[lo : lo + CHUNK]]
            part *= _UP[: len(part)]
            total = np.cumsum(part, dtype=np.uint64)
            total *= scale
            total += carry
            for k, places in enumerate((starts, ends)):
                i, j = np.searchsorted(places, [lo + 1, lo + len(part) + 1])
                before[k, i:j] = total[places[i:j] - lo - 1]
            carry, scale = total[-1], scale * step
        lift = _powers(np.uint64(pow(int(_inverse(_STEP_BYTE)), CHUNK, 1 << 64)), len(flat) // CHUNK + 1)
        return (before[1] - before[0]) * _DOWN[starts & (CHUNK - 1)] * lift[starts // CHUNK]


class Words:
    """The words of a block of texts as 64-bit hashes, without moving any of their bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        flat, self.starts, self.ends, self.first = byte_words(texts)
        self.hashes = _mixed(_byte_hashes(flat, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64) * _SEED)
        self.counts = np.diff(self.first)

    def starts_of(self, size: int) -> np.ndarray:
        """The word numbers at which a window of `size` words lies in one text."""
        ok = np.zeros(len(self.hashes) + 1, np.int32)
        has = self.counts >= size
        np.add.at(ok, self.first[:-1][has], 1)
        np.add.at(ok, self.first[:-1][has] + self.counts[has] - size + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[:-1])

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the anchors of windows of `size` words."""
        width = size - PERIOD + 1
        at = self.starts_of(width)
        within = at - np.repeat(self.first[:-1], self.counts)[at]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = at[cover[within % PERIOD]]
        return at, _mixed(_spans(self.hashes, _STEP_WORD, at, at + width))

    def windows(self, size: int, anchored: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the given anchors' starts."""
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(hit, anchored, 1)
        before = np.concatenate([[0], np.cumsum(hit)])
        at = self.starts_of(size)
        return at[before[at + PERIOD] > before[at]]

    def window_hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), [("hi", np.uint64), ("lo", np.uint64)])
        out["hi"] = _mixed(_spans(self.hashes, _STEP_WORD, at, at + size))
        out["lo"] = _mixed(_spans(_mixed(self.hashes ^ _SEED), _STEP_WORD_2, at, at + size))
        return out


def _asked(keys: np.ndarray, high: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; whether each occurs twice here; where each given key is among them; where each bucket begins."""
    distinct, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    first = (distinct if high is keys else distinct["hi"]) >> np.uint64(40)
    bucket = (first * np.uint64(buckets)) >> np.uint64(24)
    return distinct, n > 1, where, np.searchsorted(bucket, np.arange(buckets + 1))


def _questions(block: int, keys: np.ndarray, high: np.ndarray, buckets: int) -> pa.Table:
    distinct, twice, _, cut = _asked(keys, high, buckets)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    return pa.table(
        {
            "bucket": pa.array(full, pa.int64()),
            "block": pa.array(np.full(len(full), block), pa.int64()),
            "keys": pa.array([distinct[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
            "twice": pa.array([np.packbits(twice[cut[b] : cut[b + 1]]).tobytes() for b in full], pa.binary()),
        }
    )


def _answers(table: pa.Table, kind: np.dtype, name: str) -> pa.Table:
    """For each block that asked, a bit for each of its keys: it occurs twice somewhere."""
    parts = [np.frombuffer(k, kind) for k in table["keys"].to_pylist()]
    own = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)).astype(bool) for t, p in zip(table["twice"].to_pylist(), parts, strict=True)]
    keys = np.concatenate(parts)
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    found = (n > 1)[where] | np.concatenate(own)
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    # a key that one block alone holds twice is found there; one that two blocks hold is found by its count
    return pa.table(
        {
            "block": table["block"],
            "kind": pa.array([name] * len(parts), pa.string()),
            "bucket": table["bucket"],
            "found": pa.array([np.packbits(found[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        }
    )


def _told(answers: pa.Table, name: str, keys: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the given keys occur twice anywhere, from the answers of that kind."""
    distinct, _, where, cut = _asked(keys, high, buckets)
    found = np.zeros(len(distinct), bool)
    for kind, bucket, bits in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["found"].to_pylist(), strict=True):
        if kind == name:
            a, b = cut[bucket], cut[bucket + 1]
            found[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return found[where]


def row_block(rows: DataFrame, names: list[str], blocks: int) -> Column:
    """The block of a row by a hash of its columns (but maps) and its whole text."""
    hashed = [n for n in names if not rows.schema[n].dataType.typeName() == "map"]
    return F.pmod(F.xxhash64(*hashed, "text"), F.lit(blocks))


WIDE = np.dtype([("hi", np.uint64), ("lo", np.uint64)])


def repeated_spans(df: DataFrame, each, out: str, keep: list[str], text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """each(table, words, removed) for every block, with the schema `out`.

    table holds the columns `keep` (named c0, c1, ...) and `text` of a block's rows, words their Words, removed a
    boolean for each word: it lies in a repeated window.
    """
    if size < PERIOD:
        raise ValueError(f"windows must have {PERIOD} words at least")
    raw = F.col(f"`{text}`").cast("string")
    total = df.select(F.sum(F.octet_length(raw))).first()[0] or 0
    blocks = parts_for(total, block_bytes)
    anchor_buckets = parts_for(total // 25, BUCKET_HASHES)  # about a word in six bytes, an anchor for four words
    window_buckets = parts_for(total // 12, BUCKET_HASHES)
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], raw.alias("text"))
    rows = rows.withColumn("block", row_block(rows, names, blocks))
    asked = "bucket long, block long, keys binary, twice binary"
    answered = "block long, kind string, bucket long, found binary"

    def ask_anchors(table: pa.Table) -> pa.Table:
        words = Words(binary_values(table["text"]))
        keys = words.anchors(size)[1]
        return _questions(table["block"][0].as_py(), keys, keys, anchor_buckets)

    def ask_windows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            empty = np.zeros(0, WIDE)
            return _questions(0, empty, empty["hi"], window_buckets)
        words = Words(binary_values(docs["text"]))
        at, keys = words.anchors(size)
        begin = words.windows(size, at[_told(answers, "anchor", keys, keys, anchor_buckets)])
        found = words.window_hashes(size, begin)
        return _questions(docs["block"][0].as_py(), found, found["hi"], window_buckets)

    def mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(binary_values(docs["text"]))
        removed = np.zeros(len(words.hashes) + 1, np.int64)
        if answers.num_rows:
            at, keys = words.anchors(size)
            begin = words.windows(size, at[_told(answers, "anchor", keys, keys, anchor_buckets)])
            found = words.window_hashes(size, begin)
            begin = begin[_told(answers, "window", found, found["hi"], window_buckets)]
            np.add.at(removed, begin, 1)
            np.add.at(removed, begin + size, -1)
        return each(docs, words, np.cumsum(removed)[:-1] > 0)

    anchors = rows.select("block", "text", *names).groupBy("block").applyInArrow(lambda docs: thrifty(ask_anchors(docs)), asked)
    anchor_answers = anchors.groupBy("bucket").applyInArrow(lambda t: _answers(t, np.dtype(np.uint64), "anchor"), answered)
    by_block = rows.select("block", "text", *names).groupBy("block")
    windows = by_block.cogroup(anchor_answers.groupBy("block")).applyInArrow(lambda docs, answers: thrifty(ask_windows(docs, answers)), asked)
    window_answers = windows.groupBy("bucket").applyInArrow(lambda t: _answers(t, WIDE, "window"), answered)
    return by_block.cogroup(anchor_answers.union(window_answers).groupBy("block")).applyInArrow(lambda docs, answers: thrifty(mark(docs, answers)), out)


def digest_rows(docs: pa.Table, words: Words, removed: np.ndarray) -> pa.Table:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""
    shas, gone = [], []
    for k, raw in enumerate(words.texts):
        own = removed[words.first[k] : words.first[k + 1]]
        n = int(own.sum())
        parts = raw.split()
        if n:
            parts = [parts[i] for i in np.flatnonzero(~own)]
        gone.append(n)
        shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
    return pa.table({"doc_id": docs["c0"].cast(pa.int64()), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def kept_texts(words: Words, removed: np.ndarray) -> list[str]:
    """Each text without its removed words and the blanks behind them; unchanged where nothing is removed."""
    out = []
    offset = 0
    for k, raw in enumerate(words.texts):
        a, b = words.first[k], words.first[k + 1]
        own = removed[a:b]
        if own.any():
            starts = np.concatenate([words.starts[a:b] - offset, [len(raw)]])
            edges = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
            raw = b"".join([raw[: starts[0]], *(raw[starts[i] : starts[j]] for i, j in zip(edges[::2], edges[1::2], strict=True))])
        out.append(raw.decode())
        offset += len(words.texts[k]) + 1
    return out


def dedup(df: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """All columns of df, with repeated windows cut out of `text` (null becomes empty)."""
    keep = [c for c in df.columns if c != text]

    def cut(docs: pa.Table, words: Words, removed: np.ndarray) -> pa.Table:
        columns = {f"c{i}": docs[f"c{i}"] for i in range(len(keep))}
        return pa.table(columns | {"text": pa.array(kept_texts(words, removed), pa.string())})

    kinds = dict(df.dtypes)
    out = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(keep)], "text string"])
    found = repeated_spans(df, cut, out, keep, text, size)
    return found.select(*[F.col("text" if c == text else f"c{keep.index(c)}").alias(c) for c in df.columns])


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row."""
    return repeated_spans(df, digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string", [doc_id], text, size)
