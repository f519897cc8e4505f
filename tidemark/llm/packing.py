"""Packing by cutting-stock column generation.

Each document's ids, with an end id, are cut at multiples of the capacity; full pieces are sequences of their own,
and what is left of each document is packed whole. The lengths left over form a histogram of at most capacity - 1
rows. Over it a linear program chooses how often each pattern (a multiset of lengths that fits) is used: columns are
priced by a knapsack dynamic program over the duals until the program is proven within `gap` of its optimum. Counts
are rounded down, what remains is packed by largest-first patterns, and documents, ranked within each length, take the
patterns' places by rank. Ranks are a file's rank plus the counts of the files before it, so that a length that a
third of all documents share is ranked by as many tasks as any.

Defined results: a null text counts as empty (one piece, the end id); rows that repeat an id and a text are packed
each for itself; an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import thrifty_batches, written
from tidemark.llm.tokens import REMEMBERED, encoder

CAPACITY = 1024
END_ID = 0
GAP = 2e-3
ROWS = 500
PIECES = "part int, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, rank long, ids binary"


def largest_first(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern: from the longest down, as many of each length as there are left and fit."""
    pattern, space = np.zeros(len(lengths), np.int64), capacity
    for i in range(len(lengths) - 1, -1, -1):
        if left[i] > 0 and lengths[i] <= space:
            pattern[i] = min(int(left[i]), space // int(lengths[i]))
            space -= int(pattern[i] * lengths[i])
    return pattern


def best_pattern(lengths: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total dual (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if n:
            value = duals[:n] + best[c - lengths[:n]]
            i = int(np.argmax(value))
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(lengths[took[c]])
    return float(best[capacity]), pattern


def triangular_inverse(basis: np.ndarray, order: list[int]) -> np.ndarray:
    """Inverse of a basis whose column k has its last use of row order[k]: forward substitution, row by row.

    No call goes to a linear algebra library here or below: its threads may block in a process that also runs a JVM.
    """
    m = len(order)
    solved = np.zeros((m, m))
    for k, row in enumerate(order):
        used = np.flatnonzero(basis[row, :k])
        solved[k] = -(basis[row, used][:, None] * solved[used]).sum(axis=0)
        solved[k, k] += 1.0
        solved[k] /= basis[row, k]
    inverse = np.empty((m, m))
    inverse[:, order] = solved
    return inverse


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row exchange."""
    m = len(basis)
    both = np.concatenate([basis, np.eye(m)], axis=1)
    for k in range(m):
        r = k + int(np.abs(both[k:, k]).argmax())
        if r != k:
            both[[k, r]] = both[[r, k]]
        both[k] /= both[k, k]
        on = np.flatnonzero(both[:, k])
        on = on[on != k]
        both[on] -= both[on, k][:, None] * both[k]
    return both[:, m:]


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, refactor: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, a solution of the linear program within `gap` of its optimum.

    The first basis is that of the largest-first patterns over fractional counts: each uses up one length, so the
    matrix is triangular in that order and the basis feasible. Counts are raised by small amounts that differ from
    length to length, so that no two leave the basis at once and the program cannot cycle; the inverse is made anew
    every `refactor` steps. The caller fits whole numbers to the true counts.
    """
    m = len(lengths)
    wanted = counts + 1e-5 * (1 + np.arange(m)) / m
    basis, x, left, active, order = np.zeros((m, m)), np.zeros(m), wanted.copy(), np.ones(m, np.int64), []
    for k in range(m):
        pattern = largest_first(lengths, active * capacity, capacity)
        on = np.flatnonzero(pattern)
        i = on[np.argmin(left[on] / pattern[on])]
        x[k] = max(0.0, left[i] / pattern[i])
        left = np.maximum(0.0, left - x[k] * pattern)
        left[i], active[i] = 0.0, 0
        basis[:, k] = pattern
        order.append(int(i))
    inverse, least = triangular_inverse(basis, order), float((lengths * wanted).sum()) / capacity
    steps = 0
    while True:
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, np.maximum(duals, 0), capacity)
        bound = max(x.sum() / max(value, 1.0), least)
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            return basis.T.round().astype(np.int64), x
        on = np.flatnonzero(pattern)
        way = (inverse[:, on] * pattern[on]).sum(axis=1)
        can = way > 1e-9
        step = np.where(can, x / np.where(can, way, 1), np.inf)
        r = int(np.argmin(step))
        x = np.maximum(0.0, x - step[r] * way)
        x[r] = step[r]
        basis[:, r] = pattern
        steps += 1
        if steps % refactor == 0:
            inverse = inverse_of(basis)
            x = np.maximum(0.0, (inverse * wanted).sum(axis=1))
            continue
        row = inverse[r] / way[r]
        hit = np.flatnonzero(way)
        inverse[hit] -= way[hit, None] * row
        inverse[r] = row


def whole_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of times that use up the counts exactly."""
    if not len(lengths):
        return []
    patterns, x = column_generation(lengths, counts, capacity, gap)
    times, left, out = np.floor(x + 1e-6).astype(np.int64), counts.astype(np.int64).copy(), []
    for p, t in zip(patterns, times, strict=True):
        on = p > 0
        t = min(int(t), int((left[on] // p[on]).min())) if on.any() else 0
        if t > 0:
            out.append((p, t))
            left = left - p * t
    while left.any():
        p = largest_first(lengths, left, capacity)
        on = p > 0
        t = int((left[on] // p[on]).min())
        out.append((p, t))
        left = left - p * t
    return out


def pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of every document, with their ids, crc32 and rank among its task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part = encoder(tokenizer, remembered).encode, TaskContext.get().partitionId()
        seen, end, wide = np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some, out = batch.slice(lo, ROWS), []
                for key, raw in zip(some.column(0).to_pylist(), encode_all(some.column(1).to_pylist()), strict=True):
                    raw += end
                    for a in range(0, len(raw), wide):
                        ids = raw[a : a + wide]
                        n = len(ids) // 4
                        out.append((part, key, a // 4, n, len(raw) // 4, zlib.crc32(ids), int(seen[n]), ids))
                        seen[n] += 1
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(thrifty_batches(cut), PIECES)


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, gap: float = GAP, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian, 32 bits) for each piece."""
    cut = written(pieces(df, tokenizer, doc_id, text, capacity, end_id, remembered), "packing-pieces")
    spark = cut.sparkSession
    counted = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counted.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "packing-ranks")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    # places: for each length, ranks from `first` on belong to a pattern; at most a few thousand rows, whatever the input
    places, sequence, taken = [(capacity, 0, 1, 0, 0)], full, np.zeros(len(lengths), np.int64)
    for pattern, times in whole_patterns(lengths, counts, capacity, gap):
        offset = 0
        for i in np.flatnonzero(pattern)[::-1]:
            places.append((int(lengths[i]), int(taken[i]), int(pattern[i]), sequence, offset))
            offset += int(pattern[i] * lengths[i])
            taken[i] += times * pattern[i]
        sequence += times
    by_length: dict[int, list[tuple]] = {}
    for p in places:
        by_length.setdefault(p[0], []).append(p[1:])
    kind = "length int, places array<struct<first:long,each:long,sequence:long,offset:long>>"
    table = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], kind)
    ranked = cut.join(offsets.drop("n"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    put = ranked.join(F.broadcast(table), "length")
    at = F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1)
    put = put.withColumn("p", at).withColumn("k", F.col("rank") - F.col("p.first"))
    return put.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("p.sequence") + F.floor(F.col("k") / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset") + F.pmod(F.col("k"), F.col("p.each")) * F.col("length")).cast("long").alias("offset"),
        "ids",
    )


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id and ids, padded to the capacity unless their number is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.octet_length("ids") / 4
    exact = F.bit_count(n.cast("long")) == 1
    pad = F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (capacity - n).cast("int"))
    return joined.select("sequence_id", ids.alias("ids")).select("sequence_id", F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.unhex(pad))).alias("ids"))
