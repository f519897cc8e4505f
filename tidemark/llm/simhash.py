"""SimHash near-duplicates: fingerprints of word shingles, an exact tiled comparison, connected components.

Fingerprints: see `fingerprints` (64 bits) and `sketches` (256 bits of the distinct shingles, for a given similarity).
Comparison: distinct fingerprints are sorted by counts that near ones must share nearly (the population counts of the
fingerprint's parts, the number of shingles) and cut into tiles. A pair of tiles is skipped when the counts of any two
of their members differ too much (each differing bit changes one part's count by one), and the rest are compared by
numpy exclusive-or and bit counts. Neighbouring tiles form groups; a task holds a pair of groups, so a tile is sent once
to each task, not once to each pair. Within a task only a spanning forest of the links is emitted, so that a group of n
near copies costs O(n) rows, not O(n^2). Components come from alternating large-star and small-star steps over
tables in the shared folder.

The comparison looks at all pairs that the counts allow: its time grows with the square of the distinct texts, by
definition of the method; memory of a task, and rows emitted, do not.

Defined results: a null text counts as empty; texts without words get fingerprint zero and link like any other; texts of
any length are read whole; equal fingerprints always link; rows that repeat an id and a text yield a row each; null ids
yield rows, and count as the smallest of a component only if it has no other; ties of ids go to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_values, drop_path, new_path, parts_for, thrifty, thrifty_batches, written

SEED = 42
SHINGLE = 4
RADIUS = 4
TILE = 8192
GROUP = 4
#: A tile that holds shingle sets, 8 bytes each, has about so many.
TILE_SHINGLES = 1 << 17
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Near:
    """When fingerprints of `width` 64-bit words are candidates: at most `radius` bits differ, of the first `head` words at most `head_radius`.

    bounds: for a range of the counts' columns, how far two rows' counts may lie apart in sum. Links of at most `sure`
    bits go into the forest before all others.
    """

    width: int
    radius: int
    head: int
    head_radius: int
    sure: int
    bounds: tuple[tuple[int, int, int], ...]

    @property
    def columns(self) -> int:
        return max(b for _, b, _ in self.bounds)


def by_radius(radius: int) -> Near:
    """64-bit fingerprints; the counts are those of their four 16-bit quarters."""
    return Near(1, radius, 1, radius, radius, ((0, 4, radius),))


#: Similarity 0.8 and more, by 256 bits. Two sets of Jaccard similarity 0.8 differ in a share arccos(8 / 9) / pi = 0.1515 of
#: their bits, 38.8 of 256. More than 68 come with a probability of 1e-6 (normal: 5.1 deviations), more than 44 of the first
#: 128 with 1e-8; closer pairs are missed less. Unrelated texts differ in 128 and come within 68 with 3e-14. The counts are the
#: number of shingles (128 steps for a factor of two; a factor of 1.25 is 41.2 steps) and the population count.
FOUR_FIFTHS = Near(4, 68, 2, 44, 39, ((0, 1, 43), (1, 2, 68)))
#: A pair is verified if its shingle sets have a similarity of at least ENOUGH[0] / ENOUGH[1].
ENOUGH = (4, 5)
WIDE_SHINGLE = 5
_KEYS = np.random.default_rng(SEED).integers(0, 2**63, 4, np.uint64)


def shingle_hashes(words: list[bytes], flat: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; `flat` is the words joined by one space. Few words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    return np.array([digest(flat[a:b], SEED) for a, b in zip(begin, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words: the bits that over half of the rows have."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for lo in range(0, len(h), 255 * 32):
        bits = np.unpackbits(np.ascontiguousarray(h[lo : lo + 255 * 32]).view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
        if whole:
            ones += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def simhash_values(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each UTF-8 text."""
    out = np.zeros(len(texts), np.uint64)
    for k, raw in enumerate(texts):
        words = raw.translate(LOWER).split()
        if words:
            out[k] = majority(shingle_hashes(words, b" ".join(words), shingle)[:, None])[0]
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the 64-bit SimHash as a signed long, for each row.

    A-Z are lowered; shingles are of `shingle` words, joined by one space, repeats included (a shorter text is one
    shingle); a bit is set if over half of the shingles' XXH64 (seed 42) have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash_values(binary_values(b.column(1)), shingle).view(np.int64))], names=["doc_id", "fp"])

    kept = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return kept.mapInArrow(thrifty_batches(run), "doc_id long, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(df: DataFrame, row_key: str = "row_key", text: str = "text") -> DataFrame:
    """row_key, node (a hash of the lowered words), counts and fp (256 bits, of the distinct five-word shingles) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                nodes, sizes, prints = [], [], np.zeros((b.num_rows, 4), np.uint64)
                for k, raw in enumerate(binary_values(b.column(1))):
                    words = raw.translate(LOWER).split()
                    flat = b" ".join(words)
                    nodes.append(xxhash.xxh64_intdigest(flat, SEED + 1))
                    h = np.unique(shingle_hashes(words, flat, WIDE_SHINGLE))
                    sizes.append(len(h))
                    if len(h):
                        prints[k] = majority(_mixed(h[:, None] ^ _KEYS))
                pops = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
                steps = np.round(128 * np.log2(np.maximum(sizes, 1))).astype(np.int64)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * 2, pa.int32()), pa.array(np.stack([steps, pops], axis=1).ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), counts, pa.array([p.tobytes() for p in prints], pa.binary())], names=["row_key", "node", "counts", "fp"])

    return df.select(F.col(f"`{row_key}`").cast("long").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(thrifty_batches(run), "row_key long, node long, counts array<int>, fp binary")


def quarters(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four 16-bit quarters of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int64)


class Tile:
    """Rows of distinct nodes: fingerprints (a row for each of their words), counts, roots, and the place of the first row in its task."""

    def __init__(self, row: dict, near: Near, at: int) -> None:
        self.number, self.at = row["tile"], at
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.fp = np.frombuffer(row["fps"], np.uint64).reshape(near.width, -1)
        self.counts = np.frombuffer(row["counts"], np.int32).reshape(-1, near.columns)
        self.roots = np.frombuffer(row["roots"], np.int64)
        self.shingles, self.sizes = np.frombuffer(row["shingles"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.low, self.high = self.counts.min(axis=0), self.counts.max(axis=0)

    def gap_allows(self, low: np.ndarray, high: np.ndarray, near: Near) -> bool:
        gap = np.maximum(0, np.maximum(low - self.high, self.low - high))
        return all(gap[a:b].sum() <= most for a, b, most in near.bounds)

    def columns(self, low: np.ndarray, high: np.ndarray, near: Near) -> np.ndarray:
        """The rows that counts between low and high allow."""
        gap = np.maximum(0, np.maximum(low - self.counts, self.counts - high))
        ok = gap[:, near.bounds[0][0] : near.bounds[0][1]].sum(axis=1) <= near.bounds[0][2]
        for a, b, most in near.bounds[1:]:
            ok &= gap[:, a:b].sum(axis=1) <= most
        return np.flatnonzero(ok)


def near_pairs(a: Tile, b: Tile, near: Near, blocks: Iterator[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a's rows: its first row, and row, row of b and distance of each pair near enough (each pair once)."""
    same = a.number == b.number
    step = max(1, 1 << 18 >> max(0, int(len(b.nodes)).bit_length()))
    for lo in range(0, len(a.nodes), step) if blocks is None else blocks:
        low, high = a.counts[lo : lo + step].min(axis=0), a.counts[lo : lo + step].max(axis=0)
        if not b.gap_allows(low, high, near):
            continue
        cols = b.columns(low, high, near)
        if same:
            cols = cols[cols > lo]
        if not len(cols):
            continue
        d = np.bitwise_count(a.fp[0, lo : lo + step, None] ^ b.fp[0, cols])
        for w in range(1, near.head):
            d += np.bitwise_count(a.fp[w, lo : lo + step, None] ^ b.fp[w, cols])
        i, j = np.nonzero(d <= near.head_radius)
        d = d[i, j].astype(np.int64)
        i, j = i + lo, cols[j]
        for w in range(near.head, near.width):
            d += np.bitwise_count(a.fp[w, i] ^ b.fp[w, j])
        ok = d <= near.radius
        if same:
            ok &= j > i
        if ok.any():
            yield lo, i[ok], j[ok], d[ok]


def laid_out(rows_of_a: list[dict], rows_of_b: list[dict], near: Near) -> tuple[list[tuple[Tile, Tile]], list[Tile], int]:
    """The pairs of tiles that may hold near rows, each once; all tiles; how many rows they have."""
    at, tiles = 0, {}
    for r in [*rows_of_a, *rows_of_b]:
        if r["tile"] not in tiles:
            tiles[r["tile"]] = Tile(r, near, at)
            at += len(tiles[r["tile"]].nodes)
    pairs = [(tiles[a], tiles[b]) for a in sorted({r["tile"] for r in rows_of_a}) for b in sorted({r["tile"] for r in rows_of_b}) if a <= b]
    return [(a, b) for a, b in pairs if a.gap_allows(b.low, b.high, near)], list(tiles.values()), at


class Forest:
    """Links between rows of different trees; each joins its two trees."""

    def __init__(self, label: np.ndarray) -> None:
        self.label, self.links = label, [np.zeros((0, 2), np.int64)]

    def join(self, a: Tile, r: int, b: Tile, js: np.ndarray) -> None:
        """Links row r of a with those of the rows js of b that are in other trees, one of each."""
        own = self.label[a.at + r]
        other, first = np.unique(self.label[b.at + js], return_index=True)
        use = other != own
        if use.any():
            self.links.append(np.stack([np.full(use.sum(), a.nodes[r]), b.nodes[js[first[use]]]], axis=1))
            self.label[np.isin(self.label, other[use])] = own

    def apart(self, a: Tile, i: np.ndarray, b: Tile, j: np.ndarray) -> np.ndarray:
        return self.label[a.at + i] != self.label[b.at + j]


def forest_links(rows_of_a: list[dict], rows_of_b: list[dict], near: Near) -> np.ndarray:
    """A spanning forest (u, v) of all pairs near enough between two groups of tiles (of one, if they are the same)."""
    pairs, _, n = laid_out(rows_of_a, rows_of_b, near)
    forest = Forest(np.arange(n))
    again: list[tuple[Tile, Tile, list[int]]] = []
    for a, b in pairs:
        later = []
        for lo, i, j, d in near_pairs(a, b, near):
            sure = d <= near.sure
            for r in np.unique(i[sure]).tolist():
                forest.join(a, r, b, j[sure & (i == r)])
            if not sure.all():
                later.append(lo)
        if later:
            again.append((a, b, later))
    for a, b, later in again:
        for _, i, j, _ in near_pairs(a, b, near, iter(later)):
            apart = forest.apart(a, i, b, j)
            for r in np.unique(i[apart]).tolist():
                forest.join(a, r, b, j[apart & (i == r)])
    return np.concatenate(forest.links)


def verified_links(rows_of_a: list[dict], rows_of_b: list[dict], near: Near) -> np.ndarray:
    """A forest (u, v) over the rows' roots: every candidate pair of different roots is verified by its shingle sets, unless links found before already join them."""
    pairs, tiles, _ = laid_out(rows_of_a, rows_of_b, near)
    forest = Forest(np.unique(np.concatenate([t.roots for t in tiles]), return_inverse=True)[1])
    distinct, codes = np.unique(np.concatenate([t.shingles for t in tiles]), return_inverse=True)
    sizes = np.concatenate([t.sizes for t in tiles])
    ends = np.cumsum(sizes)
    mine = np.zeros(len(distinct), bool)
    for a, b in pairs:
        for _, i, j, _ in near_pairs(a, b, near):
            apart = forest.apart(a, i, b, j)
            for r in np.unique(i[apart]).tolist():
                js = j[apart & (i == r)]
                js = js[forest.label[b.at + js] != forest.label[a.at + r]]
                js = js[sizes[b.at + js] > 0]
                if not len(js) or not sizes[a.at + r]:
                    continue
                own = codes[ends[a.at + r] - sizes[a.at + r] : ends[a.at + r]]
                mine[own] = True
                common = np.array([np.count_nonzero(mine[codes[ends[x] - sizes[x] : ends[x]]]) for x in (b.at + js).tolist()])
                mine[own] = False
                forest.join(a, r, b, js[common * (ENOUGH[0] + ENOUGH[1]) >= (len(own) + sizes[b.at + js]) * ENOUGH[0]])
    return np.concatenate(forest.links)


def tile_links(rows: DataFrame, n_tiles: int, near: Near) -> DataFrame:
    """Links (u, v) of the rows (node, counts, fp as binary): `forest_links`; with root and shingles (distinct hashes), too: `verified_links`."""
    with_sets = "shingles" in rows.columns
    if not with_sets:
        rows = rows.withColumns({"root": F.col("node"), "shingles": F.array().cast("array<long>")})
    keys = [F.get("counts", F.lit(i)) for i in range(near.columns)]
    ordered = rows.select("node", "counts", "fp", "root", "shingles").repartitionByRange(n_tiles, *keys, "node")

    def as_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            counts = np.array(t["counts"].combine_chunks().flatten(), np.int32).reshape(t.num_rows, -1)
            order = np.lexsort([t["node"].to_numpy(), *counts.T[::-1]])
            counts = counts[order]
            prints = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(t.num_rows, -1)[order]
            number = TaskContext.get().partitionId()
            low, high = (pa.array([x.tolist()], pa.list_(pa.int32())) for x in (counts.min(axis=0), counts.max(axis=0)))
            sets = t["shingles"].combine_chunks().take(pa.array(order))
            sizes = np.diff(sets.offsets.to_numpy())
            data = (t["node"].to_numpy()[order], t["root"].to_numpy()[order], counts, prints.T, sets.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64))
            binary = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([number // GROUP]), low, high, *binary], names=["tile", "grp", "low", "high", *names[1:]])

    names = ["tile", "nodes", "roots", "counts", "fps", "shingles", "sizes"]

    tiles = written(ordered.mapInArrow(thrifty_batches(as_tile), f"tile long, grp long, low array<int>, high array<int>, {', '.join(f'{n} binary' for n in names[1:])}"), "simhash-tiles")
    # tiles meet where their first counts' bands are equal or next to each other: an equi-join
    wide = near.bounds[0][2] + 1
    bands = lambda more: F.explode(F.sequence(F.floor(F.get("low", F.lit(0)) / wide) - more, F.floor(F.get("high", F.lit(0)) / wide) + more))
    box = tiles.select("grp", "tile", "low", "high")
    left = box.select(F.col("grp").alias("ga"), F.col("tile").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"), bands(0).alias("band"))
    right = box.select(F.col("grp").alias("gb"), F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"), bands(1).alias("band"))
    meets = F.col("ta") <= F.col("tb")
    for a, b, most in near.bounds:
        gap = F.aggregate(F.sequence(F.lit(a), F.lit(b - 1)), F.lit(0), lambda s, k: s + F.greatest(F.lit(0), F.get("la", k) - F.get("hb", k), F.get("lb", k) - F.get("ha", k)))
        meets = meets & (gap <= most)
    work = written(left.join(right, "band").where(meets).select("ga", "gb").distinct(), "simhash-work")

    def side(mine: str, tag: str) -> DataFrame:
        """The tiles of each pair's group `mine`; names of their own, so that Spark can tell the sides apart."""
        pairs = work.select(F.col("ga").alias(f"ga{tag}"), F.col("gb").alias(f"gb{tag}"))
        return pairs.join(tiles.select(F.col("grp").alias(f"{mine}{tag}"), *[F.col(n).alias(f"{n}{tag}") for n in names]), f"{mine}{tag}")

    def compare(of_a: pa.Table, of_b: pa.Table) -> pa.Table:
        rows = [[dict(zip(names, r, strict=True)) for r in zip(*[t[f"{n}{tag}"].to_pylist() for n in names], strict=True)] for t, tag in ((of_a, "1"), (of_b, "2"))]
        links = (verified_links if with_sets else forest_links)(*rows, near)
        return pa.table({"u": pa.array(links[:, 0]), "v": pa.array(links[:, 1])})

    return side("ga", "1").groupBy("ga1", "gb1").cogroup(side("gb", "2").groupBy("ga2", "gb2")).applyInArrow(lambda a, b: thrifty(compare(a, b)), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (u, v) of longs: root is the smallest node of its component.

    Rounds go on until the edges no longer change (their number is about the logarithm of a component's width). Each
    round writes its edges in the shared folder; the folder of the round before it is then deleted.
    """
    spark = edges.sparkSession

    def save(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "components")
        df.write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before: tuple | None = None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour of u goes to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).distinct()
        old = path
        path, now = save(small)
        drop_path(spark, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Rows of one component are spread over so many keys where they meet their component's row.
SALTS = 32


def with_root_values(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (node, root, ...) with `name`, the least `value` of each root's rows; large components are spread over SALTS keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("root").agg(F.min(value).alias(name)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(least, ["root", "salt"]).drop("salt")


def linked_fingerprints(distinct: DataFrame, total: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct 64-bit fingerprints (a column `fp`) at most `radius` bits apart, enough of them to connect all that are linked."""
    bits = F.array(*[F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)])
    raw = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # only differing bits are counted, so the order of bytes is free
    return tile_links(distinct.select(F.col("fp").alias("node"), bits.alias("counts"), raw.alias("fp")), parts_for(total, tile), by_radius(radius))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id that can be reached over links, for each row of df."""
    prints = written(fingerprints(df, doc_id, text), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    comp = written(components(linked_fingerprints(distinct, distinct.count(), radius, tile)), "simhash-components")
    # only what is linked meets its component; all else is its own
    linked_prints = comp.join(distinct.withColumnRenamed("fp", "node"), "node")
    named = with_root_values(linked_prints, F.col("least_id"), "component_id").select(F.col("node").alias("fp"), "component_id")
    by_print = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def shingles_of(df: DataFrame) -> DataFrame:
    """node and shingles (an array of distinct hashes) for each row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = []
                for raw in binary_values(part.column(1)):
                    words = raw.translate(LOWER).split()
                    sets.append(np.unique(shingle_hashes(words, b" ".join(words), WIDE_SHINGLE)).view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    return df.select("node", "text").mapInArrow(thrifty_batches(run), "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    counted = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return counted.where(F.col("common") * (ENOUGH[0] + ENOUGH[1]) >= F.col("total") * ENOUGH[0]).select("u", "v")


def near_texts(df: DataFrame, row_key: str = "row_key", text: str = "text", tile: int = TILE) -> DataFrame:
    """row_key (a long, equal for equal rows only) and group, a number for each component of texts of similarity 0.8 or more, for each row of df.

    Links are pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, verified by the whole sets.
    Candidates come from the tiled comparison of 256-bit fingerprints (`FOUR_FIFTHS`). A spanning forest of the candidates
    is verified first. Where all of a tree's links hold, its texts are one group and no further pair is looked at; the
    texts of the other trees are compared again in tiles that hold their shingle sets: every candidate pair between two of
    their groups is verified in its task, and again only a forest is emitted.

    Defined results: A-Z are lowered; a text of less than five words is one shingle; texts of equal words are one group
    (so are null, empty and blank texts); texts without anything near are their own group.
    """
    drawn = written(sketches(df, row_key, text), "near-sketches")
    distinct = written(drawn.groupBy("node").agg(F.min_by(F.struct("counts", "fp", "row_key"), "row_key").alias("r")).select("node", "r.*"), "near-distinct")
    forest = written(tile_links(distinct.select("node", "counts", "fp"), parts_for(distinct.count(), tile), FOUR_FIFTHS), "near-forest")
    asked = forest.select(F.col("u").alias("node")).union(forest.select("v")).distinct().join(distinct.select("node", "row_key"), "node")
    texts = df.select(F.col(f"`{row_key}`").cast("long").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text")).join(asked, "row_key")
    sets = written(shingles_of(texts).dropDuplicates(["node"]), "near-sets")
    held = written(verified(forest, sets), "near-held")
    roots = written(components(held), "near-roots")
    refuted = written(forest.join(held, ["u", "v"], "left_anti"), "near-refuted")
    named = roots
    if not refuted.isEmpty():
        trees = written(components(forest), "near-trees")
        broken = refuted.select(F.col("u").alias("node")).join(trees, "node").select("root").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        in_broken = trees.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(broken, ["root", "salt"], "left_semi").select("node")
        rooted = in_broken.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        open_ = written(rooted.join(distinct.select("node", "counts", "fp"), "node").join(sets, "node"), "near-open")
        held_shingles = open_.agg(F.sum(F.size("shingles"))).first()[0] or 0
        links = tile_links(open_, parts_for(held_shingles, TILE_SHINGLES), FOUR_FIFTHS)
        root_of = open_.select("node", "root")
        links = links.join(root_of.toDF("u", "ru"), "u").join(root_of.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        joined = written(components(links).toDF("root", "top"), "near-joined")
        lone = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        named = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(lone)
    return drawn.select("row_key", "node").join(named, "node", "left").select("row_key", F.coalesce("root", "node").alias("group"))


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
