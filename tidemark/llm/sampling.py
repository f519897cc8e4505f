"""SentencePiece segmentations: Gumbel top-k samples without replacement over the lattice, and decoding.

A text (spaces as the mark U+2581, one put before it) has a lattice of all ways to cut it into pieces of the vocabulary; a character
that no piece covers is its UTF-8 bytes as byte pieces. A cut's probability is in proportion to the product of its
pieces' weights, 1 / (2 + rank in the vocabulary) ** sharpness, summed over all cuts exactly by a backward pass. No
piece reaches over the start of a word, so words' lattices are independent and each distinct word is built once for a
batch.

Samples without replacement: the whole set of cuts gets the largest of their Gumbel-perturbed log-probabilities at
once, a Gumbel value at log 1. The search keeps sets of cuts, each with its largest perturbed value and ordered by it.
The best set is taken, the cut that attains its value is drawn from it (edge by edge, in proportion to the backward
sums), and what remains is split: for each place of that cut, the cuts that agree before it and take another edge
there. Each part's own largest value is a Gumbel at the log of its mass, held below the value just taken. The first k
cuts taken are the k largest perturbed ones of all cuts (A* over a Gumbel process), so they are distinct. With the
(k+1)-th value kappa, a cut of log-probability p was included with probability 1 - exp(-exp(p - kappa)).

All random numbers are hashes of (seed, row key, draw number): the same row gives the same samples on any cluster.

Defined results: a null or empty text has one cut without pieces (log-probability 0, included surely); rows that
repeat a key and a text give equal samples; a text with fewer than k cuts gives them all; an empty table gives no
samples; further columns are not read; null keys count as 0 for the random numbers; texts of any length are read whole;
of cuts with equal perturbed values (a chance of 2^-53) the one found first is taken.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SAMPLES = 4
#: A worker keeps the lattices of the first words it meets, up to so many edges of about 50 bytes, for so much text.
KEPT_EDGES = 1_500_000
FORGET_CHARS = 1 << 27
END = -1
#: Letters of the dense table of next nodes, and one for all others.
LETTERS = 96
BATCH_CHARS = 1 << 19


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over code points, and their log-weights."""

    def __init__(self, path: str, sharpness: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        step: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        self.longest = 1
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {i} reaches over the start of a word")
            at = 0
            for c in p:
                key = (at, ord(c))
                if key not in step:
                    step[key] = nodes
                    nodes += 1
                at = step[key]
            ends[at] = i
            self.longest = max(self.longest, len(p))
        # nodes that have a next node are numbered first; the letters with most edges have a dense table of next nodes
        inner = np.unique(np.array([a for a, _ in step], np.int64))
        number = np.full(nodes, -1, np.int64)
        number[inner] = np.arange(len(inner))
        number[number < 0] = np.arange(len(inner), nodes)
        begin, char, then = (np.array(x, np.int64) for x in ([number[a] for a, _ in step], [c for _, c in step], [number[x] for x in step.values()]))
        self.inner = len(inner)
        self.end = np.full(nodes, -1, np.int32)
        self.end[number[list(ends)]] = list(ends.values())
        letters, count = np.unique(char, return_counts=True)
        dense = letters[np.argsort(-count, kind="stable")[: LETTERS - 1]]
        self.letter = np.zeros(0x110000, np.uint8)
        self.letter[dense] = np.arange(1, len(dense) + 1)
        self.table = np.full(self.inner * LETTERS, -1, np.int32)
        self.table[begin * LETTERS + self.letter[char]] = np.where(self.letter[char] > 0, then, -1)
        self.table[::LETTERS] = -1
        order = np.argsort(begin << 21 | char)
        self.keys, self.next = (begin << 21 | char)[order], then[order].astype(np.int32)
        self.weight = -sharpness * np.log(np.arange(n) + 2.0)
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, n)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of an inner one, or -1."""
        letter = self.letter[char]
        found = self.table[node * LETTERS + letter]
        rare = np.flatnonzero(letter == 0)
        if len(rare):
            key = node[rare].astype(np.int64) << 21 | char[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[rare] = np.where(self.keys[at] == key, self.next[at], -1)
        return found

    def spelt(self, char: int) -> list[int]:
        """The byte pieces of a character that is no piece."""
        return [int(self.bytes[b]) for b in chr(char).encode("utf-8", "surrogatepass")]

    def with_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The ids with characters of several bytes, numbered below zero, as byte pieces."""
        spelt = {x: self.spelt(-1 - x) for x in np.unique(ids[ids < 0]).tolist()}
        n = np.ones(len(ids), np.int64)
        for x, own in spelt.items():
            n[ids == x] = len(own)
        out, at = np.repeat(ids, n), np.cumsum(n) - n
        for x, own in spelt.items():
            for k, i in enumerate(own):
                out[at[ids == x] + k] = i
        return out

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the pieces, one after the other, and how many each has."""
        n = self.raw_size[ids]
        source = np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n)
        source += np.arange(len(source))
        return self.raw[source], n


class Lattice:
    """The lattices of distinct words. Places are numbered by their distance from their word's end, `end` is behind the
    last ones; edges are grouped by the place they leave."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]) -> None:
        v = vocabulary
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = self.end = len(chars)
        self.first_char = np.cumsum(sizes) - sizes
        left = np.repeat(self.first_char + sizes, sizes) - np.arange(n)
        longest = int(left.max()) if n else 0
        left = left.astype(np.uint16 if longest < 1 << 16 else np.int32)
        self.char = np.argsort(left, kind="stable").astype(np.int32)
        left = left[self.char]
        place = np.empty(n, np.int32)
        place[self.char] = np.arange(n, dtype=np.int32)
        cuts = np.searchsorted(left, np.arange(1, longest + 2))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, node = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        for k in range(min(v.longest, longest)):
            if k:
                near = np.searchsorted(at, cuts[k])  # these end before
                at, node = at[near:], node[near:]
            if not len(at):
                break
            node = v.follow(node, chars[self.char[at] + k])
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            piece = v.end[node]
            full = np.flatnonzero(piece >= 0)
            found.append((at[full], piece[full]))
            on = np.flatnonzero(node < v.inner)
            at, node = at[on], node[on]
        # a character that is no piece is its bytes, as one edge; those of several bytes are numbered below zero
        count = np.zeros(n, np.int32)
        if found:
            count[found[0][0]] = 1
        bare = np.flatnonzero(count == 0)
        code = chars[self.char[bare]]
        count[bare] = 1
        for begin, _ in found[1:]:
            count[begin] += 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.to, self.piece, weight = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32), np.empty(self.first[-1])
        free = self.first[:-1].copy()  # the next free edge of each place
        after = np.concatenate([place, [n]])

        def behind(begin: np.ndarray, k: int) -> np.ndarray:
            return np.where(left[begin] == k, n, after[self.char[begin] + k])

        spelt_weight = {-1 - c: float(v.weight[v.spelt(c)].sum()) for c in np.unique(code).tolist()}
        self.to[free[bare]], self.piece[free[bare]] = behind(bare, 1), np.where(code < 128, v.bytes[np.minimum(code, 127)], -1 - code)
        weight[free[bare]] = [spelt_weight[c] for c in (-1 - code).tolist()]
        free[bare] += 1
        for k, (begin, ids) in enumerate(found):
            e = free[begin]
            self.to[e], self.piece[e], weight[e] = behind(begin, k + 1), ids, v.weight[ids]
            free[begin] += 1
        # backward sums: beta of a place is the log of all ways from it to its word's end
        beta = np.zeros(n + 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = self.first[a], self.first[b]
            group = self.first[a:b] - lo
            score = weight[lo:hi]  # in place: the share, once the sum is known
            score += beta[self.to[lo:hi]]
            top = np.maximum.reduceat(score, group)
            ways = count[a:b]
            score -= np.repeat(top, ways)
            total = np.log(np.add.reduceat(np.exp(score), group))
            score -= np.repeat(total, ways)
            beta[a:b] = total + top
        share = weight
        # the likeliest edge of each place comes first: most draws stop at it
        self.leaves = np.repeat(np.arange(n, dtype=np.int32), count)
        if len(share):
            best = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, self.first[:-1]), count))
            best = best[np.concatenate([[True], self.leaves[best[1:]] != self.leaves[best[:-1]]])]
            head = self.first[:-1]
            for x in (self.to, self.piece, share):
                x[head], x[best] = x[best], x[head].copy()
        # multiples of 2^-30, and shares as whole numbers: sums are exact, so a text's samples do not depend on its batch
        self.log_p = np.round(share * 2.0**30) * 2.0**-30
        self.p = np.exp(self.log_p)
        whole = np.round(self.p * 2.0**40).astype(np.int64)
        self.up_to = np.cumsum(whole)
        self.start_of_word = place[self.first_char] if n else self.first_char
        self.size_of_word = sizes
        self.within = self.char - np.repeat(self.first_char, sizes)[self.char].astype(np.int32)
        self.follow_likeliest()

    def follow_likeliest(self) -> None:
        """Each word's likeliest way on: its edges and, before each and at the end, the probability of leaving it later."""
        n_words = len(self.size_of_word)
        word, at = np.arange(n_words), self.start_of_word
        steps = []
        while len(word):
            e = self.first[at]
            steps.append((word, e))
            at = self.to[e]
            on = np.flatnonzero(at != self.end)
            word, at = word[on], at[on]
        self.way_n = np.zeros(n_words, np.int64)
        for w, _ in steps:
            self.way_n[w] += 1
        begin = np.cumsum(self.way_n + 1) - self.way_n - 1
        self.way, self.leave = np.zeros(int((self.way_n + 1).sum()), np.int32), np.zeros(int((self.way_n + 1).sum()))
        rest = np.zeros(n_words)
        for i in range(len(steps) - 1, -1, -1):
            w, e = steps[i]
            rest[w] += self.log_p[e]
            self.way[begin[w] + i] = e
            self.leave[begin[w] + i] = -np.expm1(rest[w])
        self.way_at, self.way_log, self.way_p = begin, rest, np.exp(rest)


class Lattices:
    """The lattices of all words of a batch of texts, in one numbering of places and edges; `END` follows a word's last edge.

    The first words that a worker meets, up to KEPT_EDGES, stay; those of later batches are laid behind them and make
    room for the next batch's. After FORGET_CHARS of text it begins anew.
    """

    #: Per edge: the place after it, its piece, log-probability, probability, running sum of whole shares, place before it.
    EDGES = {"to": np.int32, "piece": np.int32, "log_p": np.float64, "p": np.float64, "up_to": np.int64, "leaves": np.int32}
    #: Per place: its first edge, its character's number in its word, the probability of its first edge.
    PLACES = {"first": np.int64, "within": np.int32, "likeliest": np.float64}
    #: Of the words' likeliest ways: edges, with one more for each word, and the probabilities of leaving them.
    WAYS = {"way": np.int32, "leave": np.float64}
    #: Per word.
    WORDS = {"start_of_word": np.int32, "size_of_word": np.int64, "way_at": np.int64, "way_n": np.int64, "way_log": np.float64, "way_p": np.float64}

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.room = {n: np.zeros(1 << 16, kind) for n, kind in (self.EDGES | self.PLACES | self.WAYS | self.WORDS).items()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.kept = (0, 0, 0, 0)  # places, edges, entries of ways, sum of whole shares
        self.chars = 0

    def put(self, at: int, **values: np.ndarray) -> None:
        for name, x in values.items():
            if len(self.room[name]) < at + len(x):
                more = np.zeros((at + len(x)) * 5 // 4, self.room[name].dtype)
                more[:at] = self.room[name][:at]
                self.room[name] = more
            self.room[name][at : at + len(x)] = x

    def codes(self, words: list[str]) -> np.ndarray:
        """A number for each word; the lattices of words not known are built."""
        if self.chars > FORGET_CHARS:
            self.clear()
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        distinct = distinct.tolist()
        number = [self.known.get(w, -1) for w in distinct]
        new = [w for w, i in zip(distinct, number, strict=True) if i < 0]
        self.chars += sum(map(len, words))
        places, edges, ways, total = self.kept
        words_kept = len(self.known)
        built = Lattice(self.vocabulary, new)
        n, m = built.end, len(built.to)
        self.put(edges, to=np.where(built.to == n, END, built.to + places), piece=built.piece, log_p=built.log_p, p=built.p, up_to=built.up_to + total, leaves=built.leaves + places)
        self.put(places, first=built.first + edges, within=built.within, likeliest=built.p[built.first[:-1]])
        self.put(ways, way=built.way + np.int32(edges), leave=built.leave)
        self.put(words_kept, start_of_word=built.start_of_word + places, size_of_word=built.size_of_word, way_at=built.way_at + ways, way_n=built.way_n, way_log=built.way_log, way_p=built.way_p)
        for name, room in self.room.items():
            setattr(self, name, room)
        self.up_to = self.up_to[: edges + m]
        number = np.array(number, np.int64)
        number[number < 0] = np.arange(words_kept, words_kept + len(new))
        if edges < KEPT_EDGES:
            self.known.update(zip(new, range(words_kept, words_kept + len(new)), strict=True))
            self.kept = (places + n, edges + m, ways + len(built.way), total + (int(built.up_to[-1]) if m else 0))
        return number[codes] if len(words) else np.zeros(0, np.int64)


def salt(seed: int, key: int, draw: int) -> int:
    x = (seed * 0x9E3779B97F4A7C15 + key * 0xBF58476D1CE4E5B9 + draw * 0x94D049BB133111EB) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    return x ^ (x >> 27)


def uniforms(salts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a function of salt and place; -log(-log(u)) is at most LARGEST."""
    x = salts + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def uniform(salt: int, place: int) -> float:
    """The same for one salt and place."""
    x = (salt + place * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x ^= x >> 33
    x = (x * 0xFF51AFD7ED558CCD) & (2**64 - 1)
    x ^= x >> 29
    x = (x * 0xC4CEB9FE1A85EC53) & (2**64 - 1)
    x ^= x >> 32
    return (x >> 11) * 2.0**-53 + 2.0**-54


#: No Gumbel value from `uniforms` lies further above its location.
LARGEST = 37.5


def draw_words(lattice: Lattices, code: np.ndarray, salts: np.ndarray, places: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks every word to its end; edges word after word, where each word's begin (with the end), and their log-probabilities.

    The words numbered `inside` are walked from the places `start`, all others from their start. One number decides
    whether a word takes its likeliest way as a whole. If not, it leaves that way somewhere: at each place the
    way's edge is taken with its probability given that the way will be left. A step's random number is that of
    place `places[word] + character`.
    """
    # salt and place of a word make one number, to which the characters' are added
    seeds = salts + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = uniforms(seeds ^ np.uint64(0x3C3C3C3C3C3C3C3C), np.zeros(1, np.int64)) < lattice.way_p[code]
    whole[inside] = False
    count, log = lattice.way_n[code], lattice.way_log[code]
    word = np.flatnonzero(~whole)
    count[word], log[word] = 0, 0.0
    at = lattice.start_of_word[code]
    at[inside] = start
    at, way = at[word], lattice.way_at[code[word]]
    on_way = np.ones(len(code), bool)
    on_way[inside] = False
    on_way = on_way[word]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(word):
        e = lattice.first[at]
        stay = lattice.likeliest[at]
        w = np.flatnonzero(on_way)
        stay[w] *= lattice.leave[way[w] + 1] / lattice.leave[way[w]]
        u = uniforms(seeds[word], lattice.within[at])
        miss = np.flatnonzero(u >= stay)
        if len(miss):
            m, head = at[miss], e[miss]
            last = lattice.first[m + 1] - 1
            below, above = lattice.up_to[head], lattice.up_to[last]
            again = (u[miss] - stay[miss]) / (1.0 - stay[miss])
            found = np.searchsorted(lattice.up_to, below + (again * (above - below)).astype(np.int64), "right")
            e[miss] = np.clip(found, head + 1, np.maximum(last, head + 1))
            on_way[miss] = False
        steps.append((word, e))
        count[word] += 1
        log[word] += lattice.log_p[e]
        at = lattice.to[e]
        on = np.flatnonzero(at != END)
        word, at, way, on_way = word[on], at[on], way[on] + 1, on_way[on]
    offset = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(lattice.way_at[code] - offset[:-1], count)
    source += np.arange(len(source))
    out = lattice.way[np.minimum(source, len(lattice.way) - 1)]
    for i, (w, e) in enumerate(steps):
        out[offset[w] + i] = e
    return out, offset, log


def gumbel_below(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at the locations, conditioned to lie below `most` (computed without overflow)."""
    return location - np.log(np.exp(np.minimum(location - most, 700.0)) - np.log(u))


class Search:
    """The sets of cuts of one text, each with its largest perturbed value, and the cuts taken so far."""

    def __init__(self, key: int, begin: np.ndarray, seed: int, k: int) -> None:
        self.key, self.n_words, self.seed, self.k = key, len(begin), seed, k
        self.out: list[tuple[np.ndarray, float, float]] = []
        value = -math.log(-math.log(uniform(salt(seed, key, 0), 0)))
        # value; path it branches from and the edges kept of it; their log-probability; word and position there; edges not to take
        self.sets: list[tuple] = [(value, np.zeros(0, np.int32), 0, 0.0, 0, int(begin[0]), frozenset())] if len(begin) else []
        if not len(begin):
            self.out.append((np.zeros(0, np.int32), 0.0, 0.0))

    def pop(self, lattice: Lattices) -> tuple[int, int]:
        """Takes the best set and its next edge; how many words are left to walk, and where the first is walked from (END: from its start)."""
        self.now = self.sets.pop(0)
        _, _, _, _, word, at, banned = self.now
        self.salt = salt(self.seed, self.key, len(self.out) + 1)
        first, last = int(lattice.first[at]), int(lattice.first[at + 1])
        mass, self.options, sums = 0.0, [], []
        for e, p in zip(range(first, last), lattice.p[first:last].tolist(), strict=True):
            if e not in banned:
                mass += p
                self.options.append(e)
                sums.append(mass)
        u = uniform(self.salt ^ 0x5555, 0)
        self.edge = self.options[min(bisect_right(sums, u * mass), len(sums) - 1)]
        self.edge_array = np.array([self.edge], np.int32)
        start = int(lattice.to[self.edge])
        self.skip = int(start == END)  # the edge ends its word
        return self.n_words - word - self.skip, start

    def take(self, rest: np.ndarray, log_p: float) -> None:
        """Takes the cut that the walk ended."""
        value, path, kept, *_ = self.now
        self.whole = np.concatenate([path[:kept], self.edge_array, rest])
        self.out.append((self.whole, log_p, value))
        self.want = self.k + 1 - len(self.out)
        del self.sets[self.want :]

    def least(self) -> float:
        """What a new set's value must exceed."""
        return self.sets[self.want - 1][0] if len(self.sets) >= self.want else -np.inf

    def offer(self, lattice: Lattices, i: int, value: float, before: float, offset: np.ndarray) -> None:
        """A part: the cuts that take another edge at the i-th place of the tail."""
        if value <= self.least():
            return
        _, _, kept, _, word, _, banned = self.now
        edge = int(self.whole[kept + i])
        new_word = word if i == 0 else word + self.skip + int(np.searchsorted(offset, i - 1, "right")) - 1
        self.sets.append((value, self.whole, kept + i, before, new_word, int(lattice.leaves[edge]), (banned if i == 0 else frozenset()) | {edge}))
        self.sets.sort(key=lambda s: -s[0])
        del self.sets[self.want :]

    def kappa(self) -> float:
        return self.sets[0][0] if self.sets else -np.inf


def split(lattice: Lattices, texts: list[Search], rest: np.ndarray, offset: np.ndarray, word_log: np.ndarray, at: np.ndarray, block: int = 128) -> None:
    """Takes each text's cut (its chosen edge, then its words' edges in `rest`) and offers it the parts of what remains.

    Blocks of places are looked at until no later place can matter: a part's value lies at most LARGEST above the
    log-probability of what it keeps, which only falls.
    """
    begin = offset[at[:-1]]
    lengths = offset[at[1:]] - begin + 1
    edge = np.array([t.edge for t in texts], np.int64)
    before = np.array([t.now[3] for t in texts])  # log-probability of what is kept before the next block
    sums = np.zeros(len(texts))
    walked = np.flatnonzero(at[1:] > at[:-1])
    if len(walked):
        sums[walked] = np.add.reduceat(word_log, at[:-1][walked])
    ends = before + lattice.log_p[edge] + sums
    for t, a, n, log_p in zip(texts, begin.tolist(), lengths.tolist(), ends.tolist(), strict=True):
        t.take(rest[a : a + n - 1], log_p)
    most, key = np.array([t.now[0] for t in texts]), np.array([t.salt ^ 0xAAAA for t in texts], np.uint64)
    open_, lo = np.arange(len(texts)), 0
    while len(open_):
        n = np.minimum(block, lengths[open_] - lo)
        first = np.cumsum(n) - n
        text = np.repeat(open_, n)
        place = np.arange(len(text)) - np.repeat(first, n) + lo
        edges = edge[text]
        later = np.flatnonzero(place)
        edges[later] = rest[begin[text[later]] + place[later] - 1]
        logs = lattice.log_p[edges]
        run = np.cumsum(logs)
        prefix = run - logs
        prefix += np.repeat(before[open_] - prefix[first], n)
        before[open_] = prefix[first + n - 1] + logs[first + n - 1]
        other = -np.expm1(logs)
        if lo == 0:
            for j, i in zip(first.tolist(), open_.tolist(), strict=True):
                if texts[i].now[6]:
                    other[j] = sum(float(lattice.p[e]) for e in texts[i].options if e != texts[i].edge)
        live = np.flatnonzero(other > 1e-15)
        text_l, place_l, prefix_l = text[live], place[live], prefix[live]
        values = gumbel_below(prefix_l + np.log(other[live]), most[text_l], uniforms(key[text_l], place_l))
        least = np.array([t.least() for t in texts])
        good = np.flatnonzero(values > least[text_l])
        good = good[np.lexsort((-values[good], text_l[good]))]
        rank = np.arange(len(good)) - np.searchsorted(text_l[good], text_l[good])
        for g in good[rank < max(t.want for t in texts)].tolist():
            i = int(text_l[g])
            texts[i].offer(lattice, int(place_l[g]), float(values[g]), float(prefix_l[g]), offset[at[i] : at[i + 1] + 1] - offset[at[i]])
        least = np.array([texts[i].least() for i in open_.tolist()])
        open_ = open_[(lo + n < lengths[open_]) & (before[open_] + LARGEST >= least)]
        lo, block = lo + block, block * 2


def search_all(lattice: Lattices, codes: np.ndarray, cut: np.ndarray, keys: list[int], seed: int, k: int) -> list[Search]:
    """Up to k cuts for each text; texts are words codes[cut[i]:cut[i + 1]], and walk together, round after round."""
    begin = lattice.start_of_word[codes] if len(codes) else np.zeros(0, np.int32)
    size = lattice.size_of_word[codes] if len(codes) else np.zeros(0, np.int64)
    place = np.cumsum(size) - size
    # place of a word: characters of its text before it
    place -= np.repeat(place[np.minimum(cut[:-1], max(0, len(place) - 1))], np.diff(cut)) if len(place) else place
    found = [Search(key, begin[a:b], seed, k) for key, a, b in zip(keys, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for _ in range(k):
        some = [i for i, s in enumerate(found) if s.sets and len(s.out) < k]
        if not some:
            break
        asked = [found[i].pop(lattice) for i in some]
        n = [a[0] for a in asked]
        at = np.concatenate([[0], np.cumsum(n)])
        of = np.concatenate([np.arange(cut[i + 1] - m, cut[i + 1]) for i, m in zip(some, n, strict=True)])
        inside = np.array([a for a, (_, start) in zip(at[:-1].tolist(), asked, strict=True) if start != END], np.int64)
        starts = np.array([start for _, start in asked if start != END], np.int64)
        salts = np.repeat(np.array([found[i].salt for i in some], np.uint64), n)
        rest, offset, word_log = draw_words(lattice, codes[of], salts, place[of], inside, starts)
        split(lattice, [found[i] for i in some], rest, offset, word_log, at)
    return found


def words_of(text: str) -> list[str]:
    """The words, each with the marks before it; what follows the last word is a word of marks."""
    if not text:
        return []
    parts = (" " + text).replace(" ", SPACE).split(SPACE)[1:]
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, marks = [], ""
    for p in parts:
        marks += SPACE
        if p:
            out.append(marks + p)
            marks = ""
    return [*out, marks] if marks else out


_LATTICES: dict[tuple[str, float], Lattices] = {}

FULL = "row_key long, sample int, n_pieces long, log_p double, perturbed double, log_inclusion double, ids_crc32 long, decodes boolean, ids array<int>"


def segmentations(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = 1, sharpness: float = 1.0, with_ids: bool = True, packed: bool = False) -> DataFrame:
    """row_key, sample (from 1), n_pieces, log_p, perturbed, log_inclusion, ids_crc32, decodes (the ids give the text back) and ids of each sampled cut.

    Packed, the ids are binary (little-endian, 32 bits each), as those of `packing`; without ids the last column is left out.
    """
    names = [c.split()[0] for c in FULL.split(", ")][: 9 if with_ids else 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, sharpness) not in _LATTICES:
            _LATTICES[model, sharpness] = Lattices(Vocabulary(model, sharpness))
        lattices = _LATTICES[model, sharpness]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(keys):
                hi, chars = lo, 0
                while hi < len(keys) and (hi == lo or chars < BATCH_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                yield batch_samples(lattices, keys[lo:hi], texts[lo:hi])
                lo = hi

    def batch_samples(lattices: Lattices, keys: list, texts: list[str]) -> pa.RecordBatch:
        split = [words_of(t) for t in texts]
        codes = lattices.codes([w for s in split for w in s])
        cut = np.concatenate([[0], np.cumsum([len(s) for s in split])])
        rows: list[tuple] = []
        all_ids: list[np.ndarray] = []
        given: list[str] = []
        for row_key, text, found in zip(keys, texts, search_all(lattices, codes, cut, [0 if x is None else x for x in keys], seed, k), strict=True):
            kappa = found.kappa()
            for n, (path, log_p, value) in enumerate(found.out):
                ids = lattices.piece[path]
                if len(ids) and ids.min() < 0:
                    ids = lattices.vocabulary.with_bytes(ids)
                gap = math.exp(min(log_p - kappa, 700.0)) if kappa > -math.inf else math.inf
                log_inclusion = math.log(-math.expm1(-gap)) if gap > 1e-8 else log_p - kappa
                rows.append((row_key, n + 1, len(ids), log_p, value, log_inclusion, zlib.crc32(ids)))
                all_ids.append(ids)
                given.append(text)
        flat = np.concatenate([np.zeros(0, np.int32), *all_ids])
        at = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])])
        told, n_bytes = lattices.vocabulary.decoded(flat)
        ends = np.concatenate([[0], np.cumsum(n_bytes)])[at].tolist()
        told = told.tobytes()
        for i, (text, a, b) in enumerate(zip(given, ends[:-1], ends[1:], strict=True)):
            rows[i] += (told[a + 1 : b] == text.encode("utf-8", "surrogatepass"),)  # without the space put before
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
        if with_ids:
            if packed:
                columns.append(pa.array([x.tobytes() for x in all_ids], pa.binary()))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("row_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kept = FULL.rpartition(",")[0]
    return rows.mapInArrow(run, f"{kept}, ids binary" if with_ids and packed else FULL if with_ids else kept)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """df and `decoded`, the text of each row's ids (an array, or packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(model, 1.0)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                texts = [None if x is None else vocabulary.decoded(np.frombuffer(x, "<i4") if isinstance(x, bytes) else np.array(x, np.int64))[0].tobytes()[1:].decode("utf-8", "replace") for x in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], names=[*names, "decoded"])

    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = [f.dataType.simpleString() for f in df.schema]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], F.col(f"`{ids}`").alias("ids"))
    out = given.mapInArrow(run, ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds, strict=True)], "decoded string"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], "decoded")
