"""Alignment of two tokenizers' ids over the same text, and how often ids of both stand for the same stretch of it.

A is a byte-level BPE read by the tokenizers library, B a SentencePiece model. Both encode a text behind one space. The
cumulative byte ends of each side go into a dictionary from end to index; the intersection of the two key sets, sorted,
slices both id lists into groups, the finest stretches on whose borders both sides agree. Links are all pairs of an A
and a B token of one group, expanded slice by slice (a slice of many tokens by its distinct ids and their numbers, so
that no list grows with the product). Neither tokenizer joins across a single space between other characters, so texts
are handled as their units between such spaces; a worker aligns each distinct unit once, thousands in one pass, and
remembers it. Texts where that is not certain are aligned whole.

Counts over the corpus: the documents that hold a pair are counted by a grouped sum with map-side combination. To
bring the counts back, documents lie in blocks (a bounded number of links, in the order of reading); each block asks
for its distinct pairs only, so a frequent pair is asked for once by each block and never by each document, and blocks
meet their answers in a cogroup.

Defined results: a text that is null, empty, or not given back by the bytes of either side has no tokens: zeros, an
empty `groups`, no links. Each row is a document of its own, also if it repeats an id or another row. Rows without an id
are kept. An empty table gives no rows; further columns are not read. Texts of any length are aligned whole.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import int_lists
from tidemark.llm.common import thrifty_batches, written
from tidemark.llm.tokens import UNSURE

#: Units that a worker remembers (about 300 bytes each), and units of one pass.
REMEMBERED, PASS = 400_000, 4000
#: Links (distinct in their document) after which a block of documents ends.
BLOCK_LINKS = 2_000_000
#: Pairs of one group beyond which they are expanded by distinct ids.
LARGE_GROUP = 4096
#: A link is 2^32 times the A id, plus the B id.
SHIFT = 32
ROWS = 200

Aligned = tuple[str, bytes, bytes, int, int, int, int]  # groups, links (int64), their times (int64; empty: once each), A tokens, B tokens, groups, links


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """align(texts) for a tokenizer file A and a SentencePiece model B."""

    NOTHING: Aligned = ("", b"", b"", 0, 0, 0, 0)

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary, letters = self.a.get_vocab(with_added_tokens=True), byte_alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sure = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece crosses a space
        self.width_a, self.width_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        marked = [*(f"{x}," for x in self.name_a), *(f"{x}|" for x in self.name_a), *(f"{x}," for x in self.name_b), *(f"{x};" for x in self.name_b)]
        self.marked, self.marked_sizes = np.array(marked, object), np.fromiter(map(len, marked), np.int64, len(marked))
        self.remembered, self.young, self.old = remembered, {}, {}

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Both sides' ids of a text behind a space; None where their bytes differ from it."""
        a = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        want = f" {text}".encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return a, b

    def sliced(self, a: list[int], b: list[int], ends: list[int]) -> list[Aligned] | None:
        """The groups and links of both id lists, cut at `ends`, byte ends that both sides must have (None where they have not)."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        at_a = dict(zip(np.cumsum(self.width_a[ids_a]).tolist(), range(1, len(a) + 1), strict=True))
        at_b = dict(zip(np.cumsum(self.width_b[ids_b]).tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(at_a.keys() & at_b.keys())
        last = np.searchsorted(common, ends)
        if last[-1] >= len(common) or [common[i] for i in last] != ends:
            return None
        # the end of each group in both lists, and where it begins
        to_a, to_b = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        many_a, many_b = to_a - from_a, to_b - from_b
        # names, those of a group's A side before those of its B side, each with the mark that follows it
        marked = np.empty(len(a) + len(b), np.int64)
        marked[np.arange(len(a)) + np.repeat(from_b, many_a)] = ids_a
        marked[np.arange(len(b)) + np.repeat(to_a, many_b)] = ids_b + 2 * len(self.name_a)
        marked[to_a + from_b - 1] += len(self.name_a)
        marked[to_a + to_b - 1] += len(self.name_b)
        text = "".join(self.marked[marked].tolist())
        text_to = np.cumsum(self.marked_sizes[marked])[to_a + to_b - 1][last]
        # links: group by group each A token with each B token; groups of very many pairs apart
        pairs = many_a * many_b
        large = np.flatnonzero(pairs > LARGE_GROUP)
        plain = pairs.copy()
        plain[large] = 0
        links_to = np.cumsum(plain)
        which = np.repeat(np.arange(len(plain)), plain)
        k = np.arange(len(which)) - (links_to - plain)[which]
        links = ids_a[from_a[which] + k // many_b[which]] << SHIFT | ids_b[from_b[which] + k % many_b[which]]
        data, cut_links = links.tobytes(), (links_to[last] * 8).tolist()
        n_links = np.cumsum(pairs)[last]
        rows = zip(text_to.tolist(), cut_links, *(np.diff(x, prepend=0).tolist() for x in (to_a[last], to_b[last], last + 1, n_links)), strict=True)
        out, t, c = [], 0, 0
        for text_end, link_end, n_a, n_b, n_groups, n in rows:
            out.append((text[t : text_end - 1], data[c:link_end], b"", n_a, n_b, n_groups, n))
            t, c = text_end, link_end
        for g in large.tolist():
            i = int(np.searchsorted(last, g))
            mine, times, found = out[i], Counter(a[from_a[g] : to_a[g]]), Counter(b[from_b[g] : to_b[g]])
            more = {x << SHIFT | y: n * m for x, n in times.items() for y, m in found.items()}
            told = mine[2] or np.ones(len(mine[1]) // 8, np.int64).tobytes()
            out[i] = (mine[0], mine[1] + np.array(list(more), np.int64).tobytes(), told + np.array(list(more.values()), np.int64).tobytes(), *mine[3:])
        return out

    def whole(self, text: str) -> Aligned | None:
        found = self.ids(text)
        return None if found is None else self.sliced(*found, [len(text.encode()) + 1])[0]

    def learn(self, units: list[str]) -> dict[str, Aligned | None]:
        """Units aligned, many joined by spaces at a time; None for a unit without tokens."""
        out: dict[str, Aligned | None] = {}
        for lo in range(0, len(units), PASS):
            some = units[lo : lo + PASS]
            found = self.ids(" ".join(some))
            if found is None:  # a unit among them is not given back
                out.update((u, self.whole(u)) for u in some)
                continue
            made = self.sliced(*found, np.cumsum([len(u.encode()) + 1 for u in some]).tolist())
            if made is None:
                raise RuntimeError("a tokenizer joined units over a space")
            out.update(zip(some, made, strict=True))
        return out

    def of_units(self, units: list[str]) -> dict[str, Aligned | None]:
        """Each distinct unit aligned; those met lately are remembered in two generations, of which the older is let go."""
        here, new = {}, []
        for u in units:
            found = self.young.get(u, self)
            if found is self:
                found = self.old.get(u, self)
                if found is self:
                    new.append(u)
                    continue
                self.young[u] = found
            here[u] = found
        made = self.learn(new)
        self.young.update(made)
        if len(self.young) > self.remembered // 2:
            self.young, self.old = {}, self.young
        return here | made

    def align(self, texts: Sequence[str]) -> Iterator[Aligned | None]:
        apart = [t.split(" ") if t and self.sure and UNSURE.search(f" {t}") is None else None for t in texts]
        here = self.of_units(list(dict.fromkeys(u for units in apart if units for u in units)))
        for t, units in zip(texts, apart, strict=True):
            if units is None:
                yield self.whole(t) if t else None
                continue
            parts = list(map(here.__getitem__, units))
            if None in parts:
                yield None
                continue
            text, links, times, n_a, n_b, n_groups, n_links = zip(*parts, strict=True)
            plain = b"" if not any(times) else b"".join(x or np.ones(len(y) // 8, np.int64).tobytes() for x, y in zip(times, links, strict=True))
            yield ";".join(text), b"".join(links), plain, sum(n_a), sum(n_b), sum(n_groups), sum(n_links)


def distinct_links(links: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links, ascending, and how often each occurs."""
    keys = np.frombuffer(links, np.int64)
    if not times:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.frombuffer(times, np.int64))
    return found, total


_ALIGNERS: dict[tuple[str, str, int], Aligner] = {}


def aligner(path_a: str, path_b: str, remembered: int = REMEMBERED) -> Aligner:
    """One for each pair of paths, bound and Python worker."""
    if (path_a, path_b, remembered) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b, remembered] = Aligner(path_a, path_b, remembered)
    return _ALIGNERS[path_a, path_b, remembered]


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>"


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED, block_links: int = BLOCK_LINKS) -> DataFrame:
    """For each row: its block, doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), distinct links and their times.

    A link that occurs over 2^31 times in one text is an error.
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, held = aligner(path_a, path_b, remembered), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                blocks, found, keys, times = [], [], [], []
                for one in own.align(some.column(1).to_pylist()):
                    one = one or Aligner.NOTHING
                    k, t = distinct_links(one[1], one[2])
                    if held and held + len(k) > block_links:
                        block, held = block + 1, 0
                    held += len(k)
                    blocks.append(block)
                    found.append(one)
                    keys.append(k)
                    times.append(t)
                if found:
                    text, _, _, *sizes = zip(*found, strict=True)
                    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(keys)))
                    if any(len(t) and int(t.max()) >= 2**31 for t in times):
                        raise OverflowError("a link occurs too often in one text")
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), some.column(0), *[pa.array(x, pa.int64()) for x in sizes], pa.array(text, pa.string()), lists, int_lists(times)], names=names)

    return rows.mapInArrow(thrifty_batches(run), ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n (rows that hold it), best (whether no link of its A id has more)."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = written(counts, "alignment-counts").withColumn("a", F.shiftright("link", SHIFT))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each entry of A's vocabulary
    return counts.join(F.broadcast(most), "a").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned (written before) with n_best and count_sum over each row's links, without block, links and times."""
    asked = aligned.select(F.col("block").alias("asker"), F.explode("links").alias("link")).distinct()
    answers = asked.join(counts, "link").select("asker", "link", "n", "best")
    kept = [f for f in aligned.schema.fields if f.name not in ("block", "links", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        link, n, best = (told.column(c).to_numpy() for c in ("link", "n", "best"))
        order = np.argsort(link)
        links, times = (docs.column(c).combine_chunks() for c in ("links", "times"))
        at = order[np.searchsorted(link, links.flatten().to_numpy(), sorter=order)] if len(link) else np.zeros(0, np.int64)
        t = times.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        sums = [total(np.where(best[at], t, 0)), total(t * n[at])]
        return pa.table([docs.column(f.name) for f in kept] + [pa.array(x, pa.int64()) for x in sums], names=[*[f.name for f in kept], "n_best", "count_sum"])

    return aligned.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(score, f"{schema}, n_best long, count_sum long")
