"""Byte-level BPE token ids by the tokenizers library, each distinct space-delimited unit encoded once by a worker.

The tokenizer's own splitting pattern never joins across a single space that a non-space follows, so a text is the
sequence of its units (a space and what follows up to the next one) and its ids are theirs, one after the other.
Texts in which that is not certain (double or trailing spaces, other leading white space in a unit, a special token's
string) are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Units that a worker remembers, about 200 bytes each; it then forgets all and begins anew.
REMEMBERED = 800_000
SPECIAL = "<|endoftext|>"
#: A space that other white space or nothing follows.
UNSURE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # byte-level: one character stands for one byte
        self.units: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Remember the ids of each unit (given without its leading space).

        Letters and a tail of these marks are tokens of their own, so a word with a tail is the word and the tail.
        """
        composed, plain = [], set()
        for p in new:
            word = p.rstrip(".,;:!?")
            if len(word) < len(p) and word.isalpha():
                composed.append((p, word, p[len(word) :]))
                if word not in self.units:
                    plain.add(word)
            else:
                plain.add(p)
        self.learn_plain(list(plain))
        tails = [t for t in {t for _, _, t in composed} if t not in self.tails]
        self.tails.update(zip(tails, self.whole(tails), strict=True))
        for p, word, tail in composed:
            self.units[p] = self.units[word] + self.tails[tail]

    def learn_plain(self, new: list[str]) -> None:
        for lo in range(0, len(new), 5000):
            some = new[lo : lo + 5000]
            joined = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.width[ids])
            raw = np.frombuffer(joined.encode(), np.uint8)
            wanted = np.concatenate([np.flatnonzero(raw == 32)[1:], [len(raw)]])
            cut = np.searchsorted(ends, wanted) + 1
            if len(wanted) != len(some) or not np.array_equal(ends[cut - 1], wanted):
                raise RuntimeError("the tokenizer joined units over a space")
            data = ids.tobytes()
            at = [0, *(cut * 4).tolist()]
            self.units.update((p, data[a:b]) for p, a, b in zip(some, at[:-1], at[1:], strict=True))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        batch = list(texts)
        for lo in range(0, len(batch), 64):
            some = batch[lo : lo + 64]
            apart = [SPECIAL not in t and UNSURE.search(t) is None for t in some]
            parts = [t.split(" ") if ok else [t] for t, ok in zip(some, apart, strict=True)]
            first = self.whole([p[0] for p in parts])
            flat = [u for p in parts for u in p[1:]]
            known = list(map(self.units.get, flat))
            gaps = [i for i, k in enumerate(known) if k is None]
            if gaps:
                new = {flat[i] for i in gaps}
                if len(self.units) + 2 * len(new) > self.remembered:
                    self.units.clear()
                self.learn(list(new))
                for i in gaps:
                    known[i] = self.units[flat[i]]
            at = 0
            for begin, p in zip(first, parts, strict=True):
                yield begin + b"".join(known[at : at + len(p) - 1])
                at += len(p) - 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each path, bound and Python worker."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]
