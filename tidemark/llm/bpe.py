"""Byte-level BPE over ragged numpy arrays, and the safe splitting of texts into repeated pieces."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: The split of byte-level BPE as published with the 50k vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEXT_TO_SPACE = re.compile(r" \s|\s ")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.int64(1 << 40)


def cut_with_care(text: str) -> bool:
    """Whether a space stands next to other white space, so that not every space begins a piece."""
    return _NEXT_TO_SPACE.search(text) is not None


def pieces(text: str) -> list[str]:
    """Cuts at single spaces between characters that aren't white space, where a pre-token always begins.

    Every piece but the first lacks the space that stands before it; cutting there can't change the tokens.
    """
    return _SAFE_SPACE.split(text) if cut_with_care(text) else text.split(" ")


class Interned(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __init__(self, keys=()):
        self.names = list(keys)
        super().__init__((k, n) for n, k in enumerate(self.names))

    def __missing__(self, key):
        n = self[key] = len(self)
        self.names.append(key)
        return n

    def since(self, n: int) -> list:
        return self.names[n:]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else 256 and on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b if b in own else 256 + more))
        more += b not in own
    return out


class ArrayBPE:
    """Counts the tokens of pre-tokens by rank-synchronous merging.

    All pre-tokens of a batch lie in one flat array of symbols. Each round finds the lowest-rank pair of every
    sequence with one segmented minimum, merges all its occurrences (of overlapping ones each second, from the left)
    in all sequences at once, and sets aside the sequences that have no pair left. A merge can only make pairs of
    higher rank than its own, so this gives what merging one pair at a time gives.
    """

    def __init__(self, model: bytes):
        spec = json.loads(model)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.start = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(order.astype(np.int64), _NONE)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(SPLIT)
        added = sorted((t["content"] for t in spec.get("added_tokens", ()) if t["content"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.reset()

    def symbols_left(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each of the byte strings, none of which is empty."""
        left = np.zeros(len(words), np.int64)
        if not words:
            return left
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.start[np.frombuffer(b"".join(words), np.uint8)]
        word = np.arange(len(words))
        while len(sym):
            first = np.cumsum(lens) - lens
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] << 20 | sym[1:]
            key[first + lens - 1] = -1  # no pair reaches into the next sequence
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            left[word[done]] = lens[done]
            hit = np.flatnonzero((rank == np.repeat(low, lens)) & (rank < _NONE))
            if len(hit):
                new = np.append(True, hit[1:] != hit[:-1] + 1)
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[run % 2 == 0]
                sym[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, lens)
            keep[hit + 1] = False
            lens = np.add.reduceat(keep, first, dtype=np.int64)[~done]
            word, sym = word[~done], sym[keep]
        return left

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token's string counts 1 wherever it stands. Pre-tokens are remembered."""
        out = np.zeros(len(texts), np.int64)
        before, flat, lens = len(self.known), [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.added.split(text) if self.added and self.added.search(text) else [text]
            out[i] = len(parts) // 2
            for part in parts[::2]:
                found = self.split.findall(part)
                flat += found
                lens[i] += len(found)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if len(self.known) > before:
            self.counts = np.append(self.counts, self.symbols_left([w.encode("utf-8", "surrogatepass") for w in self.known.since(before)]))
        sums, ends = np.append(0, np.cumsum(self.counts[at])), np.cumsum(lens)
        return out + sums[ends] - sums[ends - lens]

    def reset(self) -> None:
        self.known, self.counts = Interned(), np.zeros(0, np.int64)
