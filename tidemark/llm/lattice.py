"""Unigram subword lattices: the probability of a word summed over all its segmentations.

A word is its characters after a word mark; every vocabulary piece that matches a stretch of it is an arc. The forward
recursion ``alpha[e] = logsumexp(alpha[s] + score[piece])`` over the arcs that end at ``e`` sums all segmentations in log
space. It runs over many words at once: arcs are found for all of them by rolling hashes, one piece length after the
other, and then taken in the order of their end within the word. A character that no piece covers is one unknown piece
and its code point, dealt evenly over all code points, so every text has a positive probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MARK = 0x2581  # begins a word, as in the vocabulary file
OUTSIDE = 0x10FFFF  # stands for the mark inside a word
CODE_POINTS = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _rolled(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = (hashes ^ codes.astype(np.uint64)) * _STEP
    return (x ^ (x >> np.uint64(31))) * _SPREAD


@dataclass(frozen=True)
class Pieces:
    """The vocabulary by length: prefix hashes to go on with, whole hashes with their ids. ``n`` pieces; id n: unknown."""

    n: int
    alive: tuple[np.ndarray, ...]
    whole: tuple[np.ndarray, ...]
    ids: tuple[np.ndarray, ...]

    def plain(self) -> tuple:
        """What to broadcast: ``Pieces(*plain)`` makes it whole in a task, where the class comes with the function."""
        return self.n, self.alive, self.whole, self.ids

    @staticmethod
    def of(texts: list[str]) -> Pieces:
        most = max(map(len, texts))
        alive: list[set[int]] = [set() for _ in range(most)]
        whole: list[list[tuple[int, int]]] = [[] for _ in range(most)]
        for i, text in enumerate(texts):
            h = np.zeros(1, np.uint64)
            for k, c in enumerate(_codes(text)):
                h = _rolled(h, np.array([c]))
                alive[k].add(int(h[0]))
            whole[len(text) - 1].append((int(h[0]), i))
        pairs = [sorted(w) for w in whole]
        return Pieces(
            len(texts),
            tuple(np.array(sorted(a), np.uint64) for a in alive),
            tuple(np.array([h for h, _ in p], np.uint64) for p in pairs),
            tuple(np.array([i for _, i in p], np.int64) for p in pairs),
        )


def _found(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each hash is in the sorted table, where)"""
    if not len(table):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return table[at] == hashes, at


class Lattice:
    """The arcs of many words (texts, A to Z lower-cased, without white space, not empty)."""

    def __init__(self, words: list[str], pieces: Pieces):
        text = "".join(chr(MARK) + w.replace(chr(MARK), chr(OUTSIDE)) for w in words)
        codes = _codes(text)
        starts = np.flatnonzero(codes == MARK)
        self.first = starts + np.arange(len(starts))  # a word of n characters has n + 1 nodes
        self.length = np.diff(np.append(starts, len(codes)))
        word_of = np.repeat(np.arange(len(starts)), self.length)
        node = np.arange(len(codes)) + word_of
        room = self.length[word_of] - (np.arange(len(codes)) - starts[word_of])
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        single = np.zeros(len(codes), bool)
        for k in range(len(pieces.alive)):
            hashes = _rolled(hashes, codes[at + k])
            hit, place = _found(pieces.whole[k], hashes)
            found.append((node[at[hit]], np.full(hit.sum(), k + 1), pieces.ids[k][place[hit]] if hit.any() else place[hit]))
            if k == 0:
                single[at[hit]] = True
            on = _found(pieces.alive[k], hashes)[0] & (room[at] > k + 1)
            at, hashes = at[on], hashes[on]
            if not len(at):
                break
        unknown = node[~single]
        found.append((unknown, np.ones(len(unknown), np.int64), np.full(len(unknown), pieces.n)))
        source, size, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
        self.n, self.nodes = pieces.n, len(codes) + len(starts)
        depth = np.arange(self.nodes) - np.repeat(self.first, self.length + 1)
        target = source + size
        order = np.lexsort((target, depth[target]))
        self.source, self.target, self.piece = source[order], target[order], piece[order]
        self.by_end = np.append(np.flatnonzero(np.diff(depth[self.target], prepend=-1)), len(order))
        self.last = self.first + self.length

    def _sums(self, logs: np.ndarray, heads: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(logs, heads)
        sizes = np.diff(np.append(heads, len(logs)))
        return top + np.log(np.add.reduceat(np.exp(logs - np.repeat(top, sizes)), heads))

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Natural log probability of reaching each node; ``scores``: log probabilities of pieces, the last unknown."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first] = 0
        for a, b in zip(self.by_end, self.by_end[1:], strict=False):
            ends = self.target[a:b]
            heads = np.flatnonzero(np.diff(ends, prepend=-1))
            alpha[ends[heads]] = self._sums(alpha[self.source[a:b]] + scores[self.piece[a:b]], heads)
        return alpha

    def log_probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        return self.forward(scores)[self.last]

    def expected(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (the last: unknown) over all segmentations of the words, ``counts`` times each.

        The slope of a word's log probability by a score is that piece's expected use, so the backward pass hands each
        node's share back along its arcs.
        """
        alpha = self.forward(scores)
        share = np.zeros(self.nodes)
        share[self.last] = counts
        uses = np.zeros(len(self.source))
        for a, b in zip(self.by_end[-2::-1], self.by_end[:0:-1], strict=False):
            source, target, piece = self.source[a:b], self.target[a:b], self.piece[a:b]
            uses[a:b] = share[target] * np.exp(alpha[source] + scores[piece] - alpha[target])
            np.add.at(share, source, uses[a:b])
        return np.bincount(self.piece, uses, self.n + 1)
