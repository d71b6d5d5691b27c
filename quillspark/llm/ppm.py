"""Prediction by partial matching over bytes, with frozen statistics of several languages.

Each language has a tree of byte contexts up to ``order`` bytes, grown on a bounded
labelled sample. A byte costs -log2 of its share in the longest context that knows it;
each longer context that doesn't costs its escape probability (distinct bytes over
distinct plus seen ones). As the statistics are frozen, the cost of a byte depends on at
most ``order`` + 1 bytes, so the trees of all languages are kept as sorted arrays of byte
sequences with a row of exact code lengths, one for each language, and whole batches are
scored in NumPy.
"""

from __future__ import annotations

import numpy as np

ORDER = 4


def _pack(data: np.ndarray, length: int) -> np.ndarray:
    """Every sequence of ``length`` bytes of ``data`` as one number, the last byte lowest."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted number in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTrees:
    def __init__(self, languages: list[str], order: int = ORDER):
        self.languages, self.order = languages, order
        #: for each order: sequences of a context and its byte with their code lengths,
        #: and contexts with their escape lengths
        self.sequences: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []

    @classmethod
    def train(cls, texts: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
        """Trees of the given texts by language; a language without text costs 8 bits a byte."""
        trees = cls(sorted(texts), order)
        width = len(trees.languages)
        data = [np.frombuffer(b"".join(b"\n" * order + t for t in texts[name]), np.uint8) for name in trees.languages]
        for k in range(order + 1):
            counted = [np.unique(_pack(d, k + 1), return_counts=True) for d in data]
            union = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.uint64)
            contexts = np.unique(union >> np.uint64(8))
            seen, distinct = np.zeros((2, len(contexts), width))
            counts = np.zeros((len(union), width))
            for j, (keys, n) in enumerate(counted):
                counts[np.searchsorted(union, keys), j] = n
                at = np.searchsorted(contexts, keys >> np.uint64(8))
                np.add.at(seen[:, j], at, n)
                np.add.at(distinct[:, j], at, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(seen > 0, -np.log2(distinct / (seen + distinct)), 0.0)
                own = np.searchsorted(contexts, union >> np.uint64(8))
                direct = -np.log2(counts / (seen + distinct)[own])
            shorter = trees.cost(union & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(union), width), 8.0)
            trees.sequences.append(union)
            trees.lengths.append(np.where(counts > 0, direct, escape[own] + shorter).astype(np.float32))
            trees.contexts.append(contexts)
            trees.escapes.append(escape.astype(np.float32))
        return trees

    def cost(self, sequences: np.ndarray, order: int | None = None) -> np.ndarray:
        """Bits of the last byte of each sequence of ``order`` + 1 bytes, a column for each language."""
        order = self.order if order is None else order
        out = np.zeros((len(sequences), len(self.languages)), np.float32)
        left = np.arange(len(sequences))
        for k in range(order, -1, -1):
            keys = sequences[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = _find(self.sequences[k], keys)
            out[left[known]] += self.lengths[k][at[known]]
            left, keys = left[~known], keys[~known]
            at, known = _find(self.contexts[k], keys >> np.uint64(8))
            out[left[known]] += self.escapes[k][at[known]]
            if not len(left):
                break
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        if not sizes.sum():
            return out
        lead = b"\n" * self.order
        data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
        packed = _pack(data, self.order + 1)
        # the sequences that end within a text, those over a border left out
        starts = np.cumsum(sizes + self.order) - sizes - self.order
        inside = np.ones(len(packed) + self.order, bool)
        for k in range(self.order):
            inside[starts[1:] - 1 - k] = False
        distinct, where = np.unique(packed[inside[: len(packed)]], return_inverse=True)
        cost = self.cost(distinct)
        full = np.flatnonzero(sizes > 0)
        begins = (np.cumsum(sizes) - sizes)[full]
        for j in range(len(self.languages)):
            out[full, j] = np.add.reduceat(cost[:, j].astype(np.float64)[where], begins)
        return out
