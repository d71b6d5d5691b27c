"""Byte-level BPE by speculation and verification.

A word's tokens are proposed by greedy longest match (an Aho-Corasick automaton over
the vocabulary). Every adjacent pair of proposed tokens is then tested for
compatibility, all distinct pairs of a batch at once in NumPy: two tokens are
compatible when merging the bytes of both would never join across their border.
A token sequence is the encoding of its bytes exactly when all adjacent pairs are
compatible, so only words with a failing pair go through the exact merge loop.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Entries kept of the maps from words to ids in one worker; beyond it they start anew.
CACHE_ENTRIES = 200_000

# The public pre-tokenizer's pattern and the white space it knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: No token of the pattern spans from a non-space to a space, so a text can be cut there.
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


def tokenizer_path(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(f"{name}.json")
    return f"{folder}/{name}.json"


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SpeculativeBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        vocab = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        by_text = model["vocab"]
        size = max(vocab.values()) + 1
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merge_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = by_text[a], by_text[b], by_text[a + b]
            self.left[z], self.right[z] = x, y
            self.merge_rank[x, y] = (rank, z)
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.vocab = vocab
        self.size = size
        # order in which a token comes into being: bytes first, then by rank
        self.order = np.zeros(size, np.int64)
        for rank, z in self.merge_rank.values():
            self.order[z] = rank + 1
        pairs = np.array([[x * size + y, r + 1] for (x, y), (r, _) in self.merge_rank.items()], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_key, self.pair_order = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.trie = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.words = regex.compile(PATTERN).findall
        self.word_ids: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.known_pairs: dict[int, bool] = {}

    # -- exact merging -----------------------------------------------------------
    def merge_exactly(self, data: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap: O(n log n) for any length."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.merge_rank
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = rank[a, b][1]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [t for t, ok in zip(ids, alive) if ok]

    # -- verification ------------------------------------------------------------
    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For arrays of token pairs: does merging leave the border between them open?

        The tokens on either side of the border are unwound in the order opposite to
        their making; at each step the pair that faces the border must have no merge
        that comes before the step which would undo it.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # the first merge that may no longer join the two, as (order, side)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(self.pair_key, x * self.size + y)
            at[at == len(self.pair_key)] = 0
            joined = self.pair_key[at] == x * self.size + y
            bad = joined & (self.pair_order[at] < limit[live])
            good[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            ox, oy = self.order[x], self.order[y]
            going = (ox > 0) | (oy > 0)
            live, x, y, ox, oy = live[going], x[going], y[going], ox[going], oy[going]
            # the later made of the two is unwound; of equals the right one, as merging runs from the left
            unwind_left = ox > oy
            limit[live] = np.where(unwind_left, ox, oy + 1)
            a[live] = np.where(unwind_left, self.right[x], x)
            b[live] = np.where(unwind_left, y, self.left[y])
        return good

    # -- batches -----------------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        """Put the ids of these distinct words into the word map."""
        raw = [w.encode("utf-8") for w in words]
        proposed: list[list[int] | None] = []
        flat: list[int] = []
        ends: list[int] = []
        for data in raw:
            ids, covered = [], 0
            for _, (i, n) in self.trie.iter_long(data.decode("latin-1")):
                ids.append(i)
                covered += n
            if covered != len(data):
                ids = []
            proposed.append(ids)
            flat.extend(ids)
            ends.append(len(flat))
        tokens = np.array(flat, np.int64)
        stops = np.array(ends, np.int64)
        starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        ok = stops > starts
        if len(tokens) > 1:
            inner = np.ones(len(tokens) - 1, bool)
            cut = stops[(stops > 0) & (stops < len(tokens))] - 1
            inner[cut] = False
            key = tokens[:-1] * self.size + tokens[1:]
            distinct, where = np.unique(key[inner], return_inverse=True)
            fine = self.compatible(distinct // self.size, distinct % self.size)[where]
            failing = np.zeros(len(tokens), np.int64)
            failing[:-1][inner] = ~fine
            total = np.concatenate(([0], np.cumsum(failing)))
            ok &= total[stops] == total[starts]
        if len(self.word_ids) > CACHE_ENTRIES:
            self.word_ids.clear()
        for word, data, ids, good in zip(words, raw, proposed, ok.tolist()):
            self.word_ids[word] = np.array(ids if good else self.merge_exactly(data), "<i4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes; null and empty texts have none."""
        pieces = [_PIECE.findall(t) if t else [] for t in texts]
        known = self.piece_ids
        fresh: set[str] = set()
        for p in pieces:
            fresh.update(p)
        if len(known) > CACHE_ENTRIES:
            known.clear()
        fresh = [p for p in fresh if p not in known]
        split = [self.words(p) for p in fresh]
        words: set[str] = set()
        for s in split:
            words.update(s)
        word_ids = self.word_ids
        new = [w for w in words if w not in word_ids]
        if len(word_ids) + len(new) > 2 * CACHE_ENTRIES:
            word_ids.clear()
            new = list(words)
        if new:
            self.learn(new)
            if len(word_ids) < len(words):  # learn() began anew
                self.learn([w for w in words if w not in word_ids])
        get = word_ids.__getitem__
        for p, s in zip(fresh, split):
            known[p] = b"".join(map(get, s))
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


@lru_cache(maxsize=4)
def load(path: str) -> SpeculativeBPE:
    """One encoder for each worker process."""
    return SpeculativeBPE(path)
