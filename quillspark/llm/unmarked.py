"""Sentence boundaries in text without marks or spaces: a linear chain over characters.

Every character is tagged as the last of a sentence or as inside one. Features are the
characters around, hashed; the weights of these and of the transitions between tags are
learned by an averaged structured perceptron on sentences whose marks and white space
were taken out, and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import checkpoint

#: Slots of the hashed weights, passes over the training sequences, and their greatest length.
SLOTS, PASSES, MOST_CHARS = 1 << 20, 12, 400
#: Seed of the order, and items that are mixed at a time.
SEED, MIXED_ITEMS = 5, 2000
#: Characters of scripts that are written without spaces: Thai, Kana and Han.
UNSPACED = re.compile(r"[ก-๛぀-ヿ㐀-䶿一-鿿]")
#: What is taken out: white space and marks of every kind.
STRIPPED = re.compile(r"[\s.,;:!?…。、，；：！？「」『』（）()\"'“”‘’·—–-]+")


def stripped(text: str) -> tuple[str, np.ndarray]:
    """The text without marks and white space, and where each of its characters stood."""
    kept = np.ones(len(text), bool)
    for m in STRIPPED.finditer(text):
        kept[m.start() : m.end()] = False
    at = np.flatnonzero(kept)
    return "".join(text[i] for i in at.tolist()), at


def _slots(text: str) -> np.ndarray:
    """(characters, features) slots: one to four characters around each place."""
    codes = np.frombuffer(("\0\0\0" + text + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(text)
    c = [codes[k : k + n] for k in range(8)]  # c[3] is the character itself
    groups = [(3,), (4,), (2, 3), (3, 4), (4, 5), (1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6), (0, 1, 2, 3), (2, 3, 4, 5), (4, 5, 6, 7)]
    out = np.zeros((n, len(groups)), np.int64)
    with np.errstate(over="ignore"):
        for g, places in enumerate(groups):
            h = np.full(n, g + 1, np.uint64)
            for p in places:
                h = (h ^ c[p]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, g] = (h % np.uint64(SLOTS)).astype(np.int64)
    return out


class UnmarkedModel:
    """Weights of the boundary tag for each slot, and of each pair of tags that follow one another."""

    def __init__(self) -> None:
        self.weights = np.zeros(SLOTS, np.float32)
        self.moves = np.zeros((2, 2))
        self.learned = 0

    def _decode(self, emit: np.ndarray) -> np.ndarray:
        n = len(emit)
        tags = np.zeros(n, bool)
        if not n:
            return tags
        (ii, ib), (bi, bb) = self.moves.tolist()
        inside, boundary, back = 0.0, 0.0, []
        inside, boundary = ii, ib + float(emit[0])  # a sequence begins after an inside tag
        for e in emit[1:].tolist():
            x, y = inside + ib, boundary + bb
            u, v = inside + ii, boundary + bi
            back.append((v > u, y > x))
            inside, boundary = (v if v > u else u), (y if y > x else x) + e
        tags[-1] = boundary > inside
        for k in range(n - 2, -1, -1):
            tags[k] = back[k][int(tags[k + 1])]
        return tags

    def tag(self, text: str) -> np.ndarray:
        """Which characters of a stripped text end a sentence; the last one does."""
        tags = self._decode(self.weights[_slots(text)].sum(1)) if len(text) else np.zeros(0, bool)
        if len(tags):
            tags[-1] = True
        return tags

    def learn(self, sequences: list[list[str]]) -> UnmarkedModel:
        """Learn from sequences of sentences at hand, as ``train`` does from a table; their marks and white space are taken out here."""
        data = list(items(sequences))
        return self._passes(len(data), lambda k: _sparse(*self.one_pass(data, k, len(data))))

    def one_pass(self, data: Iterable[tuple[str, list[int]]], number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One pass of the perceptron over ``n`` items, from the present weights: the change of each, and its sum over all steps."""
        now, moves = self.weights, self.moves
        change, held = np.zeros(SLOTS + 4, np.int64), np.zeros(SLOTS + 4, np.int64)
        self.weights, self.moves = now.copy(), moves.copy()
        for done, (text, ends) in enumerate(_mixed(data, number)):
            slots, gold = _slots(text), np.zeros(len(text), bool)
            gold[ends] = True
            got = self._decode(self.weights[slots].sum(1))
            if (got == gold).all():
                continue
            for tags, sign in ((gold, 1), (got, -1)):
                changed = slots[tags].ravel()
                pairs = 2 * np.concatenate(([False], tags[:-1])).astype(int) + tags
                np.add.at(self.weights, changed, np.float32(sign))
                np.add.at(self.moves, (pairs // 2, pairs % 2), sign)
                every = np.concatenate((changed, SLOTS + pairs))
                np.add.at(change, every, sign)
                np.add.at(held, every, sign * (n - done))
        self.weights, self.moves = now, moves
        return change, held

    def _passes(self, n: int, run: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> UnmarkedModel:
        """All passes over ``n`` items; the weights are at last the average of those on the way."""
        self.learned = n
        if not n:
            return self
        now, average = np.zeros(SLOTS + 4), np.zeros(SLOTS + 4)
        for k in range(PASSES):
            at, change, held = run(k)
            average += now
            average[at] += held / n
            now[at] += change
            self._set(now)
        self._set(average / PASSES)
        return self

    def _set(self, values: np.ndarray) -> None:
        self.weights, self.moves = values[:SLOTS].astype(np.float32), values[SLOTS:].reshape(2, 2).copy()

    def cuts(self, text: str) -> list[int]:
        """Ends of the sentences of a text as it stands, the last one included."""
        plain, at = stripped(text)
        return [int(at[k]) + 1 for k in np.flatnonzero(self.tag(plain)).tolist()]


def items(sequences: Iterable[list[str]]) -> Iterator[tuple[str, list[int]]]:
    """Stripped text of at most ``MOST_CHARS`` characters, or one sentence, with the places at which its sentences end."""
    for sentences in sequences:
        parts = [p for p in (stripped(s)[0] for s in sentences) if p]
        while parts:
            size = taken = 0
            while taken < len(parts) and (not taken or size + len(parts[taken]) <= MOST_CHARS):
                size += len(parts[taken])
                taken += 1
            yield "".join(parts[:taken]), (np.cumsum([len(p) for p in parts[:taken]]) - 1).tolist()
            parts = parts[taken:]


def _mixed(data: Iterable[tuple[str, list[int]]], number: int) -> Iterator[tuple[str, list[int]]]:
    """The items in an order of their own for each pass, mixed among ``MIXED_ITEMS`` that are held at a time."""
    data = iter(data)
    group = 0
    while some := list(islice(data, MIXED_ITEMS)):
        for i in np.random.default_rng((SEED, number, group)).permutation(len(some)).tolist():
            yield some[i]
        group += 1


def _sparse(change: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(change | held)
    return at, change[at], held[at]


def train(rows: DataFrame) -> UnmarkedModel:
    """Learn from all rows ``(document_id, item_no, text, ends)``, in the order of their keys' hash.

    Each update looks at the weights that the one before left, so one task runs through all
    rows, a pass a job, and holds few of them at a time. Parts learned apart and averaged
    would need many more passes. What comes to the driver is bounded by the slots.
    """
    spark = rows.sparkSession
    order = F.xxhash64("document_id", "item_no"), "document_id", "item_no"
    data = checkpoint(rows.repartition(1).sortWithinPartitions(*order).select("text", "ends"))
    n = data.count()
    model = UnmarkedModel()

    def run(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        frozen = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = ((text.as_py(), ends.as_py()) for batch in batches for text, ends in zip(batch.column(0), batch.column(1)))
            columns = _sparse(*frozen.value.one_pass(pairs, number, n))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "change", "held"])

        got = data.mapInArrow(work, "slot long, change long, held long").toArrow()
        return tuple(got[c].to_numpy() for c in ("slot", "change", "held"))

    return model._passes(n, run)
