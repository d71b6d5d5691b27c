"""Problem 10: share of repeated content inside one document.

Every document gets a row of cheap statistics from one Arrow pass over its whole text:
sampled 32-character sequences, sentences, lines and words that came before. A decision
list learned by sequential covering (rules.py) from a bounded sample of labelled
statistics, emitted as one ordered Spark ``CASE`` expression, says which documents may
be repetitive; only these are measured exactly. The exact share is no statistic of the
list: it labels the sample, at a bound with a margin, and verifies what the list proposes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.corpus import about
from quillspark.llm.rolling import INVERSE, joined_codes, mix, normalise, powers, prefix_sums, window_hashes
from quillspark.llm.rules import DecisionList, learn
from quillspark.runtime import ship

#: Length of the stretch that must come again, and the share from which a document counts.
STRETCH, SHARE = 50, 0.30
#: The list learns to propose documents of at least this part of SHARE, so that those at the bound are well inside.
MARGIN = 0.5
#: Labelled documents from which the list is learned, at most.
SAMPLE_ROWS = 4000
#: Length of the sampled sequences; of as many neighbouring ones as WINNOW the one of least hash is looked at.
SEQUENCE, WINNOW = 32, 8
#: Characters that are measured together; a longer single text is a slice of its own.
SLICE_CHARS = 2_000_000

STATISTICS = ["covered_share", "sequence_share", "sentence_share", "line_share", "distinct_word_ratio"]
_SENTENCE = re.compile(r"[.!?…。！？।؟\n]+")


def repeated_characters(texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """For normalised texts: how many characters lie in a stretch that came before, and the longest run of such.

    All windows of all texts are hashed by one rolling sum and found again by one
    sort; each window found is compared character by character with the first of
    its hash, so that a collision of hashes changes nothing.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(texts) or lengths.max() <= stretch:
        return out
    codes, starts, _ = joined_codes(texts)
    closing = starts + lengths
    n = len(codes) - stretch + 1
    sums = prefix_sums(codes)
    salt = mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = sums[stretch:] - sums[:n]
        h *= powers(n, INVERSE)
        h += np.repeat(salt, lengths + 1)[:n]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    # windows whose hash may come twice, by 20 bits of it; then exactly, by sorting those alone
    hint = np.zeros(1 << 20, bool)
    hint[twice & np.uint64(0xFFFFF)] = True
    maybe = np.flatnonzero(hint[h & np.uint64(0xFFFFF)])
    order = maybe[np.argsort(h[maybe], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    # the first window of a run of equal hashes is the earliest, as the sort is stable
    run_start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    again, first = order[1:][same], order[run_start[1:][same]]
    by_place = np.argsort(again)
    again, first = again[by_place], first[by_place]
    again = again[_equal(codes, again, first, stretch)]
    change = np.zeros(len(codes) + 1, np.int8)
    change[again] += 1
    change[again + stretch] -= 1  # windows are distinct, and so are their ends
    inside = (np.cumsum(change[:-1], dtype=np.int32) > 0).astype(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(closing, begin)
    np.add.at(out[0], owner, end - begin)
    np.maximum.at(out[1], owner, end - begin)
    return out


def _equal(codes: np.ndarray, a: np.ndarray, b: np.ndarray, stretch: int) -> np.ndarray:
    """Are the windows at ``a`` (ascending) and ``b`` the same? Where both moved on by one, one character decides."""
    goes_on = np.zeros(len(a), bool)
    goes_on[1:] = (np.diff(a) == 1) & (np.diff(b) == 1)
    heads, step = np.flatnonzero(~goes_on), np.arange(stretch)
    if (codes[a + stretch - 1] == codes[b + stretch - 1]).all() and all(
        (codes[a[h][:, None] + step] == codes[b[h][:, None] + step]).all() for h in np.array_split(heads, len(heads) // 50_000 + 1)
    ):
        return np.ones(len(a), bool)
    parts = np.array_split(np.arange(len(a)), len(a) // 50_000 + 1)  # two windows of one hash differ
    return np.concatenate([(codes[a[h][:, None] + step] == codes[b[h][:, None] + step]).all(1) for h in parts])


def _share_of_repeats(parts: list[str]) -> float:
    """Characters in parts that came before over all characters."""
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def sequence_shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For normalised texts: share of the characters in sampled sequences that came before, and share of those sequences.

    Hashes decide here; what is proposed is compared character by character later on.
    """
    if not texts:
        return np.zeros(0), np.zeros(0)
    codes, starts, lengths = joined_codes(texts)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    at = np.arange(max(0, len(codes) - SEQUENCE))
    at = at[at + SEQUENCE <= (starts + lengths)[owner[at]]]
    h = window_hashes(prefix_sums(codes), at, SEQUENCE)
    # least of each run of WINNOW, then the greatest of those around: a sequence equals it if it is the least of some run
    least = np.concatenate([np.zeros(WINNOW, np.uint64), h, np.zeros(WINNOW, np.uint64)])
    for step in (1, 2, 4):
        least = np.minimum(least[:-step], least[step:])
    greatest = least
    for step in (1, 2, 4):
        greatest = np.maximum(greatest[:-step], greatest[step:])
    kept = greatest[1 : len(h) + 1] == h
    at, h = at[kept], h[kept]
    keys = (owner[at].astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(keys, kind="stable")
    again = at[order[1:][keys[order[1:]] == keys[order[:-1]]]]
    change = np.zeros(len(codes) + 1, np.int8)
    change[again] += 1
    change[again + SEQUENCE] -= 1
    inside = np.add.reduceat(np.cumsum(change[:-1], dtype=np.int32) > 0, starts, dtype=np.int64)
    sampled, found = (np.bincount(owner[x], minlength=len(texts)) for x in (at, again))
    return inside / np.maximum(lengths, 1), found / np.maximum(sampled, 1)


def _cheap(raw: list[str], texts: list[str]) -> list[np.ndarray]:
    """Columns STATISTICS of the raw and the normalised texts."""
    shares = [sequence_shares(texts[a:b]) for a, b in _slices(texts)]
    covered, sequences = (np.concatenate([x[k] for x in shares] or [np.zeros(0)]) for k in (0, 1))
    sentences = np.array([_share_of_repeats(_SENTENCE.split(t)) for t in texts], np.float64)
    lines = np.array([_share_of_repeats(t.split("\n")) for t in raw], np.float64)
    words = np.array([len(set(w)) / len(w) if (w := t.split()) else 1.0 for t in texts], np.float64)
    return [covered, sequences, sentences, lines, words]


def _exact(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, repeated characters, longest repeated run) of normalised texts."""
    parts = [repeated_characters(texts[a:b]) for a, b in _slices(texts)]
    repeated, longest = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return np.array([len(t) for t in texts], np.int64), repeated, longest


def statistics(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """``(key, STATISTICS...)`` of each row, and its text if asked for.

    Null, empty and blank texts have shares of 0 and a word ratio of 1. Repeated rows stay
    repeated; whole texts are read.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = ["key", *STATISTICS, *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or "" for t in batch.column(1).to_pylist()]
            columns = [pa.array(c) for c in _cheap(raw, [normalise(t) for t in raw])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([batch.column(1)] if with_text else [])], names)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, " + ", ".join(f"{s} double" for s in STATISTICS) + (", text string" if with_text else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def exact_shares(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., n_chars, repeated_chars, repeated_share, longest_share)`` of each row.

    Null, empty and blank texts have no characters and shares of 0; texts shorter than
    the stretch have a share of 0.
    """
    ship(df.sparkSession)
    columns = [key, *keep]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    names = [*columns, "n_chars", "repeated_chars", "repeated_share", "longest_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, repeated, longest = _exact([normalise(t or "") for t in batch.column(len(columns)).to_pylist()])
            shares = (n, repeated, repeated / np.maximum(n, 1), longest / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), *map(pa.array, shares)], names)

    schema = f"{kinds}, n_chars bigint, repeated_chars bigint, repeated_share double, longest_share double"
    return df.select(*columns, text).mapInArrow(run, schema)


def fit(df: DataFrame, key: str, text: str, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn the list from at most ``sample_rows`` documents, picked by the hash of their key and labelled by their exact share.

    A document is a positive case from MARGIN * ``share`` on. Without any positive case in
    the sample the list proposes what has a covered_share of half of that.
    """
    picked = df.where(about(key, sample_rows, df.count())).orderBy(F.xxhash64(key), key).limit(sample_rows).select(key, text)
    stats = statistics(picked.withColumnRenamed(text, "text"), key, "text", with_text=True)
    sample = exact_shares(stats, key, "text", tuple(STATISTICS)).select(*STATISTICS, "repeated_share").toPandas()
    bound = MARGIN * share
    labels = sample["repeated_share"].to_numpy(np.float64) >= bound
    if not labels.any():
        return learn(np.zeros((0, len(STATISTICS))), np.zeros(0, bool), STATISTICS, offered={"covered_share": [bound / 2]})
    return learn(sample[STATISTICS].to_numpy(np.float64), labels, STATISTICS)


def classify(df: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """Statistics and exact share of each row, ``rule`` (number of the rule that fired, null: none) and ``is_repetitive``."""
    rules = fit(df, key, text, share)
    stats = exact_shares(statistics(df, key, text, with_text=True), key, "text", tuple(STATISTICS))
    fired: Column = rules.expression()
    return stats.withColumn("rule", fired).withColumn("is_repetitive", F.col("rule").isNotNull() & (F.col("repeated_share") >= share))


def found(df: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """Keys of the documents that the list proposes and whose exact share bears it out; no other is measured exactly."""
    rules = fit(df, key, text, share)
    proposed = statistics(df, key, text, with_text=True).where(rules.expression().isNotNull())
    return exact_shares(proposed, key).where(F.col("repeated_share") >= share).select(key)
