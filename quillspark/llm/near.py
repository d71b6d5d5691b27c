"""Problem 1: near copies with small edits, by partition of the universe of tokens.

Similarity is that of the sets of 5-character sequences of the normalised texts. Tokens
are longer windows, hashed: at word starts, or at every character in scripts without
spaces; their width and the share of them that is kept go by size band. The hashed
universe is parted into segments; a text is indexed under its subset of each segment and
under the one-deletion neighbourhood of that. Texts that meet under a signature compare
256-bit sketches of their sequences; what remains is verified exactly.

Signatures expected to be frequent are allocated to several blocks of the index (counted
on a sample of the texts), so that no group gathers in one task; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.rolling import joined_codes, mix, normalise, prefix_sums, window_hashes
from quillspark.operators.graph import connected_components
from quillspark.runtime import checkpoint, ship

GRAM, LEAST = 5, 0.66
#: Segments of the universe (a power of two), and tokens kept of a text, about.
SEGMENTS, TOKENS = 128, 32
#: Size bands by distinct sequences: (from, to, width for words, width for scripts without spaces). They overlap
#: by more than 1 / LEAST, so that two sets of a similarity of LEAST always have a band in common. The wide
#: windows are about four words: at LEAST one word in seven or eight may differ, however they are spread.
BANDS = [(0, 176, 10, 6), (112, 1 << 60, 28, 12)]
#: Characters a space above which every place counts. Up to 1 / LEAST times as many the words count too, so that
#: a text just under the limit and one just over it both have words.
CHARACTERS_A_SPACE = 14
#: Bits of a sketch: one of the least hash in each of so many classes of hashes.
SKETCH_BITS = 256
#: In how many of its first 128 bits, and of all, a pair may differ. At a similarity of 0.66 they differ
#: in 22 and 44 on average, with deviations of 4.3 and 6: a pair at the very threshold is lost to this
#: in 3 of 1000 cases, one of 0.70 in 1 of 10,000.
MOST_HALF, MOST_DIFFERING = 36, 60
#: A signature expected under more texts than this is spread over blocks; of how many texts one is sampled for that.
HOT_TEXTS, HOT_SAMPLE, MOST_BLOCKS = 4000, 64, 64


def _bands_of(sizes: np.ndarray) -> list[np.ndarray]:
    return [(sizes >= low) & (sizes < high) for low, high, _, _ in BANDS]


def _set_sizes(sums: np.ndarray, owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of distinct sequences of each text."""
    at = np.arange(max(0, len(owner) - GRAM))
    at = at[at + GRAM <= (starts + lengths)[owner[at]]]
    h = window_hashes(sums, at, GRAM)
    # the owner in the upper bits, so that one sort does for all texts
    keys = np.sort((owner[at].astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(lengths))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of normalised texts, each signature of a text once."""
    codes, starts, lengths = joined_codes(texts)
    sums = prefix_sums(codes)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    space = codes == 32
    spaces = np.add.reduceat(space, starts) if len(texts) else np.zeros(0)
    words = spaces * CHARACTERS_A_SPACE
    spaced, unspaced = words >= lengths * LEAST, words < lengths
    sizes = _set_sizes(sums, owner, starts, lengths)
    # what repeats within a text doesn't enlarge its set, nor its number of places
    distinct = np.minimum(1.0, sizes / np.maximum(lengths - GRAM + 1, 1))
    begins = np.zeros(len(codes), bool)
    begins[1:] = space[:-1]
    begins[starts] = True
    owners, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, member in enumerate(_bands_of(sizes)):
        for with_spaces in (True, False):
            chosen = member & (spaced if with_spaces else unspaced)
            if not chosen.any():
                continue
            width = BANDS[k][2 if with_spaces else 3]
            at = np.flatnonzero(begins & chosen[owner] if with_spaces else chosen[owner])
            own = owner[at]
            fits = at + width <= starts[own] + lengths[own]
            at, own = at[fits], own[fits]
            places = np.bincount(own, minlength=len(texts)) * distinct
            # kept share by the band of the number of places: steps of the square root of two
            step = np.exp2(np.ceil(np.log2(np.maximum(places, 1)) * 2) / 2)
            share = np.minimum(1.0, TOKENS / step)
            h = window_hashes(sums, at, width)
            kept = (h & np.uint64(0xFFFF)).astype(np.float64) < share[own] * 65536
            owners.append(own[kept])
            tokens.append(h[kept] ^ np.uint64(width))
    # a text too short for its windows is one token
    without = np.setdiff1d(np.flatnonzero(lengths > 0), np.concatenate(owners))
    if len(without):
        whole = [int(window_hashes(sums, starts[i : i + 1], int(lengths[i]))[0]) for i in without]
        owners.append(without)
        tokens.append(np.array(whole, np.uint64))
    own, token = np.concatenate(owners), np.concatenate(tokens)
    order = np.lexsort((token, own))
    own, token = own[order], token[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (token[1:] != token[:-1])
    own, token = own[fresh], token[fresh]
    segment = own * SEGMENTS + (token >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(own), bool)
    first[1:] = segment[1:] != segment[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(own)))
    with np.errstate(over="ignore"):
        total = np.add.reduceat(token, at) if len(at) else np.zeros(0, np.uint64)
        group = np.cumsum(first) - 1
        # each subset itself, and of one of several tokens what is left without each of them
        several = size[group] > 1
        own = np.concatenate([own[at], own[several]])
        signature = np.concatenate([total, total[group[several]] - token[several]])
    order = np.argsort(own, kind="stable")
    return own[order], mix(signature[order])


def sketches(texts: list[str]) -> np.ndarray:
    """A row of four 64-bit numbers for each set of 5-character sequences."""
    codes, starts, lengths = joined_codes(texts)
    least = np.full(len(texts) * SKETCH_BITS, np.iinfo(np.uint64).max, np.uint64)
    n = len(codes) - GRAM + 1
    if n > 0:
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        at = np.flatnonzero((owner[:n] == owner[GRAM - 1 :]) & (codes[GRAM - 1 :] < 0x110000))
        h = window_hashes(prefix_sums(codes), at, GRAM)
        np.minimum.at(least, owner[at] * SKETCH_BITS + (h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), h >> np.uint64(8))
    bits = (mix(least) & np.uint64(1)).astype(np.uint8).reshape(len(texts), SKETCH_BITS)
    return np.packbits(bits, axis=1).view("<i8")


def _index_rows(df: DataFrame, hot: dict[int, int]) -> DataFrame:
    """``(id, s1, s2, s3, s4, keys)`` of each text of ``(id, text)``; texts that came before in the batch are left to the first."""
    hot_key = np.array(sorted(hot), np.uint64)
    hot_blocks = np.array([hot[int(k)] for k in hot_key], np.int64)

    def spread(ids: np.ndarray, own: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put each text of a hot key into every pair of blocks that holds its own block."""
        if not len(hot_key):
            return own, key
        at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
        is_hot = hot_key[at] == key
        if not is_hot.any():
            return own, key
        rows, blocks = np.flatnonzero(is_hot), hot_blocks[at[is_hot]]
        again = np.repeat(rows, blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = (mix(ids[own[again]].view(np.uint64)) % np.repeat(blocks, blocks).astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        with np.errstate(over="ignore"):
            blocked = mix(key[again] + (low * MOST_BLOCKS + high + 1).astype(np.uint64))
        own = np.concatenate([own[~is_hot], own[again]])
        key = np.concatenate([key[~is_hot], blocked])
        order = np.argsort(own, kind="stable")
        return own[order], key[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2000):
                batch = whole.slice(start, 2000)
                ids = batch.column(0).to_numpy()
                _, first = np.unique(ids, return_index=True)
                first.sort()
                ids = ids[first]
                texts = [normalise(t) for t in batch.column(1).take(pa.array(first)).to_pylist()]
                own, key = spread(ids, *signatures(texts))
                s = sketches(texts)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(np.bincount(own, minlength=len(ids)), out=offsets[1:])
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(s[:, k].copy()) for k in range(4)), keys], ["id", "s1", "s2", "s3", "s4", "keys"])

    return df.mapInArrow(run, "id bigint, s1 bigint, s2 bigint, s3 bigint, s4 bigint, keys array<bigint>")


def _hot_signatures(df: DataFrame) -> dict[int, int]:
    """Signatures expected under more than HOT_TEXTS texts, with their number of blocks.

    They are counted on the texts whose id falls into one of HOT_SAMPLE classes. The
    list steers only how work is spread; it has at most (signatures of all texts) /
    HOT_TEXTS entries.
    """
    sample = _index_rows(df.where(F.pmod("id", F.lit(HOT_SAMPLE)) == 0), {}).dropDuplicates(["id"])
    counts = sample.select(F.explode("keys").alias("key")).groupBy("key").count()
    rows = counts.where(F.col("count") * HOT_SAMPLE > HOT_TEXTS).collect()
    return {r["key"] & (1 << 64) - 1: int(min(MOST_BLOCKS, max(2, r["count"] * HOT_SAMPLE // (HOT_TEXTS // 2)))) for r in rows}


#: From how many rows under a key on they are compared in blocks, and comparisons of a block.
BLOCK_ROWS, BLOCK_SIZE = 150, 1 << 17


def _close(rows: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids (two rows) of the pairs of positions whose whole sketches are close; the first halves are known to be."""
    _, ids, s1, s2, s3, s4 = rows
    differing = sum(np.bitwise_count(s[a] ^ s[b]) for s in (s1, s2, s3, s4))
    near = (differing <= MOST_DIFFERING) & (ids[a] != ids[b])
    return np.stack([ids[a[near]], ids[b[near]]])


def _compare(rows: tuple[np.ndarray, ...], fresh: int) -> tuple[list[np.ndarray], int]:
    """(pairs of ids, start of the last key): each row from ``fresh`` on against those before it under its key."""
    key, _, s1, s2, _, _ = rows
    change = np.ones(len(key), bool)
    change[1:] = key[1:] != key[:-1]
    edges = np.append(np.flatnonzero(change), len(key))
    start = np.repeat(edges[:-1], np.diff(edges))
    size = np.repeat(np.diff(edges), np.diff(edges))
    place = np.arange(len(key)) - start
    out = []
    active = np.flatnonzero((place > 0) & (size < BLOCK_ROWS))
    active = active[active >= fresh]
    step = 1
    while len(active):
        other = active - step
        half = np.bitwise_count(s1[active] ^ s1[other]) + np.bitwise_count(s2[active] ^ s2[other])
        k = np.flatnonzero(half <= MOST_HALF)
        if len(k):
            out.append(_close(rows, active[k], other[k]))
        step += 1
        active = active[place[active] >= step]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo < BLOCK_ROWS or hi <= fresh:
            continue
        high = max(1, BLOCK_SIZE // (hi - lo))
        for i in range(max(lo, fresh), hi, high):
            j = min(hi, i + high)
            half = np.bitwise_count(s1[i:j, None] ^ s1[None, lo:j])
            half += np.bitwise_count(s2[i:j, None] ^ s2[None, lo:j])
            k = np.flatnonzero(half.ravel() <= MOST_HALF)
            a, b = k // (j - lo) + i, k % (j - lo) + lo
            before = b < a
            if before.any():
                out.append(_close(rows, a[before], b[before]))
    return out, int(edges[-2]) if len(key) else 0


def _meeting(index: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` of ids under one key whose sketches are close. Rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the key that may go on
        for batch in batches:
            # unsigned, as the bits of negative numbers are counted by their absolute value
            now = tuple(batch.column(k).to_numpy().view(np.uint64 if k > 1 else np.int64) for k in range(6))
            rows = tuple(np.concatenate(p) for p in zip(*held, now)) if held else now
            out, tail = _compare(rows, sum(len(h[0]) for h in held))
            held = [tuple(p[tail:] for p in rows)]
            if out:
                both = np.concatenate(out, 1)
                both = np.unique(np.stack([both.min(0), both.max(0)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0].copy()), pa.array(both[1].copy())], ["a", "b"])

    return index.mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``(a, a2, b, b2, similarity)`` of the pairs that reach ``least``, from the whole sets."""

    def grams(t: str) -> set[str]:
        return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}

    names = ["a", "a2", "b", "b2", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows come from a join on b, so that those of one b follow each other
            kept, values, last, y = [], [], None, set()
            b, s, t = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for i in range(len(b)):
                if b[i] != last:
                    last, y = b[i], grams(normalise(t[i]))
                x = grams(normalise(s[i]))
                common = len(x & y)
                total = len(x) + len(y) - common
                if total and common / total >= least:
                    kept.append(i)
                    values.append(common / total)
            keep = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(4)), pa.array(values, pa.float64())], names)

    left, right = texts.toDF("a", "a2", "s"), texts.toDF("b", "b2", "t")
    both = pairs.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "s", "t")
    return both.mapInArrow(run, "a bigint, a2 bigint, b bigint, b2 bigint, similarity double")


def with_ids(rows: DataFrame) -> DataFrame:
    """Add ``id`` and ``id2``, 128 bits that stand for ``text``: candidates go by the first half, copies by both."""
    return rows.withColumns({"id": F.xxhash64("text"), "id2": F.xxhash64(F.lit("second"), "text")})


def similar_texts(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``(a, a2, b, b2, similarity)``: ids of different texts of ``(id, id2, text)`` that are similar enough.

    Copies are one, by 128 bits of hash; texts that differ in letter case or white space
    alone are two of similarity 1. Texts that are shorter than GRAM when normalised have
    no sequences and are similar to none.
    """
    ship(rows.sparkSession)
    texts_only = rows.select("id", "text")
    index = _index_rows(texts_only, _hot_signatures(texts_only)).select(F.explode("keys").alias("key"), "id", "s1", "s2", "s3", "s4")
    pairs = _meeting(index.repartition("key").sortWithinPartitions("key"))
    pairs = checkpoint(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(wanted, "id", "left_semi").groupBy("id", "id2").agg(F.first("text").alias("text"))
    return _verify(pairs, texts, least)


def similar_chunks(chunks: DataFrame, least: float = LEAST) -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``, the smaller id first: chunks of different documents that are similar enough.

    Copies of a text count as similar (1.0) unless it is shorter than GRAM. Null texts
    take no part; repeated rows of a chunk count once.
    """
    rows = with_ids(chunks.where(F.col("text").isNotNull()).select("chunk_id", "document_id", "text"))
    linked = similar_texts(rows.select("id", "id2", "text"), least).select("a", "a2", "b", "b2")
    # a text with GRAM characters when normalised; only short ones are looked at closely
    long_enough = (F.length("text") >= 64) | (F.length(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " "))) >= GRAM)
    members = rows.where(long_enough).select("chunk_id", "document_id", "id", "id2").distinct()
    x = members.toDF("chunk_x", "document_x", "a", "a2")
    y = members.toDF("chunk_y", "document_y", "b", "b2")
    other = linked.join(x, ["a", "a2"]).join(y, ["b", "b2"]).select("chunk_x", "document_x", "chunk_y", "document_y")
    same = x.join(y, (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2")) & (F.col("chunk_x") < F.col("chunk_y"))).select(*other.columns)
    both = other.unionByName(same).where(F.col("document_x") != F.col("document_y"))
    return both.select(F.least("chunk_x", "chunk_y").alias("chunk_id_a"), F.greatest("chunk_x", "chunk_y").alias("chunk_id_b"))


def groups(chunks: DataFrame, least: float = LEAST) -> DataFrame:
    """``(chunk_id, group_id, links)`` of every chunk with a text: the smallest chunk id of its group, and how many chunks it is linked to.

    Groups are the connected components of similar texts; copies of a text are one vertex
    with many members, so that they are never expanded into pairs. A chunk that is similar
    to no other is a group of its own with 0 links.
    """
    def vertex(a, b):
        return F.concat_ws(".", F.col(a).cast("string"), F.col(b).cast("string"))

    rows = with_ids(chunks.where(F.col("text").isNotNull()).select("chunk_id", "text"))
    found = similar_texts(rows.select("id", "id2", "text"), least)
    linked = checkpoint(found.select(vertex("a", "a2").alias("a"), vertex("b", "b2").alias("b")))
    members = rows.select("chunk_id", vertex("id", "id2").alias("id")).distinct()
    vertices = members.groupBy("id").agg(F.count("*").alias("members"), F.min("chunk_id").alias("first"))
    edges = linked.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    components = connected_components(edges).select("id", "component")
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(vertices.select(F.col("id").alias("b"), "members"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("members").alias("others"))
    known = vertices.join(components, "id", "left").withColumn("component", F.coalesce("component", F.col("id")))
    named = known.groupBy("component").agg(F.min("first").alias("group_id"))
    classes = known.join(named, "component").join(degree, "id", "left")
    links = F.coalesce("others", F.lit(0)) + F.col("members") - 1
    return members.join(classes.select("id", "group_id", links.cast("bigint").alias("links")), "id").select("chunk_id", "group_id", "links")
