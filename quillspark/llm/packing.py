"""Problem 9: filling containers, as packing of vectors by the dot-product heuristic.

An item has three sizes: tokens, segments (one) and tokens that bear loss; a container
limits all three, the loss to less than its tokens. A container is filled by taking,
again and again, the fitting item whose sizes have the greatest dot product with the
room left. Texts stay whole, so one with more loss than the limit is in a container alone. Items are packed in shards
of bounded size, assigned by hash; each shard packs all capacities, and only its last
containers are less full. An item over the capacity is cut into full containers and a
rest that is packed like an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.encode import slices
from quillspark.runtime import checkpoint, ship

#: Items of a shard, about. A shard is one task's group, whatever the size of the table.
SHARD_ITEMS = 8000
#: A container holds one segment for so many tokens of its capacity, and at least so many.
TOKENS_A_SEGMENT, LEAST_SEGMENTS = 128, 4
#: Share of a container's tokens that may bear loss, where it has more than one item.
LOSS_SHARE = 0.97


def measure(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, tokens, loss_tokens)``: the first line of a text is its prompt and bears no loss.

    In a text of one line all but the first token bear loss. Null and empty texts have 0 of both.
    """
    ship(df.sparkSession)
    path = path or bpe.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens, loss = [], []
            for a, b in slices(texts):
                part = texts[a:b]
                n = [len(r) // 4 for r in encoder.encode_batch(part)]
                heads = [t[: t.find("\n")] if 0 < t.find("\n") < len(t) - 1 else "" for t in part]
                h = [len(r) // 4 for r in encoder.encode_batch(heads)]
                tokens += n
                loss += [max(0, x - (y or 1)) for x, y in zip(n, h)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], ["key", "tokens", "loss_tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, tokens bigint, loss_tokens bigint").withColumnRenamed("key", key)


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number of each item, each of at most the limit of tokens.

    An item with more loss than the limit is alone in its container. Equal items are one class, so that choosing costs the number of classes. Of equal
    products the larger item goes first.
    """
    container = np.full(len(tokens), -1, np.int64)
    alone = np.flatnonzero(loss > limits[2])
    container[alone] = np.arange(len(alone))
    some = np.flatnonzero(loss <= limits[2])
    if not len(some):
        return container
    order = some[np.lexsort((loss[some], tokens[some]))[::-1]]
    t, l = tokens[order], loss[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (l[1:] != l[:-1])
    start = np.flatnonzero(first)
    left = np.diff(np.append(start, len(t)))
    at = start.copy()
    ct, cl = t[start].astype(np.float64), l[start].astype(np.float64)
    most_t, most_s, most_l = (float(x) for x in limits)
    number, total = len(alone), len(t)
    live = np.arange(len(start))
    while total:
        room_t, room_s, room_l = most_t, most_s, most_l
        while room_s >= 1:
            # classes are in descending order of tokens: what is too large is a prefix
            begin = int(np.searchsorted(-ct[live], -room_t, "left"))
            cand = live[begin:]
            if not len(cand):
                break
            score = ct[cand] * (room_t / most_t**2) + room_s / most_s**2 + cl[cand] * (room_l / most_l**2)
            score[cl[cand] > room_l] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            c = cand[k]
            # as many of the class at once as the heuristic would take one after the other
            container[order[at[c]]] = number
            at[c] += 1
            left[c] -= 1
            total -= 1
            room_t, room_s, room_l = room_t - ct[c], room_s - 1, room_l - cl[c]
            if not left[c]:
                live = np.delete(live, begin + k)
                if not len(live):
                    break
        number += 1
    return container


def limits_of(capacity: int) -> tuple[int, int, int]:
    """(tokens, segments, loss-bearing tokens) of a container."""
    return capacity, max(LEAST_SEGMENTS, capacity // TOKENS_A_SEGMENT), int(capacity * LOSS_SHARE)


def assign(sizes: DataFrame, key: str, capacities: list[tuple[int, int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(capacity_id, container_id, key, piece, start_token, tokens, loss_tokens)``.

    ``sizes`` has (key, tokens, loss_tokens), each key once; ``capacities`` are
    (capacity_id, capacity_tokens). A text of at most the capacity has piece 0 alone; a
    longer one has pieces of exactly the capacity in containers of their own and a rest.
    A text without tokens needs no container: its container_id is null.
    """
    sizes = checkpoint(sizes)
    shards = max(1, -(-sizes.count() // shard_items))
    kind = sizes.schema[key].dataType.simpleString()
    names = ["capacity_id", "container_id", key, "piece", "start_token", "tokens", "loss_tokens"]

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity_id, capacity, shard = (int(g) for g in group)
        limits = limits_of(capacity)
        pdf = pdf.sort_values("key")
        n, loss = pdf["tokens"].to_numpy(np.int64), pdf["loss_tokens"].to_numpy(np.int64)
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        # prompts come first: a piece bears the loss that is left after its start
        rest_loss = np.minimum(loss, rest)
        packed = pack(rest[rest > 0], rest_loss[rest > 0], limits)
        rows = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        base = int(packed.max()) + 1 if len(packed) else 0
        some = np.flatnonzero(rest > 0)
        none = np.flatnonzero(n == 0)
        row = np.concatenate([rows, some, none])
        number = np.concatenate([base + np.arange(len(rows)), packed, np.full(len(none), -1)])
        start = np.concatenate([piece * capacity, full[some] * capacity, np.zeros(len(none), np.int64)])
        size = np.concatenate([np.full(len(rows), capacity), rest[some], np.zeros(len(none), np.int64)])
        prompt = (n - loss)[row]
        out = pd.DataFrame({
            "capacity_id": np.int32(capacity_id), "container_id": [f"{capacity_id}-{shard}-{x}" if x >= 0 else None for x in number],
            key: pdf["key"].to_numpy()[row], "piece": np.concatenate([piece, full[some], np.zeros(len(none), np.int64)]).astype(np.int32),
            "start_token": start, "tokens": size, "loss_tokens": np.clip(start + size - np.maximum(prompt, start), 0, size),
        })
        return out[names]

    table = F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities))
    # the hash spreads equal sizes and neighbouring keys over the shards
    rows = sizes.select(F.col(key).alias("key"), "tokens", "loss_tokens", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    rows = rows.select("*", F.explode(table).alias("c")).select("key", "tokens", "loss_tokens", "shard", "c.*")
    schema = f"capacity_id int, container_id string, {key} {kind}, piece int, start_token bigint, tokens bigint, loss_tokens bigint"
    return rows.groupBy("capacity_id", "capacity", "shard").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """All texts of documents in containers of each capacity of pack_capacity (a handful of rows)."""
    sizes = [(r["capacity_id"], r["capacity_tokens"]) for r in capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").collect()]
    return assign(measure(documents, "doc_id", "text"), "doc_id", sizes)
