"""Problem 5: cutting oversized contents at natural boundaries.

A content is parsed into a tree: sections under their headings, blocks between blank
lines, lines of lists and tables, sentences, words. Sibling subtrees are merged from
the bottom up while they fit the limit; only oversized nodes are descended into. The
same tree says of any stored chunk whether its ends are borders of some node.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.corpus import current_documents, distinct_chunks
from quillspark.runtime import ship

#: Greatest length of a piece, and what consecutive pieces share, in UTF-16 units.
LIMIT, LEAST_OVERLAP, MOST_OVERLAP = 1000, 20, 200
#: Stored chunks of a document that are audited together.
AUDIT_BLOCK = 512

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.M)
_BLANK = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*")
_ITEM_LINE = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]|^[ \t]*\|", re.M)
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*[ \t\r\n]+|[。！？।؟]+[」』”’)\]]*[ \t\r\n]*)")
_GAP = re.compile(r"[ \t\r\n]+")
_WHITE = " \t\r\n"


def is_word_part(c: str) -> bool:
    """Letters, combining marks and numbers."""
    return unicodedata.category(c)[0] in "LMN"


class Tree:
    """Structure of one content. Positions are code points inside, UTF-16 units outside."""

    def __init__(self, text: str):
        self.text = text
        self.units: np.ndarray | None = None
        if not text.isascii() and max(text) > "￿":
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            self.units = np.concatenate(([0], np.cumsum(1 + (codes > 0xFFFF)))).astype(np.int64)

    def unit(self, at: int) -> int:
        return at if self.units is None else int(self.units[at])

    def size(self, a: int, b: int) -> int:
        return b - a if self.units is None else int(self.units[b] - self.units[a])

    def place(self, unit: int) -> int | None:
        """Code point at a UTF-16 offset; None inside a surrogate pair or outside the content."""
        if self.units is None:
            return unit if 0 <= unit <= len(self.text) else None
        at = int(np.searchsorted(self.units, unit))
        return at if at < len(self.units) and self.units[at] == unit else None

    # -- the levels of the tree: borders of the children of a node -----------------
    def children(self, a: int, b: int, level: int) -> list[int] | None:
        """Borders of the children of the node [a, b) at ``level``; None if this level doesn't part it."""
        text = self.text
        if level < 6:  # sections: under the headings of this depth
            cuts = [m.start() for m in _HEADING.finditer(text, a, b) if len(m[1]) == level + 1]
        elif level == 6:
            cuts = [m.end() for m in _BLANK.finditer(text, a, b)]
        elif level == 7:
            cuts = [m.end() for m in _LINE.finditer(text, a, b)] if _ITEM_LINE.search(text, a, b) else []
        elif level == 8:
            cuts = [m.end() for m in _SENTENCE.finditer(text, a, b)]
        elif level == 9:
            cuts = [m.end() for m in _GAP.finditer(text, a, b)]
        else:
            cuts = [i for i in range(a + 1, b) if not (is_word_part(text[i - 1]) and is_word_part(text[i]))]
        cuts = [c for c in cuts if a < c < b]
        return [a, *cuts, b] if cuts else None

    LEVELS = 11

    # -- packing -----------------------------------------------------------------
    def cores(self, limit: int) -> list[int]:
        """Borders of pieces of at most ``limit`` units that together are the whole content."""
        return [0, *self._pack(0, len(self.text), 0, limit)]

    def _pack(self, a: int, b: int, level: int, limit: int) -> list[int]:
        """Ends of the pieces of the node [a, b)."""
        if self.size(a, b) <= limit:
            return [b]
        while level < self.LEVELS and (borders := self.children(a, b, level)) is None:
            level += 1
        if level == self.LEVELS:
            return self._hard(a, b, limit)
        ends: list[int] = []
        for x, y in zip(borders, borders[1:]):
            part = self._pack(x, y, level + 1, limit)
            # the last piece before and the first of this subtree are siblings: merged if they fit
            if ends and self.size(ends[-2] if len(ends) > 1 else a, part[0]) <= limit:
                ends.pop()
            ends += part
        return ends

    def _hard(self, a: int, b: int, limit: int) -> list[int]:
        """A run without any border: cut at the limit, though not before a combining mark if possible."""
        ends = []
        while self.size(a, b) > limit:
            c = a + limit if self.units is None else bisect_right(self.units, self.units[a] + limit) - 1
            d = c
            while d > a + 1 and unicodedata.category(self.text[d])[0] == "M":
                d -= 1
            a = d if d > a + 1 else c
            ends.append(a)
        return [*ends, b]

    def pieces(self, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> list[tuple[int, int]]:
        """(start, end) in UTF-16 units of overlapping pieces, without white space at their ends."""
        text = self.text
        n = len(text)
        first = n - len(text.lstrip(_WHITE))
        if first == n:
            return []
        if self.size(first, len(text.rstrip(_WHITE))) <= limit:
            return [(self.unit(first), self.unit(len(text.rstrip(_WHITE))))]
        shared = (least + 3 * most) // 4
        borders = self.cores(limit - shared - least)
        out: list[tuple[int, int]] = []
        last_end = first
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            end = b
            while end > a and text[end - 1] in _WHITE:
                end -= 1
            if end == a:
                continue  # white space alone
            start = first if not out else self._overlap(out, last_end, end, least, shared, limit)
            out.append((start, end))
            last_end = end
        return [(self.unit(a), self.unit(b)) for a, b in out]

    def _overlap(self, out: list, last_end: int, end: int, least: int, most: int, limit: int) -> int:
        """Where the next piece begins so that it shares ``least`` to ``most`` units with the one before."""
        low = max(out[-1][0] + 1, last_end - most)
        while low < last_end and (self.size(low, last_end) > most or self.size(low, end) > limit):
            low += 1
        high = last_end
        while high > low and self.size(high, last_end) < least:
            high -= 1
        # all these lie between the same two pieces: at most `most` units, whatever the text
        for level in (6, 7, 8, 9, 10):
            cuts = self.children(max(0, low - 1), min(len(self.text), high + 1), level)
            cuts = [c for c in (cuts or [])[1:-1] if low <= c <= high and self.text[c] not in _WHITE]
            if cuts:
                return cuts[0] if level < 9 else cuts[len(cuts) // 2]
        return low

    # -- auditing ----------------------------------------------------------------
    def is_border(self, unit: int) -> bool:
        """Is this UTF-16 offset a border of some node, down to the words?

        The last level of the tree has the borders of all levels above it, so that the two
        characters around the offset, as a node of that level, decide.
        """
        at = self.place(unit)
        if at is None:
            return False
        return at in (0, len(self.text)) or self.children(at - 1, at + 1, self.LEVELS - 1) is not None


def pieces(df: DataFrame, key: str, content: str, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """``(key, chunk_index, start_char_offset, end_char_offset, text)`` of the pieces of each content.

    Contents within the limit are one piece; null, empty and blank contents have none.
    A run without any border longer than the limit is cut at the limit.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            where: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                tree = Tree(text)
                for k, (a, b) in enumerate(tree.pieces(limit, least, most)):
                    rows.append((k, a, b, text[tree.place(a) : tree.place(b)]))
                    where.append(i)
            columns = list(zip(*rows)) or [()] * 4
            keys = batch.column(0).take(pa.array(where, pa.int64()))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, types))], ["key", "i", "a", "b", "t"])

    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"))
    out = rows.mapInArrow(run, f"key {kind}, i int, a int, b int, t string")
    return out.toDF(key, "chunk_index", "start_char_offset", "end_char_offset", "text")


def faults(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """Stored chunks that break the rules: ``(chunk_id, too_long, cuts_word, bad_overlap)``.

    ``chunks`` has (chunk_id, document_id, chunk_index, start_char_offset, end_char_offset),
    each once; ``documents`` has (document_id, content). Where the content is missing, its
    characters can't be held against the chunk; a null offset breaks no rule.
    """
    ship(chunks.sparkSession)
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    before = F.lag("end_char_offset").over(order)
    rows = chunks.withColumn("overlap", F.when(F.col("chunk_index") > 0, before - F.col("start_char_offset")))
    # bounded groups: the chunks of a document in blocks of their index
    fields = ["chunk_id", "start_char_offset", "end_char_offset", "overlap"]
    grouped = rows.groupBy("document_id", F.expr(f"chunk_index div {AUDIT_BLOCK}").alias("block")).agg(F.collect_list(F.struct(*fields)).alias("chunks"))
    both = grouped.join(documents.select("document_id", "content"), "document_id", "left").select("content", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = None if text is None else Tree(text)
                for c in group:
                    a, b, o = c["start_char_offset"], c["end_char_offset"], c["overlap"]
                    long = a is not None and b is not None and b - a > limit
                    cut = tree is not None and not all(x is None or tree.is_border(x) for x in (a, b))
                    lap = o is not None and not least <= o <= most
                    if long or cut or lap:
                        out.append((c["chunk_id"], long, cut, lap))
            columns = list(zip(*out)) or [()] * 4
            types = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["chunk_id", "too_long", "cuts_word", "bad_overlap"])

    return both.mapInArrow(run, "chunk_id string, too_long boolean, cuts_word boolean, bad_overlap boolean")


def stored_faults(chunks: DataFrame, loaded: DataFrame) -> DataFrame:
    """Faults of the stored chunks of document_chunk against the current contents of loaded_document."""
    columns = ["chunk_id", "document_id", "chunk_index", "start_char_offset", "end_char_offset"]
    return faults(distinct_chunks(chunks, columns), current_documents(loaded))
