"""Problem 3: language of every document and of every paragraph in another language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.corpus import current_documents
from quillspark.llm.ppm import ContextTrees
from quillspark.runtime import ship

#: The sample the trees are grown on: labelled documents of each language, and characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 80, 4000
FOLDS = 4
#: Letters from which a paragraph has a language of its own.
LEAST_LETTERS = 40
#: Formats whose paragraphs are no segments.
WHOLE_FORMATS = ("pdf", "xlsx")
#: Contents scored together.
SLICE_CHARS = 1_500_000

_PARTING = re.compile(r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*")
_REGION = re.compile(r"[-_].*", re.S)
_WHITE = " \t\r\n"


def paragraphs(content: str) -> list[str]:
    """Parts of a content between blank lines."""
    text = content.strip(_WHITE)
    return _PARTING.split(text) if text else []


def label_names(reference: DataFrame) -> dict[str, str]:
    """Language by each name in language_ref (11 rows, fixed), in lower case."""
    out: dict[str, str] = {}
    for r in reference.select("lang", "iso3", "name", "native_name").collect():
        out |= {x.strip().lower(): r["lang"] for x in r if x}
    return out


def resolve(label: str | None, names: dict[str, str]) -> str | None:
    """Language that a label names, whatever its letter case and region; None if none."""
    if label is None:
        return None
    text = label.strip().lower()
    return names.get(text) or names.get(_REGION.sub("", text).strip())


def _letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def train(documents: DataFrame, names: dict[str, str], sample: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> ContextTrees:
    """Grow the trees on at most ``sample`` labelled documents of each language, ``chars`` of each.

    The labels of the sample may be wrong and its documents mixed. The sample is parted into
    FOLDS by document; trees grown on the other folds name the language of each paragraph, so
    that none is judged by trees that know it, and paragraphs that differ from their label are
    left out, first of the next round and then of the trees that are returned.
    """
    label = F.lower(F.trim(F.col("lang_label")))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map()
    lang = F.coalesce(table[label], table[F.trim(F.regexp_replace(label, "[-_].*", ""))])
    rows = documents.where(F.col("content").isNotNull()).withColumn("lang", lang).where(F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("document_id"), "document_id")
    rows = rows.select("lang", "document_id", F.substring("content", 1, chars).alias("content"))
    picked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).orderBy("document_id").select("lang", "content").collect()
    parts = [(r["lang"], k % FOLDS, _bytes(p)) for k, r in enumerate(picked) for p in paragraphs(r["content"])]
    names_seen = sorted({name for name, _, _ in parts})
    if not parts:
        return ContextTrees.train({name: [] for name in set(names.values())})
    kept = [True] * len(parts)
    for _ in range(2):
        agrees = list(kept)
        for fold in range(FOLDS):
            texts: dict[str, list[bytes]] = {name: [] for name in names_seen}
            for (name, f, part), ok in zip(parts, kept):
                if ok and f != fold:
                    texts[name].append(part)
            trees = ContextTrees.train(texts)
            mine = [i for i, (_, f, _) in enumerate(parts) if f == fold]
            best = np.argmin(trees.code_lengths([parts[i][2] for i in mine]), axis=1)
            for i, j in zip(mine, best):
                # a language that only this fold has can't be told from the others
                agrees[i] = trees.languages[j] == parts[i][0] or not texts[parts[i][0]]
        kept = agrees
    texts = {name: [] for name in names_seen}
    for (name, _, part), ok in zip(parts, kept):
        if ok:
            texts[name].append(part)
    return ContextTrees.train(texts)


def _confidence(bits: np.ndarray, size: int) -> float:
    """Weight of the shortest code among all, at a temperature that grows with the length of the text."""
    scale = max(1.0, size**0.5 / 4)
    return float(1 / np.exp2(-(bits - bits.min()) / scale).sum())


def segments(documents: DataFrame, trees: ContextTrees, names: dict[str, str]) -> DataFrame:
    """``(document_id, segment_no, lang, confidence, is_missing, is_other)``.

    Segment -1 is the whole document, with the language that most letters of its
    paragraphs are in; ``is_missing`` says that its label names no language or another.
    The other segments are the paragraphs, from 0, of formats that have them;
    ``is_other`` says that a paragraph of LEAST_LETTERS or more is not in the main
    language. Null and blank contents have no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    frozen = spark.sparkContext.broadcast(trees)  # its size is bounded by that of the sample

    def score(rows: list[tuple]) -> Iterator[tuple]:
        trees = frozen.value
        split = [paragraphs(content) for _, content, _, _ in rows]
        bits = trees.code_lengths([_bytes(p) for parts in split for p in parts])
        at = 0
        for (key, _, path, label), parts in zip(rows, split):
            own = bits[at : at + len(parts)]
            at += len(parts)
            letters = np.array([_letters(p) for p in parts])
            best = own.argmin(1)
            long = letters >= LEAST_LETTERS
            if long.any():
                main = int(np.bincount(best[long], weights=letters[long]).argmax())
            else:
                main = int(own.sum(0).argmin())
            size = sum(map(len, parts))
            same = best == main
            whole = own[same].sum(0) if same.any() else own.sum(0)
            name = trees.languages[main]
            yield key, -1, name, _confidence(whole, size), resolve(label, names) != name, False
            if (path or "").rpartition(".")[2].lower() not in WHOLE_FORMATS:
                for k, p in enumerate(parts):
                    yield key, k, trees.languages[best[k]], _confidence(own[k], len(p)), False, bool(long[k] and best[k] != main)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("document_id", pa.string()), ("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("is_missing", pa.bool_()), ("is_other", pa.bool_())]
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if r[1].strip(_WHITE)]
            while rows:
                size, n = 0, 0
                while n < len(rows) and (not n or size + len(rows[n][1]) <= SLICE_CHARS):
                    size += len(rows[n][1])
                    n += 1
                columns = zip(*score(rows[:n]))
                rows = rows[n:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])

    source = documents.where(F.col("content").isNotNull() & F.col("document_id").isNotNull()).select("document_id", "content", "source_path", "lang_label")
    return source.mapInArrow(run, "document_id string, segment_no int, lang string, confidence double, is_missing boolean, is_other boolean")


def document_languages(loaded: DataFrame, reference: DataFrame) -> DataFrame:
    """Segments of all current documents of loaded_document, by trees grown on its labelled rows."""
    names = label_names(reference)
    documents = current_documents(loaded)
    return segments(documents, train(documents, names), names)


def found(loaded: DataFrame, reference: DataFrame) -> DataFrame:
    rows = document_languages(loaded, reference)
    return rows.where(F.col("is_missing") | F.col("is_other")).select("document_id", "segment_no", "lang")
