"""The pN_ queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import budget, language, near, neighbours, packing, repetition, scans, sentences, split
from quillspark.llm.corpus import current_documents
from quillspark.llm.encode import token_ids
from quillspark.llm.oracles import SQL
from quillspark.runtime import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of documents by byte_bpe_50k."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least 0.30 is repeated, by the learned list and the exact share."""
    return repetition.found(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated content of every document, with the rule of the list that fired."""
    return repetition.classify(table(spark, sf_dir, "documents"), "doc_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks that are too long, cut a word, or overlap too little or too much."""
    return split.stored_faults(table(spark, sf_dir, "document_chunk"), table(spark, sf_dir, "loaded_document")).select("chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current contents cut into overlapping pieces by their structure."""
    return split.pieces(current_documents(table(spark, sf_dir, "loaded_document")), "document_id", "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of a cosine of 0.90 or more under one model, either among the other's five nearest."""
    return neighbours.similar_pairs(table(spark, sf_dir, "embedded_chunk"), table(spark, sf_dir, "sqlite_vector_store"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of different documents whose texts have a similarity of 0.66 or more."""
    return near.similar_chunks(table(spark, sf_dir, "document_chunk"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents with a missing or wrong label, and of paragraphs in another language."""
    return language.found(table(spark, sf_dir, "loaded_document"), table(spark, sf_dir, "language_ref"))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and paragraph."""
    return language.document_languages(table(spark, sf_dir, "loaded_document"), table(spark, sf_dir, "language_ref"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the .md, .docx and .txt contents, by their offsets."""
    rows = sentences.document_sentences(table(spark, sf_dir, "loaded_document"))
    return rows.select("document_id", "start_char_offset", "end_char_offset")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken and misread words, running lines, page numbers and damaged markers of page_block."""
    return scans.found(table(spark, sf_dir, "page_block"), table(spark, sf_dir, "loaded_document"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired paragraphs of every scanned document, over its page ends."""
    return scans.document_paragraphs(table(spark, sf_dir, "page_block"), table(spark, sf_dir, "loaded_document"))


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of chunks and documents by source, language and domain, and all their roll-ups."""
    chunks, loaded, documents, reference = (table(spark, sf_dir, t) for t in ("document_chunk", "loaded_document", "documents", "language_ref"))
    return budget.token_budget(spark, chunks, loaded, documents, reference)


def p6_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cube in bytes, by deltas from earlier deliveries over the present ones to the withdrawal of documents.

    Withdrawn are the documents of which a change of no tenant is on record.
    """
    chunks, loaded, documents, reference, events = (table(spark, sf_dir, t) for t in ("document_chunk", "loaded_document", "documents", "language_ref", "change_event"))
    return budget.after_removal(spark, chunks, loaded, documents, reference, events.where("tenant_id is null"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents assigned to containers of each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of every chunk."""
    return near.groups(table(spark, sf_dir, "document_chunk"))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk that the curves meet."""
    return neighbours.nearest_on_curves(table(spark, sf_dir, "embedded_chunk"), table(spark, sf_dir, "sqlite_vector_store"))


def p7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact five nearest of every chunk whose document number is divisible by 20."""
    number = F.regexp_extract("chunk_id", r"(\d+)#", 1).try_cast("bigint")
    return neighbours.nearest(table(spark, sf_dir, "embedded_chunk"), table(spark, sf_dir, "sqlite_vector_store"), F.coalesce(number % 20 == 0, F.lit(False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p2_paragraphs": p2_paragraphs,
        "p3_found": p3_found,
        "p3_languages": p3_languages,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_budget": p6_budget,
        "p6_deltas": p6_deltas,
        "p7_found": p7_found,
        "p7_neighbours": p7_neighbours,
        "p7_nearest": p7_nearest,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p10_found": p10_found,
        "p10_shares": p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return SQL
