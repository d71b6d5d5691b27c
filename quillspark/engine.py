"""The composed pipeline: load, clean, chunk, embed, store, retrieve, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import providers
from quillspark.config import EmbeddingOptions, IngestionOptions, RerankOptions, StoreOptions
from quillspark.functions.predicates import Predicate
from quillspark.functions.text import parse_score
from quillspark.operators import chunk, index, pages
from quillspark.operators import retrieve as R

#: Chunkers by name: (documents with document_id and content) -> chunks.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": chunk.fixed_size, "sentence": chunk.sentence_groups, "recursive": chunk.recursive, "words": chunk.words}
MODES = ("dense", "sparse", "hybrid")
ENHANCEMENTS = ("hyde", "rag-fusion", "crag", "stepback")


class Engine:
    """Providers default to stand-ins; an enhancement by name needs a chat model."""

    def __init__(
        self, spark: SparkSession, ingestion: IngestionOptions | None = None, embedding: EmbeddingOptions | None = None, rerank: RerankOptions | None = None,
        store: StoreOptions | None = None, embedder: providers.Embedder | None = None, chat: providers.ChatModel | None = None, scorer: providers.PairScorer | None = None,
    ):
        self.spark = spark
        self.ingestion, self.embedding = ingestion or IngestionOptions(), embedding or EmbeddingOptions()
        self.rerank, self.store = rerank or RerankOptions(), store or StoreOptions()
        self.embedder, self.chat, self.scorer = embedder, chat, scorer or providers.OverlapScorer()
        if self.rerank.mode == "llm" and chat is None:
            raise ValueError("reranking by a model needs a chat provider")

    # -- ingest ----------------------------------------------------------------------
    def chunks(self, documents: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
        """``(chunk_id, document_id, chunk_index, text, start_char_offset, end_char_offset, metadata)``."""
        if strategy not in CHUNKERS:
            raise ValueError(f"unknown chunker {strategy}")
        rows = pages.preprocess(documents, self.ingestion.cleaning) if self.ingestion.preprocess else documents
        if strategy == "recursive":
            options.setdefault("limit", self.ingestion.max_chunk)
        out = CHUNKERS[strategy](rows, "document_id", "content", **options)
        out = out.withColumn("chunk_id", F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")))
        if self.ingestion.contextual and self.chat is not None:
            around = chunk.context_window(F.col("content"), F.col("start_char_offset"), F.col("end_char_offset"))
            asked = providers.complete(out.join(rows.select("document_id", "content"), "document_id").withColumn("prompt", F.concat(around, F.lit("\n<chunk>\n"), "text")), "prompt", self.chat)
            out = asked.withColumn("text", F.when(F.coalesce("reply", F.lit("")) != "", F.concat("reply", F.lit("\n\n"), "text")).otherwise(F.col("text"))).drop("prompt", "reply", "content")
        return out.join(documents.select("document_id", "metadata"), "document_id") if "metadata" in documents.columns else out

    def embed(self, chunks: DataFrame) -> DataFrame:
        return providers.embed(chunks, "text", self.embedder, self.embedding.dimensions).withColumn("model_id", F.lit(self.embedding.model))

    def write(self, embedded: DataFrame, collection: str) -> None:
        """Upsert into the collection's partition of the store, by a new version of its table."""
        path = f"{self.store.folder}/{collection}"
        old = self.read(collection)
        merged = embedded if old is None else index.upsert(old, embedded.select(*old.columns))
        version = (self._version(path) or 0) + 1
        merged.write.mode("overwrite").parquet(f"{path}/version={version}")

    def _version(self, path: str) -> int | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        names = [s.getPath() for s in fs.listStatus(hadoop)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=None)

    def read(self, collection: str) -> DataFrame | None:
        version = self._version(f"{self.store.folder}/{collection}")
        return None if version is None else self.spark.read.parquet(f"{self.store.folder}/{collection}/version={version}")

    def remove(self, ids: DataFrame, collection: str) -> None:
        path, old = f"{self.store.folder}/{collection}", self.read(collection)
        if old is not None:
            index.delete(old, ids).write.mode("overwrite").parquet(f"{path}/version={self._version(path) + 1}")

    # -- query -----------------------------------------------------------------------
    def query_vectors(self, queries: list[tuple[str, str]]) -> list[tuple[str, list[float]]]:
        rows = providers.embed(self.spark.createDataFrame(queries, "query_id string, text string"), "text", self.embedder, self.embedding.dimensions)
        return [(r["query_id"], list(r["vector"])) for r in rows.select("query_id", "vector").collect()]  # the request's own rows

    def retrieve(self, collection: DataFrame, queries: list[tuple[str, str]], k: int, mode: str = "hybrid", where: Predicate | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        rows = collection if where is None else collection.where(where.column())
        n = max(self.rerank.candidates, k) if self.rerank.mode != "none" else k
        if mode == "dense":
            out = R.knn(rows, self.query_vectors(queries), n)
        elif mode == "sparse":
            out = R.bm25(rows, queries, n)
        else:
            out = R.hybrid(rows, queries, self.query_vectors(queries), n, over_fetch=self.store.over_fetch)
        return self.reranked(out, collection, queries, k)

    def reranked(self, result: DataFrame, collection: DataFrame, queries: list[tuple[str, str]], k: int) -> DataFrame:
        if self.rerank.mode == "none":
            return R.min_score(result.where(F.col("rank") <= k), self.rerank.floor)
        asked = R.payload(result, collection, ["text"]).join(F.broadcast(self.spark.createDataFrame(queries, "query_id string, query string")), "query_id")
        if self.rerank.mode == "llm":
            prompt = F.concat(F.lit("Rate from 0 to 1 how well the text answers the query.\nQuery: "), "query", F.lit("\nText: "), "text")
            asked = providers.complete(asked.withColumn("prompt", prompt), "prompt", self.chat)
            return R.rerank(asked, parse_score(F.coalesce("reply", F.lit(""))), k, self.rerank.candidates, self.rerank.floor)
        scored = providers.pair_scores(asked, "query", "text", self.scorer)
        return R.rerank(scored, F.col("pair_score"), k, self.rerank.candidates, self.rerank.floor)

    def enhanced(self, name: str, collection: DataFrame, queries: list[tuple[str, str]], k: int, mode: str = "hybrid") -> DataFrame:
        """One of ENHANCEMENTS around ``retrieve``; an empty or equal reply falls back to the query itself."""
        if name not in ENHANCEMENTS:
            raise ValueError(f"unknown enhancement {name}")
        if self.chat is None:
            raise ValueError(f"{name} needs a chat provider")
        ask = lambda p: self.chat.complete([f"{p}: {t}" for _, t in queries])
        if name == "hyde":
            return self.retrieve(collection, [(q, a or t) for (q, t), a in zip(queries, ask("Answer"))], k, mode)
        if name == "rag-fusion":
            lists = [queries]
            replies = [[x.strip() for x in a.split("\n") if x.strip()][:3] for a in ask("Variants")]
            lists += [[(q, r[i] if i < len(r) else t) for (q, t), r in zip(queries, replies)] for i in range(max(map(len, replies), default=0))]
            return R.fold([self.retrieve(collection, x, k, mode) for x in lists], k)
        if name == "stepback":
            general = [(q, a if a and a != t else t) for (q, t), a in zip(queries, ask("General"))]
            return self.retrieve(collection, queries, k, mode) if general == queries else R.rrf([self.retrieve(collection, x, k, mode) for x in (queries, general)], k)
        first = self.retrieve(collection, queries, 2 * k, mode)
        asked = R.payload(first, collection, ["text"]).withColumn("prompt", F.concat(F.lit("Grade: "), "text"))
        return R.crag(providers.complete(asked, "prompt", self.chat, "grade"), k)
