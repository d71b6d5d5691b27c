"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("silo", T.StringType()), T.StructField("department", T.StringType()),
    T.StructField("office", T.StringType()), T.StructField("confidentiality_level", T.StringType()), T.StructField("document_type", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()), T.StructField("author", T.StringType()), T.StructField("last_modified", T.DateType()),
    T.StructField("title", T.StringType()),
])
DOCUMENT = T.StructType([T.StructField("metadata", METADATA), T.StructField("content", T.StringType()), T.StructField("source_path", T.StringType())])
CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType(), False), T.StructField("document_id", T.StringType(), False), T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("text", T.StringType()), T.StructField("start_char_offset", T.IntegerType()), T.StructField("end_char_offset", T.IntegerType()),
    T.StructField("metadata", METADATA), T.StructField("provenance", T.StringType()),
])
EMBEDDED_CHUNK = T.StructType([*CHUNK.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("model_id", T.StringType())])
RESULT = T.StructType([
    T.StructField("query_id", T.StringType(), False), T.StructField("chunk_id", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False),
])
IMAGE = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("caption", T.StringType()),
    T.StructField("image_path", T.StringType()), T.StructField("section_heading", T.StringType()),
    T.StructField("start_char_offset", T.IntegerType()), T.StructField("end_char_offset", T.IntegerType()),
])
TABLE = T.StructType([
    T.StructField("table_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("markdown", T.StringType()),
    T.StructField("section_heading", T.StringType()), T.StructField("start_char_offset", T.IntegerType()), T.StructField("end_char_offset", T.IntegerType()),
])
PROPERTIES = T.MapType(T.StringType(), T.StringType())
ENTITY = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "type", "name")), T.StructField("properties", PROPERTIES)])
RELATION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("from_id", "to_id", "type")), T.StructField("properties", PROPERTIES)])
NODE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "path", "title", "text", "parent_id")),
    T.StructField("child_ids", T.ArrayType(T.StringType())), T.StructField("cross_references", T.ArrayType(T.StringType())),
])
CHANGE_EVENT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("version", T.LongType()),
])
CONVERSATION = T.StructType([
    T.StructField("conversation_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("expires_at", T.TimestampType()),
])
BENCHMARK_QUERY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("expected_facts", T.ArrayType(T.StringType())),
    T.StructField("relevant_keywords", T.ArrayType(T.StringType())), T.StructField("target_section", T.StringType()),
])
